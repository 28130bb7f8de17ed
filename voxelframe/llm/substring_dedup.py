"""Substring de-duplication by recompression.

Rounds of recompression name the tokens of all documents alike: a maximal run
of one symbol becomes one symbol, then each pair of a *left* and a *right*
symbol (a fair coin by name) does.  Names are 64-bit fingerprints of what they
stand for, so that all tasks agree on them without a dictionary.  Whether some
tokens form a symbol depends on a few tokens around them; that interval is
tracked exactly.  Wherever a window of ``window`` words holds the whole interval
of a symbol, every other occurrence of the window parses to the same symbol:
equal substrings have the same interior symbols.

Each window takes as its anchor the interior symbol of the highest round that
it has, of these the one of least hash, which is a function of the window's
words alone.  So two equal windows have equal anchors, and a window can only
repeat if its anchor is found in several documents:

1. anchors (one for several windows) are counted by name: least and greatest document;
2. the occurrences of shared anchors are kept, each with the hash of its *stretch*: all tokens of the consecutive
   windows that it anchors.  Where a whole stretch occurs in a smaller document, all its windows repeat;
3. for anchors with several different stretches, the occurrences of each stretch in its least document are verified window
   by window.

The passes are written to the shared folder.  Names and stretches are joined
with what they occur in by joins that spread hot keys, and only minima and
counts are gathered for a key.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PRIME, Scratch, fold61, free_name, hash_column, join_hot, mix, sums61, text_slices, times61, words_of

#: Rounds of recompression.
ROUNDS = 3
#: The base of the polynomials that hash token intervals.
_BASE = 0x16E6A9D0C5B3F871 % ((1 << 61) - 1)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA24BAED4963EE407)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


class Symbols:
    """The symbols of one round over the tokens of several documents, each with the interval that decides it.

    ``first`` marks symbols that start a document.  A document's ends count as outside, so what depends on them has an
    interval beyond the document, and no window holds it.
    """

    def __init__(self, name: np.ndarray, lo: np.ndarray, hi: np.ndarray, first: np.ndarray):
        self.name, self.lo, self.hi, self.first = name, lo, hi, first

    def _left(self, at: np.ndarray, values: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """Of the symbols before ``at`` the ``values``, or ``edge`` at the start of a document."""
        return np.where(self.first[at], edge, values[at - 1])

    def _last(self) -> np.ndarray:
        return np.append(self.first[1:], True)

    def runs(self) -> Symbols:
        """Maximal runs of one name become a symbol of their own; to end, a run needs the symbols on both sides."""
        n = len(self.name)
        start = np.flatnonzero(self.first | np.append(True, self.name[1:] != self.name[:-1]))
        end = np.append(start[1:], n)
        size = end - start
        name = self.name[start].copy()
        long = size > 1
        name[long] = mix(name[long] * _A + size[long].astype(np.uint64))
        lo = self._left(start, self.lo, self.lo[start] - 1)
        last = self._last()[end - 1]
        hi = np.where(last, self.hi[end - 1] + 1, self.hi[np.minimum(end, n - 1)])
        return Symbols(name, lo, hi, self.first[start])

    def pairs(self, level: int) -> Symbols:
        """A left and a right symbol next to each other become one.

        A pair is decided by its two symbols; a left one alone also by the symbol after it, a right one alone by the one
        before it.
        """
        n = len(self.name)
        right = (mix(self.name + np.uint64(level + 1)) >> np.uint64(63)).astype(bool)
        last = self._last()
        begins = ~right & ~last & np.append(right[1:], False)
        inside = np.append(False, begins[:-1])
        at = np.flatnonzero(~inside)
        pair = begins[at]
        after = np.minimum(at + 1, n - 1)
        name = np.where(pair, mix((self.name[at] ^ _C) * _A + self.name[after]), self.name[at])
        lo = np.where(right[at], self._left(at, self.lo, self.lo[at] - 1), self.lo[at])
        hi = np.where(right[at], self.hi[at], np.where(last[at], self.hi[at] + 1, self.hi[after]))
        return Symbols(name, lo, hi, self.first[at])


def parse(h: np.ndarray, offsets: np.ndarray, rounds: int = ROUNDS) -> list[Symbols]:
    """The symbols of each round."""
    first = np.zeros(len(h), dtype=bool)
    first[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    at = np.arange(len(h), dtype=np.int64)
    out, now = [], Symbols(h, at, at + 1, first)
    for i in range(rounds):
        # runs of tokens are named first; runs of symbols of later rounds are rare and stay pairs' work
        now = (now.runs() if i == 0 else now).pairs(i)
        out.append(now)
    return out


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, modulo 2^61 - 1, by doubling."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        size, prime, tables = max(n, 1 << 16), int(PRIME), []
        for base in (_BASE, pow(_BASE, -1, prime)):
            out = np.ones(1, np.uint64)
            while len(out) < size:
                out = np.concatenate([out, times61(out, np.full(1, pow(base, len(out), prime), np.uint64))])
            tables.append(out)
        _POWERS[0] = tuple(tables)
    return _POWERS[0]


def content(h: np.ndarray):
    """A function of token intervals ``[a, b)`` that hashes what they hold, wherever they lie: a polynomial modulo 2^61 - 1."""
    up, down = _powers(len(h) + 1)
    sums = sums61(times61(fold61(h), up[: len(h)]))
    return lambda a, b: mix(times61(fold61(sums[b] + PRIME - sums[a]), down[a]) + (b - a).astype(np.uint64) * _C)


def anchors(h: np.ndarray, offsets: np.ndarray, window: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The starts of all windows, the name of the anchor of each, and a number that is equal for windows of one anchor."""
    sizes = np.diff(offsets)
    starts = np.concatenate([np.arange(a, a + n - window + 1) for a, n in zip(offsets[:-1], sizes) if n >= window] or [np.zeros(0, np.int64)]).astype(np.int64)
    hashed = content(h)
    # windows without any interior symbol are their own anchors
    name, which = hashed(starts, starts + window), -1 - starts
    open_ = np.ones(len(starts), dtype=bool)
    levels = parse(h, offsets, rounds)
    for level in range(rounds, 0, -1):
        s = levels[level - 1]
        own = np.flatnonzero(open_)
        if not len(own):
            break
        a, b = np.searchsorted(s.lo, starts[own], "left"), np.searchsorted(s.hi, starts[own] + window, "right")
        ok = a < b
        own, a, b = own[ok], a[ok], b[ok]
        # the least hash of each range: two overlapping powers of two cover it
        rank = (mix(s.name ^ _B) & np.uint64(0xFFFFFFFFFF000000)) | (np.arange(len(s.name), dtype=np.uint64) & np.uint64(0xFFFFFF))
        tables = [rank]
        while 1 << len(tables) <= window:
            t, step = tables[-1], 1 << (len(tables) - 1)
            tables.append(np.append(np.minimum(t[:-step], t[step:]), t[max(0, len(t) - step) :]) if len(t) > step else t)
        k = np.floor(np.log2(np.maximum(b - a, 1))).astype(np.int64)
        best = np.zeros(len(own), dtype=np.uint64)
        for i, t in enumerate(tables):
            m = k == i
            best[m] = np.minimum(t[a[m]], t[b[m] - (1 << i)])
        at = a + ((best & np.uint64(0xFFFFFF)).astype(np.int64) - a & 0xFFFFFF)  # the low bits tell where in the range
        name[own] = mix(hashed(s.lo[at], s.hi[at]) + np.uint64(level))
        which[own] = at * (rounds + 1) + level
        open_[own] = False
    return starts, name, which


def stretches(h: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """One entry for each run of consecutive windows with one anchor: document, its first window (by document), their number, anchor name, stretch hash."""
    starts, name, which = anchors(h, offsets, window)
    if not len(starts):
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64),) * 2
    doc = np.searchsorted(offsets, starts, "right") - 1
    begin = np.flatnonzero(np.append(True, (which[1:] != which[:-1]) | (doc[1:] != doc[:-1])))
    count = np.diff(np.append(begin, len(starts)))
    at = starts[begin]
    return doc[begin], at - offsets[doc[begin]], count, name[begin], content(h)(at, at + count + window - 1)


def remove_repeats(docs: DataFrame, window: int = 13, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` (long) and ``kept`` (the words that stay, joined by one space).

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged.  A word goes if a window of ``window`` words covers it whose words also
    start somewhere in a document of a smaller key; windows are judged on the input.  Null, empty and blank texts
    have no words, and texts with fewer words than a window lose none.  Rows that repeat a key are one document to
    the rule (neither is smaller) and each gets its result.  Keys must be integers; rows of null key keep all words.
    An empty table gives an empty result; columns named like the new ones are replaced.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "substrings")
    docs = docs.drop("n_words", "n_removed", "kept")
    # rows are told apart by key and, where keys repeat, by the hash of the text
    repeated = not docs.groupBy(key).count().where("count > 1").isEmpty()
    tag = F.xxhash64(text) if repeated else F.lit(0).cast("long")
    slim = docs.select(F.col(key).cast("long").alias("id"), tag.alias("t"), F.col(text).alias("text")).where("id is not null")

    def release() -> None:
        """Shuffle files of finished passes go when the driver's handles of them do; nothing depends on when."""
        gc.collect()
        spark._jvm.System.gc()

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            h, offsets = hash_column(b.column("text"))
            doc, _, _, name, _ = stretches(h, offsets, window)
            yield pa.record_batch([b.column("id").take(pa.array(doc)), pa.array(name.view(np.int64))], names=["id", "name"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            h, offsets = hash_column(b.column("text"))
            doc, at, count, name, stretch = stretches(h, offsets, window)
            own = pa.array(doc)
            yield pa.record_batch([b.column("id").take(own), b.column("t").take(own), pa.array(at.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(name.view(np.int64)), pa.array(stretch.view(np.int64))], names=["id", "t", "at", "n", "name", "stretch"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            h, offsets = hash_column(b.column("text"))
            starts, doc = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, rows in enumerate(b.column("places").to_pylist()):
                own = np.unique(np.concatenate([np.arange(r["at"], r["at"] + r["n"]) for r in rows]))
                starts.append(own[own <= offsets[i + 1] - offsets[i] - window])
                doc.append(np.full(len(starts[-1]), i))
            doc, starts = np.concatenate(doc), np.concatenate(starts)
            at = starts + offsets[doc]
            w1, w2 = content(h)(at, at + window), content(mix(h + _A))(at, at + window)
            own = pa.array(doc)
            yield pa.record_batch([b.column("id").take(own), b.column("t").take(own), pa.array(starts.astype(np.int32)), pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64))], names=["id", "t", "at", "w1", "w2"])

    # 1. anchors that several documents share
    shared = slim.select("id", "text").mapInArrow(names, "id long, name long").groupBy("name")
    shared = scratch.keep(shared.agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count(F.lit(1)).alias("c")).where("least < most").select("name", "c"), "shared")
    release()
    # 2. their occurrences, and the stretches among them that a smaller document holds
    occurs = slim.mapInArrow(places, "id long, t long, at int, n int, name long, stretch long")
    occurs = scratch.keep(join_hot(occurs, shared, ["name"], "c", "id", always=True).drop("c"), "occurs")
    release()
    first = F.min_by(F.struct("t", "at", "n"), F.struct("id", "at"))
    kinds = scratch.keep(occurs.groupBy("name", "stretch").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("c"), first.alias("f")), "kinds")
    # a stretch found once is its own first occurrence; the others go whole, or lie in the least document again
    lead = kinds.where("c > 1").select("name", "stretch", "c", "least", F.col("f.t").alias("ft"), F.col("f.at").alias("fat"))
    more = join_hot(occurs, lead, ["name", "stretch"], "c", "id").where("id > least or t <> ft or at <> fat")
    more = scratch.keep(more.select("id", "t", "at", "n", F.when(F.col("id") == F.col("least"), F.col("name")).alias("name")), "more")
    scratch.drop("shared", "occurs")
    whole = more.where("name is null").drop("name")
    # 3. of anchors with different stretches, all occurrences in the least document of each, window by window
    own = kinds.select("name", F.col("least").alias("id"), "f.*", F.lit(1).alias("lead")).unionByName(more.where("name is not null").withColumn("lead", F.lit(0)))
    several = own.groupBy("name").agg(F.sum("lead").alias("k"), F.count(F.lit(1)).alias("c")).where("k > 1").select("name", "c")
    several = scratch.keep(several, "several")
    places_of = join_hot(own.drop("lead"), several, ["name"], "c", "id", always=True).groupBy("id", "t").agg(F.collect_list(F.struct("at", "n")).alias("places"))
    single = scratch.keep(slim.join(places_of, ["id", "t"]).mapInArrow(windows, "id long, t long, at int, w1 long, w2 long"), "windows")
    scratch.drop("kinds", "several")
    release()
    again = single.groupBy("w1", "w2").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count(F.lit(1)).alias("c")).where("least < most")
    again = scratch.keep(again.drop("most"), "again")
    alone = join_hot(single, again, ["w1", "w2"], "c", "id").where("id > least").select("id", "t", "at", F.lit(1).alias("n"))
    gone = scratch.keep(whole.unionByName(alone).groupBy("id", "t").agg(F.collect_set(F.struct("at", "n")).alias("gone")), "gone")
    scratch.only("gone")
    release()

    k, t, g = free_name(docs, "_id", "_t", "_gone")
    rows = docs.withColumn(k, F.col(key).cast("long")).withColumn(t, tag)
    joined = rows.join(gone.select(F.col("id").alias(k), F.col("t").alias(t), F.col("gone").alias(g)), [k, t], "left").drop(k, t)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, text):
            kept, removed, total = [], [], []
            for words, runs in zip(words_of(b.column(text)), b.column(g).to_pylist()):
                if runs:
                    edge = np.zeros(len(words) + 1, dtype=np.int64)
                    for r in runs:
                        edge[r["at"]] += 1
                        edge[r["at"] + r["n"] + window - 1] -= 1
                    stays = np.cumsum(edge)[:-1] == 0
                    total.append(len(words))
                    words = [words[i] for i in np.flatnonzero(stays)]
                    removed.append(total[-1] - len(words))
                else:
                    total.append(len(words))
                    removed.append(0)
                kept.append(b" ".join(words))
            others = [i for i, c in enumerate(b.schema.names) if c != g]
            yield pa.record_batch([*[b.column(i) for i in others], pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=[*[b.schema.names[i] for i in others], "n_words", "n_removed", "kept"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return joined.mapInArrow(cut, f"{schema}, n_words long, n_removed long, kept string")
