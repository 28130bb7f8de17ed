"""Document likelihood over a subword lattice.

A word is a path through a lattice whose edges are the pieces of an existing
vocabulary and single bytes.  The scores of the vocabulary weight the edges, and
the forward recursion in log space sums the probabilities of all segmentations,
so that a word gets its marginal probability and not that of one best
segmentation.  One more edge spans each word that the training texts hold, with
its discounted frequency; what the discounts leave goes to the pieces.  Word
frequencies are kept for each language and backed off to those of all
languages; a document's probability is the mixture over the languages, whose
weights are their shares of the training documents.  The frequencies of all
stand for languages of less than ``MIN_SHARE`` of them, which together weigh what
they share (and 0.01).

``P(text) = sum_l share_l * prod_words P_l(word) * P_l(end)`` with
``P_l(w) = (c_l(w) - d_l)+ / N_l + spare_l * ((c(w) - d)+ / N + spare * P_pieces_l(w))``.

The existing scores start rounds of expectation maximisation over all
training words, which fit the weights of the pieces to each language.  Words are
counted over all training texts.  The most frequent ones, a bounded number, are
looked up in the workers; all others are joined by word.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free_name, gathered, group_key, mix, text_slices, words_of

#: Words that the workers hold, of up to eight numbers each, and fewer of more; entries of a worker's counter.
HOT_WORDS, COUNTER = 1 << 18, 300_000
#: The share of the training documents from which a language has frequencies of its own, however many languages there are.
MIN_SHARE = 1 / 256
#: The key of the end of a text: no word holds a blank.
END = b" "
LOG10 = np.log(10.0)
#: Words of one lattice batch; words that are gathered first, so that those of each length are many.
BATCH, GATHER = 2048, 60_000


def read_vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces and natural log weights of a sentencepiece file; a leading blank marks the start of a word.

    Scores of a unigram file are log-probabilities.  Those of a byte-pair file are ranks, counted downwards from 0;
    they are read by Zipf's law, as ``-log(rank + 10)``.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ranked = [(sp.id_to_piece(i).replace("▁", " ").encode(), sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    by_rank = all(float(s).is_integer() for _, s in ranked)
    pieces = {p: (-np.log(10.0 - s) if by_rank else float(s)) for p, s in ranked if p and b" " not in p[1:]}
    least = min(pieces.values())
    for b in range(256):  # any text has a path
        pieces.setdefault(bytes([b]), least)
    return list(pieces), np.array(list(pieces.values()))


class Lattice:
    """The pieces by length, and the recursions over batches of words of equal length."""

    def __init__(self, pieces: list[bytes], weights: np.ndarray, stop: np.ndarray):
        """``weights`` has a row for each language, ``stop`` the probability that a word ends after a piece."""
        self.pieces, self.stop = pieces, stop
        norm = weights - np.logaddexp.reduce(weights, axis=1, keepdims=True) + np.log1p(-stop)[:, None]
        self.log_p = np.hstack([norm, np.full((len(norm), 1), -np.inf)])  # the last column is no piece
        self.p, self.least = np.exp(self.log_p), float(norm.min())
        self.tables, self.bits = {}, np.zeros(1 << 20, dtype=bool)
        for k in sorted({len(p) for p in pieces}):
            own = np.array([i for i, p in enumerate(pieces) if len(p) == k])
            h = self._hash(np.array([list(pieces[i]) for i in own], dtype=np.uint64))
            order = np.argsort(h)
            self.tables[k] = (h[order], own[order])
            self.bits[h >> np.uint64(44)] = True

    @staticmethod
    def _step(h: np.ndarray | None, x: np.ndarray) -> np.ndarray:
        """The hash of strings one byte longer."""
        return x + np.uint64(1) if h is None else h * np.uint64(0x100000001B3) + (x + np.uint64(1))

    def _hash(self, x: np.ndarray) -> np.ndarray:
        out = None
        for j in range(x.shape[1]):
            out = self._step(out, x[:, j])
        return mix(out)

    def edges(self, x: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """For each length the pieces (or their number, for none) that start at each position (one row each) of the words ``x``."""
        out, h = [], None
        n = x.shape[1]
        for k in range(1, min(n, max(self.tables)) + 1):
            h = self._step(h if h is None else h[:, :-1], x[:, k - 1 :])
            if k not in self.tables:
                continue
            keys, own = self.tables[k]
            name = mix(h)
            at = np.nonzero(self.bits[name >> np.uint64(44)])
            wanted = name[at]
            i = np.searchsorted(keys, wanted)
            i[i == len(keys)] = 0
            hit = keys[i] == wanted
            if hit.any():
                got = np.full(h.shape[::-1], len(self.pieces), dtype=np.int64)
                got[at[1][hit], at[0][hit]] = own[i[hit]]
                out.append((k, got))
        return out

    def is_short(self, n: int) -> bool:
        """Whether no path through ``n`` bytes is too improbable for a double, so that plain sums do; others take logarithms."""
        return n * self.least > -600

    @staticmethod
    def _paths(n: int, weighed: list[tuple[int, np.ndarray]], back: bool = False) -> np.ndarray:
        """The sum over all paths from the start to each position, or from there to the end."""
        out = np.zeros((n + 1, weighed[0][1].shape[1])) if weighed else np.zeros((n + 1, 0))
        out[n if back else 0] = 1.0
        for j in range(n - 1, -1, -1) if back else range(1, n + 1):
            for k, p in weighed:
                if back and j + k <= n:
                    out[j] += out[j + k] * p[j]
                elif not back and k <= j:
                    out[j] += out[j - k] * p[j - k]
        return out

    def forward(self, x: np.ndarray, edges: list[tuple[int, np.ndarray]], log_p: np.ndarray) -> np.ndarray:
        """log of the sum over all paths from the start to each position."""
        n = x.shape[1]
        alpha = np.full((n + 1, len(x)), -np.inf)
        alpha[0] = 0.0
        for j in range(1, n + 1):
            into = [alpha[j - k] + log_p[got[j - k]] for k, got in edges if k <= j]
            alpha[j] = _log_sum(into)
        return alpha

    def backward(self, x: np.ndarray, edges: list[tuple[int, np.ndarray]], log_p: np.ndarray) -> np.ndarray:
        n = x.shape[1]
        beta = np.full((n + 1, len(x)), -np.inf)
        beta[n] = 0.0
        for j in range(n - 1, -1, -1):
            beta[j] = _log_sum([beta[j + k] + log_p[got[j]] for k, got in edges if j + k <= n])
        return beta

    def _batches(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        sizes = np.array([len(w) for w in words])
        for n in np.unique(sizes):
            own = np.flatnonzero(sizes == n)
            for a in range(0, len(own), step := max(1, min(BATCH, (BATCH * 32) // (int(n) + 1)))):
                some = own[a : a + step]
                x = np.frombuffer(b"".join(b" " + words[i] for i in some), np.uint8).reshape(len(some), n + 1)
                yield some, x.astype(np.uint64)

    def marginal(self, words: list[bytes]) -> np.ndarray:
        """Natural log of the probability of each word in each language, all segmentations summed."""
        out = np.zeros((len(words), len(self.stop)))
        for some, x in self._batches(words):
            edges = self.edges(x)
            for i, log_p in enumerate(self.log_p):
                if self.is_short(x.shape[1]) and edges:
                    with np.errstate(divide="ignore"):
                        whole = np.log(self._paths(x.shape[1], [(k, self.p[i][got]) for k, got in edges])[-1])
                else:
                    whole = self.forward(x, edges, log_p)[-1]
                out[some, i] = whole + np.log(self.stop[i])
        return out

    def expected(self, words: list[bytes], there: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over the segmentations of the words that are ``there`` (word, language), by language."""
        out = np.zeros(self.log_p.shape)
        for some, x in self._batches(words):
            edges = self.edges(x)  # which pieces fit where is the same in all languages
            for i, log_p in enumerate(self.log_p):
                own = np.flatnonzero(there[some, i])
                if not len(own):
                    continue
                part = edges if len(own) == len(x) else [(k, got[:, own]) for k, got in edges]
                if self.is_short(x.shape[1]) and edges:
                    weighed = [(k, self.p[i][got]) for k, got in part]
                    alpha, beta = self._paths(x.shape[1], weighed), self._paths(x.shape[1], weighed, back=True)
                    alpha /= alpha[-1]
                    for (k, p), (_, got) in zip(weighed, part):
                        n = len(got)
                        p *= alpha[:n]
                        p *= beta[k : k + n]
                        out[i] += np.bincount(got.ravel(), p.ravel(), len(log_p))
                    continue
                alpha, beta = self.forward(x[own], part, log_p), self.backward(x[own], part, log_p)
                for k, got in part:
                    n = len(got)
                    share = np.exp(alpha[:n] + log_p[got] + beta[k : k + n] - alpha[-1])
                    out[i] += np.bincount(got.ravel(), share.ravel(), len(log_p))
        return out[:, :-1]


def _log_sum(terms: list[np.ndarray]) -> np.ndarray:
    x = np.stack(terms)
    top = x.max(0)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return safe + np.log(np.exp(x - safe).sum(0))


def _discount(n1: int | None, n2: int | None) -> float:
    n1, n2 = n1 or 0, n2 or 0
    return min(max(n1 / (n1 + 2 * n2), 0.1), 0.95) if n1 else 0.5


def _expected(table: DataFrame, columns: list[str], model: Lattice) -> tuple[np.ndarray, np.ndarray]:
    """Expected uses of each piece over the words of each language, and the number of its words."""
    shared, width = table.sparkSession.sparkContext.broadcast(model), len(model.pieces) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(columns), width))
        for b in gathered(batches, GATHER):
            b = b.filter(pc.not_equal(b.column("w"), pa.scalar(END, pa.binary())))
            there = np.stack([np.asarray(b.column(c)) > 0 for c in columns], 1)
            sums[:, :-1] += shared.value.expected(b.column("w").to_pylist(), there)
            sums[:, -1] += there.sum(0)
        at = np.flatnonzero(sums)
        yield pa.record_batch([pa.array(at), pa.array(sums.ravel()[at])], names=["i", "x"])

    out = np.zeros(len(columns) * width)
    # one row for each piece and language
    for i, x in table.where("c > 0").select("w", *columns).mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x")).collect():
        out[i] = x
    out = out.reshape(len(columns), width)
    return out[:, :-1], out[:, -1]


def score(docs: DataFrame, learn: Column, vocabulary: str, lang: str = "lang", key: str = "doc_id", text: str = "text", hot_words: int = HOT_WORDS, rounds: int = 3, min_share: float = MIN_SHARE) -> DataFrame:
    """``docs`` without its text, with ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``.

    Tokens are the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then one end.  ``learn`` picks the training rows by
    columns of ``docs``.  ``base_score`` is the add-one estimate of single words, ``score`` the log10 probability of the
    text under the model above.  Null and empty texts are just an end.  Null is a language like any other.  Without
    training rows the pieces alone score.  Repeated rows are scored each; an empty table gives an empty result.
    Columns named like the new ones are replaced.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    docs = docs.drop("n_tokens", "n_known", "train_tokens", "base_score", "score")
    l, t, w = free_name(docs, "_l", "_train", "_uid")
    rows = docs.withColumn(l, group_key(F.col(lang))).withColumn(t, F.coalesce(learn, F.lit(False)))
    trained = rows.where(F.col(t)).count()
    sizes = rows.where(F.col(t)).groupBy(l).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_share * trained).orderBy(F.desc("n"), l).collect()
    names = {r[0]: i for i, r in enumerate(sizes)}
    m = len(names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # language: its number, -1 for those without one, -2 for texts that are only scored
        own: dict[int, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for i, c in own.items():
                yield pa.record_batch([pa.array(list(c), pa.binary()), pa.array(np.full(len(c), i, np.int32)), pa.array(list(c.values()), pa.int64())], names=["w", "l", "n"])
            own.clear()

        for b in text_slices(batches, text):
            for words, name, train in zip(words_of(b.column(text), lower=True), b.column(l).to_pylist(), b.column(t).to_pylist()):
                words.append(END)
                own.setdefault(names.get(name, -1) if train else -2, Counter()).update(words)
            if sum(map(len, own.values())) > COUNTER:
                yield from flush()
        yield from flush()

    counted = rows.select(text, l, t).mapInArrow(count, "w binary, l int, n long").groupBy("w")
    counted = counted.agg(*[F.sum(F.when(F.col("l") == i, F.col("n")).otherwise(0)).alias(f"c{i}") for i in range(m)], F.sum(F.when(F.col("l") >= -1, F.col("n")).otherwise(0)).alias("c"), F.sum("n").alias("a"))
    table = scratch.keep(counted, "words")
    columns = [f"c{i}" for i in range(m)] + ["c"]
    stats = table.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("n", F.sum), ("v", lambda c: F.sum((F.col(c) > 0).cast("long"))), ("one", lambda c: F.sum((F.col(c) == 1).cast("long"))), ("two", lambda c: F.sum((F.col(c) == 2).cast("long"))))]).first()
    total = np.array([float(stats[f"n_{c}"] or 0) for c in columns])
    kinds = np.array([float(stats[f"v_{c}"] or 0) for c in columns])
    d = np.array([_discount(stats[f"one_{c}"], stats[f"two_{c}"]) for c in columns])
    spare = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
    n_train, v_train = int(total[-1]), int(kinds[-1])

    # the weights of the pieces: expectation maximisation over all kinds of training words
    pieces, weights = read_vocabulary(vocabulary)
    model = Lattice(pieces, np.tile(weights, (m + 1, 1)), np.full(m + 1, 0.25))
    prior = np.exp(weights - np.logaddexp.reduce(weights))
    for _ in range(rounds):
        uses, words = _expected(table, columns, model)
        each = uses.sum(1, keepdims=True)
        # a language without words keeps the existing scores
        model = Lattice(pieces, np.log(uses + prior * (each * 0.001 + 1)), (words + 1) / (words + each[:, 0] + 4))
    lattice = spark.sparkContext.broadcast(model)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches, GATHER):
            words = b.column("w").to_pylist()
            end = np.array([x == END for x in words])
            log_p = lattice.value.marginal([b"" if x == END else x for x in words])
            log_p[end] = -np.inf  # always counted, where anything is
            c = np.stack([np.asarray(b.column(x)) for x in columns], 1).astype(np.float64)
            own = np.where(c > 0, c - d, 0.0) / np.maximum(total, 1)
            # in logs, as a long word may be too improbable for a double
            with np.errstate(divide="ignore"):
                own, left = np.log(own), np.log(spare)
                pool = own[:, -1:] if n_train else np.full((len(own), 1), -np.inf)
                lp = np.logaddexp(own[:, :-1], left[:-1] + np.logaddexp(pool, left[-1] + log_p[:, :-1]))
                whole = np.logaddexp(own[:, -1], left[-1] + log_p[:, -1])
            lp = np.column_stack([lp, whole]) / LOG10
            if not n_train:
                lp[end] = 0.0
            base = np.log10((c[:, -1] + 1) / (n_train + v_train + 1))
            yield pa.record_batch([b.column("w"), b.column("a"), pa.array((c[:, -1] > 0).astype(np.int32)), pa.array(base), *[pa.array(np.ascontiguousarray(lp[:, i])) for i in range(m + 1)]], names=["w", "a", "known", "base", *[f"p{i}" for i in range(m + 1)]])

    ps = [f"p{i}" for i in range(m + 1)]
    weighed = scratch.keep(table.select("w", *columns, "a").mapInArrow(weigh, "w binary, a long, known int, base double, " + ", ".join(f"{p} double" for p in ps)), "weighed")
    # words by the logarithm of their count: the bar that leaves at most hot_words above it
    hist = {r[0]: r[1] for r in weighed.groupBy(F.floor(F.log2("a") * 8).alias("g")).agg(F.count(F.lit(1))).collect()}
    bar, above, hot_words = 1 << 30, 0, hot_words * 8 // max(8, m + 3)
    for g in sorted(hist, reverse=True):
        above += hist[g]
        if above > hot_words:
            break
        bar = g
    is_hot = F.floor(F.log2("a") * 8) >= bar
    got = weighed.where(is_hot).drop("a").toPandas()
    # a row for each word and, at the end, one of zeros for words that are not there
    values = np.vstack([np.column_stack([got[ps].to_numpy(np.float64), got["base"].to_numpy(np.float64), got["known"].to_numpy(np.float64)]), np.zeros((1, len(ps) + 2))])
    hot = spark.sparkContext.broadcast(({bytes(x): i for i, x in enumerate(got["w"])}, values))
    others = [c for c in rows.columns if c not in (text, l, t)]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, values = hot.value
        none = len(values) - 1
        uid = TaskContext.get().partitionId() << 40
        for b in text_slices(batches, text):
            texts = words_of(b.column(text), lower=True)
            for ws in texts:
                ws.append(END)
            size = np.array([len(x) for x in texts])
            flat = list(itertools.chain.from_iterable(texts))
            at = np.fromiter(map(index.get, flat, itertools.repeat(none)), dtype=np.int64, count=len(flat))
            doc = np.repeat(np.arange(len(texts)), size)
            cols = np.add.reduceat(values[at], np.cumsum(size) - size, axis=0).T  # every text has a token
            rare: list[Counter] = [Counter() for _ in texts]
            for i in np.flatnonzero(at == none):
                rare[doc[i]][flat[i]] += 1
            ids = np.arange(uid, uid + len(texts))
            uid += len(texts)
            yield pa.record_batch(
                [*[b.column(c) for c in others], pa.array(ids), pa.array(size), *[pa.array(np.ascontiguousarray(x)) for x in cols], pa.array([list(c) for c in rare], pa.list_(pa.binary())), pa.array([list(c.values()) for c in rare], pa.list_(pa.int32()))],
                names=[*others, w, "n_tokens", *ps, "base", "known", "rare", "times"],
            )

    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others)
    partial = scratch.keep(rows.select(*others, text).mapInArrow(sums, f"{kept}, `{w}` long, n_tokens long, {', '.join(f'{p} double' for p in ps)}, base double, known double, rare array<binary>, times array<int>"), "partial")
    # every rare word has fewer uses than the bar, so no key of this join is hot
    rest = partial.select(w, F.explode(F.arrays_zip("rare", "times")).alias("x")).select(w, F.col("x.rare").alias("w"), F.col("x.times").alias("n"))
    rest = rest.join(weighed.where(~is_hot).drop("a"), "w").groupBy(w).agg(*[F.sum(F.col("n") * F.col(p)).alias(f"r{p}") for p in ps], F.sum(F.col("n") * F.col("base")).alias("rbase"), F.sum(F.col("n") * F.col("known")).alias("rknown"))
    out = partial.drop("rare", "times").join(rest, w, "left")
    scratch.only("weighed", "partial")
    # the frequencies of all stand for the documents of the other languages
    shares = np.array([0.99 * r[1] / trained for r in sizes] + [0.01 + 0.99 * (1 - sum(r[1] for r in sizes) / trained)]) if trained else np.ones(1)
    parts = [F.col(p) + F.coalesce(f"r{p}", F.lit(0.0)) + F.lit(float(np.log10(s))) for p, s in zip(ps, shares)]
    top = F.greatest(*parts) if len(parts) > 1 else parts[0]
    log_sum = top + F.log10(sum((F.pow(F.lit(10.0), x - top) for x in parts), F.lit(0.0)))
    return out.select(*others, "n_tokens", (F.col("known") + F.coalesce("rknown", F.lit(0))).cast("long").alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("rbase", F.lit(0.0))).alias("base_score"), log_sum.alias("score"))
