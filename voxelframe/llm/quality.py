"""Quality classification by an interpolated modified Kneser-Ney model of trusted text.

A trigram model over words (``[^\\x20\\x09-\\x0D]+``, unchanged, named by their
64-bit hashes) is fitted on all documents of one half that the labels call good.
Counts, continuation counts and context totals are summed by shards of n-grams, which
travel as compressed arrays; probabilities are interpolated from them where a text is scored.  Every document gets its perplexity
under the model, and is kept unless that lies above a quantile of the
perplexities of trusted documents of its language, which the model has not
seen: all of the other half.  Perplexities of short documents are drawn towards
the mean of trusted text, as if ``prior_tokens`` average words had been read as well.

A model of up to ``MAX_NGRAMS`` n-grams goes to the workers, who score whole texts
against its sorted keys.  A larger one stays in its tables, sharded by n-gram, and
answers what blocks of documents ask.  Either way gives the same sums.
"""

from __future__ import annotations

import functools
import gc
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, free_name, group_key, hash_column, join_few, mix, text_slices

#: N-grams that are broadcast, at 10 bytes each; the driver takes some times that while it gathers them.
MAX_NGRAMS = 1 << 20
#: Of larger models: n-grams of a shard at most, bytes of text of a block of documents, and parts of the blocks that go one after the other.
SHARD_NGRAMS, BLOCK_BYTES, PASSES = 1 << 20, 4 << 20, 8
#: Of training: words that are counted at once, bytes of all texts for each shard, and parts of the texts that go one after the
#: other, of ``PART_BYTES`` at least, so that only the text of one part lies in shuffle files.
COUNT_WORDS, SHARD_BYTES, PARTS, PART_BYTES = 1 << 20, 16 << 20, 4, 192 << 20
#: What stands before a text; not 0, of which the keys of all orders would be 0.
START = np.uint64(0x5851F42D4C957F2D)
_TWO, _THREE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def pair_key(one: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(one * _TWO + word)


def triple_key(two: np.ndarray, one: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(pair_key(two, one) * _THREE + word)


def before(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words one and two places before each; ``starts`` marks the first words of texts."""
    one = np.concatenate([[START], words[:-1]])
    one[starts] = START
    two = np.concatenate([[START], one[:-1]])
    two[starts] = START
    return one, two


def release(spark: SparkSession) -> None:
    """Shuffle files of finished passes go when the driver's handles of them do; nothing depends on when."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    spark._jvm.System.gc()


class Coded:
    """An array of few different values, each held once, with their places in 2 or 4 bytes."""

    def __init__(self, values: np.ndarray):
        self.known, places = np.unique(values, return_inverse=True)
        self.places = places.astype(np.uint16 if len(self.known) <= 1 << 16 else np.uint32)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return self.known[self.places[at]]


Table = tuple[np.ndarray, np.ndarray | Coded]


@dataclass
class Model:
    """Discounted counts of the seen n-grams, and totals and back-off weights of contexts, by keys, which are sorted."""

    grams: tuple[Table, Table, Table]  # of one word: its probability
    contexts: tuple[tuple[np.ndarray, np.ndarray | Coded, np.ndarray | Coded], ...]  # of the word before, of the two before: total, back-off weight
    floor: float  # probability of a word that is not seen

    @property
    def uni(self) -> Table:
        return self.grams[0]

    def score(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """log10 p of each word given the two before it; ``starts`` marks the first words of texts."""
        if not len(words):
            return np.zeros(0)
        one, two = before(words, starts)
        pair = pair_key(one, words)
        p, every = np.full(len(words), self.floor), np.ones(len(words), dtype=bool)
        at, known = _find(self.grams[0][0], words, every)
        p[known] = self.grams[0][1][at]
        for (keys, taken), (own, total, back), key, context in (
            (self.grams[1], self.contexts[0], pair, one),
            (self.grams[2], self.contexts[1], triple_key(two, one, words), pair_key(two, one)),
        ):
            at, there = _find(own, context, every)
            p[there] *= back[at]
            # a longer n-gram is seen only if its context is
            sums, every = np.zeros(len(words)), _at(every, there)
            sums[there] = total[at]
            at, seen = _find(keys, key, every)
            p[seen] += taken[at] / sums[seen]
        return np.log10(p)


def _at(like: np.ndarray, places: np.ndarray) -> np.ndarray:
    out = np.zeros_like(like)
    out[places] = True
    return out


def _find(keys: np.ndarray, wanted: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``keys`` and in ``wanted`` of the entries that both hold."""
    at = np.flatnonzero(where)
    if not len(keys) or not len(at):
        return at[:0], at[:0]
    i = np.searchsorted(keys, wanted[at])
    i[i == len(keys)] = 0
    ok = keys[i] == wanted[at]
    return i[ok], at[ok]


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of all words, their count by text, and the positions of first words."""
    h, offsets = hash_column(column)
    sizes = np.diff(offsets).astype(np.int64)
    return np.where(h == START, np.uint64(1), h), sizes, offsets[:-1][sizes > 0].astype(np.int64)


def _discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more, from the numbers of n-grams counted 1 to 4 times."""
    n1, n2, n3, n4 = (float(max(x, 0)) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), raw)]


def _taken(d: list[float], c: np.ndarray) -> np.ndarray:
    """The discounts of n-grams by their counts; of those not seen, 0."""
    return np.array([0.0, *d])[np.minimum(c, 3).astype(np.int64)]


def _back(d: list[float], total: np.ndarray, *by: np.ndarray) -> np.ndarray:
    """The back-off weights of contexts: the discounts of what follows them, over its count."""
    return sum(x * n for x, n in zip(d, by)) / total


def trusted_sample(docs: DataFrame, labels: DataFrame, per_language: int | None = None, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Ids of the trusted documents to learn from, and of those kept for the thresholds: every trusted document is one or the other.

    The two halves are told apart by the hash of the key.  ``per_language`` bounds the first half for quick trials; the
    ranks are then taken in 64 slices of each language, so that no language meets in one task.
    """
    good = labels.where("quality = 1").select(F.col("doc_id").alias("_id")).distinct()
    both = docs.select(F.col(key).alias("_id"), group_key(F.col("lang")).alias("_lang")).join(good, "_id").withColumn("_h", F.xxhash64(F.lit(3), "_id"))
    learn = both.where("_h < 0")
    if per_language is not None:
        learn = learn.withColumn("_slice", F.pmod("_h", F.lit(64)))
        w = Window.partitionBy("_lang", "_slice").orderBy("_h")
        quota = F.lit(per_language // 64) + (F.col("_slice") < per_language % 64).cast("int")
        learn = learn.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= quota)
    return learn.select("_id").distinct(), both.where("_h >= 0").select("_id").distinct()


@dataclass
class Tables:
    """The model as tables of keys ``k``: ``x`` of n-grams, ``x`` and ``y`` of contexts.  They are views of the ``written`` arrays."""

    grams: list[DataFrame]
    contexts: list[DataFrame]
    floor: float
    written: dict[str, DataFrame]  # keys and counts of each part, by name
    discounts: tuple[list[float], list[float], list[float]]
    total: int  # of the counts of words
    size: int  # n-grams and contexts of all

    def parts(self) -> list[DataFrame]:
        return [*self.grams, *self.contexts]

    def collect(self) -> Model:
        """The model in the driver, which gets keys instead of the words that they are made of."""

        def read(df: DataFrame) -> tuple[np.ndarray | Coded, ...]:
            rows = df.toArrow()
            out = [rows.column("k").to_numpy().view(np.uint64)]
            order = np.argsort(out[0])  # keys are unique
            out[0] = out[0][order]
            rows = rows.drop_columns(["k"])
            for n in df.columns[1:]:
                out.append(Coded(rows.column(n).to_numpy()[order]))
                rows = rows.drop_columns([n])
            pa.default_memory_pool().release_unused()  # else the driver keeps the room of the rows
            return tuple(out)

        return Model(tuple(read(df) for df in self.grams), tuple(read(df) for df in self.contexts), self.floor)


#: Rows of training: ``kind`` is a part of the model, or ``deal`` for what the next round sums by ``shard``; of ``n`` n-grams, ``s1`` to ``s4`` are
#: counted so often; ``words`` are sorted keys or the words that ``numbers`` refer to.
_ROWS = "shard int, kind string, n long, s1 long, s2 long, s3 long, s4 long, words binary, numbers binary"


def _rows(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32(), pa.string(), *[pa.int64()] * 5, pa.binary(), pa.binary()]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 9, kinds)], names=[x.split()[0] for x in _ROWS.split(", ")])


def _distinct(keys: np.ndarray) -> np.ndarray:
    """The sorted distinct keys; ``np.unique`` without inverse hashes them, which takes many times as long."""
    keys = np.sort(keys)
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The sorted distinct keys, a place of each, and the sums of its values."""
    order = np.argsort(keys)
    own = keys[order]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
    return own[first], order[first], *[np.add.reduceat(v[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64) for v in values]


def _dealt(words: list[np.ndarray], numbers: list[np.ndarray], keys: np.ndarray, shards: int) -> list[tuple]:
    """N-grams and their numbers by shard: each shard gets its words once, and their places, those of first words as steps."""
    known, codes = np.unique(np.concatenate(words), return_inverse=True)
    codes, out = codes.reshape(len(words), -1), []
    for i, at in _packed(keys, shards):
        at = at[np.argsort(codes[0, at])]
        own, places = np.unique(codes[:, at], return_inverse=True)
        first, *others = places.reshape(len(words), -1)
        out.append((i, "deal", len(at), 0, 0, 0, 0, _steps(known[own]), _squeezed(np.concatenate([np.diff(first, prepend=0), *others, *[x[at] for x in numbers]]))))
    return out


def _gathered(rows: pa.Table, n_words: int, n_numbers: int) -> list[np.ndarray]:
    out = [[np.zeros(0, np.uint64)] for _ in range(n_words)] + [[np.zeros(0, np.int64)] for _ in range(n_numbers)]
    for words, numbers in zip(rows.column("words").to_pylist(), rows.column("numbers").to_pylist()):
        known, columns = _keys(words), _full(numbers).reshape(n_words + n_numbers, -1)
        for i, c in enumerate(columns):
            out[i].append(c.astype(np.int64) if i >= n_words else known[c if i else np.cumsum(c)])
    return [np.concatenate(x) for x in out]


def _part(shard: int, kind: str, keys: np.ndarray, *numbers: np.ndarray) -> tuple:
    """A shard of a part of the model: its keys, sorted, and what was counted of each."""
    return (shard, kind, len(keys), *[int((numbers[0] == i).sum()) for i in (1, 2, 3, 4)], _steps(keys), _squeezed(np.concatenate(numbers)))


def _by_count(c: np.ndarray) -> tuple[np.ndarray, ...]:
    """What contexts sum: the counts of n-grams, and how many are counted once, twice and more."""
    return c, c == 1, c == 2, c > 2


def train(texts: DataFrame | list[DataFrame], scratch: Scratch, text: str = "text", size: int = 0) -> Tables:
    """Fits the model on ``texts``, or on all of several tables, one after the other; ``size`` tells the bytes of text.

    Trigrams are dealt by the pair that they begin with, so that a shard has whole contexts; what continues a pair, and then a
    word, is dealt by that.  Each block of words is counted before it is dealt, and goes to a shard as one row,
    so that no n-gram is hot.
    """
    spark = scratch.spark
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // SHARD_BYTES + 1)

    def trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> list[pa.RecordBatch]:
            u, v, w = (np.concatenate(x) for x in zip(*held))
            _, at, c = _summed(triple_key(u, v, w), np.ones(len(w), np.int64))
            u, v, w = u[at], v[at], w[at]
            return _rows(_dealt([u, v, w], [c], pair_key(u, v), shards)).to_batches()

        held, n = [], 0
        for b in text_slices(batches, text):
            words, _, first = _words(b.column(text))
            if len(words):
                held.append((*before(words, first)[::-1], words))
                n += len(words)
            if n >= COUNT_WORDS:
                yield from counted()
                held, n = [], 0
        if n:
            yield from counted()

    def of_trigrams(rows: pa.Table) -> pa.Table:
        shard, (u, v, w, c) = rows.column("shard")[0].as_py(), _gathered(rows, 3, 1)
        keys, at, c = _summed(triple_key(u, v, w), c)
        u, v, w = u[at], v[at], w[at]
        context, _, *sums = _summed(pair_key(u, v), *_by_count(c))
        pairs, at, n = _summed(pair_key(v, w), np.ones(len(w), np.int64))
        return _rows([_part(shard, "trigrams", keys, c), _part(shard, "c3", context, *sums), *_dealt([v[at], w[at]], [n], pairs, shards)])

    def of_bigrams(rows: pa.Table) -> pa.Table:
        shard, (v, w, c) = rows.column("shard")[0].as_py(), _gathered(rows, 2, 1)
        keys, at, c = _summed(pair_key(v, w), c)
        context, _, *sums = _summed(v[at], *_by_count(c))
        words, _, n = _summed(w[at], np.ones(len(at), np.int64))
        both, none = np.concatenate([words, context]), np.zeros(len(words), np.int64)
        numbers = [np.concatenate([n, np.zeros(len(context), np.int64)]), *[np.concatenate([none, x]) for x in sums]]
        return _rows([_part(shard, "bigrams", keys, c), *_dealt([both], numbers, both, shards)])

    def of_words(rows: pa.Table) -> pa.Table:
        shard, (w, *numbers) = rows.column("shard")[0].as_py(), _gathered(rows, 1, 5)
        words, _, n, *sums = _summed(w, *numbers)
        seen, leads = n > 0, sums[0] > 0
        return _rows([_part(shard, "unigrams", words[seen], n[seen]), _part(shard, "c2", words[leads], *[x[leads] for x in sums])])

    def made(dealt: DataFrame, f, level: str) -> DataFrame:
        path = f"{scratch.root}/{level}"
        with scratch.writing():
            dealt.groupBy("shard").applyInArrow(f, _ROWS).write.partitionBy("kind").option("compression", "none").parquet(path)
        release(spark)
        return spark.read.schema(_ROWS).parquet(path)

    name = f"voxelframe_{uuid.uuid4().hex}"
    for t in texts if isinstance(texts, list) else [texts]:
        t = t.select(text).mapInArrow(trigrams, _ROWS).repartition(shards, "shard")
        with scratch.writing():
            t.write.mode("append").format("parquet").option("compression", "none").option("path", f"{scratch.root}/dealt").bucketBy(shards, "shard").saveAsTable(name)
        release(spark)
    levels = ("level3", "trigrams", "c3"), ("level2", "bigrams"), ("level1", "unigrams", "c2")
    scratch.names += ["dealt", *[f"{level}/kind={kind}" for level, *kinds in levels for kind in (*kinds, *["deal"] * (level != "level1"))]]
    three = made(spark.table(name), of_trigrams, "level3")
    spark.sql(f"DROP TABLE {name}")
    scratch.drop("dealt")
    two = made(three.where("kind = 'deal'"), of_bigrams, "level2")
    scratch.drop("level3/kind=deal")
    one = made(two.where("kind = 'deal'"), of_words, "level1")
    scratch.drop("level2/kind=deal")

    of = {kind: df.where(F.col("kind") == kind) for df, (_, *kinds) in zip((three, two, one), levels) for kind in kinds}
    counts = {kind: [x or 0 for x in df.agg(*[F.sum(c) for c in ("n", "s1", "s2", "s3", "s4")]).first()] for kind, df in of.items()}
    d3, d2, d1 = (_discounts(counts[k][1:]) for k in ("trigrams", "bigrams", "unigrams"))
    kinds, once, twice = counts["unigrams"][:3]
    total = counts["bigrams"][0] or 1  # a word is counted once for each pair that it ends
    spare = once * d1[0] + twice * d1[1] + (kinds - once - twice) * d1[2] if kinds else 1.0
    floor = spare / total / (kinds + 1)

    def view(kind: str, columns: int, values) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for words, numbers in zip(b.column("words").to_pylist(), b.column("numbers").to_pylist()):
                    out = values(*_full(numbers).reshape(columns, -1).astype(np.int64))
                    yield pa.record_batch([pa.array(_keys(words).view(np.int64)), *map(pa.array, out)], names=["k", "x", "y"][: 1 + len(out)])

        return of[kind].select("words", "numbers").mapInArrow(run, "k long, x double" + ", y double" * (columns > 1))

    def gram(kind: str, d: list[float]) -> DataFrame:
        return view(kind, 1, lambda c: [c - _taken(d, c)])

    def context(kind: str, d: list[float]) -> DataFrame:
        return view(kind, 4, lambda total, *by: [total.astype(np.float64), _back(d, total, *by)])

    grams = [view("unigrams", 1, lambda c: [(c - _taken(d1, c)) / total + floor]), gram("bigrams", d2), gram("trigrams", d3)]
    written = {f"{level}/kind={kind}": of[kind] for level, *own in reversed(levels) for kind in own}
    return Tables(grams, [context("c2", d2), context("c3", d3)], floor, written, (d1, d2, d3), total, sum(c[0] for c in counts.values()))


def _scored(b: pa.RecordBatch, model: Model, text: str, count: str, total: str) -> pa.RecordBatch:
    words, sizes, first = _words(b.column(text))
    # summed text by text, so that equal texts get equal sums wherever they lie
    sums, some = np.zeros(len(sizes)), np.flatnonzero(sizes)
    if len(some):
        sums[some] = np.add.reduceat(model.score(words, first), first)
    return pa.record_batch([*b.columns, pa.array(sizes), pa.array(sums)], names=[*b.schema.names, count, total])


def with_logprob(docs: DataFrame, model: Broadcast, text: str, count: str, total: str) -> DataFrame:
    """``docs`` with the number of words (``count``) and their log10 probability (``total``) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, text):
            yield _scored(b, model.value, text, count, total)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, {count} long, {total} double")


def _packed(keys: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """The places of ``keys`` by shard."""
    own = (keys % np.uint64(shards)).astype(np.int64)
    order = np.argsort(own, kind="stable")
    cuts = np.searchsorted(own[order], np.arange(shards + 1))
    yield from ((i, order[x:y]) for i, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])) if x < y)


def _squeezed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 up, in the bytes that the largest needs, compressed byte by byte: first all lowest bytes, and so on."""
    wide = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if not len(values) or int(values.max()) <= np.iinfo(t).max)
    values = np.ascontiguousarray(values, dtype=wide)
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T)
    return bytes([values.itemsize]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _full(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), np.uint8).reshape(blob[0], -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(f"u{blob[0]}")


def _steps(keys: np.ndarray) -> bytes:
    """Sorted keys, as their steps."""
    return _squeezed(np.diff(keys, prepend=np.uint64(0)))


def _keys(blob: bytes) -> np.ndarray:
    return np.cumsum(_full(blob), dtype=np.uint64)


def _asked(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The keys of all words, of all pairs, of all triples, and of the contexts of first words."""
    one, two = before(words, first)
    edge = np.array([START], dtype=np.uint64)
    return np.concatenate([words, pair_key(one, words), triple_key(two, one, words), edge, pair_key(edge, edge)])


def _answered(words: np.ndarray, first: np.ndarray, at: np.ndarray, known: np.ndarray, model: tuple) -> np.ndarray:
    """What ``Model.score`` gives, from what was counted of each key: ``at`` has the places of those of ``_asked``; 0 stands for not seen.  ``model`` has discounts, the count of all words and the floor."""
    n, ((d1, d2, d3), whole, floor) = len(words), model
    c = known[0][at[:n]]
    p = np.where(c > 0, (c - _taken(d1, c)) / whole + floor, floor)
    for k, d in ((1, d2), (2, d3)):  # the context is the word, or the pair, that ends one place before
        context = np.concatenate([at[3 * n + k - 1 :][:1], at[(k - 1) * n : k * n - 1]])
        context[first] = at[3 * n + k - 1]
        total, *by = known[1:, context]
        seen, c = total > 0, known[0][at[k * n : (k + 1) * n]]
        total = np.where(seen, total, 1)
        p = np.where(seen, _back(d, total, *by) * p + (c - _taken(d, c)) / total, p)
    return np.log10(p)


def with_logprob_by_joins(docs: DataFrame, tables: Tables, scratch: Scratch, text: str, count: str, total: str) -> DataFrame:
    """The same from the tables, without the text: the distinct n-grams of each block of documents meet the model sharded by n-gram.

    A block asks each shard for its n-grams at once, as an array, and gets what is known of them in the same order.  However
    frequent an n-gram, a block asks for it once, so no key is hot.  The model is a table in as many buckets as there are
    shards, so that it is dealt once.  A row's block hangs on its values alone; up to ``PASSES`` parts of the blocks go one after
    the other, so that only the shuffle files of one part lie on disk.
    """
    spark, model = docs.sparkSession, (tables.discounts, tables.total, tables.floor)
    (block,) = free_name(docs, "_block")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(partitions, tables.size // SHARD_NGRAMS + 1)
    kept = [f for f in docs.schema.fields if f.name != text]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def pack(context: bool):
        def packed(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            keys, numbers = (np.concatenate(x, axis=-1) for x in zip(*held))
            order = np.argsort(keys)
            keys = keys[order]
            own = list(_packed(keys, shards))
            blobs = [pa.array([_steps(keys[at]) for _, at in own], pa.binary()), pa.array([_squeezed(numbers[:, order[at]].reshape(-1)) for _, at in own], pa.binary())]
            return pa.record_batch([pa.array([i for i, _ in own], pa.int32()), pa.array([context] * len(own)), *blobs], names=["shard", "context", "keys", "counts"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n = [], 0
            for b in batches:
                for words, numbers in zip(b.column("words").to_pylist(), b.column("numbers").to_pylist()):
                    held.append((_keys(words), _full(numbers).reshape(4 if context else 1, -1)))
                    n += len(held[-1][0])
                    if n >= 1 << 20:
                        yield packed(held)
                        held, n = [], 0
            if n:
                yield packed(held)

        return run

    def ask(rows: pa.Table) -> pa.Table:
        words, _, first = _words(rows.column(text).combine_chunks())
        keys = _distinct(_asked(words, first)) if len(words) else words
        own = list(_packed(keys, shards))
        ids = rows.column(block)[:1].to_pylist() * len(own)
        return pa.table([pa.array([i for i, _ in own], pa.int32()), pa.array(ids, pa.int64()), pa.array([_steps(keys[at]) for _, at in own], pa.binary())], names=["shard", "block", "keys"])

    def answer(asked: pa.Table, parts: pa.Table) -> pa.Table:
        have, out = [], []
        for context in (False, True) if asked.num_rows else ():
            own = parts.filter(pc.equal(parts.column("context"), context))
            keys = np.concatenate([np.zeros(0, np.uint64), *[_keys(x) for x in own.column("keys").to_pylist()]])
            counts = np.concatenate([np.zeros((4 if context else 1, 0), np.uint8), *[_full(x).reshape(4 if context else 1, -1) for x in own.column("counts").to_pylist()]], axis=1)
            order = np.argsort(keys)
            have.append((keys[order], counts[:, order]))
        for wanted in asked.column("keys").to_pylist():
            wanted, known = _keys(wanted), []
            for keys, counts in have:
                at, there = _find(keys, wanted, np.ones(len(wanted), dtype=bool))
                known.append(np.zeros((len(counts), len(wanted)), counts.dtype))
                known[-1][:, there] = counts[:, at]
            out.append(_squeezed(np.concatenate(known).reshape(-1)))
        return pa.table([asked.column("shard"), asked.column("block"), pa.array(out, pa.binary())], names=["shard", "block", "known"])

    def scored(rows: pa.Table, answers: pa.Table) -> pa.Table:
        words, sizes, first = _words(rows.column(text).combine_chunks())
        sums, some = np.zeros(len(sizes)), np.flatnonzero(sizes)
        if len(some):
            keys, at = np.unique(_asked(words, first), return_inverse=True)
            known, got = np.zeros((5, len(keys)), np.int64), dict(zip(answers.column("shard").to_pylist(), answers.column("known").to_pylist()))
            for i, places in _packed(keys, shards):
                known[:, places] = _full(got[i]).reshape(5, -1)
            sums[some] = np.add.reduceat(_answered(words, first, at, known, model), first)
        return pa.table([*[rows.column(f.name) for f in kept], pa.array(sizes), pa.array(sums)], names=[*[f.name for f in kept], count, total])

    name, packed_to = f"voxelframe_{uuid.uuid4().hex}", f"packed-{count}"
    scratch.names.append(packed_to)
    for own, df in reversed(tables.written.items()):
        context = own.endswith(("c2", "c3"))
        df = df.select("words", "numbers").mapInArrow(pack(context), "shard int, context boolean, keys binary, counts binary").repartition(shards, "shard")
        with scratch.writing():
            df.write.mode("append").format("parquet").option("compression", "none").option("path", f"{scratch.root}/{packed_to}").bucketBy(shards, "shard").saveAsTable(name)
        scratch.drop(own)
        release(spark)
    packed = spark.table(name)
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = size // BLOCK_BYTES + 1
    done, passes = [], min(PASSES, blocks)
    docs = docs.withColumn(block, F.pmod(F.xxhash64(*docs.columns), F.lit(blocks).cast("long")))

    def one_pass(i: int) -> DataFrame:  # its frames go when it ends
        part = docs.where(F.col(block) % passes == i)
        asked = part.groupBy(block).applyInArrow(ask, "shard int, block long, keys binary")
        answers = asked.groupBy("shard").cogroup(packed.groupBy("shard")).applyInArrow(answer, "shard int, block long, known binary")
        out = part.groupBy(block).cogroup(answers.withColumnRenamed("block", block).groupBy(block)).applyInArrow(scored, f"{fields}, {count} long, {total} double")
        return scratch.keep(out, f"part{i}-{count}")

    for i in range(passes):
        done.append(one_pass(i))
        release(spark)
    spark.sql(f"DROP TABLE {name}")
    scratch.drop(packed_to)
    return functools.reduce(DataFrame.unionByName, done)


def score(docs: DataFrame, labels: DataFrame, quantile: float = 0.998, per_language: int | None = None, prior_tokens: float = 20.0, key: str = "doc_id", text: str = "text", lang: str = "lang", max_ngrams: int = MAX_NGRAMS) -> DataFrame:
    """``docs`` with ``n_tokens``, ``perplexity``, ``threshold`` (of the language) and ``keep``.

    The model learns from every trusted document of one half of the keys, and the thresholds come from every one of the
    other; ``per_language`` bounds the first for quick trials.  Null and empty texts have no words and are kept with the mean perplexity.  A
    language, null included, without trusted documents is judged by the threshold of all; without any trusted
    document everything is kept (threshold infinite).  Repeated rows and keys get equal results; an empty table gives
    an empty result.  Columns named like the new ones are replaced.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality", prompt=True)
    docs = docs.drop("n_tokens", "perplexity", "threshold", "keep")
    learn, rest = trusted_sample(docs, labels, per_language, key)
    learn = learn.withColumnRenamed("_id", key)
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(1, min(PARTS, size // PART_BYTES))

    def sample(i: int) -> DataFrame:
        def own(df: DataFrame) -> DataFrame:
            return df.where(F.pmod(F.xxhash64(F.lit(5), key), F.lit(parts)) == i) if parts > 1 else df

        ids = own(learn)
        return own(docs.select(key, text)).join(ids if per_language is None else F.broadcast(ids), key, "left_semi").select(text)

    tables = train([sample(i) for i in range(parts)], scratch, text, size)

    n, lp, l, h, mean, bar = free_name(docs, "_n", "_lp", "_l", "_h", "_mean", "_bar")

    slim = docs.select(F.col(key).alias("id"), group_key(F.col(lang)).alias("l"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    small = tables.size <= max_ngrams
    model = spark.sparkContext.broadcast(tables.collect()) if small else None
    scored = with_logprob(slim, model, "t", "n", "lp") if small else with_logprob_by_joins(slim, tables, scratch, "t", "n", "lp")
    scored = scratch.keep(scored.select("id", "l", "h", "n", "lp"), "scores")
    if small:  # each executor and the driver have a file of it, which would stay as long as a result that reads it
        model.destroy(blocking=True)
        model = None
    held = scored.join(rest.withColumnRenamed("_id", "id"), "id", "left_semi").where("n > 0")
    means = scratch.keep(held.groupBy("l").agg((F.sum("lp") / F.sum("n")).alias("mean")), "means")
    drawn = join_few(held, means, "l", "id").withColumn("x", -(F.col("lp") + prior_tokens * F.col("mean")) / (F.col("n") + prior_tokens))
    limit = F.percentile_approx("x", quantile, 10000)
    limits = scratch.keep(drawn.groupBy("l").agg(F.first("mean").alias(mean), limit.cast("double").alias(bar)).withColumnRenamed("l", l), "limits")
    pooled, every = held.agg(F.sum("lp") / F.sum("n")).first()[0] or 0.0, drawn.agg(limit).first()[0]
    fallback = float("inf") if every is None else float(every)

    scratch.only("limits", "scores")
    release(spark)
    docs = docs.withColumn(l, group_key(F.col(lang)))
    # equal texts have equal scores, so that key and text tell rows apart well enough
    once = scored.groupBy(group_key(F.col("id")).alias(mean), F.col("h").alias(h)).agg(F.first("n").alias(n), F.first("lp").alias(lp))
    out = docs.withColumns({mean: group_key(F.col(key)), h: F.xxhash64(text)}).join(once, [mean, h]).drop(mean, h)
    out = join_few(out, limits, l, key, "left")
    x = -(F.col(lp) + prior_tokens * F.coalesce(mean, F.lit(pooled))) / (F.col(n) + prior_tokens)
    limit = F.coalesce(bar, F.lit(fallback))
    out = out.withColumn("n_tokens", F.col(n)).withColumn("perplexity", F.pow(F.lit(10.0), x)).withColumn("threshold", F.pow(F.lit(10.0), limit)).withColumn("keep", x <= limit)
    return out.drop(l, n, lp, mean, bar)
