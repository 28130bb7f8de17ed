"""Toxicity by compression distance.

Zstandard dictionaries are trained apart on windows of toxic and of ordinary
text.  A window is a few words; it is compressed with either dictionary, and the
difference of the lengths is its distance.  Both dictionaries stand on one base
of ordinary text, which leaves less chance in the difference, and the ordinary
one is as large as the toxic one.

The labelled sample is dealt into folds, and each fold trains a pair of
dictionaries.  Only a part of a toxic document is toxic, so the toxic ones are
trained in rounds: first on all windows of toxic documents, then on those that
lean to the toxic dictionaries of the *other* folds more than nearly all ordinary
windows do.  What the trainer takes depends on the order of its windows; of
several orders, the one that tells the other folds' windows apart best is kept.

The distance of a window is the mean over the pairs.  How far a document's
windows lie apart (the greatest distances, their mean, and how many pass each of
several thresholds) is turned into a probability by a logistic model.  It is
calibrated on the sample, each document measured by the pairs of the other folds,
with the weight that its class has among all labels.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free_name, text_slices, words_of

PUNCTUATION = b".,!;:?\"'()[]{}#$%&*|-_"
#: Words of a window, and words from one window to the next.
WINDOW_WORDS, STRIDE = 4, 2
#: Bytes of the common base, of each trained dictionary, and of the piece of text that the trainer takes at once.
BASE_BYTES, DICTIONARY_BYTES, SEGMENT = 8192, 4096, 12
#: zstandard stores tiny blocks raw: each window is compressed behind so many bytes that both dictionaries end with.
FILLER_BYTES = 64
#: Folds of the sample, rounds of training, and orders that are tried in each.
FOLDS, ROUNDS, ORDERS = 3, 3, 8
#: The share of ordinary windows that a leaning window must pass.
LEAN = 0.98
#: Distances that are counted.
THRESHOLDS = (1.5, 2, 2.5, 3, 4, 5, 6)
#: The sample: labelled documents of either class, and bytes of their texts (the last document may pass that).
SAMPLE_DOCS, SAMPLE_BYTES = 3000, 16 << 20
#: Bytes of windows that a dictionary is trained on, and windows of a fold and class that choose among dictionaries; by hash.
TRAIN_BYTES, JUDGES = 4 << 20, 4000

Pair = tuple[bytes, bytes]


def windows(words: list[bytes], size: int, stride: int = STRIDE) -> list[bytes]:
    """The windows of a text: ``size`` words without the punctuation around them."""
    bare = [w for x in words if (w := x.strip(PUNCTUATION))]
    return [b" " + b" ".join(bare[i : i + size]) + b" " for i in range(0, max(1, len(bare) - (size - stride)) if bare else 0, stride)]


def _header() -> bytes:
    """What makes a dictionary a full one, with zstandard's own default code tables and first offsets (RFC 8878, 3.1.1.3.2.2 and 5).

    zstandard builds the default tables anew for each window that it compresses with bare text, which takes most of its time; a full
    dictionary's tables are built once.  As they are the same tables, lengths stay the same.  The table of literals has
    only the bytes 0 and 1, so that it is never used.
    """

    def table(counts: list[int], log: int) -> bytes:
        bits, n, left, threshold, width = log - 5, 4, (1 << log) + 1, 1 << log, log + 1
        for c in counts:
            most = 2 * threshold - 1 - left
            left -= abs(c)
            c += 1 + most * (c + 1 >= threshold)
            bits |= c << n
            n += width - (c < most)
            while left < threshold:
                width, threshold = width - 1, threshold >> 1
        return bits.to_bytes((n + 7) // 8, "little")

    offsets = [*[1] * 6, *[2] * 3, *[1] * 15, *[-1] * 5]
    matches = [1, 4, 3, *[2] * 6, *[1] * 37, *[-1] * 7]
    literals = [4, 3, *[2] * 11, *[1] * 3, *[2] * 9, 3, 2, *[1] * 5, *[-1] * 4]
    return struct.pack("<IIBB", 0xEC30A437, 1, 128, 16) + table(offsets, 5) + table(matches, 6) + table(literals, 6) + struct.pack("<III", 1, 4, 8)


HEADER = _header()
#: Longer windows (with the filler) might get code tables of their own, from 56 matches of four bytes on, if the dictionary has none.
PLAIN_BYTES = 200


class Compressor:
    """Lengths of windows compressed behind a dictionary of bare text."""

    def __init__(self, dictionary: bytes):
        how = zstandard.ZstdCompressionParameters(window_log=17, hash_log=16, chain_log=16, search_log=4, min_match=4, target_length=64, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_dict_id=False, write_checksum=False)
        bare = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        # zstandard takes no shorter text
        full = zstandard.ZstdCompressionDict(HEADER + dictionary, dict_type=zstandard.DICT_TYPE_FULLDICT) if len(dictionary) >= 8 else bare
        self.bare, self.full = (zstandard.ZstdCompressor(dict_data=d, compression_params=how) for d in (bare, full))

    def sizes(self, whole: list[bytes], long: list[int]) -> np.ndarray:
        """``long``: the places of the longer windows."""
        out = _sizes(self.full, whole)
        if long:
            out[long] = _sizes(self.bare, [whole[i] for i in long])
        return out


def _long(whole: list[bytes]) -> list[int]:
    return [i for i, w in enumerate(whole) if len(w) > PLAIN_BYTES]


class Meter:
    """Distances by the mean of several pairs of dictionaries, opened once."""

    def __init__(self, base: bytes, pairs: list[Pair]):
        self.filler = base[-FILLER_BYTES:]
        self.pairs = [tuple(Compressor(base + d + self.filler) for d in p) for p in pairs]

    def distances(self, some: list[bytes]) -> np.ndarray:
        """By how many bytes the toxic dictionaries shorten each window more than the ordinary ones, on average."""
        out, whole = np.zeros(len(some)), [self.filler + w for w in some]
        long = _long(whole)
        for ordinary, toxic in self.pairs if some else ():
            out += ordinary.sizes(whole, long) - toxic.sizes(whole, long)
        return out / max(1, len(self.pairs))


def _sizes(compressor: zstandard.ZstdCompressor, whole: list[bytes]) -> np.ndarray:
    return np.fromiter(map(len, compressor.multi_compress_to_buffer(whole)), np.int64, len(whole))


def features(d: np.ndarray) -> np.ndarray:
    """What the calibration knows of a document with these window distances."""
    if not len(d):
        return np.array([1.0] + [0.0] * (8 + len(THRESHOLDS)))
    top = np.sort(d)
    best = [top[-1 - k] if len(d) > k else 0.0 for k in (0, 1, 3)]
    counts = len(d) - np.searchsorted(top, THRESHOLDS)  # distances at each threshold or beyond
    shares = (len(d) - np.searchsorted(top, (2, 3, 4))) / len(d)
    return np.concatenate([[1.0], best, np.log1p(counts), [np.log1p(len(d)), d.mean()], shares])


@dataclass
class Model:
    base: bytes
    pairs: list[Pair]
    weights: np.ndarray
    window_words: int

    def scores(self, texts: list[list[bytes]], meter: Meter) -> list[float]:
        cut = [windows(words, self.window_words) for words in texts]
        every = [w for ws in cut for w in ws]
        place = {w: i for i, w in enumerate(dict.fromkeys(every))}  # equal windows are compressed once
        d = meter.distances(list(place))[np.fromiter(map(place.__getitem__, every), np.int64, len(every))]
        ends = np.cumsum([len(ws) for ws in cut], dtype=np.int64)
        x = np.array([features(d[b - len(ws) : b]) for ws, b in zip(cut, ends)])
        return (1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))).tolist()


def _by_hash(some: set[bytes]) -> list[bytes]:
    """The windows in an order that depends on nothing but themselves."""
    return [w for _, w in sorted((xxhash.xxh64_intdigest(w), w) for w in some)]


def _dictionary(some: list[bytes], size: int, seed: int = 0) -> bytes:
    """A dictionary trained on the windows, in their order or a seeded one; of too few windows, their text."""
    samples, total = [], 0
    for i in np.random.default_rng(seed).permutation(len(some)) if seed else range(len(some)):
        if total > TRAIN_BYTES:
            break
        samples.append(some[i])
        total += len(some[i])
    try:
        return zstandard.train_dictionary(size, samples, k=SEGMENT, d=6).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weighted logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(sample: list[tuple[list[bytes], int, int]], totals: dict[int, int], window_words: int = WINDOW_WORDS) -> Model:
    """Dictionaries and calibration from ``sample``, rows of words, class and fold; ``totals`` counts all labels of a class."""
    # windows to learn from overlap by half
    own = {(kind, fold): set() for kind in (0, 1) for fold in range(FOLDS)}
    for words, kind, fold in sample:
        own[kind, fold].update(windows(words, window_words, max(1, window_words // 2)))
    base = _dictionary(_by_hash(set().union(*(own[0, f] for f in range(FOLDS)))), BASE_BYTES)
    plain = [_by_hash(own[0, f]) for f in range(FOLDS)]
    ordinary = [_dictionary(plain[f], DICTIONARY_BYTES) for f in range(FOLDS)]
    # copies of a document would make their fold's windows look toxic to the others
    found = Counter(w for f in range(FOLDS) for w in own[1, f])
    lean = [_by_hash(own[1, f]) for f in range(FOLDS)]
    candidates = [[w for w in lean[f] if found[w] == 1] for f in range(FOLDS)]
    usual = [plain[f][:JUDGES] for f in range(FOLDS)]
    others = [[g for g in range(FOLDS) if g != f] for f in range(FOLDS)]
    pairs: list[Pair] = []
    for i in range(ROUNDS):
        telling = [[w for w in lean[f] if found[w] == 1][:JUDGES] for f in range(FOLDS)]
        pairs = [_best_pair(base, ordinary[f], lean[f], [w for g in others[f] for w in telling[g]], [w for g in others[f] for w in usual[g]]) for f in range(FOLDS)]
        if i + 1 == ROUNDS:
            break
        chosen = []
        for f in range(FOLDS):
            meter = Meter(base, [pairs[g] for g in others[f]])
            low = meter.distances(usual[f])
            bar = max(1.0, float(np.quantile(low, LEAN))) if len(low) else 1.0
            chosen.append([w for w, x in zip(candidates[f], meter.distances(candidates[f])) if x > bar] or lean[f])
        lean = chosen
    model = Model(base, pairs, np.zeros(len(features(np.zeros(0)))), window_words)
    if sample:
        meters = [Meter(base, [pairs[g] for g in others[f]]) for f in range(FOLDS)]
        x = np.stack([features(meters[f].distances(windows(words, window_words))) for words, _, f in sample])
        y = np.array([k for _, k, _ in sample], dtype=np.float64)
        weight = np.array([totals[k] / max(1, int((y == k).sum())) for _, k, _ in sample])
        model.weights = _calibrate(x, y, weight / weight.mean())
    return model


def _best_pair(base: bytes, ordinary: bytes, some: list[bytes], telling: list[bytes], usual: list[bytes]) -> Pair:
    """The ordinary dictionary and, of the toxic ones from several orders of ``some``, the one that tells other windows apart best."""
    if not telling or not usual:
        return ordinary, _dictionary(some, DICTIONARY_BYTES)
    filler = base[-FILLER_BYTES:]
    # the windows as they are compressed, and their lengths under the ordinary dictionary, which all orders share
    sides = [[filler + w for w in side] for side in (telling, usual)]
    plain = Compressor(base + ordinary + filler)
    long = [_long(side) for side in sides]
    lengths = [plain.sizes(*side) for side in zip(sides, long)]
    best: tuple[float, bytes] | None = None
    for seed in range(ORDERS):
        toxic = _dictionary(some, DICTIONARY_BYTES, seed)
        opened = Compressor(base + toxic + filler)
        a, b = (n - opened.sizes(*side) for n, *side in zip(lengths, sides, long))
        gap = float((a.mean() - b.mean()) / (b.std() + 1e-9))
        if best is None or gap > best[0]:
            best = (gap, toxic)
    return ordinary, best[1]


def sample_of(docs: DataFrame, labels: DataFrame, learn: Column, scratch: Scratch, sample_docs: int, key: str, text: str) -> tuple[DataFrame, dict[int, int]]:
    """Text, class and fold of at most ``sample_docs`` labelled rows of either class, those of least key hash, and the numbers of all."""
    marks = labels.where("toxic in (0, 1)").groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    usable = scratch.keep(docs.where(learn).select(F.col(key).alias("_id")).join(marks, "_id").distinct(), "usable")
    totals = {0: 0, 1: 0} | {r[0]: r[1] for r in usable.groupBy("toxic").count().collect()}
    ids = None
    for kind in (0, 1):
        own = usable.where(F.col("toxic") == kind).orderBy(F.xxhash64(F.lit(11), "_id"), "_id").limit(sample_docs)
        ids = own if ids is None else ids.unionByName(own)
    ids = scratch.keep(ids, "ids")  # twice sample_docs rows at most
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("text")).join(F.broadcast(ids), "_id")
    return scratch.keep(rows.select("text", "toxic", F.xxhash64(F.lit(11), "_id").alias("h"), F.pmod(F.xxhash64(F.lit(5), "_id"), F.lit(FOLDS)).cast("int").alias("fold")), "sample"), totals


def _read(sample: DataFrame, sample_bytes: int) -> list[tuple[list[bytes], int, int]]:
    """The sample in the driver, up to ``sample_bytes`` of text of either class."""
    out, used = [], {0: 0, 1: 0}
    for r in sample.orderBy("h", "text").toLocalIterator():
        if used[r["toxic"]] < sample_bytes:
            used[r["toxic"]] += len(r["text"] or "")
            out.append(((r["text"] or "").encode("utf-8").lower().split(), r["toxic"], r["fold"]))
    return out


def score(docs: DataFrame, labels: DataFrame, learn: Column, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES, window_words: int = WINDOW_WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if the score is at least 0.5, else 0).

    ``learn`` picks, by columns of ``docs``, the rows whose labels may be used; of these at most ``sample_docs`` of
    either class, those of smallest key hash, and ``sample_bytes`` of their text are.  Every whole text is scored.
    Null and empty texts have no window and get the score of the bare calibration; null labels are no labels; without
    any usable label all scores are 0.5.  Repeated rows get equal scores; an empty table gives an empty result.
    Columns named like the new ones are replaced.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    docs = docs.drop("score", "predicted")
    sample, totals = sample_of(docs, labels, learn, scratch, sample_docs, key, text)
    model = spark.sparkContext.broadcast(train(_read(sample, sample_bytes), totals, window_words))
    scratch.only()
    (x,) = free_name(docs, "_score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = Meter(model.value.base, model.value.pairs)
        for b in text_slices(batches, text):
            yield pa.record_batch([*b.columns, pa.array(model.value.scores(words_of(b.column(text), lower=True), meter), pa.float64())], names=[*b.schema.names, x])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    out = docs.mapInArrow(run, f"{schema}, `{x}` double").withColumnRenamed(x, "score")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
