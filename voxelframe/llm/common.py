"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the text contracts: space and \x09-\x0D, as ``bytes.split()`` has it.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that one vectorised step takes at once, so that a worker's arrays stay small.
SLICE_BYTES = 2 << 20
#: Bytes whose running sums are held at once when words are hashed.
HASH_BYTES = 1 << 18
#: Rows that any key may have in one task.
HOT_ROWS = 128
#: Rows of a table that may be broadcast, as keys and a few numbers; parts of each key beyond.
MAX_BROADCAST_KEYS, SALTS = 50_000, 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, a temporary one in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "local")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="voxelframe-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Spark's own switch: the shuffle files of a query go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written to the shared folder: they cut lineage, so that a lost executor costs a re-read and no recomputation.

    A result that is still to be computed reads some of them, so those go when the application ends; ``only`` names
    them, and the others go at once.  With ``prompt``, shuffle files of what is written go when it is; without, they stay until
    the driver collects its garbage.
    """

    def __init__(self, spark: SparkSession, label: str, prompt: bool = False):
        self.prompt = prompt
        self.spark, self.root = spark, f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        self.held: list[DataFrame] = []
        self.names: list[str] = []
        atexit.register(self._end)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        with self.writing():
            df.write.option("compression", "zstd").parquet(path)
        self.names.append(name)
        return self.spark.read.schema(df.schema).parquet(path)

    @contextlib.contextmanager
    def writing(self) -> Iterator[None]:
        """Around a write; frames that are made within it and read again would miss their shuffle files."""
        was = self.spark.conf.get(CLEANUP, None)
        if self.prompt:
            self.spark.conf.set(CLEANUP, "true")
        try:
            yield
        finally:
            if self.prompt:
                self.spark.conf.unset(CLEANUP) if was is None else self.spark.conf.set(CLEANUP, was)

    def hold(self, df: DataFrame) -> DataFrame:
        """For a small table that is used twice and is quickly made from written ones: kept by the executors until ``let_go``."""
        self.held.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return self.held[-1]

    def let_go(self) -> None:
        while self.held:
            self.held.pop().unpersist()

    def drop(self, *names: str) -> None:
        """Deletes the tables."""
        for name in names:
            self._delete(f"{self.root}/{name}")
            self.names.remove(name)

    def only(self, *names: str) -> None:
        """Deletes all tables but these."""
        self.let_go()
        self.drop(*[n for n in self.names if n not in names])

    def _delete(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _end(self) -> None:
        with contextlib.suppress(Exception):  # the session may be gone, and its folder with it
            self._delete(self.root)


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that do not clash with the columns of ``df``, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def group_key(column: Column) -> Column:
    """A string that is never null, so that null is a group of its own in joins as well."""
    return F.when(column.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), column.cast("string")))


def join_hot(big: DataFrame, small: DataFrame, keys: list[str], weight: str, spread: str, counts: DataFrame | None = None, always: bool = False) -> DataFrame:
    """Inner join of ``big`` with ``small``, whose ``keys`` are unique; ``weight`` counts the rows of ``big`` by key, in ``small``
    or in ``counts``, a written table.  A row of ``big`` meets one row at most.

    A key with more rows than a quarter of an even share of a partition is hot.  There are fewer than four such keys for
    each partition whatever the input, so their list is broadcast.  The rows of a hot key are dealt by the hash
    of column ``spread`` over as many salts as it has quarter shares, and the one row of ``small`` is repeated for each further
    salt; all other rows of ``small`` stay as they are.  Without hot keys it is a plain join, unless the plan should
    ``always`` be the same: the list then holds the most frequent key, as Spark leaves out a join with an empty one.
    """
    counts = small if counts is None else counts
    total, top, most = counts.agg(F.sum(weight), F.max(weight), F.max_by(F.struct(*keys), weight)).first()
    partitions = max(1, int(big.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bar = max((total or 0) / (4 * partitions), HOT_ROWS)
    if not always and (not top or top <= bar):
        return big.join(small, keys)
    found = counts.where(F.col(weight) > bar).select(*keys, F.ceil(F.col(weight) / bar).cast("int").alias("_salts"))
    hot = big.sparkSession.createDataFrame(found.collect() or ([(*most, 1)] if most else []), found.schema)
    salt = F.pmod(F.xxhash64(F.col(spread)), F.coalesce("_salts", F.lit(1))).cast("int")
    left = big.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt).drop("_salts")
    further = small.join(F.broadcast(hot.where("_salts > 1")), keys).withColumn("_salt", F.explode(F.sequence(F.lit(1), F.col("_salts") - 1))).drop("_salts")
    right = small.withColumn("_salt", F.lit(0)).unionByName(further)
    return left.join(right, [*keys, "_salt"]).drop("_salt")


def join_few(big: DataFrame, small: DataFrame, key: str, spread: str, how: str = "inner") -> DataFrame:
    """Join with a written table that has one row for each of what are mostly few keys (languages, sources).

    Up to ``MAX_BROADCAST_KEYS`` rows are broadcast; beyond, the rows of ``big`` are dealt by key and hash of ``spread``.
    """
    if small.count() <= MAX_BROADCAST_KEYS:
        return big.join(F.broadcast(small), key, how)
    (salt,) = free_name(big, "_salt")
    copies = small.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return big.withColumn(salt, F.pmod(F.xxhash64(F.col(spread)), F.lit(SALTS))).join(copies, [key, salt], how).drop(salt)


def text_slices(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that each holds about ``limit`` bytes of text, or one longer row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0))
        at = np.cumsum(sizes, dtype=np.int64) // limit
        cuts = np.flatnonzero(np.diff(at)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield batch.slice(a, b - a)


def gathered(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches joined to ones of at least ``rows`` rows, where so many come."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def words_of(column: pa.Array, lower: bool = False) -> list[list[bytes]]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of each text as UTF-8; a null text has none.  ``lower`` folds A-Z only."""
    raw = column.cast(pa.binary()).to_pylist()
    return [(t.lower() if lower else t).split() if t else [] for t in raw]


_BLANK = np.zeros(256, dtype=bool)
_BLANK[list(BLANKS.encode())] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
def hash_column(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of each word of all texts, and the offsets of the texts, without making the words.

    Every byte at every place of a word has a random number of its own; a word's hash comes from their sum, a
    difference of running sums."""
    column = pc.fill_null(column, "")
    _, places, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(places, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    text = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    word = np.concatenate([[False], ~_BLANK[text], [False]])
    begin, end = word[1:-1] & ~word[:-2], word[1:-1] & ~word[2:]
    inner = at[(at > 0) & (at < len(text))]  # texts end words too
    begin[inner] |= word[1:-1][inner]
    end[inner - 1] |= word[1:-1][inner - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    offsets = np.searchsorted(starts, at)
    out = np.zeros(len(starts), dtype=np.uint64)
    a = 0
    while a < len(starts):  # words of about HASH_BYTES at a time, or one longer word
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + HASH_BYTES, "right")))
        own = text[starts[a] : ends[b - 1]]
        x, y = starts[a:b] - starts[a], ends[a:b] - starts[a]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_numbers(_FOLD[own] if lower else own, x))])
        out[a:b] = mix(sums[y] - sums[x] + (y - x).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        a = b
    return out, offsets


def _numbers(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The number of each byte at its place, counted from the start of its word."""
    place = np.arange(len(text)) - np.repeat(starts, np.diff(np.append(starts, len(text))))
    far = np.flatnonzero(place >= PLACES)
    index = (place << 8) | text
    if not len(far):
        return _NUMBERS[index]
    out = _NUMBERS[np.minimum(index, len(_NUMBERS) - 1)]
    out[far] = _number(index[far])
    return out


def _number(index: np.ndarray) -> np.ndarray:
    return mix(mix(index.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0xD6E8FEB86659FD93))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: The numbers of bytes at the first places of a word are looked up.
PLACES = 64
_NUMBERS = _number(np.arange(PLACES << 8))


#: A Mersenne prime: sums modulo it, unlike those modulo 2^64, have no short patterns that collide under every base.
PRIME = np.uint64((1 << 61) - 1)
_LOW31, _LOW30 = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)


def fold61(x: np.ndarray) -> np.ndarray:
    """``x`` modulo 2^61 - 1."""
    x = (x & PRIME) + (x >> np.uint64(61))
    return np.where(x >= PRIME, x - PRIME, x)


def times61(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of two arrays of residues modulo 2^61 - 1, by halves of 31 bits."""
    a1, a0, b1, b0 = a >> np.uint64(31), a & _LOW31, b >> np.uint64(31), b & _LOW31
    middle = a1 * b0 + a0 * b1
    return fold61(((a1 * b1) << np.uint64(1)) + (middle >> np.uint64(30)) + ((middle & _LOW30) << np.uint64(31)) + a0 * b0)


def sums61(x: np.ndarray) -> np.ndarray:
    """0 and the running sums of residues modulo 2^61 - 1; halves are summed apart, as 64 bits would overflow."""
    low, high = np.cumsum(x & _LOW31), np.cumsum(x >> np.uint64(31))
    return np.concatenate([np.zeros(1, np.uint64), fold61(fold61(low) + times61(fold61(high), np.full(1, 1 << 31, np.uint64)))])
