"""Line de-duplication over levelled sorted runs of line hashes.

The index is a set of runs: tables ``(h1, h2, docs, fresh)`` bucketed and sorted
by the 128-bit hash of a line key.  A batch of documents is counted by hash and
merge-anti-joined with the runs: keys that no run holds enter as new (``fresh``),
so that each key enters once; counts of known keys are added as increments to
where the key is.  When a level holds ``fanout`` runs they are merged into one run
of the next level, so a key is rewritten a logarithmic number of times however
many batches come.  How many documents hold a key is the count that it entered
with plus its increments in later runs.

All runs have the same buckets in the same order, one file each, so none of
these joins shuffles or sorts a run.  Everything here is DataFrame operations:
the lines never leave the JVM.
"""

from __future__ import annotations

import contextlib
import functools
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, LOWER, UPPER, Scratch, free_name, join_hot

#: Second hash of a line key, so that a name has 128 bits.
SECOND_SEED = 7


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def key_hashes(text: Column) -> Column:
    """For each line of a text its key's hashes, or null where the key is empty."""

    # two steps, so that each key is made once and then hashed
    keys = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), line_key)
    return F.transform(keys, lambda k: F.when(k != "", F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(SECOND_SEED), k).alias("h2"))))


def count_lines(docs: DataFrame, text: str, batch: Column, batches: int = 1) -> DataFrame:
    """``(h1, h2, b0, b1, ...)``: the documents of each batch that hold a key; a document counts once, however often it repeats the line."""
    lines = docs.select(batch.alias("batch"), F.explode(F.array_distinct(key_hashes(F.col(text)))).alias("k")).where(F.col("k").isNotNull())
    return lines.select("batch", "k.*").groupBy("h1", "h2").agg(*[F.sum((F.col("batch") == i).cast("long")).alias(f"b{i}") for i in range(batches)])


class LineRuns:
    """The levelled index.  ``add`` takes a counted batch; ``at_least`` answers for all batches so far."""

    #: A bucket of one file is read in its order.
    ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"

    def __init__(self, spark: SparkSession, fanout: int = 4):
        if fanout < 2:
            raise ValueError("fanout must be at least 2")
        self.spark, self.fanout, self.levels, self._made = spark, fanout, [[]], 0
        self.scratch = Scratch(spark, "line-runs")
        self.prefix = "line_runs_" + uuid.uuid4().hex
        # as many buckets as a shuffle has partitions: what a shuffle by key has dealt is written as it is
        self.buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """``df``, dealt by ``h1, h2``, as a table of the index's buckets."""
        table = f"{self.prefix}_{name}"
        out = df.write.format("parquet").option("compression", "zstd").option("path", f"{self.scratch.root}/{name}")
        out.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").saveAsTable(table)
        self.scratch.names.append(name)
        return self.spark.table(table)

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.prefix}_{name}")
        self.scratch.drop(name)

    def _write(self, run: DataFrame) -> tuple[str, DataFrame]:
        name = f"run{self._made}"
        self._made += 1
        with self.ordered():
            return name, self.keep(run, name)

    @contextlib.contextmanager
    def ordered(self) -> Iterator[None]:
        before = self.spark.conf.get(self.ORDERED, None)
        self.spark.conf.set(self.ORDERED, "true")
        try:
            yield
        finally:
            self.spark.conf.unset(self.ORDERED) if before is None else self.spark.conf.set(self.ORDERED, before)

    def runs(self) -> list[DataFrame]:
        """The runs from the oldest to the newest."""
        return [df for level in reversed(self.levels) for _, df in level]

    def unseen(self, counted: DataFrame) -> DataFrame:
        """The keys of a counted batch that no run holds: merge-anti-joined with each run in turn."""
        for run in self.runs():
            counted = counted.join(run.where("fresh").select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        return counted

    def step(self, counted: DataFrame) -> DataFrame:
        """The run of a counted batch ``(h1, h2, docs)``: ``fresh`` marks keys that enter, the others are increments."""
        if not self.runs():
            return counted.select("h1", "h2", "docs", F.lit(True).alias("fresh"))
        new = self.unseen(counted).select("h1", "h2", F.lit(True).alias("fresh"))
        return counted.join(new.hint("merge"), ["h1", "h2"], "left").select("h1", "h2", "docs", F.coalesce("fresh", F.lit(False)).alias("fresh"))

    def add(self, counted: DataFrame) -> None:
        """Adds a counted batch as a run of level 0 and compacts the levels that are full."""
        self.levels[0].append(self._write(self.step(counted)))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._compact(full))
            for name, _ in full:
                self.drop(name)
            level += 1

    def _compact(self, runs: list[tuple[str, DataFrame]]) -> tuple[str, DataFrame]:
        """One run of several, merged in pairs."""
        name, merged = runs[0]
        for i, (_, run) in enumerate(runs[1:], 1):
            a, b = merged.alias("a"), run.hint("merge").alias("b")
            both = a.join(b, ["h1", "h2"], "full").select("h1", "h2", (F.coalesce("a.docs", F.lit(0)) + F.coalesce("b.docs", F.lit(0))).alias("docs"), (F.coalesce("a.fresh", F.lit(False)) | F.coalesce("b.fresh", F.lit(False))).alias("fresh"))
            before, (name, merged) = name, self._write(both)
            if i > 1:
                self.drop(before)
        return name, merged

    def at_least(self, min_docs: int) -> list[DataFrame]:
        """The keys found in so many documents, ``(h1, h2, docs)``, by the run that each entered with: no key is in two."""
        out, runs = [], self.runs()
        for i, run in enumerate(runs):
            found = run.where("fresh").select("h1", "h2", "docs")
            for later in runs[i + 1 :]:
                more = later.where("not fresh").select("h1", "h2", F.col("docs").alias("more"))
                found = found.join(more.hint("merge"), ["h1", "h2"], "left").select("h1", "h2", (F.col("docs") + F.coalesce("more", F.lit(0))).alias("docs"))
            out.append(found.where(F.col("docs") >= min_docs))
        return out


def drop_lines(docs: DataFrame, min_docs: int = 10, key: str = "doc_id", text: str = "text", batches: int = 4, fanout: int = 2) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` (long) and ``kept`` (the text without lines found in ``min_docs`` documents or more).

    Lines whose key is empty always stay.  A null or empty text is one empty line, and ``kept`` is then empty.
    Documents are told apart by row, not by ``key``: rows that repeat a key or a text count as documents of their
    own.  An empty table gives an empty result; columns named like the new ones are replaced.  A table that
    arrives at once is dealt into ``batches`` batches by the hash of its rows; all of them enter the index before any
    line is dropped, so their number does not change the result.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped", "kept")
    index = LineRuns(spark, fanout)
    counted = index.keep(count_lines(docs, text, F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(batches)), batches), "counted")
    for i in range(batches):
        index.add(counted.where(f"b{i} > 0").select("h1", "h2", F.col(f"b{i}").alias("docs")))
    index.drop("counted")
    with index.ordered():
        found = [index.scratch.keep(df, f"frequent{i}") for i, df in enumerate(index.at_least(min_docs))]
    for name in [name for level in index.levels for name, _ in level]:
        index.drop(name)
    return _without(docs, functools.reduce(DataFrame.unionByName, found), key, text)


def _without(docs: DataFrame, frequent: DataFrame, key: str, text: str) -> DataFrame:
    """Drops the lines of ``frequent``: their positions are joined by key hash, gathered by document and applied to the text."""
    r1, r2, lines, drop = free_name(docs, "_r1", "_r2", "_lines", "_drop")
    # a row is named by 128 bits of its key and its text: equal rows lose the same lines, so they may share one list
    named = docs.withColumns({r1: F.xxhash64(F.col(key), F.col(text)), r2: F.xxhash64(F.lit(SECOND_SEED), F.col(key), F.col(text))})
    at = named.select(F.col(r1).alias("r1"), F.col(r2).alias("r2"), F.posexplode(key_hashes(F.col(text))).alias("pos", "k")).where(F.col("k").isNotNull())
    hit = join_hot(at.select("r1", "r2", "pos", "k.*"), frequent, ["h1", "h2"], "docs", "r1")
    gone = hit.groupBy("r1", "r2").agg(F.collect_set("pos").alias(drop)).withColumnsRenamed({"r1": r1, "r2": r2})
    out = named.join(gone, [r1, r2], "left").withColumn(lines, F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1))
    left = F.filter(F.col(lines), lambda _, i: F.coalesce(~F.array_contains(F.col(drop), i), F.lit(True)))
    kept = F.when(F.col(drop).isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(F.array_join(left, "\n"))
    return out.withColumn("n_lines", F.size(lines).cast("long")).withColumn("n_dropped", F.coalesce(F.size(drop), F.lit(0)).cast("long")).withColumn("kept", kept).drop(r1, r2, lines, drop)
