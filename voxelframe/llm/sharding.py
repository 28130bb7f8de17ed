"""Sharding by proportional stratified interleaving.

Rows are shuffled within their source by a seeded hash and ranked; row ``r`` of
the ``n`` rows of a source gets the fractional rank ``(r + phase) / n``, where the
phase (0 to 1) is a hash of the source.  Sorting all rows by fractional rank
interleaves the sources in proportion, so every contiguous cut of that order has
the mixture of the whole.  The order is cut into shards whose row counts differ
by one at most.

Neither ranking meets a whole source, or the whole table, in one task.  Ranks
within a source come from a histogram of hash prefixes (offset of the bucket
plus rank in the bucket), and positions in the global order from intervals of
fractional rank, whose offsets follow from the row counts and phases of the
sources.  Phases keep many sources of a few rows from meeting in one interval.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, group_key

#: Hash prefixes of a source, and intervals of the fractional rank.
BUCKETS = 4096
#: Phases of sources; a power of two keeps the products within 64 bits up to 2^40 rows.
PHASES = 1024


def _phase(source: str, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed + 1), F.col(source)), F.lit(PHASES))


def _interval(rank: str, phase: str, rows: str, buckets: int) -> str:
    """The interval of the fractional rank, in integers."""
    return f"(({rank} * {PHASES} + {phase}) * {buckets}) div ({rows} * {PHASES})"


def shard(rows: DataFrame, n_shards: int, source: str = "source", key: str = "doc_id", seed: int = 17, buckets: int = BUCKETS) -> DataFrame:
    """``rows`` with ``shard`` (int, 0 to ``n_shards`` - 1) and ``slot`` (long, from 0 without gaps in each shard).

    Null sources form a source of their own; null keys and repeated rows are
    placed like any others (equal rows are interchangeable, so a rerun gives the
    same table).  With fewer rows than shards some shards stay empty, and an
    empty table gives an empty result.  Existing columns are kept; those named
    ``shard`` or ``slot`` are replaced.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    rows = rows.drop("shard", "slot")
    src, h, b, before, n, rank, fb, off, total, pos, phase = free_name(rows, "_src", "_h", "_b", "_before", "_n", "_rank", "_fb", "_off", "_total", "_pos", "_phase")
    plain = [c for c, t in rows.dtypes if not t.startswith(("map", "variant"))]
    # the content joins the key in the hash, so that repeated keys are shuffled too; the same holds for rows without a key
    dealt = rows.withColumn(src, group_key(F.col(source))).withColumn(h, F.xxhash64(F.lit(seed), F.col(key), *[F.col(c) for c in plain if c != key]))
    dealt = dealt.withColumn(b, F.shiftrightunsigned(h, 52).cast("int") % buckets)

    counts = dealt.groupBy(src, b).agg(F.count(F.lit(1)).alias(n))
    per_source = Window.partitionBy(src)
    offsets = counts.select(src, b, (F.sum(n).over(per_source.orderBy(b)) - F.col(n)).alias(before), F.sum(n).over(per_source).alias(n))
    ranked = dealt.withColumn(rank, F.row_number().over(Window.partitionBy(src, b).orderBy(h, key)) - 1).join(offsets, [src, b])
    ranked = ranked.withColumn(rank, F.col(rank) + F.col(before)).withColumn(phase, _phase(src, seed))
    ranked = ranked.withColumn(fb, F.expr(_interval(f"`{rank}`", f"`{phase}`", f"`{n}`", buckets)).cast("int"))
    ranked = ranked.withColumn(rank, (F.col(rank) * PHASES + F.col(phase)) / (F.col(n) * PHASES))

    # rows of each interval: of a source of few rows they are listed; of others, the rows below interval i are as many r
    # as satisfy (r * PHASES + phase) * buckets < i * n * PHASES
    sizes = counts.groupBy(src).agg(F.sum(n).alias("n")).withColumn("p", _phase(src, seed))
    few = sizes.where(F.col("n") < buckets).withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    few = few.select(F.expr(_interval("r", "p", "n", buckets)).alias(fb), F.lit(1).cast("long").alias("c"))
    many = sizes.where(F.col("n") >= buckets).withColumn(fb, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))))
    below = lambda i: f"(({i}) * n * {PHASES} - p * {buckets} + {buckets * PHASES - 1}) div {buckets * PHASES}"
    many = many.select(fb, F.expr(f"least(n, {below(f'`{fb}` + 1')}) - least(n, {below(f'`{fb}`')})").alias("c"))
    starts = few.unionByName(many).groupBy(fb).agg(F.sum("c").alias("c"))  # one row for each interval
    every = Window.orderBy(fb)
    starts = starts.select(F.col(fb).cast("int").alias(fb), (F.sum("c").over(every) - F.col("c")).alias(off), F.sum("c").over(Window.partitionBy()).alias(total))
    placed = ranked.drop(before, n, b, phase).join(F.broadcast(starts), fb)
    placed = placed.withColumn(pos, F.col(off) + F.row_number().over(Window.partitionBy(fb).orderBy(rank, src, h, key)) - 1)
    cut = F.expr(f"`{pos}` * {n_shards} div `{total}`")
    first = F.expr(f"(shard * `{total}` + {n_shards - 1}) div {n_shards}")
    return placed.withColumn("shard", cut.cast("int")).withColumn("slot", F.col(pos) - first).drop(src, h, rank, fb, off, total, pos)
