"""Histograms, probability models, pyramids and error statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def normalize_counts(counts: DataFrame, by: list[str], symbol: str, count: str, scale_bits: int) -> DataFrame:
    """Integer frequencies ``freq`` that sum to ``2^scale_bits`` in each group, at least 1 for each symbol, with ``cum``.

    Floors of the exact share, then single units: what is missing goes to the largest remainders, going round (ties
    to the smaller symbol); what is too much is taken from the largest frequencies above 1, one each, in rounds.  A
    round takes a unit from every frequency above 1, largest first, so after ``k`` rounds a frequency ``f`` has lost
    ``min(k, f - 1)``; the last, partial round takes from the largest that are left.
    """
    total = 1 << scale_bits
    w, n = Window.partitionBy(*by), F.col(count)
    rows = counts.where(n > 0).withColumn("_sum", F.sum(n).over(w)).withColumn("_kinds", F.count(F.lit(1)).over(w))
    exact = (n.cast("decimal(38,0)") * total)
    rows = rows.withColumn("_f", F.greatest(F.floor(exact / F.col("_sum")).cast("long"), F.lit(1))).withColumn("_rem", (exact % F.col("_sum")).cast("decimal(38,0)"))
    rows = rows.withColumn("_gap", F.lit(total) - F.sum("_f").over(w))
    rows = rows.withColumn("_place", F.row_number().over(w.orderBy(F.desc("_rem"), symbol)) - 1)
    up = F.expr("case when _gap > 0 then _gap div _kinds + case when _place < _gap % _kinds then 1 else 0 end else 0 end")
    # full rounds k: the largest k with sum(min(k, f - 1)) <= -gap, from the frequencies in ascending order
    rows = rows.withColumn("_spare", F.col("_f") - 1)
    asc = w.orderBy("_spare", symbol)
    rows = rows.withColumn("_below", F.coalesce(F.sum("_spare").over(asc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_left", F.count(F.lit(1)).over(asc.rowsBetween(0, Window.unboundedFollowing)))
    k = F.max(F.expr("case when _gap < 0 and _below + _left * coalesce(_prev, 0) <= -_gap then least(_spare, (-_gap - _below) div _left) else 0 end")).over(w)
    rows = rows.withColumn("_prev", F.lag("_spare", 1, 0).over(asc)).withColumn("_k", k)
    rows = rows.withColumn("_cut", F.least("_k", "_spare"))
    rows = rows.withColumn("_over", F.when(F.col("_gap") < 0, -F.col("_gap") - F.sum("_cut").over(w)).otherwise(0))
    rows = rows.withColumn("_now", F.col("_f") - F.col("_cut"))
    rows = rows.withColumn("_turn", F.row_number().over(w.orderBy(F.desc("_now"), symbol)))
    last = F.when((F.col("_turn") <= F.col("_over")) & (F.col("_now") > 1), 1).otherwise(0)
    rows = rows.withColumn("freq", F.col("_f") + up - F.when(F.col("_gap") < 0, F.col("_cut") + last).otherwise(0))
    rows = rows.withColumn("cum", F.sum("freq").over(w.orderBy(symbol)) - F.col("freq"))
    return rows.select(*by, symbol, count, "freq", "cum")


def mean_level(voxels: DataFrame, sizes: dict[str, int], ratio: dict[str, int]) -> DataFrame:
    """The next level of a pyramid: means of boxes, halves rounded up, the last voxel of an axis repeated to fill a box.

    Repetition is a weight, so no voxel is made up: the last index of an axis counts once more for each missing one.
    """
    weight, area = F.lit(1), 1
    for a, r in ratio.items():
        missing = -sizes[a] % r
        area *= r
        weight = weight * F.when(F.col(a) == sizes[a] - 1, 1 + missing).otherwise(1)
    keys = [F.expr(f"{a} div {ratio[a]}").alias(a) if a in ratio else F.col(a) for a in ("t", "c", "z", "y", "x") if a in voxels.columns]
    total = voxels.withColumn("_w", F.col("v") * weight).groupBy(*keys).agg(F.sum("_w").alias("_s"))
    return total.withColumn("v", F.expr(f"(_s + {area // 2}) div {area}")).drop("_s")


def raw_plan(blocks: DataFrame, plane: int, item: int, model_bytes: str = "model_bytes", by: tuple[str, ...] = ("t", "c")) -> DataFrame:
    """Whether each block (``depth``, ``coded`` bytes) is stored raw: if its coded record is no smaller, or if the
    chosen records with the models are no smaller than the whole volume raw."""
    w = Window.partitionBy(*by)
    stored, coded = F.lit(20) + F.col("depth") * plane * item, F.lit(52 if item == 2 else 32) + F.col("coded")
    rows = blocks.withColumn("stored", stored).withColumn("record", coded).withColumn("own_raw", F.col("record") >= F.col("stored"))
    whole = F.sum(F.when(F.col("own_raw"), F.col("stored")).otherwise(F.col("record"))).over(w) + F.col(model_bytes) >= F.sum("stored").over(w)
    return rows.withColumn("raw", F.col("own_raw") | whole)


def errors(pairs: DataFrame, gain: float, by: list[str]) -> DataFrame:
    """Root mean square, mean absolute and greatest error of ``a`` against ``b``; integer sums, then one division."""
    d = F.col("a") - F.col("b")
    sums = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(d * d).alias("sq"), F.sum(F.abs(d)).alias("ab"), F.max(F.abs(d)).alias("max_abs"))
    rmse = F.sqrt(F.col("sq") / F.col("n"))
    return sums.select(*by, "n", rmse.alias("rmse"), (F.col("ab") / F.col("n")).alias("mae"), "max_abs", (rmse * gain).alias("rmse_electrons"))


def coalesced_runs(strips: DataFrame, by: list[str], offset: str = "off", length: str = "len") -> DataFrame:
    """Neighbouring byte ranges joined into one read each: gaps and islands over the order of ``strip``."""
    w = Window.partitionBy(*by).orderBy("strip")
    jump = F.when(F.lag(F.col(offset) + F.col(length)).over(w) == F.col(offset), 0).otherwise(1)
    rows = strips.withColumn("_jump", jump).withColumn("run", F.sum("_jump").over(w))
    return rows.groupBy(*by, "run").agg(F.min(offset).alias(offset), F.sum(length).alias(length), F.count(F.lit(1)).alias("strips"))


def resident_peak(units: DataFrame, by: list[str]) -> DataFrame:
    """The most bytes that are resident at once if a unit (``first``, ``last`` page, ``bytes``) lives from its first use to its last."""
    events = units.select(*by, F.explode(F.array(F.struct(F.col("first").alias("at"), F.lit(0).alias("kind"), F.col("bytes").alias("d")), F.struct(F.col("last").alias("at"), F.lit(1).alias("kind"), (-F.col("bytes")).alias("d")))).alias("e")).select(*by, "e.*")
    w = Window.partitionBy(*by).orderBy("at", "kind", F.desc("d")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("_now", F.sum("d").over(w)).groupBy(*by).agg(F.max("_now").alias("peak"))
