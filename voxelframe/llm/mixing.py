"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 60-bit hash.  A source takes each of its documents a whole
number of times, and once more those whose hash lies below a threshold, chosen
so that the taken words come as near as can be to the target of the source.
The thresholds are found by histograms: words are summed by source and hash
prefix, the prefix in which the running sum crosses the budget is refined by
the next bits, and only that one bucket of each source is looked at again: its
rows are written out, and the later rounds read nothing else.
Nothing is sorted, a larger budget takes a superset (thresholds are nested),
and the final filter is a comparison.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, Scratch, free_name, group_key, join_few

#: Bits of the hash that each round of refinement adds.
ROUND_BITS, ROUNDS = 12, 5


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, 0 for null."""
    inner = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(inner) > 0, F.size(F.split(inner, r"[\x20\x09-\x0D]+"))).otherwise(0).cast("long")


def targets(sources: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """``target`` of each row (``src``, ``name``, ``size``) of ``sources``.

    Sources in the order of their names (by code point, null last) weigh ``weights``, repeating, and share ``share``
    times all sizes; no target exceeds ``most`` times the size, and what is cut is shared again by weight.  The
    fixed point of that rule is ``min(most * size, level * weight)``: with the sources in the order of
    ``most * size / weight``, those before the level are full and the rest share what is left.
    """
    order = Window.orderBy(F.col("name").isNull(), F.col("name").cast("string").cast("binary"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    table = sources.withColumn("weight", w).withColumn("cap", F.col("size") * F.lit(float(most)))
    # one row for each source: a small table whatever the number of documents
    fill, every = Window.orderBy(F.col("cap") / F.col("weight"), "src"), Window.partitionBy()
    table = table.withColumn("full", F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn("rest", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    table = table.withColumn("level", (F.sum("size").over(every) * F.lit(float(share)) - F.col("full")) / F.col("rest"))
    # the level at the first source that it does not fill
    level = F.min(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "src", "level"))).over(every)["level"]
    table = table.withColumn("_level", level)
    return table.select("src", "size", F.coalesce(F.least("cap", F.col("_level") * F.col("weight")), F.col("cap")).alias("target"))


def mix_table(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: int = 2, source: str = "source", text: str = "text", key: str = "doc_id", seed: int = 29) -> DataFrame:
    """``docs`` with ``size`` (words), ``source_size``, ``target`` (of the source) and ``taken`` (words, repeats counted).

    ``taken`` is a multiple of ``size``: ``copies = taken / size``, at most ``most``.  Null sources are one source,
    the last; null and empty texts have size 0 and take 0.  The hash is of key and text, so null and repeated keys are
    dealt by their texts.  Rows equal in both share their hash; where a threshold falls among them, as many of them are
    taken as come nearest to the target, whichever they are.  A source without words has target 0, and an empty table
    gives an empty result.  Columns named like the four new ones are replaced.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    docs = docs.drop("size", "source_size", "target", "taken", "copies")
    src, h, full, bar, need, tie, part, before = free_name(docs, "_src", "_h", "_full", "_bar", "_need", "_tie", "_part", "_before")
    hashed = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key), F.col(text)), 64 - ROUND_BITS * ROUNDS)
    dealt = docs.withColumn(src, group_key(F.col(source))).withColumn(h, hashed)

    # names, sizes and hashes are all that the rounds read
    slim = scratch.keep(dealt.select(F.col(src).alias("src"), F.col(source).alias("name"), word_count(F.col(text)).alias("size"), F.col(h).alias("h")), "slim")
    sources = slim.groupBy("src").agg(F.first("name").alias("name"), F.sum("size").alias("size"))
    plan = scratch.keep(targets(sources, weights, share, most).withColumn("full", F.when(F.col("size") > 0, F.least(F.floor(F.col("target") / F.col("size")), F.lit(most))).otherwise(0)), "targets")
    # prefix: the bits fixed so far; need: words still wanted beyond the documents below the prefix
    state = plan.select("src", F.lit(0).cast("long").alias("prefix"), (F.col("target") - F.col("full") * F.col("size")).alias("need"))
    rows = slim.select("src", "size", "h")
    for i in range(ROUNDS):
        shift = ROUND_BITS * (ROUNDS - 1 - i)
        inside = join_few(rows, state, "src", "h").where(F.shiftrightunsigned("h", shift + ROUND_BITS) == F.col("prefix"))
        if i == 1:  # from here on, the rows of the boundary bucket of each source are all that is read
            rows = scratch.keep(inside.select("src", "size", "h"), "boundary")
            inside = join_few(rows, state, "src", "h")
        sums = inside.groupBy("src", "prefix", "need", F.shiftrightunsigned("h", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        w = Window.partitionBy("src").orderBy("bucket")
        sums = sums.withColumn("upto", F.sum("words").over(w)).withColumn("below", F.col("upto") - F.col("words"))
        # the first bucket whose end passes the need; if none does, the last one
        crossing = F.min_by(F.struct("bucket", "below"), F.when(F.col("upto") > F.col("need"), F.col("bucket")).otherwise(F.lit(1 << 62) - F.col("bucket")))
        step = sums.groupBy("src", "need").agg(crossing.alias("c"))
        state = scratch.keep(step.select("src", F.col("c.bucket").alias("prefix"), (F.col("need") - F.col("c.below")).alias("need")), f"round{i}")
    found = plan.join(state, "src", "left").select(F.col("src").alias(src), F.col("size").alias("source_size"), "target", F.col("full").alias(full), F.coalesce("prefix", F.lit(0)).alias(bar), F.coalesce("need", F.lit(0.0)).alias(need))
    found = scratch.keep(found, "found")
    met = join_few(dealt, found, src, h)

    # the last bucket of a source is one document, or documents of equal hash: they are numbered, and a document is in if
    # that comes nearer to the need.  The running sums go over the partitions in which the rows were written.
    edge = met.where(F.col(h) == F.col(bar)).withColumn("size", word_count(F.col(text))).withColumn(tie, F.monotonically_increasing_id())
    edge = scratch.keep(edge.withColumn(part, F.shiftright(tie, 33)), "edge")
    parts = edge.groupBy(src, part).agg(F.sum("size").alias(before))
    parts = parts.withColumn(before, F.sum(before).over(Window.partitionBy(src).orderBy(part)) - F.col(before))
    within = F.sum("size").over(Window.partitionBy(src, part).orderBy(tie)) - F.col("size")
    edge = edge.join(parts, [src, part]).withColumn(before, F.col(before) + within)
    edge = edge.withColumn(tie, (2 * F.col(before) + F.col("size") <= 2 * F.col(need)).cast("long")).drop(part, before)
    rest = met.where(F.col(h) != F.col(bar)).withColumn("size", word_count(F.col(text))).withColumn(tie, (F.col(h) < F.col(bar)).cast("long"))
    out = rest.unionByName(edge)
    copies = F.least(F.col(full) + F.col(tie), F.lit(most))
    scratch.only("found", "edge")
    return out.withColumn("taken", copies * F.col("size")).withColumn("copies", copies.cast("int")).drop(src, h, full, bar, need, tie)


def mix(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The mixture itself: every document as often as it is taken, with the columns of ``docs``; documents without words stay out."""
    out = mix_table(docs, text=text, **options)
    (copy,) = free_name(out, "_copy")
    taken = (F.col("copies") > 0) & (F.length(F.btrim(F.col(text), F.lit(BLANKS))) > 0)
    return out.where(taken).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*docs.columns)
