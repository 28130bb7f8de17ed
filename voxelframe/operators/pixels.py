"""Voxels, planes, blocks: relations over one dense dataset and conversions between them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.transform import q_symbol, sink_context
from ..plans.spec import U16, U32, Options


@dataclass(frozen=True)
class Geometry:
    """Extents of a dataset without its time axis, which grows with the data."""

    x: int
    y: int
    z: int
    c: int

    @property
    def frame(self) -> int:
        return self.x * self.y * self.z * self.c


def with_coordinates(df: DataFrame, g: Geometry, i: str = "i") -> DataFrame:
    """T, C, Z, Y, X of a linear index, X fastest."""
    return df.withColumns({
        "x": F.expr(f"{i} % {g.x}"),
        "y": F.expr(f"({i} div {g.x}) % {g.y}"),
        "z": F.expr(f"({i} div {g.x * g.y}) % {g.z}"),
        "c": F.expr(f"({i} div {g.x * g.y * g.z}) % {g.c}"),
        "t": F.expr(f"{i} div {g.frame}"),
    })


def linear_index(g: Geometry, t: Column, c: Column, z: Column, y: Column, x: Column) -> Column:
    return (((t * g.c + c) * g.z + z) * g.y + y) * g.x + x


#: The three relations of pixels that the tests draw from the tables: table, key, value and geometry.
EVENTS, ORDERS, EMBED = Geometry(25, 4, 5, 2), Geometry(15, 5, 5, 2), 64


def px_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("i"), F.round(F.col("value") * 100).cast("long").alias("v"))
    return with_coordinates(rows, EVENTS)


def px_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("i"), (F.round(F.col("o_totalprice") * 100).cast("long") % 65536).alias("v"))
    return with_coordinates(rows, ORDERS)


def px_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("y"), F.posexplode("embedding").alias("x", "e"))
    return rows.select((F.col("y") * EMBED + F.col("x")).alias("i"), F.round((F.col("e").cast("double") + 1) * 127.5).cast("long").alias("v"), F.col("x").cast("long").alias("x"), "y")


def contexts(voxels: DataFrame, g: Geometry, options: Options = Options()) -> DataFrame:
    """Voxels with ``q``, the alphabet of their volume, and the causal context of each: one window over a block's voxels.

    The neighbours to the left, above and in the plane before lie 1, X and X * Y places back in the order of the block,
    so three lags of one sorted window find them; lags that run into another row or plane are discarded by the rules
    for the edges.
    """
    block = F.expr(f"z div {options.block_depth}")
    w = Window.partitionBy("t", "c", "b").orderBy("i")
    rows = voxels.withColumn("q", q_symbol(F.col("v"))).withColumn("b", block)
    # one row for each volume; the voxels meet by block only
    alphabet = rows.groupBy("t", "c").agg((F.max("q") + 1).alias("alphabet"))
    rows = rows.join(alphabet, ["t", "c"])
    near = {n: F.coalesce(F.lag("q", k).over(w), F.lit(0)) for n, k in (("l", 1), ("u", g.x), ("p", g.x * g.y))}
    rows = rows.withColumns(near).withColumn("lz", F.expr(f"z % {options.block_depth}"))
    c = F.col
    return rows.withColumn("ctx", sink_context(c("lz"), c("y"), c("x"), c("l"), c("u"), c("p"), c("alphabet"), options.mode))


def planes(voxels: DataFrame) -> DataFrame:
    """One row for each plane, its pixels packed as little-endian 16-bit binary; ``high`` has the bits above of planes with wider ones."""
    sound = F.when(F.col("v").between(0, U32), F.col("v")).when(F.col("v").isNotNull(), F.raise_error(F.concat(F.lit(f"samples must lie in 0..{U32}: "), F.col("v"))))

    def packed(shift: int) -> Column:
        byte = lambda s, k: F.lpad(F.hex(F.shiftright(s["v"], shift + k).bitwiseAND(255)), 2, "0")
        return F.unhex(F.array_join(F.transform("own", lambda s: F.concat(byte(s, 0), byte(s, 8))), ""))

    rows = voxels.groupBy("t", "c", "z").agg(F.array_sort(F.collect_list(F.struct("y", "x", sound.alias("v")))).alias("own"), F.max("v").alias("most"))
    return rows.select("t", "c", "z", packed(0).alias("pixels"), F.when(F.col("most") > U16, packed(16)).alias("high"))


def hyperslab(voxels: DataFrame, **picks: int | slice) -> DataFrame:
    """``voxels[t=..., z=slice(a, b, s), ...]``: integer picks drop their axis, slices renumber theirs from 0; steps may be negative.

    The extents of the axes are those of the rows, counted once.
    """
    named = {a: p for a, p in picks.items() if isinstance(p, slice)}
    sizes = voxels.agg(*[(F.max(a) + 1).alias(a) for a in named]).first().asDict() if named else {}
    out = voxels
    for a, p in picks.items():
        if isinstance(p, slice):
            start, stop, step = p.indices(int(sizes[a] or 0))
            where = F.col(a).between(start, stop - 1) if step > 0 else F.col(a).between(stop + 1, start)
            out = out.where(where & (F.pmod(F.col(a) - start, F.lit(abs(step))) == 0)).withColumn(a, F.expr(f"({a} - {start}) div {step}"))
        else:
            out = out.where(F.col(a) == p).drop(a)
    return out


def read_planes(stored: DataFrame, requests: DataFrame, chunk_depth: int) -> DataFrame:
    """Planes (or voxels of planes) for requests ``(ord, t, c, z)``, duplicates included, found by the computed unit key.

    An equality on ``z div chunk_depth`` finds the unit; a range predicate would have to compare all pairs.
    """
    units = stored.withColumn("unit", F.expr(f"z div {chunk_depth}"))
    return requests.withColumn("unit", F.expr(f"z div {chunk_depth}")).join(units, ["t", "c", "unit", "z"]).drop("unit")
