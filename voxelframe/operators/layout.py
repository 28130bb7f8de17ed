"""Page order, coordinates and chunk grids as expressions and small relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.spec import FormatError, check_page_order


def page_index(order: str, sizes: dict[str, int], **coords: Column) -> Column:
    """The page of a plane for an order from slowest to fastest, such as ``TCZ``."""
    out = F.lit(0)
    for a in check_page_order(order).lower():
        out = out * sizes[a] + coords[a]
    return out


def page_coordinates(page: str, order: str, sizes: dict[str, int]) -> dict[str, Column]:
    """The inverse: T, C and Z of a page, by remainders and quotients of the fastest axes first."""
    out, scale = {}, 1
    for a in reversed(check_page_order(order).lower()):
        out[a] = F.expr(f"({page} div {scale}) % {sizes[a]}")
        scale *= sizes[a]
    return out


def ome_order(order: str) -> str:
    """An order from slowest to fastest, such as ``TCZ``, as the metadata writes it: ``XYZCT``."""
    return "XY" + check_page_order(order)[::-1]


def expand_tiff_data(entries: DataFrame, order: str, sizes: dict[str, int]) -> DataFrame:
    """One row for each plane of entries ``(ifd, first_t, first_c, first_z, plane_count)``; ``order`` is fastest first, such as ``ZCT``.

    An entry covers ``plane_count`` planes from its first one on, in the order, and as many IFDs.
    """
    rows = entries.select("*", F.explode(F.sequence(F.lit(0), F.col("plane_count") - 1)).alias("k"))
    linear, scale = F.col("k").cast("long"), 1
    for a in order.lower():
        linear, scale = linear + F.col(f"first_{a}") * scale, scale * sizes[a]
    rows = rows.withColumn("lin", linear).withColumn("ifd", F.col("ifd") + F.col("k"))
    scale, cols = 1, {}
    for a in order.lower():
        cols[a] = F.expr(f"(lin div {scale}) % {sizes[a]}")
        scale *= sizes[a]
    return rows.withColumns(cols).select("ifd", "t", "c", "z")


def check_coverage(pages: DataFrame, n_pages: int) -> DataFrame:
    """What is wrong with a page map: IFDs without a plane, IFDs or planes named twice, and gaps in the rectangle; empty if nothing is."""
    spark = pages.sparkSession
    missing = spark.range(n_pages).select(F.col("id").alias("ifd")).join(pages, "ifd", "left_anti").select(F.lit("missing ifd").alias("problem"), F.col("ifd").alias("n"))
    twice = pages.groupBy("ifd").count().where("count > 1").select(F.lit("ifd named twice").alias("problem"), F.col("ifd").alias("n"))
    planes = pages.groupBy("t", "c", "z").count().where("count > 1").select(F.lit("plane named twice").alias("problem"), F.col("count").alias("n"))
    box = F.lit(1)
    for a in "tcz":
        box = box * (F.max(a) - F.min(a) + 1)
    gap = pages.agg(box.alias("box"), F.countDistinct("t", "c", "z").alias("n")).where("box <> n").select(F.lit("not a rectangle").alias("problem"), F.col("n"))
    return missing.unionByName(twice).unionByName(planes).unionByName(gap)


def rebase(pages: DataFrame) -> DataFrame:
    """A partial acquisition moved to its own origin."""
    low = pages.agg(*[F.min(a).alias(f"_{a}") for a in "tcz"])
    moved = pages.join(F.broadcast(low), how="inner")  # one row
    return moved.select("ifd", *[(F.col(a) - F.col(f"_{a}")).alias(a) for a in "tcz"])


def is_local(uuid: Column, root: Column, file_name: Column, own_name: str) -> Column:
    """Whether an entry means this file: by identifier where both sides have one, else by its name as seen from the file's folder.

    An entry that names no file does; a name with another folder does not.  One whose identifier cannot be compared and
    that has no name is an error.
    """
    theirs, ours = (F.nullif(F.lower(F.trim(x)), F.lit("")) for x in (uuid, root))
    plain = F.regexp_replace(file_name, r"^(\./+)+", "")
    unclear = F.raise_error(F.lit("an entry names its file by nothing that can be compared")).cast("boolean")
    return F.when(theirs.isNotNull() & ours.isNotNull(), theirs == ours).when(file_name.isNotNull(), plain == own_name).when(uuid.isNull(), F.lit(True)).otherwise(unclear)


def chunk_grid(df: DataFrame, sizes: dict[str, int], chunks: dict[str, int]) -> DataFrame:
    """``df`` with the number of the chunk that each voxel lies in, along every axis."""
    return df.withColumns({f"chunk_{a}": F.expr(f"{a} div {n}") for a, n in chunks.items()})


def block_specs(df: DataFrame, depth: int, z: str = "z") -> DataFrame:
    """Z slabs: first plane and depth of each block of a number of planes ``nz``."""
    rows = df.select("*", F.explode(F.sequence(F.lit(0), F.expr(f"(nz - 1) div {depth}"))).alias("b"))
    return rows.select(*[c for c in rows.columns if c != "b"], (F.col("b") * depth).alias("z0"), F.least(F.lit(depth), F.col("nz") - F.col("b") * depth).alias("depth"))


def check_canonical(planes: DataFrame, sizes: dict[str, int], arrival: str = "seq") -> DataFrame:
    """Planes that did not arrive in T, C, Z order: the first of them is where a sequential writer must stop."""
    want = (F.col("t") * sizes["c"] + F.col("c")) * sizes["z"] + F.col("z")
    return planes.withColumn("expected", want).where(F.col(arrival) != want)


def complete_levels(images: DataFrame, n_planes: int) -> DataFrame:
    """Pyramid levels that every plane has, at one size: ``path, w, h``."""
    kinds = images.groupBy("path").agg(F.countDistinct("plane").alias("n"), F.min("w").alias("w"), F.max("w").alias("w1"), F.min("h").alias("h"), F.max("h").alias("h1"))
    return kinds.where((F.col("n") == n_planes) & (F.col("w") == F.col("w1")) & (F.col("h") == F.col("h1"))).select("path", "w", "h")


def record_offsets(records: DataFrame, by: list[str], header: int, framing: int) -> DataFrame:
    """Where each record's payload starts: a running sum of lengths and framing after the header."""
    w = Window.partitionBy(*by).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return records.withColumn("off", F.lit(header) + F.coalesce(F.sum(F.col("len") + framing).over(w), F.lit(0)) + framing)


def unit_of(kind: str, z: Column, chunk_depth: int) -> Column:
    """The key of the stored unit of a plane: the file, its volume, or its chunk."""
    if kind not in ("single", "volumes", "stream"):
        raise FormatError(f"unknown container kind {kind}")
    return F.floor(z / chunk_depth).cast("long") if kind == "stream" else F.lit(0).cast("long")
