"""Multiscale images as tables: levels by repeated means, their scale and translation, and the JSON that describes them."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import arrays
from ..plans.spec import Calibration, FormatError, Options
from ..functions.transform import quantize, reconstruct
from .statistics import mean_level

# The units that axes may have.
SPACE = ("nanometer", "micrometer", "millimeter", "centimeter", "meter")
TIME = ("nanosecond", "microsecond", "millisecond", "second", "minute", "hour")


def level_table(voxels: DataFrame, sizes: dict[str, int], levels: int, scale: dict[str, float] | None = None, translation: dict[str, float] | None = None, lossy: bool = False) -> tuple[DataFrame, list[dict]]:
    """All levels as one table with ``level``, and for each level its sizes, scale and translation.

    Each level halves y and x of the one before it (axes of one pixel stay); a voxel's centre moves by half a step, so
    ``translation += scale * (factor - 1) / 2`` and then ``scale *= factor``.  Lossy levels must be made losslessly and
    then repacked.
    """
    if levels < 1 or levels > 1 + math.ceil(math.log2(max(sizes["y"], sizes["x"]))):
        raise FormatError("too many levels for these extents")
    if lossy and levels > 1:
        raise FormatError("make the levels losslessly, then repack them")
    now, size = voxels, dict(sizes)
    sc, tr = {a: float((scale or {}).get(a, 1)) for a in size}, {a: float((translation or {}).get(a, 0)) for a in size}
    if not all(map(math.isfinite, [*sc.values(), *tr.values()])):
        raise FormatError("scale and translation must be finite")
    out, told = now.withColumn("level", F.lit(0)), [{"level": 0, "sizes": dict(size), "scale": dict(sc), "translation": dict(tr)}]
    for level in range(1, levels):
        ratio = {a: 2 for a in "yx" if size[a] > 1}
        now = mean_level(now, size, ratio)
        for a, f in ratio.items():
            tr[a] += sc[a] * (f - 1) / 2
            sc[a] *= f
            size[a] = -(-size[a] // f)
        out = out.unionByName(now.withColumn("level", F.lit(level)))
        told.append({"level": level, "sizes": dict(size), "scale": dict(sc), "translation": dict(tr)})
    return out, told


def describe(levels: list[dict], axes: str, name: str, units: dict[str, str] | None = None) -> str:
    """The multiscales entry: axes with kinds and units, and each level's path and transformations."""
    units = units or {}
    if set(units) - set(axes):
        raise FormatError("units of axes that the image lacks")
    listed = []
    for a in axes:
        kind = {"t": "time", "c": "channel"}.get(a, "space")
        entry = {"name": a, "type": kind}
        if a in units:
            if units[a] not in {"time": TIME, "space": SPACE, "channel": ()}[kind]:
                raise FormatError(f"{units[a]!r} is no unit of {kind}")
            entry["unit"] = units[a]
        listed.append(entry)
    sets = []
    for x in levels:
        steps = [{"type": "scale", "scale": [x["scale"].get(a, 1.0) for a in axes]}]
        if any(x["translation"].values()):
            steps.append({"type": "translation", "translation": [x["translation"].get(a, 0.0) for a in axes]})
        sets.append({"path": str(x["level"]), "coordinateTransformations": steps})
    return json.dumps({"name": name, "axes": listed, "datasets": sets, "type": "mean"})


CODED_SCHEMA = "level int, t long, c long, chunk_z long, chunk_y long, chunk_x long, depth int, height int, width int, payload binary"


def code_levels(table: DataFrame, chunks: dict[str, int], options: Options = Options(), calibration: Calibration | None = None) -> DataFrame:
    """Every chunk of every level (``level, t, c, z, y, x, v``) as a framed chunk of the block codec, with its place and extents."""
    places = [F.expr(f"{a} div {chunks[a]}").alias(f"chunk_{a}") for a in "zyx"]
    own = F.array_sort(F.collect_list(F.struct("z", "y", "x", "v")))
    sizes = [(F.max(a) - F.min(a) + 1).cast("int").alias(n) for a, n in zip("zyx", ("depth", "height", "width"))]
    grouped = table.groupBy(F.col("level").cast("int").alias("level"), *[F.col(a).cast("long").alias(a) for a in "tc"], *places).agg(*sizes, F.transform(own, lambda s: s["v"].cast("int")).alias("values"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                shape = tuple(row.column(n)[0].as_py() for n in ("depth", "height", "width"))
                values = np.asarray(row.column("values").flatten())
                if len(values) != np.prod(shape):
                    raise FormatError(f"{len(values)} voxels do not make a chunk of {shape}")
                frame = arrays.encode_chunk(values.astype("<u2").reshape(shape), "zyx", options, calibration)
                yield pa.record_batch([*row.columns[:-1], pa.array([frame], pa.binary())], names=[*row.schema.names[:-1], "payload"])

    return grouped.mapInArrow(run, CODED_SCHEMA)


def decode_levels(coded: DataFrame, chunks: dict[str, int]) -> DataFrame:
    """The voxels of coded chunks: ``level, t, c, z, y, x, v``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                v = arrays.decode_chunk(r["payload"], (r["depth"], r["height"], r["width"]), "zyx", "<u2")
                at = [x.ravel() + r[f"chunk_{a}"] * chunks[a] for a, x in zip("zyx", np.indices(v.shape))]
                same = [pa.array(np.full(v.size, r[k]), t) for k, t in (("level", pa.int32()), ("t", pa.int64()), ("c", pa.int64()))]
                yield pa.record_batch([*same, *map(pa.array, at), pa.array(v.ravel().astype(np.int64))], names=["level", "t", "c", "z", "y", "x", "v"])

    return coded.mapInArrow(run, "level int, t long, c long, z long, y long, x long, v long")


def write_levels(table: DataFrame, path: str, description: str, codec: str = "zstd") -> None:
    """The levels as Parquet partitioned by level, and the description beside them; codec ``zstd`` or ``none``."""
    table.write.partitionBy("level").option("compression", codec).parquet(f"{path}/levels")
    table.sparkSession.createDataFrame([(description,)], "value string").coalesce(1).write.text(f"{path}/multiscales")


def rechunk(voxels: DataFrame, chunks: dict[str, int], keep: tuple[str, ...] = ("t", "c")) -> DataFrame:
    """One row for each chunk of another grid: its place along the axes of ``chunks`` and its ``values``, first axis slowest."""
    places = [F.expr(f"{a} div {n}").alias(f"chunk_{a}") for a, n in chunks.items()]
    own = F.array_sort(F.collect_list(F.struct(*chunks, "v")))
    return voxels.groupBy(*keep, *places).agg(F.transform(own, lambda s: s["v"]).alias("values"))


def repack(table: DataFrame, calibration: Calibration | None, label: str = "is_label") -> DataFrame:
    """Every level quantised once; rows marked as labels stay as they are."""
    if calibration is None:
        return table
    return table.withColumn("v", F.when(F.col(label), F.col("v")).otherwise(reconstruct(quantize(F.col("v"), calibration), calibration)))


def declared_paths(description: str) -> list[str]:
    """The paths that a description names; absolute ones and steps upwards are an error."""
    paths = [d["path"] for d in json.loads(description)["datasets"]]
    if any(p.startswith("/") or ".." in p.split("/") for p in paths):
        raise FormatError("paths must stay below the image")
    return paths
