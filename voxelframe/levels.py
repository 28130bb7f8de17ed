"""Command line of multiscale chunk stores: make one of a page file, describe it, pack it anew, write a level as pages.

    python -m voxelframe.levels encode stack.tif store --levels 3 --channels 2 --slices 5
    python -m voxelframe.levels info store
    python -m voxelframe.levels repack store lossy --offset 100 --gain 0.46 [--step 2]
    python -m voxelframe.levels decode store frames --level 1

A store is a folder: the coded chunks of all levels as Parquet (``chunks``, by level) and the multiscale text beside
them.  Paths are URIs or absolute, seen by all executors.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ship
from .cli import finite, positive
from .operators import multiscale
from .plans import jobs
from .plans.spec import Calibration, FormatError
from .sources import stack, tiff

CHUNKS = {"z": 16, "y": 128, "x": 128}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="voxelframe.levels", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("encode", "info", "repack", "decode"):
        p = sub.add_parser(name)
        p.add_argument("input")
        if name != "info":
            p.add_argument("output")
        if name == "encode":
            p.add_argument("--levels", type=positive, default=1)
            p.add_argument("--channels", type=positive, default=1)
            p.add_argument("--slices", type=positive, required=True)
        if name == "repack":
            for a in ("offset", "gain"):
                p.add_argument(f"--{a}", type=finite, required=True)
            p.add_argument("--step", type=finite, default=2.0)
        if name == "decode":
            p.add_argument("--level", type=int, default=0)
    return top


def uri(path: str) -> str:
    return path if ":" in path else f"file://{path}"


def _write(spark: SparkSession, coded: DataFrame, path: str, text: str) -> None:
    coded.write.partitionBy("level").parquet(f"{path}/chunks")
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/multiscales")


def _read(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    text = spark.read.text(f"{path}/multiscales").first()[0]
    coded = spark.read.parquet(f"{path}/chunks")
    return coded.select(*[f.split()[0] for f in multiscale.CODED_SCHEMA.split(", ")]), json.loads(text)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("levels").getOrCreate()
    ship(spark)
    stack.register(spark)
    if a.command == "encode":
        facts = tiff.inspect(uri(a.input))
        c, z = a.channels, a.slices
        if facts["item"] > 2:
            raise FormatError("samples must be unsigned of 8 or 16 bits")
        if facts["planes"] % (c * z):
            raise FormatError(f"{facts['planes']} pages are no whole number of frames of {c} channels and {z} slices")
        pages = spark.read.format("tiffplanes").load(uri(a.input))
        planes = pages.select(F.expr(f"page div {c * z}").alias("t"), F.expr(f"page div {z} % {c}").alias("c"), F.expr(f"page % {z}").alias("z"), "pixels")
        table, told = multiscale.level_table(jobs.voxels_of(planes, facts["width"]), {"z": z, "y": facts["height"], "x": facts["width"]}, a.levels)
        _write(spark, multiscale.code_levels(table, CHUNKS), uri(a.output), multiscale.describe(told, "tczyx", "image"))
        return 0
    coded, text = _read(spark, uri(a.input))
    if a.command == "info":
        rows = coded.groupBy("level").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.octet_length("payload")).alias("bytes"), (F.max("chunk_x") * CHUNKS["x"] + F.max_by("width", "chunk_x")).alias("x")).orderBy("level").collect()
        print(json.dumps({"axes": [x["name"] for x in text["axes"]], "levels": [{"path": d["path"], **{k: r[k] for k in ("chunks", "bytes", "x")}} for d, r in zip(text["datasets"], rows)]}))
    elif a.command == "repack":
        voxels = multiscale.decode_levels(coded, CHUNKS)
        _write(spark, multiscale.code_levels(voxels, CHUNKS, calibration=Calibration(a.offset, a.gain, a.step)), uri(a.output), json.dumps(text))
    else:
        voxels = multiscale.decode_levels(coded.where(F.col("level") == a.level), CHUNKS)
        # the extents of the level, and its planes in each frame
        size = voxels.agg(*[(F.max(k) + 1).alias(k) for k in "czyx"]).first()
        if size["x"] is None:
            raise FormatError(f"no level {a.level}")
        planes = jobs.pack_planes(voxels, size["x"], size["y"])
        for row in tiff.write_frames(planes, uri(a.output), size["x"], size["y"], size["c"] * size["z"]).collect():
            print(row["file"])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
