"""Encoding and decoding as Spark jobs: chunks of planes are the unit of work, and nothing larger meets in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..codec import container
from .spec import U32, Calibration, FormatError, Options

CHUNK_SCHEMA = "t int, c int, z0 int, depth int, payload binary, raw_bytes long, total_bytes long, q_bytes long, r_bytes long, model_bytes long, blocks int, raw_blocks int, q_max int"
PLANE_SCHEMA = "t int, c int, z int, pixels binary"
#: Planes of samples that may be wider: the bits above the sixteenth, null if there are none.
WIDE_SCHEMA = f"{PLANE_SCHEMA}, high binary"
#: Raw bytes of the chunks that a task holds at once; how many of them go in lock step is the container's choice.
BATCH_BYTES = 64 << 20
_STATS = ("raw_bytes", "total_bytes", "q_bytes", "r_bytes", "model_bytes", "blocks", "raw_blocks", "q_max")


def plane_words(plane: np.ndarray) -> tuple[bytes, bytes | None]:
    """``pixels`` and ``high`` of a plane."""
    high = plane >> 16
    return (plane & 65535).astype("<u2").tobytes(), high.astype("<u2").tobytes() if high.any() else None


def plane_samples(pixels: bytes, high: bytes | None) -> np.ndarray:
    """The inverse, in one row."""
    low = np.frombuffer(pixels, "<u2")
    return low if high is None else low.astype(np.int64) | np.frombuffer(high, "<u2").astype(np.int64) << 16


def with_high(planes: DataFrame) -> DataFrame:
    """Planes with a column ``high``, be there wider samples or not."""
    return planes if "high" in planes.columns else planes.withColumn("high", F.lit(None).cast("binary"))


def encode_chunks(planes: DataFrame, width: int, height: int, chunk_depth: int, options: Options = Options(), calibration: Calibration | None = None) -> DataFrame:
    """Chunks of ``planes`` (``t, c, z, pixels`` as little-endian 16-bit binary, ``high`` the same of wider samples' upper bits), each an independent volume stream.

    One shuffle gathers the planes of a chunk, whose size is bounded by ``chunk_depth``; the coder then takes as many chunks
    of an Arrow batch in lock step as its working memory holds.  A chunk with missing or repeated planes, or one of a wrong size, is an error.
    """
    grouped = with_high(planes).groupBy("t", "c", F.expr(f"z div {chunk_depth}").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("z", "pixels", "high"))).alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, size = [], 0
            for i in range(b.num_rows):
                (r,) = b.slice(i, 1).to_pylist()
                zs = [p["z"] for p in r["own"]]
                if zs != list(range(r["chunk"] * chunk_depth, r["chunk"] * chunk_depth + len(zs))) or any(len(x) != 2 * width * height for p in r["own"] for x in (p["pixels"], p["high"]) if x is not None):
                    raise ValueError(f"planes {zs} do not make chunk {r['chunk']} of t={r['t']}, c={r['c']}")
                rows.append((r, np.concatenate([plane_samples(p["pixels"], p["high"]) for p in r["own"]]).reshape(len(zs), height, width)))
                size += rows[-1][1].nbytes
                if size > BATCH_BYTES:
                    yield _encoded(rows, options, calibration)
                    rows, size = [], 0
            if rows:
                yield _encoded(rows, options, calibration)

    return grouped.mapInArrow(run, CHUNK_SCHEMA)


def _encoded(rows: list[tuple[dict, np.ndarray]], options: Options, calibration: Calibration | None) -> pa.RecordBatch:
    done = container.encode_volumes([v for _, v in rows], options, calibration)
    fields = {k: [] for k in ("t", "c", "z0", "depth", "payload", *_STATS)}
    for (r, v), (payload, stats) in zip(rows, done):
        for k, x in {"t": r["t"], "c": r["c"], "z0": r["own"][0]["z"], "depth": len(v), "payload": payload, **stats}.items():
            fields[k].append(x)
    kinds = {"payload": pa.binary(), **{k: pa.int64() for k in _STATS[:5]}}
    return pa.record_batch([pa.array(x, kinds.get(k, pa.int32())) for k, x in fields.items()], names=list(fields))


def decode_chunks(chunks: DataFrame) -> DataFrame:
    """Planes of chunks (``t, c, z0, payload``): no shuffle; chunks of about ``BATCH_BYTES`` of raw pixels in lock step, or one larger chunk."""

    def decoded(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        for r, v in zip(rows, container.decoded_volumes([r["payload"] for r in rows])):
            planes, high = zip(*map(plane_words, v))
            at = [pa.array(np.full(len(planes), r[k], dtype=np.int32)) for k in ("t", "c")]
            yield pa.record_batch([*at, pa.array(r["z0"] + np.arange(len(planes), dtype=np.int32)), pa.array(planes, pa.binary()), pa.array(high, pa.binary())], names=["t", "c", "z", "pixels", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, size = [], 0
            for i in range(b.num_rows):
                rows += b.slice(i, 1).to_pylist()
                size += container.raw_bytes(rows[-1]["payload"])
                if size > BATCH_BYTES:
                    yield from decoded(rows)
                    rows, size = [], 0
            if rows:
                yield from decoded(rows)

    return chunks.select("t", "c", "z0", "payload").mapInArrow(run, WIDE_SCHEMA)


def voxels_of(planes: DataFrame, width: int) -> DataFrame:
    """Voxels of packed planes, for analytics: one row for each pixel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, c, z, pixels, high in zip(*(b.column(k).to_pylist() for k in ("t", "c", "z", "pixels", "high"))):
                v = plane_samples(pixels, high).astype(np.int64)
                at = np.arange(len(v))
                yield pa.record_batch([pa.array(np.full(len(v), k, dtype=np.int64)) for k in (t, c, z)] + [pa.array(at // width), pa.array(at % width), pa.array(v)], names=["t", "c", "z", "y", "x", "v"])

    return with_high(planes).mapInArrow(run, "t long, c long, z long, y long, x long, v long")


def pack_planes(voxels: DataFrame, width: int, height: int) -> DataFrame:
    """Planes of voxels, each a group of one plane's rows."""

    def pack(rows: pa.Table) -> pa.Table:
        out = np.zeros(width * height, dtype=np.int64)
        out[np.asarray(rows["y"]) * width + np.asarray(rows["x"])] = np.asarray(rows["v"])
        if out.min() < 0 or out.max() > U32:
            raise FormatError(f"samples must lie in 0..{U32}")
        return pa.table({k: pa.array([rows[k][0].as_py()], pa.int32()) for k in ("t", "c", "z")} | {k: pa.array([x], pa.binary()) for k, x in zip(("pixels", "high"), plane_words(out))})

    return voxels.select("t", "c", "z", "y", "x", "v").groupBy("t", "c", "z").applyInArrow(pack, WIDE_SCHEMA)


def header_fields(payload: str = "payload") -> dict:
    """Extents and kind of a volume stream from its first bytes, without Python."""

    def u32(at: int):
        return F.conv(F.concat(*[F.hex(F.substring(payload, at + k, 1)) for k in (4, 3, 2, 1)]), 16, 10).cast("long")

    return {"magic": F.decode(F.substring(payload, 1, 4), "utf-8"), "nx": u32(8), "ny": u32(12), "nz": u32(16), "block_depth": u32(20)}


def check_payloads(chunks: DataFrame, width: str, height: str, lossy: bool) -> DataFrame:
    """``chunks`` with ``fits``: whether each payload's header has the coder's mode, the extents ``width`` and ``height`` (columns) and the depth of its row."""
    h = header_fields()
    magic = container.VOLUME[lossy].decode()
    return chunks.withColumn("fits", (h["magic"] == magic) & (h["nx"] == F.col(width)) & (h["ny"] == F.col(height)) & (h["nz"] == F.col("depth")))
