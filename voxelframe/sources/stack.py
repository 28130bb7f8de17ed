"""A Spark data source for container files: ``spark.read.format("voxelstack").load(path)`` and ``df.write``.

Reading makes a partition for each run of stored units, so only units that the
filters on ``t``, ``c`` and ``z`` leave are read and decoded (set
``spark.sql.python.filterPushdown.enabled``).  Writing takes chunk rows, as
``plans.jobs.encode_chunks`` makes them, in part files beside the target, and
the driver's commit copies them in T, C, Z order, then renames: the target is
whole or absent.  Paths must be seen by driver and executors alike.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as D

from ..codec import container
from ..plans.jobs import BATCH_BYTES, WIDE_SCHEMA, plane_words
from ..plans.spec import Dims, FormatError

#: Stored bytes that one partition reads.
PARTITION_BYTES = 64 << 20


def opener(path: str):
    fs, inner = pafs.FileSystem.from_uri(path)
    info = fs.get_file_info(inner)
    if info.type != pafs.FileType.File:
        raise FileNotFoundError(path)
    handle = fs.open_input_file(inner)
    return lambda at, n: handle.read_at(n, at), info.size, handle


@dataclass
class UnitPartition(D.InputPartition):
    units: tuple[container.Unit, ...]
    width: int
    height: int


class StackReader(D.DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.bytes = int(options.get("partitionbytes", PARTITION_BYTES))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterator[D.Filter]:  # noqa: N802
        names = {D.EqualTo: "eq", D.In: "in", D.GreaterThan: "gt", D.GreaterThanOrEqual: "ge", D.LessThan: "lt", D.LessThanOrEqual: "le"}
        for f in filters:
            if type(f) in names and len(f.attribute) == 1 and f.attribute[0] in ("t", "c", "z"):
                self.tests.append((f.attribute[0], names[type(f)], f.value))
            yield f  # units hold several planes, so Spark filters again

    def _wanted(self, u: container.Unit) -> bool:
        for a, how, v in self.tests:
            lo, hi = (u.z0, u.z0 + u.depth - 1) if a == "z" else (getattr(u, a),) * 2
            if not {"eq": lambda: lo <= v <= hi, "in": lambda: any(lo <= x <= hi for x in v), "gt": lambda: hi > v, "ge": lambda: hi >= v, "lt": lambda: lo < v, "le": lambda: lo <= v}[how]():
                return False
        return True

    def partitions(self) -> list[UnitPartition]:
        read, size, handle = opener(self.path)
        with handle:
            index = container.read_index(read, size)
        units, d = [u for u in index.units if self._wanted(u)], index.dims
        out, own, total = [], [], 0
        for u in units:
            own.append(u)
            total += u.length
            if total >= self.bytes:
                out.append(UnitPartition(tuple(own), d.x, d.y))
                own, total = [], 0
        return out + ([UnitPartition(tuple(own), d.x, d.y)] if own or not out else [])

    def read(self, partition: UnitPartition) -> Iterator[pa.RecordBatch]:
        """Decodes units of about ``BATCH_BYTES`` of raw pixels at a time, or one larger unit."""
        if not partition.units:
            return
        read, _, handle = opener(self.path)
        with handle:
            held, size = [], 0
            for u in partition.units:
                payload = read(u.offset, u.length)
                raw = 2 * partition.width * partition.height * u.depth
                if container.raw_bytes(payload) != raw:  # before anything of that size is allocated
                    raise FormatError(f"the payload of t={u.t}, c={u.c}, z={u.z0} has other extents than its container")
                held.append((u, payload))
                size += raw
                if size > BATCH_BYTES:
                    yield from self._decoded(held)
                    held, size = [], 0
            yield from self._decoded(held)

    @staticmethod
    def _decoded(held: list[tuple[container.Unit, bytes]]) -> Iterator[pa.RecordBatch]:
        for (u, _), v in zip(held, container.decoded_volumes([payload for _, payload in held])):
            planes, high = zip(*map(plane_words, v))
            same = [pa.array([x] * len(planes), pa.int32()) for x in (u.t, u.c)]
            yield pa.record_batch([*same, pa.array(range(u.z0, u.z0 + len(planes)), pa.int32()), pa.array(planes, pa.binary()), pa.array(high, pa.binary())], names=["t", "c", "z", "pixels", "high"])


@dataclass
class Parts(D.WriterCommitMessage):
    path: str
    records: list[tuple]


class StackWriter(D.DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        try:
            self.dims = Dims(*(int(options[k]) for k in ("x", "y", "z", "c", "t")))
            self.chunk_depth = int(options["chunkdepth"])
        except KeyError as e:
            raise FormatError(f"writing needs the options x, y, z, c, t and chunkdepth: {e} is missing") from e
        self.lossy, self.parts = options.get("lossy", "false") == "true", f"{self.path}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Parts:
        fs, inner = pafs.FileSystem.from_uri(self.parts)
        fs.create_dir(inner)
        name, records, at = f"{inner}/{uuid.uuid4().hex}", [], 0
        with fs.open_output_stream(name) as out:
            for b in iterator:
                for r in b.select(["t", "c", "z0", "depth", "payload"]).to_pylist():
                    data = container.chunk_record(r["t"], r["c"], r["z0"], r["depth"], r["payload"])
                    out.write(data)
                    records.append((r["t"], r["c"], r["z0"], r["depth"], at, len(data)))
                    at += len(data)
        return Parts(name, records)

    def commit(self, messages: list[Parts | None]) -> None:
        fs, inner = pafs.FileSystem.from_uri(self.path)
        try:
            if not self.overwrite and fs.get_file_info(inner).type != pafs.FileType.NotFound:
                raise FileExistsError(self.path)
            records = sorted((*r, m.path) for m in messages if m for r in m.records)
            each = -(-self.dims.z // self.chunk_depth)
            want = [(t, c, k * self.chunk_depth, min(self.chunk_depth, self.dims.z - k * self.chunk_depth)) for t in range(self.dims.t) for c in range(self.dims.c) for k in range(each)]
            if [r[:4] for r in records] != want:
                raise FormatError(f"{len(records)} chunks do not make the declared dataset of {len(want)}")
            temporary = f"{inner}.{uuid.uuid4().hex}"
            with fs.open_output_stream(temporary) as out:
                out.write(container.stream_header(self.dims, self.chunk_depth, len(records), self.lossy))
                for *_, at, n, path in records:
                    with fs.open_input_file(path) as part:
                        out.write(part.read_at(n, at))
            if isinstance(fs, pafs.LocalFileSystem) and not self.overwrite:
                try:
                    os.link(temporary, inner)  # fails if the target is there, also if it came meanwhile
                finally:
                    os.unlink(temporary)
            else:
                fs.move(temporary, inner)
        finally:
            self.abort(messages)

    def abort(self, messages: list[Parts | None]) -> None:
        fs, inner = pafs.FileSystem.from_uri(self.parts)
        if isinstance(fs, pafs.LocalFileSystem):
            shutil.rmtree(inner, ignore_errors=True)
        elif fs.get_file_info(inner).type != pafs.FileType.NotFound:
            fs.delete_dir(inner)


class StackSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "voxelstack"

    def schema(self) -> str:
        return WIDE_SCHEMA

    def reader(self, schema) -> StackReader:
        return StackReader(self.options)

    def writer(self, schema, overwrite: bool) -> StackWriter:
        return StackWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    from .tiff import TiffSource

    spark.dataSource.register(StackSource)
    spark.dataSource.register(TiffSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def unit_index(spark: SparkSession, path: str):
    """``kind, t, c, z0, depth, off, len`` of each stored unit, without decoding any."""
    read, size, handle = opener(path)
    with handle:
        index = container.read_index(read, size)
    rows = [(index.kind, u.t, u.c, u.z0, u.depth, u.offset, u.length) for u in index.units]
    return spark.createDataFrame(rows, "kind string, t int, c int, z0 int, depth int, off long, len long")


def file_info(spark: SparkSession, path: str):
    """One row: the extents of a container, its kind and its flags."""
    read, size, handle = opener(path)
    with handle:
        index = container.read_index(read, size)
    d = index.dims
    return spark.createDataFrame([(d.t, d.c, d.z, d.y, d.x, index.kind, container.file_flags(index))], "t int, c int, z int, y int, x int, kind string, flags int")
