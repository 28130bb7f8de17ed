"""TIFF stacks in Spark: the data source ``tiffplanes`` (a file or a folder of files) and a sink of one file for each frame.

``spark.read.format("tiffplanes").load(path)`` gives ``file, page, width, height, bits, pixels, high``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import datasource as D

from ..codec import tiff
from ..plans.jobs import plane_samples, plane_words, with_high
from ..plans.spec import FormatError
from .stack import opener

SCHEMA = "file string, page int, width int, height int, bits int, pixels binary, high binary"
PAGES = 256


@dataclass
class PageRange(D.InputPartition):
    """Some pages of one file: where each lies, so that no task reads the directories again."""

    path: str
    first: int
    parts: tuple[tuple[tiff.Page, int, int], ...]  # page, sample, place in a contiguous stack


def files_of(path: str) -> list[str]:
    """The file itself, or the TIFF files of a folder by name."""
    fs, inner = pafs.FileSystem.from_uri(path)
    if fs.get_file_info(inner).type != pafs.FileType.Directory:
        return [path]
    found = [f.base_name for f in fs.get_file_info(pafs.FileSelector(inner)) if f.is_file and f.base_name.lower().endswith((".tif", ".tiff"))]
    return [f"{path.rstrip('/')}/{n}" for n in sorted(found)]


def inspect(path: str) -> dict:
    """Pages, extents, sample depth and description of a stack; mixed extents or depths are an error."""
    read, size, handle = opener(path)
    with handle:
        pages = tiff.read_pages(read, size)
        if not pages:
            raise FormatError("no pages")
        kinds = {(p.one(tiff.WIDTH), p.one(tiff.HEIGHT), p.item, p.samples) for p in pages}
        if len(kinds) != 1:
            raise FormatError(f"pages differ: {sorted(kinds)}")
        w, h, item, samples = kinds.pop()
        planes = tiff.contiguous_count(pages[0], len(pages), size)
    return {"width": w, "height": h, "item": item, "samples": samples, "planes": planes * samples, "stored": len(pages), "description": pages[0].description}


class TiffReader(D.DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[PageRange]:
        out = []
        for path in files_of(self.path):
            info = inspect(path)
            read, size, handle = opener(path)
            with handle:
                pages = tiff.read_pages(read, size)
            stored = info["stored"] > 1 or info["planes"] == info["samples"]
            parts = [(pages[i // info["samples"]], i % info["samples"], 0) if stored else (pages[0], 0, i) for i in range(info["planes"])]
            out += [PageRange(path, a, tuple(parts[a : a + PAGES])) for a in range(0, len(parts), PAGES)]
        return out

    def read(self, partition: PageRange) -> Iterator[pa.RecordBatch]:
        read, _, handle = opener(partition.path)
        name = partition.path.rpartition("/")[2]
        with handle:
            for i, (page, sample, place) in enumerate(partition.parts, partition.first):
                plane = tiff.read_plane(read, page, sample, place)
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
                row = (name, i, plane.shape[1], plane.shape[0], 8 * page.item, *plane_words(plane))
                yield pa.record_batch([pa.array([x], k) for x, k in zip(row, kinds)], names=["file", "page", "width", "height", "bits", "pixels", "high"])


class TiffSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "tiffplanes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TiffReader:
        return TiffReader(self.options)


def write_frames(planes: DataFrame, folder: str, width: int, height: int, count: int, item: int = 2) -> DataFrame:
    """Writes planes (``t, c, z, pixels``) as one file of ``count`` pages for each ``t``; ``file, pages`` of those written.

    A frame is streamed page by page by the task that has it, to a name of its own that becomes the file's when it is
    whole; one with samples above 16 bits has pages of 32.  A frame of another number of planes is an error and leaves no file.  A task that runs again replaces its files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, inner = pafs.FileSystem.from_uri(folder)
        fs.create_dir(inner)
        rows = ((t, p, h.as_py(), w) for b in batches for t, p, h, w in zip(b.column("t").to_pylist(), b.column("pixels"), b.column("high"), b.column("wide").to_pylist()))
        now = next(rows, None)
        while now is not None:
            t, name, own_item = now[0], f"frame-{now[0]:08d}.tif", 4 if now[3] and item == 2 else item
            part = f"{inner}/.{name}-{uuid.uuid4().hex}"

            def own() -> Iterator[np.ndarray]:
                nonlocal now
                while now is not None and now[0] == t:
                    yield plane_samples(now[1].as_buffer(), now[2]).reshape(height, width)
                    now = next(rows, None)

            try:
                with fs.open_output_stream(part) as out:
                    for piece in tiff.page_stream(own(), count, width, height, item=own_item):
                        out.write(piece)
            except Exception:
                fs.delete_file(part)
                raise
            fs.move(part, f"{inner}/{name}")
            yield pa.record_batch([pa.array([name]), pa.array([count], pa.int32())], names=["file", "pages"])

    rows = with_high(planes).select("t", "c", "z", "pixels", "high").repartition("t")
    dealt = rows.withColumn("wide", F.max(F.col("high").isNotNull()).over(Window.partitionBy("t"))).sortWithinPartitions("t", "c", "z").select("t", "pixels", "high", "wide")
    return dealt.mapInArrow(run, "file string, pages int")
