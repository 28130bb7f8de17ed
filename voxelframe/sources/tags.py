"""The tag tree of TIFF files as a table: ``file, page, path, tag, type, bytes``, one row for each tag of each (sub-)image, values little-endian."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..codec import container, tags, tiff

SCHEMA = "file string, page int, path array<int>, tag int, type int, bytes binary"
#: Sample depth, format and meaning are listed as well.
PLACES = frozenset(tags.STRUCTURAL - {tiff.BITS, tiff.FORMAT, tiff.PHOTOMETRIC})


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """Of whole files by ``binaryFile``: metadata is small beside pixels, but a file must fit a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                pages = tiff.read_pages(container.read_bytes(data), len(data))
                rows = [(name, i, list(r.path), r.tag, r.kind, r.value) for i, p in enumerate(pages) for r in tags.of_page(p, i, without=PLACES)]
                if rows:
                    kinds = (pa.string(), pa.int32(), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.binary())
                    yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=["file", "page", "path", "tag", "type", "bytes"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, SCHEMA)
