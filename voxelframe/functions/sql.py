"""The codec as SQL functions: ``spark.sql("select decode_volume(payload) ...")``."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..codec import container
from ..plans.spec import U16, FormatError


def register(spark: SparkSession) -> None:
    """``encode_volume(pixels, x, y, z)``, ``decode_volume(stream)``, ``get_metadata(container)``, ``set_metadata(container, bytes)``
    and ``container_shape(container)``, all over Arrow batches."""

    @F.pandas_udf("binary")
    def encode_volume(pixels: pd.Series, x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        arrays = [np.frombuffer(p, "<u2").reshape(c, b, a) for p, a, b, c in zip(pixels, x, y, z)]
        return pd.Series([data for data, _ in container.encode_volumes(arrays)])

    @F.pandas_udf("binary")
    def decode_volume(streams: pd.Series) -> pd.Series:
        volumes = container.decode_volumes([bytes(s) for s in streams])
        if any(v.max() > U16 for v in volumes):
            raise FormatError("samples exceed 16 bits")
        return pd.Series([v.astype("<u2").tobytes() for v in volumes])

    @F.pandas_udf("binary")
    def get_metadata(data: pd.Series) -> pd.Series:
        return data.map(lambda d: container.get_metadata(bytes(d)))

    @F.pandas_udf("binary")
    def set_metadata(data: pd.Series, metadata: pd.Series) -> pd.Series:
        return pd.Series([container.set_metadata(bytes(d), bytes(m)) for d, m in zip(data, metadata)])

    @F.pandas_udf("struct<kind: string, lossy: boolean, t: long, c: long, z: long, y: long, x: long, units: long>")
    def container_shape(data: pd.Series) -> pd.DataFrame:
        rows = [container.read_index(container.read_bytes(bytes(d)), len(d)) for d in data]
        return pd.DataFrame([(r.kind, r.lossy, r.dims.t, r.dims.c, r.dims.z, r.dims.y, r.dims.x, len(r.units)) for r in rows], columns=["kind", "lossy", "t", "c", "z", "y", "x", "units"])

    for f in (encode_volume, decode_volume, get_metadata, set_metadata, container_shape):
        spark.udf.register(f.__name__ if hasattr(f, "__name__") else f.func.__name__, f)
