"""Incremental encoding: planes arrive as a stream, chunks leave when they are whole."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..codec import container
from ..plans.spec import Calibration, Options

SCHEMA = "t int, c int, z0 int, depth int, payload binary"


def encode_stream(planes: DataFrame, width: int, height: int, depth: int, chunk_depth: int, options: Options = Options(), calibration: Calibration | None = None) -> DataFrame:
    """Chunks of a stream of planes ``t, c, z, pixels``, one state for each (t, c).

    Planes of a volume must come in order of z: one that was seen before, or that skips another, is an error.  The
    state holds the planes of one unfinished chunk.  The last chunk of a volume leaves with plane ``depth`` - 1.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, held = (state.get[0], list(state.get[1])) if state.exists else (0, [])
        out = []
        rows = pd.concat(list(batches)).sort_values("z", kind="stable")
        if "high" in rows and rows["high"].notna().any():
            raise ValueError(f"planes of t={key[0]}, c={key[1]} have samples above 16 bits")
        for z, pixels in zip(rows["z"], rows["pixels"]):
            if z != at or z >= depth:
                raise ValueError(f"plane {z} of t={key[0]}, c={key[1]} came where {at} was due")
            held.append(bytes(pixels))
            at += 1
            if len(held) == chunk_depth or at == depth:
                v = np.frombuffer(b"".join(held), "<u2").reshape(len(held), height, width)
                out.append((*key, at - len(held), len(held), container.encode_volume(v, options, calibration)[0]))
                held = []
        state.update((at, held))
        yield pd.DataFrame(out, columns=["t", "c", "z0", "depth", "payload"])

    return planes.groupBy("t", "c").applyInPandasWithState(run, SCHEMA, "due int, held array<binary>", "append", GroupStateTimeout.NoTimeout)
