"""Shapes, coder options and planners: what is decided on the driver before any data is read."""

from __future__ import annotations

import math
from dataclasses import dataclass

U16, U32 = 65535, (1 << 32) - 1
AXES = "tczyx"
#: Fixed values of the format: context modes with the multiple of the alphabet that their compact contexts take.
MODES = {"signed3": (0, 25), "signs": (1, 9), "mean": (2, 3), "meansigns": (3, 9)}
DEFAULT_BLOCK_DEPTH, DEFAULT_SCALE_BITS = 4, 10


class FormatError(ValueError):
    """Bytes, shapes or options that the format does not allow."""


@dataclass(frozen=True)
class Dims:
    """A five-dimensional extent; storage order is T, C, Z, Y, X with X fastest."""

    x: int
    y: int
    z: int
    c: int = 1
    t: int = 1

    def __post_init__(self):
        for n in (self.x, self.y, self.z, self.c, self.t):
            if not 0 < n <= U32:
                raise FormatError(f"extents must lie in 1..{U32}: {self}")
        if self.voxels * 2 >= 1 << 63:
            raise FormatError("the dataset is too large")

    @property
    def plane(self) -> int:
        return self.x * self.y

    @property
    def volume(self) -> int:
        return self.plane * self.z

    @property
    def voxels(self) -> int:
        return self.volume * self.c * self.t

    @property
    def raw_bytes(self) -> int:
        return 2 * self.voxels


@dataclass(frozen=True)
class Options:
    """Coder options; a block depth or scale of 0 stands for the default."""

    block_depth: int = DEFAULT_BLOCK_DEPTH
    mode: str = "mean"
    scale_bits: int = DEFAULT_SCALE_BITS

    def __post_init__(self):
        if self.mode not in MODES:
            raise FormatError(f"context mode must be one of {', '.join(MODES)}")
        if not 0 <= self.block_depth <= U32:
            raise FormatError("block depth out of range")
        object.__setattr__(self, "block_depth", self.block_depth or DEFAULT_BLOCK_DEPTH)
        object.__setattr__(self, "scale_bits", self.scale_bits or DEFAULT_SCALE_BITS)
        if not 8 <= self.scale_bits <= 11:
            raise FormatError("scale bits must lie in 8..11")


@dataclass(frozen=True)
class Calibration:
    """Camera calibration of the lossy mode."""

    offset: float = 0.0
    gain: float = 1.0
    step: float = 2.0

    def __post_init__(self):
        if not all(map(math.isfinite, (self.offset, self.gain, self.step))) or self.gain <= 0 or self.step <= 0:
            raise FormatError("offset must be finite, gain and noise step finite and positive")


def context_count(alphabet: int, mode: str) -> int:
    return MODES[mode][1] * alphabet + alphabet + 1


def reciprocal_gain(gain: float) -> float:
    out = 1.0 / gain if gain else math.inf
    if not math.isfinite(out) or out <= 0:
        raise FormatError("gain must have a finite positive reciprocal")
    return out


def check_axes(axes: str, rank: int | None = None) -> str:
    """Axes of an array: a unique subset of ``tczyx`` with both ``y`` and ``x``."""
    if len(set(axes)) != len(axes) or not set(axes) <= set(AXES) or not {"y", "x"} <= set(axes) or not 2 <= len(axes) <= 5:
        raise FormatError(f"axes must be a unique subset of {AXES} with y and x: {axes!r}")
    if rank is not None and rank != len(axes):
        raise FormatError(f"{len(axes)} axes for {rank} dimensions")
    return axes


def default_axes(rank: int) -> str:
    if not 2 <= rank <= 5:
        raise FormatError("arrays have two to five dimensions")
    return AXES[-rank:]


def canonical_shape(shape: tuple[int, ...], axes: str) -> Dims:
    """The extents by axis, 1 for axes that the array lacks."""
    check_axes(axes, len(shape))
    own = dict(zip(axes, shape))
    return Dims(*(own.get(a, 1) for a in "xyzct"))


def check_page_order(order: str) -> str:
    if sorted(order.upper()) != ["C", "T", "Z"]:
        raise FormatError(f"page order must be a permutation of TCZ: {order!r}")
    return order.upper()


def resolve_dims(pages: int, override: dict[str, int | None], inferred: dict[str, int | None]) -> dict[str, int]:
    """T, C and Z of a stack of pages: overrides, then what the file says, then one left-over axis (Z first) takes the rest."""
    out = {a: override.get(a) or inferred.get(a) for a in "tcz"}
    known = math.prod(v for v in out.values() if v)
    for a in "zct":
        if out[a] is None:
            if pages % known:
                raise FormatError(f"{pages} pages do not divide by {known}")
            out[a], known = pages // known, pages
    if math.prod(out.values()) != pages:
        raise FormatError(f"{out} does not make {pages} pages")
    return out


def default_chunks(shape: tuple[int, ...], axes: str, side: int = 512, item: int = 2, limit: int = 8 << 20) -> tuple[int, ...]:
    """Chunks of at most 4 planes and ``side`` pixels (512 in chunk stores, 1024 in files of filtered chunks), one T and C.

    The largest extent, the first of equals, is halved until a chunk fits ``limit`` bytes.
    """
    most = {"z": 4, "y": side, "x": side}
    out = [min(max(1, n), most.get(a, 1)) for n, a in zip(shape, axes)]
    while math.prod(out) * item > max(item, limit):
        widest = out.index(max(out))
        out[widest] = -(-out[widest] // 2)
    return tuple(out)


def stream_depth(dims: Dims, memory: int, block_depth: int) -> int:
    """Planes of a streamed chunk: a quarter of the memory, in whole blocks where it holds one."""
    depth = max(1, min(dims.z, memory // 4 // (2 * dims.plane)))
    return depth - depth % block_depth if depth > block_depth else depth


def pipeline_slots(dims: Dims, depth: int, memory: int, most: int = 8) -> int:
    """Chunks in flight where each needs four times its raw size."""
    return max(1, min(most, memory // max(1, 4 * depth * dims.plane * 2)))


def anisotropic_levels(shape: tuple[int, int, int], voxel: tuple[float, float, float], small: int = 256) -> list[tuple[int, int, int]]:
    """Downsampling factors (z, y, x) of a pyramid: the finest axes double until no extent exceeds ``small``."""
    levels = [(1, 1, 1)]

    def left(f: tuple[int, int, int]) -> list[int]:
        return [-(-n // k) for n, k in zip(shape, f)]

    while max(left(levels[-1])) > small:
        now = levels[-1]
        spacing = [v * k if n > 1 else math.inf for v, k, n in zip(voxel, now, left(now))]
        reach = 2 * min(spacing)
        levels.append(tuple(k * (2 if s <= reach and s < math.inf else 1) for k, s in zip(now, spacing)))
    return levels


def check_levels(factors: list[tuple[int, int, int]]) -> None:
    """Levels start at full resolution and each is a whole multiple of the one before, larger in some axis."""
    if not factors or tuple(factors[0]) != (1, 1, 1):
        raise FormatError("the first level must be (1, 1, 1)")
    for a, b in zip(factors, factors[1:]):
        if any(q % p for p, q in zip(a, b)) or all(p == q for p, q in zip(a, b)):
            raise FormatError(f"level {b} does not follow {a}")


def level_tile(shape: tuple[int, int, int], chunk: tuple[int, int, int], ratio: tuple[int, int, int], limit: int = 16 << 20) -> tuple[int, int, int]:
    """The chunk of a level, halved in the side whose source is largest until the 16-bit tile that it is made from fits ``limit``."""
    out = [min(n, c) for n, c in zip(shape, chunk)]
    while 2 * math.prod(c * r for c, r in zip(out, ratio)) > limit:
        sources = [(c * r if c > 1 else 0) for c, r in zip(out, ratio)]
        if not any(sources):
            raise FormatError("the step between two levels is too large for one tile")
        out[sources.index(max(sources))] = -(-out[sources.index(max(sources))] // 2)
    return tuple(out)
