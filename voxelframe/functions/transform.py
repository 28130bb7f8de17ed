"""Pixel transforms as column expressions: square-root symbols, remainders, calibrated quantisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.spec import U16, Calibration


def q_symbol(v: Column) -> Column:
    """``floor(sqrt(v))``: exact for unsigned 16-bit values."""
    return F.floor(F.sqrt(v)).cast("long")


def remainder(v: Column) -> Column:
    q = q_symbol(v)
    return v - q * q


def rebuild(q: Column, r: Column) -> Column:
    """``q * q + r``; a value beyond 16 bits is an error."""
    v = q * q + r
    return F.when(v <= U16, v).otherwise(F.raise_error(F.concat(F.lit("reconstructed value exceeds 65535: "), v.cast("string"))))


def quantize(v: Column, cal: Calibration) -> Column:
    """``round(2 * sqrt(max((v - offset) * gain, 0)) / step)``, halves away from zero."""
    electrons = F.greatest((v - F.lit(cal.offset)) * F.lit(cal.gain), F.lit(0.0))
    return F.round(2 * F.sqrt(electrons) / F.lit(cal.step)).cast("long")


def reconstruct(q: Column, cal: Calibration) -> Column:
    """``round(offset + (q * step)^2 / 4 / gain)``, clamped to 16 bits."""
    z = q * F.lit(cal.step)
    return F.least(F.greatest(F.round(F.lit(cal.offset) + F.lit(0.25) * z * z / F.lit(cal.gain)), F.lit(0)), F.lit(U16)).cast("long")


def saturate8(v: Column) -> Column:
    """A value as 8 bits: beyond 255 it saturates and never wraps."""
    return F.least(v, F.lit(255))


def median3(a: Column, b: Column, c: Column) -> Column:
    return F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))


def order3(a: Column, b: Column) -> Column:
    """0 if ``a < b``, 1 if equal, 2 if greater."""
    return F.when(a < b, 0).when(a == b, 1).otherwise(2)


def difference5(d: Column) -> Column:
    """The five classes of a difference: 0, 1, more, -1, less."""
    return F.when(d == 0, 0).when(d == 1, 1).when(d > 1, 2).when(d == -1, 3).otherwise(4)


def compact_context(left: Column, up: Column, back: Column, mode: str) -> Column:
    if mode == "mean":
        return left + up + back
    if mode == "meansigns":
        return (left + up + back) * 3 + order3(left, up)
    middle = median3(left, up, back)
    if mode == "signs":
        return (middle * 3 + order3(left, up)) * 3 + order3(back, middle)
    return (middle * 5 + difference5(left - up)) * 5 + difference5(back - middle)


def sink_context(local_z: Column, y: Column, x: Column, left: Column, up: Column, back: Column, alphabet: Column, mode: str) -> Column:
    """The context of a voxel from its neighbours: at x = 0 there is one for all, in the first row it is the left symbol;
    on the first plane of a block the mean modes use ``(left + up) div 2`` for the plane before, the others the left symbol."""
    from ..plans.spec import MODES

    base = alphabet * MODES[mode][1]
    edge = (y == 0) if mode in ("mean", "meansigns") else (y == 0) | (local_z == 0)
    half = F.floor((left + up) / 2).cast("long")
    return F.when(x == 0, base + alphabet).when(edge, base + left).otherwise(compact_context(left, up, F.when(local_z == 0, half).otherwise(back), mode))
