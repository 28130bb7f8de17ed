"""XML descriptions of exported images: acquisition metadata of page files, and views for multi-resolution viewers."""

from __future__ import annotations

import xml.etree.ElementTree as ElementTree

from ..operators.layout import ome_order
from ..plans.spec import FormatError, anisotropic_levels, level_tile

# The units of multiscale text as page files abbreviate them.
SHORT = {"micrometer": "µm", "nanometer": "nm", "millimeter": "mm", "centimeter": "cm", "meter": "m", "second": "s", "millisecond": "ms", "microsecond": "µs", "minute": "min", "hour": "h"}


def element(name: str, content: str | list = "", /, **attributes: object) -> ElementTree.Element:
    """An element with a text, or with elements in it."""
    out = ElementTree.Element(name, {k: str(v) for k, v in attributes.items()})
    if isinstance(content, str):
        out.text = content or None
    else:
        out.extend(content)
    return out


def text_of(root: ElementTree.Element) -> str:
    return ElementTree.tostring(root, encoding="unicode")


def page_description(sizes: dict[str, int], order: str = "TCZ", bits: int = 16, scale: dict[str, float] | None = None, units: dict[str, str] | None = None, channels: list[str] | None = None) -> str:
    """The metadata of a file of all planes in an order from slowest to fastest; ``scale`` by axis, ``units`` spelt out."""
    units, scale = units or {}, scale or {}
    if unknown := [u for u in units.values() if u not in SHORT]:
        raise FormatError(f"units without a short form: {unknown}")
    if channels and len(channels) != sizes["c"]:
        raise FormatError("a name for each channel is needed")
    keys = {"z": "PhysicalSizeZ", "y": "PhysicalSizeY", "x": "PhysicalSizeX", "t": "TimeIncrement"}
    facts: dict[str, object] = {f"Size{a.upper()}": sizes[a] for a in "xyczt"}
    for a, key in keys.items():
        if a in scale:
            facts[key] = float(scale[a])
            if a in units:
                facts[f"{key}Unit"] = SHORT[units[a]]
    named = [element("Channel", ID=f"Channel:0:{i}", Name=n, SamplesPerPixel=1) for i, n in enumerate(channels or [])]
    planes = element("TiffData", IFD=0, PlaneCount=sizes["t"] * sizes["c"] * sizes["z"])
    pixels = element("Pixels", [*named, planes], ID="Pixels:0", DimensionOrder=ome_order(order), Type=f"uint{bits}", **facts)
    return text_of(element("OME", [element("Image", [pixels], ID="Image:0")], xmlns="http://www.openmicroscopy.org/Schemas/OME/2016-06"))


def view_description(data_file: str, sizes: dict[str, int], voxel: dict[str, float], unit: str = "micrometer", channels: list[str] | None = None) -> str:
    """The description of a multi-resolution file: a setup for each channel, all time points, and the calibration of each view."""
    names = channels or [f"channel {i}" for i in range(sizes["c"])]
    if len(names) != sizes["c"]:
        raise FormatError("a name for each channel is needed")
    if any(v <= 0 for v in voxel.values()):
        raise FormatError("voxel sizes must be positive")

    def listed(values: dict) -> str:
        return " ".join(str(values[a]) for a in "xyz")

    def channel(i: int) -> list[ElementTree.Element]:
        return [element("id", str(i)), element("name", names[i])]

    def setup(i: int) -> ElementTree.Element:
        size = element("voxelSize", [element("unit", unit), element("size", listed(voxel))])
        return element("ViewSetup", [*channel(i), element("size", listed(sizes)), size, element("attributes", [element("channel", str(i))])])

    calibration = " ".join(str(voxel[a]) if i == j else "0" for i, a in enumerate("xyz") for j in range(4))

    def registration(t: int, i: int) -> ElementTree.Element:
        transform = element("ViewTransform", [element("Name", "voxel calibration"), element("affine", calibration)], type="affine")
        return element("ViewRegistration", [transform], timepoint=t, setup=i)

    own = range(sizes["c"])
    setups = element("ViewSetups", [*map(setup, own), element("Attributes", [element("Channel", channel(i)) for i in own], name="channel")])
    loader = element("ImageLoader", [element("hdf5", data_file, type="relative")], format="bdv.hdf5")
    times = element("Timepoints", [element("first", "0"), element("last", str(sizes["t"] - 1))], type="range")
    views = element("ViewRegistrations", [registration(t, i) for t in range(sizes["t"]) for i in own])
    return text_of(element("SpimData", [element("BasePath", ".", type="relative"), element("SequenceDescription", [loader, setups, times]), views], version="0.2"))


def view_levels(sizes: dict[str, int], voxel: dict[str, float], chunk: tuple[int, int, int] = (16, 128, 128)) -> list[dict]:
    """The levels of every setup: factors and cells as x, y, z, and extents as z, y, x."""
    out, before = [], (1, 1, 1)
    for f in anisotropic_levels(tuple(sizes[a] for a in "zyx"), tuple(voxel[a] for a in "zyx")):
        shape = tuple(-(-sizes[a] // k) for a, k in zip("zyx", f))
        tile = level_tile(shape, chunk, tuple(a // b for a, b in zip(f, before)))
        out.append({"level": len(out), "resolution": f[::-1], "cells": tile[::-1], "shape": shape})
        before = f
    return out
