"""Acquisition metadata in XML: which plane each directory of a file holds, and the physical scale."""

from __future__ import annotations

import os
import xml.etree.ElementTree as ElementTree
from dataclasses import dataclass

from ..plans.spec import FormatError
from .text import MICROMETRES


@dataclass
class Layout:
    """T, C, Z of a file, the page order (slowest first), and the plane of each directory where that is listed."""

    t: int
    c: int
    z: int
    order: str
    planes: list[tuple[int, int, int]] | None = None
    scale: dict[str, float] | None = None


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _whole(e: ElementTree.Element, name: str, default: int | None = None) -> int:
    text = e.get(name)
    if text is None:
        if default is None:
            raise FormatError(f"{_local(e)} lacks {name}")
        return default
    if not text.isdigit():
        raise FormatError(f"{name} is not a whole number: {text!r}")
    return int(text)


def _here(entry: ElementTree.Element, root: str | None, path: str) -> bool:
    """Whether an entry means the file at ``path``: one that names none does, as do those that name its identifier or its place.

    A file name counts from the folder of the file, so that a file of the same name elsewhere is another one.  An
    entry that names more than one file, or one by nothing that can be compared, is an error.
    """
    names = [x for x in entry if _local(x) == "UUID"]
    if len(names) > 1:
        raise FormatError("an entry names more than one file")
    if not names:
        return True
    theirs, ours = ((x or "").strip().casefold() for x in (names[0].text, root))
    if theirs and ours:
        return theirs == ours
    place = names[0].get("FileName")
    if not place:
        raise FormatError("an entry names its file by nothing that can be compared")
    return os.path.realpath(os.path.join(os.path.dirname(path), place)) == os.path.realpath(path)


def parse(text: str, width: int, height: int, pages: int, path: str = "") -> Layout | None:
    """The layout of a description, or None if it is none of this kind; what is unclear or contradictory is an error.

    A file may hold a part of an acquisition: its planes must make a full rectangle, whose origin becomes (0, 0, 0).
    """
    if "<OME" not in text and ":OME" not in text:
        return None
    try:
        root = ElementTree.fromstring(text)
    except ElementTree.ParseError as e:
        raise FormatError(f"bad XML: {e}") from e
    if _local(root) != "OME":
        return None
    images = [x for x in root if _local(x) == "Image"]
    found = [x for x in images[0] if _local(x) == "Pixels"] if len(images) == 1 else []
    if not found:
        raise FormatError("one image with pixels is needed")
    px = found[0]
    sizes = {a.lower(): _whole(px, f"Size{a}") for a in "XYZCT"}
    if (sizes["x"], sizes["y"]) != (width, height) or 0 in sizes.values():
        raise FormatError(f"pages of {width} x {height} do not fit {sizes}")
    axes = (px.get("DimensionOrder") or "").upper()
    if not axes.startswith("XY") or sorted(axes[2:]) != ["C", "T", "Z"]:
        raise FormatError(f"unknown order {axes!r}")
    fast = axes[2:].lower()
    total = sizes["z"] * sizes["c"] * sizes["t"]
    entries = [x for x in px if _local(x) == "TiffData"]
    listed = len(entries) > 1 or any(x.attrib or any(_local(y) == "UUID" for y in x) for x in entries)
    scale = {a: float(px.get(f"PhysicalSize{a.upper()}")) * MICROMETRES.get(px.get(f"PhysicalSize{a.upper()}Unit", "um").lower(), 1.0) for a in "zyx" if px.get(f"PhysicalSize{a.upper()}")}
    if not listed:
        if total != pages:
            raise FormatError(f"{total} planes are described, the file has {pages}")
        return Layout(sizes["t"], sizes["c"], sizes["z"], fast[::-1].upper(), None, scale)

    def at(n: int) -> tuple[int, int, int]:
        where = {}
        for a in fast:
            n, where[a] = divmod(n, sizes[a])
        return where["t"], where["c"], where["z"]

    planes: dict[int, tuple[int, int, int]] = {}
    for x in entries:
        if not _here(x, root.get("UUID"), path):
            continue
        ifd = _whole(x, "IFD", 0)
        first = {a: _whole(x, f"First{a.upper()}", 0) for a in fast}
        count = _whole(x, "PlaneCount", 1 if x.get("IFD") is not None else pages)
        start, step = 0, 1
        for a in fast:
            start, step = start + first[a] * step, step * sizes[a]
        if any(first[a] >= sizes[a] for a in fast) or ifd + count > pages or start + count > total:
            raise FormatError("an entry lies outside the file or the pixels")
        for k in range(count):
            if ifd + k in planes:
                raise FormatError(f"directory {ifd + k} is named twice")
            planes[ifd + k] = at(start + k)
    if len(planes) != pages:
        raise FormatError("the entries do not cover every directory")
    if len(set(planes.values())) != pages:
        raise FormatError("a plane is named twice")
    low, high = [min(p[i] for p in planes.values()) for i in range(3)], [max(p[i] for p in planes.values()) for i in range(3)]
    t, c, z = (b - a + 1 for a, b in zip(low, high))
    if t * c * z != pages:
        raise FormatError("the planes do not make a full rectangle")
    moved = [tuple(v - a for v, a in zip(planes[i], low)) for i in range(pages)]
    return Layout(t, c, z, fast[::-1].upper(), moved, scale)
