"""Tags of page files kept in a container's metadata: captured when a stack is encoded, given back when it is written out.

A record has the plane, the path to a sub-image (empty for the page itself), the tag, its type and its value in
little-endian order.  Tags that say how pixels are stored are made anew on writing and are not kept.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

from ..plans.spec import FormatError
from . import tiff

MARK = b"\0voxelframe tags\0"
STRUCTURAL = {tiff.WIDTH, tiff.HEIGHT, tiff.BITS, tiff.FORMAT, tiff.PHOTOMETRIC, tiff.COMPRESSION, tiff.STRIPS, tiff.SAMPLES, tiff.ROWS, tiff.LENGTHS, tiff.PLANAR, tiff.PREDICTOR, tiff.TILE_WIDTH, tiff.TILE_HEIGHT, tiff.TILES, tiff.TILE_LENGTHS, tiff.SUB_IFDS}
#: Bytes of one number of each type; a fraction is two of them.
WIDTHS = {3: 2, 8: 2, 4: 4, 9: 4, 11: 4, 13: 4, 5: 4, 10: 4, 12: 8, 16: 8, 17: 8, 18: 8}
_RECORD = struct.Struct("<IBHHI")


@dataclass(frozen=True)
class Tag:
    plane: int
    path: tuple[int, ...]
    tag: int
    kind: int
    value: bytes


def little(kind: int, value: bytes, order: str) -> bytes:
    """The value of a tag in little-endian order."""
    width = WIDTHS.get(kind, 1)
    return value if order == "<" or width == 1 else np.frombuffer(value, f">u{width}").astype(f"<u{width}").tobytes()


def of_page(page: tiff.Page, plane: int, path: tuple[int, ...] = (), without: frozenset[int] = frozenset(STRUCTURAL)) -> Iterator[Tag]:
    for tag, (kind, raw) in sorted(page.tags.items()):
        if tag not in without:
            yield Tag(plane, path, tag, kind, little(kind, raw, page.order))
    for i, child in enumerate(page.children):
        yield from of_page(child, plane, (*path, i), without)


def dump(tags: Iterable[Tag], limit: int) -> bytes:
    """The record of the tags; more than ``limit`` bytes are an error."""
    out = b"".join(_RECORD.pack(t.plane, len(t.path), t.tag, t.kind, len(t.value)) + struct.pack(f"<{len(t.path)}H", *t.path) + t.value for t in tags)
    if len(MARK) + 8 + len(out) > limit:
        raise FormatError("the tags exceed the limit of metadata")
    return MARK + struct.pack("<II", len(out), zlib.crc32(out)) + out


def load(metadata: bytes) -> tuple[list[Tag], bytes]:
    """The tags of a record and what follows it; metadata without one has none."""
    if not metadata.startswith(MARK):
        return [], metadata
    at = len(MARK) + 8
    if len(metadata) < at:
        raise FormatError("truncated tags")
    size, crc = struct.unpack_from("<II", metadata, len(MARK))
    body, out, i = metadata[at : at + size], [], 0
    if len(body) != size or zlib.crc32(body) != crc:
        raise FormatError("the tags are damaged")
    while i < size:
        plane, depth, tag, kind, n = _RECORD.unpack_from(body, i)
        i += _RECORD.size
        path = struct.unpack_from(f"<{depth}H", body, i)
        i += 2 * depth
        out.append(Tag(plane, path, tag, kind, body[i : i + n]))
        i += n
    return out, metadata[at + size :]
