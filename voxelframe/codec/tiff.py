"""Grayscale TIFF pages: classic and big files of either byte order, in strips or tiles, stored, deflated, LZW or PackBits."""

from __future__ import annotations

import bisect
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np

from ..plans.spec import FormatError

# Fixed values of the format: field types with their sizes, and the tags that are read.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, DESCRIPTION, STRIPS, SAMPLES, ROWS, LENGTHS, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 270, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_LENGTHS, SUB_IFDS, FORMAT = 322, 323, 324, 325, 330, 339
STORED, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773


@dataclass
class Page:
    order: str
    tags: dict[int, tuple[int, bytes]] = field(default_factory=dict)
    children: list[Page] = field(default_factory=list)

    def values(self, tag: int, default: list[int] | None = None) -> list[int]:
        if tag not in self.tags:
            if default is None:
                raise FormatError(f"page without tag {tag}")
            return default
        kind, raw = self.tags[tag]
        letter = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 13: "I", 16: "Q", 17: "q", 18: "Q"}.get(kind)
        if not letter:
            raise FormatError(f"tag {tag} is not a whole number")
        return list(struct.unpack(f"{self.order}{len(raw) // SIZES[kind]}{letter}", raw))

    def one(self, tag: int, default: int | None = None) -> int:
        return self.values(tag, None if default is None else [default])[0]

    @property
    def description(self) -> str:
        return self.tags[DESCRIPTION][1].split(b"\0")[0].decode("utf-8", "replace") if DESCRIPTION in self.tags else ""

    @property
    def samples(self) -> int:
        """Samples of a page: one, or several in planes of their own; interleaved samples are an error."""
        n = self.one(SAMPLES, 1)
        if n > 1 and self.one(PLANAR, 1) != 2:
            raise FormatError("interleaved samples are not supported")
        return n

    @property
    def item(self) -> int:
        bits = set(self.values(BITS, [1]))
        if len(bits) != 1 or bits - {8, 16, 32} or set(self.values(FORMAT, [1])) != {1}:
            raise FormatError("samples must be unsigned of 8, 16 or 32 bits")
        return bits.pop() // 8


def read_pages(read, size: int, depth: int = 16) -> list[Page]:
    """All pages with their sub-images; ``read(offset, length)`` gives bytes of the file."""
    head = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if not order or len(head) < 8:
        raise FormatError("not a TIFF file")
    (version,) = struct.unpack_from(order + "H", head, 2)
    if version not in (42, 43):
        raise FormatError("not a TIFF file")
    big = version == 43
    word, step, count = ("Q", 20, "Q") if big else ("I", 12, "H")
    (at,) = struct.unpack_from(order + word, head, 8 if big else 4)
    seen: set[int] = set()

    def directory(at: int, level: int) -> tuple[Page, int]:
        if at in seen or level > depth or not 0 < at < size:
            raise FormatError("directories loop or lie outside the file")
        seen.add(at)
        n_size, w_size = struct.calcsize(count), struct.calcsize(word)
        (n,) = struct.unpack(order + count, read(at, n_size))
        raw = read(at + n_size, n * step + w_size)
        if len(raw) != n * step + w_size:
            raise FormatError("truncated directory")
        page = Page(order)
        for i in range(n):
            tag, kind, many = struct.unpack_from(order + "HH" + word, raw, i * step)
            total = SIZES.get(kind, 0) * many
            if not total:
                continue
            value = raw[i * step + 4 + w_size : i * step + 4 + 2 * w_size]
            if total > w_size:
                (where,) = struct.unpack(order + word, value)
                if where + total > size:
                    raise FormatError("tag outside the file")
                value = read(where, total)
            page.tags[tag] = (kind, value[:total])
        if SUB_IFDS in page.tags:
            page.children = [directory(x, level + 1)[0] for x in page.values(SUB_IFDS)]
        return page, struct.unpack_from(order + word, raw, n * step)[0]

    out = []
    while at:
        page, at = directory(at, 0)
        out.append(page)
    return out


def contiguous_count(page: Page, pages: int, size: int) -> int:
    """Planes behind one directory of an ImageJ stack that is stored in one run, else the number of directories."""
    if pages != 1 or not page.description.startswith("ImageJ=") or page.one(COMPRESSION, 1) != STORED or SAMPLES in page.tags and page.samples > 1:
        return pages
    named = [x.split("=", 1)[1] for x in page.description.splitlines() if x.lower().startswith("images=")]
    n = int(named[0]) if named and named[0].strip().isdigit() else 1
    plane = page.one(WIDTH) * page.one(HEIGHT) * page.item
    if n > 1 and page.values(STRIPS)[0] + n * plane > size:
        raise FormatError("the stack is shorter than its description says")
    return max(n, 1)


def _unpackbits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 2
    return bytes(out)


def _unlzw(data: bytes) -> bytes:
    bits = int.from_bytes(data, "big")
    left, width, out, table, last = len(data) * 8, 9, bytearray(), [], b""
    while left >= width:
        left -= width
        code = (bits >> left) & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        word = table[code] if code < len(table) else last + last[:1]
        out += word
        if last:
            table.append(last + word[:1])
        last = word
        width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
    return bytes(out)


def _expand(data: bytes, how: int) -> bytes:
    if how == STORED:
        return data
    if how in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(data)
    if how == PACKBITS:
        return _unpackbits(data)
    if how == LZW:
        return _unlzw(data)
    raise FormatError(f"compression {how} is not supported")


def read_plane(read, page: Page, sample: int = 0, skip: int = 0) -> np.ndarray:
    """One sample plane of a page as 16-bit values, or of 32 bits if its samples are; ``skip`` planes on in a contiguous stack."""
    w, h, item, how = page.one(WIDTH), page.one(HEIGHT), page.item, page.one(COMPRESSION, 1)
    kind, wide = np.dtype(f"{page.order}u{item}"), np.dtype(f"u{max(item, 2)}")
    if skip:
        return np.frombuffer(read(page.values(STRIPS)[0] + skip * w * h * item, w * h * item), kind).reshape(h, w).astype(wide)
    tiled = TILES in page.tags
    tw, th = (page.one(TILE_WIDTH), page.one(TILE_HEIGHT)) if tiled else (w, min(h, page.one(ROWS, h)))
    across, down = -(-w // tw), -(-h // th)
    offsets, lengths = (page.values(TILES), page.values(TILE_LENGTHS)) if tiled else (page.values(STRIPS), page.values(LENGTHS))
    if sample >= page.samples or len(offsets) != len(lengths) or len(offsets) < across * down * page.samples:
        raise FormatError("the page lacks strips or tiles")
    out = np.zeros((h, w), dtype=wide)
    for k in range(across * down):
        at = sample * across * down + k
        y, x = k // across * th, k % across * tw
        rows = th if tiled else min(th, h - y)
        data = _expand(read(offsets[at], lengths[at]), how)
        if len(data) < rows * tw * item:
            raise FormatError("truncated strip or tile")
        part = np.frombuffer(data, kind, rows * tw).reshape(rows, tw)
        if page.one(PREDICTOR, 1) == 2:
            part = np.cumsum(part, axis=1, dtype=part.dtype.newbyteorder("="))
        out[y : y + th, x : x + tw] = part[: h - y, : w - x]
    return out


def page_stream(planes, count: int, width: int, height: int, description: str = "", item: int = 2, big: bool | None = None, extra: dict[int, list[tuple[int, int, bytes]]] | None = None):
    """The bytes of a little-endian file of ``count`` stored pages, one page at a time; 8-bit pages saturate at 255.

    ``extra`` has further tags of pages: number, type and value.  All pages have one size but for these and the
    description, so the place of every directory is known before its page is.  A file that a classic one's 32-bit
    offsets cannot reach becomes a big one, as does any with ``big``.
    """
    extra = extra or {}
    text = description.encode() + b"\0"
    size = width * height * item
    stored = size + size % 2

    def directory_bytes(large: bool, i: int) -> int:
        entries = 10 + (i == 0)  # the first page has the description
        return 8 + entries * 20 + 8 if large else 2 + entries * 12 + 4

    def added(large: bool, i: int) -> int:
        """Bytes that further tags add to a page: their entries, and values that do not fit these."""
        return sum((20 if large else 12) + (len(v) + len(v) % 2 if len(v) > (8 if large else 4) else 0) for *_, v in extra.get(i, ()))

    # what further tags add before each page that has some
    marks = sorted(extra)
    sums = {large: np.cumsum([0, *(added(large, i) for i in marks)]) for large in (False, True)}

    def place(large: bool, i: int) -> int:
        """Where a page begins; its directory follows its pixels, and the values of further tags that."""
        start = (16 if large else 8) + len(text) + len(text) % 2
        first = directory_bytes(large, 0) - directory_bytes(large, 1) if i else 0
        return start + i * (stored + directory_bytes(large, 1)) + first + int(sums[large][bisect.bisect_left(marks, i)])

    big = place(False, count) >= 1 << 32 if big is None else big
    if not big and place(False, count) >= 1 << 32:
        raise FormatError("classic files end at 4 GiB")
    word, number, head = ("<Q", "<Q", 16) if big else ("<I", "<H", 8)
    first = place(big, 0) + stored if count else 0
    yield (struct.pack("<2sHHHQ", b"II", 43, 8, 0, first) if big else struct.pack("<2sHI", b"II", 42, first)) + text + b"\0" * (len(text) % 2)
    inline = struct.calcsize(word)

    def entry(tag: int, kind: int, many: int, value: int) -> bytes:
        return struct.pack("<HH", tag, kind) + struct.pack(word, many) + struct.pack(word, value)

    written = 0
    for plane in planes:
        if written == count:
            raise FormatError(f"more than {count} pages")
        pixels = np.minimum(np.asarray(plane, dtype=np.int64), (1 << 8 * item) - 1).astype(f"<u{item}").tobytes()
        if len(pixels) != size:
            raise FormatError(f"page {written} is not {width} x {height}")
        at, long = place(big, written), 16 if big else 4
        tags = [(WIDTH, 4, 1, width), (HEIGHT, 4, 1, height), (BITS, 3, 1, 8 * item), (COMPRESSION, 3, 1, STORED), (PHOTOMETRIC, 3, 1, 1)]
        tags += [(DESCRIPTION, 2, len(text), int.from_bytes(text.ljust(inline, b"\0"), "little") if len(text) <= inline else head)] if not written else []
        tags += [(STRIPS, long, 1, at), (SAMPLES, 3, 1, 1), (ROWS, 4, 1, height), (LENGTHS, long, 1, size), (FORMAT, 3, 1, 1)]
        values, behind = b"", at + stored + directory_bytes(big, written) + (20 if big else 12) * len(extra.get(written, ()))
        for tag, kind, value in extra.get(written, ()):
            many = len(value) // SIZES[kind]
            if len(value) <= inline:
                tags.append((tag, kind, many, int.from_bytes(value.ljust(inline, b"\0"), "little")))
            else:
                tags.append((tag, kind, many, behind + len(values)))
                values += value + b"\0" * (len(value) % 2)
        written += 1
        following = place(big, written) + stored if written < count else 0
        yield pixels + b"\0" * (size % 2) + struct.pack(number, len(tags)) + b"".join(entry(*t) for t in sorted(tags)) + struct.pack(word, following) + values
    if written != count:
        raise FormatError(f"{written} of {count} pages")


def write_pages(planes, width: int, height: int, description: str = "", item: int = 2, big: bool | None = None) -> bytes:
    """The file of ``page_stream`` in memory."""
    planes = list(planes)
    return b"".join(page_stream(planes, len(planes), width, height, description, item, big))
