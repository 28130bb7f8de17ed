"""Static probability models: normalised rows of integer frequencies and their sparse byte form."""

from __future__ import annotations

import struct

import numpy as np

from ..plans.spec import FormatError


def normalize_row(counts: np.ndarray, total: int) -> np.ndarray:
    """Frequencies that sum to ``total``, at least 1 for each symbol counted; the rule of ``normalize_counts``, for one row."""
    counts = np.asarray(counts)
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), dtype=np.int64)
    if not len(used):
        return out
    if len(used) > total:
        raise FormatError(f"{len(used)} symbols exceed a total of {total}")
    n = [int(x) for x in counts[used]]
    whole = sum(n)
    f = np.array([max(1, x * total // whole) for x in n])
    gap = total - int(f.sum())
    if gap > 0:
        order = sorted(range(len(n)), key=lambda i: (-(n[i] * total % whole), i))
        f += gap // len(n)
        f[order[: gap % len(n)]] += 1
    while gap < 0:
        able = sorted((i for i in range(len(n)) if f[i] > 1), key=lambda i: (-f[i], i))[:-gap]
        f[able] -= 1
        gap += len(able)
    out[used] = f
    return out


#: Holds symbols, frequencies and their sums: none exceeds 2^11.
SMALL = np.int16


class Model:
    """Frequencies of some contexts over one alphabet; contexts never seen have no row."""

    def __init__(self, contexts: int, alphabet: int, scale_bits: int, rows: dict[int, np.ndarray]):
        self.contexts, self.alphabet, self.scale_bits, self.total = contexts, alphabet, scale_bits, 1 << scale_bits
        self.active = np.array(sorted(rows), dtype=np.int64)
        self.freq = np.array([rows[c] for c in self.active], dtype=SMALL).reshape(len(self.active), alphabet)
        self.cum = np.cumsum(self.freq, axis=1, dtype=SMALL) - self.freq
        self.row = np.full(contexts, -1, dtype=np.int64)
        self.row[self.active] = np.arange(len(self.active))

    @classmethod
    def from_counts(cls, contexts: int, alphabet: int, scale_bits: int, ctx: np.ndarray, sym: np.ndarray) -> Model:
        """The model of observed (context, symbol) pairs."""
        pairs, n = np.unique(ctx.astype(np.int64) * alphabet + sym, return_counts=True)
        contexts_of, total = pairs // alphabet, 1 << scale_bits
        if not len(pairs):
            return cls(contexts, alphabet, scale_bits, {})
        starts = np.flatnonzero(np.append(True, contexts_of[1:] != contexts_of[:-1]))
        sizes = np.diff(np.append(starts, len(pairs)))
        row = np.repeat(np.arange(len(starts)), sizes)
        whole = np.add.reduceat(n, starts)[row]
        f = np.maximum(1, n * total // whole)
        gap = total - np.add.reduceat(f, starts)
        # what is left goes to the largest remainders; rows that exceed the total are reduced one by one
        order = np.lexsort((np.arange(len(n)), -(n * total % whole), row))
        rank = np.empty(len(n), dtype=np.int64)
        rank[order] = np.arange(len(n)) - starts[row]
        f += np.where(gap[row] > 0, gap[row] // sizes[row] + (rank < gap[row] % sizes[row]), 0)
        freq = np.zeros((len(starts), alphabet), dtype=SMALL)
        freq[row, pairs % alphabet] = f
        for i in np.flatnonzero(gap < 0):
            counts = np.zeros(alphabet, dtype=np.int64)
            own = slice(starts[i], starts[i] + sizes[i])
            counts[pairs[own] % alphabet] = n[own]
            freq[i] = normalize_row(counts, total)
        return cls(contexts, alphabet, scale_bits, dict(zip(contexts_of[starts].tolist(), freq)))

    def slots(self) -> np.ndarray:
        """The symbol of each slot of each row."""
        return np.repeat(np.tile(np.arange(self.alphabet, dtype=SMALL), len(self.freq)), self.freq.ravel()).reshape(len(self.freq), self.total)

    def dump(self) -> bytes:
        """Header, then index steps, symbol steps and frequencies as varints; the last frequency of a row is implied."""
        head = struct.pack("<IHBB", self.contexts, self.alphabet, self.scale_bits, 0) + varint(len(self.active))
        row, sym = np.nonzero(self.freq)
        if not len(row):
            return head
        first = np.append(True, row[1:] != row[:-1])
        last = np.append(first[1:], True)
        step = np.where(first, sym, sym - np.append(0, sym[:-1]))
        # a row has two numbers before its symbols, a symbol two but for the last, whose frequency is implied
        at = 2 * (row + 1) + np.cumsum(2 - last) - (2 - last)
        numbers = np.zeros(int(at[-1]) + 1, dtype=np.int64)
        numbers[at] = step
        numbers[at[~last] + 1] = self.freq[row, sym][~last]
        numbers[at[first] - 2] = np.diff(self.active, prepend=0)
        numbers[at[first] - 1] = np.bincount(row)
        return head + varints(numbers)

    @classmethod
    def load(cls, data: bytes) -> Model:
        if len(data) < 8:
            raise FormatError("truncated model")
        contexts, alphabet, bits, spare = struct.unpack_from("<IHBB", data)
        if not contexts or not 0 < alphabet <= 511 or not 8 <= bits <= 11 or spare:
            raise FormatError("bad model header")
        numbers = read_varints(data[8:])
        if not len(numbers):
            raise FormatError("truncated model")
        rows: dict[int, np.ndarray] = {}
        ctx, at, plain = 0, 1, numbers.tolist()
        for i in range(plain[0]):
            if at + 2 > len(plain):
                raise FormatError("truncated model")
            step, kinds = plain[at], plain[at + 1]
            if i and not step:
                raise FormatError("contexts must ascend")
            ctx += step
            if ctx >= contexts or not 0 < kinds <= alphabet:
                raise FormatError("model row out of range")
            own = numbers[at + 2 : at + 1 + 2 * kinds]
            at += 1 + 2 * kinds
            if len(own) != 2 * kinds - 1:
                raise FormatError("truncated model")
            steps, f = own[::2], np.append(own[1::2], 0)
            if not steps[1:].all():
                raise FormatError("symbols must ascend")
            symbols = np.cumsum(steps)
            if symbols[-1] >= alphabet:
                raise FormatError("symbol out of range")
            f[-1] = (1 << bits) - f.sum()
            if (f <= 0).any():
                raise FormatError("frequencies must be positive and sum to the scale")
            rows[ctx] = np.zeros(alphabet, dtype=SMALL)
            rows[ctx][symbols] = f
        if at != len(plain):
            raise FormatError("bytes after the model")
        return cls(contexts, alphabet, bits, rows)


def varint(value: int) -> bytes:
    """Base-128, least significant group first, the top bit set while more follow."""
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data):
            raise FormatError("truncated varint")
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if not b & 128:
            if value >> 32 or (not b and shift):
                raise FormatError("varint too large or not canonical")
            return value, at
        shift += 7
        if shift > 28:
            raise FormatError("varint too long")


_SHIFTS = 7 * np.arange(5)


def varints(values: np.ndarray) -> bytes:
    """The varints of numbers below 2^32, one after another."""
    sizes = 1 + (values[:, None] >= 1 << _SHIFTS[1:]).sum(1)
    groups = values[:, None] >> _SHIFTS & 127
    more = np.arange(5) < sizes[:, None] - 1
    return (groups | more * 128).astype(np.uint8)[np.arange(5) < sizes[:, None]].tobytes()


def read_varints(data: bytes) -> np.ndarray:
    """All varints of some bytes."""
    raw = np.frombuffer(data, np.uint8).astype(np.int64)
    ends = np.flatnonzero(raw < 128)
    if not len(raw) or raw[-1] > 127:
        raise FormatError("truncated varint")
    starts = np.append(0, ends[:-1] + 1)
    sizes = ends - starts + 1
    if sizes.max() > 5 or ((raw[ends] == 0) & (sizes > 1)).any():
        raise FormatError("varint too long or not canonical")
    place = np.arange(len(raw)) - np.repeat(starts, sizes)
    values = np.add.reduceat((raw & 127) << 7 * place, starts)
    if (values >> 32).any():
        raise FormatError("varint too large")
    return values
