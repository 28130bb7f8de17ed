"""The entropy coder: four interleaved byte-rANS states for each block, many blocks in lock step.

A block is serial: its contexts and states depend on the voxels before.  Blocks
are independent, so the same step of all blocks of one shape is one vector
operation; the cost of a step is nearly that of one block.  Where the contexts
are known before (all symbols in encoding, remainders in decoding) the states of
a block take a step together: none needs another, and the bytes that they give
or take have an order that follows from their counts.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np

from ..plans.spec import MODES, FormatError
from .model import Model

LANES, LOWER = 4, 1 << 23
#: With fewer blocks a step of plain integers is cheaper than one of vectors.
FEW = 12
#: Voxels of each block whose frequencies are looked up at once.
STEPS = 4096


def block_contexts(q: np.ndarray, mode: str, alphabet: int | np.ndarray) -> np.ndarray:
    """Contexts of all voxels of blocks ``q`` (block, z, y, x)."""
    q = q.astype(np.int64)
    a = np.asarray(alphabet, dtype=np.int64).reshape(-1, 1, 1, 1)
    base = MODES[mode][1] * a
    left, up, back = np.zeros_like(q), np.zeros_like(q), np.zeros_like(q)
    left[..., 1:] = q[..., :-1]
    up[:, :, 1:] = q[:, :, :-1]
    back[:, 1:] = q[:, :-1]
    back[:, 0] = (left[:, 0] + up[:, 0]) // 2
    ctx = _compact(left, up, back, mode)
    edge = base + left
    ctx[:, :, 0] = edge[:, :, 0]
    if not mode.startswith("mean"):
        ctx[:, 0] = edge[:, 0]
    ctx[..., 0] = (base + a)[..., 0]
    return ctx


def _compact(l: np.ndarray, u: np.ndarray, p: np.ndarray, mode: str) -> np.ndarray:
    if mode == "mean":
        return l + u + p
    three = lambda a, b: 1 + np.sign(a - b)
    if mode == "meansigns":
        return (l + u + p) * 3 + three(l, u)
    m = np.maximum(np.minimum(l, u), np.minimum(np.maximum(l, u), p))
    if mode == "signs":
        return (m * 3 + three(l, u)) * 3 + three(p, m)
    five = lambda d: np.where(d > 1, 2, np.where(d < -1, 4, np.where(d == -1, 3, d)))
    return (m * 5 + five(l - u)) * 5 + five(p - m)


class Tables:
    """The models of several blocks, one after another; ``which`` names the model of each block."""

    def __init__(self, models: list[Model], which: np.ndarray):
        self.bits = models[0].scale_bits
        self.mask = (1 << self.bits) - 1
        width = max(m.alphabet for m in models)
        pad = lambda x: np.pad(x, ((0, 0), (0, width - x.shape[1])))
        self.freq = np.concatenate([pad(m.freq) for m in models])
        self.cum = np.concatenate([pad(m.cum) for m in models])
        first = np.cumsum([0, *(len(m.freq) for m in models[:-1])])
        longest = max(m.contexts for m in models)
        self.rows = np.full((len(models), longest), -1, dtype=np.int64)
        for i, m in enumerate(models):
            self.rows[i, : m.contexts] = np.where(m.row >= 0, m.row + first[i], -1)
        self.which, self.models = np.asarray(which), models
        self._slots: np.ndarray | None = None

    def entries(self, blocks: np.ndarray, ctx: np.ndarray, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Frequency and start of symbols in their contexts."""
        at = self.row(blocks, ctx) * self.freq.shape[1] + sym
        freq = self.freq.ravel()[at]
        if not freq.all():
            raise FormatError("symbol that the model lacks")
        return freq, self.cum.ravel()[at]

    def row(self, blocks: np.ndarray, ctx: np.ndarray) -> np.ndarray:
        out = self.rows[self.which[blocks], ctx]
        if (out < 0).any():
            raise FormatError("symbol in a context that the model lacks")
        return out

    @cached_property
    def flat_slots(self) -> np.ndarray:
        return self.slots.ravel()

    @cached_property
    def flat_freq(self) -> np.ndarray:
        return self.freq.ravel()

    @cached_property
    def flat_cum(self) -> np.ndarray:
        return self.cum.ravel()

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.concatenate([m.slots() for m in self.models])
        return self._slots


class Writer:
    """States and byte stacks of blocks; symbols come last first."""

    def __init__(self, blocks: int):
        self.state = np.full((blocks, LANES), LOWER, dtype=np.int64)
        self.parts: list[list[bytes]] = [[] for _ in range(blocks)]

    def push(self, freq: np.ndarray, cum: np.ndarray, bits: int) -> None:
        """Steps (step, block, lane) of all states, first to last; a symbol of the whole range changes nothing."""
        steps, blocks, _ = freq.shape
        given = np.zeros((steps, blocks, LANES, 2), dtype=np.uint8)
        count = np.zeros((steps, blocks, LANES), dtype=np.uint8)
        x = self.state
        for i in range(steps):
            f = freq[i]
            limit = f << (31 - bits)
            for k in range(2):  # a state of 31 bits gives two bytes at most
                out = x >= limit
                if not out.any():
                    break
                given[i, :, :, k] = x & 255
                count[i] += out
                x = np.where(out, x >> 8, x)
            high = x // f
            x = (high << bits) + (x - high * f) + cum[i]
        self.state = x
        # by block, then in the order of the steps, the last lane first
        order = lambda a: a[:, :, ::-1].swapaxes(0, 1)
        mask = order(count)[..., None] > np.arange(2)
        flat, ends = order(given)[mask].tobytes(), np.cumsum(mask.reshape(blocks, -1).sum(1))
        for own, a, b in zip(self.parts, [0, *ends], ends):
            own.append(flat[a:b])

    def stacks(self) -> list[bytes]:
        return [b"".join(p) for p in self.parts]


class Reader:
    def __init__(self, states: np.ndarray, stacks: list[bytes]):
        self.state = np.array(states, dtype=np.int64)
        self.left = np.array([len(s) for s in stacks], dtype=np.int64)
        self.bytes = np.zeros((len(stacks), max(1, int(self.left.max(initial=0)))), dtype=np.uint8)
        for i, s in enumerate(stacks):
            self.bytes[i, : len(s)] = np.frombuffer(s, np.uint8)
        self.flat, self.base = self.bytes.ravel(), np.arange(len(stacks)) * self.bytes.shape[1]

    def pop(self, lane: int, t: Tables, row: np.ndarray) -> np.ndarray:
        """The next symbol of all blocks, in one lane."""
        x = self.state[:, lane]
        slot = x & t.mask
        sym = np.take(t.flat_slots, (row << t.bits) + slot)
        at = row * t.freq.shape[1] + sym
        x = np.take(t.flat_freq, at) * (x >> t.bits) + slot - np.take(t.flat_cum, at)
        for _ in range(2):
            need = x < LOWER
            if not need.any():
                break
            self.left -= need
            if (self.left < 0).any():
                raise FormatError("truncated byte stack")
            x = np.where(need, (x << 8) | np.take(self.flat, self.base + self.left), x)
        self.state[:, lane] = x
        return sym

    def pop_lanes(self, t: Tables, row: np.ndarray, here: np.ndarray) -> np.ndarray:
        """The next symbols (block, lane) of all states, where ``here``; their bytes come in the order of the lanes."""
        x = self.state
        slot = x & t.mask
        sym = np.take(t.flat_slots, (row << t.bits) + slot)
        at = row * t.freq.shape[1] + sym
        y = np.take(t.flat_freq, at) * (x >> t.bits) + slot - np.take(t.flat_cum, at)
        y = np.where(here, y, x)
        need = (y < LOWER).astype(np.int64) + (y < LOWER >> 8)
        if need.any():
            top = self.left[:, None] - np.cumsum(need, axis=1) + need - 1  # of each lane's first byte
            self.left = self.left - need.sum(1)
            if (self.left < 0).any():
                raise FormatError("truncated byte stack")
            for k in range(2):
                y = np.where(need > k, (y << 8) | np.take(self.flat, self.base[:, None] + np.maximum(top - k, 0)), y)
        self.state = y
        return np.where(here, sym, 0)

    def check_empty(self) -> None:
        if self.left.any() or (self.state != LOWER).any():
            raise FormatError("bytes left in the stack")


def encode(q: np.ndarray, r: np.ndarray | None, mode: str, alphabets: np.ndarray, q_tables: Tables, r_tables: Tables | None) -> tuple[Writer, Writer | None]:
    """Encodes blocks ``q`` (block, z, y, x) and their remainders, last voxel first."""
    ctx = block_contexts(q, mode, alphabets).reshape(len(q), -1)
    q2, r2 = q.reshape(len(q), -1), r.reshape(len(q), -1) if r is not None else None
    if LANES * len(q) < FEW:
        return _encode_few(q2, r2, ctx, q_tables, r_tables)
    streams = [(Writer(len(q)), q_tables, ctx, q2)] + ([(Writer(len(q)), r_tables, q2, r2)] if r is not None else [])
    blocks, n = np.arange(len(q))[:, None], q2.shape[1]
    for a in range((n - 1) // STEPS * STEPS, -1, -STEPS):  # some voxels at a time, the last first
        for second, (out, t, contexts, symbols) in enumerate(streams):
            c, s = contexts[:, a : a + STEPS].astype(np.int64), symbols[:, a : a + STEPS].astype(np.int64)
            freq, cum = np.full((len(q), STEPS), 1 << t.bits, dtype=np.int64), np.zeros((len(q), STEPS), dtype=np.int64)
            # a zero has no remainder
            own = np.nonzero(c) if second else np.nonzero(np.ones(c.shape, dtype=bool))
            freq[own], cum[own] = t.entries(np.broadcast_to(blocks, c.shape)[own], c[own], s[own])
            shaped = lambda v: np.ascontiguousarray(v.reshape(len(q), -1, LANES).swapaxes(0, 1)[::-1])
            out.push(shaped(freq), shaped(cum), t.bits)
    return streams[0][0], streams[1][0] if r is not None else None


def decode(shape: tuple[int, int, int], mode: str, alphabets: np.ndarray, q_tables: Tables, q_reader: Reader, r_tables: Tables | None = None, r_reader: Reader | None = None) -> np.ndarray:
    """The voxels of blocks of one shape: ``q``, or ``q * q + r`` with remainders."""
    depth, ny, nx = shape
    n, plane = depth * ny * nx, ny * nx
    blocks = len(alphabets)
    every, a = np.arange(blocks), np.asarray(alphabets, dtype=np.int64)
    base = MODES[mode][1] * a
    if blocks < FEW:
        got = [_decode_one(shape, mode, int(a[i]), i, q_tables, q_reader, r_tables, r_reader) for i in range(blocks)]
        return np.array(got, dtype=np.int64).reshape(blocks, *shape)
    q = np.zeros((n, blocks), dtype=np.int64)
    for i in range(n):
        x, y, z = i % nx, i // nx % ny, i // plane
        if x == 0:
            ctx = base + a
        elif y == 0 or (z == 0 and not mode.startswith("mean")):
            ctx = base + q[i - 1]
        else:
            l, u = q[i - 1], q[i - nx]
            ctx = _compact(l, u, q[i - plane] if z else (l + u) // 2, mode)
        q[i] = q_reader.pop(i % LANES, q_tables, q_tables.row(every, ctx))
    q_reader.check_empty()
    if r_reader is None:
        return q.T.reshape(blocks, *shape)
    v, lanes = q * q, every[:, None]
    for i in range(0, n, LANES):
        own = q[i : i + LANES].T
        if own.any():
            if own.shape[1] < LANES:
                own = np.pad(own, ((0, 0), (0, LANES - own.shape[1])))
            here = own > 0
            row = np.zeros(own.shape, dtype=np.int64)
            row[here] = r_tables.row(np.broadcast_to(lanes, own.shape)[here], own[here])
            v[i : i + LANES] += r_reader.pop_lanes(r_tables, row, here).T[: n - i]
    r_reader.check_empty()
    if (v > 65535).any():
        raise FormatError("reconstructed value exceeds 65535")
    return v.T.reshape(blocks, *shape)


def _encode_few(q: np.ndarray, r: np.ndarray | None, ctx: np.ndarray, q_tables: Tables, r_tables: Tables | None) -> tuple[Writer, Writer | None]:
    """The same, block after block with plain integers."""
    streams = [(q_tables, ctx, q, Writer(len(q)))] + ([(r_tables, q, r, Writer(len(q)))] if r is not None else [])
    for second, (t, contexts, symbols, out) in enumerate(streams):
        freq, cum, width, shift, bits = t.freq.ravel().tolist(), t.cum.ravel().tolist(), t.freq.shape[1], 31 - t.bits, t.bits
        for b in range(len(q)):
            at = (t.row(np.full(symbols.shape[1], b), contexts[b].astype(np.int64)) * width + symbols[b]).tolist()
            skip = (q[b] == 0).tolist() if second else None
            state, stack = [LOWER] * LANES, bytearray()
            for i in range(len(at) - 1, -1, -1):
                if skip and skip[i]:
                    continue
                f, x = freq[at[i]], state[i % LANES]
                if not f:
                    raise FormatError("symbol that the model lacks")
                limit = f << shift
                while x >= limit:
                    stack.append(x & 255)
                    x >>= 8
                state[i % LANES] = ((x // f) << bits) + x % f + cum[at[i]]
            out.state[b] = state
            out.parts[b].append(bytes(stack))
    return streams[0][3], streams[1][3] if r is not None else None


def _popper(t: Tables, reader: Reader, block: int):
    """A function that decodes the next symbol of one block in a lane and context, and one that checks the end."""
    rows, width, total = t.rows[t.which[block]].tolist(), t.freq.shape[1], 1 << t.bits
    slots, freq, cum, mask, bits = t.slots.ravel().tolist() if t.slots.size < 1 << 22 else t.slots.ravel(), t.freq.ravel().tolist(), t.cum.ravel().tolist(), t.mask, t.bits
    state, stack = [int(x) for x in reader.state[block]], bytearray(reader.bytes[block, : reader.left[block]].tobytes())

    def pop(lane: int, ctx: int) -> int:
        row = rows[ctx]
        if row < 0:
            raise FormatError("symbol in a context that the model lacks")
        x = state[lane]
        slot = x & mask
        sym = int(slots[row * total + slot])
        k = row * width + sym
        x = freq[k] * (x >> bits) + slot - cum[k]
        while x < LOWER:
            if not stack:
                raise FormatError("truncated byte stack")
            x = (x << 8) | stack.pop()
        state[lane] = x
        return sym

    def check() -> None:
        if stack or state != [LOWER] * LANES:
            raise FormatError("bytes left in the stack")

    return pop, check


def _decode_one(shape: tuple[int, int, int], mode: str, alphabet: int, block: int, q_tables: Tables, q_reader: Reader, r_tables: Tables | None, r_reader: Reader | None) -> list[int]:
    depth, ny, nx = shape
    plane, base, mean, compact = ny * nx, MODES[mode][1] * alphabet, mode.startswith("mean"), _COMPACT[mode]
    pop, check = _popper(q_tables, q_reader, block)
    q = [0] * (depth * plane)
    i = 0
    for z in range(depth):
        for y in range(ny):
            for x in range(nx):
                if not x:
                    ctx = base + alphabet
                elif not y or not (z or mean):
                    ctx = base + q[i - 1]
                else:
                    l, u = q[i - 1], q[i - nx]
                    ctx = compact(l, u, q[i - plane] if z else (l + u) // 2)
                q[i] = pop(i % LANES, ctx)
                i += 1
    check()
    if r_reader is None:
        return q
    pop, check = _popper(r_tables, r_reader, block)
    for i, s in enumerate(q):
        if s:
            q[i] = s * s + pop(i % LANES, s)
            if q[i] > 65535:
                raise FormatError("reconstructed value exceeds 65535")
    check()
    return q


def _three(a: int, b: int) -> int:
    return (a > b) - (a < b) + 1


def _five(d: int) -> int:
    return (0, 1, 2, 4, 3)[min(max(d, -2), 2)]


_COMPACT = {
    "mean": lambda l, u, p: l + u + p,
    "meansigns": lambda l, u, p: (l + u + p) * 3 + _three(l, u),
    "signs": lambda l, u, p: ((m := sorted((l, u, p))[1]) * 3 + _three(l, u)) * 3 + _three(p, m),
    "signed3": lambda l, u, p: ((m := sorted((l, u, p))[1]) * 5 + _five(l - u)) * 5 + _five(p - m),
}
