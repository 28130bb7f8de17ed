"""Benchmark decontamination by spaced-seed hashing.

A mask reads some token positions of a span and ignores the others.  The masks
are all shapes that the last equal tokens of an accepted overlap can have (see
``shapes``), so whatever verification accepts agrees with one of them.  The
masked hashes of the benchmark are joined with those of every position of every
document; each hit names a diagonal (document position minus item position),
along which the overlap is verified token by token: the best stretch, with ``+1``
for an equal and ``-1`` for a different token, must hold enough equal tokens.  Of
items too short for that many, the whole diagonal must hold their share.

The benchmark is a stated query set.  It is taken in blocks of bounded size,
each of which goes over all documents; documents are never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import hash_column, mix, text_slices

#: Equal tokens that a mask reads, fewer for items that need fewer.
WEIGHT = 5
#: Equal tokens that make an overlap, or this share of a shorter item.
MIN_EQUAL, MIN_SHARE = 13, 0.8
#: Tokens of the benchmark that are broadcast at once.
BLOCK_TOKENS = 1_000_000
BETWEEN = re.compile(r"[\W_]+")


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the tokens of all texts, lower-cased runs of letters and digits, and the offsets of the texts."""
    return hash_column(pa.array([BETWEEN.sub(" ", t.lower()) if t else "" for t in texts], pa.string()))


def needed(length: int) -> int:
    """Equal tokens that an overlap with an item of ``length`` tokens must hold."""
    return min(MIN_EQUAL, int(np.ceil(MIN_SHARE * length)))


def shapes(weight: int) -> list[tuple[int, ...]]:
    """The masks of the last ``weight`` equal tokens of a best stretch.

    A best stretch ends where its gain (``+1`` equal, ``-1`` different) first is highest, so each of its ends gains
    something: the masks are all patterns that do, read backwards from an equal token.
    """
    out, open_ = [], [((0,), 1, 1)]  # steps back from the end, gain, length
    while open_:
        back, gain, n = open_.pop()
        if len(back) == weight:
            out.append(tuple(back[-1] - x for x in reversed(back)))
            continue
        open_.append(((*back, n), gain + 1, n + 1))
        if gain > 1:
            open_.append((back, gain - 1, n + 1))
    return sorted(out)


def masks_of(length: int) -> list[tuple[int, ...]]:
    """The masks for an item of so many tokens; of those that a difference splits too short, the mirrored ones as well."""
    out = shapes(min(WEIGHT, needed(length)))
    return sorted({*out, *(tuple(m[-1] - x for x in reversed(m)) for m in out)}) if length <= WEIGHT + 1 else out


_FACTORS = (mix(np.arange(1, WEIGHT + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def masked_hashes(h: np.ndarray, masks: Iterable[tuple[int, ...]]) -> Iterator[np.ndarray]:
    """The hashes of 32 bits of every span of ``h`` under each mask; masks share the sums of their common last positions."""
    terms = [(h >> np.uint64(32)).astype(np.uint32) * f for f in _FACTORS]
    sums: dict[tuple[int, ...], np.ndarray] = {}
    for mask in masks:
        back = tuple(mask[-1] - x for x in reversed(mask))
        for k in range(1, len(back) + 1):
            own = back[:k]
            if own not in sums:
                if len(h) <= own[-1]:
                    sums[own] = np.zeros(0, dtype=np.uint32)
                elif k == 1:
                    sums[own] = terms[0]
                else:
                    sums[own] = sums[own[:-1]][own[-1] - own[-2] :] + terms[k - 1][: len(h) - own[-1]]
        yield sums[back]


@dataclass
class Block:
    """Some items of the benchmark: their tokens and the sorted masked hashes of all their spans."""

    ids: list
    items: list[np.ndarray]
    keys: np.ndarray
    item: np.ndarray
    pos: np.ndarray
    masks: list[tuple[int, ...]]
    bits: np.ndarray


#: The high bits of a hash that a worker looks up first.
BITS = 20


def build_block(rows: list[tuple]) -> Block:
    """The block of ``rows``, pairs of an id and the hashed tokens of an item."""
    items = [x for _, x in rows]
    by_length = {n: masks_of(n) for n in sorted({len(x) for x in items})}
    keys, item, pos = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, x in enumerate(items):
        for k in masked_hashes(x, by_length[len(x)]):
            keys.append(k)
            item.append(np.full(len(k), i))
            pos.append(np.arange(len(k)))
    keys, item, pos = np.concatenate(keys), np.concatenate(item), np.concatenate(pos)
    order = np.argsort(keys, kind="stable")
    bits = np.zeros(1 << BITS, dtype=bool)
    bits[keys >> np.uint32(32 - BITS)] = True
    masks = sorted({m for ms in by_length.values() for m in ms}, key=lambda m: tuple(m[-1] - x for x in reversed(m)))
    return Block([r[0] for r in rows], items, keys[order], item[order], pos[order], masks, bits)


def _hits(h: np.ndarray, offsets: np.ndarray, block: Block) -> dict[int, set[tuple[int, int]]]:
    """(item, diagonal) of all hits by text; a span lies in one text."""
    found: dict[int, set[tuple[int, int]]] = {}
    for mask, k in zip(block.masks, masked_hashes(h, block.masks)):
        at = np.flatnonzero(block.bits[k >> np.uint32(32 - BITS)])
        lo = np.searchsorted(block.keys, k[at])
        ok = block.keys[np.minimum(lo, len(block.keys) - 1)] == k[at]
        at, lo = at[ok], lo[ok]
        text = np.searchsorted(offsets, at, "right") - 1
        ok = at + mask[-1] < offsets[text + 1]
        for p, a, i in zip(at[ok], lo[ok], text[ok]):
            b = np.searchsorted(block.keys, k[p], "right")
            found.setdefault(int(i), set()).update(zip(block.item[a:b].tolist(), (p - offsets[i] - block.pos[a:b]).tolist()))
    return found


def verify(h: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int] | None:
    """The best stretch of an overlap: equal tokens, its start in the document and its length; None if it does not suffice.

    Of an item that needs fewer than ``MIN_EQUAL`` tokens the stretch goes from the first equal token to the last, where
    that is what suffices.
    """
    a, b = max(0, -diagonal), min(len(item), len(h) - diagonal)
    equal = h[diagonal + a : diagonal + b] == item[a:b]
    gain = np.concatenate([[0], np.cumsum(np.where(equal, 1, -1))])
    low = np.minimum.accumulate(gain)
    end = int(np.argmax(gain - low))
    start = int(np.argmin(gain[: end + 1]))
    n, enough = int(equal[start:end].sum()), needed(len(item))
    if n < enough < MIN_EQUAL and (every := np.flatnonzero(equal)).size >= enough:
        n, start, end = len(every), int(every[0]), int(every[-1]) + 1
    return (n, diagonal + a + start, end - start) if n >= enough else None


def overlaps(texts: list[str | None], block: Block) -> list[list[tuple]]:
    """For each text ``(item id, equal tokens, start, length)`` of the items that it holds, the best stretch of each."""
    h, offsets = tokens(texts)
    out: list[list[tuple]] = [[] for _ in texts]
    if not len(block.keys):
        return out
    for i, places in _hits(h, offsets, block).items():
        own, best = h[offsets[i] : offsets[i + 1]], {}
        for j, diagonal in places:
            if (got := verify(own, block.items[j], diagonal)) and got > best.get(j, (0,)):
                best[j] = got
        out[i] = [(block.ids[j], *best[j], len(block.items[j])) for j in sorted(best)]
    return out


def blocks_of(benchmark: DataFrame, item: str, text: str, limit: int = BLOCK_TOKENS) -> Iterator[Block]:
    """The benchmark in blocks of about ``limit`` tokens, read one partition at a time."""
    rows, size = [], 0
    for r in benchmark.select(item, text).toLocalIterator():
        h, _ = tokens([r[1]])
        if len(h):
            rows.append((r[0], h))
            size += len(h)
        if size >= limit:
            yield build_block(rows)
            rows, size = [], 0
    if rows:
        yield build_block(rows)


def find_overlaps(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``doc_id, item_id, n_equal, doc_start, n_tokens, item_tokens``: one row for each document and benchmark item found in it.

    ``doc_start`` and ``n_tokens`` give the stretch in tokens of the document, ``n_equal`` its equal tokens.  Null and
    empty texts and items match nothing.  An overlap holds ``MIN_EQUAL`` equal tokens or, of shorter items, the share
    ``MIN_SHARE`` rounded up; items of up to four tokens are found as they are, however common their words.  Items of
    equal text match the same documents, each with a row of its own; rows that repeat a document's key give a row each.  Empty tables on either
    side give an empty result.  Extra columns are ignored.
    """
    spark = docs.sparkSession
    kind, name = docs.schema[key].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {name}, n_equal int, doc_start int, n_tokens int, item_tokens int"
    slim, out = docs.select(key, text), None
    arrow = pa.schema([("doc_id", pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()), ("item_id", pa.int64() if name == "bigint" else pa.int32() if name == "int" else pa.string()), *[(c, pa.int32()) for c in ("n_equal", "doc_start", "n_tokens", "item_tokens")]])
    for block in blocks_of(benchmark, item, text, block_tokens):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in text_slices(batches, text):
                found = overlaps(b.column(text).to_pylist(), shared.value)
                rows = [(d, *x) for d, xs in zip(b.column(key).to_pylist(), found) for x in xs]
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), arrow.types)], schema=arrow)

        part = slim.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def remove(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The documents that hold no benchmark item, unchanged and in place: a filter without a shuffle, one after another for each block.

    Null and empty texts and rows of null key stay; whole texts are read, however long; repeated rows stay or go
    together; an empty benchmark leaves all documents; extra columns pass through, whatever their names.
    """
    for block in blocks_of(benchmark, item, text, block_tokens):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in text_slices(batches, text):
                clean = [not x for x in overlaps(b.column(text).to_pylist(), shared.value)]
                yield b.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
