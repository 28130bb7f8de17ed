"""Near-duplicate documents by MinHash.

Each document is the set of its word shingles.  Minima under many universal
hash functions make a signature; bands of the signature are the keys of
buckets.  Pairs are verified by signature and then on the full sets, and the
components of the verified links come from alternating large-star and
small-star steps.

No group of copies is paired with itself in full.  Documents of equal sets are
one class: only its first document takes part.  Each bucket has a leader,
the member that shares most buckets with most others, which in a group of
edited copies is the one closest to all.  Documents are verified against the
best of their leaders first, then against the leaders that are still in other
components.  What a leader's documents hold outside their largest component is
compared with all of them, block by block inside the tasks, and only links come
out: in the end no candidate pair between different components is untested.
"""

from __future__ import annotations

import gc
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free_name, hash_column, join_hot, mix, text_slices

#: A pair of similarity 0.8 misses all of 56 bands of 7 rows with a probability of 2e-6, one of 0.85 with 2e-10.
BANDS, ROWS = 56, 7
#: Hashes of the signature that verifies; the share of it that may be missing is over 7 standard deviations.
CHECKS, MARGIN = 128, 0.25
_MULTIPLIERS = (mix(np.arange(1, 1025, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
#: Shingles hashed at once, to stay within the cache.
CHUNK = 1 << 14
#: Bytes of sets in one block of the last comparison.
BLOCK_BYTES = 1 << 19
#: Links that one task connects; more are connected by rounds over all tasks.
FEW_LINKS = 1 << 16


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct hashes of the ``size``-word shingles of each text; with fewer words, of the whole sequence."""
    h, offsets = hash_column(column, lower=True)
    out = []
    rolled = h.copy()
    for k in range(1, size):
        rolled[: len(h) - k] = mix(rolled[: len(h) - k] * np.uint64(0x9E3779B97F4A7C15) + h[k:]) if len(h) > k else rolled[: len(h) - k]
    for a, b in zip(offsets[:-1], offsets[1:]):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            x = np.uint64(b - a)
            for w in h[a:b]:
                x = mix(np.array([x * np.uint64(31) + w], dtype=np.uint64))[0]
            out.append(np.array([x], dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def signatures(sets: list[np.ndarray], count: int) -> np.ndarray:
    """Minima of each set under ``count`` multiply-shift hashes of 32 bits; rows of empty sets hold the maximum."""
    out = np.full((len(sets), count), 0xFFFFFFFF, dtype=np.uint32)
    full = np.flatnonzero([len(x) for x in sets])
    if not len(full):
        return out
    flat = (np.concatenate([sets[i] for i in full]) >> np.uint64(32)).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])]).astype(np.int64)
    lows = np.full((count, len(full)), 0xFFFFFFFF, dtype=np.uint32)
    for x in range(0, len(flat), CHUNK):  # a set may lie in several chunks
        part = flat[x : x + CHUNK]
        a, b = int(np.searchsorted(starts, x, "right")) - 1, int(np.searchsorted(starts, x + len(part), "left"))
        at = np.maximum(starts[a:b] - x, 0)
        for j in range(count):
            np.minimum(lows[j, a:b], np.minimum.reduceat(part * _MULTIPLIERS[j], at), out=lows[j, a:b])
    out[full] = lows.T
    return out


def _band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    x = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(sig), bands)).copy()
    for r in range(rows):
        x = mix(x * np.uint64(0x9E3779B97F4A7C15) + sig[:, r::rows].astype(np.uint64))
    return x


def _identified(docs: DataFrame, key: str, text: str, *extra: str) -> DataFrame:
    """``id, t1, t2, text``: what tells rows apart is their key, null or not, and the two hashes of their text."""
    return docs.select(*extra, F.col(key).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("t1"), F.xxhash64(F.lit(7), F.col(text)).alias("t2"), F.col(text).alias("text"))


def _same(left: DataFrame, right: DataFrame):
    return left["id"].eqNullSafe(right["id"]) & (left["t1"] == right["t1"]) & (left["t2"] == right["t2"])


def _sketches(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """``id, t1, t2, n, s1, s2`` (a name of the set) and ``keys``, the bucket of each band, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            sets = shingle_sets(b.column("text"), size)
            names = np.array([[s.sum(dtype=np.uint64), mix(s).sum(dtype=np.uint64)] for s in sets], dtype=np.uint64).view(np.int64)
            keys = _band_keys(signatures(sets, bands * rows), bands, rows).view(np.int64)
            yield pa.record_batch([*b.select(["id", "t1", "t2"]).columns, pa.array([len(s) for s in sets], pa.int64()), pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array(list(keys), pa.list_(pa.int64()))], names=["id", "t1", "t2", "n", "s1", "s2", "keys"])

    return docs.mapInArrow(run, "id long, t1 long, t2 long, n long, s1 long, s2 long, keys array<long>")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """The sorted shingles of documents ``id, text`` and a signature of one byte for each of ``CHECKS`` hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text"):
            sets = shingle_sets(b.column("text"), size)
            sig = (signatures(sets, CHECKS) & np.uint32(255)).astype(np.uint8)
            yield pa.record_batch([b.column("id"), pa.array([x.tobytes() for x in sig], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "sig", "shingles"])

    return docs.mapInArrow(run, "id long, sig binary, shingles binary")


def _check(pairs: DataFrame, threshold: int, exact: bool) -> DataFrame:
    """Pairs ``a, b`` whose ``a_x``, ``b_x`` pass: signatures nearly, full sets exactly ``100 * inter >= threshold * union``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column("a_x"), b.column("b_x")):
                if exact:
                    p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    inter = len(np.intersect1d(p, q, assume_unique=True))
                    ok.append(100 * inter >= threshold * (len(p) + len(q) - inter))
                else:
                    same = np.frombuffer(x.as_buffer(), np.uint8) == np.frombuffer(y.as_buffer(), np.uint8)
                    ok.append(same.mean() >= threshold / 100 - MARGIN)
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.select("a", "b", "a_x", "b_x").mapInArrow(run, "a long, b long")


def _connected(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links and the smallest node that each reaches, without those that are it themselves."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while len(u):
        u, v = root[u], root[v]
        apart = u != v
        u, v = np.maximum(u, v)[apart], np.minimum(u, v)[apart]
        np.minimum.at(root, u, v)
        while (root != (up := root[root])).any():
            root = up
    moved = root != np.arange(len(ids))
    return ids[moved], ids[root[moved]]


def _connected_here(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = [(np.asarray(x.column("a")), np.asarray(x.column("b"))) for x in batches]
        if links:
            ids, least = _connected(*map(np.concatenate, zip(*links)))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(least, pa.int64())], names=["id", "component"])

    return edges.coalesce(1).mapInArrow(run, "id long, component long")


def components(edges: DataFrame, scratch: Scratch, label: str = "cc", few: int = FEW_LINKS) -> DataFrame:
    """``id, component`` (the smallest id reachable, which has no row itself) of the nodes of ``edges`` (``a``, ``b``), a written table.

    Up to ``few`` links, whatever the input, are connected by one task, as rounds of many nearly empty tasks take longer.

    Beyond, alternates large-star (each node links its larger neighbours to the smallest of all) and small-star (its smaller
    neighbours and itself) until nothing changes.  Only minima are aggregated by node, and they go back to the
    edges by a join that spreads hot nodes.
    """
    edges = edges.where("a <> b").select("a", "b")
    if edges.count() <= few:
        return scratch.keep(_connected_here(edges), label)
    edges = scratch.keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{label}-0")
    last = None
    for i in itertools.count(1):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.hold(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("c")))
        large = join_hot(both, low, ["u"], "c", "v").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.hold(large)
        # small-star: u with its smaller neighbours
        least = scratch.hold(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c")))
        moved = join_hot(large, least, ["u"], "c", "v").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges = scratch.keep(moved, f"{label}-{i}")
        # a star forest has no edge whose smaller end is a larger end elsewhere; sums tell when nothing moves any more
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.let_go()
        scratch.drop(f"{label}-{i - 1}")
        if state == last:
            break
        last = state
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))


def near_duplicates(docs: DataFrame, size: int = 5, threshold: int = 80, bands: int = BANDS, rows: int = ROWS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: the component of each document under links of Jaccard similarity >= ``threshold`` %.

    A-Z is lower-cased; words are ``[^\\x20\\x09-\\x0D]+``; a document's set holds its distinct ``size``-word shingles or,
    with fewer words, its whole sequence.  Texts that are null, empty or blank have an empty set and are linked with
    nothing.  ``component_id`` is the smallest key reachable; ``kept`` marks the rows that have it.  Keys must be
    integers.  Rows that repeat a key are documents of their own, linked or not as their texts are; a row of null
    key takes part like any other, and the component of such rows alone is null, with ``kept`` true.  An empty table
    gives an empty result; extra columns are ignored.
    """
    out = _grouped(docs, size, threshold, bands, rows, key, text)
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("least.id").alias("component_id"), F.col("id").eqNullSafe(F.col("least.id")).alias("kept"))


def _grouped(docs: DataFrame, size: int, threshold: int, bands: int, rows: int, key: str, text: str) -> DataFrame:
    """``id, t1, t2, n`` of every row, and the ``least`` of its component (``id`` with null last, ``t1``, ``t2``).

    The nodes are the distinct sets, each under a number of its own.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dup", prompt=True)
    docs = _identified(docs, key, text)

    def release() -> None:
        """Shuffle files of finished passes go when the driver's handles of them do; nothing depends on when."""
        scratch.let_go()
        gc.collect()
        spark._jvm.System.gc()

    sketch = scratch.keep(_sketches(docs, size, bands, rows).withColumn("row", F.monotonically_increasing_id()), "sketch")
    full = sketch.where("n > 0")
    # classes of equal sets; the first row of each stands for it
    first = F.min(F.struct(F.col("id").isNull().alias("z"), "id", "t1", "t2")).alias("f")
    classes = full.groupBy("s1", "s2", "n").agg(first, F.count(F.lit(1)).alias("c"))
    classes = scratch.keep(classes.select("s1", "s2", "n", "c", F.monotonically_increasing_id().alias("node"), "f"), "classes")
    firsts = classes.select(F.col("node"), "f.id", "f.t1", "f.t2")
    repeated = not full.groupBy("id", "t1", "t2").count().where("count > 1").isEmpty()
    once = full.select("id", "t1", "t2", "keys")
    if repeated:
        once = once.dropDuplicates(["id", "t1", "t2"])
    reps = scratch.keep(once.join(firsts, _same(once, firsts)).select(F.col("node").alias("id"), "keys"), "reps")
    named_sets = scratch.keep(sketch.drop("keys"), "names")
    full = named_sets.where("n > 0")
    scratch.drop("sketch")
    release()
    banded = reps.select("id", F.explode("keys").alias("k"))
    buckets = scratch.keep(banded.groupBy("k").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "buckets")
    members = scratch.keep(join_hot(banded, buckets, ["k"], "c", "id"), "members")
    scratch.drop("reps")
    release()
    # how many others a document meets, over all its buckets
    members = scratch.keep(members.join(members.groupBy("id").agg(F.sum("c").alias("meets")), "id"), "ranked")
    lead = F.max_by(F.struct(F.col("id").alias("lead"), F.col("meets").alias("fame")), F.struct("meets", -F.col("id"))).alias("l")
    leads = scratch.keep(members.groupBy("k").agg(lead, F.count(F.lit(1)).alias("c")).select("k", "l.*", "c"), "leads")
    led = join_hot(members.select("id", "k"), leads, ["k"], "c", "id").select("lead", "id", "fame").distinct()
    led = scratch.keep(led, "led")
    wanted = firsts.join(led.select(F.col("id").alias("node")).distinct(), "node")
    texts = docs.dropDuplicates(["id", "t1", "t2"]) if repeated else docs
    sets = scratch.keep(_sets(texts.join(wanted, _same(texts, wanted)).select(F.col("node").alias("id"), "text"), size), "sets")
    scratch.drop("members")
    scratch.drop("ranked")
    release()

    best = F.max_by("lead", F.struct("fame", -F.col("lead")))
    pairs = led.where("id <> lead").groupBy("id").agg(best.alias("lead"))
    links = scratch.keep(_verified(_ordered(pairs), sets, threshold, scratch, "v0"), "links0")
    comp = components(links, scratch, "cc0")
    release()
    named = _named(led, comp, scratch, "named0")
    more = _verified(_ordered(named.where("id <> lead and component <> lead_component")), sets, threshold, scratch, "v1")
    links = scratch.keep(links.unionByName(more), "links1")
    comp = components(links, scratch, "cc1")
    release()
    rest = scratch.keep(_across(_named(led, comp, scratch, "named1"), sets, threshold, scratch), "rest")
    if not rest.isEmpty():
        comp = components(links.unionByName(rest), scratch, "cc2")
    release()

    placed = classes.join(comp.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = scratch.keep(placed, "placed")
    least = scratch.keep(placed.groupBy("component").agg(F.min("f").alias("least"), F.count(F.lit(1)).alias("k")), "least")
    of_class = scratch.keep(join_hot(placed, least, ["component"], "k", "node").select("s1", "s2", "n", "c", "least"), "of-class")
    linked = join_hot(full, of_class, ["s1", "s2", "n"], "c", "row").select("id", "t1", "t2", "n", "least")
    alone = named_sets.where("n = 0").select("id", "t1", "t2", "n", F.struct(F.col("id").isNull().alias("z"), "id", "t1", "t2").alias("least"))
    scratch.only("names", "of-class")
    release()
    return linked.unionByName(alone)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).distinct()


def _named(led: DataFrame, comp: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """``lead, id`` with the components of both; a document without a link is a component of its own."""
    out = led.select("lead", "id").join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
    of_lead = out.where("id = lead").select("lead", F.col("component").alias("lead_component"))
    sizes = scratch.hold(led.groupBy("lead").agg(F.count(F.lit(1)).alias("c")))
    return scratch.keep(join_hot(out, of_lead, ["lead"], "c", "id", sizes), label)


def _verified(pairs: DataFrame, sets: DataFrame, threshold: int, scratch: Scratch, label: str) -> DataFrame:
    """The pairs ``a, b`` that pass both checks."""
    pairs = scratch.keep(pairs, f"{label}-pairs")
    likely = scratch.keep(_check(_with(pairs, sets, "sig", scratch), threshold, exact=False), f"{label}-likely")
    return scratch.keep(_check(_with(likely, sets, "shingles", scratch), threshold, exact=True), f"{label}-links")


def _across(named: DataFrame, sets: DataFrame, threshold: int, scratch: Scratch) -> DataFrame:
    """Links between the components of each leader's documents.

    The documents outside the largest component meet all documents of the leader, as blocks of sets of about
    ``BLOCK_BYTES``.  The blocks of a large group are dealt over several tasks; of the pairs, only links leave a task, one
    for each document and component.
    """
    parts = named.groupBy("lead", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = parts.groupBy("lead").agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("most"), F.sum("n").alias("c"), F.count(F.lit(1)).alias("kinds"))
    mixed = scratch.hold(mixed.where("kinds > 1").select("lead", "most", "c"))
    there = scratch.hold(join_hot(named.select("lead", "id", "component"), mixed, ["lead"], "c", "id").select("lead", "id", "component", "most"))
    uses = scratch.hold(there.groupBy("id").agg(F.count(F.lit(1)).alias("c")))
    sized = join_hot(there, sets.select("id", F.octet_length("shingles").alias("bytes")), ["id"], "c", "lead", uses)
    odd = F.col("component") != F.col("most")
    total = sized.groupBy("lead").agg(F.sum("bytes").alias("all_bytes"), F.sum(F.when(odd, F.col("bytes")).otherwise(0)).alias("odd_bytes"), F.count(F.lit(1)).alias("c"))
    cuts = total.select("lead", "c", *[F.ceil(F.col(f"{n}_bytes") / BLOCK_BYTES).cast("int").alias(f"{n}_blocks") for n in ("all", "odd")])
    cuts = scratch.hold(cuts.withColumn("salts", F.ceil(F.col("all_blocks") / 8).cast("int")))
    placed = scratch.hold(join_hot(there, cuts, ["lead"], "c", "id"))
    full = join_hot(placed, sets, ["id"], "c2", "lead", uses.withColumnRenamed("c", "c2"))
    item = F.struct("id", "component", "sig", "shingles")
    whole = full.groupBy("lead", F.pmod(F.xxhash64("id"), F.col("all_blocks")).cast("int").alias("block"), "odd_blocks", "salts").agg(F.collect_list(item).alias("all"))
    whole = whole.withColumn("salt", F.col("block") % F.col("salts")).select("lead", "salt", "all", F.explode(F.sequence(F.lit(0), F.col("odd_blocks") - 1)).alias("part"))
    some = full.where(odd).groupBy("lead", F.pmod(F.xxhash64("id"), F.col("odd_blocks")).cast("int").alias("part"), "salts").agg(F.collect_list(item).alias("odd"))
    some = some.select("lead", "part", "odd", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1).to_pylist()[0]
                links = _links_of(one["odd"], one["all"], threshold)
                if links:
                    a, b = zip(*links)
                    yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return whole.join(some, ["lead", "part", "salt"]).select("odd", "all").mapInArrow(run, "a long, b long")


def _links_of(odd: list[dict], every: list[dict], threshold: int) -> list[tuple[int, int]]:
    """Links from documents of one block to other components in the other, one for each document and component."""
    sig = np.stack([np.frombuffer(r["sig"], np.uint8) for r in every])
    component = np.array([r["component"] for r in every])
    out = []
    for x in odd:
        near = (sig == np.frombuffer(x["sig"], np.uint8)).mean(1)
        p, linked = np.frombuffer(x["shingles"], np.uint64), {x["component"]}
        for i in np.argsort(-near, kind="stable"):
            if near[i] < threshold / 100 - MARGIN:
                break
            if component[i] in linked:
                continue
            q = np.frombuffer(every[i]["shingles"], np.uint64)
            if 100 * min(len(p), len(q)) < threshold * max(len(p), len(q)):
                continue
            inter = len(np.intersect1d(p, q, assume_unique=True))
            if 100 * inter >= threshold * (len(p) + len(q) - inter):
                linked.add(component[i])
                out.append((min(x["id"], every[i]["id"]), max(x["id"], every[i]["id"])))
    return out


def _with(pairs: DataFrame, values: DataFrame, column: str, scratch: Scratch) -> DataFrame:
    """The values of both ends of each pair of a written table; ends of many pairs are spread."""
    out = pairs
    for end, other in (("a", "b"), ("b", "a")):
        counts = scratch.hold(pairs.groupBy(end).agg(F.count(F.lit(1)).alias("c")))
        out = join_hot(out, values.select(F.col("id").alias(end), F.col(column).alias(f"{end}_x")), [end], "c", other, counts)
    return out


def drop_near_duplicates(docs: DataFrame, size: int = 5, threshold: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component, unchanged: that of the smallest key, null last, and of equal keys that of the least text hash.

    Of rows that repeat key and text one stays.  Texts without words are linked with nothing and all stay.
    """
    found = Scratch(docs.sparkSession, "near-dup-rows", prompt=True).keep(_grouped(docs, size, threshold, BANDS, ROWS, key, text).where("n > 0").withColumn("first", F.struct("id", "t1", "t2").eqNullSafe(F.struct("least.id", "least.t1", "least.t2"))).drop("least"), "rows")
    i, t1, t2 = free_name(docs, "_id", "_t1", "_t2")
    rows = docs.withColumns({i: F.col(key).cast("long"), t1: F.xxhash64(F.col(text)), t2: F.xxhash64(F.lit(7), F.col(text))})

    def like(other: DataFrame):
        return rows[i].eqNullSafe(other["id"]) & (rows[t1] == other["t1"]) & (rows[t2] == other["t2"])

    gone = found.where("not first").select("id", "t1", "t2").distinct()
    stays = rows.join(gone, like(gone), "left_anti")
    again = found.where("first").groupBy("id", "t1", "t2").count().where("count > 1").select("id", "t1", "t2")
    if again.isEmpty():
        return stays.select(*docs.columns)
    plain = [c for c, t in docs.dtypes if not t.startswith(("map", "variant"))]
    row = F.min_by(F.struct(*[F.col(c) for c in docs.columns]), F.xxhash64(*[F.col(c) for c in plain]))
    one = rows.join(again, like(again), "left_semi").groupBy(i, t1, t2).agg(row.alias("row")).select("row.*")
    return stays.join(again, like(again), "left_anti").select(*docs.columns).unionByName(one)
