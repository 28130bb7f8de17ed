"""The operators against brute force, with nulls, empty texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import inspect
import itertools
import math
import random
import time
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelframe.llm import decontamination, line_dedup, lm_score, mixing, near_dup, quality, sharding, substring_dedup, topk, toxicity

DOCS = "doc_id long, text string, lang string, source string"
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, *(None,) * (4 - len(r))) for r in rows], DOCS)


@pytest.fixture(scope="module")
def mess():
    """Documents with every odd case, and copies."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(words, k=60)) for _ in range(12)]
    rows = [(i, t, "en" if i % 3 else "de", f"s{i % 4}") for i, t in enumerate(base)]
    rows += [(100, None, None, None), (101, "", "en", "s0"), (102, " \t\n", "xx", None), (103, "one", "en", "s1"), (104, base[3], "en", "s1"), (105, base[3], "en", "s2")]
    rows += [(106, base[5].replace("w1 ", "W1 "), "en", "s0"), (107, " ".join(base[7].split()[:40]) + " " + base[8], "de", "s3"), (108, "\n".join(["Same line ", "same LINE", "x"]), "en", "s0")]
    rows += [(109, "a " * 40, "en", "s0"), (110, "a " * 37 + "b", "en", "s0"), (111, " ".join(rng.choices(words, k=30000)), "en", "s1")]
    rows += [(112 + i, f"line {i}\nshared line\n\n shared LINE", "en", "s2") for i in range(12)]
    return [*rows, rows[2]]  # one repeated row


def with_clashes(df):
    """Extra columns whose names an operator might want."""
    return df.withColumns({c: F.lit(1) for c in ("_h", "_src", "size", "target", "taken", "kept", "n_words", "score", "shard", "slot", "ID", "keep", "_n")})


# --- sharding ---------------------------------------------------------------------------------------------------
def phases(spark, sources, seed=17):
    """The phase of each source: a hash with 1024 values."""
    keyed = spark.createDataFrame([(s, "-" if s is None else "+" + s) for s in sources], "s string, k string")
    return {r[0]: r[1] / 1024 for r in keyed.select("s", F.pmod(F.xxhash64(F.lit(seed + 1), "k"), F.lit(1024))).collect()}


def test_shard_spreads_sources_of_one_row(spark):
    rows = [(i, "t", "en", "hot" if i < 3000 else f"s{i}") for i in range(9000)]
    got = sharding.shard(docs_of(spark, rows), 16).collect()
    sizes = collections.Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(got) == 9000
    for k, n in sizes.items():
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(n))
    hot = collections.Counter(r["shard"] for r in got if r["source"] == "hot")
    assert max(hot.values()) - min(hot.values()) < 40  # the small sources lie all over, so that shards hold alike of the large one


def test_shard_matches_brute_force(spark):
    rows = [(i, f"t{i}", "en", "hot" if i % 3 else f"s{i % 7}") for i in range(400)]
    got = sharding.shard(docs_of(spark, rows), 16).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(400))
    sizes = collections.Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(16))
    for k, n in sizes.items():
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(n))
    # the order of the shards is the order of fractional ranks within the sources
    order = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    totals, seen, fractions = collections.Counter(r["source"] for r in got), collections.Counter(), []
    phase = phases(spark, totals)
    for r in order:
        fractions.append((seen[r["source"]] + phase[r["source"]]) / totals[r["source"]])
        seen[r["source"]] += 1
    assert fractions == sorted(fractions)
    # every shard has the mixture of the whole
    hot = collections.Counter(r["shard"] for r in got if r["source"] == "hot")
    assert max(hot.values()) - min(hot.values()) <= len(totals)  # a cut may fall among rows of equal fractions
    again = {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.shard(docs_of(spark, rows).repartition(3), 16).collect()}
    assert again == {(r["doc_id"], r["shard"], r["slot"]) for r in got}


def test_shard_odd_cases(spark, mess):
    out = sharding.shard(with_clashes(docs_of(spark, mess)), 16)
    got = out.collect()
    assert len(got) == len(mess) and out.columns.count("shard") == 1
    sizes = collections.Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes[k] for k in range(16)) <= 1
    few = sharding.shard(docs_of(spark, mess[:3]), 16).collect()
    assert sorted(r["slot"] for r in few) == [0, 0, 0] and len({r["shard"] for r in few}) == 3
    assert sharding.shard(docs_of(spark, []), 16).count() == 0


# --- mixing -----------------------------------------------------------------------------------------------------
def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        target = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_} | {s: float(most * sizes[s]) for s in full}
        over = [s for s in open_ if target[s] > most * sizes[s]]
        if not over:
            return target
        full |= set(over)


def test_mix_matches_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(0, 30), "en", rng.choice(["a", "a", "a", "b", "c", "é", None])) for i in range(600)]
    got = mixing.mix_table(docs_of(spark, rows)).collect()
    sizes = collections.Counter()
    for _, t, _, s in rows:
        sizes[s] += len(t.split())
    want = brute_targets(sizes)
    taken = collections.Counter()
    for r in got:
        assert r["size"] == len(r["text"].split()) and r["source_size"] == sizes[r["source"]]
        assert math.isclose(r["target"], want[r["source"]], rel_tol=1e-9)
        assert 0 <= r["taken"] <= 2 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 15, s  # half a document
    # thresholds: within a source, extra copies go to the documents of smallest hash
    h = dict(spark.createDataFrame(rows, DOCS).select("doc_id", F.shiftrightunsigned(F.xxhash64(F.lit(29), "doc_id", "text"), 4)).collect())
    for s in sizes:
        own = sorted((h[r["doc_id"]], r["copies"]) for r in got if r["source"] == s)
        assert [c for _, c in own] == sorted((c for _, c in own), reverse=True)
    copies = {(r["doc_id"], r["taken"]) for r in got}
    assert copies == {(r["doc_id"], r["taken"]) for r in mixing.mix_table(docs_of(spark, rows).repartition(5)).collect()}
    assert mixing.mix(docs_of(spark, rows)).count() == sum(r["copies"] for r in got if r["size"])


def test_mix_odd_cases(spark, mess):
    out = mixing.mix_table(with_clashes(docs_of(spark, mess)))
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[100]["taken"] == got[101]["taken"] == 0 and out.count() == len(mess)
    assert mixing.mix_table(docs_of(spark, [])).count() == 0
    assert [r["taken"] for r in mixing.mix_table(docs_of(spark, [(1, "", None, "a"), (2, None, None, "a")])).collect()] == [0, 0]


def test_mix_of_null_keys_and_of_equal_rows(spark):
    """The target is met however many rows share a key, or key and text."""
    rng = random.Random(7)
    nulls = [(None, " ".join(["w"] * rng.randint(5, 15)) + f" {i}", "en", "a") for i in range(300)]
    equal = [(7, "x y z", "en", "b")] * 300
    rows = [*nulls, *equal, *[(i, "p q", "en", "c") for i in range(50)]]
    for parts in (1, 7):
        got = mixing.mix_table(docs_of(spark, rows).repartition(parts)).collect()
        assert len(got) == len(rows)
        for name, most in (("a", 17), ("b", 3), ("c", 2)):
            own = [r for r in got if r["source"] == name]
            assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= most / 2, name
            assert all(r["taken"] <= 2 * r["size"] for r in own)


# --- line de-duplication ----------------------------------------------------------------------------------------
def test_lines_match_brute_force(spark, mess):
    key = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s.strip(" \t\n\x0b\x0c\r"))
    for batches in (1, 4):
        out = line_dedup.drop_lines(with_clashes(docs_of(spark, mess)), min_docs=10, batches=batches)
        counts = collections.Counter(k for _, t, *_ in mess for k in {key(x) for x in (t or "").split("\n")} if k)
        want = []
        for i, t, *_ in mess:
            lines = (t or "").split("\n")
            kept = [x for x in lines if not key(x) or counts[key(x)] < 10]
            want.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
        assert sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in out.collect()) == sorted(want)
    assert line_dedup.drop_lines(docs_of(spark, [])).count() == 0


def test_line_runs_are_levelled(spark):
    index = line_dedup.LineRuns(spark, fanout=2)
    want = collections.Counter()
    for b in range(5):
        rows = [(h, h, 1 + b) for h in range(b, b + 4)]
        want.update({h: n for h, _, n in rows})
        index.add(spark.createDataFrame(rows, "h1 long, h2 long, docs long"))
    assert [len(x) for x in index.levels] == [1, 0, 1]
    for least in (1, 4, 9):
        got = [(r["h1"], r["docs"]) for df in index.at_least(least) for r in df.collect()]
        assert sorted(got) == sorted((h, n) for h, n in want.items() if n >= least)
    # every key is fresh in one run only
    assert sum(r.where("fresh").count() for r in index.runs()) == len(want)


def test_line_runs_are_neither_shuffled_nor_sorted(spark):
    index = line_dedup.LineRuns(spark, fanout=4)
    batch = lambda k: spark.range(k, 3000 + k).selectExpr("xxhash64(id) as h1", "xxhash64(id, 1) as h2").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"))
    for k in (0, 500):
        index.add(batch(k))
    counted = index.keep(batch(900), "counted")
    with index.ordered():
        for df in (index.step(counted), *index.at_least(2)):
            df.collect()
            plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
            assert "Exchange" not in plan and "Sort [" not in plan, plan
        assert "SortMergeJoin" in index.step(counted)._jdf.queryExecution().executedPlan().toString()


# --- top-k ------------------------------------------------------------------------------------------------------
def brute_top_k(rows, k):
    good = {i: [math.floor(64 * float(x)) for x in v] for i, v in rows if v is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in sorted(i for i in good if i % 20 == 0):
        scores = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q)[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scores, 1)]
    return out


@pytest.mark.parametrize("n,k,block", [(300, 20, 7), (15, 20, 100), (1, 3, 5)])
def test_top_k_matches_brute_force(spark, n, k, block):
    rng = np.random.default_rng(n)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6) / 4]) for i in range(n)]
    if n > 100:
        rows += [(1000 + i, rows[0][1]) for i in range(60)]  # ties
        rows += [(2000, None), (2001, [math.nan] * 6), (2002, [math.inf] + [0.0] * 5), (2003, [None] * 6), (2004, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("ints", F.lit(1)).withColumn("_ints", F.lit(2))
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, k, sample_rows=64, n_pivots=8, query_block=block)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == sorted(brute_top_k(rows, k))


@pytest.mark.parametrize("large", [5e7, 1e10, 1e40, 1e200])
def test_top_k_of_large_values(spark, large):
    """Scores stay exact, and beyond the range of long they are ranked as they are and shown as its end."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(60)]
    rows += [(60 + i, [large * (1 + i % 7) + i / 3, 1.5, -large / (i + 1), float(i)]) for i in range(41)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, 5, sample_rows=32, n_pivots=4).collect()
    clip = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
    assert sorted(map(tuple, got)) == sorted((q, n, i, clip(s)) for q, n, i, s in brute_top_k(rows, 5))


def test_top_k_of_repeated_keys(spark):
    rows = [(i % 30, [float(i % 7), float(i % 5)]) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in topk.top_k(df, F.col("vec_id") % 20 == 0, 6).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    whole = lambda v: [math.floor(64 * x) for x in v]
    for q in (0, 20):
        own = min(whole(v) for i, v in rows if i == q)
        want = sorted((-sum(a * b for a, b in zip(own, whole(v))), i) for i, v in rows if i != q)[:6]
        assert sorted(got[q]) == [(n, i, -s) for n, (s, i) in enumerate(want, 1)]
    with pytest.raises(ValueError):
        topk.top_k(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>"), F.col("vec_id") == 1, 1)


def test_top_k_empty(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, 5).count() == 0


# --- substrings -------------------------------------------------------------------------------------------------
def brute_substrings(rows, window):
    first = {}
    words = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    for i, w in words:
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, w in words:
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < i:
                gone.update(range(s, s + window))
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("window", [13, 5])
def test_substrings_match_brute_force(spark, mess, window):
    rng = random.Random(window)
    # few words, so that runs, periods and chance repeats are common
    rows = [*mess, *((500 + i, " ".join(rng.choices("ab", k=rng.randint(0, 60)))) for i in range(40)), *((600 + i, "x y " * i) for i in range(12))]
    out = substring_dedup.remove_repeats(with_clashes(docs_of(spark, rows)), window)
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in out.collect())
    assert got == brute_substrings(rows, window)


def test_substrings_of_blocks_printed_twice(spark):
    """A block that one document, or rows of one key, hold twice, around a passage of a smaller document."""
    rng = random.Random(8)
    words = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    rows = []
    for i in range(8):
        passage, a, b = words(20 + 9 * i), words(30), words(30)
        block = f"{a} {passage} {b}"
        rows += [(10 * i, f"{words(9)} {passage} {words(9)}"), (10 * i + 1, f"{block} {words(25)} {block} {words(5)} {block}"), (10 * i + 2, f"{words(3)} {block}")]
        rows += [(10 * i + 3, f"{words(7)} {passage} {a}"), (10 * i + 3, f"{passage} {a} {words(4)}")]
    out = substring_dedup.remove_repeats(docs_of(spark, rows), 13)
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in out.collect())
    assert got == brute_substrings(rows, 13)


@pytest.mark.parametrize("always", [False, True])
def test_hot_join_repeats_rows_of_hot_keys_only(spark, always):
    from voxelframe.llm.common import join_hot

    big = spark.range(4000).select(F.when(F.col("id") < 2000, F.lit(-1)).otherwise(F.col("id")).alias("k"), "id")
    small = spark.range(2000, 4000).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("c")).union(spark.createDataFrame([(-1, 2000)], "k long, c long"))
    plan_rows = []
    out = join_hot(big, small, ["k"], "c", "id", always=always)
    assert sorted((r["k"], r["id"]) for r in out.collect()) == sorted((r["k"], r["id"]) for r in big.collect())

    def walk(node):
        if node.nodeName() == "Generate":
            plan_rows.append(node.metrics().apply("numOutputRows").value())
        if node.nodeName() == "AdaptiveSparkPlan":
            walk(node.executedPlan())
        elif node.nodeName().endswith("QueryStage"):
            walk(node.plan())
        for i in range(node.children().length()):
            walk(node.children().apply(i))

    walk(out._jdf.queryExecution().executedPlan())
    assert plan_rows and sum(plan_rows) < 100  # it was a row for each of the 2,001 keys and more
    cold = join_hot(big.where("id >= 2000"), small.where("k > 0"), ["k"], "c", "id", always=always)
    assert cold.count() == 2000


def test_salted_join_has_one_plan_with_and_without_hot_keys(spark):
    from voxelframe.llm.common import join_hot

    def outer_rows(big, small):
        out, found = join_hot(big, small, ["k"], "c", "id", always=True), []
        assert sorted((r["k"], r["id"]) for r in out.collect()) == sorted((r["k"], r["id"]) for r in big.join(small, "k").collect())

        def walk(node):
            if "LeftOuter" in node.simpleStringWithNodeId():
                found.append(node.metrics().apply("numOutputRows").value())
            below = [node.executedPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.plan()] if node.nodeName().endswith("QueryStage") else []
            for x in [*below, *[node.children().apply(i) for i in range(node.children().length())]]:
                walk(x)

        walk(out._jdf.queryExecution().executedPlan())
        return found

    big = spark.range(6000).select(F.when(F.col("id") < 2000, F.lit(-1)).otherwise(F.col("id")).alias("k"), "id")
    small = spark.range(2000, 4000).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("c")).union(spark.createDataFrame([(-1, 2000)], "k long, c long"))
    # a row for each row that looks for its salts, whether any key is hot or not: there was no such join without hot keys
    assert outer_rows(big, small) == [6000]
    assert outer_rows(big.where("id >= 2000"), small.where("k > 0")) == [4000]
    assert outer_rows(big.limit(0), small.limit(0)) in ([], [0])


def test_substrings_of_null_and_repeated_keys(spark):
    block = " ".join(f"b{i}" for i in range(20))
    rows = [(None, block), (None, block), (1, "x " + block), (2, block + " y"), (2, "z " + block), (2, block + " y")]
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in substring_dedup.remove_repeats(docs_of(spark, rows)).collect())
    assert got == [(0, 0), (0, 0), (1, 0), (2, 20), (2, 20), (2, 20)]


def test_interval_hashes_have_no_short_collisions():
    """Two words in the order of Thue and Morse collide under every base modulo a power of two."""
    for n in (1024, 4096):
        bits = np.array([bin(i).count("1") & 1 for i in range(n)])
        a, b = substring_dedup.mix(np.array([11, 12], dtype=np.uint64))
        h = np.concatenate([np.where(bits, a, b), np.where(bits, b, a), np.where(bits, a, b)])
        x = substring_dedup.content(h)(np.array([0, n, 2 * n]), np.array([n, 2 * n, 3 * n]))
        assert x[0] != x[1] and x[0] == x[2]


def test_substrings_empty(spark):
    assert substring_dedup.remove_repeats(docs_of(spark, [])).count() == 0


def test_recompression_is_consistent():
    """A window parses alike wherever it stands: equal windows have equal anchors."""
    rng = np.random.default_rng(2)
    piece = rng.integers(0, 5, 40).astype(np.uint64)
    h, offsets = np.concatenate([rng.integers(0, 5, 30).astype(np.uint64), piece, rng.integers(0, 5, 9).astype(np.uint64), piece]), np.array([0, 70, 119])
    starts, name, _ = substring_dedup.anchors(substring_dedup.mix(h), offsets, 13)
    seen = {}
    for s, n in zip(starts, name):
        assert seen.setdefault(tuple(h[s : s + 13]), n) == n


# --- near-duplicates --------------------------------------------------------------------------------------------
def brute_near(rows, size, threshold):
    sets = []
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, {tuple(w[j : j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()))
    comp = {i: i for i, _ in sets}
    find = lambda x: x if comp[x] == x else find(comp[x])
    for a, (i, p) in enumerate(sets):
        for j, q in sets[:a]:
            if p and q and 100 * len(p & q) >= threshold * len(p | q):
                x, y = sorted((find(i), find(j)))
                comp[y] = x
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets)


def test_near_duplicates_match_brute_force(spark, mess):
    rng = random.Random(8)
    rows = list(mess)
    base = [f"v{rng.randint(0, 400)}" for _ in range(120)]
    for i in range(60):  # a group of edited copies, some close to each other only through the base
        w = list(base)
        for _ in range(rng.randint(0, 12)):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 10**6)}"
        rows.append((1000 + i, " ".join(w)))
    chain = [f"c{i}" for i in range(100)]
    rows += [(2000 + i, " ".join(chain[3 * i : 3 * i + 60])) for i in range(10)]
    for size in (2, 5):
        got = near_dup.near_duplicates(with_clashes(docs_of(spark, rows)), size, 80)
        assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id", "kept").collect())) == brute_near(rows, size, 80)


def test_near_duplicates_of_repeated_and_null_keys(spark):
    base = lambda c: " ".join(f"{c}{i}" for i in range(40))
    x, y, z = base("x"), base("y"), base("z")
    rows = [(5, x), (5, y), (6, x + " e"), (7, y + " e"), (None, y + " f"), (None, z), (None, z + " g"), (8, None), (8, x), (5, x), (None, "")]
    got = sorted(map(str, near_dup.near_duplicates(docs_of(spark, rows), 2, 80).drop("n_shingles").collect()))
    want = [(5, 5, True)] * 3 + [(6, 5, False), (7, 5, False), (None, 5, False), (None, None, True), (None, None, True), (8, 8, True), (8, 5, False), (None, None, True)]
    assert got == sorted(f"Row(doc_id={a}, component_id={b}, kept={c})" for a, b, c in want)
    kept = near_dup.drop_near_duplicates(with_clashes(docs_of(spark, rows)), 2, 80)
    out = collections.Counter((r["doc_id"], r["text"]) for r in kept.collect())
    one = [r for r in out if r[1] in (z, z + " g")]  # of two rows without a key either
    assert out == collections.Counter({(5, x): 1, (5, y): 1, one[0]: 1, (8, None): 1, (None, ""): 1})
    assert kept.columns == with_clashes(docs_of(spark, rows)).columns


def test_components_of_a_long_chain(spark):
    from voxelframe.llm.common import Scratch

    edges = spark.range(0, 3000).select((F.col("id") * 7919 % 3001).alias("a"), ((F.col("id") + 1) * 7919 % 3001).alias("b"))
    got = near_dup.components(edges, Scratch(spark, "chain")).collect()
    assert len(got) == 3000 and {r["component"] for r in got} == {0}


@pytest.mark.parametrize("few", [0, 1 << 16])
def test_components_of_random_links(spark, few):
    from voxelframe.llm.common import Scratch

    rng = random.Random(8)
    links = [(rng.randrange(-900, 900), rng.randrange(-900, 900)) for _ in range(900)] + [(5000, 5000), (7000, 1 << 62)]
    least = {x: x for ab in links for x in ab}
    for _ in range(len(least)):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
        if all(least[a] == least[b] for a, b in links):
            break
    del least[5000]
    got = near_dup.components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "random"), few=few).collect()
    own = {r["id"]: r["component"] for r in got}
    assert len(own) == len(got) and set(own) <= set(least)
    # a node whose only link is to itself may be left out, as it is its own component
    assert {x: own.get(x, x) for x in least} == least


def test_few_links_take_few_jobs(spark):
    from voxelframe.llm.common import Scratch

    scratch = Scratch(spark, "few")
    links = scratch.keep(spark.range(0, 3000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")), "links")
    spark.sparkContext.setJobGroup("few-links", "")
    near_dup.components(links, scratch)
    spark.sparkContext.setJobGroup("others", "")
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("few-links")
    assert 0 < len(jobs) <= 4


def test_near_duplicates_empty(spark):
    assert near_dup.near_duplicates(docs_of(spark, [])).count() == 0
    got = near_dup.near_duplicates(docs_of(spark, [(1, None), (2, ""), (3, " ")])).collect()
    assert all(r["kept"] and r["n_shingles"] == 0 for r in got) and len(got) == 3


# --- decontamination --------------------------------------------------------------------------------------------
def test_decontamination(spark, mess):
    rng = random.Random(3)
    item = [f"q{i}" for i in range(40)]
    swapped = list(item)
    for i in range(3, 40, 7):  # substitutions, no thirteen words in a row
        swapped[i] = "other"
    filler = lambda n: " ".join(f"z{rng.randint(0, 10**6)}" for _ in range(n))
    rows = [*mess, (900, f"{filler(30)} {' '.join(item)} {filler(5)}"), (901, f"{filler(3)} {', '.join(swapped).upper()}!"), (902, f"{filler(50)} {' '.join(item[:9])} {filler(20)}"), (903, f"{filler(9)} short item of six words {filler(9)}"), (904, " ".join(item[10:26])), (905, filler(3000) + " " + " ".join(item)), (906, "a tiny, ONE")]
    bench = spark.createDataFrame([(1, " ".join(item), 0), (2, "short item of six words", 0), (3, None, 0), (4, "", 0), (5, "tiny one", 0), (6, " ".join(item), 0)], "item_id long, text string, doc_id int")
    for limit in (10, 10**6):  # several blocks, one block
        got = {(r["doc_id"], r["item_id"]): r for r in decontamination.find_overlaps(with_clashes(docs_of(spark, rows)), bench, block_tokens=limit).collect()}
        assert set(got) == {(d, i) for d in (900, 901, 904, 905) for i in (1, 6)} | {(903, 2), (906, 5)}
        assert got[900, 1]["n_equal"] == 40 and got[900, 1]["doc_start"] == 30 and got[901, 1]["n_equal"] == 33  # the last substitution is not worth the one token behind it
        kept = decontamination.remove(docs_of(spark, rows), bench, block_tokens=limit)
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r[0] for r in rows if r[0] not in (900, 901, 903, 904, 905, 906))
    assert decontamination.find_overlaps(docs_of(spark, rows), bench.limit(0)).count() == 0
    assert decontamination.find_overlaps(docs_of(spark, []), bench).count() == 0
    assert decontamination.remove(docs_of(spark, rows), bench.limit(0)).count() == len(rows)


def test_decontamination_looks_at_all_it_accepts():
    """Whatever pattern of substitutions verification accepts, a mask agrees with."""
    rng = random.Random(6)
    patterns = {n: range(1 << n) for n in range(1, 14)}
    patterns |= {n: [sum(1 << i for i in some) for k in (0, 1, 2) for some in itertools.combinations(range(n), k)] for n in (15, 16, 17, 18)}
    # no run of more than two, three or four equal tokens but the last; and chance
    patterns |= {n: [sum(1 << i for i in range(k, n, k + 1)) for k in (2, 3, 4)] + [sum(1 << i for i in range(n - 3) if i % 3 == 2)] + [sum((rng.random() < 0.3) << i for i in range(n)) for _ in range(2000)] for n in (20, 40, 60)}
    for n, some in patterns.items():
        block = decontamination.build_block([(7, decontamination.tokens([" ".join(f"i{j}" for j in range(n))])[0])])
        texts = ["aa bb " + " ".join("x" if p >> j & 1 else f"i{j}" for j in range(n)) + " cc" for p in some]
        found = decontamination.overlaps(texts, block)
        for text, got in zip(texts, found):
            h = decontamination.tokens([text])[0]
            want = decontamination.verify(h, block.items[0], 2)
            assert (got[0][1:4] if got else None) == want, text


@pytest.mark.parametrize("n", [1, 4, 5, 8, 11])
def test_decontamination_of_short_items(spark, n):
    item = [f"i{j}" for j in range(n)]
    rows = [(1, "a b " + " ".join(item) + " c"), (2, " ".join(["x", *item[1:]])), (3, " ".join(item[: n // 2] + ["x"] + item[n // 2 + 1 :])), (4, None), (5, "")]
    bench = spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")
    got = {r["doc_id"] for r in decontamination.find_overlaps(docs_of(spark, rows), bench).collect()}
    # a fifth may differ: nothing of up to four tokens, one of five to nine
    assert got == ({1} if n < 5 else {1, 2, 3})
    assert {r["doc_id"] for r in decontamination.remove(docs_of(spark, rows), bench).collect()} == {1, 2, 3, 4, 5} - got


def test_decontamination_recall_by_substitution_rate():
    rng = random.Random(2)
    item = [f"i{j}" for j in range(40)]
    block = decontamination.build_block([(1, decontamination.tokens([" ".join(item)])[0])])
    for rate in (0.05, 0.1, 0.15, 0.2, 0.25):
        texts = ["a b c " + " ".join("x" if rng.random() < rate else w for w in item) + " d e" for _ in range(400)]
        found = sum(bool(x) for x in decontamination.overlaps(texts, block)) / len(texts)
        assert found >= 0.9, rate


# --- classifiers ------------------------------------------------------------------------------------------------
def labelled(spark, n=600, seed=5):
    """Documents with junk and with insults, and their labels."""
    rng = random.Random(seed)
    syllables = ["an", "the", "re", "on", "ti", "er", "st", "nd", "ou", "ha"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 3)))
    rows, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rng.randint(30, 120))]
        bad, toxic = i % 6 == 0, i % 5 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["vilefool", "grubworm", "slimeball"]))
        text = " ".join(f"{x}{rng.choice('#$%')}{rng.choice('#$%')}" for x in w) if bad else " ".join(w)
        rows.append((i, text, "en", "s"))
        labels.append((i, int(not bad), int(toxic)))
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_separates_and_handles_odd_cases(spark, mess):
    rows, labels = labelled(spark)
    odd = [(10000 + i, *r[1:]) for i, r in enumerate([*mess[12:18], mess[23], mess[23], rows[0]])]
    got = {r["doc_id"]: r for r in quality.score(with_clashes(docs_of(spark, rows + odd)), labels, quantile=0.98, per_language=200).collect()}
    assert len(got) == len(rows) + len(odd)
    good = [got[i]["keep"] for i in range(600) if i % 6]
    bad = [got[i]["keep"] for i in range(600) if i % 6 == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.05
    assert got[10000]["keep"] and got[10000]["n_tokens"] == 0
    assert quality.score(docs_of(spark, []), labels).count() == 0
    everything = quality.score(docs_of(spark, rows[:20]), labels.limit(0)).collect()
    assert all(r["keep"] for r in everything)
    assert got[10007]["perplexity"] == got[10006]["perplexity"] and got[10006]["n_tokens"] == 30000  # a long text, and it again
    assert got[10008]["perplexity"] == got[0]["perplexity"]
    no_key = quality.score(docs_of(spark, [(None, *rows[1][1:]), rows[1], rows[1]]), labels).collect()
    assert len({r["perplexity"] for r in no_key}) == 1 and len(no_key) == 3


def test_kneser_ney_probabilities_sum_to_one(spark):
    rows, _ = labelled(spark, 80)
    from voxelframe.llm.common import Scratch

    m = quality.train(docs_of(spark, rows), Scratch(spark, "test")).collect()
    every = np.append(m.uni[0], np.uint64(12345))  # all words and an unknown one
    known, unknown = m.uni[0][:4], np.uint64(77)
    for context in ([known[0], known[1]], [known[3], unknown], [unknown] * 2):
        total = sum(10 ** m.score(np.array([*context, w], dtype=np.uint64), np.array([0]))[-1] for w in every)
        assert abs(total - 1) < 1e-9, context


def test_quality_by_joins_equals_the_broadcast(spark, mess):
    rows, labels = labelled(spark, 200)
    docs = with_clashes(docs_of(spark, rows + [(10000 + i, *r[1:]) for i, r in enumerate(mess)]))
    a, b = ({(r["doc_id"], r["n_tokens"], round(r["perplexity"], 6), round(r["threshold"], 6), r["keep"]) for r in quality.score(docs, labels, quantile=0.98, max_ngrams=n).collect()} for n in (quality.MAX_NGRAMS, 0))
    assert a == b and len(a) > 200
    assert quality.score(docs_of(spark, []), labels, max_ngrams=0).count() == 0


def test_quality_by_joins_deals_the_model_once_and_writes_no_text(spark, monkeypatch):
    from voxelframe.llm.common import Scratch

    plans, columns, real = {}, {}, Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name: (plans.update({name: df._jdf.queryExecution().executedPlan().toString()}), columns.update({name: df.columns}), real(self, df, name))[2])
    monkeypatch.setattr(quality, "BLOCK_BYTES", 20_000)
    rows, labels = labelled(spark, 200)
    before = len(spark.catalog.listTables())
    assert quality.score(docs_of(spark, rows), labels, max_ngrams=0).count() == 200
    parts = [n for n in plans if n.startswith("part")]
    assert 1 < len(parts) <= quality.PASSES and not any("t" in c or "text" in c for c in columns.values())
    for n in parts:  # only what is asked is dealt by shard: the model lies in buckets
        assert plans[n].count("Exchange hashpartitioning(shard") == 1 and "Bucketed: true" in plans[n], plans[n]
    assert len(spark.catalog.listTables()) == before


def test_quality_trains_and_answers_by_packed_counts(spark):
    # one row for each block of words and shard travels, not one for each n-gram; what comes in parts is learned whole
    from voxelframe.llm.common import Scratch

    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(4000)}" for _ in range(200)), "en", "s") for i in range(200)]
    docs, scratch = docs_of(spark, rows), Scratch(spark, "test")
    tables = quality.train([docs.where("doc_id < 70"), docs.where("doc_id >= 70")], scratch)
    triples = collections.Counter()
    for r in rows:
        w = ["<", "<", *r[1].split()]
        triples.update(zip(w, w[1:], w[2:]))
    pairs = collections.Counter(t[1:] for t in triples)
    words = collections.Counter(p[1] for p in pairs)
    assert [t.count() for t in tables.grams] == [len(words), len(pairs), len(triples)]
    assert [t.count() for t in tables.contexts] == [len({p[0] for p in pairs}), len({t[:2] for t in triples})]
    assert tables.total == sum(words.values()) and tables.size == sum(t.count() for t in tables.parts())
    assert all(t.count() <= 4 for t in tables.written.values())  # of shards
    rest = [t.agg(F.sum("x")).first()[0] for t in tables.contexts]
    assert rest == [sum(pairs.values()), sum(triples.values())]
    held = sum(f.stat().st_size for f in Path(scratch.root.removeprefix("file://")).rglob("*.parquet"))
    assert held < 15 * tables.size  # keys of 64 bits take 8 bytes, three words of a trigram 24


def test_quality_by_joins_holds_one_part_at_a_time(spark, monkeypatch):
    import gc
    import weakref

    from pyspark.sql.classic.dataframe import DataFrame as Classic

    made, alive, real, init = [], [], quality.release, Classic.__init__
    monkeypatch.setattr(Classic, "__init__", lambda self, *a: (init(self, *a), made.append(weakref.ref(self)))[0])

    def release(spark):
        real(spark)
        gc.collect()
        alive.append(sum(x is not None and "known" in x.columns for x in (r() for r in made)))

    monkeypatch.setattr(quality, "release", release)
    monkeypatch.setattr(quality, "BLOCK_BYTES", 20_000)
    rows, labels = labelled(spark, 200)
    assert quality.score(docs_of(spark, rows), labels, max_ngrams=0).count() == 200
    assert alive and not any(alive)  # no frame of what was answered is left for the next part


def test_shuffle_files_go_with_what_they_were_written_for(spark, monkeypatch):
    from voxelframe.llm.common import CLEANUP, Scratch

    dirs = [Path(d.getPath()) for d in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f.name for d in dirs for f in d.rglob("shuffle_*.data")}
    left, real = {}, Scratch.keep

    def keep(self, df, name):
        there = files()
        out, until = real(self, df, name), time.time() + 10
        while files() - there and time.time() < until:  # executors delete them meanwhile; the frame is still held
            time.sleep(0.1)
        left[name] = files() - there
        return out

    monkeypatch.setattr(Scratch, "keep", keep)
    monkeypatch.setattr(quality, "BLOCK_BYTES", 20_000)
    rows, labels = labelled(spark, 200)
    assert quality.score(docs_of(spark, rows), labels, max_ngrams=0).count() == 200
    assert sum(n.startswith("part") for n in left) > 1 and not any(left.values()), left
    out = near_dup.near_duplicates(docs_of(spark, rows))
    assert not any(left.values()), left
    assert spark.conf.get(CLEANUP, "false") == "false" and out.collect() == out.collect()


def test_quality_model_of_the_driver_is_bounded():
    assert 12 * quality.MAX_NGRAMS <= 16 << 20  # bytes of a model that is collected


def test_quality_leaves_no_broadcast_to_its_result(spark, monkeypatch):
    made, real = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: made.append(real(self, value)) or made[-1])
    rows, labels = labelled(spark, 200)
    out = quality.score(docs_of(spark, rows), labels)
    assert len(made) == 1 and not Path(made[0]._path).exists()  # the driver's file of the model went with the executors'
    assert out.count() == 200


def test_quality_model_is_small_in_the_driver(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    from voxelframe.llm.common import Scratch

    came, real = [], Classic.toArrow
    monkeypatch.setattr(Classic, "toArrow", lambda self: came.append(real(self)) or came[-1])
    rows, _ = labelled(spark, 600)
    tables = quality.train(docs_of(spark, rows), Scratch(spark, "test"))
    m, counts = tables.collect(), [t.count() for t in tables.parts()]
    assert [t.num_columns for t in came] == [2, 2, 2, 3, 3] and [t.num_rows for t in came] == counts  # keys, not the words of n-grams
    held = [sum(getattr(x, "places", x).nbytes for x in t) / max(1, n) for t, n in zip([*m.grams, *m.contexts], counts)]
    assert max(held[:3]) <= 10 and max(held[3:]) <= 12
    for (keys, coded, *_), t in zip([*m.grams, *m.contexts], came):
        assert dict(zip(keys.tolist(), coded[np.arange(len(keys))])) == dict(zip(t.column("k").to_numpy().view(np.uint64).tolist(), t.column("x").to_numpy()))


@pytest.mark.parametrize("max_ngrams", [quality.MAX_NGRAMS, 0])
def test_quality_learns_from_every_trusted_document(spark, max_ngrams):
    # 3,000 trusted documents, each with a word pair of its own: a bound on a language's documents would leave pairs out
    rows = [(i, f"the word a{i} b{i} ends", "en", "s") for i in range(3000)]
    docs, labels = docs_of(spark, rows), spark.createDataFrame([(i, 1, 0) for i in range(3000)], "doc_id long, quality int, toxic int")
    learn, rest = ({r[0] for r in x.collect()} for x in quality.trusted_sample(docs, labels))
    assert len(learn) > 1300 and len(rest) > 1300 and not learn & rest and learn | rest == set(range(3000))
    got = {r["doc_id"]: r["perplexity"] for r in quality.score(docs, labels, max_ngrams=max_ngrams).collect()}
    assert max(got[i] for i in learn) < min(got[i] for i in rest)


def test_toxicity_learns_and_handles_odd_cases(spark, mess):
    rows, labels = labelled(spark)
    fold = F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 5
    odd = [(10000 + i, *r[1:]) for i, r in enumerate([*mess[12:18], mess[23], mess[23], rows[0]])]
    got = {r["doc_id"]: r for r in toxicity.score(with_clashes(docs_of(spark, rows + odd)), labels, fold != 0).collect()}
    assert len(got) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i]["predicted"] == int(i % 5 == 0) for i in held]) > 0.97
    assert got[10000]["score"] == got[10001]["score"] and got[10006]["score"] == got[10007]["score"] and got[10008]["score"] == got[0]["score"]
    assert toxicity.score(docs_of(spark, []), labels, fold != 0).count() == 0
    assert {r["score"] for r in toxicity.score(docs_of(spark, rows[:9]), labels.limit(0), fold != 0).collect()} == {0.5}


def test_toxicity_compresses_as_with_bare_text():
    rng = random.Random(3)
    word = lambda n: bytes(rng.choices(b"etaoinshrdlu.,-'#", k=rng.randint(1, n)))
    text = b" ".join(word(9) for _ in range(2500))
    for dictionary in (b"", text[:7], text[:8], text[:300], text):
        filler = dictionary[-toxicity.FILLER_BYTES :]
        some = [filler + b" " + b" ".join(word(n) for _ in range(4)) for n in (4, 9, 9, 40, 400) for _ in range(60)]
        some += [filler + b" " + text[a : a + n] for a in range(0, 9000, 700) for n in (5, 25, 135, 136, 137, 600, 5000)]
        some += [filler + b" " + bytes(rng.randrange(256) for _ in range(n)) for n in (1, 30, 70, 100, 3000)] + [b"", b"\x00\x01" * 40]
        c = toxicity.Compressor(dictionary)
        assert c.sizes(some, toxicity._long(some)).tolist() == toxicity._sizes(c.bare, some).tolist()
    some, took = [filler + b" " + b" ".join(word(9) for _ in range(4)) for _ in range(5000)], [[], []]
    for _ in range(9):
        for i, f in enumerate((lambda w: c.sizes(w, toxicity._long(w)), lambda w: toxicity._sizes(c.bare, w))):
            began = time.process_time()
            f(some)
            took[i].append(time.process_time() - began)
    assert min(took[0]) < 0.9 * min(took[1])  # no code tables are built for each window


def test_toxicity_compresses_equal_windows_once(monkeypatch):
    seen, real = [], toxicity.Meter.distances
    monkeypatch.setattr(toxicity.Meter, "distances", lambda self, some: seen.extend(some) or real(self, some))
    text = [b"w%d" % (i % 20) for i in range(400)]
    pairs = [(b"w1 w2 w3 w4 and more", b"w5 w6 w7 w8 w9 w10")]
    model = toxicity.Model(b"some base of words " * 9, pairs, np.linspace(-1, 1, len(toxicity.features(np.zeros(0)))), 4)
    meter = toxicity.Meter(model.base, pairs)
    got = model.scores([text, [], text[:7], text], meter)
    assert len(seen) == len(set(seen)) < 30 and got[0] == got[3]
    want = [toxicity.features(real(meter, toxicity.windows(t, 4))) @ model.weights for t in (text, [], text[:7])]
    assert np.allclose(got[:3], 1 / (1 + np.exp(-np.clip(want, -30, 30))), rtol=1e-12)


# --- language model ---------------------------------------------------------------------------------------------
def test_lattice_sums_all_segmentations():
    pieces = [b" a", b"a", b"b", b"ab", b" ", b"ba"]
    lattice = lm_score.Lattice(pieces, np.log(np.array([[3.0, 2, 2, 4, 1, 1]])), np.array([0.3]))
    p = dict(zip(pieces, np.exp(lattice.log_p[0, :-1])))

    def paths(s):
        return 1.0 if not s else sum(p[x] * paths(s[len(x) :]) for x in pieces if s.startswith(x))

    words = [b"ab", b"abab", b"b", b"a" * 400]
    got = lattice.marginal(words)[:, 0]
    for w, g in zip(words[:3], got):
        assert math.isclose(g, math.log(paths(b" " + w) * 0.3), rel_tol=1e-9)
    assert np.isfinite(got[3])
    # expected uses: pieces of all segmentations cover the word
    uses = lattice.expected([b"ab", b"zz"], np.array([[True], [False]]))[0]
    assert math.isclose(sum(u * len(x) for u, x in zip(uses, pieces)), 3, rel_tol=1e-9)


def test_lattice_in_plain_sums_equals_logarithms(monkeypatch):
    rng = np.random.default_rng(3)
    pieces = [bytes([b]) for b in range(256)] + [b" a", b"ab", b"ba", b"abc", b"aaaa"]
    lattice = lm_score.Lattice(pieces, rng.normal(size=(3, len(pieces))), np.array([0.3, 0.2, 0.1]))
    words = sorted({b"abc"[: 1 + i % 3] * int(n) for i, n in enumerate(rng.integers(1, 40, 90))} | {b"a" * 900, bytes(range(33, 60))})
    there = rng.random((len(words), 3)) < 0.6
    assert lattice.is_short(20) and not lattice.is_short(900)
    plain = lattice.marginal(words), lattice.expected(words, there)
    monkeypatch.setattr(lm_score.Lattice, "is_short", lambda self, n: False)
    for x, y in zip(plain, (lattice.marginal(words), lattice.expected(words, there))):
        assert np.isfinite(x).all() and np.allclose(x, y, rtol=1e-10, atol=1e-12)


def test_lm_base_score_matches_brute_force(spark, mess):
    rows, _ = labelled(spark, 120)
    rows += [(5000 + r[0], *r[1:]) for r in mess]
    fold = F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 7
    out = lm_score.score(with_clashes(docs_of(spark, rows)).withColumn("w", F.lit(1)), fold != 2, VOCABULARY, hot_words=50)
    got = collections.defaultdict(list)
    for r in out.collect():
        got[r["doc_id"]].append(r)
    tokens = lambda t: [*(t or "").encode().lower().split(), b" "]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    c = collections.Counter(w for i, t, *_ in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    for i, t, *_ in rows:
        r = got[i][0]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), rel_tol=1e-9)
        assert np.isfinite(r["score"]) and r["score"] < 0
    assert len(got[5002]) == 2  # the repeated row
    whole = lm_score.score(docs_of(spark, rows), fold != 2, VOCABULARY, hot_words=1 << 18).collect()
    for r in whole:  # looked up or joined, a word scores the same
        assert math.isclose(r["score"], got[r["doc_id"]][0]["score"], rel_tol=1e-9)
    assert lm_score.score(docs_of(spark, []), fold != 2, VOCABULARY).count() == 0


def test_lm_of_many_languages(spark):
    """Each of twenty languages has frequencies of its own; those of a share below ``min_share`` share the frequencies of all."""
    rows = [(i, f"own{i % 20} own{i % 20} own{i % 20}", f"l{i % 20}") for i in range(400)]
    probe = [(1000, "own3 " * 4, "l3"), (1001, "own3 " * 4, None)]
    both = docs_of(spark, rows + probe)
    got = {r["doc_id"]: r["score"] for r in lm_score.score(both, F.col("doc_id") < 1000, VOCABULARY).where("doc_id >= 1000").collect()}
    # of l3, 1/20 of the documents, the word and the end make 3/4 and 1/4
    own = math.log10(0.99 / 20) + 4 * math.log10(0.75) + math.log10(0.25)
    assert got[1000] == got[1001] and own - 0.2 < got[1000] < own + 0.01
    pooled = lm_score.score(both, F.col("doc_id") < 1000, VOCABULARY, min_share=0.06).where("doc_id >= 1000").first()["score"]
    all_ = 4 * math.log10(0.75 / 20) + math.log10(0.25)
    assert all_ - 0.02 < pooled < all_ + 0.01


def brute_lm(rows, learn, rounds=3):
    """The log10 probability of each text, with dictionaries and one word at a time."""
    pieces, logs = lm_score.read_vocabulary(VOCABULARY)
    weight = {p: math.exp(x) for p, x in zip(pieces, logs)}
    whole = sum(weight.values())
    prior = {p: x / whole for p, x in weight.items()}
    tokens = lambda t: [*(t or "").encode().lower().split(), b" "]
    counts = collections.defaultdict(collections.Counter)
    for i, t, lang, *_ in rows:
        if learn(i):
            counts[lang].update(tokens(t))
            counts["all of them"].update(tokens(t))
    longest = max(map(len, pieces))

    def sums(word, p):
        """Probabilities of all paths to and from each place, and the edges."""
        s = b" " + word
        edges = [(a, b, s[a:b]) for a in range(len(s)) for b in range(a + 1, min(len(s), a + longest) + 1) if s[a:b] in p]
        to, back = [1.0] + [0.0] * len(s), [0.0] * len(s) + [1.0]
        for a, b, x in edges:
            to[b] += to[a] * p[x]
        for a, b, x in reversed(edges):
            back[a] += back[b] * p[x]
        return to, back, edges

    def fit(kinds):
        p, stop = {x: y * 0.75 for x, y in prior.items()}, 0.25
        for _ in range(rounds):
            uses = collections.Counter()
            for w in kinds:
                to, back, edges = sums(w, p)
                for a, b, x in edges:
                    uses[x] += to[a] * p[x] * back[b] / to[-1]
            n = sum(uses.values())
            fitted = {x: uses[x] + prior[x] * (n * 0.001 + 1) for x in prior}
            stop, total = (len(kinds) + 1) / (len(kinds) + n + 4), sum(fitted.values())
            p = {x: y / total * (1 - stop) for x, y in fitted.items()}
        return p, stop

    fitted = {k: fit([w for w in c if w != b" "]) for k, c in counts.items()}
    by_pieces = lambda w, k: 0 if w == b" " else sums(w, fitted[k][0])[0][-1] * fitted[k][1]

    def table(c):
        n1, n2 = (sum(x == k for x in c.values()) for k in (1, 2))
        d = min(max(n1 / (n1 + 2 * n2), 0.1), 0.95) if n1 else 0.5
        return c, d, sum(c.values()), d * len(c) / sum(c.values())

    tables = {k: table(c) for k, c in counts.items()}
    share = lambda w, k: max(tables[k][0][w] - tables[k][1], 0) / tables[k][2]

    def pooled(w, k):
        return share(w, "all of them") + tables["all of them"][3] * by_pieces(w, k)

    docs = collections.Counter(lang for i, _, lang, *_ in rows if learn(i))
    out = {}
    for i, t, *_ in rows:
        own = tokens(t)
        total = 0.01 * math.prod(pooled(w, "all of them") for w in own)
        for lang, n in docs.items():
            total += 0.99 * n / sum(docs.values()) * math.prod(share(w, lang) + tables[lang][3] * pooled(w, lang) for w in own)
        out[i] = math.log10(total)
    return out


def test_lm_score_matches_brute_force(spark):
    rng = random.Random(9)
    words = ["the", "Cat", "dogs", "running", "héé", "x", "zzz", "straße", "under"]
    rows = [(i, " ".join(rng.choices(words[: 6 + i % 4], k=rng.randint(0, 12))), [None, "en", "de"][i % 3], "s") for i in range(40)] + [(90, "unseen words catdog the", "en", "s"), (91, None, None, "s")]
    want = brute_lm(rows, lambda i: i < 30)
    for hot in (2, 1 << 18):
        got = lm_score.score(docs_of(spark, rows), F.col("doc_id") < 30, VOCABULARY, hot_words=hot).collect()
        for r in got:
            assert math.isclose(r["score"], want[r["doc_id"]], rel_tol=1e-9, abs_tol=1e-9), r


def test_lm_fits_three_rounds():
    assert inspect.signature(lm_score.score).parameters["rounds"].default == 3


def test_lm_word_probabilities_stay_below_one(spark):
    """The known words, the end and the pieces share one unit of probability."""
    rows = [(i, "aa bb aa cc", "en" if i % 2 else "de") for i in range(40)]
    probe = [(1000 + i, w, "en") for i, w in enumerate(["", "aa", "bb", "cc"])]
    out = lm_score.score(docs_of(spark, rows + probe), F.col("doc_id") < 1000, VOCABULARY).where("doc_id >= 1000").orderBy("doc_id").collect()
    end = 10 ** out[0]["score"]
    # P(w) P(end) for each word, in the mixture of nearly equal languages
    assert sum(10 ** r["score"] for r in out[1:]) < end and end < 0.25


def test_hash_column_tells_words_apart():
    import pyarrow as pa

    from voxelframe.llm import common

    rng = random.Random(0)
    texts = [None, "", "  ", "a", "A b\tc", "héé x", *("".join(rng.choices(" \n\x0babAé", k=rng.randint(0, 40))) for _ in range(300)), "x" * 70000 + " y"]
    for lower in (False, True):
        for column in (pa.array(texts), pa.array([*texts, *texts]).slice(len(texts), len(texts)), pa.array(texts, pa.large_string())):
            h, offsets = common.hash_column(column, lower)
            words = common.words_of(pa.array(texts), lower)
            assert [len(w) for w in words] == np.diff(offsets).tolist()
            seen = {}
            for w, x in zip([x for ws in words for x in ws], h):
                assert seen.setdefault(w, x) == x
            assert len(set(seen.values())) == len(seen)
