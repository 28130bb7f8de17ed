"""The pipeline and its quality stage against plain Python."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from voxelframe.llm import quality

from .test_operators import DOCS, brute_near, brute_targets, docs_of, labelled, mess, phases, with_clashes  # noqa: F401


def kneser_ney(texts):
    """log10 p(w | u, v) of an interpolated modified Kneser-Ney model, with dictionaries."""
    tri = collections.Counter()
    for t in texts:
        w = ["<s>", "<s>", *(t or "").encode().split()]
        tri.update(zip(w, w[1:], w[2:]))
    bi = collections.Counter((v, w) for _, v, w in tri)
    uni = collections.Counter(w for _, w in bi)

    def discounts(counts):
        n = [sum(c == i for c in counts.values()) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        raw = [1 - 2 * y * n[1] / n[0] if n[0] else 0.5, 2 - 3 * y * n[2] / n[1] if n[1] else 1.0, 3 - 4 * y * n[3] / n[2] if n[2] else 1.5]
        clipped = [min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), raw)]
        return lambda c: clipped[min(c, 3) - 1]

    d3, d2, d1 = discounts(tri), discounts(bi), discounts(uni)
    total3, total2, spare3, spare2 = (collections.Counter() for _ in range(4))
    for (u, v, _), c in tri.items():
        total3[u, v] += c
        spare3[u, v] += d3(c)
    for (v, _), c in bi.items():
        total2[v] += c
        spare2[v] += d2(c)
    whole = sum(uni.values())
    floor = sum(map(d1, uni.values())) / whole / (len(uni) + 1)

    def p(u, v, w):
        x = floor + ((uni[w] - d1(uni[w])) / whole if uni[w] else 0)
        if total2[v]:
            x = spare2[v] / total2[v] * x + ((bi[v, w] - d2(bi[v, w])) / total2[v] if bi[v, w] else 0)
        if total3[u, v]:
            x = spare3[u, v] / total3[u, v] * x + ((tri[u, v, w] - d3(tri[u, v, w])) / total3[u, v] if tri[u, v, w] else 0)
        return math.log10(x)

    known = set(uni)

    def score(t):
        w = ["<s>", "<s>", *((x if x in known else None) for x in (t or "").encode().split())]
        return len(w) - 2, sum(p(*g) for g in zip(w, w[1:], w[2:]))

    return score


def brute_quality(docs, labels, rows, quantile, per_language, prior=20.0):
    """{doc_id: (perplexity, keep)}; only the choice of the sample comes from the operator."""
    learn, rest = (set(r[0] for r in x.collect()) for x in quality.trusted_sample(docs, labels, per_language))
    score = kneser_ney([t for i, t, *_ in rows if i in learn])
    got = {i: (*score(t), lang) for i, t, lang, *_ in rows}
    held = [got[i] for i in got if i in rest and got[i][0]]
    mean = {lang: sum(lp for _, lp, x in held if x == lang) / sum(n for n, _, x in held if x == lang) for lang in {x for *_, x in held}}
    pooled = sum(lp for _, lp, _ in held) / sum(n for n, *_ in held)
    drawn = lambda n, lp, lang: -(lp + prior * mean.get(lang, pooled)) / (n + prior)
    quant = lambda v: sorted(v)[max(0, math.ceil(quantile * len(v)) - 1)]
    bars = {lang: quant([drawn(*x) for x in held if x[2] == lang]) for lang in mean}
    every = quant([drawn(*x) for x in held])
    return {i: (10 ** drawn(*x), drawn(*x), bars.get(x[2], every)) for i, x in got.items()}


def corpus(spark):
    rng = random.Random(12)
    rows, labels = labelled(spark, 420)
    rows = [(i, t, "de" if i % 7 == 3 else None if i % 50 == 49 else "en", f"src{i % 5}" if i % 3 else "hot") for i, t, *_ in rows]
    for i in range(40):  # near and exact copies of clean documents
        base = rows[7 * i + 1][1].split()
        if i % 2:
            base[rng.randrange(len(base))] = "the"
        rows.append((1000 + i, " ".join(base), "en", "hot"))
    bench = [f"the ti er st nd ou ha on an re {' '.join(rng.choices(['the', 'er', 'stnd', 'ouha'], k=12))}" for _ in range(3)]
    for i in range(6):
        words = rows[i * 11 + 2][1].split()
        rows.append((2000 + i, " ".join(words[:20] + bench[i % 3].split() + words[20:]), "en", "src1"))
    return rows, labels, spark.createDataFrame(list(enumerate(bench)), "item_id long, text string")


def test_quality_matches_brute_force(spark):
    rows, labels, _ = corpus(spark)
    docs = docs_of(spark, rows)
    want = brute_quality(docs, labels, rows, 0.95, 60)
    got = {r["doc_id"]: r for r in quality.score(docs, labels, quantile=0.95, per_language=60).collect()}
    for i, (perplexity, x, bar) in want.items():
        assert math.isclose(got[i]["perplexity"], perplexity, rel_tol=1e-3), i
        if abs(x - bar) > 1e-3:
            assert got[i]["keep"] == (x <= bar), i


def test_pipeline_matches_brute_force(spark, tmp_path):
    rows, labels, bench = corpus(spark)
    spark.createDataFrame(rows, DOCS).withColumn("n_chars", F.length("text").cast("long")).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*docs.columns, "shard", "slot"]
    got = out.collect()

    scored = brute_quality(docs, labels, rows, 0.998, 600)
    assert all(abs(x - bar) > 1e-4 or x == bar for _, x, bar in scored.values())
    kept = [r for r in rows if scored[r[0]][1] <= scored[r[0]][2] + 1e-6]
    assert 300 < len(kept) < len(rows) - 50
    first = {i for i, *_, stays in brute_near(kept, 5, 80) if stays}
    kept = [r for r in kept if r[0] in first]
    items = [r["text"].split() for r in bench.collect()]
    holds = lambda t: any(" ".join(x) in t for x in items)
    assert any(holds(r[1]) for r in kept)
    kept = [r for r in kept if not holds(r[1])]

    sizes = collections.Counter()
    for _, t, _, s in kept:
        sizes[s] += len(t.split())
    target, taken, copies = brute_targets(sizes), collections.Counter(), collections.Counter(r["doc_id"] for r in got)
    assert set(copies) <= {r[0] for r in kept} and max(copies.values()) == 2
    for i, t, _, s in kept:
        taken[s] += copies[i] * len(t.split())
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 65, s
    # shards: gapless slots, sizes one apart, fractional ranks in order
    shards = collections.Counter(r["shard"] for r in got)
    assert max(shards.values()) - min(shards[k] for k in range(16)) <= 1
    order, seen, totals, last = sorted(got, key=lambda r: (r["shard"], r["slot"])), collections.Counter(), collections.Counter(r["source"] for r in got), 0.0
    for k, n in shards.items():
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(n))
    phase = phases(spark, totals)
    for r in order:
        now = (seen[r["source"]] + phase[r["source"]]) / totals[r["source"]]
        seen[r["source"]] += 1
        assert now >= last
        last = now


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_take_empty_tables(spark, tmp_path, stage):
    rows, labels, bench = corpus(spark)
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    out = stage(spark, spark.createDataFrame([], DOCS), str(tmp_path))
    assert out.count() == 0 and out.columns[:4] == ["doc_id", "text", "lang", "source"]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_odd_rows(spark, tmp_path, mess, name, stage):  # noqa: F811
    """Nulls in any column, empty and very long texts, repeated rows and columns whose names clash."""
    rows, labels, bench = corpus(spark)
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    odd = [*[(20000 + i, *r[1:]) for i, r in enumerate(mess)], (None, "a text without a key", None, None), (None, None, None, None), (30000, rows[1][1], "en", "s0"), (30000, rows[1][1], "en", "s0")]
    docs = with_clashes(docs_of(spark, rows[:200] + odd))
    out = stage(spark, docs, str(tmp_path))
    assert sorted(out.columns) == sorted({*docs.columns, "shard", "slot"} if name == "sharding" else docs.columns)
    before = collections.Counter((r["doc_id"], r["text"]) for r in docs.collect())
    after = collections.Counter((r["doc_id"], r["text"]) for r in out.collect())
    blank = {k: n for k, n in before.items() if not (k[1] or "").split()}
    assert set(after) <= set(before)
    if name == "sharding":
        assert after == before
    elif name == "source mixing":
        assert not set(blank) & set(after) and max(after[k] / before[k] for k in after) <= 2
    else:
        assert all(after[k] == n for k, n in blank.items())
    if name == "near-duplicates":
        assert after[30000, rows[1][1]] == 0 and after[rows[1][0], rows[1][1]] == 1 and max(n for k, n in after.items() if k not in blank) == 1
