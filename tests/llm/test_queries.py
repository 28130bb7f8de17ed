"""The registered queries over whole small tables, against plain Python."""

import collections
import hashlib
import math
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from voxelframe.llm import decontamination, queries

from .test_operators import DOCS, VOCABULARY, brute_lm, brute_near, brute_substrings, brute_targets, brute_top_k, labelled, mess  # noqa: F401
from .test_pipeline import brute_quality, corpus


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory, mess):  # noqa: F811
    """Folder and rows: labelled documents, copies, junk, benchmark passages, and every odd case."""
    folder = tmp_path_factory.mktemp("tables")
    rows, labels, bench = corpus(spark)
    rows = rows + [(5000 + i, *r[1:]) for i, r in enumerate(mess)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    bench.write.parquet(f"{folder}/benchmark.parquet")
    vectors = [(i, [math.sin(i * j + j) for j in range(1, 9)]) for i in range(120)] + [(200, None)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder), rows


def run(spark, small, name):
    return queries.queries()[name](spark, small[0])


def held(i, folds, rest):
    return zlib.crc32(str(i).encode()) % folds == rest


def test_every_operator_has_one_query():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.queries()) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(queries.queries()) and len(corpus_pipeline.STAGES) == 5


def test_op1(spark, small):
    out = run(spark, small, "op1_shard")
    assert dict(out.dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == len(small[1]) and {r["law"] for r in got.values()} == {"rows"}
    for i, t, *_ in small[1]:
        data = (t or "").encode()
        assert (got[i]["size"], got[i]["text_crc32"]) == (len(data) + 1, zlib.crc32(data))
    slots = collections.defaultdict(list)
    for r in got.values():
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == set(range(16)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_op2(spark, small):
    items = {r["item_id"]: decontamination.tokens([r["text"]])[0] for r in spark.read.parquet(f"{small[0]}/benchmark.parquet").collect()}
    want = set()
    for i, t, *_ in small[1]:
        own = decontamination.tokens([t])[0]
        for j, x in items.items():  # every diagonal
            if any(decontamination.verify(own, x, d) for d in range(1 - len(x), len(own))) if len(own) else False:
                want.add((i, j))
    got = [(r["doc_id"], r["item_id"]) for r in run(spark, small, "op2_decontaminate").collect()]
    assert sorted(got) == sorted(want) and len(want) >= 6


def test_op3(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small[0]}/embeddings.parquet").collect()]
    assert sorted(map(tuple, run(spark, small, "op3_top_k").select("query_id", "rank", "vec_id", "score").collect())) == sorted(brute_top_k(rows, 20))


def test_op4(spark, small):
    got = run(spark, small, "op4_substrings").select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == brute_substrings(small[1], 13)


def test_op5(spark, small):
    key = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s.strip(" \t\n\x0b\x0c\r"))
    counts = collections.Counter(k for _, t, *_ in small[1] for k in {key(x) for x in (t or "").split("\n")} if k)
    want = []
    for i, t, *_ in small[1]:
        lines = (t or "").split("\n")
        kept = [x for x in lines if counts[key(x)] < 10 or not key(x)]
        want.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    assert sorted(map(tuple, run(spark, small, "op5_lines").select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect())) == sorted(want)


def test_op6(spark, small):
    got = run(spark, small, "op6_near_duplicates").select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == brute_near(small[1], 2, 80)


def test_op7(spark, small):
    out = run(spark, small, "op7_lm_score")
    got = {r["doc_id"]: r for r in out.collect()}
    learn = lambda i: not held(i, 7, 2)
    c = collections.Counter(w for i, t, *_ in small[1] if learn(i) for w in [*(t or "").encode().lower().split(), b" "])
    for i, t, *_ in small[1]:
        own, r = [*(t or "").encode().lower().split(), b" "], got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (not learn(i), len(own), sum(w in c for w in own), sum(c.values()))
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (sum(c.values()) + len(c) + 1)) for w in own), rel_tol=1e-9)
        assert math.isfinite(r["score"]) and r["score"] < 0
    # training texts are likelier than under the base
    assert sum(r["score"] for r in got.values() if not r["held_out"]) > sum(r["base_score"] for r in got.values() if not r["held_out"])


def test_op8(spark, small):
    rows = run(spark, small, "op8_toxicity").collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(got) == len(small[1]) and all(r["held_out"] == held(r["doc_id"], 5, 0) and r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{small[0]}/labels.parquet").collect()}
    right = [got[i]["predicted"] == t for i, t in toxic.items() if held(i, 5, 0)]
    assert len(right) > 50 and sum(right) / len(right) > 0.95
    # copies that have no label score as their originals do
    text = {i: t for i, t, *_ in small[1]}
    by_text = collections.defaultdict(set)
    for i in got:
        by_text[text[i] or ""].add(got[i]["score"])
    assert all(len(x) == 1 for x in by_text.values())


def test_op9(spark, small):
    docs = spark.read.parquet(f"{small[0]}/documents.parquet")
    labels = spark.read.parquet(f"{small[0]}/labels.parquet")
    want = brute_quality(docs, labels, small[1], 0.998, 600)
    got = {r["doc_id"]: r for r in run(spark, small, "op9_quality").collect()}
    for i, (perplexity, x, bar) in want.items():
        assert math.isclose(got[i]["perplexity"], perplexity, rel_tol=1e-3), i
        if abs(x - bar) > 1e-3:
            assert got[i]["keep"] == (x <= bar), i


def test_op10(spark, small):
    got = {r["doc_id"]: r for r in run(spark, small, "op10_mix").collect()}
    sizes, taken, largest = collections.Counter(), collections.Counter(), collections.Counter()
    for i, t, _, s in small[1]:
        n = len((t or "").split())
        assert got[i]["size"] == n and got[i]["taken"] in (0, n, 2 * n)
        sizes[s] += n
        taken[s] += got[i]["taken"]
        largest[s] = max(largest[s], n)
    want = brute_targets(sizes)
    for i, _, _, s in small[1]:
        assert got[i]["source_size"] == sizes[s] and math.isclose(got[i]["target"], want[s], rel_tol=1e-9)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6, s
    again = {r["doc_id"]: r["taken"] for r in run(spark, small, "op10_mix").collect()}
    assert again == {i: r["taken"] for i, r in got.items()}


def test_vocabulary_is_a_parameter(spark, small):
    assert queries.VOCABULARY == VOCABULARY and brute_lm and labelled and F
    a = queries.op7_lm_score(spark, small[0], vocabulary=VOCABULARY)
    assert a.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
