"""Ranking, vectors, metrics, sampling and distillation."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum import catalog
from vellum.operators import distill, lexical, metrics, rank, sampling, vector
from vellum.operators.stem import stem


def test_rrf_and_union(spark):
    rows = [(1, arm, r + 1, d) for arm, docs in enumerate(("abc", "cda")) for r, d in enumerate(docs)]
    df = spark.createDataFrame(rows, "qid long, arm int, rank int, doc string")
    assert [r["doc"] for r in rank.rrf(df, 10).orderBy("rank").collect()] == ["a", "c", "b", "d"]
    assert [r["doc"] for r in rank.union(df).orderBy("pos").collect()] == ["a", "b", "c", "d"]
    scored = spark.createDataFrame([(1, 0, "a", 0.1), (1, 1, "b", 0.9), (1, 2, "d", 0.9)], "qid long, pos int, doc string, score double")
    assert [r["doc"] for r in rank.top_k(scored, 2).orderBy("rank").collect()] == ["b", "d"]


DOCS = [("W1#0", "sleep quality improved with melatonin and regular sleep"), ("W2#0", "chronic back pain and exercise"), ("W3#0", "melatonin dosing in children")]


def test_bm25_ranks(spark):
    docs = spark.createDataFrame(DOCS, "id string, text string")
    q = spark.createDataFrame([(1, "melatonin sleep"), (2, "back pain"), (3, "of in"), (4, "zebra")], "qid long, query string")
    for stemmed in (False, True):
        idx = lexical.index(docs, "id", "text", stemmed)
        got = lexical.search(idx, q, 2, stemmed).orderBy("qid", "rank").collect()
        assert [(r["qid"], r["doc"]) for r in got] == [(1, "W1#0"), (1, "W3#0"), (2, "W2#0")]
        assert lexical.indexed(idx) == 3
    twice = spark.createDataFrame([(1, "pain"), (2, "pain pain")], "qid long, query string")
    a, b = (r["score"] for r in lexical.search(lexical.index(docs, "id", "text"), twice, 1).orderBy("qid").collect())
    assert b == pytest.approx(2 * a, abs=1e-5)


@pytest.mark.parametrize("stemmed", [False, True])
def test_bm25_shuffles_neither_words_nor_scores(spark, stemmed):
    """Every score against its definition, and only the best rows of a partition are exchanged."""
    rng = np.random.default_rng(4)
    vocab = ["sleep", "sleeping", "sleeps", "relation", "relational", "pain", "pains", "é", "of", "x1", "common"]
    rows = [(i, " ".join(rng.choice(vocab, rng.integers(1, 40)))) for i in range(200)] + [(500, None), (501, ""), (502, "Common")]
    asked = [(1, "sleeping pains common common"), (2, "relational sleep of"), (3, "nowhere"), (4, None), (5, "common")]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(3)
    queries = spark.createDataFrame(asked, "qid long, query string")
    words = {i: [stem(w) if stemmed else w for w in re.findall("[a-z0-9]+", t.lower())] for i, t in rows if t is not None}
    mean = sum(map(len, words.values())) / len(words)
    want = {}
    for qid, q in asked:
        scores = {}
        for w in re.findall("[a-z0-9]{3,}", q or ""):
            w = stem(w) if stemmed else w
            df = sum(w in x for x in words.values())
            idf = max(np.log((len(rows) - df + 0.5) / (df + 0.5)), 0) or 1e-6
            for i, x in words.items():
                if tf := x.count(w):
                    scores[i] = scores.get(i, 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(x) / mean))
        for n, (i, v) in enumerate(sorted(scores.items(), key=lambda y: (-round(y[1], 6), y[0]))[:7]):
            want[qid, n + 1] = (i, pytest.approx(v, abs=1e-6))
    for limit in (1 << 20, 1):
        out = lexical.search(lexical.index(docs, "id", "text", stemmed), queries, 7, stemmed, max_query_bytes=limit)
        assert {(r["qid"], r["rank"]): (r["doc"], r["score"]) for r in out.collect()} == want
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(qid" in plan and not re.search(r"hashpartitioning\((term|doc|qid#\w+, doc)", plan)
        assert "Generate" not in plan


def test_judgments_are_all_pairs_that_hold_the_head(spark, tmp_path):
    """Also heads without a long word of ASCII letters, heads within longer words, short and empty heads."""
    queries = ["Adoja del y es de ueómi los", "Reoi èréque par pas enle éauxê", "de ue", "", None, "elephant", "x" * 59 + "yz", "x" * 60 + "no"]
    texts = ["¿Adoja del y es de ueómi los que?", "éauxê Reoi èréque par pas enle éauxê", "two elephants, de ue", "", None, "x" * 60, "Adoja del y", "y" + "x" * 61, "Adoja del y es de ueómi los elephant " * 99]
    spark.createDataFrame(list(enumerate(queries)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {(i + 1, j) for i, q in enumerate(queries) for j, t in enumerate(texts) if q is not None and t is not None and q[:60] in t}
    got = catalog.V.judged(spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {(r["qid"], r["doc"]) for r in got} == want
    q = spark.createDataFrame([(str(i), q) for i, q in enumerate(queries)], "qid string, phrase string")
    d = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, text string")
    small = lexical.holding(d, q, "id", "text", max_phrase_bytes=100).collect()
    whole = {(str(i), str(j)) for i, q in enumerate(queries) for j, t in enumerate(texts) if q is not None and t is not None and q in t}
    assert len(small) == len(whole) and {tuple(r) for r in small} == whole
    assert lexical.holding(d, q.limit(0), "id", "text").count() == 0


def unit(n, dim, seed):
    v = np.random.default_rng(seed).normal(size=(n, dim))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_backends_find_a_stored_vector(spark):
    v = unit(200, 16, 1)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(3)
    q = df.filter("vec_id < 12").select(F.col("vec_id").alias("qid"), "embedding")
    exact = vector.topk(df, q, 5)
    for got in (exact, vector.topk(df, q, 5, by="distance"), vector.ivf(df, q, 5, probes=4, cells=10)):
        assert all(r["qid"] == r["vec_id"] for r in got.filter("rank = 1").collect())
    keys = lambda d: sorted((r["qid"], r["rank"], r["vec_id"]) for r in d.collect())
    assert keys(exact) == keys(vector.topk(df, q, 5, max_query_bytes=300))
    assert vector.recall(vector.ivf(df, q, 5, probes=10, cells=10), exact).first()["recall"] == 1.0
    assert vector.recall(vector.ivf(df, q, 5, probes=5, cells=10), exact).first()["recall"] >= 0.5
    assert [r["vec_id"] for r in vector.topk_one(df, v[3].tolist(), 2).collect()][0] == 3


def test_ivf_recall_at_production_parameters(spark):
    sf = "/root/testdata/sf0.001"
    assert vector.recall(catalog.QUERIES["ivf_probe"](spark, sf), catalog.QUERIES["knn_batch"](spark, sf)).first()["recall"] >= 0.9
    assert catalog.QUERIES["ivf_recall"](spark, sf).first()["recall"] >= 0.9


def test_hybrid_has_a_dense_arm(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids, encode = list(docs), vector.hash_encoder(64)
    v = encode([docs[i] for i in ids]).astype(np.float32).astype(float)
    arms = catalog._hybrid(spark, sf).persist()
    got = arms.filter("arm = 1").collect()
    q = catalog.V.queries(spark, sf).collect()
    assert len(got) == len(q) * min(50, len(ids))
    for r in q:
        s = np.round(v @ encode([r["query"]])[0].astype(np.float32).astype(float), 6)
        want = sorted(zip(-s, ids, strict=True))[:50]
        mine = sorted((x["rank"], x["doc"]) for x in got if x["qid"] == r["qid"])
        assert [-s[ids.index(d)] for _, d in mine] == pytest.approx([x for x, _ in want], abs=2e-6)
    assert arms.filter("arm = 0 and rank > 10").count() > 0
    found = {(r["qid"], r["doc"]) for r in rank.union(arms).collect()}
    top = catalog.QUERIES["rerank_topk"](spark, sf).collect()
    assert top and {(r["qid"], r["doc"]) for r in top} <= found


def test_synthetic(spark):
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(unit(10, 8, 2))], "vec_id long, embedding array<float>")
    out = vector.synthetic(df, 25).collect()
    assert len(out) == 25 and vector.synthetic(df, 4).count() == 4
    first = {r["vec_id"]: r["embedding"] for r in out if r["copy"] == 0}
    for r in out:
        assert abs(np.linalg.norm(r["embedding"]) - 1) < 1e-6
        assert (r["copy"] == 0) == np.allclose(r["embedding"], first[r["vec_id"]])


def test_pool(spark):
    df = spark.createDataFrame([([[3.0, 4.0], [0.0, 0.0]], [1.0, 0.0]), ([[2.0, 0.0], [4.0, 0.0], [9.0, 9.0]], [1.0, 1.0, 0.0])], "h array<array<double>>, m array<double>")
    assert [np.round(r[0], 6).tolist() for r in df.select(vector.pool(F.col("h"), F.col("m"))).collect()] == [[0.6, 0.8], [1.0, 0.0]]
    assert np.round(df.select(vector.pool(F.col("h"), F.col("m"), "cls")).first()[0], 6).tolist() == [0.6, 0.8]


def test_embed_keeps_order_and_rerank_ties(spark):
    texts = ["a much longer text here", "b", None, "cc dd"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    enc = vector.hash_encoder(8)
    got = {r["id"]: r["embedding"] for r in vector.embed(df, enc, "id", "text", batch=2).collect()}
    assert all(np.allclose(got[i], enc([t or ""])[0]) for i, t in enumerate(texts))
    pairs = spark.createDataFrame([(1, 2, "x", "sleep", "no"), (1, 1, "y", "sleep", "no"), (1, 3, "z", "sleep", "sleep well")], "qid long, pos int, doc string, query string, text string")
    assert [r["doc"] for r in vector.rerank(pairs, vector.overlap_scorer, 3).orderBy("rank").collect()] == ["z", "y", "x"]


@pytest.mark.parametrize(("score", "auc"), [([0.5] * 4, 0.5), ([0.1, 0.2, 0.8, 0.9], 1.0), ([0.9, 0.8, 0.2, 0.1], 0.0)])
def test_auc(spark, score, auc):
    df = spark.createDataFrame(list(zip([0, 0, 1, 1], score, strict=True)), "truth int, score double")
    assert metrics.roc_auc(df).first()["auc"] == auc
    assert metrics.roc_auc(df.filter("truth = 1")).first()["auc"] == 0.5


def test_f1_and_thresholds(spark):
    df = spark.createDataFrame([(0, 0, 0.1), (0, 1, 0.6), (1, 1, 0.7), (1, 1, 0.9)], "truth int, pred int, prob double")
    r = {x["name"]: x for x in metrics.per_class(df).collect()}[1]
    assert (r["precision"], r["recall"], r["f1"], r["support"]) == (0.666667, 1.0, 0.8, 2)
    assert {x["threshold"]: x["precision"] for x in metrics.thresholds(df).collect()}[0.7] == 1.0


def test_precision_counts_unjudged(spark):
    hits = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "qid long, doc string, rank int")
    j = spark.createDataFrame([(1, "a", 1), (1, "b", 0)], "qid long, doc string, relevant int")
    q = spark.createDataFrame([(1,), (2,)], "qid long")
    r = metrics.precision_at(hits, j, q, 3).first()
    assert tuple(r) == (2, 0.166667, 0.166667, 1, 1)
    lines = {x["doc"]: x["relevant"] for x in metrics.unjudged(hits.withColumn("score", F.lit(0.5)), j).collect()}
    assert lines["c"] == "?"


def test_agreement(spark):
    cols = "work_id string, relevance int, domain string, study_type string"
    a = spark.createDataFrame([("W1", 8, "sleep", "rct"), ("W2", 2, "pain", "rct")], cols)
    b = spark.createDataFrame([("W1", 8, "sleep", "rct"), ("W2", 8, "pain", "rct"), ("W3", 1, "x", None)], cols)
    r = metrics.agreement(a, b).first()
    assert (r["n"], r["mean_abs_diff"], r["within_1"], r["keep_agreement"], r["study_type_agreement"]) == (2, 3.0, 0.5, 0.5, 1.0)
    assert [x[0] for x in metrics.disagreements(a, b).collect()] == ["W2"]
    assert metrics.agreement(a.limit(0), b).first()["n"] == 0


def test_allocation(spark):
    def take(sizes, n, floor):
        df = spark.createDataFrame(list(sizes.items()), "s string, size long")
        return {r["s"]: r["take"] for r in sampling.allocation(df, "s", n, floor).collect()}

    sizes = {"big": 1000, "mid": 300, "tiny": 3}
    got = take(sizes, 1000, 20)
    assert got["tiny"] == 3 and sum(got.values()) == 1000 and all(got[s] <= n for s, n in sizes.items())
    assert got["big"] == 20 + round(957 * 980 / 1260)
    assert take({"a": 5}, 100, 2) == {"a": 5} and take({}, 5, 1) == {} and take(sizes, 0, 2) == {"big": 2, "mid": 2, "tiny": 2}


def test_samples_repeat_and_prefixes_spread(spark):
    df = spark.createDataFrame([(f"W{i}", f"s{i % 4}") for i in range(400)], "work_id string, stratum string")
    a = sampling.stratified(df, "stratum", "work_id", 80)
    assert sorted(r["work_id"] for r in a.collect()) == sorted(r["work_id"] for r in sampling.stratified(df.repartition(5), "stratum", "work_id", 80).collect())
    assert len({r["stratum"] for r in a.orderBy("pos").limit(20).collect()}) == 4
    s = sampling.split(spark.createDataFrame([(i, int(i >= 80)) for i in range(100)], "id long, y int"), "y", "id")
    assert {(r["y"], r["n"]) for r in s.filter("is_test").groupBy("y").agg(F.count("*").alias("n")).collect()} == {(0, 16), (1, 4)}


def test_logistic_head(spark):
    v = unit(300, 6, 4)
    df = spark.createDataFrame([(i, x.tolist(), int(x[0] > 0)) for i, x in enumerate(v)], "id long, embedding array<float>, truth int")
    out = distill.task(df, "id")
    r = out["summary"].first()
    assert r["accuracy"] > 0.9 and r["auc"] > 0.95 and r["n"] == 60 and out["thresholds"].count() == 5
    curve = distill.learning_curve(df, "id", [40, 200], repeats=2)
    assert [c["n"] for c in curve] == [40, 200] and curve[-1]["auc"] > 0.9
