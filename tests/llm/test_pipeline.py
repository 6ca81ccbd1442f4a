"""The pipeline on small data: its contract, and each stage against brute force over its own input."""

from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from vellum.llm import decontamination, quality_rules
from vellum.llm.oracles import ORACLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The documents before each stage, and what the last one returns."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / f"{i}")
        docs.write.parquet(path)
        out.append((name, path))
        docs = stage(spark, spark.read.parquet(path), SF)
    path = str(tmp_path_factory.mktemp("stage") / "last")
    docs.write.parquet(path)
    return dict(out) | {"out": path}


def oracle(name, path):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    out = con.sql(ORACLES[name])
    return [dict(zip(out.columns, row, strict=True)) for row in out.fetchall()]


def ids(spark, path):
    return Counter(r["doc_id"] for r in spark.read.parquet(path).select("doc_id").collect())


def test_stages(spark, steps):
    names = ["quality_rules", "near_dedup", "decontamination", "mixing", "sharding"]
    assert [name for name, _ in corpus_pipeline.STAGES] == names
    columns = spark.read.parquet(steps["quality_rules"]).columns
    for before, after in zip(names, names[1:], strict=False):
        a, b = spark.read.parquet(steps[before]), spark.read.parquet(steps[after])
        assert b.columns == columns
        assert 0 < b.count() <= (a.count() if before != "mixing" else 3 * a.count())


def test_quality_stage(spark, steps):
    docs = spark.read.parquet(steps["quality_rules"])
    base = {r["doc_id"] for r in oracle("rule_counts", steps["quality_rules"]) if r["base_failed"]}
    kept = ids(spark, steps["near_dedup"])
    assert not base & kept.keys()
    judged = quality_rules.judge(docs.select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet")).filter("kept")
    assert kept == Counter(r["doc_id"] for r in judged.collect())


def test_near_dedup_stage(spark, steps):
    want = Counter(r["doc_id"] for r in oracle("op2_bagminhash_dedup", steps["near_dedup"]) if r["kept"])
    assert ids(spark, steps["decontamination"]) == want


def test_decontamination_stage(spark, steps):
    hashed = lambda t: decontamination.word_hashes(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0]
    items = [hashed(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = Counter()
    for r in spark.read.parquet(steps["decontamination"]).select("doc_id", "text").collect():
        own = hashed(r["text"])
        # every item against every document; few shared words can't reach the score
        near = [i for i in items if len(i) and np.isin(i, own).mean() >= decontamination.MIN_SCORE]
        if not any(decontamination.align(i, own)[0] / (2 * len(i)) >= decontamination.MIN_SCORE for i in near):
            want[r["doc_id"]] += 1
    assert ids(spark, steps["mixing"]) == want


def test_mixing_stage(spark, steps):
    want = Counter({r["doc_id"]: r["copies"] for r in oracle("op4_pareto_mix", steps["mixing"]) if r["copies"]})
    assert ids(spark, steps["sharding"]) == want


def test_sharding_stage(spark, steps):
    got = spark.read.parquet(steps["out"])
    key = lambda r: (r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"])
    assert Counter(map(key, got.collect())) == Counter(map(key, oracle("op9_bounded_ring", steps["sharding"])))


def test_run(spark, steps):
    got = corpus_pipeline.run(spark, SF)
    assert got.exceptAll(spark.read.parquet(steps["out"])).count() == 0 and got.count() == spark.read.parquet(steps["out"]).count()
