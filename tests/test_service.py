"""Passes over services, claim cards, probes and the command line."""

from pyspark.sql import functions as F

from vellum.__main__ import main
from vellum.operators import distill, metrics, publish, service, vector

ENCODE = vector.hash_encoder(32)


def test_failed_batches_are_deferred(spark):
    df = spark.createDataFrame([(f"W{i}", i) for i in range(30)], "work_id string, n long").coalesce(1)

    def lookup(rows):
        if any(r["n"] == 13 for r in rows):
            raise OSError("no service")
        return {r["work_id"]: "" if r["n"] == 4 else f"J{r['n']}" for r in rows if r["n"] % 2 == 0}

    got = {r["work_id"]: (r["venue"], r["state"]) for r in service.looked_up(df, lookup, "venue", batch=10).collect()}
    assert got["W2"] == ("J2", "found") and got["W3"] == got["W4"] == (None, "missing")
    assert {v for k, v in got.items() if 10 <= int(k[1:]) < 20} == {(None, "deferred")}
    works = df.select("work_id", F.lit(None).cast("string").alias("venue"), F.when(F.col("n") == 2, "kept").alias("venue_source"))
    filled = {r["work_id"]: (r["venue"], r["venue_source"]) for r in service.enrich(works, service.looked_up(df, lookup, "venue", batch=10), "venue", "epmc").collect()}
    assert filled["W6"] == ("J6", "epmc") and filled["W3"] == (None, "missing") and filled["W12"] == (None, None) and filled["W2"][1] == "kept"
    assert service.looked_up(df.limit(0), lookup, "venue").count() == 0


def test_replies_and_triage(spark):
    rows = [(0, '{"is_error": false, "result": "ok"}'), (1, '{"is_error": true, "result": "ok"}'), (2, '{"result": 5}'), (3, "broken"), (4, '{"result": "x"}'), (5, None)]
    got = spark.createDataFrame(rows, "i int, r string").select("i", service.reply_text(F.col("r")).alias("t")).collect()
    assert {r["i"]: r["t"] for r in got} == {0: "ok", 1: None, 2: None, 3: None, 4: "x", 5: None}
    papers = spark.createDataFrame([(i, f"T{i}", "  " if i == 1 else "abstract", ["Review"] if i == 2 else []) for i in range(10)], "pos int, title string, abstract string, pub_types array<string>")
    prompts = {r["batch_id"]: r for r in service.triage_prompts(papers, "Judge.").collect()}
    assert [prompts[b]["n"] for b in (0, 1)] == [8, 2] and prompts[1]["prompt"].startswith("Judge.\n\nTriage these papers:\n\nPaper 1\nTitle: T8")
    assert "(no abstract available)" in prompts[0]["prompt"] and "Publisher-declared types: Review" in prompts[0]["prompt"]
    one = '{"relevant": true, "study_type": "rct", "confidence": 0.5}'
    replies = spark.createDataFrame([(0, 1, f"```json\n[{one}]\n```"), (1, 2, f"[{one}]"), (2, 1, '[{"relevant": true, "study_type": "x", "confidence": 1}]'), (3, 1, "no")], "batch_id long, n int, reply string")
    assert [(r["batch_id"], r["place"], r["relevant"]) for r in service.triage_verdicts(replies, ["rct"]).collect()] == [(0, 0, True)]


def test_quota(spark):
    say = lambda used, at: f'{{"rate_limits": {{"five_hour": {{"used_percentage": {used}, "resets_at": {at}}}, "week": {{"used_percentage": 1}}}}}}'
    rows = [(0, say(90, 500), 1), (1, say(80, 500), 1), (2, say(90, 500), 9000), (3, "[]", 1), (4, None, 1), (5, say(90, 50), 1)]
    df = spark.createDataFrame(rows, "i int, s string, age int")
    got = {r["i"]: (r["w"], r["n"]) for r in df.select("i", service.quota_wait(F.col("s"), F.col("age"), F.lit(100.0)).alias("w"), service.next_reset(F.col("s"), F.lit(100.0)).alias("n")).collect()}
    assert got == {0: (460.0, 460.0), 1: (0.0, 460.0), 2: (0.0, 460.0), 3: (0.0, 1800.0), 4: (0.0, 1800.0), 5: (60.0, 18010.0)}


def test_reports(spark):
    df = spark.createDataFrame([("W1", 9, False, [], [], 1, 2, 3, 0.5, 1.0), ("W2", 9, False, [], [], 1, None, 3, 0.25, 2.0)], "work_id string, prompt_words int, truncated boolean, findings array<string>, drops array<string>, input_tokens int, output_tokens int, cache_read_tokens int, cost_usd double, seconds double")
    assert service.usage_total(df).first().asDict() == {"input_tokens": 2, "output_tokens": 2, "cache_read_tokens": 6, "cost_usd": 0.75, "seconds": 3.0}
    assert '"usage":{"input_tokens":1,"output_tokens":null' in [r[0] for r in service.report_lines(df).collect()][1]


def test_cards_cache_and_bench(spark, tmp_path):
    works = spark.createDataFrame([("W1", 0.5, "T"), ("W2", 0.9, "U")], "work_id string, quality double, title string")
    found = spark.createDataFrame([(f"f{i}", f"W{i % 3}", f"sleep claim number {i}", "c") for i in range(9)], "finding_id string, work_id string, claim string, caveats string")
    cards = publish.cards(works, found)
    assert cards.count() == 6
    asked = spark.createDataFrame([(0, "sleep claim number 4")], "qid long, query string")
    assert vector.rank_texts(cards, asked, ENCODE, 2, "finding_id", "claim").filter("rank = 1").first()["finding_id"] == "f4"
    path, calls = str(tmp_path / "cache"), spark.sparkContext.accumulator(0)

    def counted(texts):
        calls.add(len(texts))
        return ENCODE(texts)

    first = vector.embedded_once(found, counted, path, "finding_id", "claim")
    assert first.count() == 9 and calls.value == 9
    vector.embedded_once(found.withColumn("claim", F.when(F.col("finding_id") == "f1", "new").otherwise(F.col("claim"))), counted, path, "finding_id", "claim")
    assert calls.value == 10
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = vector.bench(v, v.limit(3).select(F.col("vec_id").alias("qid"), "embedding"), 3, 2, backends=["exact"])
    assert rows[0]["recall"] == 1.0 and rows[0]["p50"] <= rows[0]["p95"] and vector.order_statistics([3, 1, 2]) == (2, 3)
    df = spark.createDataFrame([("a", float(x)) for x in [5, 1, 2, 2, 9]] + [("b", 1.0), ("b", None)], "t string, v double")
    assert {r["t"]: (r["p50"], r["p95"]) for r in metrics.order_statistics(df, "t", "v").collect()} == {"a": (2.0, 9.0), "b": (1.0, 1.0)}


def test_pilot(spark):
    rows = [(f"W{i}", i % 10, "sleep" if i % 2 else "pain", [float(i % 10), float(i % 2)]) for i in range(200)]
    got = {r["task"]: r for r in distill.pilot(spark.createDataFrame(rows, "work_id string, relevance int, domain string, embedding array<double>"), "work_id")}
    assert set(got) == {"relevance>=5", "relevance>=7", "domain=pain", "domain=sleep"} and all(r["accuracy"] > 0.9 for r in got.values())


def test_commands(spark, tmp_path, capsys):
    store = tmp_path / "store"
    works = [(f"W{i}", None if i % 2 else 2001, "openalex", "kept_text") for i in range(20)]
    spark.createDataFrame(works, "work_id string, year int, discovered_via string, status string").write.parquet(str(store / "works.parquet"))
    chunks = [("c1", "sleep improves memory"), ("c2", "pain and relief"), ("c3", "running shoes"), ("c4", "cold weather"), ("c5", "warm milk")]
    spark.createDataFrame(chunks, "chunk_id string, text string").write.parquet(str(store / "chunks.parquet"))
    assert main(["status", "--store", str(store)]) == 0 and "20" in capsys.readouterr().out
    assert main(["sample", "--store", str(store), "--n", "7", "--floor", "2", "--out", str(tmp_path / "s")]) == 0
    assert spark.read.parquet(str(tmp_path / "s")).count() == 7
    assert main(["search", "--store", str(store), "--query", "memory sleep"]) == 0 and "c1" in capsys.readouterr().out
    assert main(["query", "--store", "/root/testdata/sf0.001", "--name", "status_message"]) == 0
