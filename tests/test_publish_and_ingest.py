"""Snapshots, the topic lifecycle, and the readers."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from vellum.operators import extract, joins, publish
from vellum.sources import files, paged
from vellum.streaming import lifecycle as L

WORK = "work_id string, doi string, title string, venue string, year int, authors string, status string, study_type string, evidence_grade int, quality double, quality_source string"
FINDING = "finding_id string, work_id string, claim string, caveats string, anchor_chunk_id string, char_start int, char_end int, quote string"


def corpus(spark, ids=("W1",), quality=0.8):
    w = spark.createDataFrame([(i, None, "T é", None, 2020, '["A B"]', "kept_text", "rct", 2, quality, "judge") for i in ids], WORK)
    f = spark.createDataFrame([(f"f_{i}", i, "a claim", "few", f"{i}#0", 0, 4, "body") for i in ids], FINDING)
    c = spark.createDataFrame([(f"{i}#0", i, 0, "results", "body text here", 3) for i in ids], "chunk_id string, work_id string, idx int, section string, text string, n_words int")
    return publish.live_works(w, f), publish.live_findings(w, f, c), c


EMPTY = "kind string, row_id string, first_shipped string"


def test_publish_verify_tombstone(spark, tmp_path):
    out = str(tmp_path)
    ledger = spark.createDataFrame([], EMPTY)
    works, found, chunks = corpus(spark, ("W1", "W2"))
    first = publish.publish(out, works, found, ledger, "2024-01-01T00:00")
    assert first["changed"] and first["counts"] == {"works": 2, "findings": 2}
    ledger = spark.createDataFrame(first["ledger"].collect(), EMPTY)
    assert not publish.publish(out, works, found, ledger, "2024-01-02T00:00")["changed"]
    assert publish.verify(spark, out)["files"] == first["files"]
    live, dead = publish.read(spark, out, "works")
    assert live.filter("work_id = 'W1'").first()["venue"] is None and dead.count() == 0 and live.first()["authors"] == ["A B"]
    w1, f1, _ = corpus(spark)
    second = publish.publish(out, w1, f1, ledger, "2024-01-03T00:00")
    assert second["tombstones"] == {"works": 1, "findings": 1} and len(publish.history(spark, out)) == 2
    assert [r["work_id"] for r in publish.read(spark, out, "works")[1].collect()] == ["W2"]
    old, new = (publish.read(spark, out, "works", n)[0].select("work_id", "year") for n in (first["files"]["works"][6:22], second["files"]["works"][6:22]))
    assert {r["work_id"]: r["state"] for r in joins.diff(old, new, "work_id", ["year"], publish.read(spark, out, "works")[1]).collect()} == {"W1": "carried", "W2": "tombstoned"}
    assert publish.audit_anchors(publish.read(spark, out, "findings")[0], chunks).count() == 0
    assert publish.audit_anchors(publish.read(spark, out, "findings")[0], chunks.withColumn("text", F.lit("other"))).first()["problem"] == "quote moved"
    path = Path(out) / second["files"]["works"]
    other = Path(out) / first["files"]["works"]
    path.write_bytes(other.read_bytes())
    with pytest.raises(publish.SnapshotError):
        publish.verify(spark, out)


def test_violations_stop_a_snapshot(spark, tmp_path):
    works, found, _ = corpus(spark, quality=1.5)
    with pytest.raises(publish.SnapshotError, match="quality out of range"):
        publish.publish(str(tmp_path), works, found, spark.createDataFrame([], EMPTY), "2024-01-01T00:00")


class Broken(OSError):
    def __init__(self, status=None):
        super().__init__("broken")
        self.status = status


def raises(e):
    def f(*_):
        raise e

    return f


HELD = L.Sweep("a1", "b1", "2020-01-01")


@pytest.mark.parametrize(
    ("discover", "process", "expand", "want"),
    [
        (raises(Broken(404)), len, lambda: None, (None, None, "2020-01-01")),
        (raises(Broken(429)), len, lambda: None, ("a1", "b1", "2020-01-01")),
        (raises(Broken()), len, lambda: None, ("a1", "b1", "2020-01-01")),
        (lambda s: ([1], ("a2", None)), raises(Broken()), lambda: None, ("a1", "b1", "2020-01-01")),
        (lambda s: ([1], ("a2", None)), len, raises(Broken()), ("a2", None, "2020-01-01")),
        (lambda s: ([1], ("a2", None)), len, lambda: None, ("a2", None, "2020-01-01")),
        (lambda s: ([1], (None, None)), len, lambda: None, (None, None, "2024-05-05")),
        (lambda s: ([1], (None, None)), len, raises(Broken()), (None, None, "2020-01-01")),
    ],
)
def test_sweep(discover, process, expand, want):
    got = L.run_pass(HELD, "2024-05-05", discover, process, expand)
    assert (got.openalex_cursor, got.epmc_cursor, got.watermark) == want and got.status == "done"


TOPIC = "id int, name string, query string, openalex_id string, status string, added_by string, last_crawled_at string, watermark string, openalex_cursor string, epmc_cursor string"


def test_claims(spark):
    rows = [(1, "a", "a", None, "done", "m", "2024-01-01", "2024-01-01", None, None), (2, "b", "b", None, "pending", "m", None, None, None, None), (3, "c", "c", None, "done", "m", "2024-03-01", None, None, None), (4, "d", "d", None, "done", "m", "2024-03-02", "2024-01-01", None, "x"), (5, "e", "e", None, "active", "m", None, None, None, None)]
    t = spark.createDataFrame(rows, TOPIC)
    order = []
    while (r := L.claim_next_topic(t, F.lit("2024-02-01")).first()) is not None:
        order.append(r["id"])
        t = t.filter(F.col("id") != r["id"])
    assert order == [2, 1, 3, 4]
    assert L.recover(spark.createDataFrame(rows, TOPIC)).filter("status = 'pending'").count() == 2


def test_topic_sync(spark):
    t = spark.createDataFrame([(1, "a", "old", None, "done", "m", None, "2024-01-01", "c", None)], TOPIC)
    lines = spark.createDataFrame([("# Topics",), ("- a (T12) :: new query",), ("- b",), ("text",)], "line string")
    wanted = files.topics(lines)
    assert {(r["name"], r["openalex_id"], r["query"]) for r in wanted.collect()} == {("a", "T12", "new query"), ("b", None, None)}
    got = {r["name"]: r for r in L.sync_topics(t, wanted).collect()}
    assert (got["a"]["query"], got["a"]["watermark"], got["a"]["openalex_cursor"]) == ("new query", None, None)
    assert (got["b"]["id"], got["b"]["status"], got["b"]["query"]) == (2, "pending", "b")


CAND = "seq long, work_id string, openalex_id string, doi string, pmcid string, title string, is_oa boolean, is_retracted boolean, pub_types array<string>"
STORED = "work_id string, openalex_id string, doi string, pmcid string, title string, status string, reject_reason string, study_type string, evidence_grade int, text_source string"


def test_process_candidates(spark):
    works = spark.createDataFrame([("W9", "W9", "10.1/z", None, "t", "kept_text", None, None, None, None), ("W1", "W1", None, None, "old", "candidate", None, None, None, None)], STORED)
    rows = [(1, "W1", "W1", "10.1/A", None, "new", True, False, ["Randomized Controlled Trial"]), (2, "W2", "W2", "10.1/b", "PMC2", "t", True, True, []), (3, "W3", "W3", None, None, "t", False, False, []), (4, "X", None, "10.1/z", None, "t", True, False, []), (5, "W1", None, None, "PMC7", "again", True, False, [])]
    pm = spark.createDataFrame([("10.1/a", "PMC1")], "doi string, pmcid string")
    bucket = spark.createDataFrame([("PMC5", "x")], "pmcid string, text string")
    xml = spark.createDataFrame([("PMC1", "body")], "pmcid string, text string")
    got = {r["work_id"]: r for r in L.process(works, spark.createDataFrame(rows, CAND), pm, bucket, xml).collect()}
    assert set(got) == {"W9", "W1", "W2", "W3"}
    assert (got["W1"]["status"], got["W1"]["pmcid"], got["W1"]["study_type"], got["W1"]["evidence_grade"], got["W1"]["title"]) == ("kept_text", "PMC1", "rct", 2, "old")
    assert got["W2"]["status"] == "retracted" and (got["W3"]["status"], got["W3"]["reject_reason"]) == ("rejected", "not_open_access") and got["W9"]["status"] == "kept_text"
    dup, rest = L.drain_deferred(works, spark.createDataFrame(rows, CAND).withColumns({"status": F.lit("candidate"), "reject_reason": F.lit(None).cast("string")}))
    assert [r["seq"] for r in dup.collect()] == [4] and rest.count() == 4


def test_paged_source(spark, tmp_path):
    spark.dataSource.register(paged.PagedSource)
    opts = {"fetch": "tests.fixtures_pages:fetch", "base": "http://x", "topic": "T1"}
    rows = spark.read.format("paged").options(**opts).load().collect()
    assert [json.loads(r[0])["id"] for r in rows] == list("abcd")
    from tests.fixtures_pages import fetch

    one, nxt = paged.walk(fetch, lambda c: paged.works_url("http://x", "T1", None, c, 2), "works", None, 2)
    assert [r["id"] for r in one] == list("abc") and nxt == "c3"
    assert paged.page("search", {"resultList": {"result": [1]}, "nextCursorMark": "m"}, "m")[1] is None
    assert "from_publication_date%3A2024-01-01" in paged.works_url("http://x", "T1", "2024-01-01", "*", 2)
    assert "FIRST_IDATE" in paged.search_url("http://x", "sleep", "2024-01-01", "*", 5) and "doi%3A10.1%2Fa" in paged.doi_filter_url("http://x", ["https://doi.org/10.1/A"])


def test_retries():
    calls = []

    def fetch(url):
        calls.append(url)
        if len(calls) < 3:
            raise paged.StatusError(503, url)
        return {"id": 1}

    assert paged.retrying(fetch, sleep=lambda s: None)("u") == {"id": 1} and len(calls) == 3
    with pytest.raises(paged.StatusError):
        paged.retrying(raises(paged.StatusError(400, "u")), sleep=lambda s: None)("u")
    assert paged.by_id(raises(paged.StatusError(404, "u")), "u") is None


def test_files(spark, tmp_path):
    (tmp_path / "q.txt").write_text("# note\n\nsleep\n pain \n")
    assert [tuple(r) for r in files.queries(spark, str(tmp_path / "q.txt")).orderBy("qid").collect()] == [(1, "sleep"), (2, "pain")]
    (tmp_path / "j.tsv").write_text("q\tid\tr\n1\ta\t1\n1\ta\t0\n1\tb\t?\n2\tc\t1\n")
    assert {(r[0], r[1]): r[2] for r in files.judgments(spark, str(tmp_path / "j.tsv"), strict=True).collect()} == {(1, "a"): 0, (2, "c"): 1}
    df = spark.createDataFrame([("W1", None)], "work_id string, title string")
    assert files.write_jsonl(df, str(tmp_path / "out")) == 1
    assert files.jsonl(spark, str(tmp_path / "out"), "work_id string, title string").first()["title"] is None
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts" / "W1.txt").write_text("body")
    works = spark.createDataFrame([("W1", "/data/W1.txt"), ("W2", "/data/W2.txt")], "work_id string, text_path string")
    assert {r[0]: r[1] for r in files.heads(works, files.texts(spark, str(tmp_path / "texts"))).collect()} == {"W1": "body", "W2": None}
    xml = spark.createDataFrame([('<L xmlns="http://x"><C><Key>a/b.xml</Key></C><C><Key>a/b.txt</Key></C></L>',)], "xml string")
    assert files.object_keys(xml, ".txt").first()["key"] == "a/b.txt"
    assert files.file_digest(spark, str(tmp_path / "texts")).count() == 1


def test_stream_sink_is_idempotent(spark, tmp_path):
    src = tmp_path / "in"
    spark.range(3).selectExpr("cast(id as string) work_id").write.json(str(src))
    seen = []
    q = L.ingest(spark.readStream.schema("work_id string").json(str(src)), lambda df, n: seen.extend(r[0] for r in df.collect()), str(tmp_path / "ck"))
    q.awaitTermination(60)
    L.ingest(spark.readStream.schema("work_id string").json(str(src)), lambda df, n: seen.extend(r[0] for r in df.collect()), str(tmp_path / "ck")).awaitTermination(60)
    assert sorted(seen) == ["0", "1", "2"]


def test_prompts(spark):
    df = spark.createDataFrame([(0, "A", 2020, "x" * 2000), (1, "B", None, None), (2, "C", 1999, "y")], "pos long, title string, year int, abstract string")
    got = [r["prompt"] for r in extract.paper_prompts(df, 2).orderBy("batch_id").collect()]
    assert got[0].count("x") == 1500 and "Year: unknown\nAbstract: (missing)" in got[0] and got[1].startswith("Paper 1\nTitle: C")
