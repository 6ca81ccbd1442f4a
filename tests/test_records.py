"""Record expressions, stores and joins on small fixtures."""

import pytest
from pyspark.sql import functions as F

from vellum.functions import records as R
from vellum.operators import joins, store
from vellum.sources import records


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_quality_spec(spark):
    rows = [(8, None, None), (7, None, 5), (None, 0.9, 2), (None, 0.4, None), (10, 0.1, 1), (0, None, 5), (None, None, 3)]
    df = spark.createDataFrame(rows, "r int, g double, e int")
    got = [x[0] for x in df.select(R.quality(F.col("r"), F.col("g"), F.col("e"))).collect()]
    assert got == [0.8, 0.532, 0.5837, 0.276, 1.0, 0.0, None]
    assert [x[0] for x in df.select(R.quality_source(F.col("r"), F.col("g"))).collect()] == ["judge", "judge", "gate", "gate", "judge", "judge", None]


def test_identifiers(spark):
    rows = [("W1", "10.1/a", "PMC1"), ("", "10.1/a", "PMC1"), (None, None, "PMC1"), (None, "", None)]
    df = spark.createDataFrame(rows, "o string, d string, p string")
    cid = R.canonical_id(F.col("o"), F.col("d"), F.col("p"))
    assert [r[0] for r in df.select(cid).collect()] == ["W1", "doi:10.1/a", "pmcid:PMC1", None]
    with pytest.raises(Exception, match="needs an OpenAlex id"):
        df.select(R.require_id(cid)).collect()
    assert one(spark, R.short_id(F.lit("https://x.org/W12")), R.norm_doi(F.lit("https://doi.org/10.1/AbC")))[:] == ("W12", "10.1/abc")


def test_study_type(spark):
    df = spark.createDataFrame([(["Editorial", "Network Meta-Analysis"],), (["Journal Article"],), ([],), (["case reports", "editorial"],)], "t array<string>")
    assert [r[0] for r in df.select(R.study_type(F.col("t"))).collect()] == ["meta_analysis", None, None, "case_report"]


def test_authors(spark):
    df = spark.createDataFrame([(None,), ("  ",), ('["A B", " C ", ""]',), ("A B; C D",), ("A B, C D.",)], "a string")
    assert [r[0] for r in df.select(R.authors(F.col("a"))).collect()] == [[], [], ["A B", "C"], ["A B", "C D"], ["A B", "C D."]]
    assert [r[0] for r in df.select(R.looked_up_authors(F.lit(None).cast("array<string>"), F.col("a"))).collect()][-1] == ["A B", "C D"]


def test_openalex_record(spark):
    raw = '{"id":"https://x.org/W9","doi":"https://doi.org/10.1/Q","display_name":" T ","publication_year":2020,"abstract_inverted_index":{"anxiety":[1],"Mindfulness":[0],"helps":[2]},"is_retracted":null}'
    r = records.from_openalex(spark.createDataFrame([(raw,)], "json string")).first()
    assert (r["work_id"], r["doi"], r["title"], r["is_oa"], r["is_retracted"], r["abstract"]) == ("W9", "10.1/Q", "T", False, False, "Mindfulness anxiety helps")


def test_epmc_record(spark):
    raw = ['{"pmcid":"PMC1","title":"T","pubYear":"2021","isOpenAccess":"Y","abstractText":"<h4>Background</h4>one <i>two</i>","pubTypeList":{"pubType":["Retracted Publication"]}}', '{"title":"no ids"}']
    rows = records.from_epmc(spark.createDataFrame([(x,) for x in raw], "json string")).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["work_id"], r["year"], r["is_oa"], r["is_retracted"], r["abstract"]) == ("pmcid:PMC1", 2021, True, True, "Background: one two")


def test_dedupe_is_greedy(spark):
    """a~b share a doi, b~c a pmcid: b goes, and c stays since a dropped record blocks nobody."""
    df = spark.createDataFrame([(1, "a", "d1", None), (2, "b", "d1", "p1"), (3, "c", None, "p1"), (4, "c", None, None), (5, "e", None, None)], "seq long, work_id string, doi string, pmcid string")
    assert sorted(r["seq"] for r in joins.candidates_deduped(df, "seq").collect()) == [1, 3, 5]


def test_seen_ignores_candidates(spark):
    works = spark.createDataFrame([("W1", "d1", None, "kept_text"), ("W2", "d2", None, "candidate")], "work_id string, doi string, pmcid string, status string")
    cands = spark.createDataFrame([(1, "X", "d1", None), (2, "Y", "d2", None), (3, "Z", None, None)], "seq long, work_id string, doi string, pmcid string")
    assert [r[0] for r in joins.seen(cands, works, "seq").collect()] == [1]


def test_migrate_is_idempotent(spark):
    df = spark.range(2).withColumnRenamed("id", "work_id")
    target = spark.createDataFrame([], "work_id long, venue string, quality double").schema
    once, added = store.migrate(df, target)
    assert added == ["venue", "quality"] and store.migrate(once, target)[1] == []


def test_replace_keys_and_stamp(spark):
    old = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "work_id string, idx int")
    new = spark.createDataFrame([("a", 9)], "work_id string, idx int")
    done = spark.createDataFrame([("a",), ("b",)], "work_id string")
    assert [tuple(r) for r in store.replace_keys(old, new, done, "work_id").collect()] == [("a", 9)]
    w = spark.createDataFrame([("a", None), ("c", None)], "work_id string, chunked_at string")
    assert {r[0]: r[1] for r in store.stamp(w, done, "chunked_at", F.lit("now")).collect()} == {"a": "now", "c": None}


def test_judgments_keep_the_publisher(spark):
    w = spark.createDataFrame([("W1", "rct", None, None, None, None), ("W2", None, None, None, None, None)], "work_id string, study_type string, relevance int, domain string, label_source string, label_confidence double")
    v = spark.createDataFrame([("W1", 8, "sleep", "cohort", 0.7), ("W2", 3, "pain", "opinion", 0.4)], "work_id string, relevance int, domain string, study_type string, confidence double")
    rows = {r["work_id"]: r for r in store.apply_verdicts(w, v, "model-a").collect()}
    assert (rows["W1"]["study_type"], rows["W1"]["label_source"], rows["W1"]["relevance"]) == ("rct", "publisher", 8)
    assert (rows["W2"]["study_type"], rows["W2"]["label_source"], rows["W2"]["label_confidence"]) == ("opinion", "model-a", 0.4)


def test_versioned_table(spark, tmp_path):
    t = store.Versioned(spark, str(tmp_path / "t"))
    with pytest.raises(FileNotFoundError):
        t.read()
    t.write(spark.range(3))
    before = t.read()
    t.write(before.union(spark.range(1)))
    assert (before.count(), t.read().count()) == (3, 4)


def test_whole_texts_are_rebuilt(spark):
    from vellum import catalog

    sf = "/root/testdata/sf0.001"
    want = {r["doc_id"]: " ".join(x for x in (r["text"] or "").split(" ") if x) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = catalog.QUERIES["rebuild_abstract_whole"](spark, sf).collect()
    assert {r["doc_id"]: r["rebuilt"] for r in got} == want
    assert max(len(r["rebuilt"].split(" ")) for r in got) > 5
