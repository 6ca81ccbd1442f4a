"""Commands over folders of Parquet tables: python -m vellum COMMAND --store DIR ...

A store holds the tables that the operators read (works, abstracts, chunks, findings, texts, labels, ...), each
as DIR/NAME.parquet; results go to --out, or are shown. audit and diff exit with 1 where they find problems.
"""

from __future__ import annotations

import argparse
import datetime
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import clean, distill, joins, lexical, metrics, pending, publish, sampling, service, vector
from vellum.session import session

COMMANDS: dict[str, tuple[Callable, list[tuple[str, dict]]]] = {}


def command(*options: tuple[str, dict]):
    def add(fn: Callable) -> Callable:
        COMMANDS[fn.__name__.replace("_", "-")] = (fn, list(options))
        return fn

    return add


def opt(name: str, default=None, kind: type = str, **more) -> tuple[str, dict]:
    return name, {"default": default, "type": kind} | more


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")


@command(opt("--n", 200, int), opt("--floor", 20, int), opt("--seed", 7, int))
def sample(s: Store, a) -> DataFrame:
    """A stratified sample of the kept works."""
    from vellum.functions import records as R

    w = s.works.filter(F.col("status").startswith("kept")).withColumn("stratum", R.stratum(F.col("discovered_via"), F.col("status"), F.col("year")))
    return sampling.stratified(w.select("work_id", "stratum"), "stratum", "work_id", a.n, a.floor, a.seed)


@command(opt("--limit", None, int))
def judge_pending(s: Store, a) -> DataFrame:
    """Works that still need a judgment."""
    return pending.judge(s.works, limit=a.limit)


@command(opt("--papers", False, bool))
def abstracts(s: Store, a) -> DataFrame:
    """Works without an abstract, and how many abstracts each source gave."""
    return s.abstracts.groupBy("source").agg(F.count("*").alias("n"))


@command(opt("--target-tokens", clean.TARGET_TOKENS, int))
def chunk(s: Store, a) -> DataFrame:
    """Texts (work_id, text) to passages."""
    return clean.chunk(s.texts, "work_id", "text", a.target_tokens)


@command(opt("--dim", 64, int))
def embed(s: Store, a) -> DataFrame:
    """Vectors of the passages by the stand-in encoder."""
    return vector.embed(s.chunks, vector.hash_encoder(a.dim), "chunk_id", "text")


@command(opt("--query", required=True), opt("--k", 10, int))
def search(s: Store, a) -> DataFrame:
    """The best passages for a query by BM25."""
    asked = s.spark.createDataFrame([(0, a.query)], "qid long, query string")
    return lexical.search(lexical.index(s.chunks, "chunk_id", "text"), asked, a.k)


@command(opt("--k", 10, int), opt("--reps", 3, int))
def index_bench(s: Store, a) -> DataFrame:
    """Build time, latency and recall of the vector backends."""
    v = s.vectors
    return s.spark.createDataFrame(vector.bench(v, v.limit(20).select(F.col("chunk_id").alias("qid"), "embedding"), a.k, a.reps, "chunk_id"))


@command()
def compare(s: Store, a) -> DataFrame:
    """Agreement of two sets of verdicts."""
    return metrics.agreement(s.verdicts, s.other_verdicts)


@command(opt("--c", 1.0, float))
def distill_pilot(s: Store, a) -> DataFrame:
    """Held-out accuracy of the three tasks that could stand in for judgments."""
    return s.spark.createDataFrame(distill.pilot(s.judged, "work_id"))


@command()
def status(s: Store, a) -> DataFrame:
    """Works with text, and all of them."""
    return service.status_counts(s.works)


@command()
def venue_pending(s: Store, a) -> DataFrame:
    return pending.venue(s.works)


@command()
def authors_pending(s: Store, a) -> DataFrame:
    return pending.authors(s.works)


@command(opt("--days", 90, int))
def retractions_pending(s: Store, a) -> DataFrame:
    """Works whose retraction check is older than so many days."""
    return pending.retraction(s.works, F.lit(datetime.datetime.now() - datetime.timedelta(days=a.days)))


@command(opt("--bundle", required=True))
def bundle(s: Store, a) -> DataFrame:
    """Publish a snapshot; its new ledger rows are the result."""
    now = datetime.datetime.now().isoformat(timespec="minutes")
    works, findings = publish.live_works(s.works, s.findings), publish.live_findings(s.works, s.findings, s.chunks)
    made = publish.publish(a.bundle, works, findings, s.ledger, now)
    print(made["bundle_id"], "new" if made["changed"] else "unchanged")
    return made["ledger"] if made["changed"] else s.ledger.limit(0)


@command(opt("--bundle", required=True))
def bundle_verify(s: Store, a) -> DataFrame:
    m = publish.verify(s.spark, a.bundle)
    return s.spark.createDataFrame([(m["bundle_id"], *m["counts"].values())], "bundle_id string, works long, findings long")


@command(opt("--bundle", required=True), opt("--problems", True, bool, help=argparse.SUPPRESS))
def bundle_audit(s: Store, a) -> DataFrame:
    """Where a snapshot and its tables have drifted apart."""
    live = publish.live_works(s.works, s.findings)
    fields = [c for c in publish.WORK_FIELDS if c not in ("work_id", "authors")]
    return publish.audit(publish.read(s.spark, a.bundle, "works")[0].select("work_id", *fields), live.select("work_id", *fields), "work_id", fields)


@command(opt("--bundle", required=True), opt("--old", required=True), opt("--new", required=True), opt("--problems", True, bool, help=argparse.SUPPRESS))
def bundle_diff(s: Store, a) -> DataFrame:
    """Works that vanished between two snapshots without a tombstone."""
    (old, _), (new, dead) = (publish.read(s.spark, a.bundle, "works", n) for n in (a.old, a.new))
    return joins.diff(old, new, "work_id", ["year", "quality"], dead).filter("state = 'vanished'")


@command(opt("--bundle", required=True), opt("--query", required=True), opt("--k", 10, int))
def bundle_eval(s: Store, a) -> DataFrame:
    """The claim cards of a snapshot that are nearest to a query."""
    cards = publish.cards(publish.read(s.spark, a.bundle, "works")[0], publish.read(s.spark, a.bundle, "findings")[0])
    asked = s.spark.createDataFrame([(0, a.query)], "qid long, query string")
    return vector.rank_texts(cards, asked, vector.hash_encoder(64), a.k, "finding_id", "claim")


@command(opt("--name", required=True))
def query(s: Store, a) -> DataFrame:
    """A query of the catalogue over the store's tables."""
    from vellum import catalog

    return catalog.QUERIES[a.name](s.spark, s.path)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="vellum", description=__doc__)
    parser.add_argument("--master")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, (fn, options) in COMMANDS.items():
        p = sub.add_parser(name, help=fn.__doc__)
        p.add_argument("--store", required=True)
        p.add_argument("--out")
        for flag, how in options:
            p.add_argument(flag, **how)
    a = parser.parse_args(argv)
    result = COMMANDS[a.command][0](Store(session(a.master), a.store), a)
    if a.out:
        result.write.mode("overwrite").parquet(a.out)
    else:
        result.show(50, truncate=120)
    return int(getattr(a, "problems", False) and not result.isEmpty())


if __name__ == "__main__":
    sys.exit(main())
