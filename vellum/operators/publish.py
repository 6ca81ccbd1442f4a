"""Content-addressed snapshots: build, validate, publish, verify, audit, history.

Rows are produced by Spark in key order and streamed through the driver into compressed JSON lines in
any Hadoop file system; the driver holds the rows of one partition at a time, and hashes what it wrote
by reading it back in parts. A snapshot is two payloads named by their digest and a
manifest; the same content is published once.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from itertools import chain

import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import records as R
from vellum.operators import joins
from vellum.scratch import Folder

SCHEMA_VERSION, LEVEL, MANIFEST = 2, 19, "manifest.json"
WORK_FIELDS = ["work_id", "doi", "title", "venue", "year", "authors", "quality", "quality_source", "study_type", "evidence_grade"]


class SnapshotError(ValueError):
    """A snapshot breaks an invariant."""


def live_works(works: DataFrame, findings: DataFrame) -> DataFrame:
    """Works that ship: a kept text, a quality and at least one finding."""
    ok = works.filter((F.col("status") == "kept_text") & F.col("quality").isNotNull())
    return ok.join(findings.select("work_id").distinct(), "work_id", "left_semi").withColumn("authors", R.authors(F.col("authors"))).select(*WORK_FIELDS)


def live_findings(works: DataFrame, findings: DataFrame, chunks: DataFrame) -> DataFrame:
    """Findings of shipped works with their anchors; the section is the passage's."""
    ok = works.filter((F.col("status") == "kept_text") & F.col("quality").isNotNull()).select("work_id")
    c = chunks.select(F.col("chunk_id").alias("anchor_chunk_id"), "section")
    anchor = F.struct(F.col("anchor_chunk_id").alias("chunk_id"), "section", "char_start", "char_end", "quote")
    return findings.join(c, "anchor_chunk_id").join(ok, "work_id").select("finding_id", "work_id", "claim", "caveats", anchor.alias("anchor"))


def cards(works: DataFrame, findings: DataFrame) -> DataFrame:
    """Live findings as a client holds them: the claim with its caveats, and the work's quality and title."""
    return findings.select("finding_id", "work_id", "claim", "caveats").join(works.select("work_id", "quality", "title"), "work_id").select("finding_id", "work_id", "claim", "caveats", "quality", "title")


def violations(works: DataFrame, findings: DataFrame) -> DataFrame:
    """rule, key: every breach of what a snapshot promises."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    twice = lambda df, k, rule: df.groupBy(k).count().filter("count > 1").select(F.lit(rule).alias("rule"), F.col(k).alias("key"))
    out = [
        twice(works, "work_id", "work repeats"),
        twice(findings, "finding_id", "finding repeats"),
        works.filter(~F.coalesce(F.col("quality").between(0, 1), F.lit(False))).select(F.lit("quality out of range"), "work_id"),
        works.filter(blank("quality_source")).select(F.lit("no quality source"), "work_id"),
        findings.filter(blank("claim") | blank("caveats") | blank("anchor.quote")).select(F.lit("blank field"), "finding_id"),
        findings.join(works, "work_id", "left_anti").select(F.lit("parent not shipped"), "finding_id"),
        works.join(findings, "work_id", "left_anti").select(F.lit("work without findings"), "work_id"),
    ]
    found = out[0]
    for part in out[1:]:
        found = found.union(part)
    return found


def dead_and_live(live: DataFrame, dead: DataFrame, key: str) -> DataFrame:
    """rule, key: tombstones of live rows, and repeated tombstones."""
    both = dead.join(live, key, "left_semi").select(F.lit("both live and dead").alias("rule"), F.col(key).alias("key"))
    return both.union(dead.groupBy(key).count().filter("count > 1").select(F.lit("tombstone repeats"), key))


def ship(ledger: DataFrame, live: DataFrame, kind: str, key: str, now: str) -> DataFrame:
    """Ledger rows for live keys that never shipped before."""
    fresh = live.select(F.lit(kind).alias("kind"), F.col(key).alias("row_id"))
    return fresh.join(ledger, ["kind", "row_id"], "left_anti").withColumn("first_shipped", F.lit(now))


def _lines(df: DataFrame) -> Iterator[bytes]:
    """Compact JSON lines with nulls, in the frame's order."""
    row = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    for r in df.select(row.alias("j")).toLocalIterator():
        yield json.dumps(json.loads(r["j"]), ensure_ascii=False, separators=(",", ":")).encode() + b"\n"


def compressed(lines: Iterable[bytes], sizes: list[int]) -> Iterator[bytes]:
    """The lines as one compressed stream, in parts; appends their bytes and their number to sizes."""
    press, n, rows = zstandard.ZstdCompressor(level=LEVEL).compressobj(), 0, 0
    for line in lines:
        n, rows = n + len(line), rows + 1
        if part := press.compress(line):
            yield part
    yield press.flush()
    sizes += [n, rows]


def expanded(parts: Iterable[bytes]) -> Iterator[bytes]:
    press = zstandard.ZstdDecompressor().decompressobj()
    for part in parts:
        yield press.decompress(part)


def digest(payloads: list[tuple[int, Iterable[bytes]]]) -> str:
    """Of the payloads' lengths and bytes; these come in parts of any size."""
    h = hashlib.sha256()
    for n, parts in payloads:
        h.update(n.to_bytes(8, "big"))
        for p in parts:
            h.update(p)
    return h.hexdigest()[:16]


def publish(out: str, works: DataFrame, findings: DataFrame, ledger: DataFrame, now: str, encoder: dict | None = None) -> dict:
    """Write a snapshot unless the manifest already names this content. Returns the manifest, `changed` and the new ledger rows."""
    folder = Folder(works.sparkSession, out)
    shipped = {k: ledger.filter(F.col("kind") == k).select(F.col("row_id").alias(key)) for k, key in (("work", "work_id"), ("finding", "finding_id"))}
    bad = violations(works, findings).take(5)
    dead_w, dead_f = joins.tombstones(shipped["work"], works, "work_id"), joins.tombstones(shipped["finding"], findings, "finding_id")
    bad += dead_and_live(works, dead_w, "work_id").union(dead_and_live(findings, dead_f, "finding_id")).take(5)
    if bad:
        raise SnapshotError("; ".join(f"{r['rule']}: {r['key']}" for r in bad))
    rows = {"works": (works.orderBy("work_id"), dead_w), "findings": (findings.orderBy("finding_id"), dead_f)}
    sizes: dict[str, list[int]] = {k: [] for k in rows}
    for k, (live, dead) in rows.items():
        folder.write(f"{k}.tmp", compressed(chain(_lines(live), _lines(dead)), sizes[k]))
    name = digest([(sizes[k][0], expanded(folder.read(f"{k}.tmp"))) for k in rows])
    files = {k: f"{k}-{name}.jsonl.zst" for k in rows}
    old = json.loads(b"".join(folder.read(MANIFEST))) if folder.exists(MANIFEST) else None
    if old and old["files"] == files and old["schema_version"] == SCHEMA_VERSION:
        for k in rows:
            folder.delete(f"{k}.tmp")
        return old | {"changed": False}
    for k, file in files.items():
        folder.rename(f"{k}.tmp", file)
    dead = {"works": dead_w.count(), "findings": dead_f.count()}
    manifest = {"schema_version": SCHEMA_VERSION, "bundle_id": f"{now[:16]}-{name}", "replaces": None, "created_at": now, "encoder": encoder or {}, "counts": {k: sizes[k][1] - dead[k] for k in rows}, "tombstones": dead, "files": files}
    folder.write(f"{MANIFEST}.tmp", [json.dumps(manifest, indent=1).encode()])
    folder.rename(f"{MANIFEST}.tmp", MANIFEST)
    new = ship(ledger, works, "work", "work_id", now).unionByName(ship(ledger, findings, "finding", "finding_id", now))
    return manifest | {"changed": True, "ledger": new}


def manifest_of(spark: SparkSession, out: str) -> dict:
    return json.loads(b"".join(Folder(spark, out).read(MANIFEST)))


def read(spark: SparkSession, out: str, kind: str, name: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Live rows and tombstones of a payload; of the current snapshot unless a digest is given."""
    file = f"{kind}-{name}.jsonl.zst" if name else manifest_of(spark, out)["files"][kind]
    df = spark.read.json(f"{out}/{file}")
    if "deleted" not in df.columns:
        df = df.withColumn("deleted", F.lit(None).cast("boolean"))
    gone = F.coalesce("deleted", F.lit(False))
    return df.filter(~gone).drop("deleted"), df.filter(gone)


def history(spark: SparkSession, out: str) -> list[str]:
    """Digests of complete pairs, oldest first."""
    found = Folder(spark, out).names()
    have = {k: {x[len(k) + 1 : -len(".jsonl.zst")]: t for x, t in found.items() if x.startswith(f"{k}-") and x.endswith(".jsonl.zst")} for k in ("works", "findings")}
    both = have["works"].keys() & have["findings"].keys()
    return sorted(both, key=lambda n: (max(have["works"][n], have["findings"][n]), n))


def verify(spark: SparkSession, out: str) -> dict:
    """The manifest, after its files were hashed, counted and validated again."""
    m, folder = manifest_of(spark, out), Folder(spark, out)
    payloads = [m["files"][k] for k in ("works", "findings")]
    try:
        name = digest([(sum(map(len, expanded(folder.read(f)))), expanded(folder.read(f))) for f in payloads])
    except zstandard.ZstdError as e:
        raise SnapshotError(f"a payload can't be read: {e}") from e
    if any(name not in f for f in m["files"].values()):
        raise SnapshotError("a payload was changed: its digest isn't its name's")
    for k, key in (("works", "work_id"), ("findings", "finding_id")):
        live, dead = read(spark, out, k)
        if (live.count(), dead.count()) != (m["counts"][k], m["tombstones"][k]):
            raise SnapshotError(f"the counts of {k} differ from the manifest's")
        if dead_and_live(live, dead, key).take(1):
            raise SnapshotError(f"{k} has rows that are live and dead")
    if bad := violations(read(spark, out, "works")[0], read(spark, out, "findings")[0]).take(3):
        raise SnapshotError(str(bad))
    return m


def audit(snapshot: DataFrame, table: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, problem: where a snapshot and the tables it came from have drifted apart."""
    d = joins.diff(snapshot, table, key, fields)
    each = F.when(F.col("state") == "vanished", F.array(F.lit("not in the table"))).when(F.col("state") == "added", F.array(F.lit("not in the snapshot"))).otherwise(F.transform("changed", lambda c: F.concat(F.lit("differs: "), c)))
    return d.select(key, F.explode(each).alias("problem"))


def audit_anchors(findings: DataFrame, chunks: DataFrame) -> DataFrame:
    """finding_id, problem: anchors whose passage is gone or doesn't hold the quote at its span."""
    c = chunks.select(F.col("chunk_id").alias("__c"), F.col("text").alias("__t"))
    j = findings.join(c, F.col("anchor.chunk_id") == F.col("__c"), "left")
    held = F.substring(F.col("__t"), F.col("anchor.char_start").cast("int") + 1, (F.col("anchor.char_end") - F.col("anchor.char_start")).cast("int"))
    why = F.when(F.col("__t").isNull(), "passage missing").when(held != F.col("anchor.quote"), "quote moved")
    return j.select("finding_id", why.alias("problem")).filter("problem is not null")
