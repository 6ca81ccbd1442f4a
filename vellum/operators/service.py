"""Passes over a remote service or a model: batches, replies, usage, quota, deferral."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from vellum.functions import records as R
from vellum.functions import text as T

# Batch sizes, the share of a quota window that may be used, and times in seconds.
TRIAGE_BATCH, LOOKUP_BATCH, TRIAGE_ABSTRACT = 8, 50, 1500
CEILING, STALE_S, WINDOW_S, UNKNOWN_RESET_S, SLACK_S = 85.0, 1800, 5 * 3600, 1800.0, 60.0
USAGE = ("input_tokens", "output_tokens", "cache_read_tokens", "cost_usd", "seconds")


def reply_text(wrapped: Column) -> Column:
    """The result of a wrapped reply {is_error, result}; null for an error or anything but text."""
    w = F.from_json(wrapped, "struct<is_error:boolean,result:string>")
    is_text = F.try_variant_get(F.try_parse_json(wrapped), "$.result", "string").isNotNull() & F.schema_of_variant(F.try_parse_json(wrapped)).contains("result: STRING")
    return F.when(~F.coalesce(w["is_error"], F.lit(False)) & is_text, w["result"])


def triage_prompts(candidates: DataFrame, instructions: str, batch: int = TRIAGE_BATCH) -> DataFrame:
    """batch_id, n, prompt for candidates (pos, title, abstract, pub_types), batch at a time."""
    cut = F.substring(F.trim(F.coalesce("abstract", F.lit(""))), 1, TRIAGE_ABSTRACT)
    hint = F.when(F.size("pub_types") > 0, F.concat(F.lit("\nPublisher-declared types: "), F.array_join("pub_types", ", "))).otherwise("")
    block = F.concat(F.format_string("Paper %d\nTitle: %s\nAbstract: ", F.col("pos") % batch + 1, F.coalesce("title", F.lit(""))), F.when(cut == "", "(no abstract available)").otherwise(cut), hint)
    each = candidates.select(F.floor(F.col("pos") / batch).alias("batch_id"), F.struct("pos", block.alias("block")).alias("x"))
    made = each.groupBy("batch_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda s: s["block"]), "\n\n").alias("papers"))
    return made.select("batch_id", "n", F.concat(F.lit(instructions + "\n\nTriage these papers:\n\n"), "papers").alias("prompt"))


def triage_verdicts(replies: DataFrame, study_types: list[str]) -> DataFrame:
    """batch_id, place, relevant, study_type, evidence_grade, confidence. A reply of another length, or with an unknown type, gives none.

    replies: batch_id, n (papers asked about), reply (which may stand in fences).
    """
    v = F.from_json(T.strip_fences(F.col("reply")), "array<struct<relevant:boolean,study_type:string,confidence:double>>")
    df = replies.withColumn("v", v)
    whole = F.coalesce(F.forall("v", lambda x: x["study_type"].isin(study_types) & x["relevant"].isNotNull() & x["confidence"].isNotNull()), F.lit(False))
    good = df.filter(F.col("v").isNotNull() & (F.size("v") == F.col("n")) & whole)
    each = good.select("batch_id", F.posexplode("v").alias("place", "x"))
    return each.select("batch_id", "place", "x.relevant", "x.study_type", R.grade(F.col("x.study_type")).alias("evidence_grade"), "x.confidence")


def usage_total(reports: DataFrame) -> DataFrame:
    """The sums of the usage counters; a missing one counts as nothing."""
    return reports.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in USAGE])


def report_lines(results: DataFrame) -> DataFrame:
    """line: one JSON object for each work with its findings, drops and usage, nulls included."""
    return results.select(F.to_json(F.struct("work_id", "prompt_words", "truncated", "findings", "drops", F.struct(*USAGE).alias("usage")), {"ignoreNullFields": "false"}).alias("line"))


def status_counts(works: DataFrame) -> DataFrame:
    """with_text, total: what an hourly status message says."""
    return works.agg(F.count_if(F.col("status") == "kept_text").alias("with_text"), F.count("*").alias("total"))


def quota_wait(status: Column, age: Column, now: Column) -> Column:
    """Seconds to wait before more is spent: until the last of the overused windows resets; 0 for old or malformed status."""
    windows = F.map_values(F.from_json(status, "struct<rate_limits:map<string,struct<used_percentage:double,resets_at:double>>>")["rate_limits"])
    waits = F.transform(F.filter(windows, lambda w: F.coalesce(w["used_percentage"], F.lit(0.0)) > CEILING), lambda w: F.greatest(F.coalesce(w["resets_at"], F.lit(0.0)) - now, F.lit(0.0)) + SLACK_S)
    return F.when(age > STALE_S, F.lit(0.0)).otherwise(F.coalesce(F.array_max(waits), F.lit(0.0)))


def next_reset(status: Column, now: Column) -> Column:
    """Seconds until the five-hour window rolls over; a reset in the past is rolled forward by whole windows."""
    at = F.from_json(status, "struct<rate_limits:struct<five_hour:struct<resets_at:double>>>")["rate_limits"]["five_hour"]["resets_at"]
    late = F.greatest(F.ceil((now - at) / WINDOW_S), F.lit(0)) * WINDOW_S
    return F.coalesce(at + late - now + SLACK_S, F.lit(UNKNOWN_RESET_S))


def looked_up(pending: DataFrame, lookup: Callable[[list[dict]], dict[str, object]], value: str, kind: str = "string", batch: int = LOOKUP_BATCH, key: str = "work_id") -> DataFrame:
    """key, value and state (found, missing, deferred) for pending rows, asked batch by batch on the executors.

    lookup takes a batch of rows and returns what it knows by key; a batch that raises is deferred as a
    whole, so that its rows stay pending, and others go on.
    """
    schema = StructType([pending.schema[key], *StructType.fromDDL(f"`{value}` {kind}, state string").fields])
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in (b.to_pylist() for b in batches):
            for at in range(0, len(rows), batch):
                some = rows[at : at + batch]
                try:
                    known, other = lookup(some), "missing"
                except Exception:  # noqa: BLE001  whatever broke, the rows stay pending
                    known, other = {}, "deferred"
                got = [known.get(r[key]) for r in some]
                states = ["found" if x not in (None, "", []) else other for x in got]
                got = [x if s == "found" else None for x, s in zip(got, states, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([r[key] for r in some], kinds.field(0).type), pa.array(got, kinds.field(1).type), pa.array(states)], kinds.names)

    return pending.mapInArrow(run, schema)


def enrich(works: DataFrame, answers: DataFrame, value: str, source: str, key: str = "work_id") -> DataFrame:
    """works with value and its source filled from answers (of looked_up); rows that are deferred or were filled stay as they are."""
    done = answers.filter("state <> 'deferred'").select(key, F.col(value).alias("__v"), F.when(F.col("state") == "found", F.lit(source)).otherwise("missing").alias("__s"))
    j = works.join(done, key, "left")
    return j.withColumns({value: F.coalesce(value, "__v"), f"{value}_source": F.coalesce(f"{value}_source", "__s")}).drop("__v", "__s")
