"""Secret scans with multipart credential linking. DataFrame functions only.

Method. Three base kinds (assign, access, hex) are certain and always reported. Bare mixed-case
strings of 40 characters (kind `key`) and URLs or host:port pairs (kind `endpoint`) are weak: they
are reported only where a complementary part stands within `scope` characters in the same text. A
weak key needs an access identifier; a weak endpoint needs an access identifier or a base secret.

The interval join runs on (document, scope-wide bin). Certain parts are first reduced to their
least and largest start for each bin, so a weak part meets at most three rows a class however many
parts a text holds, and the answer is still exact: within a bin of width `scope` every part is in
reach, and of the neighbouring bins the nearest part decides.

Offsets count code points. Matches of one pattern are found by extracting them all and splitting
the text at them; a match starts after the pieces and matches before it. Sums of their lengths take
n log n steps for n matches, and a host has at most 253 characters, so long texts and long runs cost
no more than in proportion.

Defined results. Null text counts as empty and has no spans. Null keys are kept. Rows equal in key
and text share their result. Texts are read whole, however long. Empty tables give empty results.
Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm import common as C

# The base patterns and, in order, the kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # maximal runs of 24 or more are what remains of [0-9a-f]+ after the length test
KINDS = ("assign", "access", "hex", "key", "endpoint")
RUN = r"[A-Za-z0-9/+=]{40,}"  # maximal runs; those of 40 without "=" and with both cases and a digit are keys
ENDPOINT = r"""https?://[^\x20\x09-\x0D"'<>]+|[A-Za-z0-9][A-Za-z0-9.-]{0,252}\.[A-Za-z]{2,}:([0-9]+)"""
PORT_DIGITS = (2, 5)
SCOPE = 400
SPANS = "array<struct<start:int,kind:int,end:int>>"


def running(lengths: Column) -> Column:
    """Sums of an array's prefixes: doubling strides, so n log n steps instead of an array copied for each entry."""
    n = F.size(lengths)

    def stride(acc: Column, k: Column) -> Column:
        by = F.least(F.pow(F.lit(2.0), k).cast("int"), n)
        return F.zip_with(acc, F.concat(F.array_repeat(F.lit(0), by), F.slice(acc, F.lit(1), n - by)), lambda x, y: x + y)

    return F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(n, F.lit(1)))).cast("int")), lengths, stride)


def spans(text: Column, pattern: str, kind: int, hint: Column, keep: Callable[[Column, Column], Column], group: int = 0) -> Column:
    """Matches that keep accepts by the match and its group; hint is a cheap necessary condition."""
    p = F.lit(pattern)
    matches, groups, pieces = F.regexp_extract_all(text, p, F.lit(0)), F.regexp_extract_all(text, p, F.lit(group)), F.split(text, pattern, -1)
    ends = running(F.zip_with(F.slice(pieces, F.lit(1), F.size(matches)), matches, lambda x, m: F.length(x) + F.length(m)))
    span = F.zip_with(F.zip_with(matches, groups, lambda m, g: F.struct(m.alias("m"), g.alias("g"))), ends, lambda x, e: F.when(keep(x["m"], x["g"]), F.struct((e - F.length(x["m"])).alias("start"), F.lit(kind).alias("kind"), e.alias("end"))))
    found = F.filter(span, lambda x: x.isNotNull()).cast(SPANS)
    return F.when(hint, found).otherwise(F.array().cast(SPANS))


def is_key(run: Column, _: Column) -> Column:
    return (F.length(run) == 40) & ~F.contains(run, F.lit("=")) & run.rlike("[a-z]") & run.rlike("[A-Z]") & run.rlike("[0-9]")


def render(parts: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(parts), lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """key, base (spans), linked (spans) for each row of docs."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    k = F.col(f"`{key}`")
    found = docs.select(k.alias("__key"), k.isNull().alias("__null"), F.coalesce(k, F.lit(0).cast(docs.schema[key].dataType)).alias("__k"), F.xxhash64(body).alias("__h"), body.alias("__text"))
    found = found.select(
        "*",
        spans(F.col("__text"), ASSIGN, 0, F.col("__text").rlike(r"(?i)secret|token|passw|api_?key"), lambda m, g: F.length(g) >= 6, 2).alias("__assign"),
        spans(F.col("__text"), ACCESS, 1, F.contains("__text", F.lit("AKIA")), lambda m, g: F.length(m) >= 20).alias("__access"),
        spans(F.col("__text"), HEX, 2, F.col("__text").rlike(HEX), lambda m, g: F.lit(True)).alias("__hex"),
    )
    sure = (F.size("__assign") > 0) | (F.size("__access") > 0) | (F.size("__hex") > 0)
    weak_hint = F.contains("__text", F.lit("://")) | F.col("__text").rlike(r"[A-Za-z]:[0-9]{2}")
    port = lambda m, g: (g == "") | F.length(g).between(*PORT_DIGITS)
    found = found.select(
        "*",
        F.when(F.size("__access") > 0, spans(F.col("__text"), RUN, 3, F.lit(True), is_key)).alias("__keys"),
        F.when(sure, spans(F.col("__text"), ENDPOINT, 4, weak_hint, port, 1)).alias("__ends"),
    )
    ids = ["__null", "__k", "__h"]
    found = C.stash(found.select("__key", *ids, "__assign", "__access", "__hex", F.concat(F.coalesce("__keys", F.array().cast(SPANS)), F.coalesce("__ends", F.array().cast(SPANS))).alias("__weak")))
    held = found.filter(F.size("__weak") > 0)
    weak = held.select(*ids, F.explode("__weak").alias("w")).distinct().withColumn("__bin", F.floor(F.col("w.start") / scope)).withColumn("__near", F.explode(F.array(F.col("__bin") - 1, F.col("__bin"), F.col("__bin") + 1)))
    strong = held.select(*ids, F.explode(F.concat("__assign", "__access", "__hex")).alias("s")).select(*ids, F.when(F.col("s.kind") == 1, "access").otherwise("secret").alias("cls"), F.floor(F.col("s.start") / scope).alias("__near"), "s.start")
    heaps = strong.groupBy(*ids, "__near", "cls").agg(F.min("start").alias("lo"), F.max("start").alias("hi"))
    at = F.col("w.start")
    reach = F.when(F.col("__near") == F.col("__bin"), True).when(F.col("__near") < F.col("__bin"), F.col("hi") >= at - scope).otherwise(F.col("lo") <= at + scope)
    fits = (F.col("cls") == "access") | (F.col("w.kind") == 4)
    linked = weak.join(heaps, [*ids, "__near"]).filter(reach & fits).select(*ids, "w").distinct().groupBy(*ids).agg(F.collect_list("w").alias("__linked"))
    out = found.join(linked, ids, "left")
    return out.select(F.col("__key").alias(key), F.col("__assign").alias("assign"), F.col("__access").alias("access"), F.col("__hex").alias("hex"), F.coalesce("__linked", F.array().cast(SPANS)).alias("linked"))


def query(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(C.tables(sf_dir, "documents")).select("doc_id", "text"))
    base = F.concat("assign", "access", "hex")
    return found.select(
        "doc_id",
        F.size("assign").cast("long").alias("n_assign"),
        F.size("access").cast("long").alias("n_access"),
        F.size("hex").cast("long").alias("n_hex"),
        F.sha2(render(base).cast("binary"), 256).alias("base_sha256"),
        render(F.concat(base, "linked")).alias("spans"),
    )
