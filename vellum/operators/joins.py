"""Joins of records: identifiers, priority lookups, ordered loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum import scratch
from vellum.functions import records as R

IDENTIFIERS = ("work_id", "doi", "pmcid")


def identifiers(df: DataFrame, tag: str) -> DataFrame:
    """tag, kind and value of every identifier that a record has."""
    each = F.array(*[F.struct(F.lit(c).alias("kind"), R.filled(F.col(c)).alias("value")) for c in IDENTIFIERS])
    return df.select(F.col(tag).alias("tag"), F.explode(each).alias("i")).filter("i.value is not null").select("tag", "i.kind", "i.value")


def seen(candidates: DataFrame, works: DataFrame, tag: str) -> DataFrame:
    """tags of the candidates known by any identifier; works that are only candidates don't count.

    An OR of three equalities would be a nested loop; one equality on (kind, value) is a hash join.
    """
    known = identifiers(works.filter(F.col("status") != "candidate"), "work_id").select("kind", "value")
    return identifiers(candidates, tag).join(known, ["kind", "value"], "left_semi").select("tag").distinct()


def fill_pmcids(candidates: DataFrame, lookup: DataFrame) -> DataFrame:
    """Missing pmcids from a (doi, pmcid) table, DOIs without regard to case."""
    known = lookup.filter("doi is not null and pmcid is not null").groupBy(F.lower("doi").alias("__doi")).agg(F.min("pmcid").alias("__pmcid"))
    return candidates.join(known, F.lower("doi") == F.col("__doi"), "left").withColumn("pmcid", F.coalesce(R.filled(F.col("pmcid")), "__pmcid")).drop("__doi", "__pmcid")


def rehydrate(candidates: DataFrame, records: DataFrame) -> DataFrame:
    """Publication types and missing pmcids of candidates from full records, by DOI."""
    known = records.filter("doi is not null").groupBy(F.lower("doi").alias("__doi")).agg(F.first("pub_types").alias("__types"), F.first("pmcid").alias("__pmcid"))
    j = candidates.join(known, F.lower("doi") == F.col("__doi"), "left")
    return j.withColumns({"pub_types": F.coalesce("__types", "pub_types"), "pmcid": F.coalesce("pmcid", "__pmcid")}).drop("__doi", "__types", "__pmcid")


def by_identifiers(papers: DataFrame, by_pmcid: DataFrame, by_doi: DataFrame, value: str) -> DataFrame:
    """papers with value from a pmcid table first, else from a doi table; blanks count as missing."""
    usable = F.col(value).isNotNull() & (F.col(value).cast("string") != "") & (F.col(value).cast("string") != "[]")
    a = by_pmcid.filter(usable).groupBy(F.upper("pmcid").alias("__p")).agg(F.first(value).alias("__a"))
    b = by_doi.filter(usable).groupBy(F.lower("doi").alias("__d")).agg(F.first(value).alias("__b"))
    j = papers.join(a, F.upper("pmcid") == F.col("__p"), "left").join(b, F.lower("doi") == F.col("__d"), "left")
    return j.withColumn(value, F.coalesce("__a", "__b")).drop("__a", "__b", "__p", "__d")


def priority_lookup(papers: DataFrame, first: DataFrame, second: DataFrame, value: str, names: tuple[str, str] = ("openalex", "epmc")) -> DataFrame:
    """work_id, value and where it came from; papers that neither source knows have a row that says missing."""
    a = first.select(R.norm_doi(F.col("doi")).alias("__d"), F.col(value).alias("__a")).filter("__a is not null").dropDuplicates(["__d"])
    b = second.select("work_id", F.col(value).alias("__b")).filter("__b is not null").dropDuplicates(["work_id"])
    j = papers.select("work_id", "doi").join(a, R.norm_doi(F.col("doi")) == F.col("__d"), "left").join(b, "work_id", "left")
    source = F.when(F.col("__a").isNotNull(), names[0]).when(F.col("__b").isNotNull(), names[1]).otherwise("missing")
    return j.select("work_id", F.coalesce("__a", "__b").alias(value), source.alias("source"))


def retraction_check(papers: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """work_id and a flag for each of two sources (both are asked), by DOI."""
    a = first.filter("is_retracted").select(R.norm_doi(F.col("doi")).alias("__d")).distinct().withColumn("__a", F.lit(True))
    b = second.filter("is_retracted").select("work_id").distinct().withColumn("__b", F.lit(True))
    j = papers.select("work_id", "doi").join(a, R.norm_doi(F.col("doi")) == F.col("__d"), "left").join(b, "work_id", "left")
    return j.select("work_id", F.coalesce("__a", F.lit(False)).alias("in_first"), F.coalesce("__b", F.lit(False)).alias("in_second"))


def retraction_stats(checked: DataFrame) -> DataFrame:
    a, b = F.col("in_first"), F.col("in_second")
    return checked.agg(F.count("*").alias("checked"), F.count_if(a | b).alias("retracted"), F.count_if(a & ~b).alias("only_first"), F.count_if(b & ~a).alias("only_second"), F.count_if(a & b).alias("both"))


def load_in_order(ids: DataFrame, works: DataFrame, abstracts: DataFrame, require: bool = False) -> DataFrame:
    """works and their abstracts for a list (pos, work_id), in its order."""
    return ids.join(works, "work_id").join(abstracts.select("work_id", "abstract"), "work_id", "inner" if require else "left").orderBy("pos")


def with_chunks(works: DataFrame, chunks: DataFrame) -> DataFrame:
    """works with their chunks in order; works without chunks are left out."""
    own = chunks.groupBy("work_id").agg(F.array_sort(F.collect_list(F.struct("idx", "chunk_id", "section", "text", "n_words"))).alias("chunks"))
    return works.join(own, "work_id")


def work_budget(chunks: DataFrame, most_words: int = 14_000) -> DataFrame:
    """Chunks of each work until its words run out (the first always fits), and whether any were left out."""
    w = Window.partitionBy("work_id").orderBy("idx")
    # the first chunk that doesn't fit ends the work
    marked = chunks.withColumn("__upto", F.sum("n_words").over(w)).withColumn("__n", F.row_number().over(w))
    marked = marked.withColumn("__over", F.max(((F.col("__upto") > most_words) & (F.col("__n") > 1)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.withColumn("truncated", F.max("__over").over(Window.partitionBy("work_id")) == 1).filter("__over = 0").drop("__upto", "__n", "__over")


def candidates_deduped(cands: DataFrame, order: str) -> DataFrame:
    """First-wins removal of records that share any identifier with an earlier kept one.

    A dropped record's other identifiers don't block later ones, so this isn't connected components.
    Each round looks at the undecided records: one that comes first at all of its identifiers is kept,
    and those that share an identifier with it go. No pairs of records are made, however many share an
    identifier; the undecided are written after each round, so plans stay short.
    """
    spark = cands.sparkSession
    open_, path = scratch.written(identifiers(cands, order))
    without = cands.select(F.col(order).alias("tag")).join(open_.select("tag"), "tag", "left_anti")  # no identifier, nothing to share
    kept, paths = [scratch.written(without)[0]], [path]
    while True:
        led = open_.join(open_.groupBy("kind", "value").agg(F.min("tag").alias("first")), ["kind", "value"])
        first = led.groupBy("tag").agg(F.bool_and(F.col("tag") == F.col("first")).alias("leads")).filter("leads").select("tag")
        winners, path = scratch.written(first)
        if winners.isEmpty():
            break
        kept.append(winners)
        beaten = led.join(winners.withColumnRenamed("tag", "first"), "first", "left_semi").select("tag").distinct()
        open_, path = scratch.written(open_.join(beaten, "tag", "left_anti"))
        scratch.delete(spark, paths.pop())
        paths.append(path)
    scratch.delete(spark, paths.pop())
    tags = kept[0]
    for k in kept[1:]:
        tags = tags.unionByName(k)
    return cands.join(tags.withColumnRenamed("tag", order), order, "left_semi")


def diff(before: DataFrame, after: DataFrame, key: str, fields: list[str], dead: DataFrame | None = None) -> DataFrame:
    """key, state (added, carried, changed, tombstoned, vanished) and the changed fields between two snapshots."""
    a = before.select(key, F.struct(*fields).alias("a"))
    b = after.select(key, F.struct(*fields).alias("b"))
    j = a.join(b, key, "full_outer")
    t = dead.select(key).distinct().withColumn("__dead", F.lit(True)) if dead is not None else None
    j = j.join(t, key, "left") if t is not None else j.withColumn("__dead", F.lit(None).cast("boolean"))
    changed = F.filter(F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    gone = F.col("b").isNull()
    state = F.when(F.col("a").isNull(), "added").when(gone & F.col("__dead"), "tombstoned").when(gone, "vanished").when(F.size(changed) > 0, "changed").otherwise("carried")
    return j.select(key, state.alias("state"), F.when(both, changed).otherwise(F.array().cast("array<string>")).alias("changed"))


def tombstones(ledger: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Everything ever shipped that is no longer live."""
    return ledger.select(key).distinct().join(live.select(key), key, "left_anti").withColumn("deleted", F.lit(True)).orderBy(key)

