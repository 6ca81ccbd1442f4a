"""Judgments against rankings, classifiers and each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def precision_at(hits: DataFrame, judgments: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """One row: queries, p_at_k, p_at_3, hit_at_3, unjudged. The denominators are k and 3 also where there are fewer hits."""
    judged = hits.filter(F.col("rank") <= k).join(judgments, ["qid", "doc"], "left")
    per = judged.groupBy("qid").agg(
        (F.sum(F.coalesce("relevant", F.lit(0))) / F.lit(float(k))).alias("pk"),
        (F.sum(F.when(F.col("rank") <= 3, F.coalesce("relevant", F.lit(0))).otherwise(0)) / F.lit(3.0)).alias("p3"),
        F.max(F.when(F.col("rank") <= 3, F.coalesce("relevant", F.lit(0))).otherwise(0)).alias("h3"),
        F.count_if(F.col("relevant").isNull()).alias("u"),
    )
    every = queries.select("qid").join(per, "qid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return every.agg(
        F.count("*").alias("queries"),
        F.round(F.coalesce(F.avg(zero("pk")), F.lit(0.0)), 6).alias("p_at_k"),
        F.round(F.coalesce(F.avg(zero("p3")), F.lit(0.0)), 6).alias("p_at_3"),
        F.coalesce(F.sum(zero("h3")), F.lit(0)).cast("long").alias("hit_at_3"),
        F.coalesce(F.sum(zero("u")), F.lit(0)).cast("long").alias("unjudged"),
    )


def unjudged(hits: DataFrame, judgments: DataFrame) -> DataFrame:
    """(qid, doc) without a judgment, once each, as lines for a judge: relevance ?, score to three decimals."""
    j = hits.join(judgments, ["qid", "doc"], "left")
    return j.select("qid", "doc", F.coalesce(F.col("relevant").cast("string"), F.lit("?")).alias("relevant"), F.format_string("%.3f", F.col("score").cast("double")).alias("score")).dropDuplicates(["qid", "doc"])


def agreement(a: DataFrame, b: DataFrame, threshold: int = 5) -> DataFrame:
    """How two sets of verdicts (work_id, relevance, domain, study_type) agree; zeros where they share no work."""
    p = pairs(a, b)
    rate = lambda c: F.round(F.coalesce(F.avg(c.cast("double")), F.lit(0.0)), 6)
    gap = F.abs(F.col("a.relevance") - F.col("b.relevance"))
    return p.agg(
        F.count("*").alias("n"),
        rate(gap).alias("mean_abs_diff"),
        rate((gap <= 1).cast("int")).alias("within_1"),
        rate(((F.col("a.relevance") >= threshold) == (F.col("b.relevance") >= threshold)).cast("int")).alias("keep_agreement"),
        rate((F.col("a.domain") == F.col("b.domain")).cast("int")).alias("domain_agreement"),
        rate(F.col("a.study_type").eqNullSafe(F.col("b.study_type")).cast("int")).alias("study_type_agreement"),
    )


def pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """a's verdicts beside b's of the same work; the last of b's (by seq, where there is one) counts."""
    if "seq" in b.columns:
        cols = [c for c in b.columns if c not in ("work_id", "seq")]
        b = b.groupBy("work_id").agg(F.max_by(F.struct(*cols), "seq").alias("v")).select("work_id", "v.*")
    return a.alias("a").join(b.alias("b"), F.col("a.work_id") == F.col("b.work_id"))


def disagreements(a: DataFrame, b: DataFrame, gap: int = 2) -> DataFrame:
    far = (F.abs(F.col("a.relevance") - F.col("b.relevance")) >= gap) | (F.col("a.domain") != F.col("b.domain")) | ~F.col("a.study_type").eqNullSafe(F.col("b.study_type"))
    return pairs(a, b).filter(far).select(F.col("a.work_id").alias("work_id"))


def per_class(df: DataFrame) -> DataFrame:
    """name, precision, recall, f1, support for rows (truth, pred); 0 where a denominator is 0."""
    matrix = df.groupBy("truth", "pred").count()
    t = matrix.groupBy(F.col("truth").alias("name")).agg(F.sum("count").alias("support"), F.sum(F.when(F.col("truth") == F.col("pred"), F.col("count")).otherwise(0)).alias("tp"))
    p = matrix.groupBy(F.col("pred").alias("name")).agg(F.sum("count").alias("claimed"))
    j = t.join(p, "name", "full_outer").select("name", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("support", "tp", "claimed")])
    div = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    j = j.withColumn("precision", div(F.col("tp"), F.col("claimed"))).withColumn("recall", div(F.col("tp"), F.col("support")))
    f1 = div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return j.select("name", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round(f1, 6).alias("f1"), F.col("support").cast("long").alias("support"))


def thresholds(df: DataFrame, cuts: tuple[float, ...] = (0.3, 0.4, 0.5, 0.6, 0.7)) -> DataFrame:
    """threshold, kept, precision, recall for rows (truth 0/1, prob); one pass over the rows."""
    cut = df.select("truth", "prob", F.explode(F.array(*[F.lit(c) for c in cuts])).alias("threshold"))
    over = F.col("prob") >= F.col("threshold")
    g = cut.groupBy("threshold").agg(F.count("*").alias("n"), F.count_if(over).alias("k"), F.count_if(over & (F.col("truth") == 1)).alias("tp"), F.count_if(F.col("truth") == 1).alias("pos"))
    div = lambda x, y: F.round(F.coalesce(F.try_divide(F.col(x).cast("double"), F.col(y)), F.lit(0.0)), 6)
    return g.select("threshold", div("k", "n").alias("kept"), div("tp", "k").alias("precision"), div("tp", "pos").alias("recall"))


def roc_auc(df: DataFrame) -> DataFrame:
    """One row, auc, for rows (truth 0/1, score): the Mann-Whitney statistic, ties counted half; 0.5 without one of the classes.

    Counts by distinct score come first; ranks are prefix sums over them. A class total is one row, so
    nothing but the distinct scores is ordered, and those in range partitions.
    """
    by = df.groupBy("score").agg(F.count_if(F.col("truth") == 1).alias("p"), F.count_if(F.col("truth") == 0).alias("n"))
    below = prefix_sum(by, "score", "n", "below")
    return below.agg(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2.0)).alias("u"), F.sum("p").cast("double").alias("pos"), F.sum("n").cast("double").alias("neg")).select(
        F.round(F.coalesce(F.try_divide(F.col("u"), F.col("pos") * F.col("neg")), F.lit(0.5)), 6).alias("auc")
    )


def prefix_sum(df: DataFrame, order: str, value: str, name: str, parts: int = 64) -> DataFrame:
    """name: the sum of value over rows of lesser order. Each range is summed by itself, and the sums of the ranges before it are added."""
    edges = [r for r in (df.approxQuantile(order, [i / parts for i in range(1, parts)], 0.01) or [])]
    cuts = sorted(set(edges))
    where = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(order))) if cuts else F.lit(0)
    placed = df.withColumn("__part", where)
    sums = placed.groupBy("__part").agg(F.sum(value).alias("__s"))
    offset = sums.withColumn("__o", F.sum("__s").over(Window.orderBy("__part")) - F.col("__s")).select("__part", "__o")  # at most `parts` rows
    w = Window.partitionBy("__part").orderBy(order)
    own = placed.withColumn("__own", F.sum(value).over(w) - F.col(value))
    return own.join(F.broadcast(offset), "__part").withColumn(name, F.col("__own") + F.col("__o")).drop("__part", "__o", "__own")


def strata_accuracy(df: DataFrame, strata: list[str]) -> DataFrame:
    """stratum, value, n, accuracy for rows (truth, pred, ...) along each stratum column."""
    each = df.select("truth", "pred", F.explode(F.array(*[F.struct(F.lit(s).alias("stratum"), F.col(s).cast("string").alias("value")) for s in strata])).alias("x"))
    return each.groupBy("x.stratum", "x.value").agg(F.count("*").alias("n"), F.round(F.avg((F.col("truth") == F.col("pred")).cast("int")), 6).alias("accuracy"))


def order_statistics(rows: DataFrame, by: str, value: str) -> DataFrame:
    """by, p50, p95: the entries at n // 2 and int(0.95 n), from 0, of each group's sorted values.

    Ranks come from counts by value, so a group of many rows is as many rows as it has values.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(by).orderBy(value))
    placed = counts.withColumn("upto", upto).withColumn("n", F.sum("c").over(Window.partitionBy(by)))
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col(value)))
    return placed.groupBy(by).agg(at(F.floor(F.col("n") / 2)).alias("p50"), at(F.floor(F.col("n") * F.lit(0.95))).alias("p95"))
