"""Mixing sources to target weights by Pareto order sampling.

Method. A source's target, in words, is its share of all words by weight, but at most max_repeat
times its own words; what is cut off is shared again by weight among the others until no target is
above its limit. With e = target / source words, every document gets floor(e) whole copies for
certain. The words still missing are taken as one more copy of some documents, with unequal
inclusion: a document's probability is in proportion to its weight (unless a column is named, the
number of binary digits of its words, so that each doubling of a text adds one step), by the factor
that makes the expected words those missing; probabilities that would exceed one are one, and the
factor is found for the rest. Documents are ranked by Pareto's ratio, the odds of a fixed random
number over the odds of inclusion, and taken in that order while words are missing; the last one is
taken if that ends nearer to the target. The sample so has a fixed size in words.

Scale. Equal rows are one row with a count. No source's rows meet in one task: factors come from sums
by weight, ranks are summed over buckets of the ratio first, and only the one bucket of each source in
which the words run out is ordered row by row.

Defined results. Null text has size 0 and takes 0 words. Null source is a source of its own, last in
order; sources of any type are ordered as text. Null and repeated keys are documents like others;
rows equal in key, source and text are interchangeable. Very long texts count whole. Extra columns
are ignored by mix unless carried, and kept by repeat, whatever their names. Empty tables give empty
results. A source without words takes none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm import common as C

WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeat: float = 3.0, share: float = 1.0) -> DataFrame:
    """sizes (source, source_size: a row for each source) with target.

    The level that fills the uncut sources is found by rounds of one aggregate each; a source once
    cut stays cut, so rounds end. Sources are ranked by code points in range partitions, so their
    number isn't bounded by one task.
    """
    ranked = C.stash(gapless(sizes, "source", "__pos"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("__pos") % len(weights) + 1).cast("int"))
    base = ranked.withColumn("__w", w).withColumn("__cap", F.col("source_size") * max_repeat)
    total = share * float(base.agg(F.sum("source_size")).first()[0] or 0)
    level, cut = 0.0, -1
    while True:
        full = F.col("__cap") <= F.col("__w") * F.lit(level)
        row = base.agg(F.sum(F.when(full, F.col("__cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("__w"))), F.count_if(full)).first()
        used, free, now = row[0] or 0.0, row[1] or 0.0, row[2]
        if now == cut or free <= 0:
            break
        level, cut = max(level, (total - used) / free), now
    return base.withColumn("target", F.least(F.col("__cap"), F.col("__w") * F.lit(level))).drop("__w", "__cap", "__pos")


def gapless(df: DataFrame, by: str, name: str) -> DataFrame:
    """Numbers from 0 in ascending order of by, nulls last, without a global window.

    Each range partition is numbered by itself; the counts of the (boundedly many) partitions give
    the offsets. The order of a frame with few rows, such as one row for each source, is meant.
    """
    null_last = F.col(by).isNull()
    placed = C.stash(df.repartitionByRange(16, null_last, F.col(by)).withColumn("__part", F.spark_partition_id()))
    counts = dict(sorted((r[0], r[1]) for r in placed.groupBy("__part").count().collect()))
    offsets, seen = {}, 0
    for part, n in counts.items():
        offsets[part], seen = seen, seen + n
    start = F.coalesce(*[F.when(F.col("__part") == p, F.lit(o)) for p, o in offsets.items()], F.lit(0)) if offsets else F.lit(0)
    w = Window.partitionBy("__part").orderBy(null_last, F.col(by))
    return placed.withColumn(name, F.row_number().over(w) - 1 + start).drop("__part")


def inclusion(cells: DataFrame) -> DataFrame:
    """__n, __s, __w and __lambda for cells (__n, __s, __w, __need, __words: a source's words of one weight).

    The greatest weights are taken for certain as long as the factor for the rest would exceed their
    inverse. Weights have a bounded number of values, so windows hold few rows a source.
    """
    down = Window.partitionBy("__n", "__s").orderBy(F.desc("__w"))
    up = Window.partitionBy("__n", "__s").orderBy("__w")
    df = cells.withColumn("__above", F.sum("__words").over(down) - F.col("__words")).withColumn("__mass", F.sum(F.col("__words") * F.col("__w")).over(up))
    df = df.withColumn("__factor", F.try_divide(F.col("__need") - F.col("__above"), F.col("__mass").cast("double")))
    fits = F.when(F.col("__factor") * F.col("__w") <= 1, F.col("__w"))
    df = df.withColumn("__top", F.max(fits).over(Window.partitionBy("__n", "__s")))
    of_top = F.max(F.when(F.col("__w") == F.col("__top"), F.col("__factor"))).over(Window.partitionBy("__n", "__s"))
    rest = F.greatest(F.coalesce(of_top, F.lit(0.0)), F.lit(0.0)) * F.col("__w")
    sure = F.col("__top").isNull() | (F.col("__w") > F.col("__top"))
    return df.select("__n", "__s", "__w", F.when((F.col("__need") <= 0) | (F.col("__words") == 0), F.lit(0.0)).when(sure, F.lit(1.0)).otherwise(F.least(rest, F.lit(1.0))).alias("__lambda"))


def spread(df: DataFrame, n: str, chunk: int = 1000) -> DataFrame:
    """Each row n times, numbered by __i from 0; many copies of one row are dealt out to several tasks."""
    few = df.filter(F.col(n).between(1, chunk)).withColumn("__from", F.lit(0).cast("long"))
    many = df.filter(F.col(n) > chunk).withColumn("__from", F.explode(F.expr(f"sequence(0L, {n} - 1, {chunk}L)")))
    many = many.repartition(F.col("__from"))
    each = F.sequence(F.col("__from"), F.least(F.col("__from") + chunk, F.col(n)) - 1)
    return few.unionByName(many).withColumn("__i", F.explode(each)).drop("__from")


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[float, ...] = WEIGHTS, max_repeat: float = 3.0, weight: str | None = None, seed: int = 11, carry: list[str] | None = None) -> DataFrame:
    """key, source, size, source_size, target, inclusion (of the part copy), copies and taken for each row of docs, and the columns in carry.

    weight, if given, names a positive column instead of the default weight; it is rounded to 64 steps a doubling.
    """
    carried = [c for c in carry or [] if c.lower() not in {x.lower() for x in (key, source, "size", "source_size", "target", "inclusion", "copies", "taken")}]
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    size = n_words(body)
    given = F.length(F.bin(size)) if weight is None else F.pow(F.lit(2.0), F.round(F.log2(F.greatest(F.col(f"`{weight}`").cast("double"), F.lit(1e-9))) * 64) / 64)
    own = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    # 52 bits of the MD5 of seed, key and the text's own, so never 0 or 1
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), own, F.lit(":"), F.md5(body.cast("binary"))).cast("binary")), 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)
    cols = {"__key": F.col(f"`{key}`"), "__source": F.col(f"`{source}`"), "size": size, "__w": F.coalesce(given, F.lit(0)), "__u": u} | {f"__c_{c}": F.col(f"`{c}`") for c in carried}
    rows = docs.select(*[c.alias(n) for n, c in cols.items()])
    rows = C.stash(rows.groupBy(*cols).agg(F.count("*").alias("__m")))
    flag = lambda c: (F.col(c).isNull().alias("__n"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("__s"))  # noqa: E731  nulls never equal in a join
    words = F.sum(F.col("size") * F.col("__m"))
    goal = targets(rows.groupBy(F.col("__source").cast("string").alias("source")).agg(words.alias("source_size")), weights, max_repeat)
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    g = goal.withColumn("__whole", F.least(F.floor(each + 1e-12), F.lit(int(max_repeat))).cast("long"))
    g = C.stash(g.select(*flag("source"), "source_size", "target", "__whole", F.greatest(F.col("target") - F.col("__whole") * F.col("source_size"), F.lit(0.0)).alias("__need")))
    cells = rows.select(*flag("__source"), "__w", (F.col("size") * F.col("__m")).alias("x")).groupBy("__n", "__s", "__w").agg(F.sum("x").alias("__words"))
    odds_of = C.stash(inclusion(cells.join(g.select("__n", "__s", "__need"), ["__n", "__s"])))
    df = rows.select("*", *flag("__source")).join(g, ["__n", "__s"]).join(odds_of, ["__n", "__s", "__w"])
    # ratio q of the odds; q / (1 + q) has the same order and lies in [0, 1]
    odds = F.col("__u") * (1 - F.col("__lambda"))
    df = df.withColumn("__rank", F.when(F.col("__lambda") <= 0, F.lit(1.0)).otherwise(odds / (odds + (1 - F.col("__u")) * F.col("__lambda"))))
    df = df.withColumn("__bucket", F.least(F.floor(F.col("__rank") * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))
    heaps = df.groupBy("__n", "__s", "__bucket").agg(words.alias("__heap"), F.first("__need").alias("__goal"))
    before = F.sum("__heap").over(Window.partitionBy("__n", "__s").orderBy("__bucket")) - F.col("__heap")
    # at most BUCKETS rows a source; a bucket is taken whole, cut, or left
    heaps = heaps.withColumn("__before", before).select("__n", "__s", "__bucket", "__before", (F.col("__before") + F.col("__heap") <= F.col("__goal")).alias("__in"), (F.col("__before") >= F.col("__goal")).alias("__out"))
    df = df.join(heaps, ["__n", "__s", "__bucket"])
    sure = df.filter("__in or __out").withColumn("__extra", F.when(F.col("__in"), F.col("__m")).otherwise(F.lit(0).cast("long")))
    w = Window.partitionBy("__n", "__s", "__bucket").orderBy("__rank", "__key", "size", "__u")
    mass = F.col("size") * F.col("__m")
    edge = df.filter("not __in and not __out").withColumn("__at", F.col("__before") + F.sum(mass).over(w.rowsBetween(Window.unboundedPreceding, 0)) - mass)
    # of equal rows as many as end nearest to the words missing
    units = F.floor((F.col("__need") - F.col("__at")) / F.col("size") + 0.5)
    edge = edge.withColumn("__extra", F.when(F.col("size") == 0, F.lit(0).cast("long")).otherwise(F.greatest(F.least(units, F.col("__m")), F.lit(0).cast("long")))).drop("__at")
    out = spread(sure.unionByName(edge).withColumn("__extra", F.when((F.col("size") == 0) | (F.col("__lambda") <= 0), F.lit(0).cast("long")).otherwise(F.col("__extra"))), "__m")
    out = out.withColumn("copies", F.least(F.col("__whole") + (F.col("__i") < F.col("__extra")).cast("long"), F.lit(int(max_repeat)).cast("long")))
    return out.select(
        F.col("__key").alias(key),
        F.col("__source").alias(source),
        "size",
        "source_size",
        F.col("target").cast("double").alias("target"),
        F.col("__lambda").alias("inclusion"),
        "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
        *[F.col(f"`__c_{c}`").alias(c) for c in carried],
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(C.tables(sf_dir, "documents")).select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return repeat(docs)


def repeat(docs: DataFrame, **args) -> DataFrame:
    """Rows of docs, each as often as the mix takes it, with its columns as they were.

    Only counts by a hash of the row travel through the sampling, so that texts are moved once: rows
    equal in all columns meet as one, and are written out as often as all of them are taken.
    """
    (tag,) = C.fresh(docs.columns, "__tag")
    tagged = docs.withColumn(tag, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    picked = mix(tagged, carry=[tag], **args).groupBy(tag).agg(F.sum("copies").alias("__copies")).filter("__copies > 0")
    rows = tagged.groupBy(tag).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("__row"))
    return spread(rows.join(picked, tag), "__copies").select("__row.*")
