"""Line dedup by content-defined chunks of lines. DataFrame functions only.

Method. Each line is hashed; a polynomial hash rolls over the hashes of two neighbouring lines and
sets a boundary where it is less than the others of the `divisor` around it, so boundaries are about
`divisor` lines apart and never fewer than `min_lines`. From each boundary on, lines are taken in
chunks of `min_lines` (the last before the next boundary takes the rest), so no chunk is too short
to count. Boundaries depend on nearby lines only, so inserted or lost lines move just the chunks next
to them. Chunks that occur more than once in the whole corpus are candidates by hash; the bytes of
all candidates are then compared, and every occurrence but the first (by key, then place) is removed.

Limit. Of a passage within otherwise different texts, the lines before its first boundary and
those that share a chunk with lines after its end stay.

Scale. Counting moves hashes and places only, with partial aggregation, so a chunk that fills a third
of the corpus is one row a task there. Texts go through one exchange on their identity, which the
comparison and the removal share; only candidates' bytes travel beyond it, and are compared by
partial aggregation. Joins on a chunk's hash are between an exchange of the occurrences, which Spark
may split, and a written table with a row for each hash.

Defined results. Null text counts as empty: one line, nothing removed. Rows equal in key and text
are one document and share their result. Null keys are one key. Texts are read whole, however long.
Extra columns are ignored, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm import common as C

DIVISOR, MIN_LINES = 3, 2
# The polynomial of the rolling hash.
BASE, MODULUS = 1_000_003, 2_147_483_647
IDS = ["__null", "__k", "__h"]


def line_hash(line: Column) -> Column:
    """The first 28 bits of the line's MD5."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 7), 16, 10).cast("long")


def identified(docs: DataFrame, key: str, text: str) -> DataFrame:
    """IDS and __text of each row."""
    body, k = F.coalesce(F.col(f"`{text}`"), F.lit("")), F.col(f"`{key}`")
    return docs.select(k.isNull().alias("__null"), F.coalesce(k, F.lit(0).cast(docs.schema[key].dataType)).alias("__k"), F.xxhash64(body).alias("__h"), body.alias("__text"))


def lines_of(text: str = "__text") -> Column:
    return F.split(F.col(text), "\n", -1)


def chunked(texts: DataFrame, divisor: int = DIVISOR, min_lines: int = MIN_LINES) -> DataFrame:
    """IDS of each row (of identified), its lines and the 1-based (a, b) of its chunks."""
    df = texts.select(*IDS, _once(lines_of()).alias("__lines"))
    df = df.select(*IDS, "__lines", _once(F.transform("__lines", line_hash)).alias("__hash"))
    n = F.size("__lines")
    # entry i looks at lines i + 1 and i + 2 (from 1)
    rolls = F.zip_with(F.slice("__hash", 2, F.greatest(n - 1, F.lit(1))), F.slice("__hash", F.lit(1), n - 1), lambda b, a: (a * BASE + b) % MODULUS)
    df = df.select(*IDS, "__lines", _once(rolls).alias("__rolls"))
    reach = max(divisor // 2, min_lines - 1)

    def least(x: Column, i: Column) -> Column:
        out = (i + 2 >= min_lines) & (i + 2 + min_lines <= F.size("__lines"))
        for d in (d for d in range(-reach, reach + 1) if d):
            out = out & F.coalesce(x < F.get("__rolls", i + d), F.lit(True))
        return out

    ends = F.filter(F.transform("__rolls", lambda x, i: F.when(least(x, i), i + 2)), lambda e: e.isNotNull())
    df = df.select(*IDS, "__lines", _once(F.concat(ends, F.array(n))).alias("__ends"))
    starts = F.concat(F.array(F.lit(1)), F.transform("__ends", lambda e: e + 1))
    chunks = F.zip_with(F.slice(starts, F.lit(1), F.size("__ends")), F.col("__ends"), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    df = df.select(*IDS, "__lines", _once(chunks).alias("__long"))

    def pieces(c: Column) -> Column:
        last = F.greatest(F.floor((c["b"] - c["a"] + 1) / min_lines).cast("int") - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda j: F.struct((c["a"] + j * min_lines).alias("a"), F.when(j == last, c["b"]).otherwise(c["a"] + (j + 1) * min_lines - 1).alias("b")))

    return df.select(*IDS, "__lines", _once(F.flatten(F.transform("__long", pieces))).alias("__chunks"))


def _once(col: Column) -> Column:
    """The same value, made in a plan node of its own: later uses, also within lambdas, don't make it again."""
    return F.explode(F.array(col))


def cut(lines: Column, chunk: Column) -> Column:
    return F.array_join(F.slice(lines, chunk["a"], chunk["b"] - chunk["a"] + 1), "\n")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", divisor: int = DIVISOR, min_lines: int = MIN_LINES) -> DataFrame:
    """key, kept text, n_lines, n_removed_lines, n_removed_chunks for each row."""
    texts = identified(docs, key, text)
    wide = F.filter("__chunks", lambda c: c["b"] - c["a"] + 1 >= min_lines)
    sums = F.transform(wide, lambda c: F.struct(F.xxhash64(cut(F.col("__lines"), c)).alias("sum"), c["a"].alias("a"), c["b"].alias("b")))
    places = C.stash(chunked(texts, divisor, min_lines).select(*IDS, F.inline(sums)))
    often = C.stash(places.groupBy("sum").agg(F.count("*").alias("n")).filter("n > 1").select("sum"), few=True)
    held = C.stash(places.join(often, "sum"))
    asked = held.groupBy(*IDS).agg(F.collect_set(F.struct("sum", "a", "b")).alias("__asked"))
    bodies = texts.join(asked, IDS).select(*IDS, _once(lines_of()).alias("__lines"), "__asked").select(*IDS, "__lines", F.inline("__asked"))
    bodies = bodies.select("sum", cut(F.col("__lines"), F.struct("a", "b")).alias("body"), F.struct(*IDS, "a").alias("at"))
    # grouping by the text itself is the byte comparison; hashes that stand for several texts are told apart by those
    same = bodies.groupBy("sum", "body").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    same = C.stash(same.groupBy("sum").agg(F.count("*").alias("texts"), F.max(F.struct("first", "last")).alias("x")).select("sum", "texts", "x.first", "x.last"), few=True)
    at = F.struct(*IDS, "a")
    later = held.join(same.filter("texts = 1 and first != last"), "sum").filter(at != F.col("first")).select(*IDS, "a", "b")
    clash = bodies.join(same.filter("texts > 1").select("sum"), "sum")
    firsts = clash.groupBy("sum", "body").agg(F.min("at").alias("first"))
    told = clash.join(firsts, ["sum", "body"]).filter(F.col("at") != F.col("first")).select(*[F.col(f"at.{c}") for c in IDS], F.col("at.a").alias("a"))
    told = told.join(held.select(*IDS, "a", "b"), [*IDS, "a"])
    gone = later.unionByName(told).groupBy(*IDS).agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("__gone"))
    out = texts.join(gone, IDS, "left").select(*IDS, "__text", F.coalesce("__gone", F.array().cast("array<struct<a:int,b:int>>")).alias("__gone"))
    out = out.select(*IDS, "__text", "__gone", _once(lines_of()).alias("__lines"))
    # what stays lies between the removed chunks
    n, m = F.size("__lines"), F.size("__gone")
    froms = F.concat(F.array(F.lit(1)), F.transform("__gone", lambda c: c["b"] + 1))
    tos = F.concat(F.transform("__gone", lambda c: c["a"] - 1), F.array(n))
    between = F.zip_with(froms, tos, lambda a, b: F.slice("__lines", a, F.greatest(b - a + 1, F.lit(0))))
    lost = F.aggregate("__gone", F.lit(0), lambda s, c: s + c["b"] - c["a"] + 1)
    return out.select(
        F.when(~F.col("__null"), F.col("__k")).alias(key),
        F.when(m == 0, F.col("__text")).otherwise(F.array_join(F.flatten(between), "\n")).alias(text),
        n.cast("long").alias("n_lines"),
        lost.cast("long").alias("n_removed_lines"),
        m.cast("long").alias("n_removed_chunks"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    out = dedup(spark.read.parquet(C.tables(sf_dir, "documents")).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed_lines", "n_removed_chunks", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
