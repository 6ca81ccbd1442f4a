"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of byte n-grams.

Method. For each language a model of order `order` over UTF-8 bytes is trained on trusted text, the
documents labelled good and not toxic. Counts are modified Kneser-Ney: raw at the highest order,
numbers of distinct left neighbours below, three discounts an order and language from the counts of
counts, and interpolation down to a uniform distribution over 256 bytes. A document's score is the
mean of -log2 p over its bytes (its perplexity is 2 to that power); it is kept if that is at most
the `quantile` of its language's trusted documents, times a small margin.

Sharded count joins. Counts stay a table, sharded by n-gram. Documents form blocks of bounded size.
Each block asks for its distinct n-grams once; a join with the counts answers, and the answers meet
the block's documents (compressed for the trip) in one task. What is gathered grows with the
documents, and no task holds the model.

Fit. Text that a model was trained on looks more likely than equally clean text, so no document is
scored by a model that has seen it. Crossed, as the query does it: all documents are halved by their
hashed ids, and each is scored by the model of all trusted documents of the other half. Counts and
thresholds so take in every trusted document, and each half of a language has a threshold of its own.
Not crossed: one model of all trusted documents of the first half scores all documents, and those of
the second half set the thresholds. Ids of trusted documents are broadcast, ids_at_once of them;
where there are more, the texts are read once for each so many.

Defined results. Null or empty text has 0 bytes, bits 0 and is kept. A null language is the language
''. A language (crossed: a half of it) without trusted documents to train on or to hold out has no
threshold and keeps all. Repeated rows are each scored; null keys are never
trusted. Texts are scored whole, however long. Extra columns are ignored, whatever their names. Empty
tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from vellum.llm import common as C

ORDER = 4  # bytes; a code of this many bytes fits a long up to 7
BLOCK_BYTES = 24 << 20
SALTS = 64


def codes(buf: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """Big-endian code of the n-gram that ends at each byte; newlines stand before a text."""
    out = np.zeros(len(buf), np.int64)
    place = np.arange(len(buf)) - np.repeat(offsets[:-1], np.diff(offsets))
    for j in range(order):
        shifted = np.full(len(buf), 10, np.int64)
        shifted[j:] = buf[: len(buf) - j]
        if j:
            shifted[place < j] = 10
        out |= shifted << (8 * j)
    return out


def count_ngrams(docs: DataFrame, order: int) -> DataFrame:
    """lang, code, c of the highest order. docs: lang, t."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = np.array(batch.column(0).to_pylist())
            for lo, hi, buf, offsets in C.slices(C.text_column(batch, "t"), 2 << 20):
                code, by = codes(buf, offsets, order), np.repeat(lang[lo:hi], np.diff(offsets))
                for one in np.unique(lang[lo:hi]):
                    u, c = np.unique(code[by == one], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([one] * len(u), pa.string()), pa.array(u), pa.array(c)], ["lang", "code", "c"])

    return docs.mapInArrow(run, "lang string, code long, c long").groupBy("lang", "code").agg(F.sum("c").alias("c"))


def discount(c: Column) -> Column:
    return F.when(c == 1, F.col("d1")).when(c == 2, F.col("d2")).otherwise(F.col("d3"))


def model(counts: DataFrame, order: int) -> DataFrame:
    """lang, level, code, p, g: probability of each seen n-gram, and weight of what its context leaves over."""
    levels = {order: counts}
    for k in range(order - 1, 0, -1):
        levels[k] = C.stash(levels[k + 1].groupBy("lang", F.col("code").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("code")).agg(F.count("*").alias("c")), few=True)
    below, out = None, None
    for k in range(1, order + 1):
        t = levels[k]
        n = [F.count_if(F.col("c") == i).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)]
        y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
        raw = {i: i - (i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}")) for i in (1, 2, 3)}
        # null where a count of counts is 0: then half of the count; greatest and least would skip the null
        kept = {i: F.when(r.isNull(), 0.5 * i).otherwise(F.least(F.greatest(r, F.lit(0.05)), F.lit(i - 0.05))) for i, r in raw.items()}
        d = t.groupBy("lang").agg(*n).select("lang", *[c.alias(f"d{i}") for i, c in kept.items()])
        # a language's counts are joined with its discounts in SALTS parts
        d = d.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        t = t.withColumn("salt", F.pmod(F.xxhash64("code"), F.lit(SALTS)).cast("int")).join(d, ["lang", "salt"]).drop("salt").withColumn("ctx", F.shiftrightunsigned("code", 8))
        ctx = t.groupBy("lang", "ctx").agg(F.sum("c").alias("total"), (F.sum(discount(F.col("c"))) / F.sum("c")).alias("g"))
        t = t.join(ctx, ["lang", "ctx"]).withColumn("own", (F.col("c") - discount(F.col("c"))) / F.col("total"))
        if k == 1:
            t = t.withColumn("p", F.col("own") + F.col("g") / 256)
        else:
            low = below.select("lang", F.col("code").alias("suffix"), F.col("p").alias("q"))
            t = t.withColumn("suffix", F.col("code").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))).join(low, ["lang", "suffix"]).withColumn("p", F.col("own") + F.col("g") * F.col("q"))
        below = C.stash(t.select("lang", "code", "p"), few=True)
        rows = below.select("lang", F.lit(k).alias("level"), "code", "p", F.lit(None).cast("double").alias("g"))
        contexts = ctx.select("lang", F.lit(k - 1).alias("level"), F.col("ctx").alias("code"), F.lit(None).cast("double").alias("p"), "g")
        both = rows.unionByName(contexts)
        out = both if out is None else out.unionByName(both)
    return out.groupBy("lang", "level", "code").agg(F.max("p").alias("p"), F.max("g").alias("g"))


def blocked(docs: DataFrame, key: str, text: str, lang: str, half: Column) -> DataFrame:
    """block, lang, half, key, t: blocks hold one language and half, and a bounded part of an input split (or of all rows)."""
    body, lan = F.coalesce(F.col(f"`{text}`"), F.lit("")), F.coalesce(F.col(f"`{lang}`"), F.lit(""))
    cols = [lan.alias("lang"), half.alias("half"), F.col(f"`{key}`").alias("key"), body.alias("t")]
    try:
        df = docs.select(F.xxhash64("_metadata.file_path", "_metadata.file_block_start").alias("split"), *cols)
        df.schema  # noqa: B018  resolves the hidden column, or fails
    except AnalysisException:
        df = docs.select(F.lit(0).cast("long").alias("split"), *cols)
    sizes = df.groupBy("split", "half").agg(F.sum(F.octet_length("t")).alias("n")).agg(F.max("n")).first()[0] or 0
    parts = max(1, -(-sizes // BLOCK_BYTES))
    return df.select(F.xxhash64("split", F.pmod(F.xxhash64("key"), F.lit(parts)), "lang", "half").alias("block"), "lang", "half", "key", "t")


def requests(docs: DataFrame, order: int) -> DataFrame:
    """block, lang, level, code: the distinct n-grams of every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, str], list[np.ndarray]] = {}
        size = 0
        for batch in batches:
            block, lang = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist())
            for lo, hi, buf, offsets in C.slices(C.text_column(batch, "t"), 2 << 20):
                code = codes(buf, offsets, order)
                by = np.repeat(block[lo:hi], np.diff(offsets))
                for b in np.unique(block[lo:hi]):
                    one = seen.setdefault((int(b), str(lang[lo:hi][block[lo:hi] == b][0])), [])
                    one.append(np.unique(code[by == b]))
                    size += len(one[-1])
            if size > 4_000_000:  # a task may read many blocks
                yield from _flush(seen, order)
                seen, size = {}, 0
        yield from _flush(seen, order)

    return docs.select("block", "lang", "t").mapInArrow(run, "block long, lang string, level int, code long").distinct()


def _flush(seen: dict[tuple[int, str], list[np.ndarray]], order: int) -> Iterator[pa.RecordBatch]:
    for (block, lang), parts in seen.items():
        u = np.unique(np.concatenate(parts))
        for level in range(order, -1, -1):
            n = len(u)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.array([lang] * n, pa.string()), pa.array(np.full(n, level, np.int32)), pa.array(u)], ["block", "lang", "level", "code"])
            if level:  # shorter n-grams and contexts; at a text's start the two differ
                u = np.unique(np.concatenate([u & ((1 << 8 * (level - 1)) - 1), u >> 8]))


def packed(docs: DataFrame, key_type: pa.DataType | None) -> DataFrame:
    """block, keys, sizes, body: texts of a block, compressed together."""
    schema = StructType.fromDDL("block long, sizes array<long>, body binary")
    schema = StructType([schema["block"], *StructType.fromDDL("keys array<string>, nulls array<boolean>").fields, schema["sizes"], schema["body"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            block, key = batch.column(0).to_numpy(), batch.column(1)
            for lo, hi, buf, offsets in C.slices(C.text_column(batch, "t"), 2 << 20):
                for b in np.unique(block[lo:hi]):
                    rows = np.flatnonzero(block[lo:hi] == b)
                    k = key.take(pa.array(rows + lo))
                    body = b"".join(buf[offsets[r] : offsets[r + 1]].tobytes() for r in rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(b)]), pa.array([k.cast(pa.string()).to_pylist()]), pa.array([k.is_null().to_pylist()]), pa.array([np.diff(offsets)[rows].tolist()], pa.list_(pa.int64())), pa.array([press.compress(body)], pa.binary())],
                        schema.names,
                    )

    return docs.select("block", "key", "t").mapInArrow(run, schema)


def _probabilities(code: np.ndarray, tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], order: int) -> np.ndarray:
    """p of each (distinct) highest-order code, backing off where an n-gram wasn't seen."""

    def look(level: int, x: np.ndarray, which: int, missing: float) -> np.ndarray:
        if level not in tables:
            return np.full(len(x), missing)
        keys = tables[level][0]
        at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
        v = tables[level][which][at]
        return np.where((keys[at] == x) & ~np.isnan(v), v, missing)

    p = look(0, np.zeros(len(code), np.int64), 2, 1.0) / 256
    for k in range(1, order + 1):
        gram = code & ((1 << 8 * k) - 1)
        p = np.where(np.isnan(own := look(k, gram, 1, np.nan)), (look(k - 1, gram >> 8, 2, 1.0) if k > 1 else 1.0) * p, own)
    return p


def score(docs: DataFrame, key_type, answers: DataFrame, order: int) -> DataFrame:
    """block, key, n_bytes and bits (mean -log2 p) of each document."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        level = answers.column("level").to_numpy()
        code, p, g = (answers.column(c).to_numpy() for c in ("code", "p", "g"))
        tables = {}
        for k in np.unique(level):
            mine = np.flatnonzero(level == k)
            mine = mine[np.argsort(code[mine], kind="stable")]
            tables[int(k)] = (code[mine], p[mine].astype(float), g[mine].astype(float))
        keys, nulls, sizes, bits = [], [], [], []
        press = zstandard.ZstdDecompressor()
        for i in range(texts.num_rows):
            size = np.array(texts.column("sizes")[i].as_py(), np.int64)
            buf = np.frombuffer(press.decompress(texts.column("body")[i].as_py()) if size.sum() else b"", np.uint8)
            offsets = np.concatenate(([0], np.cumsum(size)))
            u, back = np.unique(codes(buf, offsets, order), return_inverse=True)
            cost = np.concatenate(([0.0], np.cumsum(-np.log2(_probabilities(u, tables, order))[back])))
            bits.append((cost[offsets[1:]] - cost[offsets[:-1]]) / np.maximum(size, 1))
            sizes.append(size)
            keys += texts.column("keys")[i].as_py()
        return pa.table({"block": pa.array(np.full(len(keys), texts.column("block")[0].as_py() if texts.num_rows else 0)), "key": pa.array(keys, pa.string()), "n_bytes": pa.array(np.concatenate(sizes) if sizes else np.zeros(0, np.int64)), "bits": pa.array(np.round(np.concatenate(bits), 9) if bits else np.zeros(0))})

    return packed(docs, key_type).groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, "block long, key string, n_bytes long, bits double")


def of_half(half: Column) -> Column:
    """Name of the model of a language and half."""
    return F.concat_ws(":", half.cast("string"), "lang")


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", order: int = ORDER, quantile: float = 0.995, margin: float = 1.02, seed: int = 3, crossed: bool = False, ids_at_once: int = 1_000_000) -> DataFrame:
    """key, lang, n_bytes, bits, perplexity, threshold, kept for each row of docs."""
    ok = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    good = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.min(F.coalesce(ok, F.lit(False)).cast("int")).alias("good")).filter("good = 1").select("k")
    good = C.stash(good, few=True)
    half = lambda c: F.pmod(F.xxhash64(F.lit(seed), F.lit("half"), c), F.lit(2)).cast("int")
    trained = good if crossed else good.filter(half("k") == 0)
    held = good if crossed else good.filter(half("k") == 1)  # what its model has not seen sets the thresholds
    df = blocked(docs, key, text, lang, half(f"`{key}`") if crossed else F.lit(1))
    asked = df.select("block", of_half(F.col("half")).alias("lang"), "key", "t")  # the model that scores a document
    counts = counted(df.select(of_half(1 - F.col("half") if crossed else F.col("half")).alias("lang"), "key", "t"), trained, order, ids_at_once)
    answers = requests(asked, order).join(model(counts, order), ["lang", "level", "code"]).select("block", "level", "code", "p", "g")
    scored = score(asked, None, answers, order)
    names = df.select("block", "lang", of_half(F.col("half")).alias("model")).distinct()
    scored = C.stash(scored.join(names, "block").select(F.col("key").cast(docs.schema[key].dataType).alias(key), "lang", "model", "n_bytes", "bits"))
    # exact quantiles to a thousandth of a bit, from counts in fixed bins
    bins = scored.filter("n_bytes > 0").join(held, scored[key] == held["k"], "left_semi").groupBy("model", F.ceil(F.col("bits") * 1000).alias("bin")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("model").orderBy("bin"))
    all_of = F.sum("n").over(Window.partitionBy("model"))
    cut = bins.withColumn("share", upto / all_of).filter(F.col("share") >= quantile).groupBy("model").agg((F.min("bin") / 1000 * margin).alias("threshold"))
    cut = cut.join(counts.select(F.col("lang").alias("model")).distinct(), "model", "left_semi")
    cut = cut.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = scored.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(cut, ["model", "salt"], "left")
    return out.select(key, "lang", "n_bytes", "bits", F.pow(F.lit(2.0), "bits").alias("perplexity"), "threshold", F.coalesce(F.col("bits") <= F.col("threshold"), F.lit(True)).alias("kept"))


def counted(texts: DataFrame, trained: DataFrame, order: int, ids_at_once: int) -> DataFrame:
    """Counts of texts (lang, key, t) whose key is in trained (k), which is broadcast in parts of about ids_at_once."""
    parts = max(1, -(-trained.count() // ids_at_once))
    out = None
    for i in range(parts):
        ids = trained.filter(F.pmod(F.xxhash64(F.lit("part"), "k"), F.lit(parts)) == i)
        some = texts.join(F.broadcast(ids), texts["key"] == ids["k"], "left_semi").select("lang", "t")
        some = C.stash(count_ngrams(some, order), few=True)
        out = some if out is None else out.unionByName(some)
    return out if parts == 1 else C.stash(out.groupBy("lang", "code").agg(F.sum("c").alias("c")), few=True)


def query(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(C.tables(sf_dir, "documents")), spark.read.parquet(C.tables(sf_dir, "labels")), crossed=True)
