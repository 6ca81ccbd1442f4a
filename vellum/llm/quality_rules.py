"""Quality rules: statistics of each text, and an isolation forest over them.

Method. Rule statistics (symbols, capitals and repeated words for each word, repeated lines for each
line, digits for each byte, and the mean word length; all as log(1 + x)) make one point for each
document. Trees split a subsample at random features and values; a point's mean path length over the
trees says how easily it is cut off from the rest. Features are drawn with a probability that grows
with how well they tell the labelled good and bad rows of the sample apart (the fourth power of
|2 AUC - 1|, and at least `floor`, so that none is left out): anomalies in statistics that say nothing
about quality, such as a long tail of repeated lines among good rows, then count for little. The score
2 ** (-path / c(subsample)) above a threshold marks an anomaly. The threshold is calibrated on all
labelled rows that pass the base rules: of the scores that reject at most max_good_loss of the good
rows and 99 % of the bad rows that the least of them rejects, the middle one.

Bound on what is collected: the forest is grown on the driver from the sample_rows labelled
documents with the smallest hashed ids (a documented parameter); trees are sample_rows-independent
in size (subsample points each). The calibration collects a histogram of fixed width.

Defined results. Null text counts as empty: all counts 0, base_failed true, kept false. Null or
repeated ids, equal rows and extra columns are carried through; columns named like an output are
replaced. Very long texts are measured whole. Empty tables give empty results. Without labelled rows
the forest is grown from any rows and rejects nothing; without bad ones features are drawn evenly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from vellum.llm import common as C

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50  # fixed values of the base rules
SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_upper", "n_lines", "n_digits", "n_bytes"]


def _per_row(x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of x over each row's range."""
    total = np.concatenate(([0], np.cumsum(x, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)
_SYMBOL = np.isin(np.arange(256), SYMBOLS)
_CONT = (np.arange(256) & 0xC0) == 0x80
_NEWLINE = C._table([0x0A])


def _row_and_hash_repeats(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For items dealt to rows by counts: (in a group of two or more, not first of its group, row)."""
    row = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((h, row))
    hs, rs = h[order], row[order]
    same = np.zeros(len(h), bool)
    same[1:] = (hs[1:] == hs[:-1]) & (rs[1:] == rs[:-1])
    grouped = same.copy()
    grouped[:-1] |= same[1:]
    twice, later = np.zeros(len(h), bool), np.zeros(len(h), bool)
    twice[order], later[order] = grouped, same
    return twice, later, row


def statistics(buf: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS and EXTRA for each row of a slice."""
    starts, ends, first = C.words(buf, offsets, C.SPACE)
    prefix = C.prefix_hash(buf)
    n_words = np.diff(first)
    chars = _per_row(~(C.SPACE[buf] | _CONT[buf]), offsets)
    h = C.span_hash(prefix, starts, ends)
    wins, n_wins = C.grams(h, first, 3)
    covered = np.zeros(len(starts) + 3, np.int64)
    if len(wins):
        twice, _, row = _row_and_hash_repeats(wins, n_wins)
        begin = np.concatenate(([0], np.cumsum(n_wins)))[:-1]
        at = (np.arange(len(wins)) - begin[row] + first[:-1][row])[twice]
        for j in range(3):
            covered[at + j] = 1
    # lines: maximal runs between newlines; those without a word never count as repeated
    ls, le, lfirst = C.words(buf, offsets, _NEWLINE)
    word_in = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
    n_lines = _per_row(word_in, lfirst)
    lh = C.span_hash(prefix, ls[word_in], le[word_in])
    _, dup, lrow = _row_and_hash_repeats(lh, n_lines)
    return {
        "n_words": n_words,
        "word_chars": chars,
        "n_symbols": _per_row(_SYMBOL[buf], offsets),
        "n_dup_lines": np.bincount(lrow[dup], minlength=len(n_words)),
        "n_repeat_words": _per_row(covered[: len(starts)], first),
        "n_upper": _per_row(_UPPER[buf], offsets),
        "n_lines": n_lines,
        "n_digits": _per_row(_DIGIT[buf], offsets),
        "n_bytes": np.diff(offsets),
    }


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """Points for the forest: the rules' ratios as they are, on a scale on which small differences count."""
    per = {"n_symbols": "n_words", "n_upper": "n_words", "n_repeat_words": "n_words", "n_dup_lines": "n_lines", "n_digits": "n_bytes", "word_chars": "n_words"}
    return np.log1p(np.column_stack([s[k] / np.maximum(s[of], 1) for k, of in per.items()]))


N_FEATURES = 6


def separation(points: np.ndarray, bad: np.ndarray, power: float = 4.0, floor: float = 0.01) -> np.ndarray:
    """How likely each feature is drawn: by how far its areas under the curve, bad against good, are from one half."""
    n_bad, n_good = int(bad.sum()), int((~bad).sum())
    if not n_bad or not n_good:
        return np.ones(points.shape[1])
    out = np.empty(points.shape[1])
    for f in range(points.shape[1]):
        _, place, n = np.unique(points[:, f], return_inverse=True, return_counts=True)
        rank = (np.cumsum(n) - (n - 1) / 2)[place]  # equal values share their mean rank
        auc = (rank[bad].sum() - n_bad * (n_bad + 1) / 2) / (n_bad * n_good)
        out[f] = abs(2 * auc - 1) ** power
    return np.maximum(out, floor)


def _path_norm(n: float) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n points."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


class Forest:
    """Trees as flat arrays; node 2i+1 and 2i+2 are the children of node i."""

    def __init__(self, points: np.ndarray, trees: int, subsample: int, seed: int, weights: np.ndarray | None = None):
        rng = np.random.default_rng(seed)
        self.weights = np.ones(points.shape[1]) if weights is None else weights
        self.depth = int(np.ceil(np.log2(max(subsample, 2))))
        size = 2 ** (self.depth + 1) - 1
        self.feature = np.full((trees, size), -1, np.int16)
        self.cut = np.zeros((trees, size))
        self.length = np.zeros((trees, size))
        self.norm = _path_norm(min(subsample, max(len(points), 2)))
        for t in range(trees):
            pick = rng.permutation(len(points))[:subsample]
            self._grow(t, 0, points[pick], 0, rng)

    def _grow(self, t: int, node: int, x: np.ndarray, depth: int, rng: np.random.Generator) -> None:
        self.length[t, node] = depth + _path_norm(len(x))
        if depth >= self.depth or len(x) < 2:
            return
        lo, hi = x.min(0), x.max(0)
        open_to = np.flatnonzero(hi > lo)
        if not len(open_to):
            return
        odds = self.weights[open_to]
        f = int(rng.choice(open_to, p=odds / odds.sum()))
        cut = rng.uniform(lo[f], hi[f])
        self.feature[t, node], self.cut[t, node] = f, cut
        self._grow(t, 2 * node + 1, x[x[:, f] < cut], depth + 1, rng)
        self._grow(t, 2 * node + 2, x[x[:, f] >= cut], depth + 1, rng)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = self.feature[t, node]
                go = f >= 0
                right = x[rows, np.maximum(f, 0)] >= self.cut[t, node]
                node = np.where(go, 2 * node + 1 + right, node)
            total += self.length[t, node]
        return 2.0 ** (-total / len(self.feature) / max(self.norm, 1e-9))


def measure(docs: DataFrame, text: str = "text", keep: list[str] | None = None, forest: Forest | None = None) -> DataFrame:
    """The columns in keep, COUNTS, features as an array, and (with a forest) the anomaly score."""
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in {x.lower() for x in [*COUNTS, "features", "anomaly"]}]
    (source,) = C.fresh(keep, "__text")
    df = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(source))
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema
    for c in COUNTS:
        schema = schema.add(c, "long")
    schema = schema.add("features", ArrayType(DoubleType())).add("anomaly", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = C.text_column(batch, source)
            for lo, hi, buf, offsets in C.slices(col):
                s = statistics(buf, offsets)
                x = features(s)
                score = forest.score(x) if forest is not None else np.zeros(len(x))
                part = [batch.column(batch.schema.get_field_index(c)).slice(lo, hi - lo) for c in keep]
                listed = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*part, *[pa.array(s[c].astype(np.int64)) for c in COUNTS], listed, pa.array(score)], [*keep, *COUNTS, "features", "anomaly"])

    return df.mapInArrow(run, schema)


def _good(labels: DataFrame, key: str) -> DataFrame:
    """Labelled keys, once each; good where no row of the key says otherwise, bad where one says so."""
    ok = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    return labels.filter(F.col(key).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(key).alias("__k")).agg(F.min(ok.cast("int")).alias("__good"), F.max((F.col("quality") == 0).cast("int")).alias("__bad"))


def scored(points: DataFrame, forest: Forest) -> DataFrame:
    """points (from measure) with the anomaly score of their features."""
    names = [c for c in points.columns if c != "anomaly"]
    base = points.select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(batch.schema.get_field_index("features")).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forest.score(x))], [*batch.schema.names, "anomaly"])

    return base.mapInArrow(run, StructType(list(base.schema)).add("anomaly", "double"))


def fit(points: DataFrame, labels: DataFrame, key: str = "doc_id", trees: int = 256, subsample: int = 128, sample_rows: int = 4096, max_good_loss: float = 0.01, seed: int = 7) -> tuple[Forest, float]:
    """Grow the forest on points (from measure) and calibrate its threshold."""
    lab = _good(labels, key)
    # what the base rules reject anyway would only widen the threshold
    marked = points.filter(~base_failed()).select(key, "features").join(lab, F.col(key) == F.col("__k"), "left")
    order = F.xxhash64(F.lit(seed), F.col(key))
    # labelled rows first, so that others serve only where there are none at all
    rank = F.when(F.col("__good").isNotNull(), 0).otherwise(1)
    rows = marked.select(rank.alias("rank"), order.alias("at"), F.col(key), "features", "__bad").orderBy("rank", "at", key).limit(sample_rows).collect()
    if any(r["rank"] == 0 for r in rows):
        rows = [r for r in rows if r["rank"] == 0]
    if not rows:
        return Forest(np.zeros((2, N_FEATURES)), 1, 2, seed), float("inf")
    points = np.array([r["features"] for r in rows])
    forest = Forest(points, trees, subsample, seed, separation(points, np.array([r["__bad"] == 1 for r in rows])))
    bins = 2000
    found = (
        scored(marked.filter("__good = 1 or __bad = 1").select("features", "__bad"), forest)
        .groupBy("__bad", F.least(F.floor(F.col("anomaly") * bins), F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count("*").alias("n"))
        .collect()
    )
    counts = np.zeros((2, bins))
    for r in found:
        counts[r["__bad"], max(r["bin"], 0)] += r["n"]
    good, bad = counts[:, ::-1].cumsum(1)[:, ::-1]  # rows in this bin or a higher one
    if not good[0]:
        return forest, float("inf")
    cut = np.flatnonzero(good <= max_good_loss * good[0])
    if not len(cut):
        return forest, float("inf")
    # in the middle of the range that catches the same bad rows
    same = np.flatnonzero(bad >= 0.99 * bad[cut[0]])[-1] if bad[cut[0]] else cut[0]
    return forest, float((cut[0] + max(same, cut[0])) / 2 / bins)


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **fit_args) -> DataFrame:
    """One row for each document: key, COUNTS, base_failed, anomaly, threshold and kept. Texts are read once."""
    points = C.stash(measure(docs, text, [key]).drop("anomaly"))
    forest, cut = fit(points, labels, key, **fit_args)
    out = scored(points, forest).drop("features")
    return out.withColumn("base_failed", base_failed()).withColumn("threshold", F.lit(cut)).withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < cut))


def keep(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **fit_args) -> DataFrame:
    """The rows of docs that the rules accept, all columns as they were."""
    points = C.stash(measure(docs, text, [key]).drop("anomaly"))
    forest, cut = fit(points, labels, key, **fit_args)
    # measured again beside the row, so that no join carries texts
    row, copy = C.fresh([], "__row", "__copy")
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), F.col(f"`{text}`").alias(copy))
    return measure(boxed, copy, [row], forest).filter(~base_failed() & (F.col("anomaly") < cut)).select(f"{row}.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(C.tables(sf_dir, "documents")).select("doc_id", "text")
    labels = spark.read.parquet(C.tables(sf_dir, "labels"))
    return judge(docs, labels).select("doc_id", *COUNTS, "base_failed", "kept", "anomaly", "threshold")


def counts_query(spark, sf_dir: str) -> DataFrame:
    """The counts and the base rules of query, without its forest."""
    docs = spark.read.parquet(C.tables(sf_dir, "documents")).select("doc_id", "text")
    return measure(docs, keep=["doc_id"]).select("doc_id", *COUNTS, base_failed().alias("base_failed"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the rules accept."""
    return keep(docs, spark.read.parquet(C.tables(sf_dir, "labels")))
