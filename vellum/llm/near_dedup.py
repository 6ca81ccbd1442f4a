"""MinHash near-dedup with BagMinHash signatures of word-shingle bags.

Method. A text's bag holds its five-word shingles with their multiplicities (weights discretised to
whole numbers). Every (shingle, weight octave) owns a Poisson process of random points, each with a
time, a signature slot and a weight level; octave j covers the levels (2**(j-1), 2**j], with a rate
in proportion to its width, and a point counts if its level is at most the weight. So a weight w
costs about log2(w) processes, and points are made in order of time only until they can't beat the
slowest slot. A slot keeps its earliest point. Two bags agree in a slot with a probability equal to
their weighted Jaccard similarity. Slots are banded; texts that share a band are candidates.
Candidates are verified by the exact multiset overlap, sum of min over sum of max, at 0.8 or more.

Linking. Texts with equal word sequences are one class before anything else, however many copies
there are. In each band bucket, members are paired with two pivots only: the member that shares most
bands with other classes (the original, where edited copies resemble it more than one another) and
the least one. The verified links give components. Members of one bucket that are still in different
components have their signatures compared across components, in blocks, and those that agree nearly
enough are verified too. Within a component no pair is made, so n near copies cost a multiple of n
rows.

Scale. Copies collapse by partial aggregation. Classes are 128-bit hashes. Bags aren't stored:
verification reads the texts of the few classes in candidate pairs. Components are found by
alternating large-star and small-star rounds, written to the shared folder after each round.

Defined results. Null text counts as empty. Texts without words are equal to texts with the same
bytes (all empty texts are one group); a text of one to four words is one shingle. Rows with null keys
count; a group's id is its least non-null key (null if it has none), and one row of each group is
kept: of the rows with that key the one with the least class, and of equal rows any one. Texts are
read whole, however long; a text longer than a slice is a slice. Extra columns are ignored by groups
and carried by keep_one, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vellum.llm import common as C

SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 32, 6


def hashed_words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = C.LOWER[buf]
    starts, ends, first = C.words(low, offsets, C.NOT_ALNUM)
    return C.span_hash(C.prefix_hash(low), starts, ends), first


def bags(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, shingle and multiplicity of all distinct shingles, ordered by row and shingle."""
    g, counts = C.grams(h, first, k)
    row = np.repeat(np.arange(len(counts)), counts)
    size = np.diff(first)
    short = np.flatnonzero((size > 0) & (size < k))
    if len(short):
        whole = np.array([_sequence(h[first[r] : first[r + 1]], np.uint64(77)) for r in short], np.uint64)
        g, row = np.concatenate([g, whole]), np.concatenate([row, short])
    if not len(g):
        return row, g, np.zeros(0, np.int64)
    order = np.lexsort((g, row))
    g, row = g[order], row[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return row[at], g[at], np.diff(np.append(at, len(g)))


def _sequence(h: np.ndarray, salt: np.uint64) -> np.uint64:
    """Hash of a sequence of hashes."""
    place = C.mix(np.arange(1, len(h) + 1, dtype=np.uint64) * salt)
    return C.mix(np.array([(C.mix(h ^ place)).sum(dtype=np.uint64) + np.uint64(len(h))], np.uint64))[0]


def class_ids(h: np.ndarray, first: np.ndarray, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each row's word sequence (of its bytes where it has no words)."""
    size = np.diff(first)
    place = np.arange(len(h)) - np.repeat(first[:-1], size)
    out = np.zeros((len(size), 2), np.uint64)
    for c, salt in enumerate((0xA24BAED4963EE407, 0x9FB21C651E98DF25)):
        x = C.mix(h ^ C.mix((place + 1).astype(np.uint64) * np.uint64(salt)))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)))
        out[:, c] = C.mix(total[first[1:]] - total[first[:-1]] + size.astype(np.uint64) * np.uint64(salt | 1))
    for r in np.flatnonzero(size == 0):
        raw = buf[offsets[r] : offsets[r + 1]].astype(np.uint64) + np.uint64(300)
        out[r] = [_sequence(raw, np.uint64(0xA24BAED4963EE407)), _sequence(raw, np.uint64(0x9FB21C651E98DF25))]
    return out


def signatures(row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, rows: int, m: int) -> np.ndarray:
    """BagMinHash signatures: the time of each slot's earliest point, inf for empty bags."""
    slot = np.full(rows * m, np.inf)
    octave = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64)
    many = octave + 1
    src = np.repeat(np.arange(len(row)), many)
    j = (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)).astype(np.int64)
    row, weight = row[src], weight[src]
    low = np.where(j == 0, 0, 2.0 ** (j - 1))  # levels (low, low + width]
    width = np.where(j == 0, 1.0, 2.0 ** np.maximum(j - 1, 0))
    base = C.mix(shingle[src] + (j + 1).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    time = np.zeros(len(row))
    made = 0
    while len(row):
        # a few points at once where few processes are left; sums stay in order, so results don't depend on it
        step = min(max(8192 // len(row), 1), 256)
        count = (made + 1 + np.arange(step, dtype=np.uint64))[:, None]
        state = C.mix(base + count * np.uint64(0x9E3779B97F4A7C15))
        gap = -np.log(((state >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)) / width
        times = np.cumsum(np.concatenate([time[None], gap]), axis=0)[1:]
        other = C.mix(state ^ np.uint64(0x5851F42D4C957F2D))
        where = (((other >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)).astype(np.int64)
        level = low + width * ((other & np.uint64(0xFFFFFFFF)).astype(np.float64) + 1) / float(1 << 32)
        counts = level <= weight
        np.minimum.at(slot, (row * m + where)[counts], times[counts])
        time, made = times[-1], made + step
        on = time < slot.reshape(rows, m).max(1)[row]
        row, weight, low, width, base, time = row[on], weight[on], low[on], width[on], base[on], time[on]
    return slot.reshape(rows, m)


def band_hashes(sig: np.ndarray, bands: int, per: int) -> np.ndarray:
    bits = sig.view(np.uint64).reshape(len(sig), bands, per)
    acc = np.broadcast_to(C.mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(sig), bands)).copy()
    for k in range(per):
        acc = C.mix(acc ^ bits[:, :, k])
    return acc


def _ids(x: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(x), [None, pa.py_buffer(np.ascontiguousarray(x.astype(">u8")))]).cast(pa.binary())


def classified(docs: DataFrame, key: str, text: str, bands: int, per: int, shingle: int) -> DataFrame:
    """key, class (16 bytes) and band hashes (empty for texts without words) of each row."""
    schema = StructType([docs.schema[key], *StructType.fromDDL("class binary, bands array<bigint>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in C.slices(C.text_column(batch, "t")):
                h, first = hashed_words(buf, offsets)
                sig = signatures(*bags(h, first, shingle), hi - lo, bands * per)
                some = np.diff(first) > 0
                listed = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(some * bands))), pa.int32()), C.long_of(band_hashes(sig[some], bands, per).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), _ids(class_ids(h, first, buf, offsets)), listed], schema.names)

    return docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).mapInArrow(run, schema)


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of pairs (a, b) whose bags overlap enough."""
    a = texts.select(F.col("class").alias("a"), F.col("t").alias("ta"))
    b = texts.select(F.col("class").alias("b"), F.col("t").alias("tb"))
    joined = pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, at = batch.num_rows, 0
            ta, tb = C.text_column(batch, "ta"), C.text_column(batch, "tb")
            while at < n:  # pairs by the megabyte
                for lo, hi, _, _ in C.slices(ta.slice(at), 1 << 20):
                    break
                k = hi - lo
                rows, grams, weights = [], [], []
                for col in (ta, tb):
                    r, g, w = _bags_of(col.slice(at, k), shingle)
                    rows.append(r), grams.append(g), weights.append(w)
                size = np.bincount(rows[0], weights[0], k) + np.bincount(rows[1], weights[1], k)
                r, g, w = np.concatenate(rows), np.concatenate(grams), np.concatenate(weights)
                order = np.lexsort((g, r))
                r, g, w = r[order], g[order], w[order]
                both = np.flatnonzero((r[1:] == r[:-1]) & (g[1:] == g[:-1]))
                common = np.bincount(r[both], np.minimum(w[both], w[both + 1]), k)
                ok = np.flatnonzero((common > 0) & (common >= similarity * (size - common) - 1e-9)) + at
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ok)), batch.column(1).take(pa.array(ok))], ["a", "b"])
                at += k

    return joined.mapInArrow(run, "a binary, b binary")


def _bags_of(col: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = []
    for lo, _, buf, offsets in C.slices(col, 4 << 20):
        r, g, w = bags(*hashed_words(buf, offsets), shingle)
        parts.append((r + lo, g, w))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root for every node of edges (a, b); root is the component's least node."""
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    for _ in range(rounds):
        # large star: every node's greater neighbours go to its least neighbour or itself
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: every node and its lesser neighbours go to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        new = C.stash(small, few=True)
        moved = new.join(e, ["a", "b"], "left_anti").limit(1).count() + e.join(new, ["a", "b"], "left_anti").limit(1).count()
        e = new
        if not moved:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, per: int = ROWS) -> DataFrame:
    """key, class, root, group_id (the least key of the group), group_size and kept for each row of docs."""
    named = C.stash(classified(docs, key, text, bands, per, shingle).withColumn("__uid", F.monotonically_increasing_id()))
    classes = named.groupBy("class").agg(F.first("bands").alias("bands"))
    slots = classes.select("class", F.posexplode("bands").alias("at", "band"))
    often = slots.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    held = C.stash(slots.join(often, "band"))
    # a hub shares more bands with more classes than its neighbours: the original of edited copies
    hubs = held.groupBy("class").agg(F.sum("n").alias("reach"))
    pivots = held.join(hubs, "class").groupBy("band").agg(F.max(F.struct("reach", "class")).alias("hub"), F.min("class").alias("lo")).select("band", "hub.class", "lo").withColumnRenamed("class", "hub")
    stars = held.join(pivots, "band").select("class", F.explode(F.array("hub", "lo")).alias("other")).filter("class <> other")
    pairs = C.stash(stars.select(F.least("class", "other").alias("a"), F.greatest("class", "other").alias("b")).distinct())
    texts = C.stash(_texts(docs, held.select("class").distinct(), text))
    edges = C.stash(verified(pairs, texts, shingle, similarity), few=True)
    comp = components(edges)
    # members of a bucket that are still apart
    rooted = held.select("band", "at", "class").join(comp.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    apart = rooted.groupBy("band").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("band")
    open_ = C.stash(rooted.join(apart, "band").distinct())
    more = C.stash(likely(open_, texts, shingle, bands, per, similarity).join(pairs, ["a", "b"], "left_anti"), few=True)
    # the new links join components: they are settled among the roots alone
    found = verified(more, texts, shingle, similarity)
    for side in ("a", "b"):
        found = found.join(comp.select(F.col("node").alias(side), F.col("root").alias("__r")), side, "left").withColumn(side, F.coalesce("__r", side)).drop("__r")
    last = components(C.stash(found, few=True)).select(F.col("node").alias("root"), F.col("root").alias("__last"))
    rooted = named.drop("bands").join(comp.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    rooted = rooted.join(last, "root", "left").withColumn("root", F.coalesce("__last", "root")).drop("__last")
    first = F.min(F.struct(F.col(key).isNull().alias("__null"), F.col(key).alias("__k"), "class", "__uid"))
    ids = rooted.groupBy("root").agg(first.alias("__first"), F.count("*").alias("group_size"))
    ids = C.stash(ids)  # a join of two exchanges, which Spark may split where a group is large
    kept = F.col("__uid") == F.col("__first.__uid")
    return rooted.join(ids, "root").select(key, "class", "root", F.col("__first.__k").alias("group_id"), "group_size", kept.alias("kept"))


def likely(members: DataFrame, texts: DataFrame, shingle: int, bands: int, per: int, similarity: float, block: int = 4000, fine: int = 768) -> DataFrame:
    """Pairs (a, b) of one band and different roots whose signatures agree nearly enough to be verified.

    A band's members are cut into blocks of about `block`; pairs of blocks are compared slot by slot
    in NumPy, so that rows are made for likely pairs only. The banded slots sift first, within 0.1 of
    the similarity; a second signature of `fine` slots decides, within four of its standard deviations.
    A pair that shares several bands is compared in the first of them. Signatures keep 16 bits a slot.
    """
    slots = bands * per
    slack = 4 * (similarity * (1 - similarity) / fine) ** 0.5

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in C.slices(C.text_column(batch, "t")):
                row, g, weight = bags(*hashed_words(buf, offsets), shingle)
                both = [signatures(row, g, weight, hi - lo, slots), signatures(row, C.mix(g ^ np.uint64(0x3C79AC492BA7B653)), weight, hi - lo, fine)]
                short = np.ascontiguousarray((C.mix(np.hstack(both).view(np.uint64)) >> np.uint64(48)).astype(np.uint16))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([x.tobytes() for x in short], pa.binary())], ["class", "sig"])

    signed = texts.join(members.select("class").distinct(), "class", "left_semi").select("class", "t").mapInArrow(sign, "class binary, sig binary")
    counts = members.groupBy("band").agg(F.count("*").alias("n"))
    placed = members.join(counts, "band").withColumn("part", F.pmod(F.xxhash64("class"), F.ceil(F.col("n") / block)))
    heaps = placed.join(signed, "class").groupBy("band", "at", "part").agg(F.collect_list(F.struct("class", "root", "sig")).alias("x"))
    other = heaps.select("band", F.col("part").alias("part2"), F.col("x").alias("y"))  # (members / block)**2 / 2 pairs a band

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (ca, ra, sa), (cb, rb, sb) = (_heap(batch.column(c)[i].values, slots + fine) for c in (0, 1))
                a, b = [], []
                band = batch.column(2)[i].as_py()
                for at in range(0, len(sa), 16):
                    equal = sa[at : at + 16, None, :slots] == sb[None, :, :slots]
                    x, y = np.nonzero((equal.sum(2) >= (similarity - 0.1) * slots) & (ra[at : at + 16, None] != rb[None]))
                    mine = equal[x, y].reshape(-1, bands, per).all(2).argmax(1) == band
                    x, y = x[mine] + at, y[mine]
                    sure = (sa[x, slots:] == sb[y, slots:]).mean(1) >= similarity - slack
                    for u, v in zip(x[sure], y[sure], strict=True):
                        if ca[u] != cb[v]:
                            a.append(min(ca[u], cb[v])), b.append(max(ca[u], cb[v]))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return heaps.join(other, "band").filter("part <= part2").select("x", "y", "at").mapInArrow(compare, "a binary, b binary").distinct()


def _heap(values: pa.Array, slots: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    sig = np.frombuffer(b"".join(values.field("sig").to_pylist()), np.uint16).reshape(-1, slots)
    return values.field("class").to_pylist(), np.array(values.field("root").to_pylist(), object), sig


def _texts(docs: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """class, text: one text for each wanted class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in C.slices(C.text_column(batch, "t")):
                yield pa.RecordBatch.from_arrays([_ids(class_ids(*hashed_words(buf, offsets), buf, offsets)), batch.column(0).slice(lo, hi - lo)], ["class", "t"])

    found = docs.select(F.col(f"`{text}`").alias("t")).mapInArrow(run, "class binary, t string").join(wanted, "class", "left_semi")
    return found.groupBy("class").agg(F.first("t").alias("t"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **args) -> DataFrame:
    """Rows of docs, one of each group (with the least key), all columns as they were."""
    found = C.stash(groups(docs, key, text, **args))
    first = found.filter(F.col(key).eqNullSafe(F.col("group_id")))
    # several rows may share the least key: of different classes, or equal rows
    one = first.groupBy("root").agg(F.min("class").alias("class"), F.count("*").alias("n"))
    wanted = first.join(one, ["root", "class"]).select(F.col(key).alias("__k"), "class", "root", "n").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in C.slices(C.text_column(batch, "t")):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), _ids(class_ids(*hashed_words(buf, offsets), buf, offsets))], ["row", "class"])

    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("t"))
    marked = boxed.mapInArrow(run, StructType([*boxed.select("row").schema.fields, *StructType.fromDDL("class binary").fields]))
    kept = marked.join(wanted, (marked["class"] == wanted["class"]) & F.col(f"row.`{key}`").eqNullSafe(F.col("__k")))
    return kept.filter("n = 1").select("row").unionByName(kept.filter("n > 1").dropDuplicates(["root"]).select("row")).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    out = groups(spark.read.parquet(C.tables(sf_dir, "documents")).select("doc_id", "text"))
    return out.select("doc_id", "group_id", "group_size", "kept")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return keep_one(docs)
