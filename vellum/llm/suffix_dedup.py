"""Suffix-array dedup on a run-length index: long strings that occur more than once are removed.

Method. A byte goes if a string of `length` bytes that covers it also starts anywhere else, in the
same document or another. Windows of that length are dealt out by content: of a window's k-grams the
one with the least hash (the leftmost of equals) is its anchor, so equal windows have equal anchors.
Consecutive windows with one anchor make a stretch, told from others by its anchor, length and two
64-bit hashes of its bytes. Only stretches whose anchor stands elsewhere too go on. Where all stretches
of an anchor are equal, all their bytes go; that settles copies of whole documents without their
texts. Of other anchors, equal stretches go on once, with their count. For each bucket of anchors a
run-length index is built over its stretches: suffix order, Burrows-Wheeler transform, its runs, and the suffix
samples at both ends of every run. Matching statistics are streamed from it: the match of a suffix
with its neighbour in suffix order is compared byte by byte at run ends only, and is one shorter
than its left neighbour's everywhere else. A window whose longest match elsewhere reaches `length`,
or whose stretch occurs twice, marks its bytes.

Scale. Anchors are counted with partial aggregation, and looked up by a join that Spark may split.
A bucket holds a bounded number of bytes. An anchor with more than hot_texts different stretches is
not put in a bucket: its stretches are dealt out again by another order of the grams, which sorts out
all windows whose new anchor is in one place only, and spreads the rest over new buckets. What is
crowded in each of `deals` orders is counted window by window by 128-bit hashes. Copies of a document count as rows of numbers until the last step.

Defined results. Null text is empty: nothing removed. Texts shorter than `length` are kept whole.
Rows equal in key and text are two documents, each the other's copy. Null keys are kept. Very long
texts are cut into pieces that overlap by a window less one byte, so that each window lies in one
piece. Extra columns are ignored, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vellum.llm import common as C

LENGTH, GRAM = 200, 64
PIECE = 4 << 20  # bytes of a long text whose windows are hashed at once
POS_BITS = 26  # places in a slice or piece; the remaining bits order the grams


def stretches(buf: np.ndarray, offsets: np.ndarray, length: int, k: int, salt: int = 0) -> tuple[np.ndarray, ...]:
    """Row, start in the row, byte length, anchor hash and two content hashes of every stretch of a slice."""
    n, w = len(buf), length - k + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return (none, none, none, *[none.view(np.uint64)] * 3)
    counts = np.maximum(np.diff(offsets) - length + 1, 0)  # windows of each row
    total = int(counts.sum())
    if not total:
        return (none, none, none, *[none.view(np.uint64)] * 3)
    prefix = C.prefix_hash(buf)
    h = (prefix[k:] - prefix[:-k]) * C._power(C._B_INV, n - k + 1)
    h += np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    mask = np.uint64((1 << POS_BITS) - 1)
    # least of every w neighbours, from running minima of blocks of w in both directions
    blocks = -(-len(h) // w)
    padded = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    packed = padded[: len(h)]
    np.bitwise_and(h, ~mask, out=packed)
    packed |= np.arange(len(h), dtype=np.uint64)
    grid = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - length + 1
    anchor = (np.minimum(back[:m], ahead[w - 1 : w - 1 + m]) & mask).astype(np.int64)
    row = np.repeat(np.arange(len(counts)), counts)
    starts = np.arange(total) + np.repeat(offsets[:-1] - (np.cumsum(counts) - counts), counts)
    anchor = anchor[starts]
    new = np.ones(total, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    a = starts[first]
    b = starts[np.append(first[1:] - 1, total - 1)] + length
    at = anchor[first]
    return row[first], a - offsets[row[first]], b - a, C.span_hash(prefix, at, at + k), C.span_hash(prefix, a, b), _other_hash(buf, a, b)


_OTHER = np.uint64(0xC2B2AE3D27D4EB4F)
_OTHER_INV = np.uint64(pow(int(_OTHER), -1, 1 << 64))


def _other_hash(buf: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of each span's bytes by another base and other values of the bytes than C.span_hash."""
    prefix = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_VALUES[buf] * C._power(_OTHER, len(buf)), out=prefix[1:])
    return C.mix((prefix[b] - prefix[a]) * C._power(_OTHER_INV, len(buf) + 1)[a])


_VALUES = C.mix(np.arange(1, 257, dtype=np.uint64))


def long_slices(col: pa.Array, length: int, piece: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, byte at which the slice begins in it, bytes and offsets: slices, and pieces of longer texts."""
    for lo, hi, buf, offsets in C.slices(col):
        if hi - lo > 1 or len(buf) <= piece + length:
            yield lo, 0, buf, offsets
        else:
            for at in range(0, len(buf) - length + 1, piece):
                part = buf[at : at + piece + length - 1]
                yield lo, at, part, np.array([0, len(part)], np.int64)


class RunLengthIndex:
    """A run-compressed Burrows-Wheeler transform with suffix samples at the ends of its runs."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        """data: texts one after another; ends: where each ends. A separator follows each."""
        begins = np.concatenate(([0], ends[:-1]))
        self.begins = begins + np.arange(len(ends))
        self.ends = ends + np.arange(len(ends))
        sym = np.zeros(len(data) + len(ends), np.uint64)
        sym[np.arange(len(data)) + np.repeat(np.arange(len(ends)), ends - begins)] = data.astype(np.uint64) + np.uint64(1)
        n = len(sym)
        self.n = n
        wide = np.concatenate([sym, np.zeros(8, np.uint64)])
        key = np.zeros(n, np.uint64)
        for j in range(7):  # seven symbols of nine bits
            key = (key << np.uint64(9)) | wide[j : j + n]
        sa = np.argsort(key)  # ties are settled below
        sorted_key = key[sa]
        head = np.ones(n, bool)
        head[1:] = sorted_key[1:] != sorted_key[:-1]
        rank = np.empty(n, np.int64)
        rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        tied = ~head
        tied[:-1] |= ~head[1:]
        slots, h = np.flatnonzero(tied), 7
        while len(slots):  # prefix doubling, of the ties only
            idx = sa[slots]
            second = np.where(idx + h < n, rank[np.minimum(idx + h, n - 1)] + 1, 0)
            both = rank[idx] * np.int64(n + 1) + second
            order = np.argsort(both)
            idx, both = idx[order], both[order]
            sa[slots] = idx
            head = np.ones(len(slots), bool)
            head[1:] = both[1:] != both[:-1]
            rank[idx] = np.maximum.accumulate(np.where(head, slots, 0))
            tied = ~head
            tied[:-1] |= ~head[1:]
            slots, h = slots[tied], 2 * h
        bwt = np.where(sa > 0, sym[sa - 1], np.uint64(511))
        heads = np.flatnonzero(bwt[1:] != bwt[:-1]) + 1
        self.run_symbols = bwt[np.concatenate(([0], heads))]
        self.run_lengths = np.diff(np.concatenate(([0], heads, [n])))
        self.run_first = sa[np.concatenate(([0], heads))]  # suffixes sampled at run starts
        self.run_last = sa[np.concatenate((heads - 1, [n - 1]))]  # and at run ends
        self.key, self.wide = key, wide

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the longest common prefixes of suffixes a and b."""
        out = np.zeros(len(a), np.int64)
        live = np.arange(len(a))
        key = np.concatenate([self.key, np.zeros(1, np.uint64)])
        while len(live):
            x, y = np.minimum(a[live] + out[live], self.n), np.minimum(b[live] + out[live], self.n)
            same = (key[x] == key[y]) & (x < self.n) & (y < self.n)
            out[live[same]] += 7
            live = live[same]
        for _ in range(7):
            x, y = a + out, b + out
            ok = (x < self.n) & (y < self.n)
            ok[ok] = self.wide[x[ok]] == self.wide[y[ok]]
            if not ok.any():
                break
            out += ok
        return out

    def matching_statistics(self) -> np.ndarray:
        """For every position the longest match that starts at another position."""
        lcp = self._common(self.run_first[1:], self.run_last[:-1])
        best = np.zeros(self.n, np.int64)
        for at, value in ((self.run_first, np.concatenate(([0], lcp))), (self.run_last, np.concatenate((lcp, [0])))):
            # between samples, in text order, a match is one shorter than the one to its left
            sampled = np.full(self.n, -1, np.int64)
            sampled[at] = at
            length = np.zeros(self.n, np.int64)
            length[at] = value
            last = np.maximum.accumulate(sampled)
            np.maximum(best, np.where(last >= 0, length[last] - (np.arange(self.n) - last), 0), out=best)
        return best


def repeated_windows(texts: pa.Array, weights: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
    """For each text the ranges [a, b) of window starts whose window occurs elsewhere."""
    sizes = np.array([len(x) for x in texts.to_pylist()], np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(texts.to_pylist()), np.uint8)
    index = RunLengthIndex(data, ends)
    long = index.matching_statistics() >= length
    out = []
    for t in range(len(sizes)):
        a, m = index.begins[t], sizes[t] - length + 1
        out.append(_ranges(np.ones(m, bool) if weights[t] > 1 else long[a : a + m]))
    return out


def _ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


IDS = "k long, h long"
RANGES = "array<struct<a:int,b:int>>"


def _arrow_ranges(found: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"a": a, "b": b} for a, b in x] for x in found], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))


def marked(docs: DataFrame, length: int, gram: int, bucket_bytes: int, hot_texts: int, deal: int = 0, deals: int = 3) -> DataFrame:
    """k, h and the ranges of removed bytes (overlapping ones among them) of the documents that lose any. docs: k, h, t.

    deal: which of the orders of grams decides the anchors.
    """
    fields = f"{IDS}, start int, size int, anchor long, content long, other long"

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, h = (batch.column(i).to_numpy() for i in (0, 1))
            for lo, skip, buf, offsets in long_slices(C.text_column(batch, "t"), length):
                row, start, size, *hashes = stretches(buf, offsets, length, gram, deal)
                yield pa.RecordBatch.from_arrays([pa.array(k[row + lo]), pa.array(h[row + lo]), pa.array((start + skip).astype(np.int32)), pa.array(size.astype(np.int32)), *map(C.long_of, hashes)], ["k", "h", "start", "size", "anchor", "content", "other"])

    rows = docs.mapInArrow(split, fields)
    # written, so that the join below is one of two exchanges, which Spark may split where an anchor is frequent
    equal = (F.min("content") == F.max("content")) & (F.min("other") == F.max("other"))
    often = C.stash(rows.groupBy("anchor").agg(F.count("*").alias("n"), equal.alias("sole")).filter("n > 1").select("anchor", "sole"))
    live = C.stash(rows.join(often, "anchor"))
    one = ["anchor", "content", "other", "size"]
    texts = C.stash(live.filter("not sole").groupBy(*one).agg(F.count("*").alias("n"), F.min(F.struct("k", "h", "start")).alias("rep")))
    crowd = texts.groupBy("anchor").agg(F.count("*").alias("m")).filter(F.col("m") > hot_texts).select("anchor")
    total = texts.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    wanted = texts.select("rep.k", "rep.h", F.struct("rep.start", "size", "anchor", "content", "other", "n").alias("w")).groupBy("k", "h").agg(F.collect_list("w").alias("w"))
    source = docs.join(wanted, ["k", "h"]).select("t", "w")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = C.text_column(batch, "t")
            for i in range(batch.num_rows):
                parts, raw = batch.column(1)[i].as_py(), t[i].as_buffer().to_pybytes()
                for at in range(0, len(parts), 4096):
                    some = parts[at : at + 4096]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([p["anchor"] for p in some]), pa.array([p["content"] for p in some]), pa.array([p["other"] for p in some]), pa.array([p["size"] for p in some], pa.int32()), pa.array([p["n"] for p in some]), pa.array([raw[p["start"] : p["start"] + p["size"]] for p in some], pa.binary())],
                        ["anchor", "content", "other", "size", "n", "body"],
                    )

    bodies = source.mapInArrow(cut, "anchor long, content long, other long, size int, n long, body binary")
    # a document of which there are equal rows gives equal bodies
    bodies = C.stash(bodies.dropDuplicates(one))
    found_schema = f"anchor long, content long, other long, size int, found {RANGES}"

    def index(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        found = repeated_windows(table.column("body").combine_chunks(), table.column("n").to_numpy(), length)
        return pa.table({"anchor": table.column("anchor"), "content": table.column("content"), "other": table.column("other"), "size": table.column("size"), "found": _arrow_ranges(found)})

    even = bodies.join(crowd, "anchor", "left_anti").withColumn("bucket", F.pmod(F.xxhash64(F.lit(5), "anchor"), F.lit(buckets)))
    found = even.groupBy("bucket").applyInArrow(index, found_schema).filter(F.size("found") > 0)
    if crowd.limit(1).count():
        crowded = bodies.join(crowd, "anchor", "left_semi")
        if deal + 1 < deals:
            named = C.stash(crowded.select(*one, "n", F.xxhash64("anchor", "content").alias("k"), F.xxhash64("other", "size").alias("h"), "body"))
            again = marked(named.select("k", "h", F.col("body").alias("t")), length, gram, bucket_bytes, hot_texts, deal + 1, deals)
            starts = F.transform("r", lambda x: F.struct(x["a"].alias("a"), (x["b"] - (length - 1)).alias("b")))
            every = F.array(F.struct(F.lit(0).alias("a"), (F.col("size") - (length - 1)).alias("b")))
            others = named.join(again, ["k", "h"], "left").select(*one, F.when(F.col("n") > 1, every).otherwise(starts).alias("found")).filter(F.size("found") > 0)
        else:
            others = _one_by_one(crowded, length)
        found = found.unionByName(others)
    whole = live.filter("sole").select("k", "h", F.array(F.struct(F.col("start").alias("a"), (F.col("start") + F.col("size")).alias("b"))).alias("r"))
    ranges = live.filter("not sole").join(found, one).select("k", "h", F.transform("found", lambda x: F.struct((x["a"] + F.col("start")).alias("a"), (x["b"] + F.col("start") + length - 1).alias("b"))).alias("r"))
    return ranges.unionByName(whole).groupBy("k", "h").agg(F.flatten(F.collect_list("r")).alias("r"))


def _one_by_one(bodies: DataFrame, length: int) -> DataFrame:
    """Windows of crowded anchors, counted by 128-bit hashes."""
    one = ["anchor", "content", "other", "size", "n"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, raw in enumerate(batch.column(len(one)).to_pylist()):
                buf = np.frombuffer(raw, np.uint8)
                at = np.arange(len(buf) - length + 1)
                hashes = [C.span_hash(C.prefix_hash(buf), at, at + length), _other_hash(buf, at, at + length)]
                yield pa.RecordBatch.from_arrays([*[pa.repeat(batch.column(c)[i], len(at)) for c in range(len(one))], pa.array(at.astype(np.int32)), *map(C.long_of, hashes)], [*one, "at", "one", "two"])

    windows = bodies.select(*one, "body").mapInArrow(each, "anchor long, content long, other long, size int, n long, at int, one long, two long")
    twice = windows.groupBy("one", "two").agg(F.sum("n").alias("m")).filter("m > 1").select("one", "two")
    hit = windows.join(twice, ["one", "two"])
    return hit.groupBy(*one[:4]).agg(F.transform(F.collect_list("at"), lambda x: F.struct(x.alias("a"), (x + 1).alias("b"))).alias("found"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, bucket_bytes: int = 512 << 10, hot_texts: int = 12_000) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept (the bytes left) and kept_sha256 for each row of docs."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    named = docs.select(F.xxhash64(F.col(f"`{key}`"), F.col(f"`{key}`").isNull()).alias("k"), F.xxhash64(body).alias("h"), body.alias("t"), F.col(f"`{key}`").alias("key"))
    gone = marked(named.select("k", "h", "t"), length, gram, bucket_bytes, hot_texts)
    schema = StructType([StructType(docs.select(F.col(f"`{key}`")).schema.fields).fields[0], *StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string").fields])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, ranges = C.text_column(batch, "t"), batch.column(2)
            for lo, hi, buf, offsets in C.slices(t):
                size = np.diff(offsets)
                removed, spans, kept = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64), []
                for i in range(hi - lo):
                    own = buf[offsets[i] : offsets[i + 1]]
                    r = ranges[lo + i]
                    if r.is_valid and len(r.values):
                        edge = np.zeros(len(own) + 1, np.int64)
                        np.add.at(edge, r.values.field("a").to_numpy(), 1)
                        np.add.at(edge, r.values.field("b").to_numpy(), -1)
                        off = np.cumsum(edge)[:-1] > 0
                        removed[i] = off.sum()
                        spans[i] = (off[1:] & ~off[:-1]).sum() + off[0]
                        own = own[~off]
                    kept.append(own.tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), pa.array(size), pa.array(removed), pa.array(spans), pa.array(kept, pa.binary()), pa.array([hashlib.sha256(x).hexdigest() for x in kept])], schema.names)

    joined = named.join(gone, ["k", "h"], "left").select("t", "key", "r")
    return joined.mapInArrow(remove, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(C.tables(sf_dir, "documents")).select("doc_id", "text")).drop("kept")
