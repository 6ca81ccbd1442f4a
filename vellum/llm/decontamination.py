"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Method. Words are runs of ASCII letters and digits (lower-cased) and of non-ASCII bytes. Every n-gram of a test
item is a seed. Document frequencies of all seeds are counted over the whole corpus; a seed in more
than `COMMON` documents is put aside, but an item always keeps its n * e + 1 rarest seeds, where e
is the most replaced or lost words with which a copy scores min_score. Each of them breaks at most
n seeds, so a kept seed outlives if any e edits leave n words in a row, however often the item or
an edited copy of it leaks. The surroundings of every kept seed are aligned with its item: match
+2, mismatch -1, gap -1. Those that hold too few of the item's words to reach min_score are passed
over first. score is the best local alignment over twice the item's words; at `min_score` or more
the document is contaminated.

Limit. A copy without n words in a row of the item has no seed: very short items with an edit in
each n words, or a word put in after every n - 1. Such copies are not found.

Bounds. The test items are the stated query set. They are taken in blocks of at most block_words
words, each of which is counted and scanned against all documents, so results don't depend on the
blocks. Only a block's seeds travel to executors, and where there are several blocks each one's
matches are written before the next is read, so the driver holds one. Texts are not shuffled for one
block: alignment runs where a text is read, and clean drops the row there. For several blocks clean
collects hashes of the matching texts and joins them away once.

Defined results. Null or empty text and items of fewer than n words match nothing. A null doc_id
or item_id is reported as null. Of several matches of one item in a text the best is reported, of
equals the first. Texts are scanned whole, however long. Extra columns are ignored by scan and kept by
clean, whatever their names. Empty tables give empty results. Repeated rows are each reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vellum.llm import common as C

N, MIN_SCORE, BLOCK_WORDS, COMMON = 3, 0.6, 1_000_000, 1000
FILTER_BITS = 22


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every normalised word, and where each row's words begin."""
    low = C.LOWER[buf]
    starts, ends, first = C.words(low, offsets, C.NOT_ALNUM)
    return C.span_hash(C.prefix_hash(low), starts, ends), first


class Seeds:
    """n-grams of a block of items; seed s stands at places[at[s]:at[s + 1]] as (item, offset)."""

    def __init__(self, texts: list[str], n: int):
        col = pa.array(texts, pa.string())
        self.n, self.items = n, []
        grams, item, offset = [], [], []
        for lo, _, buf, offsets in C.slices(col):
            h, first = word_hashes(buf, offsets)
            g, counts = C.grams(h, first, n)
            begin = np.concatenate(([0], np.cumsum(counts)))
            for r in range(len(counts)):
                self.items.append(h[first[r] : first[r + 1]])
                grams.append(g[begin[r] : begin[r + 1]])
                item.append(np.full(counts[r], lo + r))
                offset.append(np.arange(counts[r]))
        self.lengths = np.array([len(x) for x in self.items], np.int64)
        every = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.item = np.concatenate(item)[order] if item else np.zeros(0, np.int64)
        self.offset = np.concatenate(offset)[order] if offset else np.zeros(0, np.int64)
        self.seeds, at = np.unique(every[order], return_index=True)
        self.at = np.append(at, len(every))
        self.kept = np.ones(len(every), bool)
        self._index()

    def _index(self) -> None:
        self.maybe = np.zeros(1 << FILTER_BITS, bool)
        self.maybe[(self.seeds & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True

    def keep_rare(self, frequency: np.ndarray, min_score: float, common: int = COMMON) -> None:
        """frequency: documents by seed. Put aside common seeds beyond those that any e edits can't all break."""
        if not len(self.item):
            return
        f = np.repeat(frequency, np.diff(self.at))
        order = np.lexsort((f, self.item))
        first = np.flatnonzero(np.concatenate(([True], np.diff(self.item[order]) > 0)))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        edits = np.floor(2 * self.lengths * (1 - min_score) / 3 + 1e-9).astype(np.int64)
        self.kept = (f <= common) | (place <= self.n * edits[self.item])

    def find(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, word place and seed of all hits."""
        g, counts = C.grams(h, first, self.n)
        near = np.flatnonzero(self.maybe[(g & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)]) if len(g) else np.zeros(0, np.int64)
        s = np.searchsorted(self.seeds, g[near])
        s[s == len(self.seeds)] = 0
        hit = self.seeds[s] == g[near] if len(self.seeds) else np.zeros(len(s), bool)
        near, s = near[hit], s[hit]
        begin = np.concatenate(([0], np.cumsum(counts)))
        row = np.searchsorted(begin, near, "right") - 1
        return row, near - begin[row] + first[row], s


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Best local score of words a against b (+2, -1, -1) and the end of that match in b."""
    m = len(b)
    ramp = np.arange(m + 1)
    above, best, end = np.zeros(m + 1, np.int64), 0, 0
    for x in a:
        t = np.zeros(m + 1, np.int64)
        np.maximum(t[1:], above[:-1] + np.where(b == x, 2, -1), out=t[1:])
        np.maximum(t, above - 1, out=t)
        above = np.maximum.accumulate(t + ramp) - ramp
        j = int(above.argmax())
        if above[j] > best:
            best, end = int(above[j]), j
    return best, end


def matches(seeds: Seeds, h: np.ndarray, first: np.ndarray, min_score: float) -> list[tuple[int, int, float, int, int]]:
    """(row, item, score, first word, end word) of the contaminated rows of a slice."""
    row, place, s = seeds.find(h, first)
    many = seeds.at[s + 1] - seeds.at[s]
    src = np.repeat(seeds.at[s], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    row, place, item, offset = np.repeat(row, many), np.repeat(place, many), seeds.item[src], seeds.offset[src]
    ok = seeds.kept[src]
    row, place, item, offset = row[ok], place[ok], item[ok], offset[ok]
    order = np.lexsort((place, item, row))
    row, place, item, offset = row[order], place[order], item[order], offset[order]
    if not len(row):
        return []
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (place[1:] - place[:-1] > seeds.lengths[item[1:]])
    cut = np.append(np.flatnonzero(new), len(row))
    found: dict[tuple[int, int], tuple[float, int, int]] = {}
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        i, r = int(item[a]), int(row[a])
        words = seeds.items[i]
        slack = int(2 * len(words) * (1 - min_score)) + 1  # more gaps would cost too much
        lo = max(int(first[r]), int((place[a:b] - offset[a:b]).min()) - slack)
        hi = min(int(first[r + 1]), int((place[a:b] - offset[a:b]).max()) + len(words) + slack)
        near = h[lo:hi]
        # matched words bound the score
        if np.isin(words, near).sum() / len(words) < min_score or np.isin(near, words).sum() / len(words) < min_score:
            continue
        score, end = align(words, near)
        share = score / (2 * len(words))
        if share >= min_score and share > found.get((r, i), (0,))[0]:
            _, back = align(words[::-1], h[lo : lo + end][::-1])
            found[r, i] = (share, lo + end - back - int(first[r]), lo + end - int(first[r]))
    return [(r, i, *v) for (r, i), v in found.items()]


def blocks(benchmark: DataFrame, item: str, text: str, block_words: int) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of the items, in blocks of bounded size."""
    ids, texts, size = [], [], 0
    for r in benchmark.select(F.col(f"`{item}`").alias("i"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t")).orderBy("i", "t").toLocalIterator():
        n = len(r["t"]) // 2 + 1
        if texts and size + n > block_words:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r["i"])
        texts.append(r["t"])
        size += n
    if texts:
        yield ids, texts


def prepared(docs: DataFrame, texts: list[str], text: str, n: int, min_score: float) -> Seeds:
    """The seeds of a block, with those that are frequent for their item put aside."""
    seeds = Seeds(texts, n)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(seeds.seeds), np.int64)
        for batch in batches:
            for _, _, buf, offsets in C.slices(C.text_column(batch, "t")):
                row, _, s = seeds.find(*word_hashes(buf, offsets))
                pair = np.unique(row * np.int64(len(seeds.seeds) + 1) + s)
                total += np.bincount(pair % (len(seeds.seeds) + 1), minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["s", "n"])

    counted = docs.select(F.col(f"`{text}`").alias("t")).mapInArrow(count, "s long, n long").groupBy("s").agg(F.sum("n").alias("n"))
    frequency = np.zeros(len(seeds.seeds), np.int64)
    for r in counted.collect():  # at most a row for each seed of the block
        frequency[r["s"]] = r["n"]
    seeds.keep_rare(frequency, min_score)
    return seeds


def scan(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", n: int = N, min_score: float = MIN_SCORE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row for each contaminated (key, item): score, first_word, end_word of the match."""
    schema = StructType([docs.schema[key], benchmark.schema[item]]).add("score", "double").add("first_word", "long").add("end_word", "long")
    out = docs.sparkSession.createDataFrame([], schema)
    kind = pa.int64() if benchmark.schema[item].dataType.simpleString() == "bigint" else None
    for (ids, texts), alone in _marked(blocks(benchmark, item, item_text, block_words)):
        seeds = prepared(docs, texts, text, n, min_score)

        def run(batches: Iterator[pa.RecordBatch], seeds: Seeds = seeds, ids: list = ids) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, _, buf, offsets in C.slices(C.text_column(batch, "t")):
                    found = matches(seeds, *word_hashes(buf, offsets), min_score)
                    if found:
                        r, i, score, a, b = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([lo + x for x in r])), pa.array([ids[x] for x in i], kind), pa.array(score), pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema.names)

        found = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).mapInArrow(run, schema)
        out = out.unionByName(found if alone else C.stash(found, few=True))
    return out


def _marked(found: Iterator) -> Iterator[tuple]:
    """Each of found, and whether it is the only one."""
    first, second = next(found, None), next(found, None)
    if first is not None:
        yield first, second is None
    if second is not None:
        yield second, False
        yield from ((x, False) for x in found)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", n: int = N, min_score: float = MIN_SCORE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs that match no item, all columns as they were."""
    hits: list[DataFrame] = []
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    hashes = {"a": F.xxhash64(body), "b": F.xxhash64(F.lit(29), F.reverse(body))}
    for (_, texts), alone in _marked(blocks(benchmark, item, item_text, block_words)):
        seeds = prepared(docs, texts, text, n, min_score)
        if alone:
            boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("t"))
            return boxed.mapInArrow(_chosen(seeds, min_score, False), boxed.select("row").schema).select("row.*")
        named = docs.select(F.struct(*[c.alias(k) for k, c in hashes.items()]).alias("row"), F.col(f"`{text}`").alias("t"))
        hits.append(C.stash(named.mapInArrow(_chosen(seeds, min_score, True), named.select("row").schema).select("row.*").distinct(), few=True))
    if not hits:
        return docs
    gone = hits[0]
    for h in hits[1:]:
        gone = gone.unionByName(h)
    names = dict(zip(hashes, C.fresh(docs.columns, "__a", "__b"), strict=True))
    gone = gone.distinct().select(*[F.col(k).alias(x) for k, x in names.items()])
    return docs.withColumns({x: hashes[k] for k, x in names.items()}).join(gone, list(names.values()), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def _chosen(seeds: Seeds, min_score: float, bad: bool):
    """Rows (row, t) that match an item, or those that match none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in C.slices(C.text_column(batch, "t")):
                found = {m[0] for m in matches(seeds, *word_hashes(buf, offsets), min_score)}
                keep = [lo + r for r in range(hi - lo) if (r in found) == bad]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64()))], ["row"])

    return run


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(C.tables(sf_dir, "documents")), spark.read.parquet(C.tables(sf_dir, "benchmark")))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean(docs, spark.read.parquet(C.tables(sf_dir, "benchmark")))
