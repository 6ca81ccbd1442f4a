"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Method. Virtual node v of shard s stands at hash(s, v) on a ring of 2**32 positions, whatever the
number of shards, so one more shard only adds its own nodes. A row's text hashes to a position and
belongs to the owner of the next node, so equal texts stand together. A shard holds at most its
quota of rows; quotas differ by at most one and add up to the number of rows, so the law is `rows`:
counts at most one apart. A full shard's overflowing rows walk clockwise to the next arcs whose
owners have room. Home rows are seated before walking ones, so rows leave home only where a shard is
over its quota. Equal texts are split only where a quota ends among them. A group larger than a
quota is cut at every shard it fills, so its rows move more than others when a shard is added; with
by="key" the key decides the position instead, and no group stays together.

Scale. Rows are put in ring order by a range exchange of narrow rows, whose key goes down to the
single row, so neither a full arc nor a large group of equal texts meets in one task. Only counts by
task and arc (shuffle partitions plus shards x vnodes numbers, however many rows there are) reach
the driver, which plans which ranks of which arc sit where. Texts aren't shuffled.

Defined results. Null text has size 16, the checksum of no bytes and the place of the empty text;
null keys come first among equal texts. Rows equal in text and key are interchangeable. Very long
texts are hashed whole. Extra columns are read only if carried; one with the name of
an output gives way to it. Empty tables give empty results. grown_shard is null: under this
law it isn't defined.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm import common as C

SHARDS, VNODES, BITS, CELL_BITS = 40, 512, 32, 13


def position(col: Column) -> Column:
    """The first 32 bits of the MD5 of col's characters."""
    return F.conv(F.substring(F.md5(col.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def ring_points(spark, shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(position, shard) of all virtual nodes in ring order; of nodes at one position the lowest shard's stays."""
    ids = spark.range(shards * vnodes, numPartitions=1).select(F.expr(f"id div {vnodes}").alias("shard"), (F.col("id") % vnodes).alias("node"))
    at = ids.select(position(F.concat_ws(":", "shard", "node")).alias("pos"), "shard")
    return sorted((r["pos"], r["shard"]) for r in at.groupBy("pos").agg(F.min("shard").alias("shard")).collect())


def plan_seats(counts: list[int], owner: list[int], quotas: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Ranges (arc, first rank, end rank, shard, first slot) that seat all rows.

    counts: rows by arc, in ring order; owner: the shard of each arc.
    """
    room, filled, out, waiting = list(quotas), [0] * len(quotas), [], []

    def seat(arc: int, lo: int, n: int, shard: int) -> None:
        out.append((arc, lo, lo + n, shard, filled[shard]))
        filled[shard] += n
        room[shard] -= n

    for arc, n in enumerate(counts):
        take = min(n, room[owner[arc]])
        if take:
            seat(arc, 0, take, owner[arc])
        if n > take:
            waiting.append((arc, take, n - take))
    open_arcs = [a for a in range(len(owner)) if room[owner[a]] > 0]
    for arc, lo, n in waiting:
        while n:
            at = bisect_left(open_arcs, arc + 1) % len(open_arcs)
            shard = owner[open_arcs[at]]
            take = min(n, room[shard])
            seat(arc, lo, take, shard)
            lo, n = lo + take, n - take
            if not room[shard]:
                open_arcs = [a for a in open_arcs if owner[a] != shard]
    return out


def arcs_of(rows: DataFrame, ends: list[int]) -> DataFrame:
    """rows (with __pos) and the arc of each: how many ends lie before it, the last arc wrapping to the first."""
    width = BITS - CELL_BITS
    cut = [bisect_left(ends, c << width) for c in range((1 << CELL_BITS) + 1)]
    cells = rows.sparkSession.createDataFrame([(c, cut[c], ends[cut[c] : cut[c + 1]]) for c in range(1 << CELL_BITS)], "__cell long, __base int, __ends array<long>")
    inside = F.size(F.filter("__ends", lambda e: e < F.col("__pos")))
    # the cells are as many whatever the input, and hold shards x vnodes numbers
    located = rows.withColumn("__cell", F.shiftrightunsigned("__pos", width)).join(F.broadcast(cells), "__cell")
    return located.withColumn("__arc", (F.col("__base") + inside) % len(ends)).drop("__cell", "__base", "__ends")


def in_ring_order(rows: DataFrame) -> tuple[DataFrame, list[tuple[int, int, int, int]]]:
    """rows with __part and __index, their place in a sort by arc, position and key; (part, arc, first index, rows) of each run."""
    spark = rows.sparkSession
    order = ["__arc", "__pos", "__key", "size", "text_crc32", "__tie"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the id counts a task's rows in the order in which the sort hands them on
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("__tie").withColumn("__id", F.monotonically_increasing_id())
    placed = C.stash(placed.withColumn("__part", F.shiftright("__id", 33).cast("int")).withColumn("__index", F.col("__id").bitwiseAND((1 << 33) - 1)).drop("__id"))
    runs = placed.groupBy("__part", "__arc").agg(F.min("__index").alias("first"), F.count("*").alias("n")).collect()
    return placed, sorted((r["__part"], r["__arc"], r["first"], r["n"]) for r in runs)


def shard(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, vnodes: int = VNODES, by: str = "text", carry: list[str] | None = None) -> DataFrame:
    """key, size, text_crc32, law, shard, slot and grown_shard for each row, and the columns in carry."""
    spark = docs.sparkSession
    points = ring_points(spark, shards, vnodes)
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(
        F.col(f"`{key}`").alias("__key"),
        (F.octet_length(body) + 16).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        position(body if by == "text" else F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))).alias("__pos"),
        F.monotonically_increasing_id().alias("__tie"),
        *[F.col(f"`{c}`").alias(f"__c_{c}") for c in carry or []],
    )
    placed, runs = in_ring_order(C.stash(arcs_of(rows, [p for p, _ in points])))
    counts, starts = [0] * len(points), []
    for part, arc, first, n in runs:
        starts.append((part, arc, counts[arc] - first))
        counts[arc] += n
    total = sum(counts)
    quotas = [total // shards + (s < total % shards) for s in range(shards)]
    seats: dict[int, list[tuple[int, int, int, int]]] = {}
    for arc, lo, hi, at, slot in plan_seats(counts, [s for _, s in points], quotas):
        seats.setdefault(arc, []).append((lo, hi, at, slot))
    # a row for each arc and task that holds rows of it; an arc has one seat, and one more for each shard that its rows walk to
    seat_type = "array<struct<lo:long,hi:long,shard:int,slot:long>>"
    plan = spark.createDataFrame([(p, a, o, sorted(seats[a])) for p, a, o in starts], f"__part int, __arc int, __start long, __seats {seat_type}")
    out = placed.join(F.broadcast(plan), ["__part", "__arc"]).withColumn("__rank", F.col("__start") + F.col("__index"))
    out = out.withColumn("__seat", F.filter("__seats", lambda s: (s["lo"] <= F.col("__rank")) & (F.col("__rank") < s["hi"]))[0])
    carried = carry or []
    made = {
        key: F.col("__key"),
        "size": F.col("size"),
        "text_crc32": F.col("text_crc32"),
        "law": F.lit("rows"),
        "shard": F.col("__seat.shard"),
        "slot": F.col("__seat.slot") + F.col("__rank") - F.col("__seat.lo"),
        "grown_shard": F.lit(None).cast("int"),
    }
    low = {c.lower() for c in made}
    return out.select(*[c.alias(n) for n, c in made.items()], *[F.col(f"`__c_{c}`").alias(c) for c in carried if c.lower() not in low])


def query(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(C.tables(sf_dir, "documents")).select("doc_id", "text"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shard(docs.select("doc_id", "text"))
