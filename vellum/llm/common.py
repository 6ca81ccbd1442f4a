"""Shared pieces: scratch tables, text kernels over Arrow buffers, gapless ranks.

Texts reach Python as Arrow string columns. Their UTF-8 bytes are used in place through
NumPy, a few megabytes at a time, so no kernel holds a Python object for each word.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 256 << 10  # text bytes that one kernel call takes, unless a single text is longer; its arrays fit a core's cache

_scratch: list[str] = []  # paths only: this module travels to executors


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a local temporary one only on a local master."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = spark.conf.get("vellum.local.scratch", None) or tempfile.mkdtemp(prefix="vellum-")
        spark.conf.set("vellum.local.scratch", path)
    return path.rstrip("/")


def stash(df: DataFrame, few: bool = False) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends there.

    few: for links and the like, small beside the texts; an eighth as many files as shuffles have partitions.
    """
    spark = df.sparkSession
    if few:
        df = df.coalesce(max(4, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    path = f"{scratch_dir(spark)}/vellum/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _scratch:
        atexit.register(_at_exit)
    _scratch.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch() -> None:
    """Delete the scratch tables of this process, as far as a session still runs."""
    spark = SparkSession.getActiveSession()
    while _scratch and spark is not None:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_scratch.pop())
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _at_exit() -> None:
    with contextlib.suppress(Exception):  # the session may have ended before; the folder's owner cleans it
        clear_scratch()


def fresh(taken: list[str], *names: str) -> list[str]:
    """Names like those given that no column in taken has (Spark compares them without case)."""
    low = {x.lower() for x in taken}
    out = []
    for name in names:
        while name.lower() in low:
            name = f"_{name}"
        low.add(name.lower())
        out.append(name)
    return out


def tables(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def ring(col: Column, seed: int, bits: int = 32) -> Column:
    """A position in [0, 2**bits) that depends on the value and the seed only."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), col), 64 - bits)


# --- kernels over UTF-8 bytes ------------------------------------------------------------------

_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_B_INV = np.uint64(pow(int(_B), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers whose output bits depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    col = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_binary(col.type):  # bytes that needn't be whole characters
        return col.fill_null(b"").view(pa.string())
    return (col if pa.types.is_string(col.type) else col.cast(pa.string())).fill_null("")


def slices(col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, row offsets into them) for runs of rows of about limit bytes."""
    n = len(col)
    if not n:
        return
    offsets = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def _table(seps: list[int]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[seps] = True
    return out


#: Separators of words: ASCII white space; everything of ASCII but digits and letters.
SPACE = _table([0x20, *range(0x09, 0x0E)])
NOT_ALNUM = _table([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def words(buf: np.ndarray, offsets: np.ndarray, seps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and where each row's words begin (rows + 1 entries)."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~seps[buf]
    before = np.empty(n, bool)
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.empty(n, bool)
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Sums of (byte + 1) * base**i over prefixes, modulo 2**64; n + 1 entries."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _power(_B, len(buf)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span's bytes, the same wherever the span stands."""
    raw = (prefix[ends] - prefix[starts]) * _power(_B_INV, len(prefix))[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def grams(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k items and how many runs each row has; runs never cross rows."""
    counts = np.maximum(np.diff(first) - k + 1, 0)
    n = len(hashes) - k + 1
    if n <= 0 or not counts.sum():
        return np.zeros(0, np.uint64), counts
    acc = hashes[:n].copy()
    for j in range(1, k):
        acc = mix(acc) + hashes[j : n + j]
    keep = np.ones(n, bool)
    for j in range(1, k):  # runs that begin in the last k - 1 places of a row
        at = first[1:] - j
        keep[at[(at >= first[:-1]) & (at < n)]] = False
    return mix(acc[keep]), counts


def long_of(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
