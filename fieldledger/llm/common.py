"""Helpers shared by the operators of this subpackage: table access, working tables, word hashes, document order."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space and the five ASCII line and tab characters; `bytes.split()` cuts at just these.
WORD_BREAK = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once per row, however often the body (or a lambda in it) uses it."""
    return F.transform(F.array(value), body)[0]


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: `spark.checkpoint.dir`, or the checkpoint folder set on the context.

    Only a local session may do without: there the current folder of the one machine is shared by definition.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    own = spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None
    if own:
        return own.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    import tempfile

    made = tempfile.mkdtemp(prefix="fieldledger-")
    spark.sparkContext.setCheckpointDir(made)
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def saved(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write `df` once as a working table in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    w = df.write.mode("errorifexists")
    (w.partitionBy(by) if by else w).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts; sets how many pieces a job is dealt into, never what it keeps."""
    return int(docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])


def pieces(total: float, each: float, least: int = 1) -> int:
    return max(least, math.ceil(total / each))


# -- hashes of words and windows (numpy, inside tasks) ----------------------------------------------------------------

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    y = x >> _S30
    y ^= x
    y *= _M1
    y ^= y >> _S27
    y *= _M2
    y ^= y >> _S31
    return y


def join2(a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hash of the ordered pair (a, b)."""
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)) + mix(b ^ np.uint64(0xD6E8FEB86659FD93 ^ salt)) * np.uint64(0xA0761D6478BD642F)


_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def is_break(raw: np.ndarray) -> np.ndarray:
    """Which bytes stand between words; a comparison of whole arrays, as a table would be looked up byte by byte."""
    return (raw - np.uint8(0x09) <= 4) | (raw == 0x20)


def folded(raw: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return raw + ((raw - np.uint8(65) < 26).view(np.uint8) << np.uint8(5))


class Words:
    """Words of a column of texts (null: none) with a 64-bit hash each, read from the bytes of the whole column at once.

    Word i is bytes `start[i]:end[i]` of `bytes`; document k has words `first[k]:first[k + 1]`. `fold` lower-cases A-Z.
    """

    def __init__(self, column, fold: bool = False):
        import pyarrow as pa

        arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        if isinstance(arr, pa.ChunkedArray):
            arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], pa.string())
        arr = arr.fill_null("").cast(pa.large_string())
        at = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
        data = arr.buffers()[2] if len(arr) else None
        raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.empty(0, np.uint8)
        at = at - at[0]
        self.bytes = np.concatenate([folded(raw) if fold else raw, np.zeros(8, np.uint8)])
        letter = np.concatenate([~is_break(raw), [False]])
        cut = np.zeros(len(raw) + 1, bool)
        cut[at] = True  # a document starts here
        self.start = np.flatnonzero(letter[:-1] & (cut[:-1] | np.concatenate([[True], ~letter[:-2]]))) if len(raw) else np.empty(0, np.int64)
        self.end = np.flatnonzero(letter[:-1] & (cut[1:] | ~letter[1:])) + 1 if len(raw) else np.empty(0, np.int64)
        self.first = np.searchsorted(self.start, at)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(arr)), self.count)
        self.offsets = at

    def hashes(self, salt: int = 0) -> np.ndarray:
        size = self.end - self.start
        eights = np.lib.stride_tricks.as_strided(self.bytes[:8].view(np.uint64), (len(self.bytes) - 7,), (1,), writeable=False)
        h = mix((eights[self.start] & _MASK[np.minimum(size, 8)]) ^ (size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)))
        at, k = np.flatnonzero(size > 8), 8
        while len(at):
            h[at] = mix(h[at] * np.uint64(0xA0761D6478BD642F) + (eights[self.start[at] + k] & _MASK[np.minimum(size[at] - k, 8)]))
            k += 8
            at = at[size[at] > k]
        return h

    def text(self, i: int) -> bytes:
        return self.bytes[self.start[i] : self.end[i]].tobytes()


def windows(h: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """Hash of every `size` consecutive entries, by doubling: h[0:2], h[0:4], ... put together for any size."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out, at, power, width = None, 0, h, 1
    left = size
    while left:
        if left & 1:
            part = power[at : at + n]
            out = part if out is None else join2(out, part, salt + width)
            at += width
        left >>= 1
        if left:
            power = join2(power[: len(power) - width], power[width:], salt + 1000 + width)
            width *= 2
    return out


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order, and which of them each key is: `np.unique` with its inverse, for hashes.

    The high bits of the keys are sorted with the keys' places in the low bits, as numbers are sorted several times as
    fast as places. Different keys of equal high bits, if there are any, are left to `np.unique`.
    """
    n = len(keys)
    if n == 0 or keys.dtype != np.uint64:
        return np.unique(keys, return_inverse=True)
    low = np.uint64(n.bit_length())
    lift = np.uint64(min(64 - int(keys.max()).bit_length(), int(low)))  # what short keys leave free above
    packed = keys << lift
    packed >>= low
    packed <<= low
    packed |= np.arange(n, dtype=np.uint64)
    packed.sort()
    tie = packed[1:] >> low == packed[:-1] >> low if lift < low else np.zeros(n - 1, bool)
    packed &= (np.uint64(1) << low) - np.uint64(1)
    order = packed.view(np.int64)
    keys = keys[order]
    first = np.concatenate([[True], keys[1:] != keys[:-1]])
    if (first[1:] & tie).any():
        keys, in_order = np.unique(keys, return_inverse=True)
    else:
        keys, in_order = keys[first], np.cumsum(first) - 1
    which = np.empty(n, np.int64)
    which[order] = in_order
    return keys, which


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def portions(batches, column: str = "text", size: int = 4 << 20):
    """Arrow batches cut into pieces of about `size` bytes of a text column, so that arrays made per word stay small."""
    for batch in batches:
        text = batch.column(column)
        ends = np.cumsum(np.asarray(_lengths(text)).astype(np.int64))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, "right")))
            yield batch.slice(a, b - a)
            a = b


def _lengths(text) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(text), 0)


# -- documents in order of id -----------------------------------------------------------------------------------------


def numbered(df: DataFrame, order: list[str], name: str = "row", weight: str | None = None, slices: int | None = None) -> DataFrame:
    """Adds `name`: how many rows (or how much `weight`) stand before each row in the order of `order`, nulls first.

    Range slices are written once with their number; each slice is counted, the slices' sums are added up (one row per
    slice), and places inside a slice come from a window over the slice alone. No task holds more than a slice.
    """
    spark = df.sparkSession
    n = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = saved(df.repartitionByRange(n, *[F.col(c).asc_nulls_first() for c in order]).withColumn("_slice", F.spark_partition_id()), "slices")
    w = F.col(weight) if weight else F.lit(1)
    sums = sorted((r["_slice"], r["s"]) for r in cut.groupBy("_slice").agg(F.sum(w.cast("long")).alias("s")).collect())  # one row per slice
    before, total = {}, 0
    for k, s in sums:
        before[k] = total
        total += s
    inside = "_slice"
    from pyspark.sql import Window

    own = Window.partitionBy(inside).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    place = F.row_number().over(own) - 1 if weight is None else F.sum(w.cast("long")).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - w
    starts = spark.createDataFrame([(k, v) for k, v in before.items()], "_slice int, _before long")
    return cut.withColumn(name, place.cast("long")).join(F.broadcast(starts), "_slice").withColumn(name, F.col(name) + F.col("_before")).drop("_slice", "_before")
