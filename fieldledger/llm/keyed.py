"""Questions about keys, asked by batches of documents and answered by hash buckets.

Documents are dealt into batches by a hash of their id. A batch works out which keys it holds (symbols, windows, word
sequences), each once, so a key that fills a third of the table is one entry per batch. The entries go to buckets by
hash as arrays, one row per batch and bucket; a bucket sees all batches' entries of its keys, and answers each batch by
the place of the entry in the array it sent. All of it is ordinary grouping: nothing depends on where a task runs, and
every step can be computed again. Rows with entries never outnumber the entries, at any size.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH = "_batch"


def in_batches(docs: DataFrame, batches: int) -> DataFrame:
    """docs with `_batch`: rows of one id stay together; null ids are dealt out by their text."""
    by = F.coalesce(F.xxhash64(F.col("doc_id")), F.lit(0)) if "text" not in docs.columns else F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    return docs.withColumn(BATCH, F.pmod(by, F.lit(batches)).cast("int"))


def lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    """A list column from flat values and the end of each list."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values))


def flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Flat values of a list column, and the row of each."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], arr.type)
    sizes = np.asarray(arr.value_lengths().fill_null(0)).astype(np.int64) if len(arr) else np.empty(0, np.int64)
    return np.asarray(arr.flatten()), np.repeat(np.arange(len(arr)), sizes)


class Dealt:
    """The keys of a batch in the order in which its buckets get them."""

    def __init__(self, keys: np.ndarray, buckets: int):
        bucket = ((keys >> np.uint64(17)) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int32)
        self.order = np.argsort(bucket, kind="stable")  # short numbers are sorted by digits
        bucket = bucket[self.order].astype(np.int32)
        first = np.flatnonzero(np.diff(bucket, prepend=np.int32(-1)))
        self.bucket = bucket[first]
        self.ends = np.append(first[1:], len(keys)).astype(np.int64) if len(first) else np.empty(0, np.int64)
        self.first = dict(zip(self.bucket.tolist(), first.tolist(), strict=True))

    def table(self, batch: int, **columns: np.ndarray) -> pa.Table:
        out = {"bucket": pa.array(self.bucket, pa.int32()), BATCH: pa.array(np.full(len(self.bucket), batch), pa.int32())}
        for name, values in columns.items():
            v = values[self.order]
            out[name] = lists(v.view(np.int64) if v.dtype == np.uint64 else v, self.ends)
        return pa.table(out)

    def answers(self, replies: pa.Table, *names: str) -> tuple[np.ndarray, ...]:
        """Which keys were answered (their index in `keys`), and the flat values of the answers' columns."""
        at, row = flat(replies.column("at"))
        if not len(at):
            return (np.empty(0, np.int64), *(np.empty(0, np.int64) for _ in names))
        base = np.array([self.first[b] for b in replies.column("bucket").to_pylist()], dtype=np.int64)
        return (self.order[base[row] + at], *(flat(replies.column(n))[0] for n in names))


def reply(rows: pa.Table, row: np.ndarray, chosen: np.ndarray, **columns: np.ndarray) -> pa.Table:
    """Answers to the entries `chosen` (a mask over the flat entries), as places in each batch's array."""
    sizes = np.bincount(row, minlength=rows.num_rows)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    told = np.bincount(row[chosen], minlength=rows.num_rows)
    keep = np.flatnonzero(told)
    ends = np.cumsum(told[keep])
    out = {BATCH: rows.column(BATCH).combine_chunks().take(pa.array(keep)), "bucket": rows.column("bucket").combine_chunks().take(pa.array(keep)), "at": lists(place[chosen].astype(np.int32), ends)}
    for name, v in columns.items():
        out[name] = lists(v[chosen], ends)
    return pa.table({k: (pa.concat_arrays(v.chunks) if isinstance(v, pa.ChunkedArray) else v) for k, v in out.items()})


def ask(batches: DataFrame, fn: Callable[[int, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Entries of every batch."""

    def work(key, rows):
        return fn(key[0].as_py(), rows)

    return batches.groupBy(BATCH).applyInArrow(work, f"bucket int, {BATCH} int, {schema}")


def ask_again(batches: DataFrame, replies: DataFrame, fn: Callable[[int, pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Entries (or results, by `schema`) of every batch, given the answers it got so far."""

    def work(key, rows, told):
        return fn(key[0].as_py(), rows, told)

    return batches.groupBy(BATCH).cogroup(replies.groupBy(BATCH)).applyInArrow(work, schema)


def answer(entries: DataFrame, fn: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    return entries.groupBy("bucket").applyInArrow(lambda rows: fn(rows), f"{BATCH} int, bucket int, at array<int>{', ' + schema if schema else ''}")
