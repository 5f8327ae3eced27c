"""Token ids in files of directly addressable codes.

A file is a Parquet table of segments, in ascending document order; a segment holds whole documents (more than one
only while it has under `SEGMENT` ids). Ids of a segment are cut into 8-bit chunks by level: level 0 has the low byte of
every id, a bitmap that says which ids go on, and a rank directory (ones before every 512th bit); level 1 has the next
byte of those that go on, and so on. Token i is read by following ranks: no block is decoded to reach it.

Columns of a segment: file (number of the range slice), segment (number in the file), n (ids), doc_ids and starts
(document k has ids starts[k] to starts[k+1]; null ids are kept), levels (list of chunk bytes), bitmaps, ranks.

Null text is empty: its document has the end id alone. Documents of one id keep an order by text hash; repeated rows
are written as often as they occur. A document longer than a segment makes one long segment. Other columns are ignored.
An empty table gives no files' rows and an empty result.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldledger.llm.common import pieces, shared_folder, text_bytes
from fieldledger.llm.tokens import END, encoder, in_portions, vocabulary_path

SEGMENT = 1 << 19
RANK_EVERY = 512
SCHEMA = "file int, segment int, n long, doc_ids array<bigint>, starts array<bigint>, levels array<binary>, bitmaps array<binary>, ranks array<binary>"


class Codes:
    """Directly addressable codes of one segment."""

    def __init__(self, levels: list[bytes], bitmaps: list[bytes], ranks: list[bytes]):
        self.levels = [np.frombuffer(x, np.uint8) for x in levels]
        self.bitmaps = [np.frombuffer(x, np.uint8) for x in bitmaps]
        self.ranks = [np.frombuffer(x, "<u4") for x in ranks]

    @classmethod
    def of(cls, ids: np.ndarray) -> Codes:
        levels, bitmaps, ranks, rest = [], [], [], ids.astype(np.uint32)
        while True:
            levels.append((rest & 0xFF).astype(np.uint8).tobytes())
            on = rest > 0xFF
            bits = np.packbits(on, bitorder="little")
            padded = np.zeros(-(-max(len(on), 1) // RANK_EVERY) * RANK_EVERY, bool)
            padded[: len(on)] = on
            sums = padded.reshape(-1, RANK_EVERY).sum(axis=1)
            bitmaps.append(bits.tobytes())
            ranks.append(np.concatenate([[0], np.cumsum(sums)[:-1]]).astype("<u4").tobytes())
            rest = rest[on] >> 8
            if not len(rest):
                return cls(levels, bitmaps, ranks)

    def rank(self, level: int, i: int) -> int:
        """Ones before bit i of a level's bitmap: a directory entry and at most 64 bytes."""
        block = i // RANK_EVERY
        a = block * RANK_EVERY // 8
        bits = np.unpackbits(self.bitmaps[level][a : i // 8 + 1], bitorder="little")[: i - block * RANK_EVERY]
        return int(self.ranks[level][block]) + int(bits.sum())

    def token(self, i: int) -> int:
        value, level = int(self.levels[0][i]), 0
        while self.bitmaps[level][i // 8] >> (i % 8) & 1:
            i = self.rank(level, i)
            level += 1
            value |= int(self.levels[level][i]) << 8 * level
        return value

    def slice(self, a: int, b: int) -> np.ndarray:
        """Tokens a to b (exclusive), from the bytes of these tokens alone."""
        if a >= b:
            return np.empty(0, np.uint32)
        out, where, level = self.levels[0][a:b].astype(np.uint32), np.arange(b - a), 0
        while True:
            on = np.unpackbits(self.bitmaps[level][a // 8 : (b - 1) // 8 + 1], bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)
            if not on.any():
                return out
            a, where = self.rank(level, a), where[on]
            b, level = a + len(where), level + 1
            out[where] |= self.levels[level][a:b].astype(np.uint32) << np.uint32(8 * level)


def _arrow_schema() -> pa.Schema:
    return pa.schema([("file", pa.int32()), ("segment", pa.int32()), ("n", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("levels", pa.list_(pa.binary())), ("bitmaps", pa.list_(pa.binary())), ("ranks", pa.list_(pa.binary()))])


def write_ids(docs: DataFrame, vocabulary: str | None = None, folder: str | None = None, slice_bytes: int = 16 << 20) -> str:
    """Encode all documents and write them as segments in ascending doc_id order; returns the folder."""
    path = vocabulary or vocabulary_path()
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    slices = pieces(text_bytes(base), slice_bytes)
    ordered = base.repartitionByRange(slices, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).select(F.spark_partition_id().alias("file"), "doc_id", "text")

    def segments(batches):
        encode, schema = encoder(path), _arrow_schema()
        held, ids, n, file, number = [], [], 0, 0, 0

        def flush():
            nonlocal held, ids, n, number
            c = Codes.of(np.concatenate(held))
            starts = np.concatenate([[0], np.cumsum([len(x) for x in held])])
            row = pa.RecordBatch.from_pydict({"file": [file], "segment": [number], "n": [n], "doc_ids": [ids], "starts": [starts.tolist()], "levels": [[x.tobytes() for x in c.levels]], "bitmaps": [[x.tobytes() for x in c.bitmaps]], "ranks": [[x.tobytes() for x in c.ranks]]}, schema=schema)
            held, ids, n, number = [], [], 0, number + 1
            return row

        for batch in batches:
            text, keys = batch.column("text"), batch.column("doc_id")
            for a, b in in_portions(text):
                file = batch.column("file")[a].as_py()
                for key, tokens in zip(keys[a:b].to_pylist(), encode(text[a:b].to_pylist()), strict=True):
                    own = np.append(tokens, np.uint16(END))
                    if held and n + len(own) > SEGMENT:
                        yield flush()
                    held.append(own)
                    ids.append(key)
                    n += len(own)
        if held:
            yield flush()

    ordered.mapInArrow(segments, SCHEMA).write.mode("errorifexists").parquet(folder)
    return folder


def read_ids(spark, folder: str) -> DataFrame:
    """One row per document, from the files alone: doc_id, start, n_tokens, ids_crc32."""
    files = spark.read.schema(SCHEMA).parquet(folder)
    per_file = sorted((r["file"], r["n"]) for r in files.groupBy("file").agg(F.sum("n").alias("n")).collect())  # a row per file
    before, total = [], 0
    for f, n in per_file:
        before.append((f, total))
        total += n
    starts = spark.createDataFrame(before, "file int, _file long")
    own = Window.partitionBy("file").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    places = files.select("file", "segment", "n").withColumn("_in", F.coalesce(F.sum("n").over(own), F.lit(0))).drop("n").join(F.broadcast(starts), "file")

    def documents(batches):
        for batch in batches:
            for s in batch.to_pylist():
                codes, at = Codes(s["levels"], s["bitmaps"], s["ranks"]), s["starts"]
                crcs = [zlib.crc32(codes.slice(a, b).astype("<u4").tobytes()) for a, b in zip(at, at[1:], strict=False)]
                k = len(crcs)
                yield pa.RecordBatch.from_pydict({"file": pa.array([s["file"]] * k, pa.int32()), "segment": pa.array([s["segment"]] * k, pa.int32()), "doc_id": pa.array(s["doc_ids"], pa.int64()), "_start": pa.array(at[:-1], pa.int64()), "n_tokens": pa.array(np.diff(at), pa.int64()), "ids_crc32": pa.array(crcs, pa.int64())})

    rows = files.mapInArrow(documents, "file int, segment int, doc_id long, _start long, n_tokens long, ids_crc32 long")
    return rows.join(places, ["file", "segment"]).select("doc_id", (F.col("_start") + F.col("_in") + F.col("_file")).alias("start"), "n_tokens", "ids_crc32")
