"""Packing of token pieces into sequences: Martello-Toth dominance reduction, then best fit.

Only the number of pieces of each length matters to the packing, so the solver works on a histogram of at most
`capacity` counts, whatever the number of documents, and returns runs: `count` pieces of one length, from a rank on, go
to consecutive sequences at one offset. Each piece finds its run by its rank among the pieces of its length.

Reduction: for the longest length left, if nothing fits beside it, it is fixed alone; if a length fills the sequence
exactly, or only one further piece can fit, or the longest that fits is at least as long as any two that fit together
(and three cannot), then the pair dominates every other set that holds the longest piece and is fixed. What is fixed
leaves the instance, and the test goes on with the rest. What no test fixes is packed by best fit in descending length.

Null text: the end id alone. Null ids and repeated rows are packed like any other; ties are broken by piece and crc.
An empty table gives an empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldledger.llm.common import numbered, saved
from fieldledger.llm.tokens import END, encoder, in_portions, vocabulary_path

Run = tuple[int, int, int, int, int]  #: length, first rank, count, first sequence, offset


class _Plan:
    """Runs built so far; every length is handed out rank by rank."""

    def __init__(self) -> None:
        self.runs: list[Run] = []
        self.rank: dict[int, int] = {}
        self.sequences = 0

    def put(self, length: int, count: int, sequence: int, offset: int) -> None:
        at = self.rank.get(length, 0)
        self.runs.append((length, at, count, sequence, offset))
        self.rank[length] = at + count

    def fresh(self, count: int) -> int:
        at = self.sequences
        self.sequences += count
        return at


def _reduce(counts: dict[int, int], capacity: int, plan: _Plan) -> None:
    """Fixes dominating sets for good and takes them out of `counts`."""
    sizes = sorted(counts)  # ascending; counts of spent lengths stay 0

    def smallest(k: int, without: int) -> list[int]:
        out: list[int] = []
        for s in sizes:
            out += [s] * min(k - len(out), counts[s] - (s == without))
            if len(out) >= k:
                break
        return out

    def best_pair(room: int, without: int) -> int:
        best, lo, hi = 0, 0, len(sizes) - 1
        left = lambda s: counts[s] - (s == without)
        while lo <= hi:
            a, b = sizes[lo], sizes[hi]
            if left(a) <= 0:
                lo += 1
            elif left(b) <= 0 or a + b > room or (lo == hi and left(a) < 2):
                hi -= 1
            else:
                best, lo = max(best, a + b), lo + 1
        return best

    def longest(room: int, without: int) -> int:
        k = bisect.bisect_right(sizes, room) - 1
        while k >= 0 and counts[sizes[k]] - (sizes[k] == without) <= 0:
            k -= 1
        return sizes[k] if k >= 0 else 0

    for a in reversed(sizes):
        while counts[a]:
            room = capacity - a
            b = longest(room, a)
            if b == 0:
                plan.put(a, counts[a], plan.fresh(counts[a]), 0)
                counts[a] = 0
                break
            low = smallest(3, a)
            only_one = len(low) < 2 or low[0] + low[1] > room
            no_three = len(low) < 3 or sum(low[:3]) > room
            if not (b == room or only_one or (no_three and b >= best_pair(room, a))):
                break
            m = counts[a] // 2 if a == b else min(counts[a], counts[b])
            at = plan.fresh(m)
            plan.put(a, m, at, 0)
            plan.put(b, m, at, a)
            counts[a] -= m
            counts[b] -= m


def _best_fit(counts: dict[int, int], capacity: int, plan: _Plan) -> None:
    """Best fit, longest first; sequences of equal room are kept as runs (first sequence, count)."""
    rooms: list[int] = []  # ascending, distinct
    groups: dict[int, list[tuple[int, int]]] = {}

    def add(room: int, first: int, count: int) -> None:
        if room and count:
            if room not in groups:
                bisect.insort(rooms, room)
                groups[room] = []
            groups[room].append((first, count))

    def fill(length: int, left: int, first: int, count: int, room: int) -> int:
        """Put pieces into `count` sequences with `room`: each gets as many as fit, the last maybe fewer."""
        each = room // length
        full = min(count, left // each)
        for j in range(each):
            if full:
                plan.put(length, full, first, capacity - room + j * length)
        add(room - each * length, first, full)
        left -= full * each
        if left and full < count:
            for j in range(left):
                plan.put(length, 1, first + full, capacity - room + j * length)
            add(room - left * length, first + full, 1)
            full, left = full + 1, 0
        add(room, first + full, count - full)
        return left

    for length in sorted((s for s in counts if counts[s]), reverse=True):
        left = counts[length]
        while left:
            k = bisect.bisect_left(rooms, length)
            if k == len(rooms):
                break
            room = rooms[k]
            first, count = groups[room].pop()
            if not groups[room]:
                del groups[room], rooms[k]
            left = fill(length, left, first, count, room)
        if left:
            need = -(-left // (capacity // length))
            fill(length, left, plan.fresh(need), need, capacity)


def pack(histogram: dict[int, int], capacity: int) -> tuple[list[Run], int]:
    """Runs that place every piece of the histogram, and the number of sequences."""
    counts, plan = dict(histogram), _Plan()
    _reduce(counts, capacity, plan)
    _best_fit(counts, capacity, plan)
    return plan.runs, plan.sequences


def token_pieces(docs: DataFrame, capacity: int, vocabulary: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: documents cut only where longer than `capacity`."""
    path = vocabulary or vocabulary_path()

    def cut(batches):
        encode = encoder(path)
        for batch in batches:
            text, keys = batch.column("text"), batch.column("doc_id")
            for a, b in in_portions(text):
                rows: list[tuple] = []
                for key, tokens in zip(keys[a:b].to_pylist(), encode(text[a:b].to_pylist()), strict=True):
                    ids = np.append(tokens, np.uint16(END)).astype("<u4")
                    rows += [(key, k, at, len(p := ids[at : at + capacity]), zlib.crc32(p.tobytes())) for k, at in enumerate(range(0, len(ids), capacity))]
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return base.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, capacity: int = 4096, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    cut = saved(token_pieces(docs, capacity, vocabulary), "cut")  # written first: ordering reads its input twice
    rows = numbered(cut, ["length", "doc_id", "piece", "ids_crc32"], name="_row")
    rows = saved(rows, "pieces")
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    runs, _ = pack(histogram, capacity)
    first, total = {}, 0
    for length in sorted(histogram):
        first[length] = total
        total += histogram[length]
    # runs of a length are consecutive in rank, so a run is found by the largest first rank that is not above
    by_length: dict[int, list[tuple[int, int, int]]] = {}
    for length, rank, _, sequence, offset in runs:
        by_length.setdefault(length, []).append((rank, sequence, offset))
    table = [(length, first[length], [list(x) for x in zip(*sorted(v), strict=True)]) for length, v in by_length.items()]
    plan = spark.createDataFrame([(a, b, c[0], c[1], c[2]) for a, b, c in table], "length long, _first long, _ranks array<bigint>, _sequences array<bigint>, _offsets array<bigint>")
    powers = F.array(*[F.lit(1 << p) for p in range(16, -1, -1)])
    at = F.aggregate(powers, F.lit(0), lambda k, p: F.when((k + p <= F.size("_ranks")) & (F.call_function("element_at", F.col("_ranks"), F.least(k + p, F.size("_ranks"))) <= F.col("_rank")), k + p).otherwise(k))
    # the plan has one row for each length, at most `capacity`, and about capacity * ln(capacity) runs in all
    placed = rows.join(F.broadcast(plan), "length").withColumn("_rank", F.col("_row") - F.col("_first")).withColumn("_at", at)
    pick = lambda c: F.call_function("element_at", F.col(c), F.col("_at"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (pick("_sequences") + F.col("_rank") - pick("_ranks")).alias("sequence_id"), pick("_offsets").alias("offset"))
