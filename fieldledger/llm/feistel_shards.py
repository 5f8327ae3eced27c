"""Sharding by a Feistel permutation of global row numbers, with cycle walking.

Documents are numbered 0..N-1 in the order of their ids. A keyed Feistel network permutes the a x b grid that just
covers N (a = ceil(sqrt N), b = ceil(N / a), so fewer than a points lie outside); a row whose image falls outside walks
on until it is inside, which makes the walk a permutation of 0..N-1. The image p gives `shard = p mod shards` and
`slot = p div shards`: counts differ by one at most, slots are gapless, and any process can compute both from the row
number, N and the seed alone. Equal input gives equal shards, whatever the partitioning.

Null text: size 8 (no bytes) and crc 0. Null ids come first in the order. Repeated rows get numbers of their own.
Columns other than doc_id and text are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldledger.llm.common import numbered

ROUNDS = 6


def permuted(row: Column, n: int, seed: int = 0) -> Column:
    """Place of row number `row` (0..n-1) in a reproducible shuffle of 0..n-1."""
    a = math.isqrt(max(n - 1, 0)) + 1
    b = -(-n // a) if n else 1

    def step(x: Column) -> Column:
        left, right = F.floor(x / F.lit(b)).cast("long"), F.pmod(x, F.lit(b))
        pair = F.struct(left.alias("l"), right.alias("r"))
        for k in range(ROUNDS):
            if k % 2 == 0:
                pair = _let(pair, lambda p, k=k: F.struct(F.pmod(p["l"] + F.pmod(F.xxhash64(p["r"], F.lit(k), F.lit(seed)), F.lit(a)), F.lit(a)).alias("l"), p["r"].alias("r")))
            else:
                pair = _let(pair, lambda p, k=k: F.struct(p["l"].alias("l"), F.pmod(p["r"] + F.pmod(F.xxhash64(p["l"], F.lit(k), F.lit(seed)), F.lit(b)), F.lit(b)).alias("r")))
        return _let(pair, lambda p: (p["l"] * F.lit(b) + p["r"]).cast("long"))

    # at most a*b - n < a points lie outside: so many steps always come back inside. Above 64 the odds of needing
    # more than 64 are below n ** -32.
    walk = min(max(a * b - n, 0), 64)
    first = step(row.cast("long"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(walk)), first, lambda x, _: F.when(x < n, x).otherwise(step(x))) if walk else first


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 20) -> DataFrame:
    """doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null: the law is not 'key')."""
    small = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("text_crc32"),
    )
    rows = numbered(small, ["doc_id", "size", "text_crc32"])
    n = rows.count()
    return rows.withColumn("_p", permuted(F.col("row"), n, seed)).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.pmod(F.col("_p"), F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("_p") / F.lit(shards)).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
