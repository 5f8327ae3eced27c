"""Order-MinHash fingerprints of documents, in Spark functions only.

A document is the sequence of its k-word pieces. The occurrence number joins each repeat (the second `a b c` is a label
of its own), so labels are distinct. Labels are ordered by hash on a circle; each of `bins` evenly spaced points selects
the `picks` labels that follow it, i.e. the minimal ones of that bin (short texts borrow from the next bins). The picked
labels are put back in text order and the tuple is hashed: one signature entry. Two texts share an entry when they share
the minimal labels *and* their order, so the likeness (share of equal entries) falls with edit distance, not only with
set overlap.

Null text counts as empty. A text of fewer than k words is one label of all its words. Equal texts have equal
fingerprints; two empty texts have likeness 1. Cost is linear in the words of a text but for sorting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldledger.llm.common import WORD_BREAK, let, pieces

POS_BITS = 24  #: low bits of a label hold its place in the text
_LOW = (1 << POS_BITS) - 1


def _labels(words: Column, k: int) -> Column:
    """Sorted labels of a text, as longs: hash of (k-mer, occurrence number) above, place in the text below."""

    def placed(h: Column, i: Column, extra: Column) -> Column:
        return h.bitwiseAND(F.lit(~_LOW)).bitwiseOR(F.call_function("shiftright", i.cast("long"), extra))

    def all_labels(w: Column) -> Column:
        n = F.size(w)
        last = n - k + 1
        extra = F.greatest(F.lit(0), F.length(F.bin(n)) - POS_BITS).cast("int")
        kmers = F.transform(F.sequence(F.lit(1), last), lambda i: placed(F.xxhash64(*[F.call_function("element_at", w, i + j) for j in range(k)]), i - 1, extra))
        return F.when(last < 2, F.array(placed(F.xxhash64(w), F.lit(0), F.lit(0)))).otherwise(F.sort_array(kmers))

    def renumbered(a: Column) -> Column:
        """Later occurrences get hashes of their own; linear: first places of runs, then each run's members."""
        high = lambda x: x.bitwiseAND(F.lit(~_LOW))
        starts = F.filter(F.sequence(F.lit(1), F.size(a)), lambda i: F.when(i == 1, True).otherwise(high(F.call_function("element_at", a, i)) != high(F.call_function("element_at", a, F.greatest(i - 1, F.lit(1))))))

        def member(i: Column, first: Column) -> Column:
            x = F.call_function("element_at", a, i)
            return F.when(i == first, x).otherwise(high(F.xxhash64(high(x), i - first)).bitwiseOR(x.bitwiseAND(F.lit(_LOW))))

        def expand(s: Column) -> Column:
            run_end = lambda r: F.coalesce(F.get(s, r + 1) - 1, F.size(a))
            runs = F.transform(s, lambda first, r: F.transform(F.sequence(first, run_end(r)), lambda i: member(i, first)))
            return F.when(F.size(s) == F.size(a), a).otherwise(F.sort_array(F.flatten(runs)))

        return let(starts, expand)

    return let(let(words, all_labels), renumbered)


def signature(text: Column, k: int = 3, bins: int = 32, picks: int = 2) -> Column:
    """array<bigint> of `bins` tuple hashes."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda w: w != "")
    powers = F.array(*[F.lit(1 << p) for p in range(27, -1, -1)])

    def entries(a: Column) -> Column:
        n = F.size(a)

        def below(point: Column) -> Column:  # binary search: how many labels lie below the point
            return F.aggregate(powers, F.lit(0), lambda at, p: F.when((at + p <= n) & (F.call_function("element_at", a, F.least(at + p, n)) < point), at + p).otherwise(at))

        def entry(point: Column) -> Column:
            return let(below(point), lambda at: tuple_hash(F.transform(F.sequence(F.lit(0), F.lit(picks - 1)), lambda j: F.call_function("element_at", a, F.pmod(at + j, n) + 1))))

        def tuple_hash(picked: Column) -> Column:
            in_order = F.sort_array(F.transform(picked, lambda x: F.struct(x.bitwiseAND(F.lit(_LOW)).alias("p"), F.call_function("shiftright", x, F.lit(POS_BITS)).alias("h"))))
            return F.xxhash64(F.transform(in_order, lambda s: s["h"]))

        points = F.array(*[F.lit(-(1 << 63) + t * ((1 << 64) // bins)) for t in range(bins)])
        return F.transform(points, entry)

    return let(_labels(words, k), entries)


def as_text(sig: Column) -> Column:
    return F.array_join(F.transform(sig, lambda x: F.lpad(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal entries of two fingerprints of one length, 0 to 1."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)).cast("double") / F.size(a)


def with_edited(docs: DataFrame, slice_bytes: int = 16 << 20) -> DataFrame:
    """Each document beside the one that follows it in descending doc_id (after the last: the first).

    Returns doc_id, text, edited, _slice, _border and the order columns. Documents are cut into slices at quantiles of
    doc_id; a quantile is an id of the table, so the first document of each slice is known and a copy of it is put at
    the end of the slice above, marked as border. Thus the texts are shuffled once and no window crosses a slice.
    Null ids follow the smallest id; equal ids are ordered by length and hash of the text.
    """
    base = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    total, rows = base.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    n = min(pieces(total, slice_bytes), 100_000, max(rows, 1))
    shares = [(i + 1) / n for i in range(n)]
    bounds = base.agg(F.percentile_approx("doc_id", shares, max(10_000, 20 * n))).first()[0] or []
    bounds = sorted(set(bounds))  # slice i holds ids in (bounds[i-1], bounds[i]]; bounds[i] is its first document
    limits = F.array(*[F.lit(int(b)) for b in bounds]) if bounds else F.array(F.lit(0))
    size = max(len(bounds), 1)
    powers = F.array(*[F.lit(1 << p) for p in range(size.bit_length(), -1, -1)])
    at = F.aggregate(powers, F.lit(0), lambda k, p: F.when((k + p <= size) & (F.call_function("element_at", limits, F.least(k + p, F.lit(size))) < F.col("doc_id")), k + p).otherwise(k))
    placed = base.withColumn("_at", F.coalesce(at, F.lit(0)))
    head = F.col("doc_id") == F.call_function("element_at", limits, F.least(F.col("_at") + 1, F.lit(size)))
    after = F.pmod(F.col("_at") + 1, F.lit(size))  # the slice above, whose last document this one follows; the top one follows slice 0
    to = F.array(F.struct(F.col("_at").alias("s"), F.lit(0).alias("b")))
    border = F.array(F.struct(after.alias("s"), F.lit(1).alias("b")))
    dealt = placed.withColumn("_to", F.explode(F.when(head, F.concat(to, border)).otherwise(to))).select("doc_id", "text", F.col("_to.s").alias("_slice"), F.col("_to.b").alias("_border"), F.length("text").cast("long").alias("n_chars"), F.xxhash64("text").alias("_tie"))
    nxt = F.lead("text").over(following())
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 3) as int))"), F.coalesce(F.col("_next").substr(F.lit(1), third), F.lit("")))
    return dealt.withColumn("_next", nxt).withColumn("edited", edited).drop("_next")


def following() -> Window:
    return Window.partitionBy("_slice").orderBy("_border", F.col("doc_id").desc_nulls_last(), "n_chars", "_tie")


def fingerprints(docs: DataFrame, k: int = 3, bins: int = 32, picks: int = 2) -> DataFrame:
    """Fingerprints of all documents and of their edited texts; see the module for how they are made."""
    both = with_edited(docs).select("doc_id", "n_chars", "_slice", "_border", "_tie", F.sha2("edited", 256).alias("edited_sha256"), signature(F.col("text"), k, bins, picks).alias("_own"), signature(F.col("edited"), k, bins, picks).alias("_edited"))
    near = both.withColumn("_following", F.lead("_own").over(following())).where("_border = 0")
    return near.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("_own")).alias("fingerprint"),
        as_text(F.col("_edited")).alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("_edited")).alias("near_edited"),
        likeness(F.col("_own"), F.col("_following")).alias("near_next"),
    )
