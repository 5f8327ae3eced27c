"""Scores of texts by a probabilistic suffix tree over words.

A state is a context of up to `depth` words that stand before a word. Its next-word distribution holds what was seen twice
or more behind it; what was seen once makes the mass that goes to the suffix (the context without its first word):
P(w | s) = (N(s w) [if >= 2] + (n1(s) + a) P(w | suffix)) / (N(s) + a), where n1 counts the words seen once. The root is the
smoothed word count. A context of any length is kept when its continuations, each left out in turn, diverge from the
suffix by more than `nats` (what was seen once has none left, so this begins at two sightings): the sum over its training words of ln(P_without_it(w | s) / P(w | suffix)), taken from below,
(N - 1) / (N(s) - 1 + a) for words seen twice, (n1 - 1 + a) / (N(s) - 1 + a) times the suffix for others. A word is scored in
the longest kept context before it, all of whose suffixes are kept as well; contexts do not cross documents.

Counting goes from short to long contexts, by questions of batches of documents to hash buckets (see `keyed`): the counts
of words; then for each length the counts of sequences behind contexts that can be kept (if the sequence without its first
word was seen twice), and the sums for each context.
A sequence, word or context that fills a third of the text is one entry per batch. Nothing is held in one place, and no
count is cut off or sampled. All rounds are one plan: the texts are dealt into batches once.

Training: documents with crc32(doc_id as text) mod 5 other than 1; null ids are scored and not trained on. Null and empty
texts are one end token. Words of equal 64-bit hash count as one; sequences and contexts are told apart by 44 bits within a bucket, so
chance meetings stay below one in a million. Rows of one id are scored and counted each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldledger.llm.common import Words, distinct, join2, pieces, text_bytes
from fieldledger.llm.keyed import BATCH, Dealt, ask, ask_again, in_batches

DEPTH = 2
NATS = 3.0  #: what a context must gain to be kept
STRENGTH = 1.0  #: a: words' worth of the suffix in every distribution
_END = np.uint64(0x9AE16A3B2F90404F)
_ANSWER = f"{BATCH} int, bucket int, step int, total binary, sums array<bigint>"


def packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Lists as compressed bytes, low bytes first: most high bytes of counts and of steps between keys are zero."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=3).compress
    bits = values.view(f"<u{values.itemsize}")
    rows = np.split(np.stack([(bits >> (8 * k)).astype(np.uint8) for k in range(values.itemsize)]), ends[:-1], axis=1) if len(ends) else []
    return pa.array([squeeze(np.ascontiguousarray(r).ravel()) for r in rows], pa.binary())


def unpacked(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Values of all lists of a column, and the row of each."""
    import zstandard

    expand, size = zstandard.ZstdDecompressor().decompress, np.dtype(kind).itemsize
    parts = [np.ascontiguousarray(np.frombuffer(expand(b), np.uint8).reshape(size, -1).T).view(kind).ravel() for b in column.to_pylist()]
    return np.concatenate(parts) if parts else np.empty(0, kind), np.repeat(np.arange(len(parts)), [len(p) for p in parts])


class Tokens:
    """Words of a batch, each document closed by the end token; contexts of any length by their hash."""

    def __init__(self, rows: pa.Table):
        w = Words(rows.column("text"), fold=True)
        ends = np.cumsum(w.count)
        self.word = np.insert(w.hashes(), ends, _END)
        self.count = w.count + 1
        self.doc = np.repeat(np.arange(len(self.count)), self.count)
        self.place = np.arange(len(self.word)) - np.repeat(np.cumsum(self.count) - self.count, self.count)
        self.train = ~np.asarray(rows.column("held_out"))[self.doc]

    def context(self, k: int, at: np.ndarray) -> np.ndarray:
        """Hash of the k words before each of the tokens `at`, nearest first, so a longer context extends its suffix."""
        out = np.full(1, np.uint64(k))
        for j in range(1, k + 1):
            out = join2(out, self.word[at - j], 31)
        return out


class Entries:
    """Distinct keys of a batch with values, dealt to buckets; keys go out as steps from one to the next."""

    def __init__(self, keys: np.ndarray, buckets: int):
        self.keys, self.which = distinct(keys)
        self.dealt = Dealt(self.keys, buckets)

    def sums(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.which, weights=weights, minlength=len(self.keys))

    def values(self, batch: int, **values: np.ndarray) -> pa.Table:
        """Values alone, in the order in which `table` sent the keys."""
        ends = self.dealt.ends
        out = {"bucket": pa.array(self.dealt.bucket, pa.int32()), BATCH: pa.array(np.full(len(ends), batch), pa.int32())}
        return pa.table(out | {name: packed(v[self.dealt.order], ends) for name, v in values.items()})

    def table(self, batch: int, drop: int, **values: np.ndarray) -> pa.Table:
        ends = self.dealt.ends
        keys = (self.keys[self.dealt.order] >> np.uint64(drop)).view(np.int64)
        step = np.diff(keys, prepend=np.int64(0))
        first = np.concatenate([[0], ends[:-1]])[: len(ends)].astype(np.int64)
        step[first] = keys[first]
        out = self.values(batch, **values)
        return out.add_column(2, "keys", packed(step, ends))

    def told(self, replies: pa.Table) -> np.ndarray:
        """The answer to each key: one value per entry, in the order sent."""
        out = np.zeros(len(self.keys), np.int64)
        values, row = unpacked(replies.column("total"), np.int64)
        if len(values):
            base = np.array([self.dealt.first[b] for b in replies.column("bucket").to_pylist()], dtype=np.int64)
            sizes = np.bincount(row, minlength=replies.num_rows)
            place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            out[self.dealt.order[base[row] + place]] = values
        return out


def _asked(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which key each entry of a bucket has, its row, and the rows' sizes."""
    step, row = unpacked(rows.column("keys"), np.int64)
    sizes = np.bincount(row, minlength=rows.num_rows)
    first = np.cumsum(sizes) - sizes
    run = np.cumsum(step)
    keys = run - np.repeat(run[first] - step[first], sizes) if len(step) else step
    return distinct(keys.view(np.uint64))[1], row, sizes


def _reply(rows: pa.Table, sizes: np.ndarray, values: np.ndarray, step: int) -> pa.Table:
    whole = lambda c: pa.array(np.asarray(rows.column(c)), pa.int32())
    return pa.table({BATCH: whole(BATCH), "bucket": whole("bucket"), "step": pa.array(np.full(rows.num_rows, step), pa.int32()), "total": packed(values.astype(np.int64), np.cumsum(sizes))})


def _counts(step: int, least: int):
    """Sums of counts, 0 where below `least`; and one row of the bucket's own: all it counted, and how many keys."""

    def work(rows: pa.Table) -> pa.Table:
        which, _, sizes = _asked(rows)
        total = np.bincount(which, weights=unpacked(rows.column("n"), np.int32)[0])
        own = pa.table({BATCH: pa.array([-1], pa.int32()), "bucket": pa.array([0], pa.int32()), "step": pa.array([step], pa.int32()), "total": pa.nulls(1, pa.binary()), "sums": pa.array([[int(total.sum()), int((total > 0).sum())]], pa.list_(pa.int64()))})
        told = _reply(rows, sizes, np.where(total >= least, total, 0)[which], step)
        return pa.concat_tables([told.append_column("sums", pa.nulls(told.num_rows, pa.list_(pa.int64()))), own])

    return work


def _kept(step: int, nats: float):
    """For contexts: 0 if dropped, else 1 + the number of words seen once behind it. A context is a word or sequence asked
    about before: its key and how often it was seen are in that question, row by row the batches of the values."""

    def work(rows: pa.Table, values: pa.Table) -> pa.Table:
        rows, values = rows.sort_by(BATCH), values.sort_by(BATCH)
        which, _, sizes = _asked(rows)
        seen, once, gain = (np.bincount(which, weights=unpacked(t.column(c), kind)[0]) for t, c, kind in ((rows, "n", np.int32), (values, "once", np.int32), (values, "gain", np.float32)))
        with np.errstate(divide="ignore", invalid="ignore"):
            rest = np.where(once > 0, once * np.log((once - 1 + STRENGTH) / (seen - 1 + STRENGTH)), 0.0)
        told = _reply(rows, sizes, np.where(gain + rest > nats, once + 1, 0)[which], step)
        return told.append_column("sums", pa.nulls(told.num_rows, pa.list_(pa.int64())))

    return work


class Walk:
    """What a batch knows from the answers so far: after step 0 the words, after 2 k - 1 the counts behind contexts of k
    words, after 2 k which of them are kept."""

    def __init__(self, rows: pa.Table, told: pa.Table, steps: int, buckets: int):
        t = self.tokens = Tokens(rows)
        step = np.asarray(told.column("step"))
        of = lambda k: told.filter(pa.array(step == k))
        self.train_tokens, distinct = of(-1).column("sums").to_pylist()[0]
        known = Entries(t.word, buckets)  # what the contexts of the round were asked as
        self.words = known.told(of(0))[known.which]
        entry = known.which
        self.base = (self.words + 0.5) / (self.train_tokens + 0.5 * (distinct + 1))
        self.p, seen = self.base.copy(), np.concatenate([[0], self.words[:-1]])
        at, most = np.arange(len(t.word)), self.words  # a sequence is seen no more often than its own suffix
        for k in range(1, steps // 2 + 1):
            at = at[(t.place[at] >= k) & (seen[at] >= 2)]
            self.context, may = t.context(k, at), most[at] >= 2
            self.asked = at[may]
            self.sequences = Entries(join2(self.context[may], t.word[self.asked], 77), buckets)
            if steps == 2 * k:
                return
            count = np.zeros(len(at), np.int64)
            count[may] = self.sequences.told(of(2 * k - 1))[self.sequences.which]
            self.contexts, which = known, entry[at - 1]
            sums = lambda weights: np.bincount(which, weights=weights, minlength=len(known.keys))  # noqa: B023, E731
            teach, n = t.train[at], seen[at]
            self.once = sums(teach & (count < 2))
            twice = np.flatnonzero(teach & (count >= 2))
            gain = np.zeros(len(at))
            gain[twice] = np.log((count[twice] - 1.0) / (n[twice] - 1 + STRENGTH) / self.p[at[twice]])
            self.gain = sums(gain)
            if steps == 2 * k + 1:
                return
            kept = known.told(of(2 * k))[which]
            known, entry = self.sequences, np.zeros(len(t.word), np.int64)
            entry[self.asked] = self.sequences.which
            use = kept > 0
            self.p[at] = np.where(use, (count + (kept - 1 + STRENGTH) * self.p[at]) / (n + STRENGTH), self.p[at])
            # the next token's longer context is this sequence; it can be kept only where its suffix is
            follow = np.zeros(len(t.word) + 1, np.int64)
            follow[at + 1] = count
            most = follow[1:]
            seen, ok = follow[:-1], np.zeros(len(t.word), bool)
            ok[at[use]] = True
            at = np.flatnonzero(ok)


def scores(docs: DataFrame, depth: int = DEPTH, nats: float = NATS, batch_bytes: int = 10 << 20) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 1, F.lit(True))
    base = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), held.alias("held_out"))
    size = text_bytes(base)
    count, buckets = pieces(size, batch_bytes), pieces(size, 2 * batch_bytes, 8)
    # texts and answers are dealt by batch once; a union of equally dealt answers is dealt so too, so no round writes old ones again
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda rows: rows.repartition(parts, BATCH)
    batches = dealt(in_batches(base, count))

    def answered(entries: DataFrame, fn) -> DataFrame:
        return entries.groupBy("bucket").applyInArrow(lambda rows: fn(rows), _ANSWER)

    def words(batch: int, rows: pa.Table) -> pa.Table:
        t = Tokens(rows)
        e = Entries(t.word, buckets)
        return e.table(batch, 0, n=e.sums(t.train).astype(np.int32))

    question = ask(batches, words, "keys binary, n binary")
    first = answered(question, _counts(0, 1))
    of_all = first.where(f"{BATCH} = -1").agg(F.array(*[F.coalesce(F.sum(F.col("sums")[k]), F.lit(0)) for k in (0, 1)]).alias("sums"))
    everywhere = spark.range(count).select(F.col("id").cast("int").alias(BATCH), F.lit(-1).alias("bucket"), F.lit(-1).alias("step"), F.lit(None).cast("binary").alias("total"), of_all.scalar().alias("sums"))
    told = dealt(everywhere).unionByName(dealt(first.where(f"{BATCH} >= 0")))
    for k in range(1, depth + 1):

        def sequences(batch: int, rows: pa.Table, known: pa.Table, k: int = k) -> pa.Table:
            w = Walk(rows, known, 2 * k, buckets)
            return w.sequences.table(batch, 20, n=w.sequences.sums(w.tokens.train[w.asked]).astype(np.int32))

        def contexts(batch: int, rows: pa.Table, known: pa.Table, k: int = k) -> pa.Table:
            w = Walk(rows, known, 2 * k + 1, buckets)
            return w.contexts.values(batch, once=w.once.astype(np.int32), gain=w.gain.astype(np.float32))

        kind, kept = f"bucket int, {BATCH} int", _kept(2 * k, nats)
        asked = ask_again(batches, told, sequences, f"{kind}, keys binary, n binary")
        told = told.unionByName(dealt(answered(asked, _counts(2 * k - 1, 2)).where(f"{BATCH} >= 0")))
        values = ask_again(batches, told, contexts, f"{kind}, once binary, gain binary")
        judged = question.groupBy("bucket").cogroup(values.groupBy("bucket")).applyInArrow(kept, _ANSWER)
        told, question = told.unionByName(dealt(judged)), asked

    def result(batch: int, rows: pa.Table, known: pa.Table) -> pa.Table:
        w = Walk(rows, known, 2 * depth + 2, buckets)
        t, n = w.tokens, rows.num_rows
        add = lambda x: np.bincount(t.doc, weights=x, minlength=n).astype(float)
        return pa.table({"doc_id": rows.column("doc_id"), "held_out": rows.column("held_out"), "n_tokens": pa.array(t.count.astype(np.int64)), "n_known": pa.array(add(w.words > 0).astype(np.int64)), "train_tokens": pa.array(np.full(n, w.train_tokens)), "base_score": pa.array(add(np.log10(w.base))), "score": pa.array(add(np.log10(w.p)))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ask_again(batches, told, result, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
