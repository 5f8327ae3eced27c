"""Benchmark items in documents, found by their templates.

A word's template is the word itself, folded and without punctuation at its ends, or a typed placeholder: `<number>` for
figures and number words, `<unit>` for a known unit behind a number (or glued to one), `<name>` for a capitalised word
that does not open a sentence. Windows of `size` template words (the whole item where it is shorter) are hashed and joined
between benchmark and documents. Hits of one document and item on one diagonal are put together, and runs of hits are chained in order over
nearby diagonals, as an inserted or missing word moves what follows it. The slots must be consistent on a
diagonal and along a chain, i.e. each value of the item stands for one value of the document throughout. So a question with other
numbers or names is caught, while text that only shares a shape is not: windows that are mostly placeholders do not
count, and the hits must cover at least `cover` of the item's words (and `least` words of it, or all).

Documents send only windows whose hash is in a bitmap of the benchmark's hashes. Its size is fixed by the number of
windows up to 16 MB; beyond that it lets more through, which the join then drops.

Null and empty texts or items have no windows. Null ids are kept as ids of their own kind (null-safe groups). Repeated
items are reported under each of their ids. Other columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldledger.llm.common import portions, saved, windows

# What counts as a number word and as a unit.
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half dozen".split())
UNITS = frozenset("mm cm m km in ft yd mi mg g kg t lb lbs oz ml l cl s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres gallon gallons cent cents dollar dollars euro euros usd eur percent % $ € £ °c °f kmh km/h mph kb mb gb tb".split())
_EDGE = re.compile(r"^[^\w%$€£°]+|[^\w%$€£°]+$")
_NUMBER = re.compile(r"[$€£]?[+-]?\d[\d.,:/]*(?:st|nd|rd|th)?(%|[a-z°/]{1,4})?")
NUMBER, UNIT, NAME = "<number>", "<unit>", "<name>"


class Template:
    """Template of a text: a hash per word, which words are slots, and the folded words themselves."""

    def __init__(self, hashes: np.ndarray, slot: np.ndarray, value: list[str]):
        self.hashes, self.slot, self.value = hashes, slot, value
        self.before = np.concatenate([[0], np.cumsum(slot)])

    def slots(self, a: int, b: int) -> list[str]:
        return [self.value[k] for k in range(a, b) if self.slot[k]] if self.before[b] > self.before[a] else []

    def starts(self, size: int) -> np.ndarray:
        """Starts of windows of which at least half are plain words."""
        n = len(self.value) - size + 1
        return np.flatnonzero(2 * (self.before[size:] - self.before[:-size]) <= size) if n > 0 else np.empty(0, np.int64)


class Reader:
    """Reads templates; what a word is by itself is remembered, its neighbours decide the rest."""

    PLAIN, IS_NUMBER, MAY_BE_UNIT, CAPITAL = range(4)

    def __init__(self, room: int = 150_000) -> None:
        import xxhash

        self.room, self.known, self.digest = room, {}, xxhash.xxh3_64_intdigest
        self.number, self.unit, self.name = (xxhash.xxh3_64_intdigest(x) for x in (NUMBER, UNIT, NAME))

    def learn(self, raw: str) -> tuple[int, int, str, bool]:
        """Hash, kind, folded word without punctuation at its ends, and whether a sentence ends with it."""
        word = _EDGE.sub("", raw)
        low = word.lower()
        m = _NUMBER.fullmatch(low)
        if (m and (not m[1] or m[1] in UNITS)) or low in NUMBER_WORDS:
            kind = self.IS_NUMBER
        elif low in UNITS:
            kind = self.MAY_BE_UNIT
        else:
            kind = self.CAPITAL if word[:1].isupper() else self.PLAIN
        out = self.known[raw] = (self.digest(low), kind, low, raw[-1] in ".!?:")
        return out

    def __call__(self, text: str | None) -> Template:
        known, learn = self.known, self.learn
        if len(known) > self.room:
            known.clear()
        hashes, slot, value = [], [], []
        opens, counted = True, False
        for raw in (text or "").split():
            h, kind, low, ends = known.get(raw) or learn(raw)
            if not low:  # punctuation alone
                opens = opens or ends
                continue
            if kind == 1:
                h, counted = self.number, True
                slot.append(len(hashes))
            else:
                if kind == 2 and counted:
                    h = self.unit
                    slot.append(len(hashes))
                elif kind == 3 and not opens:
                    h = self.name
                    slot.append(len(hashes))
                counted = False
            hashes.append(h)
            value.append(low)
            opens = ends
        mask = np.zeros(len(hashes), bool)
        mask[slot] = True
        return Template(np.array(hashes, dtype=np.uint64), mask, value)


def item_windows(items: DataFrame, size: int) -> DataFrame:
    """item_id, words, width, item_at, hash, item_slots for every window of the benchmark."""

    def work(batches):
        read = Reader()
        for batch in batches:
            rows = []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                t = read(text)
                width = min(size, len(t.value))
                if width:
                    h = windows(t.hashes, width, width).view(np.int64)
                    rows += [(item, len(t.value), width, k, int(h[k]), t.slots(k, k + width)) for k in t.starts(width).tolist()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [batch.column("item_id").type, pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], names=["item_id", "words", "width", "item_at", "hash", "item_slots"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "text").mapInArrow(work, f"item_id {kind}, words int, width int, item_at int, hash long, item_slots array<string>")


def chained(words: int, width: int, lines: list[dict]) -> list[tuple[int, int, int]]:
    """(covered, changed, at) of whole diagonals and of chains of their runs; lines: the consistent diagonals of a document and item."""
    out, runs = [], []
    for line in lines:
        d, pairs = line["diagonal"], {(x["theirs"], x["own"]) for x in line["slots"]}
        ats = np.array(line["ats"])
        out.append((int(width + np.minimum(np.diff(ats), width).sum()), sum(a != b for a, b in pairs), int(ats[0]) + d))
        for part in np.split(ats, np.flatnonzero(np.diff(ats) > 1) + 1):
            runs.append((int(part[0]) + d, int(part[0]), int(part[-1]), d, pairs))
    if len(lines) < 2:
        return out
    runs.sort(key=lambda r: r[:4])
    longest = max(b - a for _, a, b, _, _ in runs)
    best: list[tuple[int, frozenset, int]] = []  # of the chains that end with each run: words covered, slots, first word
    for j, (at, first, last, d, pairs) in enumerate(runs):
        size = last - first + width
        top = (size, frozenset(pairs), at)
        for i in range(j - 1, -1, -1):
            at_i, first_i, last_i, d_i, _ = runs[i]
            if at - at_i > longest + width + words:
                break
            if last_i < first and last_i + d_i < at and at - (last_i + d_i) <= width + words and abs(d - d_i) <= words:
                covered = best[i][0] + size - max(0, last_i + width - first)
                if covered > top[0]:
                    both = best[i][1] | pairs
                    if len({a for a, _ in both}) == len(both) == len({b for _, b in both}):
                        top = (covered, both, best[i][2])
        best.append(top)
    return out + [(n, sum(a != b for a, b in pairs), at) for n, pairs, at in best]


def leaks(docs: DataFrame, items: DataFrame, size: int = 8, cover: float = 0.5, least: int = 8) -> DataFrame:
    """doc_id, item_id, item_words, covered, changed (slots with another value), at (first word in the document)."""
    spark = docs.sparkSession
    ours = saved(item_windows(items, size), "item-windows")
    widths = sorted(r["width"] for r in ours.select("width").distinct().collect())  # at most `size` values
    count = ours.select("hash").distinct().count()
    bits = min(27, max(16, (64 * max(count, 1)).bit_length()))
    # the bitmap is made from prefixes of `bits` bits: at most 2 ** 27 of them, whatever the benchmark's size
    held = np.zeros(1 << bits, bool)
    for row in ours.select(F.shiftrightunsigned("hash", 64 - bits).alias("p")).distinct().toLocalIterator():
        held[row["p"]] = True
    sent = spark.sparkContext.broadcast(np.packbits(held, bitorder="little"))
    keys = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def work(batches):
        read, table = Reader(), sent.value
        for batch in portions(batches, size=1 << 20):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                t = read(text)
                for width in widths:
                    w = windows(t.hashes, width, width)
                    p = (w >> np.uint64(64 - bits)).astype(np.int64)
                    hit = np.flatnonzero(table[p >> 3] >> (p & 7).astype(np.uint8) & 1)
                    rows += [(doc, width, k, int(w[k].view(np.int64)), t.slots(k, k + width)) for k in hit.tolist()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [batch.column("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "width", "at", "hash", "slots"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    hits = keys.mapInArrow(work, f"doc_id {kind}, width int, at long, hash long, slots array<string>")
    met = hits.join(ours, ["hash", "width"]).withColumn("diagonal", F.col("at") - F.col("item_at"))
    lines = met.groupBy("doc_id", "item_id", "words", "width", "diagonal").agg(F.sort_array(F.collect_set("item_at")).alias("ats"), F.array_distinct(F.flatten(F.collect_set(F.arrays_zip(F.col("item_slots").alias("theirs"), F.col("slots").alias("own"))))).alias("slots"))
    theirs, own = F.array_distinct(F.transform("slots", lambda s: s["theirs"])), F.array_distinct(F.transform("slots", lambda s: s["own"]))
    consistent = (F.size(theirs) == F.size("slots")) & (F.size(own) == F.size("slots"))
    grouped = lines.where(consistent).groupBy("doc_id", "item_id", "words", "width").agg(F.collect_list(F.struct("diagonal", "ats", "slots")).alias("lines"))

    def judge(batches):
        for batch in batches:
            keep, found = [], []
            for row in range(batch.num_rows):
                words, width, lines = (batch.column(c)[row].as_py() for c in ("words", "width", "lines"))
                covered, changed, at = max(chained(words, width, lines), key=lambda c: (c[0], -c[1], -c[2]))
                if covered >= min(words, max(least, math.ceil(cover * words))):
                    keep.append(row)
                    found.append((words, covered, changed, at))
            ids = [batch.column(c).take(pa.array(keep, pa.int64())) for c in ("doc_id", "item_id")]
            cols = list(zip(*found, strict=True)) if found else [[]] * 4
            yield pa.RecordBatch.from_arrays(ids + [pa.array(list(c), t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["doc_id", "item_id", "item_words", "covered", "changed", "at"])

    item_kind = items.schema["item_id"].dataType.simpleString()
    return grouped.mapInArrow(judge, f"doc_id {kind}, item_id {item_kind}, item_words int, covered int, changed int, at long")
