"""Removal of long repeated passages, found by recompression.

Parsing: runs of one word are named by (word, length); then, round by round, every symbol gets a coin from its hash and
a 1-symbol followed by a 0-symbol is replaced by the name of the pair. Names are hashes of content, so they are global:
equal word sequences get equal symbols wherever they stand, but for a margin at their ends. Along with every symbol its
*context* is kept, the span of words that fixed it; a window that holds the context holds the same symbol at the same
place in every other occurrence. Symbols over `LONGEST` words rest, so contexts stay well inside a window.

High-level symbols whose context fits into a window are named globally by Spark: a symbol that only one document has
refutes every window around its context. Where a window holds no such symbol, symbols of lower levels are taken, down to
words, so each window is covered by some symbol. What is left are windows whose symbols are all shared; these are verified
by a 128-bit hash of their words, for which the smallest doc_id is found. So nothing is missed, and what is removed was
verified in full.

Rules: a null or empty text has no words and keeps nothing (an empty text). Null ids count as larger than any id: such
documents lose windows that a document with an id has, and cost no other document any. Rows of equal id do not remove
from each other. A text with fewer words than a window keeps all. Columns that clash with the results are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldledger.llm.common import Words, join2, pieces, text_bytes, windows
from fieldledger.llm.keyed import BATCH, Dealt, answer, ask, ask_again, flat, in_batches, reply

LONGEST = 12  #: a symbol of more words takes no part in further rounds
ROUNDS = 8
_FAR = 1 << 40
_LAST = np.iinfo(np.int64).max


class Level:
    """Symbols of one level: name, first word, and the context (from, to) in words. Documents are kept apart by a rest
    symbol before, between and behind them, whose context is endless: what leans on a document's end is never used."""

    def __init__(self, name, start, left, right, rest):
        self.name, self.start, self.left, self.right, self.rest = name, start, left, right, rest

    def kept(self, keep: np.ndarray) -> Level:
        return Level(self.name[keep], self.start[keep], self.left[keep], self.right[keep], self.rest[keep])


def _runs(level: Level) -> Level:
    """Names runs of a word. Whether a run ends is seen at its neighbours, so their context counts."""
    name = level.name.copy()
    head = np.append([True], (name[1:] != name[:-1]) | level.rest[1:])
    left, right = level.left.copy(), level.right.copy()
    left[1:], right[:-1] = np.minimum(left[1:], level.left[:-1]), np.maximum(right[:-1], level.right[1:])
    at = np.flatnonzero(head)
    k = np.diff(np.append(at, len(name)))
    many = at[k > 1]
    name[many] = join2(name[many], k[k > 1].astype(np.uint64), 7)
    left[many], right[many] = np.minimum.reduceat(left, at)[k > 1], np.maximum.reduceat(right, at)[k > 1]
    return Level(name, level.start, left, right, level.rest).kept(at)


def _pairs(level: Level, turn: int) -> Level:
    """Names pairs of an opening and a closing symbol. A pair needs no context; a symbol left alone shows that the
    neighbour it could have joined did not fit, so that neighbour's context counts."""
    live = ~level.rest & (np.append(level.start[1:], level.start[-1] + 1) - level.start <= LONGEST)
    coin = (level.name * np.uint64(2 * turn * 0x51ED270B + 0x2545F4914F6CDD1D) >> np.uint64(63)).astype(bool)
    opens, closes = live & coin, live & ~coin
    first = opens[:-1] & closes[1:]
    left, right, name = level.left.copy(), level.right.copy(), level.name.copy()
    lone = opens.copy()
    lone[:-1] &= ~first
    np.maximum(right[:-1], level.right[1:], out=right[:-1], where=lone[:-1] | first)
    lone = closes.copy()
    lone[1:] &= ~first
    np.minimum(left[1:], level.left[:-1], out=left[1:], where=lone[1:])
    at = np.flatnonzero(first)
    left[at] = np.minimum(level.left[at], level.left[at + 1])
    name[at] = join2(name[at], name[at + 1], 11)
    keep = np.ones(len(name), bool)
    keep[at + 1] = False
    return Level(name, level.start, left, right, level.rest).kept(keep)


def parse(words: np.ndarray, count: np.ndarray) -> list[Level]:
    """Levels from the words of documents with `count` words each."""
    ends = np.cumsum(count)
    gaps = np.concatenate([[0], ends])  # a rest symbol stands before each document and behind the last
    at = np.insert(np.arange(len(words), dtype=np.int64), gaps, gaps)
    rest = np.insert(np.zeros(len(words), bool), gaps, True)
    name = np.insert(words, gaps, np.uint64(0))
    levels = [Level(name, at, np.where(rest, -_FAR, at), np.where(rest, _FAR, at + 1), rest)]
    levels.append(_runs(levels[0]))
    for turn in range(ROUNDS):
        levels.append(_pairs(levels[-1], turn))
    return levels


def _spread(size: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Mask of the positions in any [first, last]."""
    d = np.bincount(first, minlength=size + 1) - np.bincount(last + 1, minlength=size + 1)
    return np.cumsum(d[:-1]) > 0


class Parsed:
    """Windows of a batch and the symbols that stand for them, worked out for about `portion` words at a time."""

    def __init__(self, rows: pa.Table, size: int, portion: int = 60_000):
        self.words = Words(rows.column("text"))
        self.ids = np.array([_LAST if i is None else i for i in rows.column("doc_id").to_pylist()], dtype=np.int64)
        self.size, self.portion, self.total = size, portion, len(self.words.start)
        self.hash, self.doc = self.words.hashes(), self.words.doc
        n, first = self.words.count, self.words.first
        self.starts = _spread(self.total, first[:-1][n >= size], (first[1:] - size)[n >= size]) if self.total else np.zeros(0, bool)
        name, doc, low, high, level, cover = [], [], [], [], [], [np.zeros(0, np.int8)]
        a = 0
        while a < len(n):
            b = max(a + 1, int(np.searchsorted(first, first[a] + portion, "right")) - 1)
            if n[a:b].max() >= size:
                out = self._symbols(a, b)
                for into, x in zip((name, doc, low, high, level, cover), out, strict=True):
                    into.append(x)
            else:
                cover.append(np.zeros(first[b] - first[a], np.int8))
            a = b
        join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
        self.low, self.high, self.number, self.cover = join(low, np.int64), join(high, np.int64), join(level, np.int8), join(cover, np.int8)
        name, owner = join(name, np.uint64), self.ids[join(doc, np.int64)]
        self.keys, self.which = np.unique(name, return_inverse=True)
        least, most = np.full(len(self.keys), _LAST), np.full(len(self.keys), -_LAST - 1)
        np.minimum.at(least, self.which, owner)
        np.maximum.at(most, self.which, owner)
        self.shared = least < most  # by two ids of this batch

    def _symbols(self, a: int, b: int) -> tuple[np.ndarray, ...]:
        """For documents a to b: name and document of each symbol used, the window starts [low, high] around its
        context, its level (from 1), and for each window the level that stands for it: the highest with one inside."""
        first = self.words.first
        base, total = first[a], first[b] - first[a]
        blind = self.starts[base : first[b]].copy()
        cover, out = np.zeros(total, np.int8), []
        levels = parse(self.hash[base : first[b]], self.words.count[a:b])
        for number in range(len(levels), 0, -1):
            level = levels[number - 1]
            fits = np.flatnonzero(level.right - level.left <= self.size)
            high = level.left[fits]
            doc = self.doc[base + high]
            low = np.maximum(level.right[fits] - self.size, first[doc] - base)
            known = np.concatenate([[0], np.cumsum(blind)])
            use = (high >= low) & (known[high + 1] > known[np.minimum(low, high)])
            if use.any():
                low, high = low[use], high[use]
                out.append((level.name[fits[use]], doc[use], low + base, high + base, np.full(len(low), number, np.int8)))
                now = blind & _spread(total, low, high)
                cover[now] = number
                blind &= ~now
            if not blind.any():
                break
        return (*(np.concatenate(c) for c in zip(*out, strict=True)), cover)

    def candidates(self, shared: np.ndarray) -> np.ndarray:
        """Starts of windows that no symbol of their level refutes by being one document's own."""
        alone = ~shared[self.which]
        refuted = np.zeros(self.total, bool)
        for number in range(1, int(self.cover.max(initial=0)) + 1):
            own = alone & (self.number == number)
            if own.any():
                refuted |= _spread(self.total, self.low[own], self.high[own]) & (self.cover == number)
        return np.flatnonzero(self.starts & ~refuted)


class Windows:
    """Distinct candidate windows of a batch by 128-bit hash, with the smallest id that has them here."""

    def __init__(self, parsed: Parsed, at: np.ndarray):
        held = _spread(parsed.total, at, at + parsed.size - 1) if len(at) else np.zeros(parsed.total, bool)
        words, place = parsed.hash[held], (np.cumsum(held) - 1)[at]  # windows lie in one piece, so places shift alone
        a, b, owner = windows(words, parsed.size, 1)[place], windows(words, parsed.size, 2)[place], parsed.ids[parsed.doc[at]]
        order = np.lexsort((b, a))
        a, b, owner = a[order], b[order], owner[order]
        new = np.append([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
        head = np.flatnonzero(new)
        self.a, self.b = a[head], b[head]
        self.least = np.minimum.reduceat(owner, head) if len(head) else np.empty(0, np.int64)
        self.of = np.empty(len(at), np.int64)
        self.of[order] = np.cumsum(new) - 1


def _read(rows: pa.Table, told: pa.Table, size: int, buckets: int) -> tuple[Parsed, np.ndarray]:
    parsed = Parsed(rows, size)
    shared = parsed.shared.copy()
    shared[Dealt(parsed.keys, buckets).answers(told)[0]] = True
    return parsed, parsed.candidates(shared)


def remove_repeats(docs: DataFrame, size: int = 50, batch_bytes: int = 4 << 20) -> DataFrame:
    """All columns of `docs`, with n_words, n_removed and kept (the words left, joined by one space)."""
    docs = docs.drop("n_words", "n_removed", "kept")
    total = text_bytes(docs)
    batches, buckets = pieces(total, batch_bytes), pieces(total, 4 * batch_bytes, 8)
    dealt_docs = in_batches(docs, batches)

    def symbols(batch: int, rows: pa.Table) -> pa.Table:
        keys = Parsed(rows, size).keys
        return Dealt(keys, buckets).table(batch, keys=keys)

    def shared(rows: pa.Table) -> pa.Table:
        keys, row = flat(rows.column("keys"))
        _, which, count = np.unique(keys, return_inverse=True, return_counts=True)
        return reply(rows, row, count[which] > 1)

    def verify(batch: int, rows: pa.Table, told: pa.Table) -> pa.Table:
        w = Windows(*_read(rows, told, size, buckets))
        return Dealt(w.a, buckets).table(batch, a=w.a, b=w.b, least=w.least)

    def smallest(rows: pa.Table) -> pa.Table:
        (a, row), b, own = flat(rows.column("a")), flat(rows.column("b"))[0], flat(rows.column("least"))[0]
        order = np.lexsort((b, a))
        x, y = a[order], b[order]
        head = np.flatnonzero(np.append([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]))[: len(x)])
        least = np.empty_like(own)
        if len(head):
            least[order] = np.repeat(np.minimum.reduceat(own[order], head), np.diff(np.append(head, len(x))))
        return reply(rows, row, least < own, least=least)

    def cut(batch: int, rows: pa.Table, told: pa.Table) -> pa.Table:
        first = told.filter(pa.compute.equal(told.column("step"), 1))
        parsed, at = _read(rows, first, size, buckets)
        w = Windows(parsed, at)
        least = w.least.copy()
        found, values = Dealt(w.a, buckets).answers(told.filter(pa.compute.equal(told.column("step"), 2)), "least")
        least[found] = values
        gone = at[least[w.of] < parsed.ids[parsed.doc[at]]]
        removed = _spread(parsed.total, gone, gone + size - 1)
        kept, lost, first = [], [], parsed.words.first
        for text, a, b in zip(rows.column("text").to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
            words, out = (text or "").encode().split(), removed[a:b]
            lost.append(int(out.sum()))
            kept.append(b" ".join([w for w, o in zip(words, out.tolist(), strict=True) if not o] if lost[-1] else words).decode())
        own = rows.drop_columns([BATCH])
        return own.append_column("n_words", pa.array(parsed.words.count, pa.int64())).append_column("n_removed", pa.array(lost, pa.int64())).append_column("kept", pa.array(kept, pa.string()))

    one = answer(ask(dealt_docs, symbols, "keys array<bigint>"), shared, "")
    two = answer(ask_again(dealt_docs, one, verify, f"bucket int, {BATCH} int, a array<bigint>, b array<bigint>, least array<bigint>"), smallest, "least array<bigint>")
    told = one.withColumn("least", F.lit(None).cast("array<bigint>")).withColumn("step", F.lit(1)).unionByName(two.withColumn("step", F.lit(2)))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return ask_again(dealt_docs, told, cut, f"{columns}, n_words long, n_removed long, kept string")


def kept_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return remove_repeats(docs.select("doc_id", "text")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
