"""Collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from fieldledger.llm import count_transducers as ct


def plain(rows, least, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    f = {p: c for p, c in f.items() if c >= least}
    held = {q for p, c in f.items() for q in ((p[:-1], (p[0], *p[2:])) if len(p) > 3 else ()) if f[q] == c}
    out = {}
    for p, a in f.items():
        if len(p) > 2 and p not in held:
            lang, w = p[0], p[1:]
            cuts = [(1000 * a * n[lang] // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w))]
            s, k = min(cuts)
            out.setdefault(lang, []).append((-s, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])]))
    return sorted((lang, i + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for lang, xs in out.items() for i, x in enumerate(sorted(xs)[:top]))


def got(spark, rows, **options):
    d = spark.createDataFrame([(t, lang, 1, "x", 2) for lang, t in rows], "text string, lang string, n int, word string, score int")
    return sorted(tuple(r) for r in ct.collocations(d, **options).collect())


def made(seed, docs, words=60):
    r = random.Random(seed)
    names = [f"{r.choice('abcdéxyzÄ')}{'long' * r.randrange(5)}{i}" for i in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    return [(r.choice(["en", "de", None]), "".join(w + r.choice([" ", " ", " ", "  \t", ", ", ".", "\n", "\x0b"]) for w in r.choices(names, weights, k=r.randrange(80)))) for _ in range(docs)]


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 2000, "range_words": 300, "bucket_words": 40}])
def test_against_plain_counts(spark, options):
    rows = made(1, 220) + [("en", "New York City hall " * 40), ("en", "a b a b a b a b, " * 60)] * 2
    assert got(spark, rows, least=4, **options) == plain(rows, 4)


def test_top_and_ties(spark):
    rows = [("en", f"{a} {b}. " * 5) for a in "pqrs" for b in "tuvw"]
    want = plain(rows, 5, top=3)
    assert len(want) == 3 and got(spark, rows, least=5, top=3) == want


def test_odd_rows(spark):
    rows = [(None, None), ("en", None), ("en", ""), ("fr", " .,;\n"), (None, "one two three " * 9), ("en", "x" * 300_000 + " y " + "x" * 300_000 + " y"), ("und", "one two three"), ("es", "only once each")]
    assert got(spark, rows, least=2) == plain(rows, 2)
    assert got(spark, [], least=2) == [] and got(spark, rows[:4], least=2) == []


def test_ranges_hold_each_phrase_once():
    rng = np.random.default_rng(2)
    runs = [np.append(rng.integers(1, 9, rng.integers(1, 30)), 0) for _ in range(60)]
    ids = np.concatenate(runs)
    whole = ct.Transducer.of_runs(ids, 5)
    cuts = np.unique(np.array([whole.phrases(4)[i] for i in (3, 50, 51, 200)] + [[2, 0, 0, 0, 0], [5, 5, 0, 0, 0]]), axis=0)
    half = [ct.Transducer.of_runs(np.concatenate(part), 5) for part in (runs[:30], runs[30:])]
    counts = {}
    for r in range(len(cuts) + 1):
        packed = [levels for t in half for q, levels in t.ranges(cuts) if q == r]
        if packed:
            t = ct.Transducer.unpacked(ct.Transducer.union(packed, 5, 2).packed())
            for k in range(5):
                for p, c in zip(t.phrases(k), t.weights[k], strict=True):
                    if c:
                        assert tuple(p) not in counts and ct.range_of(p[None, :], cuts)[0] == r
                        counts[tuple(p)] = int(c)
    want = Counter()
    for run in runs:
        w = run[:-1].tolist()
        want.update(tuple(w[i : i + k] + [0] * (5 - k)) for k in range(1, 6) for i in range(len(w) - k + 1))
    assert counts == {p: c for p, c in want.items() if c >= 2}


def test_shard_words_are_told_apart_by_bytes(monkeypatch):
    import pyarrow as pa

    plain_hashes = ct.Words.hashes
    monkeypatch.setattr(ct.Words, "hashes", lambda self, salt=0: plain_hashes(self, salt) % np.uint64(3 if salt == 0 else 1 << 62))
    words, _, counts, places = ct._shard(pa.array(["aa bb aa cc", "dd\nee aa"]))
    assert dict(zip(words, counts.tolist(), strict=True)) == {b"aa": 3, b"bb": 1, b"cc": 1, b"dd": 1, b"ee": 1}
    assert (places == 0).sum() == 3
