"""The lexicon's tally holds the keys of a small portion of text at once, however large the batch, and counts the same."""

import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from fieldledger.llm import toxicity


class Rows:
    """Stands for the labelled rows: hands out the function that runs in the tasks."""

    def mapInArrow(self, fn, schema):
        self.fn = fn
        raise StopIteration


def tally(batch):
    rows = Rows()
    with pytest.raises(StopIteration):
        toxicity._lexicon(rows, 1, 1, 10)
    tracemalloc.start()
    told = Counter()
    for part in rows.fn([batch]):
        for k, b, g in zip(*(part.column(c).to_numpy() for c in ("key", "bad", "good")), strict=True):
            told[int(k), 0] += int(b)
            told[int(k), 1] += int(g)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return told, peak


def test_tally_by_portions(monkeypatch):
    r = np.random.default_rng(2)
    words = ["".join(r.choice(list("abcdefghij"), r.integers(2, 9))) for _ in range(300)]
    texts = [" ".join(r.choice(words, 400)) for _ in range(1500)]
    batch = pa.RecordBatch.from_pydict({"text": texts, "toxic": pa.array(r.integers(0, 2, len(texts)), pa.int32())})
    assert batch.nbytes > 3 << 20
    told, peak = tally(batch)
    assert peak < 100 << 20, peak
    monkeypatch.setattr(toxicity, "PORTION", 4 << 20)
    whole, more = tally(batch)
    print(f"peak MB {peak >> 20} and {more >> 20}")
    assert told == whole
