"""Rounds send what is new: answers are dealt to the batches once, contexts go out as values without keys."""

import re

import numpy as np
import pyarrow as pa

from fieldledger.llm.suffix_tree import Entries, _asked, scores, unpacked


def test_no_round_deals_old_answers_again(spark):
    d = spark.createDataFrame([(k, f"a b c {k % 7} d e {k % 3}") for k in range(40)], "doc_id long, text string")
    lines = scores(d, batch_bytes=200)._jdf.queryExecution().executedPlan().toString().split("\n")
    assert sum("Union" in x for x in lines) > 2
    assert not [(a, b) for a, b in zip(lines, lines[1:], strict=False) if re.search(r"\bExchange\b", a) and re.search(r"\bUnion\b", b)]


def test_values_in_the_order_of_the_keys():
    r = np.random.default_rng(1)
    e = Entries(r.integers(0, 500, 3000).astype(np.uint64) << np.uint64(15), 7)
    asked, values = e.table(3, 0, n=e.sums(np.ones(3000)).astype(np.int32)), e.values(3, gain=np.arange(len(e.keys), dtype=np.int32))
    assert "keys" not in values.column_names and asked.column("bucket").equals(values.column("bucket"))
    which, row, _ = _asked(asked)
    gain, same = unpacked(values.column("gain"), np.int32)
    assert (row == same).all() and sorted(gain) == list(range(len(e.keys))) and isinstance(asked, pa.Table)
    n = unpacked(asked.column("n"), np.int32)[0]
    assert (n == e.sums(np.ones(3000))[gain]).all() and len(np.unique(which)) == len(e.keys)
