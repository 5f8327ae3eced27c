"""S16 delivery: its query runs and gives one row."""

import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_deliver_takes_the_newest_and_names_the_last_id(spark):
    got = entry.queries()["s16_deliver"](spark, DATA).collect()
    assert len(got) == 1 and got[0].delivered == min(got[0].matched, 250) and got[0].last_id
