"""What the meetings of whole-number keys send: lists from a block's first key on, as steps of a byte, and no pair to name its keys."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorate.operators import meetings


@pytest.mark.parametrize("binary", [True, False])
@pytest.mark.parametrize("widest", [3, 254, 255, 256, 4000, 10**12])
def test_lists_come_back(binary, widest):
    rng = np.random.default_rng(widest % 97)
    lens = rng.integers(1, 9, 40)
    keys = np.concatenate([np.sort(rng.integers(-5, widest, n)) for n in lens])
    values = rng.integers(0, 2, len(keys)) if binary else rng.random(len(keys))
    got = meetings._unpacked(meetings._packed(keys, lens, values, -5, binary), -5, binary)
    for x, y in zip(got, (keys, lens, values), strict=True):
        assert (x == y).all()


def test_an_element_of_a_list_takes_a_byte_and_a_bit():
    keys = np.arange(0, 80_000, 40)
    assert len(meetings._packed(keys, np.array([2000]), keys % 2, 0, True)) < 2400


def test_pairs_of_numbers_are_not_joined_with_names(spark):
    rows = spark.range(600).select((F.col("id") % 20).alias("p"), (F.col("id") % 77).cast("int").alias("k"))
    out = meetings.meetings(rows, "p", "k", F.lit(1), 1, ())
    assert dict(out.dtypes)["a"] == "int"
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Join", plan)
    assert out.count() == meetings.meetings(rows.withColumn("k", F.format_string("%05d", "k")), "p", "k", F.lit(1), 1, ()).count()
