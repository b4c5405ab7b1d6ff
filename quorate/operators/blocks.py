"""All pairs as tasks on two blocks of rows each: rows are dealt to blocks by a hash, and every two blocks meet once.

A row is sent to as many tasks as there are blocks and no pair is shuffled, so shuffles are rows times blocks and a
task holds two blocks.  Blocks grow in number with the rows beyond ``most`` rows each; few rows make ``least`` blocks, which
keeps all cores busy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Partitions of the tasks, at most.
TASKS = 4000


def number(rows: int, most: int, least: int = 12) -> int:
    """Blocks for so many rows."""
    return max(1, min(least, -(-rows // 256)), -(-rows // most))


def _dealt(rows: DataFrame, key: str, blocks: int) -> DataFrame:
    return rows.withColumn("block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))


def _met(sent: DataFrame, group: list[str], tasks: int, kernel: Callable, schema: str) -> DataFrame:
    keys = [*group, "one", "two"]
    return sent.repartition(max(1, min(tasks, TASKS)), *keys).groupBy(*keys).applyInArrow(kernel, schema)


def within(rows: DataFrame, key: str, blocks: int, kernel: Callable, schema: str, group: list[str] | tuple[str, ...] = (), groups: int = 1) -> DataFrame:
    """What ``kernel`` (Iterator[RecordBatch] -> Iterator[RecordBatch]) finds in every two blocks of the rows of a group.

    It gets the rows with ``one`` and ``two``, the numbers of the blocks, and ``side``: 0 for rows of the first block, 1 for rows of the second one.  A
    block also meets itself: then all rows have side 0.
    """
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    sent = _dealt(rows, key, blocks).select("*", other)
    sent = sent.select(*rows.columns, F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), (F.col("block") > F.col("other")).cast("int").alias("side"))
    return _met(sent, list(group), groups * blocks * (blocks + 1) // 2, kernel, schema)


def across(left: DataFrame, right: DataFrame, key: str, blocks: tuple[int, int], kernel: Callable, schema: str) -> DataFrame:
    """The same for every block of ``left`` with every block of ``right``, which have the same columns."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sides = [
        _dealt(left, key, blocks[0]).select(*left.columns, F.col("block").alias("one"), every(blocks[1]).alias("two"), F.lit(0).alias("side")),
        _dealt(right, key, blocks[1]).select(*left.columns, every(blocks[0]).alias("one"), F.col("block").alias("two"), F.lit(1).alias("side")),
    ]
    return _met(sides[0].unionAll(sides[1]), [], blocks[0] * blocks[1], kernel, schema)
