"""Ranks and running sums over any number of rows, in the whole table or by group, with no group in one task.

Rows are range-partitioned by group and order and written with the number of their partition.  Each partition is summed
in the task that holds it; only one total a partition and group meets the others.  So a group of a third of all rows is
cut where the ranges are cut.  Ranks count distinct values first, so tied rows are one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import written


def running(df: DataFrame, group: list[str], order: list[str], weights: list[str], save=written) -> DataFrame:
    """``df`` with before_<w> for each weight: its sum over the group's rows that come earlier in ``order``.

    ``order`` must tell the rows of a group apart; null weights count as zero, null keys are a key of their own.
    """
    placed = save(df.repartitionByRange(*group, *order).withColumn("__part", F.spark_partition_id()))
    earlier = Window.partitionBy("__part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = placed.withColumns({f"before_{w}": F.coalesce(F.sum(w).over(earlier), F.lit(0)) for w in weights})
    # one row a partition and group: the partitions are few, and so are the groups that a partition holds in part
    lower = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*group, "__part").agg(*(F.sum(w).alias(f"__{w}") for w in weights))
    totals = totals.select("__part", *(F.col(g).alias(f"__g_{g}") for g in group), *(F.coalesce(F.sum(f"__{w}").over(lower), F.lit(0)).alias(f"__low_{w}") for w in weights))
    same = inner["__part"] == totals["__part"]
    for g in group:
        same = same & inner[g].eqNullSafe(totals[f"__g_{g}"])
    both = inner.join(totals, same)
    return both.select(*df.columns, *((F.col(f"before_{w}") + F.col(f"__low_{w}")).alias(f"before_{w}") for w in weights))


def with_ranks(df: DataFrame, ranks: dict[str, str], group: list[str] | None = None, save=written) -> DataFrame:
    """``df`` with a rank from 1 for each {new column: score}, ties at their average; a null score has a null rank."""
    group = group or []
    for name, score in ranks.items():
        counts = df.where(F.col(score).isNotNull()).groupBy(*(F.col(g).alias(f"__g{i}") for i, g in enumerate(group)), F.col(score).alias("__value")).agg(F.count("*").alias("n"))
        found = running(counts, [f"__g{i}" for i in range(len(group))], ["__value"], ["n"], save)
        found = found.select(*(f"__g{i}" for i in range(len(group))), "__value", (F.col("before_n") + (F.col("n") + 1) / 2).alias(name))
        same = F.col(score) == F.col("__value")
        for i, g in enumerate(group):
            same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
        df = df.join(found, same, "left").drop("__value", *(f"__g{i}" for i in range(len(group))))
    return df


def percentiles(df: DataFrame, value: str, key: str, group: list[str] | None = None, save=written) -> DataFrame:
    """``df`` with rank, from the top with ties by ``key``, and percentile, the share of the group's rows up to the row; ``key`` tells rows apart."""
    group = group or []
    rows = running(df.withColumn("__one", F.lit(1)), group, [value, key], ["__one"], save)
    ties = df.groupBy(*(F.col(g).alias(f"__g{i}") for i, g in enumerate(group)), F.col(value).alias("__value")).agg(F.count("*").alias("__same"))
    below = running(ties, [f"__g{i}" for i in range(len(group))], ["__value"], ["__same"], save)
    sizes = df.groupBy(*(F.col(g).alias(f"__s{i}") for i, g in enumerate(group))).agg(F.count("*").alias("__all"))
    same, sized = F.col(value).eqNullSafe(F.col("__value")), F.lit(True)
    for i, g in enumerate(group):
        same, sized = same & F.col(g).eqNullSafe(F.col(f"__g{i}")), sized & F.col(g).eqNullSafe(F.col(f"__s{i}"))
    rows = rows.join(below, same).join(sizes, sized)
    place, above = F.col("before___one") + 1, F.col("__all") - F.col("before___same") - F.col("__same")
    return rows.select(*df.columns, (above + place - F.col("before___same")).cast("int").alias("rank"), (place / F.col("__all")).alias("percentile"))
