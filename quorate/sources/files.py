"""File sources and sinks with fixed schemas."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOTES = "item long, voter string, choice string"
MEMBERS = "voter string, full_name string, party string, chamber string, district int"
NESTED = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)


def read_csv(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    """Delimited text with a header; broken values become null, empty text too."""
    return spark.read.schema(schema).options(**({"header": True, "mode": "PERMISSIVE", "nullValue": ""} | options)).csv(path)


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return read_csv(spark, path, schema, sep="\t")


def read_wide(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A ragged external table in which NA stands for null."""
    return read_csv(spark, path, schema, nullValue="NA", enforceSchema=False)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_optional(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or None where there is none, in any store that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else None


def first_with_rows(*candidates: DataFrame | None) -> DataFrame:
    """The first source that has a row; the last one otherwise."""
    last = None
    for df in candidates:
        if df is not None:
            last = df
            if not df.isEmpty():
                return df
    if last is None:
        raise ValueError("no source")
    return last


def ensure_columns(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Adds missing columns as typed nulls."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in wanted.items() if c not in df.columns}) if set(wanted) - set(df.columns) else df


def drop_empty(df: DataFrame, optional: list[str]) -> DataFrame:
    """Without those optional columns that hold nothing but null or blank text; one aggregation decides."""
    there = [c for c in optional if c in df.columns]
    if not there:
        return df
    filled = df.agg(*(F.max(F.when(F.trim(F.col(c).cast("string")) != "", 1)).alias(c) for c in there)).first()
    return df.drop(*(c for c in there if filled[c] is None))


def flat(df: DataFrame) -> DataFrame:
    """Without nested columns, as text files need."""
    return df.select(*(f.name for f in df.schema.fields if not isinstance(f.dataType, NESTED)))


def write_csv(df: DataFrame, path: str) -> None:
    flat(df).write.mode("overwrite").option("header", True).csv(path)


def replace_label(df: DataFrame, path: str, label: str) -> None:
    """Replaces exactly the partitions of the labels in ``df``; a repeat has no further effect."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(label).parquet(path)


def read_jdbc(spark: SparkSession, url: str, query: str, **options) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def json_field(column: str, field: str, kind: str = "string"):
    return F.get_json_object(column, f"$.{field}").cast(kind)


def shared_folder(spark: SparkSession, prefix: str) -> str:
    """A new path in the folder that the cluster shares."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    base = spark.conf.get("spark.checkpoint.dir", None) or (known.get() if known.isDefined() else None)
    if base is None:
        local = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
        base = "file://" + tempfile.mkdtemp(prefix="quorate-tables-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_tables"
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{prefix}-{uuid.uuid4().hex}"


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """What a query shuffles in here is deleted when the query ends, not when the driver happens to collect its garbage; a session's own setting stays."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    if key in spark.conf.getAll:
        yield
        return
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the folder that the cluster shares: cuts lineage and computes the rows once."""
    path = shared_folder(df.sparkSession, "table")
    with brief_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
