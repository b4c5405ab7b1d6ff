"""Tolerant as-of join: for every left row the latest right row of its key at or before its time.

Method.  Left and right rows are put together and range-partitioned over all of them by (key, time,
side, rank), so that a hot key is spread over as many partitions as its rows need.  A partition is
sorted and scanned once from start to end with the last right row as its only state.  The scan leaves
each left row with the right row that the partition knows, and one summary for the partition: its
last right row and how many rows tie with it.  The summaries, one for each partition and none
wider than six numbers, are combined from left to right into what every partition would have been
handed by those before it, and a second pass over the scanned rows adds that carry-in: to left rows that
saw no right row of their key yet, and to the ties of a time that began in a partition before.

Repeated rows are counted before the range partitioning (and partly before any shuffle), so a row that is
repeated without bound is one row there.  Nothing but the summaries, whose number is the number of
partitions, reaches the driver.

Defined results: left rows of equal id, key and time count once; right rows all count, repeated ones
too, and are named in ``n_tied``.  A null key or time never matches, a left row that has one is returned
unmatched.  Of right rows at one time the larger ``rank`` wins, then the larger id; nulls lose.
Empty tables give empty or unmatched results; columns that aren't named don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

HOUR = 3_600_000_000
STEP = 6 * HOUR
TOLERANCE = 720 * HOUR
#: Columns by which the union is dealt and sorted; right rows (side 0) come before left rows of their time.
ORDER = ["key", "t", "side", "rank", "id"]
_SCANNED = "part int, summary boolean, key long, t long, id long, match_id long, match_t long, match_rank long, n_tied long"


def _masked(values: np.ndarray, missing: np.ndarray) -> pa.Array:
    return pa.array(values, pa.int64(), mask=missing)


def scan(batches: Iterator[pa.RecordBatch], part: int) -> Iterator[pa.RecordBatch]:
    """Left rows of one sorted partition with the last right row before them, then the partition's summary.

    Batches have ORDER and ``n``, how often the row stands.  The state between batches is a single right
    row, which is put in front of the next batch.
    """
    last = None  # key, t, rank or None, id or None, ties
    for batch in batches:
        if not batch.num_rows:
            continue
        key, t, side, n = (batch.column(c).to_numpy() for c in ("key", "t", "side", "n"))
        rank, name = batch.column("rank"), batch.column("id")
        no_rank, no_name = (np.asarray(c.is_null()) for c in (rank, name))
        rank, name = (c.fill_null(0).to_numpy() for c in (rank, name))
        if last is not None:
            head = [np.array([v], a.dtype) for v, a in zip((last[0], last[1], 0, last[4]), (key, t, side, n), strict=True)]
            key, t, side, n = (np.r_[h, a] for h, a in zip(head, (key, t, side, n), strict=True))
            rank, name = np.r_[np.int64(last[2] or 0), rank], np.r_[np.int64(last[3] or 0), name]
            no_rank, no_name = np.r_[last[2] is None, no_rank], np.r_[last[3] is None, no_name]
        at = np.arange(len(key))
        right = side == 0
        seen = np.maximum.accumulate(np.where(right, at, -1))
        opens = np.maximum.accumulate(np.where(np.r_[True, (key[1:] != key[:-1]) | (t[1:] != t[:-1])], at, 0))
        counted = np.r_[0, np.cumsum(np.where(right, n, 0))]
        left = np.flatnonzero(~right)
        if len(left):
            by = seen[left]
            found = (by >= 0) & (key[by] == key[left])
            ties = np.where(found, counted[by + 1] - counted[opens[by]], 0)
            columns = [
                pa.array(np.full(len(left), part, np.int32)), pa.array(np.zeros(len(left), bool)), pa.array(key[left]), pa.array(t[left]), _masked(name[left], no_name[left]),
                _masked(name[by], ~found | no_name[by]), _masked(t[by], ~found), _masked(rank[by], ~found | no_rank[by]), pa.array(ties),
            ]
            yield pa.record_batch(columns, names=_names())
        end = int(seen[-1])
        if end >= 0:
            last = (int(key[end]), int(t[end]), None if no_rank[end] else int(rank[end]), None if no_name[end] else int(name[end]), int(counted[end + 1] - counted[opens[end]]))
    if last is not None:
        values = [part, True, last[0], None, None, last[3], last[1], last[2], last[4]]
        types = [pa.int32(), pa.bool_()] + [pa.int64()] * 7
        yield pa.record_batch([pa.array([v], k) for v, k in zip(values, types, strict=True)], names=_names())


def _names() -> list[str]:
    return [c.split()[0] for c in _SCANNED.split(", ")]


def carried(summaries: list[tuple], parts: int) -> list[tuple]:
    """(part, key, t, rank, id, ties) that each partition is handed: the last right row of all before it.

    ``summaries`` have the same columns, none for a partition without right rows.
    """
    own = {s[0]: s[1:] for s in summaries}
    out, held = [], None
    for part in range(parts):
        if held is not None:
            out.append((part, *held))
        now = own.get(part)
        if now is not None:
            tied = held is not None and held[:2] == now[:2]
            held = (*now[:4], now[4] + held[4]) if tied else now
    return out


def latest(left: DataFrame, right: DataFrame, tolerance: int, partitions: int | None = None) -> DataFrame:
    """``left`` (id, key, t) with match_id, match_t, match_rank and n_tied from ``right`` (id, key, t, rank), all long.

    ``t - match_t`` is at most ``tolerance``.  Rows without a match have n_tied 0 and nulls.
    """
    spark = left.sparkSession
    tasks = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    left = left.select(*(F.col(c).cast("long").alias(c) for c in ("id", "key", "t")))
    right = right.select(*(F.col(c).cast("long").alias(c) for c in ("id", "key", "t", "rank"))).where("key is not null and t is not null")
    # nulls never match: they need no place in the order, and a hash deals them well
    none = F.lit(None).cast("long")
    apart = left.where("key is null or t is null").distinct().select("id", "key", "t", none.alias("match_id"), none.alias("match_t"), none.alias("match_rank"), F.lit(0).cast("long").alias("n_tied"))
    sides = left.where("key is not null and t is not null").select("key", "t", F.lit(1).alias("side"), none.alias("rank"), "id").unionByName(right.select("key", "t", F.lit(0).alias("side"), "rank", "id"))
    counted = sides.groupBy(*ORDER).agg(F.count("*").alias("n"))
    dealt = counted.repartitionByRange(tasks, *ORDER).sortWithinPartitions(*ORDER)

    @common.tidy
    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from scan(batches, TaskContext.get().partitionId())

    rows = common.materialise(dealt.mapInArrow(scanned, _SCANNED), "as-of")
    ends = rows.where("summary").select("part", "key", "match_t", "match_rank", "match_id", "n_tied").collect()  # one row a partition
    parts = 1 + max(tasks, rows.agg(F.max("part")).first()[0] or 0)
    handed = carried([tuple(r) for r in ends], parts)
    schema = "part_ int, key_ long, t_ long, rank_ long, id_ long, ties_ long"
    carry = F.broadcast(spark.createDataFrame(handed, schema))
    joined = rows.where("not summary").join(carry, (F.col("part") == F.col("part_")) & (F.col("key") == F.col("key_")), "left")
    fresh = F.col("match_t").isNull() & F.col("t_").isNotNull()
    tied = F.when(F.col("match_t") == F.col("t_"), F.col("ties_")).otherwise(0)
    taken = joined.select("id", "key", "t", *(F.when(fresh, F.col(c)).otherwise(F.col(m)).alias(m) for c, m in (("id_", "match_id"), ("t_", "match_t"), ("rank_", "match_rank"))), F.when(fresh, F.col("ties_")).otherwise(F.col("n_tied") + tied).alias("n_tied"))
    near = F.col("match_t").isNotNull() & (F.col("t") - F.col("match_t") <= tolerance)
    taken = taken.select("id", "key", "t", *(F.when(near, F.col(c)).alias(c) for c in ("match_id", "match_t", "match_rank")), F.when(near, F.col("n_tied")).otherwise(0).cast("long").alias("n_tied"))
    return taken.unionByName(apart)


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970 (UTC) of a time column; one without a zone is read as UTC, whatever the session's zone."""
    c = F.col(column)
    if df.schema[column].dataType.typeName() != "timestamp_ntz":
        return F.unix_micros(c.cast("timestamp"))
    second = (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("long")
    return F.unix_date(c.cast("date")).cast("long") * (24 * HOUR) + F.hour(c).cast("long") * HOUR + F.minute(c).cast("long") * 60_000_000 + second


def _crc(column: str) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary"))


def _used_time(df: DataFrame, time: str, name: str) -> Column:
    us = micros(df, time)
    return F.when(_crc(name) % 2 == 1, us - F.pmod(us, F.lit(STEP))).otherwise(us)


def clicks_to_orders(clicks: DataFrame, sales: DataFrame) -> DataFrame:
    """The contract's result: click_id, client_id, ts_us, sale_id, lag_us, total_cents, n_tied."""
    left = clicks.select(F.col("click_id").alias("id"), F.col("client_id").alias("key"), _used_time(clicks, "ts", "click_id").alias("t"))
    cents = F.floor(100 * F.col("total") + 0.5)
    whole = F.when(F.abs(F.col("total")) < 9e16, cents).cast("long")  # beyond that, and for no number, there are no cents
    twice = F.when(_crc("sale_id") % 3 != 0, F.array(F.col("sale_id"), -1 - F.col("sale_id"))).otherwise(F.array("sale_id"))
    right = sales.select(F.explode(twice).alias("id"), F.col("client_id").alias("key"), _used_time(sales, "sold_at", "sale_id").alias("t"), whole.alias("rank"))
    out = latest(left, right, TOLERANCE)
    return out.select(F.col("id").alias("click_id"), F.col("key").alias("client_id"), F.col("t").alias("ts_us"), F.col("match_id").alias("sale_id"), (F.col("t") - F.col("match_t")).alias("lag_us"), F.col("match_rank").alias("total_cents"), "n_tied")


def op11(spark, sf_dir: str) -> DataFrame:
    return clicks_to_orders(common.read_table(spark, sf_dir, "clicks"), common.read_table(spark, sf_dir, "sales"))


#: The same result from DuckDB's own as-of join; CRC-32 is spelled out, as that engine has none.
ORACLE = """
WITH steps AS (SELECT list(c ORDER BY b) AS step FROM (SELECT b, list_reduce(list_concat([CAST(b AS BIGINT)], CAST(range(8) AS BIGINT[])), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(b))),
ids AS (SELECT DISTINCT click_id AS i FROM clicks WHERE click_id IS NOT NULL UNION SELECT DISTINCT sale_id FROM sales WHERE sale_id IS NOT NULL),
crc AS (SELECT i, xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(i AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
  lambda c, x: xor(c >> 8, step[xor(c & 255, x) + 1]))) AS h FROM ids, steps),
left_rows AS (SELECT DISTINCT click_id, client_id, CASE WHEN h % 2 = 1 THEN us - us % 21600000000 ELSE us END AS ts_us FROM (SELECT click_id, client_id, epoch_us(ts) AS us FROM clicks) LEFT JOIN crc ON i = click_id),
base AS (SELECT sale_id, client_id, CASE WHEN h % 2 = 1 THEN us - us % 21600000000 ELSE us END AS t, cents, h FROM (SELECT sale_id, client_id, epoch_us(sold_at) AS us, CAST(floor(100 * total + 0.5) AS BIGINT) AS cents FROM sales) LEFT JOIN crc ON i = sale_id),
orders AS (SELECT sale_id, client_id, t, cents FROM base UNION ALL SELECT -1 - sale_id, client_id, t, cents FROM base WHERE h % 3 <> 0),
best AS (SELECT client_id, t, count(*) AS n_tied, arg_max(struct_pack(s := sale_id, c := cents), struct_pack(a := cents IS NOT NULL, c := coalesce(cents, 0), b := sale_id IS NOT NULL, s := coalesce(sale_id, 0))) AS won
  FROM orders WHERE client_id IS NOT NULL AND t IS NOT NULL GROUP BY client_id, t),
met AS (SELECT l.*, b.t, b.n_tied AS n, b.won FROM left_rows l ASOF LEFT JOIN best b ON l.client_id = b.client_id AND l.ts_us >= b.t)
SELECT click_id, client_id, ts_us, CASE WHEN ok THEN won.s END AS sale_id, CASE WHEN ok THEN ts_us - t END AS lag_us, CASE WHEN ok THEN won.c END AS total_cents, CASE WHEN ok THEN n ELSE 0 END AS n_tied
FROM (SELECT *, coalesce(ts_us - t <= 2592000000000, false) AS ok FROM met)
"""
