"""Views of the given tables as sessions, series, directories, records and feeds, in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Monday 15 January 2024, 19:30 UTC, in seconds; every query takes its clock as a parameter.
NOW = 1705347000
DAY, HOUR, CUT = 86400, 3600, 5 * 3600


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(c: str) -> Column:
    """Seconds since 1970 of a timestamp without a zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({c} AS TIMESTAMP_NTZ))")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One timed session a row: s and e in seconds, flags eu (end unknown), tu (hours unknown), ad (all day), og (ongoing)."""
    df = read(spark, sf_dir, "events").withColumn("_t", seconds("ts"))
    i = F.col("event_id")
    s = (F.col("_t") - F.pmod("_t", F.lit(900))).cast("long")
    return df.select(
        i.alias("id"), "user_id", F.col("event_type").alias("program"), F.get_json_object("props", "$.k").cast("int").alias("venue"), s.alias("s"),
        (s + 60 * (1 + F.floor("value"))).cast("long").alias("e"), (i % 10 == 0).alias("eu"), (i % 23 == 0).alias("tu"), (i % 29 == 0).alias("ad"), (i % 17 == 0).alias("og"),
        (i % 31 == 0).alias("cancelled"), (i % 41 == 0).alias("featured"), F.concat(F.lit("T"), (i % 200).cast("string")).alias("title"), F.concat(F.lit("K"), (i % 6).cast("string")).alias("kind"),
    )


SESSIONS = """x0 AS (SELECT *, CAST(floor(epoch(ts) / 900) * 900 AS BIGINT) AS s FROM events),
x AS (SELECT event_id AS id, user_id, event_type AS program, CAST(json_extract_string(props, '$.k') AS INT) AS venue, s,
 CAST(s + 60 * (1 + floor(value)) AS BIGINT) AS e, event_id % 10 = 0 AS eu, event_id % 23 = 0 AS tu, event_id % 29 = 0 AS ad, event_id % 17 = 0 AS og,
 event_id % 31 = 0 AS cancelled, event_id % 41 = 0 AS featured, 'T' || (event_id % 200) AS title, 'K' || (event_id % 6) AS kind FROM x0)"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings of one or more days: day d, n days, start and end minute (either may be missing)."""
    k = F.col("o_orderkey")
    sm = F.when(k % 11 != 0, (k * 37 % 96) * 15)
    em = F.when((k % 11 != 0) & (k % 7 != 0), (sm + 15 * (k % 9)) % 1440)
    return read(spark, sf_dir, "orders").select(k.alias("id"), F.col("o_orderpriority").alias("program"), F.floor(seconds("o_orderdate") / DAY).cast("long").alias("d"), (1 + k % 5).alias("n"), sm.alias("sm"), em.alias("em"), (F.col("o_custkey") % 50).alias("venue"))


SERIES = """r AS (SELECT o_orderkey AS id, o_orderpriority AS program, CAST(floor(epoch(o_orderdate) / 86400) AS BIGINT) AS d, 1 + o_orderkey % 5 AS n,
 CASE WHEN o_orderkey % 11 <> 0 THEN (o_orderkey * 37 % 96) * 15 END AS sm,
 CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 7 <> 0 THEN ((o_orderkey * 37 % 96) * 15 + 15 * (o_orderkey % 9)) % 1440 END AS em, o_custkey % 50 AS venue FROM orders)"""


def places(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Points of one kind (supplier or customer) in integer microdegrees of a small region."""
    key, name = {"supplier": ("s_suppkey", "s_name"), "customer": ("c_custkey", "c_name")}[kind]
    k = F.col(key)
    nation = "s_nationkey" if kind == "supplier" else "c_nationkey"
    return read(spark, sf_dir, kind).select(k.alias("id"), F.col(name).alias("name"), (39_080_000 + k * 7919 % 60_000).alias("lat"), (-84_540_000 + k * 104_729 % 60_000).alias("lng"), F.concat(F.lit("H"), (F.col(nation) % 7).cast("string")).alias("hood"))


SUPPLIERS = "sp AS (SELECT s_suppkey AS id, s_name AS name, 39080000 + s_suppkey * 7919 % 60000 AS lat, -84540000 + s_suppkey * 104729 % 60000 AS lng, 'H' || (s_nationkey % 7) AS hood FROM supplier)"
CUSTOMERS = "cu AS (SELECT c_custkey AS id, c_name AS name, 39080000 + c_custkey * 7919 % 60000 AS lat, -84540000 + c_custkey * 104729 % 60000 AS lng, 'H' || (c_nationkey % 7) AS hood FROM customer)"
