"""Fields, points and lines derived from the standard tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geodesy as G


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


KEYED_ROWS = 250_000  # rows of a table that a task sorts by key


def keyed(spark: SparkSession, d: str, name: str, key: str) -> DataFrame:
    """A table dealt by a key to as many tasks as its rows need: windows by the key sort a bounded number of rows in a task."""
    t = table(spark, d, name)
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return t.repartition(max(own, -(-t.count() // KEYED_ROWS)), key)


def fe(spark: SparkSession, d: str) -> DataFrame:
    """The embeddings as a field: row j = vec_id, column i = component."""
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("int").alias("j"), F.posexplode("embedding").alias("i", "value")).withColumn("value", F.col("value").cast("double"))


def fe_grid(spark: SparkSession, d: str) -> G.LatLon:
    nj = table(spark, d, "embeddings").agg(F.max("vec_id")).first()[0] + 1
    return G.LatLon(64, int(nj), 90.0, 0.0, -90.0, 354.375)


def fh(spark: SparkSession, d: str, *by: str) -> DataFrame:
    """Mean event value by hour (j) and day of month (i)."""
    e = table(spark, d, "events")
    return e.groupBy(*by, F.hour("ts").alias("j"), (F.dayofmonth("ts") - 1).alias("i")).agg(F.round(F.avg("value"), 9).alias("value"))


def points(spark: SparkSession, d: str) -> DataFrame:
    """A point per order, spread over the globe."""
    o = table(spark, d, "orders")
    return o.select("o_orderkey", ((F.col("o_custkey") * 37 % 1800) / 10.0 - 90.0).alias("lat"), ((F.col("o_orderkey") * 53 % 3600) / 10.0 - 180.0).alias("lon"))


def tracks(spark: SparkSession, d: str) -> DataFrame:
    """A polyline per customer through its orders in time."""
    from pyspark.sql import Window as W

    o = table(spark, d, "orders")
    k = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return o.select(F.col("o_custkey").alias("ring"), k.alias("k"), ((F.col("o_orderkey") * 29 % 1700) / 10.0 - 85.0).alias("lat"), ((F.col("o_orderkey") * 53 % 3599) / 10.0 - 179.9).alias("lon"))


# The same in SQL, for the oracles.
FE = "fe AS (SELECT vec_id::INT AS j, (k - 1)::INT AS i, embedding[k]::DOUBLE AS value FROM embeddings, range(1, 65) t(k)), fen AS (SELECT max(vec_id)::INT + 1 AS nj FROM embeddings)"
FH = "fh AS (SELECT hour(ts)::INT AS j, (day(ts) - 1)::INT AS i, round(avg(value), 9) AS value FROM events GROUP BY ALL)"
FHT = "fht AS (SELECT event_type, hour(ts)::INT AS j, (day(ts) - 1)::INT AS i, round(avg(value), 9) AS value FROM events GROUP BY ALL)"
POINTS = "pts AS (SELECT o_orderkey, (o_custkey * 37 % 1800) / 10.0::DOUBLE - 90 AS lat, (o_orderkey * 53 % 3600) / 10.0::DOUBLE - 180 AS lon FROM orders)"
TRACKS = "trk AS (SELECT o_custkey AS ring, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INT AS k, (o_orderkey * 29 % 1700) / 10.0::DOUBLE - 85 AS lat, (o_orderkey * 53 % 3599) / 10.0::DOUBLE - 179.9::DOUBLE AS lon FROM orders)"


def r6(c, places: int = 6):
    """Rounded, with no negative zero."""
    v = F.round(c, places)
    return F.when(v == 0, 0.0).otherwise(v)


def s6(e: str, places: int = 6) -> str:
    return f"CASE WHEN round({e}, {places}) = 0 THEN 0.0::DOUBLE ELSE round({e}, {places}) END"
