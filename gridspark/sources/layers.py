"""Vector layers as polylines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LAYER = "lines array<array<double>>"


def read_layer(spark: SparkSession, path: str) -> DataFrame:
    """(ring, k, lat, lon) of JSON files {"lines": [[lon, lat, lon, lat, ...], ...]}.

    A line of odd length loses its last number; files follow one another in path order.
    """
    raw = spark.read.schema(LAYER).json(path, multiLine=True).withColumn("_file", F.input_file_name())
    # one row per file in the only window without a key
    sizes = raw.groupBy("_file").agg(F.sum(F.coalesce(F.size("lines"), F.lit(0))).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    lines = raw.join(F.broadcast(sizes.select("_file", before.alias("_before"))), "_file").select("_before", F.posexplode("lines").alias("_line", "v"))
    pairs = lines.where("size(v) >= 2").select((F.col("_before") + F.col("_line")).cast("int").alias("ring"), "v", F.explode(F.sequence(F.lit(0), F.expr("size(v) div 2 - 1"))).alias("k"))
    return pairs.select("ring", F.col("k").cast("int").alias("k"), F.get("v", (F.col("k") * 2 + 1).cast("int")).alias("lat"), F.get("v", (F.col("k") * 2).cast("int")).alias("lon"))
