"""Runs and bands of a one-dimensional profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def runs(profile: DataFrame, key: str = "key") -> DataFrame:
    """(start, end) of each run of true `on` along `pos` (a position each)."""
    own = Window.partitionBy(key).orderBy("pos")
    rows = profile.filter("on").withColumn("island", F.col("pos") - F.row_number().over(own))
    return rows.groupBy(key, "island").agg(F.min("pos").alias("start"), F.max("pos").alias("end")).drop("island")


def bands(profile: DataFrame, key: str = "key", min_gap: int = 2, min_height: int = 6) -> DataFrame:
    """Runs, joined over gaps of at most min_gap positions, that are then at least min_height long."""
    own = Window.partitionBy(key).orderBy("start")
    gap = F.col("start") - F.lag("end").over(own) - 1
    rows = runs(profile, key).withColumn("new", F.coalesce((gap > min_gap).cast("int"), F.lit(1)))
    rows = rows.withColumn("band", F.sum("new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.groupBy(key, "band").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("band")
    return out.filter(F.col("end") - F.col("start") + 1 >= min_height)
