"""The monthly grid as a partitioned table (S9, J6): month and tile are folders.

A tile is a square of `tile` degrees. A lookup names the partitions that its
samples need — at most months x tiles of the store, so that list is small by
construction — and Spark prunes the scan by it at run time (dynamic partition
pruning): the grid's other months and tiles are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TILE = 5.0
PARTITIONS = ("month_key", "tile")


def month_of(month: Column) -> Column:
    return F.date_format(month, "yyyy-MM")


def tile_of(lat: Column, lon: Column, tile: float = TILE) -> Column:
    return F.concat_ws("_", F.floor(lat / tile).cast("string"), F.floor(lon / tile).cast("string"))


def write_grid(grid: DataFrame, path: str, month: str = "month", lat: str = "lat", lon: str = "lon", tile: float = TILE) -> None:
    """One file for each (month, tile); a partition holds a tile's cells of one month, whatever the grid's extent."""
    keyed = grid.withColumns({"month_key": month_of(F.col(month)), "tile": tile_of(F.col(lat), F.col(lon), tile)})
    keyed.repartition(*PARTITIONS).write.partitionBy(*PARTITIONS).parquet(path)


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def wanted_partitions(samples: DataFrame, month: str, lat: Column, lon: Column, tile: float = TILE) -> DataFrame:
    """Distinct (month_key, tile) of the samples that have both."""
    return (samples.select(month_of(F.col(month)).alias("month_key"), tile_of(lat, lon, tile).alias("tile"))
            .where((F.col("month_key") >= "0001-01") & (F.col("tile") != "")).distinct())


def crop_to(store: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of the wanted partitions; the scan reads no others. `wanted` has at most one row for each partition."""
    return store.join(F.broadcast(wanted), list(PARTITIONS), "left_semi").drop(*PARTITIONS)
