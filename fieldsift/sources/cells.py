"""Cell tables on disk: sorted writer with a read-back gate, pruned reader, integrity check, and feature export."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_cells(rows: DataFrame, path: str, key: str) -> int:
    """Writes rows by cell_id, sorted by key inside each cell, and returns the row count that a fresh read finds.

    Raises ValueError where that differs from what was to be written. A cell with many rows is dealt over several files.
    """
    spark = rows.sparkSession
    placed = rows.repartition("cell_id", F.pmod(F.xxhash64(key), F.lit(8))).sortWithinPartitions("cell_id", key)
    placed.write.option("compression", "zstd").partitionBy("cell_id").parquet(path)
    wanted, found = rows.count(), spark.read.parquet(path).count()
    if wanted != found:
        raise ValueError(f"{path}: {found} rows read back of {wanted}")
    return found


def read_cells(spark: SparkSession, path: str, cells: list[str]) -> DataFrame:
    """The rows of the named cells; others are pruned as partitions. No cell in common gives the declared columns, empty."""
    return spark.read.parquet(path).where(F.col("cell_id").isin(cells))


def listed_files(spark: SparkSession, path: str) -> DataFrame:
    """file (its path below path), bytes and sha256 of every data file of a cell table: what a manifest holds."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    inner = F.regexp_replace(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), "^[a-z0-9]+:/*", "/")
    root = F.lit("/" + re.sub("^[a-z0-9]+:/*", "", path).strip("/") + "/")
    return found.select(F.substring(inner, F.instr(inner, root) + F.length(root), F.lit(4096)).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify_files(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Files that are missing, unlisted or differ from manifest (file, bytes, sha256), by their paths below path."""
    own = listed_files(spark, path).withColumnsRenamed({"bytes": "found_bytes", "sha256": "found_sha256"})
    problem = F.when(F.col("found_bytes").isNull(), "missing").when(F.col("bytes").isNull(), "unlisted").when(F.col("bytes") != F.col("found_bytes"), "bytes").when(F.col("sha256") != F.col("found_sha256"), "digest")
    return manifest.join(own, "file", "full").select("file", problem.alias("problem")).where("problem is not null")


def feature_json(identity: Column, lon: Column, lat: Column, **properties: Column) -> Column:
    """A GeoJSON point feature as one line of text."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    own = F.struct(*(c.alias(n) for n, c in properties.items()))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), identity.alias("id"), geometry.alias("geometry"), own.alias("properties")))
