"""A backup of contents by hash: what is missing is copied once, and a seeded sample is read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators.graph import kept
from shelfmark.streaming.stores import exists

BLOB = "sha256 string, size long, content binary"
#: Fixed value: larger contents are not read back.
MOST_READ = 200 * 1024 * 1024


def backed(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema(BLOB).parquet(store)


def copy_missing(contents: DataFrame, store: str) -> DataFrame:
    """Adds the contents (BLOB) that the store lacks, or holds in another size, in the tasks that read them; returns what was added
    (sha256, size).

    The plan needs hashes and sizes alone. A run that is repeated adds nothing; one that failed has added nothing, as files
    are put in place at its end.
    """
    spark = contents.sparkSession
    there = backed(spark, store).select("sha256", "size").distinct() if exists(spark, store) else spark.createDataFrame([], "sha256 string, size long")
    plan = kept(contents.select("sha256", "size").distinct().join(there, ["sha256", "size"], "left_anti"))
    contents.select("sha256", "size", "content").join(plan, ["sha256", "size"], "left_semi").dropDuplicates(["sha256", "size"]).write.mode("append").parquet(store)
    return plan


def read_back(spark: SparkSession, store: str, n: int, seed: int) -> DataFrame:
    """(sha256, intact) of n stored contents that a seed picks, their hashes computed from what is stored."""
    some = backed(spark, store).where(F.col("size") <= MOST_READ).select("sha256", "size").distinct().orderBy(F.xxhash64("sha256", F.lit(seed)), "sha256").limit(n)
    read = backed(spark, store).join(F.broadcast(some), ["sha256", "size"], "left_semi")
    return read.groupBy("sha256").agg(F.bool_or(F.sha2("content", 256) == F.col("sha256")).alias("intact"))
