"""Writers: snapshots with a manifest, sorted manifests, copy plans and their verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_ONLY = frozenset({"media_tasks", "meta"})


def snapshot(tables: dict[str, DataFrame], folder: str, schema_only: frozenset[str] = SCHEMA_ONLY) -> DataFrame:
    """Each table as Parquet (processing tables as schemas alone), and a manifest (name, n) that is written last."""
    spark = next(iter(tables.values())).sparkSession
    counts = []
    for name, df in tables.items():
        kept = df.limit(0) if name in schema_only else df
        kept.write.mode("overwrite").parquet(f"{folder}/{name}")
        counts.append(spark.read.parquet(f"{folder}/{name}").agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")))
    manifest = counts[0]
    for c in counts[1:]:
        manifest = manifest.unionAll(c)
    manifest.write.mode("overwrite").json(f"{folder}/manifest")
    return manifest


def restore(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    names = [r.name for r in spark.read.json(f"{folder}/manifest").select("name").collect()]  # one row a table
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def manifest_lines(df: DataFrame, key: str, folder: str) -> None:
    """Sorted JSON lines; the folder is replaced as a whole."""
    df.orderBy(key).write.mode("overwrite").json(folder)


def copy_plan(wanted: DataFrame, there: DataFrame) -> DataFrame:
    """Listings (key, size): what is missing, or differs in size, is copied."""
    return wanted.join(there.select("key", "size"), ["key", "size"], "left_anti")


def orphans(there: DataFrame, referenced: DataFrame) -> DataFrame:
    return there.join(referenced.select("key"), "key", "left_anti")


def verified(sample: DataFrame, seed: int = 0, n: int = 3) -> DataFrame:
    """Of rows (key, content, sha256), n at random with whether the content still has its hash."""
    return sample.orderBy(F.rand(seed)).limit(n).select("key", (F.sha2("content", 256) == F.col("sha256")).alias("ok"))
