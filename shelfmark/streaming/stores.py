"""Folders of bucketed parquet in which a batch rewrites only the buckets that it touches.

A batch may be repeated after a failure: it writes the same rows again. The buckets it is going to touch are noted beside the
store before they are written, so that a repetition touches them too, even where the first attempt has changed what tells them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfmark.operators.graph import both_ways, kept


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def bucketed(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def stored(spark: SparkSession, store: str, schema: StructType) -> DataFrame:
    """The rows of a store of that schema (with the column ``bucket``); none before its first batch."""
    return spark.read.schema(schema).parquet(store) if exists(spark, store) else spark.createDataFrame([], schema)


def put(rows: DataFrame, store: str) -> None:
    """Each bucket is written by one task, as one file."""
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(store)


def update_latest(new: DataFrame, store: str, key: str = "id", buckets: int = 64) -> None:
    """Puts rows in the place of those of equal key."""
    spark = new.sparkSession
    new = kept(bucketed(new, key, buckets))
    touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most ``buckets``
    if touched:
        old = stored(spark, store, new.schema).where(F.col("bucket").isin(touched))
        put(kept(old.join(new.select(key), key, "left_anti").unionByName(new)), store)


def pairs(spark: SparkSession, store: str, schema: StructType) -> DataFrame:
    """The pairs (a < b, and the other columns of the schema) of a pair store."""
    return stored(spark, store, _with_bucket(schema)).where("a < b").drop("bucket")


def _with_bucket(schema: StructType) -> StructType:
    return StructType([*schema.fields, *StructType.fromDDL("bucket int").fields])


def replace_pairs(ids: DataFrame, new: DataFrame, store: str, batch: int, buckets: int = 256) -> list[int]:
    """Replaces all pairs that touch the ids (id) by the new pairs (a, b and more), each of which touches one; returns the buckets
    that were written.

    A pair is stored under both of its ends, so the partners of an id are found in that id's bucket alone, and only the buckets of
    ids and of their old and new partners are read and written. A bucket that loses its last pair keeps a row of nulls.
    """
    spark, schema = ids.sparkSession, _with_bucket(new.schema)
    ids = kept(ids.select("id").where("id is not null").distinct())
    one = new.withColumns({"a": F.least("a", "b"), "b": F.greatest("a", "b")}).where("a < b").dropDuplicates(["a", "b"])
    new = bucketed(both_ways(kept(one)), "a", buckets)
    first, old = not exists(spark, store), stored(spark, store, schema)
    own = kept(bucketed(ids.select(F.col("id").alias("a")), "a", buckets).select("bucket").distinct())
    near = [r["bucket"] for r in own.collect()]
    gone = old.where(F.col("bucket").isin(near)).join(ids.select(F.col("id").alias("a")), "a", "left_semi")
    partners = bucketed(gone.select(F.col("b").alias("a")).distinct(), "a", buckets).select("bucket")
    note = f"{store}-notes/batch={batch}"
    touched = own.unionAll(partners).unionAll(new.select("bucket"))
    if exists(spark, note):
        touched = touched.unionAll(kept(spark.read.schema("bucket int").parquet(note)))
    touched = kept(touched.distinct())
    touched.write.mode("overwrite").parquet(note)
    at = sorted(r["bucket"] for r in touched.collect())  # at most ``buckets``
    if not at:
        return at
    held = touched.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields[:-1]), "bucket")
    if first:  # nothing of the store is read
        put(new.select(*schema.names).unionByName(held), store)
        return at
    stay = old.where(F.col("bucket").isin(at) & F.col("a").isNotNull())
    for end in ("a", "b"):
        stay = stay.join(ids.select(F.col("id").alias(end)), end, "left_anti")
    put(kept(stay.select(*schema.names).unionByName(new.select(*schema.names)).unionByName(held)), store)
    return at
