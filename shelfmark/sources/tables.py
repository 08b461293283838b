"""Readers: parquet tables, JSON-lines manifests, archive records, inventories, embedded page data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCAN = "path string, size long, mtime timestamp, sha256 string"
PROBE = "sha256 string, streams array<struct<codec_type:string,codec_name:string,width:int,height:int,disposition:string,avg_frame_rate:string>>, duration double, tags map<string,string>"
ARCHIVE = "sha256 string, type string, status string, members array<struct<path:string,size:long,crc32:string,sha256:string>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scan_manifest(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines entries; blank lines are skipped."""
    return spark.read.schema(SCAN).json(path)


def probe_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row for each content: the last line of a manifest wins.

    Of a folder of parts, the last part by length of name, then by name. Spark reads parts, and blocks of a large one, in an order of
    its own; so a line's place is its part, its block and, within that, the number of its row.
    """
    at = F.struct(F.length("_metadata.file_path"), "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    rows = spark.read.schema(PROBE).json(path).withColumn("at", at)
    names = [c for c in rows.columns if c != "at"]
    return rows.groupBy("sha256").agg(F.max_by(F.struct(*names[1:]), "at").alias("x")).select("sha256", "x.*")


def archive_members(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row for each member of each archive record (one JSON file for each archive, or one line)."""
    records = spark.read.schema(ARCHIVE).option("multiLine", not lines).json(path)
    return records.select("sha256", "type", "status", F.explode("members").alias("m")).select("sha256", "type", "status", "m.path", "m.size", "m.crc32", F.col("m.sha256").alias("member_sha256"))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated listing with exactly four fields; only files are kept."""
    rows = spark.read.option("sep", "\t").option("mode", "FAILFAST").schema("kind string, path string, size long, mtime string").csv(path)
    return rows.where("kind = 'F'").drop("kind")


def directory_scan(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """Path, size, time and SHA-256 of every file below a folder; files unchanged against ``known`` keep their hash unread."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    facts = listing.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    if known is None:
        return listing.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.sha2("content", 256).alias("sha256"))
    on = ["path", "size", "mtime"]
    same = facts.join(known.select(*on, "sha256"), on)
    fresh = listing.join(known.select(F.col("path"), F.col("size").alias("length"), F.col("mtime").alias("modificationTime")), ["path", "length", "modificationTime"], "left_anti")
    return same.unionByName(fresh.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.sha2("content", 256).alias("sha256")))


def rebased(path: Column, root: str) -> Column:
    """A path with backslashes as a relative path below the root marker; an error outside it."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    at = F.instr(slashed, f"/{root}/")
    return F.when(at > 0, F.substr(slashed, at + len(root) + 2)).otherwise(F.raise_error(F.concat(F.lit("outside the root: "), path)))


def keyset_page(df: DataFrame, key: str, after, size: int) -> DataFrame:
    """The next rows in key order."""
    return (df if after is None else df.where(F.col(key) > after)).orderBy(key).limit(size)
