"""What the corpus operators share: reading tables, keys for rows, shared intermediate tables, Arrow maps.

Row identity: two rows with equal ``doc_id`` and equal text are one document for every operator that compares documents;
each such row still appears in the result. ``doc_id`` may be null, and different texts may carry one ``doc_id``.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from shelfmark.operators.graph import kept

NO_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id (long) and text alone, so that extra columns and clashing names can't interfere."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def keyed(df: DataFrame) -> DataFrame:
    """Adds the row's key in two never-null columns, k1 (from doc_id) and k2 (from the text)."""
    return df.withColumns({"k1": F.coalesce("doc_id", F.lit(NO_ID)), "k2": F.xxhash64(F.coalesce("text", F.lit("\0")))})


def crc_fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4: 2 marks held-out rows (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: cuts the lineage and survives the loss of executors."""
    return kept(df)


def arrow_map(df: DataFrame, start: Callable[[], Callable[..., list]], ddl: str) -> DataFrame:
    """Maps Arrow batches: start() runs once in each task and gives f(*columns as lists) -> list of output columns."""
    schema = StructType.fromDDL(ddl)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = start()
        for b in batches:
            out = f(*(c.to_pylist() for c in b.columns))
            yield pa.RecordBatch.from_arrays([pa.array(v, x.type) for v, x in zip(out, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


@functools.lru_cache(maxsize=1)
def once(kind: type, *args):
    """An object that a Python worker builds once for the tasks of a stage; the last stage's goes, so that none pile up."""
    return kind(*args)


class Remembered(dict):
    """A dict that computes missing values with f and starts over at a fixed number of entries.

    Values of keys longer than ``longest`` are computed each time, so that the number of bytes has a bound too.
    """

    def __init__(self, f: Callable, most: int = 200_000, longest: int = 64):
        super().__init__()
        self.f, self.most, self.longest = f, most, longest

    def __missing__(self, key):
        if len(key) > self.longest:
            return self.f(key)
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.f(key)
        return value
