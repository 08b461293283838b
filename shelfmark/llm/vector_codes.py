"""Vector codes: product codebooks trained in integers, nearest entries by VA-file filtering.

Components become integers floor(256 * x) and vectors are cut into equal consecutive parts, each with a codebook of its own. An
entry's coordinates are quantised to ``bits`` bits: a cell number each, with the range of the entries in that cell. For a
batch of parts, lookup tables hold the least and the largest squared distance from each coordinate to each cell; summed over an
entry's cells they bound its distance. Only entries whose lower bound doesn't exceed the smallest upper bound are refined, with
integer distances, so the result is exact. Ties go to the lower index.

Training moves only sums: each task adds up the parts of each entry, Spark merges the tasks' sums, and the driver sees one row
for each entry (parts x entries). Codebooks have a fixed size; they are the only thing that is sent to all tasks.

Rows whose vector is null, empty, or holds null or non-finite components are dropped, and so are those of another length than the
vector of the smallest vec_id (null ids are largest), which can't be compared with it. A length that ``parts`` doesn't divide is
filled up with zeros. Integers beyond 2**26 count as 2**26, so that no distance overflows. Equal vec_ids go by their vectors;
repeated rows are rows of their own. With fewer rows than ``entries``, a codebook has an entry for each row; empty tables give none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from shelfmark.llm.common import written

MOST = 2**26


class VAFile:
    """Exact nearest entries (K x width integers) by cells and bounds."""

    def __init__(self, entries: np.ndarray, bits: int = 3):
        self.entries = np.asarray(entries, np.int64)
        k, width = self.entries.shape
        cells = 1 << bits
        ranks = self.entries.argsort(axis=0, kind="stable").argsort(axis=0, kind="stable")
        self.cell = ranks * cells // max(k, 1)  # equally filled cells
        self.low, self.high = np.zeros((2, width, cells), np.int64)
        for c in range(width):
            for cell in np.unique(self.cell[:, c]):
                held = self.entries[self.cell[:, c] == cell, c]
                self.low[c, cell], self.high[c, cell] = held.min(), held.max()

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distance of each query to each entry."""
        lower, upper = np.zeros((2, len(queries), len(self.entries)), np.int64)
        for c in range(self.entries.shape[1]):
            q = queries[:, c, None]
            below, above = self.low[c] - q, q - self.high[c]
            near = np.maximum(np.maximum(below, above), 0)
            far = np.maximum(np.abs(below), np.abs(above))
            lower += (near * near)[:, self.cell[:, c]]
            upper += (far * far)[:, self.cell[:, c]]
        return lower, upper

    def nearest(self, queries: np.ndarray, at_once: int = 4096) -> tuple[np.ndarray, np.ndarray, int]:
        """Index and squared distance of each query's nearest entry, and how many entries were refined in all."""
        index, error, refined = np.empty(len(queries), np.int64), np.empty(len(queries), np.int64), 0
        for a in range(0, len(queries), at_once):
            q = queries[a : a + at_once]
            lower, upper = self.bounds(q)
            row, entry = np.nonzero(lower <= upper.min(axis=1)[:, None])
            away = q[row] - self.entries[entry]
            d = np.einsum("ij,ij->i", away, away)
            starts = np.flatnonzero(np.diff(row, prepend=-1))  # each row has a candidate
            least = np.minimum.reduceat(d, starts)
            hit = np.flatnonzero(d == least[row])
            first = hit[np.flatnonzero(np.diff(row[hit], prepend=-1))]
            index[a : a + at_once], error[a : a + at_once] = entry[first], least
            refined += len(d)
        return index, error, refined


def as_integers(column: pa.Array, length: int, parts: int) -> np.ndarray:
    """rows x parts x width."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)
    whole = np.clip(np.floor(x * 256.0), -MOST, MOST).astype(np.int64)
    width = -(-length // parts)
    return np.pad(whole, ((0, 0), (0, width * parts - length))).reshape(-1, parts, width)


def finite(vectors: DataFrame, column: str) -> DataFrame:
    """vec_id, label and vector (doubles) of the rows whose vector is whole and finite."""
    rows = vectors.select("vec_id", "label", F.col(column).cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("vector").isNotNull() & (F.size("vector") > 0)).where(~bad)


def start_books(rows: DataFrame, length: int, parts: int, entries: int) -> np.ndarray:
    """parts x entries x width: the parts of the rows of smallest vec_id."""
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).collect()
    return as_integers(pa.array([r["vector"] for r in first], pa.list_(pa.float64())), length, parts).transpose(1, 0, 2).copy()


def refit(rows: DataFrame, books: np.ndarray, length: int, bits: int) -> np.ndarray:
    """Each entry becomes the componentwise floor of the mean of the parts nearest to it; unused ones stay."""
    parts, entries, width = books.shape
    schema = StructType.fromDDL("part int, entry int, n long, sums array<long>")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = [VAFile(b, bits) for b in books]
        n, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for b in batches:
            x = as_integers(b.column(0), length, parts)
            for p, f in enumerate(files):
                at = f.nearest(x[:, p])[0]
                n[p] += np.bincount(at, minlength=entries)
                np.add.at(sums[p], at, x[:, p])
        part, entry = np.nonzero(n)
        out = [part, entry, n[part, entry], list(sums[part, entry])]
        yield pa.RecordBatch.from_arrays([pa.array(v, x.type) for v, x in zip(out, arrow, strict=True)], schema=arrow)

    moved = rows.select("vector").mapInArrow(run, schema)
    merged = moved.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.get("sums", F.lit(j))).alias(f"s{j}") for j in range(width)))
    books = books.copy()
    for r in merged.collect():  # parts x entries rows at most
        books[r["part"], r["entry"]] = [r[f"s{j}"] // r["n"] for j in range(width)]
    return books


def compressed(vectors: DataFrame, column: str = "embedding", parts: int = 16, entries: int = 64, rounds: int = 2, bits: int = 3) -> tuple[np.ndarray, DataFrame]:
    """The codebooks (parts x entries x width), and vec_id, label, code (an index byte for each part) and error of every kept row."""
    if entries > 256:
        raise ValueError("an index has one byte")
    rows = finite(vectors, column)
    smallest = rows.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(1).collect()
    if not smallest:
        return np.zeros((parts, 0, 0), np.int64), rows.select("vec_id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error"))
    length = len(smallest[0]["vector"])
    rows = rows.where(F.size("vector") == length)
    books = start_books(rows, length, parts, entries)
    for _ in range(rounds):
        books = refit(rows, books, length, bits)
    schema = StructType([rows.schema["vec_id"], rows.schema["label"], *StructType.fromDDL("code binary, error long")])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = [VAFile(b, bits) for b in books]
        for b in batches:
            x = as_integers(b.column(2), length, parts)
            code, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p, f in enumerate(files):
                code[:, p], d, _ = f.nearest(x[:, p])
                error += d
            out = [b.column(0), b.column(1), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error)]
            yield pa.RecordBatch.from_arrays([v.cast(x.type) for v, x in zip(out, arrow, strict=True)], schema=arrow)

    return books, rows.mapInArrow(run, schema)


def decoded(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Approximate vectors (rows x length) of codes (rows x parts)."""
    return np.concatenate([books[p][codes[:, p]] for p in range(len(books))], axis=1) / 256.0


def books_text(books: np.ndarray) -> str:
    return ",".join(map(str, books.ravel().tolist()))


def code_digests(vectors: DataFrame, column: str = "embedding", hot_share: float = 0.001, **how) -> DataFrame:
    """vec_id, code (hex), error, label_error and codebooks_sha256 of every kept row.

    Labels that hold at least ``hot_share`` of the rows, at most 1 / hot_share, are sent to all tasks; the others meet their rows in
    a shuffle, where no label is large.
    """
    books, rows = compressed(vectors, column, **how)
    digest = hashlib.sha256(books_text(books).encode()).hexdigest()
    rows = written(rows)
    sums = written(rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n_of")))
    most = rows.count() * hot_share
    hot, rest = sums.where(F.col("n_of") >= most), sums.where(F.col("n_of") < most)
    same = F.col("label").eqNullSafe(F.col("of"))
    both = rows.join(F.broadcast(hot), same).unionByName(rows.join(F.broadcast(hot), same, "left_anti").join(rest, same))
    return both.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
