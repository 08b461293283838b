"""Order MinHash fingerprints: sensitive to edit distance, not only to the set of k-mers.

Each k-mer of code points is numbered by occurrence, so that repeats differ. For each of m hash functions the l smallest
numbered k-mers are selected, put back into text order, and the tuple is hashed; the share of equal tuples of two texts
estimates a likeness that falls with their edit distance. The fingerprint is the m tuple hashes (32 bits each, in hex).

Texts shorter than k are one k-mer; with fewer than l k-mers, the tuple has those there are. Null counts as empty; an empty
text has the fingerprint of no k-mers, equal to that of any other empty text (likeness 1).
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

from shelfmark.llm.common import arrow_map, keyed, texts

U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
        x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
        return x ^ (x >> U(33))


def hash_of(codes: np.ndarray) -> int:
    out = len(codes)
    for c in codes.tolist():
        out = (out * 0x9E3779B97F4A7C15 + c + 1) % 2**64
    return out


class OrderMinHash:
    """k is a power of two."""

    def __init__(self, k: int = 8, m: int = 32, l: int = 2, seed: int = 17):
        if k & (k - 1):
            raise ValueError("k must be a power of two")
        self.k, self.m, self.l = k, m, l
        self.odd = np.random.default_rng(seed).integers(1, 2**63, m, dtype=U) * U(2) + U(1)

    def numbered(self, text: str) -> np.ndarray:
        """A 64-bit hash of each k-mer with its occurrence number, in text order."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(U)
        n = len(codes)
        if not n:
            return codes
        with np.errstate(over="ignore"):
            h, base, width = codes + U(1), U(0x9E3779B97F4A7C15), 1
            while width < self.k and 2 * width <= n:  # hashes of twice as many characters
                h = h[:-width] * base + h[width:]
                base, width = base * base, 2 * width
            if width < self.k:  # the text is shorter than k: one k-mer
                h = np.array([hash_of(codes)], U)
        h = _mixed(h)
        n = len(h)
        bits = U((1 << n.bit_length()) - 1)
        packed = (h & ~bits) | np.arange(n, dtype=U)  # sorts by hash, then by place
        packed.sort()
        same = (packed[1:] & ~bits) == (packed[:-1] & ~bits)
        if same.any():
            at = np.flatnonzero(np.concatenate(([True], ~same)))
            number = np.arange(n) - np.repeat(at, np.diff(np.append(at, n)))
            later = np.flatnonzero(number)
            where = (packed[later] & bits).astype(np.int64)
            with np.errstate(over="ignore"):
                h[where] = _mixed(h[where] + number[later].astype(U) * U(0xD1B54A32D192ED03))
        return h

    def fingerprint(self, text: str) -> np.ndarray:
        h = self.numbered(text)
        if not len(h):
            return np.zeros(self.m, "<u4")
        out = np.empty(self.m, U)
        step = max(1, min(self.m, 4_000_000 // len(h)))  # bounded memory for long texts
        with np.errstate(over="ignore"):
            for a in range(0, self.m, step):
                odd = self.odd[a : a + step]
                ranks = odd[:, None] * h[None, :]  # h is mixed already; only the upper bits decide
                rows, picked = np.arange(len(odd)), []
                for _ in range(min(self.l, len(h))):
                    picked.append(at := ranks.argmin(axis=1))
                    ranks[rows, at] = np.iinfo(U).max
                places = np.sort(np.array(picked), axis=0)  # text order
                tuples = np.zeros(len(odd), U)
                for at in places:
                    tuples = _mixed(tuples * U(0xA0761D6478BD642F) + h[at])
                out[a : a + step] = _mixed(tuples + odd)
        return (out >> U(32)).astype("<u4")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def fingerprints(docs: DataFrame, k: int = 8, m: int = 32, l: int = 2) -> DataFrame:
    """doc_id and fingerprint (hex) of every whole text."""

    def start():
        omh = OrderMinHash(k, m, l)
        return lambda doc_id, text: [doc_id, [omh.fingerprint(t or "").tobytes().hex() for t in text]]

    return arrow_map(texts(docs), start, "doc_id long, fingerprint string")


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_likeness(docs: DataFrame, k: int = 8, m: int = 32, l: int = 2, rows_in_block: int = 2000, most_blocks: int = 4096) -> DataFrame:
    """Fingerprints of every text and of its edited form: its last third replaced by the start of the next document.

    Next is the document of the next smaller doc_id (null is smallest; equal ids go by their text); the last one's next is the
    first. Documents are dealt into blocks by ranges of doc_id, bounded in number; the first row of each block is also sent to
    the block before, so each text moves once and each block streams through one task in order, one document at a time.
    """
    rows = keyed(texts(docs))
    n = docs.count()
    if n == 0:
        return rows.select("doc_id").limit(0).selectExpr("doc_id", "0L n_chars", "'' edited_sha256", "'' fingerprint", "'' edited_fingerprint", "0D near_edited", "0D near_next")
    blocks = int(min(most_blocks, max(1, n // rows_in_block)))
    cuts = sorted({int(x) for x in rows.stat.approxQuantile("k1", [i / blocks for i in range(1, blocks)], 0.1 / blocks)}) if blocks > 1 else []
    # block b holds the ids in (cuts[b-1], cuts[b]]; ids fall, so the row after block b's last is the largest of block b-1
    block = F.expr(_block_of(cuts))
    placed = rows.withColumn("block", block).withColumn("order", F.struct(F.col("k1"), F.col("k2"), F.coalesce("text", F.lit(""))))
    key = F.struct("k1", "k2")
    heads = {r["block"]: (r["head"]["k1"], r["head"]["k2"]) for r in placed.groupBy("block").agg(F.max(key).alias("head")).collect()}  # one row a block
    used = sorted(heads, reverse=True)
    sent = [(*heads[b], used[i - 1]) for i, b in enumerate(used)]  # the first block's head closes the last block
    session = docs.sparkSession
    target = session.createDataFrame(sent, "k1 long, k2 long, also int")
    both = placed.join(F.broadcast(target), ["k1", "k2"], "left")
    both = both.select("doc_id", "text", "k1", "k2", F.explode(F.when(F.col("also").isNull(), F.array(F.struct(F.col("block").alias("to"), F.lit(0).alias("copy")))).otherwise(F.array(F.struct(F.col("block").alias("to"), F.lit(0).alias("copy")), F.struct(F.col("also").alias("to"), F.lit(1).alias("copy"))))).alias("x"))
    both = both.select("doc_id", "text", "k1", "k2", "x.to", "x.copy").repartition(len(used), "to").sortWithinPartitions(F.asc("to"), F.asc("copy"), F.desc("k1"), F.desc("k2")).select("doc_id", "text", "to", "copy")
    schema = StructType.fromDDL(EDITED)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        omh = OrderMinHash(k, m, l)
        held = None  # (block, doc_id, text, fingerprint)
        ended = None
        for b in batches:
            out = []
            for doc_id, text, to, copy in zip(*(c.to_pylist() for c in b.columns)):
                text = text or ""
                if copy and ended == to:
                    continue  # a repeated row's copy
                own = omh.fingerprint(text)
                if held and held[0] == to:
                    _, its_id, its_text, its_own = held
                    third = len(its_text) // 3
                    edited = its_text[: len(its_text) - third] + text[:third]
                    its_edited = its_own if edited == its_text else omh.fingerprint(edited)
                    out.append((its_id, len(its_text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), its_own.tobytes().hex(), its_edited.tobytes().hex(), likeness(its_own, its_edited), likeness(its_own, own)))
                held, ended = (None, to) if copy else ((to, doc_id, text, own), ended)
            yield pa.RecordBatch.from_arrays([pa.array(v, x.type) for v, x in zip(zip(*out) if out else [[]] * len(arrow), arrow)], schema=arrow)

    return both.mapInArrow(run, schema)


def _block_of(cuts: list[int]) -> str:
    """SQL for the number of cuts below k1, by halving."""

    def part(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        return f"IF(k1 <= {cuts[mid]}L, {part(lo, mid)}, {part(mid + 1, hi)})" if cuts[mid] != -(2**63) else f"IF(k1 <= -9223372036854775807L - 1L, {part(lo, mid)}, {part(mid + 1, hi)})"

    return part(0, len(cuts))
