"""Repeated passages by sparse suffix arrays.

Suffixes are kept only where a k-word window's hash is the least among the windows of any ``least_words`` consecutive words
(minimisers): equal passages of that length keep suffixes at equal places. Suffixes whose first k words occur once drop out.
Those whose k words at most ``reach`` + 1 suffixes share are sorted by them and what follows; each is compared with its
neighbours in that order (``reach`` to either side: all that share its k words), and each match is extended to the right and to
the left, word by word. Matches of at least ``least_words`` words are repeats; a passage longer than one suffix's context is the
union of those of its suffixes. Where more share their k words, each window of ``least_words`` words with its minimiser there is
hashed as a whole (64 bits), and windows of equal hashes are repeats: the least and the greatest place of each hash, aggregated
in each task first and joined back, tell which windows repeat and which are later ones. Every window has one minimiser, so the
two ways together see them all. Of each repeat, the occurrence in the smallest doc_id (null first, then text, then place)
stays, the others may be cut.

Words are runs without ASCII white space, compared as they stand. Places in results are word numbers, end exclusive. Repeats
inside one document count from a distance of ``least_words`` on. Null and short texts have no repeats. Rows with equal doc_id and text are
one document, and each gets its result. The order is that of hashed words, which groups equal beginnings like any other order.
The sorted suffixes stream through each task. Words beside a key are compared by 32 bits of their hashes: an end of a span may
lie a word too far with probability 5e-10 for each pair compared.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from shelfmark.llm.common import NO_ID, Remembered, arrow_map, once, written

U = np.uint64
WORD = re.compile(rb"[^\x20\x09-\x0d]+")
U32 = np.dtype(">u4")


def _word_hash(word: bytes) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little") | 1


class Suffixes:
    def __init__(self, k: int, least_words: int):
        self.k, self.least, self.width = k, least_words, least_words - k
        self.word = Remembered(_word_hash)

    def hashes(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").split() if text else []
        return np.array(list(map(self.word.__getitem__, words)), U)

    @staticmethod
    def _mixed(w: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the n words from each place on."""
        with np.errstate(over="ignore"):
            h = np.zeros(len(at), U)
            for j in range(n):
                h = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9) + w[at + j]
            h = (h ^ (h >> U(32))) * U(0x94D049BB133111EB)
            return h ^ (h >> U(29))

    def windows(self, w: np.ndarray, at: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the windows of ``least`` words whose minimiser lies at one of the places."""
        held = np.zeros(len(w) - self.k + 1, bool)
        held[at] = True
        near = np.zeros(len(w) - self.least + 2, np.int64)  # windows that contain one of the places
        np.add.at(near, np.maximum(np.array(at) - self.width, 0), 1)
        np.add.at(near, np.minimum(np.array(at) + 1, len(near) - 1), -1)
        p = np.flatnonzero(np.cumsum(near[:-1]) > 0)
        windows = np.lib.stride_tricks.sliding_window_view(self._mixed(w, np.arange(len(held)), self.k), self.width + 1)
        step = 200_000
        own = np.concatenate([windows[p[i : i + step]].argmin(axis=1) + p[i : i + step] for i in range(0, len(p), step)])
        p = p[held[own]]
        return p, self._mixed(w, p, self.least)

    def anchors(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the minimisers and the hashes of their k words."""
        if len(w) < self.least:
            return np.zeros(0, np.int64), np.zeros(0, U)
        h = self._mixed(w, np.arange(len(w) - self.k + 1), self.k)
        windows = np.lib.stride_tricks.sliding_window_view(h, self.width + 1)
        step = 200_000
        at = np.unique(np.concatenate([windows[i : i + step].argmin(axis=1) + np.arange(i, min(i + step, len(windows))) for i in range(0, len(windows), step)]))
        return at, h[at]

    def contexts(self, w: np.ndarray, at: list[int]) -> tuple[list[bytes], list[bytes]]:
        """Up to ``width`` words that follow the k words at each place, and those before it, backwards; zeros past the ends."""
        x = self.width
        low = (w & U(0xFFFFFFFF)).astype(U32)
        line = np.concatenate([np.zeros(x, U32), low, np.zeros(x, U32)])
        return [line[x + p + self.k : 2 * x + p + self.k].tobytes() for p in at], [line[p : p + x][::-1].tobytes() for p in at]


def _prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each row, how many first words are equal (zeros never are)."""
    differ = (a != b) | (a == 0)
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


class Neighbours:
    """Compares suffixes that arrive in sorted order; keeps the last few rows."""

    def __init__(self, k: int, least_words: int, reach: int):
        self.k, self.least, self.reach = k, least_words, reach
        self.tail: dict | None = None

    def feed(self, rows: dict[str, np.ndarray]) -> list[np.ndarray]:
        n = len(rows["key"])
        if not n:
            return []
        kept = len(self.tail["key"]) if self.tail else 0
        all_ = {c: np.concatenate([self.tail[c], v]) if kept else v for c, v in rows.items()}
        key = all_["key"]
        total = len(key)
        best = np.full((total, 4), -1, np.int64)  # right and left extension: repeated, may be cut

        def match(i: np.ndarray, j: np.ndarray) -> None:
            if not len(i):
                return
            a, b = _prefix(all_["right"][i], all_["right"][j]), _prefix(all_["left"][i], all_["left"][j])
            k1, k2, pos = all_["k1"], all_["k2"], all_["pos"]
            same = (k1[i] == k1[j]) & (k2[i] == k2[j])
            ok = (a + b + self.k >= self.least) & ~(same & (np.abs(pos[i] - pos[j]) < self.least))
            i, j, a, b, same = i[ok], j[ok], a[ok], b[ok], same[ok]
            later = (k1[i] > k1[j]) | (k1[i] == k1[j]) & ((k2[i] > k2[j]) | same & (pos[i] > pos[j]))
            for col, v in ((0, a), (1, b)):
                np.maximum.at(best[:, col], i, v)
                np.maximum.at(best[:, col + 2], i[later], v[later])
                np.maximum.at(best[:, col], j, v)
                np.maximum.at(best[:, col + 2], j[~later], v[~later])

        for d in range(1, min(self.reach, total - 1) + 1):
            i = np.flatnonzero(key[d:] == key[:-d]) + d
            i = i[i >= kept]
            match(i, i - d)
        self.tail = {c: v[-self.reach :] for c, v in all_.items()}
        return self._spans(best, all_)

    def _spans(self, best: np.ndarray, rows: dict[str, np.ndarray]) -> list[np.ndarray]:
        hit = np.flatnonzero(best[:, 0] >= 0)
        best, p = best[hit], rows["pos"][hit]
        cut = best[:, 2] >= 0
        return [rows["k1"][hit], rows["k2"][hit], p - best[:, 1], p + self.k + best[:, 0], np.where(cut, p - best[:, 3], 0), np.where(cut, p + self.k + best[:, 2], 0)]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        elif b > a:
            out.append([a, b])
    return [(a, b) for a, b in out]


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans, and without the white space that follows each of them."""
    data = text.encode("utf-8", "surrogatepass")
    starts = [m.start() for m in WORD.finditer(data)] + [len(data)]
    out, at = [], 0
    for a, b in spans:
        out.append(data[at : starts[a]])
        at = starts[min(b, len(starts) - 1)]
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")


def _held(docs: DataFrame) -> DataFrame:
    """All columns and the row's key, the same plan wherever it is used, so that its exchange is made once."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(row.alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k1"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("\0"))).alias("k2"))


def repeats(docs: DataFrame, k: int = 16, least_words: int = 50, reach: int = 16) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): rows has k1, k2, doc_id and n_words of every row; spans has k1, k2 and arrays dup and cut of (from, to)."""

    def start():
        s = once(Suffixes, k, least_words)

        def f(doc_id, k1, k2, text):
            size, keys, places = [], [], []
            for t in text:
                w = s.hashes(t)
                at, h = s.anchors(w)
                size.append(len(w))
                keys.append(h.view(np.int64).tolist())
                places.append(at.tolist())
            return [doc_id, k1, k2, size, keys, places]

        return f

    held = _held(docs)
    given = held.select(F.col("row.doc_id").cast("long").alias("doc_id"), "k1", "k2", F.col("row.text").cast("string").alias("text"))
    rows = written(arrow_map(given, start, "doc_id long, k1 long, k2 long, n_words long, keys array<long>, places array<int>"))
    anchors = rows.where(F.size("keys") > 0).select("k1", "k2", F.explode(F.arrays_zip("keys", "places")).alias("x")).select("k1", "k2", F.col("x.keys").alias("key"), F.col("x.places").alias("pos"))
    # as a table, so that Spark may split the join of a hot key's anchors
    often = written(anchors.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", (F.col("n") > reach + 1).alias("crowded")))
    found = anchors.join(often, "key")
    lists = found.groupBy("k1", "k2").agg(F.collect_set(F.struct("pos", "key", "crowded")).alias("at"))  # bounded by the text

    # a suffix, or (with neither right nor left) a window under a crowded key, whose key is the hash of the whole window
    schema = StructType.fromDDL("key long, k1 long, k2 long, pos int, right binary, left binary")
    arrow = to_arrow_schema(schema)

    def suffixes(batches):
        s = once(Suffixes, k, least_words)
        for b in batches:
            out, some = [[] for _ in arrow], []
            seen, n = set(), 0
            texts_ = b.column(0).field("text").to_pylist()
            for text, k1, k2, at in zip(texts_, *(b.column(i).to_pylist() for i in (1, 2, 3))):
                if (k1, k2) in seen:
                    continue
                seen.add((k1, k2))
                w = s.hashes(text)
                few, many = [x for x in at if not x["crowded"]], [x["pos"] for x in at if x["crowded"]]
                places = [x["pos"] for x in few]
                right, left = s.contexts(w, places)
                for col, v in zip(out, ([x["key"] for x in few], [k1] * len(few), [k2] * len(few), places, right, left)):
                    col += v
                if many:
                    p, h = s.windows(w, many)
                    some.append((h.view(np.int64), np.full(len(p), k1), np.full(len(p), k2), p))
                    n += len(p)
                if n > 200_000:
                    yield of_windows(some)
                    some, n = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(v, x.type) for v, x in zip(out, arrow)], schema=arrow)
            if some:
                yield of_windows(some)

    def of_windows(some):
        cols = [np.concatenate(c) for c in zip(*some)]
        return pa.RecordBatch.from_arrays([*(pa.array(v).cast(x.type) for v, x in zip(cols, arrow)), *(pa.nulls(len(cols[0]), x.type) for x in list(arrow)[4:])], schema=arrow)

    joined = held.join(lists, ["k1", "k2"]).select("row", "k1", "k2", "at")
    both = written(joined.mapInArrow(suffixes, schema))
    order = both.where("right is not null").repartition("key").sortWithinPartitions("key", "right", "k1", "k2", "pos")
    spans = StructType.fromDDL("k1 long, k2 long, dup_from int, dup_to int, cut_from int, cut_to int")
    span_arrow = to_arrow_schema(spans)
    width = least_words - k

    def compare(batches):
        near = Neighbours(k, least_words, reach)
        for b in batches:
            col = {f.name: b.column(i) for i, f in enumerate(schema)}
            part = {c: col[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "k1", "k2", "pos")}
            for c in ("right", "left"):
                part[c] = np.frombuffer(b"".join(col[c].to_pylist()), U32).reshape(-1, width)
            found = near.feed(part)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(v).cast(x.type) for v, x in zip(found, span_arrow)], schema=span_arrow)

    windows = both.where("right is null").select("key", "k1", "k2", "pos")
    place = F.struct("k1", "k2", "pos")
    ends = windows.groupBy("key").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    other = lambda a, b: (F.col(f"{a}k1") != F.col(f"{b}k1")) | (F.col(f"{a}k2") != F.col(f"{b}k2"))
    ends = written(ends.where(other("first.", "last.") | (F.col("last.pos") - F.col("first.pos") >= least_words)))
    later = other("", "first.") | (F.col("pos") - F.col("first.pos") >= least_words)
    again = later | other("", "last.") | (F.col("last.pos") - F.col("pos") >= least_words)
    hits = windows.join(ends, "key").where(again).select("k1", "k2", "pos", later.alias("later"))

    def joined_up(batches):
        """Spans of neighbouring windows, as far as they arrive in order."""
        for b in batches:
            k1, k2, pos, cut = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            if not len(pos):
                continue
            ends_ = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]) | (pos[1:] != pos[:-1] + 1) | (cut[1:] != cut[:-1])
            a, z = np.flatnonzero(np.concatenate(([True], ends_))), np.flatnonzero(np.concatenate((ends_, [True])))
            out = [k1[a], k2[a], pos[a], pos[z] + least_words, np.where(cut[a], pos[a], 0), np.where(cut[a], pos[z] + least_words, 0)]
            yield pa.RecordBatch.from_arrays([pa.array(v).cast(x.type) for v, x in zip(out, span_arrow)], schema=span_arrow)

    each = order.mapInArrow(compare, spans).unionAll(hits.mapInArrow(joined_up, spans))
    dup = F.collect_set(F.struct(F.col("dup_from").alias("a"), F.col("dup_to").alias("b"))).alias("dup")
    cut = F.collect_set(F.when(F.col("cut_to") > 0, F.struct(F.col("cut_from").alias("a"), F.col("cut_to").alias("b")))).alias("cut")
    return rows.select("k1", "k2", "doc_id", "n_words"), each.groupBy("k1", "k2").agg(dup, cut)


def find_repeats(docs: DataFrame, k: int = 16, least_words: int = 50, reach: int = 16) -> DataFrame:
    """doc_id, n_words, n_dup_words, n_cut_words, dup_spans and cut_spans (from:to in words) of every row."""
    rows, spans = repeats(docs.select("doc_id", "text"), k, least_words, reach)

    def start():
        def f(doc_id, n_words, dup, cut):
            both = [[merged([(x["a"], x["b"]) for x in v or ()]) for v in col] for col in (dup, cut)]
            sums = [[sum(b - a for a, b in v) for v in col] for col in both]
            return [doc_id, n_words, *sums, *([",".join(f"{a}:{b}" for a, b in v) for v in col] for col in both)]

        return f

    joined = rows.join(spans, ["k1", "k2"], "left").select("doc_id", "n_words", "dup", "cut")
    return arrow_map(joined, start, "doc_id long, n_words long, n_dup_words long, n_cut_words long, dup_spans string, cut_spans string")


def cut_repeats(docs: DataFrame, k: int = 16, least_words: int = 50, reach: int = 16) -> DataFrame:
    """All rows in all their columns; later occurrences of repeated passages are cut from text, and n_chars follows.

    A text that has nothing to cut stays as it is, byte by byte.
    """
    _, spans = repeats(docs, k, least_words, reach)
    names = docs.columns
    schema = StructType.fromDDL("new string").add("row", _held(docs).schema["row"].dataType)
    arrow = to_arrow_schema(schema)

    def run(batches):
        for b in batches:
            text, cut = b.column(0).field("text").to_pylist(), b.column(1).to_pylist()
            new = [cut_words(t, merged([(x["a"], x["b"]) for x in c])) if t and c else t for t, c in zip(text, cut)]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()), b.column(0).cast(arrow.field("row").type)], schema=arrow)

    done = _held(docs).join(spans, ["k1", "k2"], "left").select("row", "cut").mapInArrow(run, schema)
    changed = ~F.col("new").eqNullSafe(F.col("row.text"))
    out = {"text": F.col("new")}
    if "n_chars" in names:
        out["n_chars"] = F.when(changed, F.length("new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return done.select(*(out.get(c, F.col("row")[c]).alias(c) for c in names))
