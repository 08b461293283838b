"""Spelling variants: words that differ by one edit, found by generating each word's full neighbourhood.

Every distinct deletion, replacement and insertion of a word over the observed alphabet is generated and looked up among the
vocabulary's words; a generated string that is a word is near by construction, so no distance is computed. Candidates outnumber
words a thousand times, so words are moved to where their candidates can be, rather than candidates to words: with k half the
least length, an edit at place k or later leaves the first k code points, an earlier one the last k. So each word goes to the group
of its first and to that of its last k code points, and generates there only the edits of that side; each candidate arises
once. A group of over ``most_in_group`` words is dealt into blocks by a hash: a block holds a part of the words, and all of the
group's words look up their candidates in each block.

Candidates are found by a 64-bit hash that an edit changes in constant time, and compared in full where hashes are equal.

A word's form is its near word of largest count, if that is at least ``times`` its own; forms are followed to the last by pointer
doubling. Counts grow with each step, so there are no cycles.

Null texts have no words; a null doc_id counts as empty text. Repeated rows count each time. Runs of any length are words; empty
tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from shelfmark.llm.common import written

U = np.uint64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BASE = 0x9E3779B97F4A7C15 | 1
BACK = pow(BASE, -1, 2**64)


def _values(codes: np.ndarray) -> np.ndarray:
    """A 64-bit value for each code point."""
    with np.errstate(over="ignore"):
        x = (codes.astype(U) + U(1)) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(29))) * U(0x94D049BB133111EB)
        x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
        return x ^ (x >> U(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def by_length(words: list[str]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length, the words' places and their code points as a matrix."""
    lengths = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    starts = np.cumsum(lengths) - lengths
    out = {}
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        out[n] = at, codes[starts[at][:, None] + np.arange(n)]
    return out


class Vocabulary:
    """Words that candidates are looked up in."""

    def __init__(self, words: list[str]):
        self.sizes = by_length(words)
        self.alphabet = {n: np.unique(codes) for n, (_, codes) in self.sizes.items()}
        hashes = np.zeros(len(words), U)
        self.length, self.row = np.zeros((2, len(words)), np.int64)  # of a word, and its row in its length's matrix
        for n, (at, codes) in self.sizes.items():
            with np.errstate(over="ignore"):
                hashes[at] = (_values(codes) * _powers(BASE, n)).sum(axis=1, dtype=U)
            self.length[at], self.row[at] = n, np.arange(len(at))
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.most_equal = int(np.unique(self.hashes, return_counts=True)[1].max(initial=0))
        bits = max(12, (16 * len(words)).bit_length())
        self.shift = U(64 - bits)
        self.there = np.zeros(1 << bits, bool)
        self.there[self.hashes >> self.shift] = True

    def find(self, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of candidates, and the words of equal hashes."""
        at = np.flatnonzero(self.there[candidates >> self.shift])
        wanted = candidates[at]
        first = np.searchsorted(self.hashes, wanted)
        found = []
        for more in range(self.most_equal):  # one, unless hashes collide
            i = np.minimum(first + more, len(self.hashes) - 1)
            hit = np.flatnonzero((self.hashes[i] == wanted) & (first + more < len(self.hashes)))
            found.append((at[hit], self.order[i[hit]]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])

    def near(self, words: list[str], first: int, end: int | None, at_once: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (place in words, place in this vocabulary) that one edit at a place from ``first`` up to ``end`` makes equal."""
        for n, (at, codes) in by_length(words).items():
            letters = max((len(self.alphabet[m]) for m in (n, n + 1) if m in self.alphabet), default=1)
            step = max(1, at_once // (letters * min(n + 1, 4096)))
            for a in range(0, len(at), step):
                for i, j in self._near(codes[a : a + step], n, first, n + 1 if end is None else min(end, n + 1), max(1, at_once // letters)):
                    yield at[a : a + step][i], j

    def _near(self, codes: np.ndarray, n: int, first: int, end: int, at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        m = len(codes)
        power, base, back = _powers(BASE, n + 2), U(BASE), U(BACK)
        with np.errstate(over="ignore"):
            terms = _values(codes) * power[:n]
            before = np.zeros((m, n + 1), U)
            np.cumsum(terms, axis=1, out=before[:, 1:])
            whole = before[:, -1:]
            span = max(1, at_once // m)
            for a in range(first, end, span):
                b = min(a + span, end)
                last = min(b, n)  # a replacement or deletion has a letter
                if n - 1 in self.sizes and a < last:
                    yield from self._checked(codes, before[:, a:last] + (whole - before[:, a + 1 : last + 1]) * back, None, a, n - 1)
                if n in self.sizes and a < last:
                    letters = self.alphabet[n]
                    yield from self._checked(codes, (whole - terms[:, a:last])[:, :, None] + _values(letters) * power[a:last, None], letters, a, n)
                if n + 1 in self.sizes:
                    letters, head = self.alphabet[n + 1], before[:, a:b]
                    yield from self._checked(codes, (head + (whole - head) * base)[:, :, None] + _values(letters) * power[a:b, None], letters, a, n + 1)

    def _checked(self, codes: np.ndarray, candidates: np.ndarray, letters: np.ndarray | None, a: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The candidates that are words: each distinct one once (an edit within equal letters counts at its first place), compared in full."""
        n = codes.shape[1]
        at, word = self.find(candidates.ravel())
        if not len(at):
            return
        if letters is None:
            row, place = np.divmod(at, candidates.shape[1])
            letter = None
        else:
            row, place = np.divmod(at, candidates.shape[1] * len(letters))
            place, letter = np.divmod(place, len(letters))
            letter = letters[letter]
        place = place + a
        previous = codes[row, np.maximum(place - 1, 0)]
        if size == n:
            keep = codes[row, place] != letter
        else:
            keep = (place == 0) | (previous != (codes[row, place] if letter is None else letter))
        keep &= self.length[word] == size  # another length has an equal hash by chance alone
        row, place, word = row[keep], place[keep], word[keep]
        letter = None if letter is None else letter[keep]
        step = max(1, (1 << 22) // (size + 1))
        for k in range(0, len(row), step):
            r, p, w = row[k : k + step], place[k : k + step, None], word[k : k + step]
            i = np.arange(size)
            source = i + (i >= p) if size < n else i - (i > p) if size > n else np.broadcast_to(i, (len(r), size))
            made = codes[r[:, None], np.clip(source, 0, n - 1)]
            if letter is not None:
                np.put_along_axis(made, p, letter[k : k + step, None], axis=1)
            held = self.sizes[size][1][self.row[w]]
            equal = (made == held).all(axis=1)
            yield r[equal], w[equal]


def vocabulary(docs: DataFrame, least: int, least_n: int, every: int, pattern: str) -> DataFrame:
    """word and n: runs of the pattern's letters, lower-cased, some of them misspelt by rule; those of at least ``least`` code points and ``least_n`` occurrences."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.col("text").cast("string").alias("text"))
    # a run only gets shorter, so short ones can be left out here
    run = F.explode(F.regexp_extract_all("text", F.lit(f"{pattern}{{{least},}}"), F.lit(0)))
    runs = rows.select("doc_id", run.alias("run")).select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    runs = runs.select("run", F.crc32(F.concat_ws(":", "doc_id", "run").cast("binary")).alias("h"))
    words = runs.select(F.when(F.col("h") % every == 0, without(F.col("run"), F.col("h") % F.length("run"))).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_n)


def without(run: Column, place: Column) -> Column:
    """A text without the code point at a place counted from 0."""
    return F.concat(F.substr(run, F.lit(1), place.cast("int")), F.substr(run, place.cast("int") + 2))


def nearest(words: DataFrame, least: int, most_in_group: int = 50_000, words_in_task: int = 50_000) -> DataFrame:
    """word, n_near, near and near_n of the words (word, n; at least ``least`` code points each) that have near words.

    near is the one of largest n (ties: the smallest in code-point order).
    """
    spark, k = words.sparkSession, least // 2
    if k < 1:
        raise ValueError("words need two code points")
    ends = F.array(F.struct(F.lit(0).alias("side"), F.left("word", F.lit(k)).alias("key")), F.struct(F.lit(1).alias("side"), F.right("word", F.lit(k)).alias("key")))
    sides = words.select("word", "n", F.explode(ends).alias("end")).select("word", "n", "end.side", "end.key")
    large = written(sides.groupBy("side", "key").agg(F.count(F.lit(1)).alias("n_in")).where(F.col("n_in") > most_in_group))
    few = large.count() <= 10_000
    sides = sides.join(F.broadcast(large) if few else large, ["side", "key"], "left")
    blocks = F.coalesce(F.ceil(F.col("n_in") / most_in_group), F.lit(1)).cast("int")
    sides = sides.select("word", "n", "side", "key", F.pmod(F.xxhash64("word"), blocks).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    tasks = max(spark.sparkContext.defaultParallelism, 2 * words.count() // words_in_task)
    dealt = sides.repartition(tasks, "side", "key", "block").select("word", "n", "side", "block", (F.col("own") == F.col("block")).alias("held"))
    schema = StructType.fromDDL("word string, n_near long, near_n long, near string")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = list(batches)
        if not every:
            return
        every = pa.Table.from_batches(every)
        # groups can be looked up together, as their candidates differ; blocks of one group can't
        for side, block in sorted({(r["side"], r["block"]) for r in every.select(["side", "block"]).group_by(["side", "block"]).aggregate([]).to_pylist()}):
            first, end = ((k, None), (0, k))[side]
            part = every.filter(pc.and_(pc.equal(every["side"], side), pc.equal(every["block"], block)))
            held = part.filter(part["held"])
            if not held.num_rows:
                continue
            there = Vocabulary(own := held["word"].to_pylist())
            n = held["n"].to_numpy()
            ranked = np.array(sorted(range(len(own)), key=lambda i: (-n[i], own[i])))
            rank = np.empty(len(own), np.int64)
            rank[ranked] = np.arange(len(own))
            asked = part["word"].to_pylist()
            count, best = np.zeros(len(asked), np.int64), np.full(len(asked), len(own), np.int64)
            for i, j in there.near(asked, first, end):
                np.add.at(count, i, 1)
                np.minimum.at(best, i, rank[j])
            some = np.flatnonzero(count)
            for a in range(0, len(some), 10_000):
                i = some[a : a + 10_000]
                j = ranked[best[i]]
                out = [[asked[x] for x in i], count[i], n[j], [own[x] for x in j]]
                yield pa.RecordBatch.from_arrays([pa.array(v, x.type) for v, x in zip(out, arrow, strict=True)], schema=arrow)

    found = dealt.mapInArrow(run, schema)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.near").alias("near"), (-F.col("b.less")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root of (word, form): forms followed to the last, twice as far in each round."""
    at = written(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open")))
    while not at.where("open").isEmpty():
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"), F.col("open").alias("still"))
        at = written(at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.coalesce("still", F.lit(False)).alias("open")))
    return at.select("word", "root")


def variants(docs: DataFrame, least: int = 7, least_n: int = 2, every: int = 31, times: int = 10, pattern: str = "[A-Za-zÀ-ÿ]", **how) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the texts."""
    words = written(vocabulary(docs, least, least_n, every, pattern))
    formed = F.col("near_n") >= times * F.col("n")
    found = words.join(nearest(words, least, **how), "word", "left")
    found = written(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("near")).alias("form"), F.when(formed, F.col("near_n")).alias("form_n")))
    last = roots(found.where(F.col("form").isNotNull()))
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
