"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are lower-cased words and their first five letters (stems differ in their endings); a run of over ``LONGEST``
characters, as in scripts without spaces, gives its overlapping triples of characters instead. All terms of a bounded sample of
labelled rows outside the held-out fold are kept, and every one of these rows is an example. A term's weight in a text is
(1 + log of its count) x idf x lift, where lift is 1 for a term that stands alike in examples of both labels and grows with the
chi-square of its standing more in examples of label 1: so a long text is near to the examples that share its telling words.

The examples become unit vectors; equal vectors are one entry with its labels. The index holds the entries in blocks, and for
each term its largest weight in each block: a query adds these up to a bound for each block, opens the blocks of the highest
bounds, and then those whose bound reaches the k-th best cosine found there. So results are exact. The k nearest entries (the
smaller one first on ties) vote with weights that fall with distance; isotonic regression on the examples' own leave-one-out
votes turns votes into probabilities. Evidence lists the nearest examples.

An example is a distinct pair of doc_id and text, however often its rows or its labels are repeated; a doc_id with both labels
counts as label 1, and different texts under one labelled doc_id are examples each. A text without a known term (an empty or null
one too) gets the share of label 1 among the examples without terms, drawn towards the share among all. Without any labelled
example every score is 0.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import Remembered, arrow_map, crc_fold, once, written

_LETTERS = bytes(i if i >= 0x80 or 97 <= i <= 122 else 32 for i in range(256))
LONGEST = 64
BLOCK = 64
#: Terms under this chi-square have no lift: so many does chance give the rarest of many terms.
LEAST_CHI2 = 16.0


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split()


def terms_of(word: bytes) -> list[str]:
    w = word.decode("utf-8", "replace")
    if len(w) > LONGEST:
        return [f"~{w[i : i + 3]}" for i in range(len(w) - 2)]
    return [w, f"{w[:5]}*"] if len(w) > 5 else [w]


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first[i], ..., first[i] + size[i] - 1 of all i, end to end."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + size, size)


def blocks_of_like(vectors: list[tuple[tuple, tuple]], size: int, rounds: int = 8) -> list[int]:
    """An order of the vectors (terms, weights) in which like ones share blocks: halves along the main direction, again and again."""
    rng, out = np.random.default_rng(11), []
    todo = [list(range(len(vectors)))]
    while todo:
        some = todo.pop()
        if len(some) <= size:
            out += some
            continue
        _, term = np.unique(np.concatenate([vectors[i][0] for i in some]), return_inverse=True)
        weight = np.concatenate([vectors[i][1] for i in some])
        at = np.repeat(np.arange(len(some)), [len(vectors[i][0]) for i in some])
        x = rng.normal(size=len(some))
        for _ in range(rounds):
            x -= x.mean()
            x = np.bincount(at, weight * np.bincount(term, weight * x[at])[term], len(some))
            x /= np.linalg.norm(x) or 1.0
        order = [some[i] for i in np.argsort(x, kind="stable")]
        half = -(-len(some) // size) // 2 * size
        todo += [order[half:], order[:half]]
    return out


class BlockMaxIndex:
    """Sparse unit vectors (dicts term -> weight; terms are numbers from 0 on) in blocks of ``size`` entries."""

    def __init__(self, vectors: list[dict[int, float]], n_terms: int, size: int = BLOCK, opened: int = 4):
        self.n, self.opened, self.blocks = len(vectors), opened, -(-len(vectors) // size)
        term = np.array([t for v in vectors for t in v], np.int64)
        at = np.repeat(np.arange(self.n), [len(v) for v in vectors])
        weight = np.array([w for v in vectors for w in v.values()])
        order = np.lexsort((at, term))
        self.at, self.weight, term = at[order], weight[order], term[order]
        # cells: a term's postings in one block
        block = self.at // size
        starts = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])]) if len(term) else np.zeros(0, np.int64)
        self.start, self.size = starts, np.diff(np.append(starts, len(term)))
        self.block, self.most = block[starts], np.maximum.reduceat(self.weight, starts) if len(term) else np.zeros(0)
        self.first = np.searchsorted(term[starts], np.arange(n_terms + 1))  # a term's cells

    def nearest(self, terms: np.ndarray, q: np.ndarray, k: int, without: int = -1) -> list[tuple[float, int]]:
        """The k largest positive cosines of a query (its terms and their weights) with their entries, the smaller entry first on ties."""
        if not self.blocks:
            return []
        sizes = self.first[terms + 1] - self.first[terms]
        cells, q = _ranges(self.first[terms], sizes), np.repeat(q, sizes)
        block = self.block[cells]
        bound = np.bincount(block, q * self.most[cells], self.blocks)
        order = np.argsort(-bound, kind="stable")
        best, open_, rest = np.zeros((2, 0)), order[: self.opened], order[self.opened :]
        while len(open_):
            mask = np.zeros(self.blocks, bool)
            mask[open_] = True
            here = np.flatnonzero(mask[block])
            own = cells[here]
            size = self.size[own]
            places = _ranges(self.start[own], size)
            score = np.bincount(self.at[places], np.repeat(q[here], size) * self.weight[places], self.n)
            if without >= 0:
                score[without] = 0
            if len(score) > 4 * k:
                score[score < np.partition(score, -2 * k)[-2 * k] - 1e-9] = 0
            entries = np.flatnonzero(score)
            both = np.concatenate([best, np.stack([-np.round(score[entries], 12), entries])], axis=1)
            best = both[:, np.lexsort((both[1], both[0]))[:k]]
            least = -best[0, k - 1] - 1e-9 if best.shape[1] == k else 0.0
            # all blocks that may hold a better one
            open_, rest = rest[(bound[rest] >= least) & (bound[rest] > 0)], rest[:0]
        return [(-float(s), int(i)) for s, i in best.T]


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pools adjacent violators; returns points for np.interp."""
    pools: list[list[float]] = []  # mean, weight, smallest and largest x
    for i in np.lexsort((y, x)):
        pools.append([float(y[i]), float(weight[i]), float(x[i]), float(x[i])])
        while len(pools) > 1 and (pools[-2][0] >= pools[-1][0] or pools[-2][3] == pools[-1][2]):
            m, w, _, hi = pools.pop()
            p = pools[-1]
            pools[-1] = [(p[0] * p[1] + m * w) / (p[1] + w), p[1] + w, p[2], hi]
    return np.array([v for p in pools for v in p[2:]]), np.array([(p[0] * p[1] + 0.5 * 1.0) / (p[1] + 1.0) for p in pools for _ in (0, 1)])


class ToxicityModel:
    def __init__(self, examples: list[tuple[int | None, int, dict[str, int]]], k: int = 15, lift: float = 0.5):
        """examples: (doc_id, label, counts of terms)."""
        self.k = k
        n, p = len(examples), sum(x[1] for x in examples)
        base = (p + 0.5) / (n + 1) if n else 0.0
        bare = [label for _, label, counts in examples if not counts]
        self.bare = (sum(bare) + base) / (len(bare) + 1)
        seen, up = Counter(t for _, _, counts in examples for t in counts), Counter(t for _, label, counts in examples if label for t in counts)
        self.number = {t: i for i, t in enumerate(sorted(seen))}
        both, a = np.array([seen[t] for t in self.number], float), np.array([up[t] for t in self.number], float)
        b, c, d = both - a, p - a, n - p - both + a
        with np.errstate(divide="ignore", invalid="ignore"):
            chi2 = np.nan_to_num(n * (a * d - b * c) ** 2 / (both * (c + d) * p * (n - p)))
        self.weight = np.log(1 + n / np.maximum(both, 1)) * (1 + lift * np.maximum(0, np.where(a * d > b * c, chi2, 0) - LEAST_CHI2))
        entries: dict[tuple, list] = {}
        for doc_id, label, counts in examples:
            if counts:
                terms = np.array([self.number[t] for t in counts])
                by = np.argsort(terms)
                terms, q = self.vector(terms[by], np.array(list(counts.values()))[by])
                entries.setdefault((tuple(terms.tolist()), tuple(np.round(q, 9).tolist())), []).append((label, doc_id))
        order = sorted(entries)
        order = [order[i] for i in blocks_of_like(order, BLOCK)]
        self.labels = [sorted(entries[e], key=str) for e in order]
        self.positive = np.array([sum(x[0] for x in ls) for ls in self.labels], float)
        self.total = np.array([len(ls) for ls in self.labels], float)
        self.index = BlockMaxIndex([dict(zip(*e)) for e in order], len(self.number))
        raw, y, w = [self.bare], [self.bare], [float(max(1, len(bare)))]
        for i, e in enumerate(order):
            for label in (0, 1):
                if m := sum(x[0] == label for x in self.labels[i]):
                    raw.append(self.vote(np.array(e[0]), np.array(e[1]), (i, label))[0])
                    y.append(float(label))
                    w.append(float(m))
        self.points = isotonic(np.array(raw), np.array(y), np.array(w))
        self.open()

    def open(self) -> None:
        number = self.number
        self.terms = Remembered(lambda word: tuple(number[t] for t in terms_of(word) if t in number), 100_000)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "terms"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.open()

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(counts)) * self.weight[terms]
        return terms, w / np.sqrt(w @ w)

    def vote(self, terms: np.ndarray, q: np.ndarray, own: tuple[int, int] | None = None) -> tuple[float, list[tuple[float, int]]]:
        """The share of label 1 among the nearest, one example of the query's own entry left out."""
        alone = own is not None and self.total[own[0]] == 1
        found = self.index.nearest(terms, q, self.k, own[0] if alone else -1)
        up, all_ = self.bare, 1.0
        for cosine, i in found:
            weight = 1 / (1.05 - min(1.0, cosine))
            left = 1.0 if own and own[0] == i else 0.0
            up += weight * (self.positive[i] - left * (own[1] if own else 0)) / (self.total[i] - left)
            all_ += weight
        return float(up / all_), found

    def score(self, text: str) -> tuple[float, str]:
        terms = [t for w in words_of(text) for t in self.terms[w]]
        if not terms:
            return self.bare, ""
        raw, found = self.vote(*self.vector(*np.unique(np.array(terms), return_counts=True)))
        shown = [f"{doc_id}:{label}:{cosine:.3f}" for cosine, i in found[:3] for label, doc_id in self.labels[i][:1]]
        return float(np.interp(raw, *self.points)), ",".join(shown)


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 2000, **model) -> ToxicityModel:
    """Learns from at most most_rows labelled rows outside the held-out fold, chosen by a hash of the id and the text."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (crc_fold(F.col("doc_id")) != 2))
    some = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)  # at most most_rows rows
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(some), "doc_id").withColumn("h", F.xxhash64("text"))

    def start():
        once.cache_clear()  # what an earlier stage's tasks left in this worker goes
        known = Remembered(terms_of)

        def f(doc_id, toxic, h, text):
            counted = [Counter(t for w in words_of(x) for t in known[w]) for x in text]
            return [doc_id, toxic, h, [list(c) for c in counted], [list(c.values()) for c in counted]]

        return f

    counted = written(arrow_map(rows.select("doc_id", "toxic", "h", "text"), start, "doc_id long, toxic int, h long, terms array<string>, counts array<int>"))
    # one doc_id may have very many texts
    keys = counted.select("doc_id", "h").distinct().orderBy(F.xxhash64("doc_id", "h"), "doc_id", "h").limit(most_rows)
    found = counted.join(F.broadcast(keys), ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]).collect()  # at most most_rows
    return ToxicityModel([(r["doc_id"], r["toxic"], dict(zip(r["terms"], r["counts"]))) for r in sorted(found, key=lambda r: (r["doc_id"], r["h"]))], **model)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **training) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **training))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_fold(F.col("doc_id")) == 2).alias("held_out"), F.col("text").cast("string").alias("text"))
    return arrow_map(rows, lambda: _scorer(shared.value, threshold), "doc_id long, held_out boolean, score double, predicted int, evidence string")


def _scorer(model: ToxicityModel, threshold: float):
    def f(doc_id, held_out, text):
        found = [model.score(t or "") for t in text]
        return [doc_id, held_out, [x[0] for x in found], [int(x[0] >= threshold) for x in found], [x[1] for x in found]]

    return f


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **training) -> DataFrame:
    """The rows, in all their columns, that are not predicted toxic."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **training))
    arrow_names = docs.columns

    def run(batches):
        import pyarrow as pa

        once.cache_clear()
        own = model.value
        for b in batches:
            text = b.column(arrow_names.index("text")).to_pylist()
            yield b.filter(pa.array([own.score(t or "")[0] < threshold for t in text], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
