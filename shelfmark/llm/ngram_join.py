"""N-gram Jaccard join with token-group matrices: documents whose word-shingle sets overlap enough, as connected classes.

1. Each distinct set is one class (rows with equal sets are never compared). A class's bands, made of its MinHash values, name
   the buckets it falls into; two sets with Jaccard likeness J share a band of r values with probability J**r each.
2. In each bucket the smallest class leads. A class joins the groups of its buckets' leaders, so similar documents meet in few
   groups. Buckets over ``most_in_bucket`` classes (very many near copies) are dealt into chunks: each meets the bucket's first
   chunk, and then the classes that are still apart from the bucket's largest component meet every chunk, in blocks. So no group
   grows with the data, and no pair of a bucket is left out.
3. Each group's task partitions its members by a MinHash value into token groups and stores each one's token union (the
   token-group matrix). A query opens a token group only if its overlap with the union reaches what any member needs
   (``share`` of its own size); there, exact overlaps decide. Classes that are already connected are not compared again.
4. Links become components by repeated label exchange; a component is named by its smallest doc_id.

A link is lost only if a pair shares none of the bands: at the default 32 bands of 3 values, with probability 6e-14 for a pair
at 0.85 (1e-10 for 0.8). Inside a group nothing is estimated. Pairs are never emitted: each group gives each member one edge.

Words are runs without ASCII white space after lower-casing A-Z; a set holds the distinct n-word shingles, or the whole
sequence where there are fewer words. A text without words (null, empty) has an empty set, linked with nothing; such rows are
components of their own doc_id. Rows with equal sets are linked. Null doc_ids take part and are never the name of a component
that has another.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from shelfmark.llm.common import NO_ID, Remembered, arrow_map, keyed, once, texts, written

U = np.uint64


def _word_hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


class Shingles:
    """Sorted distinct 64-bit hashes of a text's shingles, and MinHash values of such sets."""

    def __init__(self, n: int, values: int):
        self.n = n
        self.word = Remembered(_word_hash)
        self.odd = np.random.default_rng(5).integers(1, 2**63, values, dtype=U) * U(2) + U(1)

    def of(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes lower-case A-Z alone
        if not words:
            return np.zeros(0, U)
        w = np.array(list(map(self.word.__getitem__, words)), U)
        n = min(self.n, len(w))
        with np.errstate(over="ignore"):
            h = np.full(len(w) - n + 1, n, U)
            for j in range(n):
                h = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9) + w[j : len(w) - n + 1 + j]
            h = (h ^ (h >> U(32))) * U(0x94D049BB133111EB)
        return np.unique(h ^ (h >> U(29)))

    def least(self, s: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            out = np.full(len(self.odd), np.iinfo(U).max, U)
            for i in range(0, len(s), 100_000):
                out = np.minimum(out, (self.odd[:, None] * s[None, i : i + 100_000]).min(axis=1))
        return out


def _fold(values: np.ndarray, band: int) -> int:
    return int.from_bytes(hashlib.blake2b(values.tobytes(), digest_size=8, salt=band.to_bytes(2, "little")).digest(), "little", signed=True)


class Union:
    """Disjoint sets by the smaller number."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        """Whether the two were apart."""
        i, j = sorted((self.find(i), self.find(j)))
        self.up[j] = i
        return i != j


def link_group(sets: list[np.ndarray], share: int, known: list | None = None) -> list[int]:
    """For each set the smallest index in its component, where sets link at 100 * intersection >= share * union.

    Sets with equal values in ``known`` are connected already.
    """
    n = len(sets)
    union = Union(n)
    apart = n
    first_of: dict = {}
    for i, x in enumerate(known or ()):
        if x is not None:
            apart -= union.join(first_of.setdefault(x, i), i)
    if apart < 2:
        return [union.find(i) for i in range(n)]
    sizes = np.array([len(s) for s in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ids = ids.astype(np.int32)
    ends = np.cumsum(sizes)
    own = [ids[e - k : e] for e, k in zip(ends, sizes)]
    # token groups: like sets share the value of one more MinHash function
    rank = (np.arange(ids.max() + 1, dtype=np.int64) * 2654435761) % 4294967291
    least = np.minimum.reduceat(rank[ids], ends - sizes)
    _, group = np.unique(least, return_inverse=True)
    order = np.lexsort((sizes, group))
    members = np.split(order, np.flatnonzero(np.diff(group[order])) + 1)
    # the matrix: each token group's union, end to end
    unions = [np.unique(np.concatenate([own[i] for i in g])) for g in members]
    cells = np.concatenate(unions)
    first = np.cumsum([0] + [len(u) for u in unions[:-1]])
    tokens = [np.concatenate([own[i] for i in g]) for g in members]
    starts = [np.cumsum([0] + [len(own[i]) for i in g[:-1]]) for g in members]
    smallest = np.array([sizes[g].min() for g in members])
    largest = np.array([sizes[g].max() for g in members])
    mask = np.zeros(len(rank), np.uint8)
    for q in range(n):
        if apart < 2:
            break
        k = int(sizes[q])
        need = -(-share * k // 100)
        mask[own[q]] = 1
        bound = np.add.reduceat(mask[cells], first, dtype=np.int64)
        for g in np.flatnonzero((bound >= need) & (100 * largest >= share * k) & (share * smallest <= 100 * k)):
            if len({union.find(int(i)) for i in members[g]} | {union.find(q)}) == 1:
                continue
            both = np.add.reduceat(mask[tokens[g]], starts[g], dtype=np.int64)
            for i in members[g][100 * both >= share * (k + sizes[members[g]] - both)]:
                apart -= union.join(q, int(i))
        mask[own[q]] = 0
    return [union.find(i) for i in range(n)]


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of the edges (a, b) reaches. Nodes are set keys.

    Every round, each node's neighbours and the node itself are tied to the smallest of them; labels fall to the component's
    smallest node after about log2 of its diameter rounds. Each round's edges are a table in the shared folder.
    """
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # ties to the smallest neighbour: of larger neighbours (large star), then of all (small star)
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("b").alias("b")), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        new = written(small)
        # a star forest, in which no centre is a leaf and no leaf has two centres, is the end
        leaves = new.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
        if leaves.where("n > 1").isEmpty() and new.join(leaves.select(F.col("b").alias("a")), "a", "left_semi").isEmpty():
            return new.select(F.col("b").alias("node"), F.col("a").alias("label"))
        edges = new


def join_components(docs: DataFrame, n: int = 4, share: int = 85, bands: int = 32, rows: int = 3, most_in_bucket: int = 2000) -> DataFrame:
    """doc_id, n_shingles, component_id and n_in_component of every row."""
    labelled = classes(docs, n, share, bands, rows, most_in_bucket)
    names = labelled.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n_in_component"))
    linked = labelled.where("n_shingles > 0").join(names, "label").select("doc_id", "n_shingles", "component_id", "n_in_component")
    alone = labelled.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("n_in_component"))
    return linked.unionAll(alone)


def classes(docs: DataFrame, n: int = 4, share: int = 85, bands: int = 32, rows: int = 3, most_in_bucket: int = 2000) -> DataFrame:
    """doc_id, k2 (hash of the text), n_shingles and label of every row; equal labels are one component."""
    values = bands * rows

    def start():
        sh = once(Shingles, n, values)

        def f(doc_id, text, k2):
            size, key, band = [], [], []
            for t in text:
                s = sh.of(t)
                size.append(len(s))
                key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                m = sh.least(s) if len(s) else None
                band.append([] if m is None else [_fold(m[i * rows : (i + 1) * rows], i) for i in range(bands)])
            return [doc_id, k2, size, key, band]

        return f

    base = texts(docs).withColumn("k2", F.xxhash64(F.coalesce("text", F.lit("\0"))))
    sets = written(arrow_map(base, start, "doc_id long, k2 long, n_shingles long, set_key binary, band array<long>"))
    met, wide = _buckets(sets, most_in_bucket)
    crowded = not wide.isEmpty()
    if crowded:
        wide = written(wide)
        met = met.unionAll(_with_first_chunk(wide))
    order = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("k1"), "k2")
    reps = sets.select("set_key", order.alias("o")).groupBy("set_key").agg(F.min("o").alias("o"))

    def members(groups: DataFrame) -> DataFrame:
        """Each class's text goes to its groups once; sets are made again there, which costs less than moving them."""
        at = reps.join(groups.groupBy("set_key").agg(F.collect_set("lead").alias("leads")), "set_key").select("set_key", "leads", "o.k1", "o.k2")
        return keyed(texts(docs)).join(at, ["k1", "k2"]).select("set_key", "text", F.explode("leads").alias("lead"))

    edges = _group_edges(members(met).withColumn("known", F.lit(None).cast("binary")), n, share, values)
    if crowded:
        edges = written(edges)
    labels = components(edges)
    if crowded:
        rest = written(_leftovers(wide, labels, most_in_bucket))
        if not rest.isEmpty():
            known = labels.select(F.col("node").alias("set_key"), F.col("label").alias("known"))
            labels = components(edges.unionAll(_group_edges(members(rest).join(known, "set_key", "left"), n, share, values)))
    return sets.select("doc_id", "k2", "n_shingles", "set_key").join(labels, F.col("set_key") == F.col("node"), "left").select("doc_id", "k2", "n_shingles", F.coalesce("label", "set_key").alias("label"))


def _buckets(sets: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(set_key, lead) of the classes in buckets of two to ``most`` classes; (set_key, at, chunk, chunks) of those in larger ones."""
    spots = sets.select("set_key", F.explode("band").alias("at"))
    shared = spots.groupBy("at").agg(F.min("set_key").alias("lead"), F.max("set_key").alias("last"), F.count(F.lit(1)).alias("n")).where("lead <> last").select("at", "lead", "n")
    met = written(spots.join(shared, "at").select("set_key", "lead", "at", (F.col("n") > most).alias("large")).distinct())
    # rows were counted so far; classes count
    large = met.where("large")
    sized = large.groupBy("at").agg(F.ceil(F.count(F.lit(1)) / most).alias("chunks"))
    large = large.join(sized, "at")
    plain = met.where("not large").select("set_key", "lead").unionAll(large.where("chunks = 1").select("set_key", "lead"))
    return plain.distinct(), large.where("chunks > 1").select("set_key", "at", F.pmod(F.xxhash64("set_key"), F.col("chunks")).alias("chunk"), "chunks")


def _group_name(*parts: str | Column) -> Column:
    return F.unhex(F.md5(F.concat_ws(":", *(F.col(p).cast("string") if isinstance(p, str) else p for p in parts)))).alias("lead")


def _with_first_chunk(wide: DataFrame) -> DataFrame:
    """(set_key, lead): each further chunk of a crowded bucket together with the bucket's first chunk."""
    to = F.when(F.col("chunk") == 0, F.sequence(F.lit(1).cast("long"), F.col("chunks") - 1)).otherwise(F.array("chunk"))
    return wide.select("set_key", "at", F.explode(to).alias("c")).select("set_key", _group_name("at", "c"))


def _leftovers(wide: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(set_key, lead): each chunk of a crowded bucket together with each block of its classes outside its largest component."""
    named = wide.join(labels, F.col("set_key") == F.col("node"), "left").select("set_key", "at", "chunk", "chunks", F.coalesce("label", "set_key").alias("label"))
    largest = named.groupBy("at", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("at").agg(F.max(F.struct("n", "label")).alias("x"), F.sum("n").alias("n"))
    blocks = largest.where(F.col("n") > F.col("x.n")).select("at", F.col("x.label").alias("main"), F.ceil((F.col("n") - F.col("x.n")) / most).alias("blocks"))
    open_ = named.join(blocks, "at")
    here = open_.select("set_key", "at", F.col("chunk").alias("c"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("b"))
    apart = open_.where(F.col("label") != F.col("main")).withColumn("b", F.pmod(F.xxhash64("set_key", F.lit(1)), F.col("blocks")))
    there = apart.select("set_key", "at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("c"), "b")
    return here.unionAll(there).select("set_key", _group_name("at", "c", F.concat(F.lit("b"), F.col("b").cast("string")))).distinct()


def _group_edges(members: DataFrame, n: int, share: int, values: int) -> DataFrame:
    """An edge (a, b) for each member that is linked to a smaller one of its group. Groups stream through sorted partitions."""
    schema = StructType.fromDDL("a binary, b binary")
    arrow = to_arrow_schema(schema)

    def run(batches):
        sh = once(Shingles, n, values)
        lead, keys, sets, known = None, [], [], []

        def close():
            if len(keys) < 2:
                return []
            return [(keys[j], keys[i]) for i, j in enumerate(link_group(sets, share, known)) if i != j]

        for b in batches:
            out = []
            for at, key, text, label in zip(*(c.to_pylist() for c in b.columns)):
                if at != lead:
                    out += close()
                    lead, keys, sets, known = at, [], [], []
                if keys and keys[-1] == key:
                    continue  # a repeated row
                keys.append(key)
                known.append(label)
                sets.append(sh.of(text))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.binary()) for i in (0, 1)], schema=arrow)
        out = close()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.binary()) for i in (0, 1)], schema=arrow)

    return members.select("lead", "set_key", "text", "known").repartition("lead").sortWithinPartitions("lead", "set_key").mapInArrow(run, schema)


def drop_copies(docs: DataFrame, n: int = 5, share: int = 80, bands: int = 32, **tuning) -> DataFrame:
    """The rows, in all their columns, that come first in their component: by doc_id (null last), then by text.

    Of repeated rows one stays. Rows without words stay, each distinct doc_id and text once.
    """
    labelled = classes(docs, n, share, bands, **tuning)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("k2"))
    keep = labelled.where("n_shingles > 0").groupBy("label").agg(F.min(order).alias("o")).select(F.coalesce("o.doc_id", F.lit(NO_ID)).alias("k1"), F.col("o.k2").alias("k2"))
    keep = keep.unionAll(labelled.where("n_shingles = 0").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("k1"), "k2").distinct())
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k1"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("\0"))).alias("k2"))
    found = held.join(keep, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    return found.select(*(F.col("row")[c].alias(c) for c in docs.columns))
