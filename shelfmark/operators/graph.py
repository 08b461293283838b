"""Trees and pair tables: closures, context, roll-ups, components, symmetric pairs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only in local mode, where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="shelfmark-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """A table in the cluster's shared folder, which cuts the lineage of loops."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, n: int, *keys: str, most: int = 250_000) -> DataFrame:
    """The rows dealt out by keys into parts of about ``most`` of n rows, so that a task's share doesn't grow with the table."""
    return df.repartition(max(1, -(-n // most)), *keys)


def closure(edges: DataFrame, most_depth: int = 64) -> DataFrame:
    """(ancestor, descendant, depth) of a forest given as (id, parent_id); every node is its own at depth 0.

    Paths double in each round, so depth d takes about log2(d) joins; each round's new pairs are a table of their own, and older
    ones are not written again. A cycle, or a path longer than most_depth, is an error.
    """
    start = edges.select(F.col("id").alias("ancestor"), F.col("id").alias("descendant"), F.lit(0).alias("depth"))
    pairs = kept(edges.where("parent_id is not null").select(F.col("parent_id").alias("ancestor"), F.col("id").alias("descendant"), F.lit(1).alias("depth")))
    reach = 1
    while True:
        left = pairs.where(f"depth = {reach}").select("ancestor", F.col("descendant").alias("mid"), F.col("depth").alias("d1"))
        right = pairs.select(F.col("ancestor").alias("mid"), "descendant", F.col("depth").alias("d2"))
        new = kept(left.join(right, "mid").select("ancestor", "descendant", (F.col("d1") + F.col("d2")).alias("depth")))
        if new.isEmpty():
            return start.unionAll(pairs)
        if reach >= most_depth:
            raise ValueError(f"a cycle, or a path of more than {most_depth} steps")
        pairs = pairs.unionAll(new)
        reach *= 2


def rolled_up(edges: DataFrame, own: DataFrame, count: str, most_depth: int = 64) -> DataFrame:
    """(id, own, total) of every node of a forest (id, parent_id): sums are pushed up level by level.

    A round moves one sum for each node that still has something to pass on, and merges them at the parents.
    """
    up = edges.where("parent_id is not null").select("id", "parent_id")
    sums = [own.select("id", F.col(count).alias("n"))]
    for _ in range(most_depth + 1):
        moved = kept(sums[-1].join(up, "id").groupBy(F.col("parent_id").alias("id")).agg(F.sum("n").alias("n")))
        if moved.isEmpty():
            break
        sums.append(moved)
    else:
        raise ValueError(f"a cycle, or a path of more than {most_depth} steps")
    every = sums[0]
    for x in sums[1:]:
        every = every.unionAll(x)
    total = every.groupBy("id").agg(F.sum("n").alias("total"))
    return edges.select("id").join(own.select("id", F.col(count).alias("own")), "id", "left").join(total, "id", "left").select("id", F.coalesce("own", F.lit(0)).alias("own"), F.coalesce("total", F.lit(0)).alias("total"))


def context(edges: DataFrame, kinds: list[str], most_depth: int = 64) -> DataFrame:
    """id and, for each kind, the nearest node of that kind at or above it in a forest (id, parent_id, kind), carried down level by level."""
    mine = lambda above: [F.coalesce(F.when(F.col("kind") == k, F.col("id")), above(k)).alias(k) for k in kinds]
    levels = [kept(edges.where("parent_id is null").select("id", *mine(lambda k: F.lit(None).cast("string"))))]
    for _ in range(most_depth + 1):
        last = levels[-1].select(F.col("id").alias("parent_id"), *(F.col(k).alias(f"above_{k}") for k in kinds))
        below = kept(edges.join(last, "parent_id").select("id", *mine(lambda k: F.col(f"above_{k}"))))
        if below.isEmpty():
            break
        levels.append(below)
    else:
        raise ValueError(f"a cycle, or a path of more than {most_depth} steps")
    out = levels[0]
    for x in levels[1:]:
        out = out.unionAll(x)
    return out


def both_ways(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Each pair in both directions: joins on it stay equi-joins."""
    turned = pairs.withColumns({a: F.col(b), b: F.col(a)})
    return pairs.unionByName(turned)


def components(pairs: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of the pairs (a, b) reaches, by large-star and small-star rounds."""
    edges = kept(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        both = both_ways(edges)
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        tied = large.join(down, "b").select("a", "b", "m")
        new = kept(tied.select(F.col("m").alias("a"), "b").unionAll(tied.select(F.col("m").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
        leaves = new.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
        if leaves.where("n > 1").isEmpty() and new.join(leaves.select(F.col("b").alias("a")), "a", "left_semi").isEmpty():
            centres = new.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct()
            return centres.unionAll(new.select(F.col("b").alias("node"), F.col("a").alias("label")))
        edges = new


def chains(rows: DataFrame, most_depth: int = 64) -> DataFrame:
    """(id, oldest, depth, replaced_by) of versions (id, replaces): the first version of each one's chain, how many versions stand
    before it, and the least of those that replace it.

    Each pointer is joined with the pointers of where it leads, so it reaches twice as far in each round. A pointer to a version that
    isn't there ends the chain. Two versions may replace the same one; of repeated ids the least pointer counts. A cycle, or a chain of more than most_depth versions
    before one, is an error.
    """
    rows = kept(rows.groupBy("id").agg(F.min("replaces").alias("replaces")))
    there = rows.select(F.col("id").alias("replaces"))
    links = rows.select("id", "replaces").where("replaces is not null").join(there, "replaces", "left_semi")
    at = kept(rows.select("id").join(links, "id", "left").select("id", F.coalesce("replaces", "id").alias("to"), F.col("replaces").isNotNull().cast("int").alias("depth")))
    reach = 1
    while True:
        on = at.where("depth > 0").select(F.col("id").alias("to"), F.col("to").alias("further"), F.col("depth").alias("more"))
        moved = at.join(on, "to", "left")
        if moved.where("more is not null").isEmpty():
            break
        if reach > most_depth:
            raise ValueError(f"a cycle, or a chain of more than {most_depth} versions")
        at = kept(moved.select("id", F.coalesce("further", "to").alias("to"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))
        reach *= 2
    if not at.where(F.col("depth") > most_depth).isEmpty():
        raise ValueError(f"a chain of more than {most_depth} versions")
    next_ = links.groupBy(F.col("replaces").alias("id")).agg(F.min("id").alias("replaced_by"))
    return at.select("id", F.col("to").alias("oldest"), "depth").join(next_, "id", "left")


def full_paths(nodes: DataFrame, separator: str = " / ", most_depth: int = 64) -> DataFrame:
    """(id, path) of a forest (id, parent_id, name): the names from the top down to each node, carried down level by level.

    A node whose parent isn't there has no path; a name that is null counts as empty.
    """
    named = nodes.select("id", "parent_id", F.coalesce("name", F.lit("")).alias("name"))
    levels = [kept(named.where("parent_id is null").select("id", F.col("name").alias("path")))]
    for _ in range(most_depth + 1):
        last = levels[-1].select(F.col("id").alias("parent_id"), F.col("path").alias("above"))
        below = kept(named.join(last, "parent_id").select("id", F.concat("above", F.lit(separator), "name").alias("path")))
        if below.isEmpty():
            break
        levels.append(below)
    else:
        raise ValueError(f"a cycle, or a path of more than {most_depth} steps")
    out = levels[0]
    for x in levels[1:]:
        out = out.unionAll(x)
    return out
