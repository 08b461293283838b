"""Order-dependent resolution: guarded merging, greedy one-to-one assignment, merging of orders.

Each result is defined by a sequence of steps in a strict order. Small groups (of at most ``most_in_task`` pairs) stream through
partitions that are sorted by group and order. Of larger groups, assignment is found in rounds over all pairs at once, and merging
by connected components of the edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from shelfmark.operators.graph import components, dealt, kept


def _by_size(rows: DataFrame, by: str, most: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of small groups, and those of large ones (none if there are no large groups), as written tables."""
    rows = kept(rows)
    large = kept(rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(by))
    if large.isEmpty():
        return rows, None
    few = F.broadcast(large) if large.count() <= 10_000 else large
    return rows.join(few, by, "left_anti"), rows.join(few, by, "left_semi")


def _united(edges: DataFrame, by: list[str], deal: list[str]) -> DataFrame:
    """Unites along sorted edges, all of one value of ``deal`` in one task; the state is one group's nodes and their guards."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, up, held = None, {}, {}

        def find(n: int) -> int:
            while up[n] != n:
                up[n] = n = up[up[n]]
            return n

        def close() -> list[tuple]:
            return [(group[0], n, find(n)) for n in sorted(up)]

        for pdf in parts:
            out = []
            for g, a, ga, b, gb in zip(zip(*(pdf[c] for c in (by[0], *deal))), pdf["node"], pdf["guard"], pdf["other"], pdf["other_guard"]):
                if g != group:
                    out += close() if group else []
                    group, up, held = g, {}, {}
                for n, guards in ((a, ga), (b, gb)):
                    if n not in up:
                        up[n], held[n] = n, set(guards)
                x, y = sorted((find(a), find(b)))
                if x != y and not held[x] & held[y]:
                    up[y] = x
                    less, more = sorted((held[x], held.pop(y)), key=len)
                    more |= less
                    held[x] = more
            yield pd.DataFrame(out, columns=[by[0], "node", "label"])
        yield pd.DataFrame(close() if group else [], columns=[by[0], "node", "label"])

    rows = edges.select(by[0], *(c for c in deal if c != by[0]), "node", "guard", "other", "other_guard", "rank")
    return rows.repartition(*deal).sortWithinPartitions(*deal, "rank", "node", "other").mapInPandas(run, f"{by[0]} long, node long, label long")


def guarded_groups(edges: DataFrame, by: str, most_in_task: int = 200_000) -> DataFrame:
    """Unites the ends of edges (node, guard, other, other_guard) in order of rank, then of nodes, unless both groups hold an
    equal guard. Returns (by, node, label): the least node of each group. A node has one guard, or an array of them.

    Components of the edges don't touch each other, so those of a large group are dealt out by themselves. A component whose
    nodes all have guards of their own is one group, and needs no order; only others are followed edge by edge, one component in
    one task.
    """
    if not isinstance(edges.schema["guard"].dataType, ArrayType):
        edges = edges.withColumns({"guard": F.array("guard"), "other_guard": F.array("other_guard")})
    small, large = _by_size(edges, by, most_in_task)
    out = _united(small, [by], [by])
    if large is None:
        return out
    ends = large.select(by, "node", "guard").unionAll(large.select(by, F.col("other").alias("node"), F.col("other_guard").alias("guard"))).distinct()
    tied = components(large.select(F.struct(by, "node").alias("a"), F.struct(by, F.col("other").alias("node")).alias("b")))
    part = kept(tied.select(F.col(f"node.{by}").alias(by), F.col("node.node").alias("node"), F.col("label.node").alias("part")))
    each = ends.join(part, [by, "node"]).select(by, "part", F.explode_outer("guard").alias("guard"), (F.size("guard") > 0).alias("any"))
    uses = each.groupBy(by, "part", "guard").agg(F.count_if("any").alias("n"))
    free = kept(uses.groupBy(by, "part").agg(F.max("n").alias("n")).where("n <= 1").select(by, "part"))
    whole = part.join(free, [by, "part"]).select(by, "node", F.col("part").alias("label"))
    rest = large.join(part, [by, "node"]).join(free, [by, "part"], "left_anti")
    alone = ends.join(part, [by, "node"], "left_anti").select(by, "node", F.col("node").alias("label")).distinct()  # edges to oneself
    return out.unionByName(whole).unionByName(_united(rest, [by], [by, "part"])).unionByName(alone)


def assign_greedily(pairs: DataFrame, by: str, most_in_task: int = 200_000) -> DataFrame:
    """Takes pairs (left, right, score, near) by score, then nearness, then ids, where both ends are free: (by, left, right, score).

    In a large group, a pair that is first at both of its ends is taken whatever else happens, so all such pairs are taken at once
    and the pairs of their ends go; rounds follow until none is left. Few rounds do unless scores fall along a chain of pairs.
    """
    small, large = _by_size(pairs.select(by, "left", "right", "score", "near"), by, most_in_task)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, lefts, rights = None, set(), set()
        for pdf in parts:
            keep = []
            for g, a, b in zip(pdf[by], pdf["left"], pdf["right"]):
                if g != group:
                    group, lefts, rights = g, set(), set()
                free = a not in lefts and b not in rights
                if free:
                    lefts.add(a)
                    rights.add(b)
                keep.append(free)
            yield pdf.loc[keep, [by, "left", "right", "score"]]

    kind = dict(small.dtypes)
    rows = small.repartition(by).sortWithinPartitions(by, small["score"].desc(), "near", "left", "right")
    out = rows.mapInPandas(run, ", ".join(f"{c} {kind[c]}" for c in (by, "left", "right", "score")))
    order = F.struct((-F.col("score")).alias("less"), "near", "left", "right").alias("k")
    while large is not None and not large.isEmpty():
        at = lambda end: large.groupBy(by, end).agg(F.min(order).alias("k")).select(by, "k")  # noqa: B023, E731
        first = kept(at("left").join(at("right"), [by, "k"]).select(by, "k.left", "k.right", (-F.col("k.less")).cast(kind["score"]).alias("score")))
        out = out.unionByName(first)
        large = kept(large.join(first.select(by, "left"), [by, "left"], "left_anti").join(first.select(by, "right"), [by, "right"], "left_anti"))
    return out


def merged_orders(rows: DataFrame, by: str, item: str, lists: list[str], within: list[str], n: int = 0) -> DataFrame:
    """(by, item, position): one order of a group's items that keeps each list's own as far as earlier ones allow.

    Lists are folded in the order of ``lists`` (their date and id); a list's items go by ``within``. A new item stands right after
    the one that precedes it in its list. Items are a chain in which each knows the next one, so a step takes the same time
    however long the chain is; the state is one group's items. n is the number of rows, where known: by it they are dealt out.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, after, here, listed = None, {}, None, None

        def close() -> pd.DataFrame:
            out, x = [], after.get(None)
            while x is not None:
                out.append(x)
                x = after[x]
            return pd.DataFrame({by: [group] * len(out), item: out, "position": range(1, len(out) + 1)})

        for pdf in parts:
            for g, one, x in zip(pdf[by], zip(*(pdf[c] for c in lists)), pdf[item]):
                if g != group:
                    if after:
                        yield close()
                    group, after, listed = g, {}, None
                if one != listed:
                    listed, here = one, None
                if x not in after:
                    after[x], after[here] = after.get(here), x
                here = x
        if after:
            yield close()

    kind = dict(rows.dtypes)
    ordered = (dealt(rows, n, by) if n else rows.repartition(by)).sortWithinPartitions(by, *lists, *within)
    return ordered.mapInPandas(run, f"{by} {kind[by]}, {item} {kind[item]}, position int")
