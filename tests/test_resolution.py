"""Greedy assignment, guarded merging, merged orders, version chains and free names against step-by-step versions."""

import random

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import graph, naming, resolve


def greedy(rows):
    lefts, rights, out = set(), set(), set()
    for g, a, b, score, near in sorted(rows, key=lambda r: (r[0], -r[3], r[4], r[1], r[2])):
        if (g, a) not in lefts and (g, b) not in rights:
            lefts.add((g, a))
            rights.add((g, b))
            out.add((g, a, b, score))
    return out


PAIR = "g long, left int, right long, score int, near int"


@pytest.mark.parametrize("most", [10**6, 40, 0])
def test_greedy_assignment(spark, most):
    r = random.Random(1)
    rows = list({(g, a, b): (g, a, b, r.randrange(6), r.randrange(3)) for g in range(4) for _ in range(15 * 4**g) for a, b in [(r.randrange(5 + 8 * g), r.randrange(5 + 8 * g))]}.values())
    rows += [(9, i, i + k, 20 - 2 * i - k, 0) for i in range(8) for k in (0, 1)]  # a chain
    found = resolve.assign_greedily(spark.createDataFrame(rows, PAIR), "g", most)
    assert found.dtypes == [("g", "bigint"), ("left", "int"), ("right", "bigint"), ("score", "int")]
    assert sorted(map(tuple, found.collect())) == sorted(greedy(rows))
    assert resolve.assign_greedily(spark.createDataFrame([], PAIR), "g", most).collect() == []


def test_one_group_of_many_pairs(spark):
    n = 300_000
    pairs = spark.range(n).selectExpr("1L as g", "cast(pmod(xxhash64(id, 'l'), 60000) as int) as left", "pmod(xxhash64(id, 'r'), 60000) as right", "cast(pmod(xxhash64(id), 1000000) as int) as score", "0 as near").dropDuplicates(["left", "right"])
    rounds, stream = resolve.assign_greedily(pairs, "g", 1000), resolve.assign_greedily(pairs, "g", 10**9)
    a, b = (x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("left", "right", "score").cast("decimal(38,0)"))).first() for x in (rounds, stream))
    assert a == b and a[0] > 30_000


def guarded(edges):
    up, held = {}, {}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for g, a, ga, b, gb, rank in sorted(edges, key=lambda e: (e[0], e[5], e[1], e[3])):
        for n, guard in ((a, ga), (b, gb)):
            up.setdefault((g, n), (g, n))
            held.setdefault((g, n), {guard})
        x, y = sorted((find((g, a)), find((g, b))))
        if x != y and not held[x] & held[y]:
            up[y] = x
            held[x] |= held[y]
    return {(*n, find(n)[1]) for n in up}


@pytest.mark.parametrize("most", [10**6, 10, 0])
def test_guarded_merging(spark, most):
    r = random.Random(3)
    guard = {(g, n): r.choice([None, *(str(x) for x in range(3 + 20 * (g % 3)))]) for g in range(6) for n in range(40)}
    edges = list({(g, a, b): (g, a, guard[g, a], b, guard[g, b], r.randrange(3)) for g in range(6) for _ in range(4 + 7 * g) for a, b in [(r.randrange(40), r.randrange(40))]}.values())
    edges += [(7, 1, "x", 1, "x", 0)]
    found = resolve.guarded_groups(spark.createDataFrame(edges, "g long, node long, guard string, other long, other_guard string, rank int"), "g", most)
    assert sorted(map(tuple, found.collect())) == sorted(guarded(edges))


def test_merged_orders(spark):
    r = random.Random(5)
    rows = [(g, day, o, p, at) for g in range(5) for o in range(8) for day in [r.randrange(4)] for at, p in enumerate(r.sample(range(20), r.randrange(1, 10)))]
    want = []
    for g in range(5):
        merged = []
        for _, o in sorted({(x[1], x[2]) for x in rows if x[0] == g}):
            after = 0
            for x in (x for x in rows if x[0] == g and x[2] == o):
                if x[3] in merged:
                    after = merged.index(x[3]) + 1
                else:
                    merged.insert(after, x[3])
                    after += 1
        want += [(g, p, i) for i, p in enumerate(merged, 1)]
    df = spark.createDataFrame(rows, "g long, day int, o int, p int, at int")
    assert sorted(map(tuple, resolve.merged_orders(df, "g", "p", ["day", "o"], ["at"]).collect())) == sorted(want)


def test_chains(spark):
    kind = "id string, replaces string"
    rows = [(f"v{i}", f"v{i - 1}" if i else None) for i in range(21)] + [("b", "v3"), ("lost", "gone"), ("alone", None), ("alone", None)]
    found = {r["id"]: tuple(r)[1:] for r in graph.chains(spark.createDataFrame(rows, kind)).collect()}
    assert all(found[f"v{i}"] == ("v0", i, {3: "b", 20: None}.get(i, f"v{i + 1}")) for i in range(21))
    assert found["b"] == ("v0", 4, None) and found["lost"] == ("lost", 0, None) and found["alone"] == ("alone", 0, None)
    for bad in ([("x", "y"), ("y", "z"), ("z", "x")], [("x", "x")]):
        with pytest.raises(ValueError, match="cycle"):
            graph.chains(spark.createDataFrame(bad + rows, kind))
    with pytest.raises(ValueError, match="more than 19"):
        graph.chains(spark.createDataFrame(rows, kind), 19)


def test_free_names(spark):
    there = [("f", "Cover.jpg"), ("f", "cover (2).jpg"), ("f", "cover (4).JPG"), ("f", "cover (04).jpg"), ("g", "x"), ("f", ".hidden"), (None, "top")]
    new = [(1, "f", "cover.JPG"), (2, "f", "cover.jpg"), (3, "f", "cover (2).jpg"), (4, "f", "cover (5).jpg"), (5, "f", "COVER.jpg"), (6, "g", "x"), (7, "g", "y"), (8, "g", "Y"), (9, "f", ".hidden"), (10, None, "top"), (11, None, "top"), (12, "f", "a.b.c"), (13, "f", "a.b.c"), (14, "g", "x (2)"), (15, "f", "new")]
    found = {r["id"]: r["free"] for r in naming.free_names(spark.createDataFrame(new, "id int, folder string, name string"), spark.createDataFrame(there, "folder string, name string")).collect()}
    assert found == {1: "cover (3).JPG", 2: "cover (6).jpg", 3: "cover (2) (2).jpg", 4: "cover (5).jpg", 5: "COVER (7).jpg", 6: "x (3)", 7: "y", 8: "Y (2)", 9: ".hidden (2)", 10: "top", 11: "top", 12: "a.b.c", 13: "a.b (2).c", 14: "x (2)", 15: "new"}


def test_free_names_never_clash(spark):
    r = random.Random(8)
    name = lambda: r.choice(["a", "A", "b"]) + r.choice(["", " (2)", " (3)", " (2) (2)", " (7)"]) + r.choice(["", ".x"])
    new = [(i, r.choice("fg"), name()) for i in range(120)]
    there = [(r.choice("fg"), name()) for _ in range(15)]
    found = naming.free_names(spark.createDataFrame(new, "id int, folder string, name string"), spark.createDataFrame(there, "folder string, name string")).collect()
    shown = [(x["folder"], x["free"].lower()) for x in found]
    assert len(found) == 120 and len(set(shown)) == 120 and not set(shown) & {(f, n.lower()) for f, n in there}


def test_full_paths(spark):
    rows = [(1, None, "a"), (2, 1, "b"), (3, 2, None), (4, 9, "lost"), (5, None, None), (6, 5, "c")]
    found = {tuple(r) for r in graph.full_paths(spark.createDataFrame(rows, "id int, parent_id int, name string"), "/").collect()}
    assert found == {(1, "a"), (2, "a/b"), (3, "a/b/"), (5, ""), (6, "/c")}
