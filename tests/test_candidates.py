"""Candidates of editions: who meets whom, how well each fits, and the comparison by sound."""

import itertools
import random

import duckdb
from pyspark.sql import functions as F

from shelfmark.functions.text import title_key
from shelfmark.operators import candidates
from shelfmark.plans import matching  # noqa: F401
from shelfmark.plans.catalogue import QUERIES

EDITION = "edition string, title string, number string, durations array<double>"
RELEASE = "release string, group string, title string, group_title string, numbers array<string>, durations array<double>, count int"


def test_contained_equals_brute_force(spark):
    r = random.Random(3)
    keys = sorted({"".join(r.choice("ab") for _ in range(r.randrange(0, 12))) for _ in range(300)} | {"aaaa", "a" * 30, ""})
    want = {(a, b) for a, b in itertools.permutations(keys, 2) if len(a) >= 4 and a in b}
    got = candidates.contained(spark.createDataFrame([(k,) for k in keys], "key string")).collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want)


def test_who_meets(spark):
    editions = spark.createDataFrame([("e1", "Blue Ring", "AB-1", None), ("e2", "Sun", "ab-2", None), ("e3", None, "", None), ("e4", "Red Moon", None, None)], EDITION)
    rows = [
        ("same", None, "BLUE  ring!", None, None, None, None),
        ("longer", None, "The Blue Ring II", None, [], None, None),
        ("by group", None, "other", "blue ring", [None], None, None),
        ("number", "g", "Blue Sky", None, ["a b-1 x", "zz"], None, None),  # first four characters and the number's start
        ("listed", "g", "anything", None, None, None, None),  # in that release's group
        ("wrong title", None, "Green", None, ["AB-1"], None, None),
        ("short", None, "Sunny", None, None, None, None),  # three characters within another are too few
        ("empty", None, "", None, [""], None, None),
        ("inside", None, "moon", None, None, None, None),
    ]
    found = candidates.similar(editions, spark.createDataFrame(rows, RELEASE)).collect()
    want = {("e1", "same"), ("e1", "longer"), ("e1", "by group"), ("e1", "number"), ("e1", "listed"), ("e3", "empty"), ("e4", "inside")}
    assert {tuple(x) for x in found} == want and len(found) == len(want)
    assert candidates.similar(editions.limit(0), spark.createDataFrame(rows, RELEASE)).count() == 0


def test_fit_equals_plain(spark):
    def plain(durations, number, title, c_durations, count, numbers, c_title):
        durations, n = durations or [], len(durations or [])
        c = max(0, 1 - abs(count - n) / max(count, n)) if n and count else 0
        k = float(bool(number) and any(x and "".join(x.split()).upper() == number.upper() for x in numbers or []))
        t = float(title_key(title or "") == title_key(c_title or ""))
        if c_durations is None:
            return 0.5 * c + 0.35 * k + 0.15 * t
        near = sum(bool(a and b and abs(a - b) <= 3000) for a, b in zip(durations, c_durations))
        return 0.35 * (near / max(n, len(c_durations)) if n else 0) + 0.25 * c + 0.25 * k + 0.15 * t

    r = random.Random(5)
    lengths = lambda: r.choice([None, [], [r.choice([None, 0.0, 1000.0, 4000.0, 4001.0, 9000.0]) for _ in range(r.randrange(1, 6))]])
    rows = []
    for i in range(200):
        rows.append((i, lengths(), r.choice([None, "", "ab-1"]), r.choice(["Blue", "blué!", None]), lengths(), r.choice([None, 0, 1, 3, 9]), r.choice([None, [], [None, "AB -1"], ["x"]]), r.choice(["BLUE", "x", None])))
    df = spark.createDataFrame(rows, "i int, d array<double>, number string, title string, cd array<double>, count int, numbers array<string>, c_title string")
    key = lambda c: candidates.folded("title_key", F.coalesce(c, F.lit("")))
    got = df.select("i", candidates.fit(F.col("d"), F.col("number"), key("title"), F.col("cd"), F.col("count"), F.col("numbers"), key("c_title")).alias("s")).collect()
    want = {i: plain(d, number, title, cd, count or 0, numbers, c_title) for i, d, number, title, cd, count, numbers, c_title in rows}
    assert all(abs(x.s - want[x.i]) < 1e-9 for x in got) and len(got) == 200


def test_ranked(spark):
    editions = spark.createDataFrame([("e", "Blue", "A1", [1000.0, 2000.0])], EDITION)
    releases = spark.createDataFrame([("b", None, "blue", None, ["A 1"], [1500.0, 9000.0], 2), ("a", None, "blue", None, [], None, 2), ("c", None, "blue", None, None, None, 2)], RELEASE)
    assert [(x.release, x.score, x["rank"]) for x in candidates.ranked(editions, releases).orderBy("rank").collect()] == [("b", 0.825, 1), ("a", 0.65, 2), ("c", 0.65, 3)]


def test_compared(spark):
    editions = spark.createDataFrame([("r", "old", "2001", 1), ("r", "new", "2010", 2), ("r", "undated", None, 0), ("r", "unused", "1999", 0)], "release string, edition string, date string, place int")
    rows = spark.createDataFrame([("r", "old", "t1", 1, 1), ("r", "new", "t1", 2, 3), ("r", "new", "t1", 1, 10), ("r", "new", "t1", 1, 2), ("r", "old", "t2", 1, 2), ("r", "undated", "t2", 1, 4)], "release string, edition string, track string, disc int, position int")
    files = [
        ("r", "old", "t1", 1, "s1", "p", 100.0),
        ("r", "new", "t1", 2, "s2", None, 50.0),  # of its own length all, nine tenths of the shorter
        ("r", "new", "t1", 3, "s1", None, 50.0),  # a cell takes the smaller file
        ("r", "undated", "t1", 4, "s9", "p", 9.0),  # same by decoded sound
        ("r", "new", "t2", 5, "s5", None, None),
        ("r", "undated", "t2", 6, None, None, 7.0),
        ("r", "new", "t3", 7, "s7", None, 100.0),
        ("r", "undated", "t3", 8, "s8", None, 200.0),
    ]
    files = spark.createDataFrame(files, "release string, edition string, track string, file int, sha string, pcm string, seconds double")

    def of(score, ms):
        matches = spark.createDataFrame([("s1", "s2", score, ms), ("s7", "s8", 0.99, 89_000)], "a string, b string, score double, matched_ms long")
        return {(x.track, x.edition): (x.position, x.relation, x.share, x.score) for x in candidates.compared(editions, rows, files, matches).collect()}

    got = of(0.93, 45_000)
    assert got == {
        ("t1", "old"): ("1", "ref", None, None),
        ("t1", "new"): ("2, 10, 2-3", "master", 0.9, 0.93),
        ("t1", "undated"): (None, "same", None, None),
        ("t2", "old"): ("2", "nofile", None, None),
        ("t2", "new"): (None, "new", None, None),
        ("t2", "undated"): ("4", "other", None, None),
        ("t3", "new"): (None, "new", None, None),
        ("t3", "undated"): (None, "part", 0.445, 0.99),
    }
    assert of(0.92, 60_000)["t1", "new"] == ("2, 10, 2-3", "remix", 1.0, 0.92)


def test_sound_comparison_odd_rows(spark, tmp_path):
    """Fractions and large quantities, unknown values, a part listed twice, and duplicate lines: as in SQL."""
    con = duckdb.connect()
    con.sql("CREATE TABLE part AS SELECT * FROM (VALUES (1, 'a', 3), (2, 'a', 5), (3, NULL, 1), (4, 'b', NULL), (5, 'b', 9), (6, 'c', 2), (6, 'c', 2), (6, 'd', 2), (7, 'b', 4)) t(p_partkey, p_brand, p_size)")
    con.sql("CREATE TABLE orders AS SELECT i AS o_orderkey, CASE WHEN i % 11 <> 0 THEN TIMESTAMP '2001-01-31 23:30:00' + INTERVAL (i * 53 % 700) DAY END AS o_orderdate FROM range(1, 61) g(i) UNION ALL SELECT 5, TIMESTAMP '2001-02-01'")
    con.sql("""CREATE TABLE lineitem AS SELECT CAST(1 + i * 7 % 60 AS BIGINT) AS l_orderkey, CASE WHEN i % 29 <> 0 THEN CAST(1 + i % 7 AS INTEGER) END AS l_linenumber, CAST(1 + i * 5 % 13 % 6 AS BIGINT) AS l_partkey,
        CASE i % 9 WHEN 0 THEN NULL WHEN 1 THEN 1000.0 + i % 5 WHEN 4 THEN 1000.0 + i % 5 WHEN 2 THEN 10.5 + i % 3 ELSE 8 + i % 6 END::DOUBLE AS l_quantity, CASE i % 5 WHEN 0 THEN 'R' WHEN 1 THEN NULL ELSE 'N' END AS l_returnflag FROM range(400) g(i) UNION ALL VALUES (12, 1, 7, 100, 'N'), (13, 1, 7, 104, 'N')""")
    for t in ("part", "orders", "lineitem"):
        con.sql(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    plain = lambda df: sorted(str([None if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r]) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))
    q = QUERIES["sound_comparison"]
    got, want = plain(q.run(spark, str(tmp_path)).toPandas()), plain(con.sql(q.sql).df())
    assert len(want) > 50 and all(any(f"'{x}'" in r for r in want) for x in ("ref", "new", "nofile", "same", "other", "part", "master", "remix"))
    assert got == want
