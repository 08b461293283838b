"""Checks, guarded writes, placement, undo, code pages and track lists by pinned cases and laws."""

import time

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import parse, tags, text
from shelfmark.operators import changelog, graph, placement, policy, rules


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_legacy_bytes(spark):
    assert text.legacy_text("曲名".encode("cp932")) == "曲名" and text.legacy_text("曲名".encode()) == "曲名" and text.legacy_text(b"caf\xe9") == "café"
    for name in ("utf-8", "cp932"):
        assert text.code_page(["テスト.wav".encode(name), b"plain.txt", "歌ってみた".encode(name)]) == name
    assert text.code_page(["音乐".encode("gbk"), "测试文件".encode("gbk")]) == "gbk" and text.code_page([b"a", b"b.txt"]) is None
    rows = spark.createDataFrame([([bytearray("テスト".encode("cp932"))],), (None,)], "names array<binary>")
    assert [r.p for r in rows.select(text.page_of("names").alias("p")).collect()] == ["cp932", None]


def test_small_parsers(spark):
    r = one(
        spark,
        safe=parse.safe_name(F.lit(' a/b: "c"\n d ')), guess=parse.catalogue_guess(F.lit("abcd-004a  Lark")), none=parse.catalogue_guess(F.lit("A-1 x")), one_=parse.message("{n} {n:track|tracks} {x}", {"n": F.lit(1)}), many=parse.message("{n:a|b}", {"n": F.lit("2")}),
        ja=parse.language(F.lit("ja;q=1, en")), zh=parse.language(F.lit(None).cast("string")), mark=parse.expiry(F.lit(1001), 200), exact=parse.expiry(F.lit(1000), 200), other=parse.series(F.lit(" OTHER ")), series=parse.series(F.lit(" x ")),
        sizes=F.array(*(parse.human_size(F.lit(x).cast("long")) for x in (0, 1023, 1024, 1280, 10 * 1024, 10239, 1024**4 * 5, 1024**5 * 3, None))), fps=parse.frame_rate(F.lit("24000/1001")), no=parse.frame_rate(F.lit("0/0")),
        cover=parse.cover(F.lit('{"file": "f1"}')), bad=parse.cover(F.lit('{"picture": "x"}')), broken=parse.cover(F.lit("{")), order=tags.in_display_order(F.array(*map(F.lit, ("z", "performer:b", "artist", "a", "title"))), ["title", "artist"]),
    )
    assert (r.safe, tuple(r.guess), tuple(r.none)) == ("a_b_ _c__ d", ("ABCD-004A", "Lark"), (None, "A-1 x"))
    assert (r.one_, r.many, r.ja, r.zh, r.mark, r.exact, r.other, r.series) == ("1 track {x}", "b", "ja", "zh", 1800, 1200, None, "x")
    assert r.sizes == ["0 B", "1023 B", "1.0 KB", "1.3 KB", "10 KB", "10.0 KB", "5.0 TB", "3072 TB", "—"]
    assert (r.fps, r.no, r.cover.file, r.cover.mode, r.bad, r.broken) == (23.976, None, "f1", "replace", None, None) and r.order == ["title", "artist", "performer:b", "a", "z"]


def test_rule_files_are_checked(spark):
    good = {"name": "a", "pattern": "^x/", "confidence": 0.5, "role": "log", "keep": True}
    for bad in ({"name": None}, {"confidence": 2}, {"pattern": "("}, {"role": "odd"}, {"form": "x"}):
        with pytest.raises(ValueError):
            rules.checked([good | bad], {"role": {"log"}})
    with pytest.raises(ValueError):
        rules.checked([good, good], {"role": {"log"}})
    found = rules.applied(F.col("p"), rules.checked([good], {"role": {"log"}}), ["role"])
    rows = spark.createDataFrame([("x/a/b/file",), ("x/file",), ("y/file",)], "p string").select(found.alias("r")).collect()
    assert [None if x.r is None else (x.r.rule, x.r.role, x.r.folders) for x in rows] == [("a", "log", "a/b"), ("a", "log", ""), None]


def test_titles_in_a_long_text(spark):
    """Work grows with a text's words, not with their square."""
    long_ = " ".join(f"w{i}" for i in range(60_000)) + " deep river now"
    texts = spark.createDataFrame([(1, long_.split()), (2, []), (3, ["deep", "deep", "river"])], "id int, words array<string>")
    names = spark.createDataFrame([(7, "deep river"), (8, "river")], "release int, name string")
    start = time.time()
    assert {r.id: r.release for r in rules.titles_in(texts, names).collect()} == {1: 7, 3: 7}
    assert time.time() - start < 30


def test_titles_in_texts(spark):
    names = spark.createDataFrame([(1, "night"), (2, "night sky"), (3, "blue sky"), (4, "night sky")], "release long, name string")
    rows = [(1, "a night out"), (2, "nights out"), (3, "the night sky"), (4, "blue sky at night"), (5, "")]
    words = spark.createDataFrame(rows, "id long, t string").select("id", F.split("t", " ").alias("words"))
    assert {r.id: r.release for r in rules.titles_in(words, names, 3).collect()} == {1: 1, 4: 3}


def test_guarded_writes_run_twice(spark):
    base = spark.createDataFrame([(1, 10)], "id long, parent long")
    rows = spark.createDataFrame([(1, 10), (2, 10), (3, 11), (4, 10), (2, 10)], "id long, parent long")
    deleted, parents = spark.createDataFrame([(4,)], "id long"), spark.createDataFrame([(10,)], "parent long")
    new = changelog.guarded(base, rows, "id", deleted, parents, "parent")
    assert [tuple(r) for r in new.collect()] == [(2, 10)]
    assert changelog.guarded(base.unionByName(new), rows, "id", deleted, parents, "parent").isEmpty()


def test_undo(spark):
    made = spark.createDataFrame([("b1", 1), ("b1", 2), ("b2", 3)], "batch string, id long")
    pointing = spark.createDataFrame([("b1", 1), ("b3", 1), ("b3", 2), ("b2", 3)], "batch string, id long")
    assert [tuple(r) for r in changelog.refused(made, pointing).collect()] == [("b1", 2)]
    undos = spark.createDataFrame([(5, 1), (6, 5), (7, 2)], "batch long, undoes long")
    assert sorted(map(tuple, changelog.undo_marks(undos).collect())) == [(2, 7), (5, 6)]


def test_trees(spark):
    chain = [(f"n{i}", f"n{i - 1}" if i else None, "era" if i == 0 else "plain") for i in range(40)]
    edges = spark.createDataFrame(chain, "id string, parent_id string, kind string")
    assert graph.closure(edges).count() == 40 * 41 // 2
    own = spark.createDataFrame([("n39", 2), ("n10", 5)], "id string, n long")
    total = {r.id: r.total for r in graph.rolled_up(edges, own, "n").collect()}
    assert total["n0"] == total["n10"] == 7 and total["n11"] == 2 and len(total) == 40
    assert {r.era for r in graph.context(edges, ["era"]).collect()} == {"n0"}
    ring = spark.createDataFrame([("a", "b", "x"), ("b", "a", "x")], "id string, parent_id string, kind string")
    with pytest.raises(ValueError):
        graph.closure(ring, 8)
    with pytest.raises(ValueError):
        graph.rolled_up(ring, spark.createDataFrame([("a", 1)], "id string, n long"), "n", 8)


def test_folders_merge(spark):
    source = spark.createDataFrame([(p,) for p in ("a", "a/b", "a/b/c", "d", "d/e")], "path string")
    target = spark.createDataFrame([(p,) for p in ("a", "a/x", "z")], "path string")
    assert {r.path: r.action for r in placement.merged(source, target).collect()} == {"a": "merge", "a/b": "move", "a/b/c": "along", "d": "move", "d/e": "along"}


def test_play_versions(spark):
    v = lambda *a: [(x.version, x.level, x.locked) for x in one(spark, v=policy.play_versions(*(F.lit(x) for x in a))).v]
    assert v("own", True, True, True, "full", "lossless") == [("stream", "lossless", False), ("original", "original", True), ("aac", "lossy", False)]
    assert v("same", True, True, False, "full", "lossy") == [("original", "lossless", True)] and v("own", True, True, True, "none", "original") == []


FILE = "edition long, id long, disc int, track int, title string, name string, title_key string, seconds double, lossless boolean, audio string, linked long"
ENTRY = "edition long, track long, name string, title_key string, listed int"


def test_track_lists(spark):
    f = lambda e, i, disc, track, title, seconds=100.0, lossless=False, audio=None, linked=None: (e, i, disc, track, title, title.lower(), title.lower().split(" (")[0], seconds, lossless, audio, linked)
    files = [
        f(1, 1, 1, 2, "Two"), f(1, 2, 1, 1, "One", audio="x"), f(1, 3, 2, 5, "other name", audio="x", lossless=True),  # the same sound is one row
        f(1, 4, 1, None, "Two", 101.5), f(1, 5, 1, None, "Two", 140.0),  # a copy joins its twin, a longer one is a row of its own
        f(1, 6, 2, 1, "Three (live)"), f(1, 7, 2, 2, "Linked", linked=77), f(2, 8, 1, None, "New"),
    ]
    entries = [(1, 70, "two", "two", 1), (1, 71, "two", "two", 3), (1, 72, "x", "three", 1), (1, 77, "far", "far", 0), (1, 78, "linked", "linked", 9)]
    got = placement.track_lists(spark.createDataFrame(files, FILE), spark.createDataFrame(entries, ENTRY)).collect()
    rows = sorted((r.edition, r.disc, r.position, r.title, r.track, r.files) for r in got)
    assert rows == [(1, 1, 1, "other name", None, "2,3"), (1, 1, 2, "Two", 71, "1,4"), (1, 1, 3, "Two", None, "5"), (1, 2, 1, "Three (live)", 72, "6"), (1, 2, 2, "Linked", 77, "7"), (2, 1, 1, "New", None, "8")]
