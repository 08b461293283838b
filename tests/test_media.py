"""Lyrics and rules with releases: the cases that queries over the given tables can't show."""

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import classify, lyrics, rules


def sung(spark, *texts):
    rows = lyrics.parsed(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), ["id"]).orderBy("id", "at").collect()
    return [[(r["t_ms"], r["line"], *r["translations"]) for r in rows if r["id"] == i] for i in range(len(texts))], {r["id"]: r["synced"] for r in rows}


def test_lyrics(spark):
    found, synced = sung(
        spark,
        None,
        "\n \r\n\t　",
        "\r\nひとつめの　行\rふたつめの　行\r\r\rみっつめの　行\r\r",
        "[1:23] はじめ\n二番\n三番\n四番",
        "﻿[ti:Song]\n[ar:Nobody]\n[00:12.50]first\n[00:20.00][01:10.00]chorus\n[00:30.1]<00:30.10>wo<00:30.50>rds\n[00:40]\n[00:41.000]last",
        "[offset:+500]\n[00:00.20]a\n[00:10.00]b",
        "[00:01.00]\n[00:05.00]鳥のうた\n[00:05.00]Song of the birds\n[00:05.00]鸟之歌\n[00:09.00]つぎ",
        "[00:07]only",
        "[00:01]\n[00:02]",
        "[00:05]a\n[00:05]\n[00:05]b\n[00:05]c",
        "[offset:2000]\n[00:03]x\n[00:01]y\n[offset:bad]\n[00:01.5]z",
    )
    assert found[:2] == [[], []] and found[8] == []
    assert found[2] == [(None, "ひとつめの　行"), (None, "ふたつめの　行"), (None, ""), (None, "みっつめの　行")] and not synced[2]
    assert found[3][0] == (None, "[1:23] はじめ") and not synced[3]
    assert found[4] == [(12500, "first"), (20000, "chorus"), (30100, "words"), (40000, ""), (41000, "last"), (70000, "chorus")] and synced[4]
    assert found[5] == [(0, "a"), (9500, "b")]
    assert found[6] == [(5000, "鳥のうた", "Song of the birds", "鸟之歌"), (9000, "つぎ")]
    assert found[7] == [(7000, "only")]
    assert found[9] == [(5000, "a"), (5000, "b", "c")]
    assert found[10] == [(0, "y", "z"), (1000, "x")]


KNOWN = {"slots": {"cd_rip", "pv"}, "rights": {"own"}, "states": {"ignored"}, "eras": {"first", "late"}}


@pytest.fixture(scope="module")
def releases(spark):
    rows = [
        ("ab-006", "AB-006", "first", ["Silver Bell -The Long Road-"]),
        ("amber", None, "first", ["Silver Bell -Amber Light-"]),
        ("ab-004", "AB-004", "first", ["Möwe -Letters from Home-", "Möwe"]),
        ("lt-nordlys", None, "late", ["NORDLYS"]),
        ("same-a", None, "late", ["Twin"]),
        ("same-b", None, "late", ["Ｔｗｉｎ"]),
    ]
    return spark.createDataFrame(rows, "id string, catalog_no string, era string, names array<string>")


def placed(spark, releases, raw, *paths):
    found = classify.suggested(spark.createDataFrame([(p,) for p in paths], "path string"), classify.checked(spark, raw, releases, KNOWN), releases, {"rar", "iso"})
    return {r["path"]: {k: v for k, v in r.asDict().items() if v is not None} for r in found.collect()}


def test_first_rule_wins_and_unknown_releases_give_way(spark, releases):
    raw = [
        {"name": "junk", "ext": ["download"], "state": "ignored"},
        {"name": "rip", "match": r"^rips/\[(?P<cat>AB-\d{3})A?\]", "release": {"catalog": "cat"}, "slot": "cd_rip", "rights": "own", "confidence": 0.9},
        {"name": "fallback", "match": "^rips/", "rights": "own", "confidence": 0.3},
    ]
    a, b, c = "rips/[AB-004A] Möwe/01.flac", "rips/[AB-999] Unknown/01.flac", "rips/x.download"
    found = placed(spark, releases, raw, a, a, b, c, "else/x", None)
    assert set(found) == {a, b, c}
    assert found[a] == {"path": a, "rule": "rip", "confidence": 0.9, "release_id": "ab-004", "slot": "cd_rip", "edition": "", "rights": "own"}
    assert found[b]["rule"] == "fallback" and "release_id" not in found[b] and found[c]["state"] == "ignored"


def test_titles(spark, releases):
    raw = [{"name": "era", "match": "^era/", "release": {"title": "$name", "era": "first"}}, {"name": "any", "match": "^(?:era|any)/", "release": {"title": "$name"}}]
    found = placed(spark, releases, raw, "any/Band - Singer - Silver Bell - Amber Light.mkv", "any/Band - Möwe（缺）.mkv", "any/Möwex.a", "era/NORDLYS Extra Things.a", "era/MOWE.a", "any/twin.x")
    assert {p: (x["rule"], x["release_id"]) for p, x in found.items()} == {
        "any/Band - Singer - Silver Bell - Amber Light.mkv": ("any", "amber"),
        "any/Band - Möwe（缺）.mkv": ("any", "ab-004"),
        "era/NORDLYS Extra Things.a": ("any", "lt-nordlys"),
        "era/MOWE.a": ("era", "ab-004"),
    }


def test_places(spark, releases):
    raw = [
        {"name": "rip A", "match": r"^rips/\[(?P<cn>(?P<cat>AB-\d{3})A)\][^/]*/", "release": {"catalog": "cat"}, "slot": "cd_rip", "edition": {"name": "second", "catalog": "cn"}, "keep": True},
        {"name": "rip", "match": r"^rips/\[(?P<cat>AB-\d{3})\][^/]*/", "release": {"catalog": "cat"}, "slot": "cd_rip"},
        {"name": "web", "match": "^web/", "era": "first", "folder": "旧网页", "keep": True},
        {"name": "bms", "match": "^bms/", "era": "late", "folder": "BMS", "seal": True},
        {"name": "readme", "match": r"^notes/read\.txt$", "folder": "about/notes", "readme": True},
    ]
    paths = ["rips/[AB-004A] Möwe/Scans/1.jpg", "rips/[AB-004] Möwe/01.flac", "web/2019/pages/index.html", "bms/x.RAR", "bms/x.ogg", "notes/read.txt"]
    found = placed(spark, releases, raw, *paths)
    pick = lambda p, *keys: tuple(found[p].get(k) for k in keys)
    assert pick(paths[0], "release_id", "slot", "edition", "edition_catalog", "folder") == ("ab-004", "cd_rip", "second", "AB-004A", "Scans")
    assert pick(paths[1], "edition", "edition_catalog", "folder") == ("", None, None)
    assert pick(paths[2], "era_id", "folder", "release_id") == ("first", "旧网页/2019/pages", None)
    assert pick(paths[3], "seal") == (True,) and pick(paths[4], "seal") == (None,)
    assert pick(paths[5], "folder", "readme") == ("about/notes", True)


@pytest.mark.parametrize(
    "raw,message",
    [
        ({"match": "x", "release": "amber", "slot": "vinyl"}, "unknown slot"),
        ({"match": "x", "release": {"title": "t"}}, "no group"),
        ({"match": "x", "slot": "pv"}, "needs a release"),
        ({"match": "x", "release": "amber", "edition": "early"}, "edition needs a slot"),
        ({"match": "x", "folder": "a//b"}, "bad folder"),
        ({"match": "x", "era": "nope", "folder": "a"}, "unknown era"),
        ({"match": "x", "release": "amber", "era": "late"}, "era is for folders"),
        ({"match": "x", "release": "none"}, "unknown release"),
        ({"match": "x(", "folder": "a"}, "bad pattern"),
        ({"folder": "a"}, "needs a pattern"),
        ({"ext": ["a"], "keep": True}, "needs a pattern"),
        ({"match": "x", "release": {"era": "late"}}, "needs an id"),
        ({"match": "x", "confidence": 2}, "confidence"),
    ],
)
def test_faulty_rules(spark, releases, raw, message):
    with pytest.raises(ValueError, match=message):
        classify.checked(spark, [raw], releases, KNOWN)


def test_named_groups():
    assert classify.named_groups(r"(a)(?<b>\((c)[(\])]+)(?:d)(?<=x)(?<!y)(?<e>f)") == {"b": 2, "e": 4}


def test_folders_below_the_match(spark):
    cases = [(r"\bart/", "start/x/art/y/z/f", "y/z"), ("^a/", "a/b//c/f", "b/c"), ("(?<=x)/a", "a/a/x/a/b/f", "b"), ("a", "a", ""), ("(a|b)+/", "q/ab/c/f", "c"), ("^a/", "a/\nb/f", "\nb"), ("z", "z/" + "n" * 300 + "/f", "n" * 200)]
    for pattern, path, want in cases:
        assert spark.createDataFrame([(path,)], "p string").select(rules.kept_folders(F.col("p"), pattern)).first()[0] == want, pattern


def test_names_in_texts(spark):
    texts = spark.createDataFrame([(1, "a b c a".split()), (2, []), (3, ["b"] * 5), (4, ["x", "y"])], "id int, words array<string>")
    names = spark.createDataFrame([("r", "a"), ("s", "b c"), ("t", "b b b b"), ("u", "y"), ("v", "y"), ("w", "a b c a b")], "release string, name string")
    assert {tuple(r) for r in rules.titles_in(texts, names).collect()} == {(1, "s"), (3, "t")}
