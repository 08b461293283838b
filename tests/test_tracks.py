"""Track lists, heard tracks and duplicate entries in single cases."""

import pathlib
import random

from pyspark.sql import functions as F

from shelfmark.functions.text import exact_key, fold_latin
from shelfmark.operators import tracks
from shelfmark.plans import curation, editions  # noqa: F401
from shelfmark.plans.catalogue import QUERIES

FILE = "edition int, id int, disc int, track int, title string, name string, title_key string, seconds double, lossless boolean, audio string, linked int, role string"
ENTRY = "edition int, track int, name string, title_key string, listed int, position int"


def file(id, track, title, seconds=100.0, lossless=False, audio=None, linked=None, role=None, disc=1, edition=1):
    return edition, id, disc, track, title, title.lower(), title.lower().split(" (")[0], seconds, lossless, audio, linked, role


def listed(spark, files, entries=(), heard=()):
    got = tracks.track_lists(spark.createDataFrame(files, FILE), spark.createDataFrame(list(entries), ENTRY), spark.createDataFrame(list(heard), "file int, track int"))
    return sorted((r["disc"], r["position"], r["files"], r["track"], r["new_disc"], r["new_position"], r["relinked"]) for r in got.collect())


def test_images_and_extras(spark):
    files = [file(1, 1, "a"), file(2, 2, "b"), file(3, None, "disc", 1501.0)]
    assert [x[2] for x in listed(spark, files)] == ["1", "2", "3"]  # two others only
    assert [x[2] for x in listed(spark, [*files, file(4, 3, "c", role="extra")])] == ["1", "2", "3"]
    assert [x[2] for x in listed(spark, [*files, file(4, 3, "c", 1500.0)])] == ["1", "2", "4"]


def test_followers_of_followers(spark):
    files = [
        file(1, None, "x", 50.0, audio="s"), file(2, None, "y", 90.0, audio="s"),  # one sound: 2 follows 1
        file(3, None, "y", 51.0), file(4, None, "y", 90.0),  # y's first file lies in 1's row, so lengths go by that
        file(5, None, "z", 51.0, audio="t"), file(6, None, "y", None, audio="t"), file(7, 9, "Z", 10.0),  # 5 is no copy of 7
    ]
    assert [x[2] for x in listed(spark, files)] == ["7", "1,2,3", "4", "5,6"]


def brute_rows(files):
    groups, by_audio, by_name = {}, {}, {}
    for f in sorted(files, key=lambda f: (f[3] is None, f[1])):
        _, i, disc, track, _, name, _, seconds, _, audio, *_ = f
        twin = by_name.get(name)
        first = groups[twin][0][7] if twin is not None else None
        close = twin is not None and (seconds is None or first is None or abs(seconds - first) <= 2)
        key = by_audio[audio] if audio in by_audio else (disc, track, name) if track is not None else twin if close else i
        groups.setdefault(key, []).append(f)
        if audio is not None:
            by_audio.setdefault(audio, key)
        by_name.setdefault(name, key)
    return sorted(",".join(map(str, sorted(f[1] for f in g))) for g in groups.values())


def test_rows_equal_step_by_step(spark):
    r = random.Random(6)
    by_edition = {e: [file(100 * e + i, r.choice([None, None, 1, 2]), r.choice("abcde"), r.choice([None, 10.0, 11.0, 14.0, 16.5]), audio=r.choice([None, None, "p", "q", "r"]), disc=r.choice([1, 2]), edition=e) for i in range(14)] for e in range(40)}
    got = tracks.track_lists(spark.createDataFrame([f for x in by_edition.values() for f in x], FILE), spark.createDataFrame([], ENTRY)).collect()
    for e, files in by_edition.items():
        assert sorted(x["files"] for x in got if x["edition"] == e) == brute_rows(files)


def test_tracks_new_ones_and_relinks(spark):
    files = [file(1, 1, "One", linked=11), file(2, 2, "Two"), file(3, 3, "Three"), file(4, 4, "Three (live)"), file(5, 5, "Five", linked=99), file(6, 1, "Six", disc=2)]
    entries = [(1, 11, "one", "one", 1, 4), (1, 12, "two", "two", 1, 7), (1, 13, "three", "three", 1, 2)]
    assert listed(spark, files, entries, [(6, 12), (1, 13)]) == [(1, 1, "1", 11, None, None, ""), (1, 2, "2", 12, None, None, "2"), (1, 3, "3", 13, None, None, "3"), (1, 4, "4", None, 1, 8, "4"), (1, 5, "5", None, 1, 9, "5"), (2, 1, "6", None, 1, 10, "6")]
    assert listed(spark, files[5:], entries, [(6, 12)]) == [(2, 1, "6", 12, None, None, "6")]
    assert listed(spark, files[4:]) == [(1, 1, "5", None, 1, 1, "5"), (2, 1, "6", None, 2, 1, "6")]


def test_heard_in_editions_with_equal_ids(spark):
    files = [file(1, 1, "One", edition=1), file(1, 1, "Uno", edition=2)]
    entries = [(e, t, n, n, 1, t) for e in (1, 2) for t, n in ((5, "x"), (6, "y"))]
    heard = spark.createDataFrame([(1, 1, 5), (2, 1, 6)], "edition int, file int, track int")
    got = tracks.track_lists(spark.createDataFrame(files, FILE), spark.createDataFrame(entries, ENTRY), heard).collect()
    assert sorted((r["edition"], r["files"], r["track"]) for r in got) == [(1, "1", 5), (2, "1", 6)]


def test_heard(spark):
    evidence = [(1, 10), (2, 10), (2, 11), (3, 11), (3, 12), (3, 12), (4, 13), (4, 14), (5, 20), (5, 21)]
    rows = [(1, 10), (1, 11), (2, 11), (2, 13), (3, 12), (4, 12), (5, 14), (6, 14), (6, 14)]
    got = tracks.heard(spark.createDataFrame(evidence, "file int, track int"), spark.createDataFrame(rows, "edition int, track int")).collect()
    assert sorted(map(tuple, got)) == [(1, 10), (3, 11), (4, 14), (5, 20)]  # 2: an edition lists both


def test_duplicates(spark):
    entries = [(1, 1, "Etude", 100.0), (1, 2, "Étude", 102.0), (1, 3, "Étude!", 9000.0), (1, 4, "Other", None), (1, 5, "Else", None), (1, 6, "etude", None), (2, 7, "Etude", None)]
    rows = [(1, 100, 1, None), (1, 101, 2, "Étude"), (1, 100, 6, None), (1, 102, 5, "Other (2)")]
    files = [(1, 102, 4, 40, "s", 10.0), (1, 103, 5, 50, "t", 10.0), (1, 104, 3, 30, None, 12.0), (1, 105, 5, 51, None, 10.5), (1, 106, 4, 41, "s", 1.0)]
    f = spark.createDataFrame(files, "release int, edition int, track int, file int, audio string, seconds double")
    make = lambda masters: sorted(map(tuple, tracks.duplicate_entries(spark.createDataFrame(entries, "release int, track int, title string, ms double"), spark.createDataFrame(rows, "release int, edition int, track int, title string"), f, spark.createDataFrame(masters, "a int, b int")).collect()))
    # 6 stands beside 1 in edition 100, 4 and 5 beside each other in 102; 3 is too long for 1 and 2, but 6 has no length
    plain = [(1, 1, "1,2", "Étude", "title"), (1, 3, "6,3", "Étude!", "title")]
    assert make([]) == plain
    assert make([(30, 51)]) == [plain[0], (1, 3, "6,5,3", "Étude!", "recording,title")]
    assert make([(30, 41)]) == plain  # lengths too far apart


def test_large_editions_are_equal_in_rounds(spark):
    r = random.Random(8)
    files, entries = [], []
    for e in range(30):
        titles = [r.choice("abcdef") + r.choice(["", " (live)"]) for _ in range(r.choice([2, 5, 12]))]
        files += [file(100 * e + i, r.choice([None, 1, 2, 3]), t, r.choice([None, 10.0, 11.0, 14.0, 1600.0]), r.random() < 0.3, r.choice([None, None, "p", "q"]), r.choice([None, None, 1, 2, 7]), r.choice([None, "extra", "log"]), r.choice([1, 2]), e) for i, t in enumerate(titles)]
        entries += [(e, r.randrange(1, 9), t.lower(), t.split(" (")[0], r.randrange(3), r.randrange(20)) for t in titles if e % 4]
    heard = [(f[1], r.randrange(1, 9)) for f in files if r.random() < 0.3]
    a, b, c = spark.createDataFrame(files, FILE), spark.createDataFrame(entries, ENTRY), spark.createDataFrame(heard, "file int, track int")
    whole, mixed, rounds = (sorted(map(str, tracks.track_lists(a, b, c, most).collect())) for most in (500, 12, 0))
    assert len(whole) > 80 and whole == mixed == rounds


def test_lines_move_once_to_each_key_and_none_is_stored(spark):
    at = pathlib.Path(spark.conf.get("spark.checkpoint.dir")) / "tables"
    for name, moves in (("edition_track_lists", 3), ("generated_tracks", 3), ("duplicate_entries", 5)):  # lines and parts by part, lines by order or lines and orders by order, lines by release
        before = set(at.glob("*/*.parquet"))
        plan = QUERIES[name].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert sum(spark.read.parquet(str(p)).count() for p in set(at.glob("*/*.parquet")) - before) == 0
        assert plan.count("Exchange hashpartitioning") <= moves


def test_duplicates_among_all_releases(spark):
    got = QUERIES["duplicate_entries"].run(spark, "/root/testdata/sf0.001").select("release").distinct().collect()
    assert {r["release"] % 3 for r in got} == {0, 1, 2}


def test_large_releases_are_equal_by_joins(spark):
    r = random.Random(9)
    facts = []
    for release in range(40):
        title, ms = {t: r.choice(["Etude", "Étude", "etude!", "Song", "song", "Other"]) for t in range(9)}, {t: r.choice([None, 1000.0, 3500.0, 9000.0]) for t in range(9)}
        named = lambda t: (t, exact_key(t), fold_latin(t) == t) if t else (None, None, None)
        for _ in range(r.choice([3, 8, 30])):
            t, edition = r.randrange(9), release * 10 + r.randrange(8)
            row = (edition, t, *named(r.choice([None, title[t], "Étude"]))) if r.random() < 0.6 else None
            file = (edition, t, edition * 10 + r.randrange(9), r.choice([None, None, "p", "q"]), 10.0 + t) if r.random() < 0.6 else None
            facts.append((release, (t, *named(title[t]), ms[t]), row, file))
    name = "title: string, key: string, plain: boolean"
    kind = f"release long, entry struct<track: long, {name}, ms: double>, row struct<edition: long, track: long, {name}>, file struct<edition: long, track: long, file: long, audio: string, seconds: double>"
    df = spark.createDataFrame(facts, kind)
    whole, mixed, joins = (sorted(map(str, tracks.duplicate_entries_of(df, lambda a, b: (a + b) % 5 == 0, most_in_row=most).collect())) for most in (200, 10, 0))
    assert len(whole) > 15 and whole == mixed == joins


def test_lines_without_an_order_are_in_no_edition(spark, tmp_path):
    for name, key in (("lineitem", "l_orderkey"), ("orders", "o_custkey"), ("part", None)):
        df = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        (df.withColumn(key, F.when(F.col(key) % 17 != 3, F.col(key))) if key else df).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, by in (("edition_track_lists", "edition"), ("duplicate_entries", "release")):
        got = QUERIES[name].run(spark, str(tmp_path)).agg(F.count(F.lit(1)), F.count(by)).first()
        assert got[0] == got[1] > 0
