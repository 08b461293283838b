"""Functions and operators by their pinned behaviour, and by laws where no value is pinned."""

import json
import random

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import parse, tags, text
from shelfmark.operators import changelog, graph, policy, predicates, sequences, tasks
from shelfmark.sources import tables


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_folds():
    assert text.exact_key("Café Ünïcode") == text.exact_key("cafe unicode")
    assert text.exact_key("Smørrebrød Straße œuvre Æon") == "smorrebrodstrasseoeuvreaeon"
    assert text.exact_key("が") != text.exact_key("か") and text.exact_key("ﾃｽﾄ Ａ") == text.exact_key("テスト a")
    assert text.title_key("Night (Live) [2nd mix]") == text.title_key("night") != text.exact_key("Night (Live)")
    assert text.rule_key("Ｆoo：bar\u200b [ガ]") == text.rule_key("foo bar カ")
    assert text.search_key("Ångström") == "angstrom"
    assert sorted(["a10", "a2"], key=text.natural_key) == ["a2", "a10"] and text.slug("Ça va, Łódź?") == "ca-va-lodz"


@pytest.mark.parametrize("name", ["utf-8", "utf-8-sig", "utf-16", "cp932"])
def test_decode(name):
    assert text.decode("あいうえお テスト".encode(name)) == "あいうえお テスト"
    assert text.decode("你好，世界，这是一个测试".encode("gb18030")) == "你好，世界，这是一个测试"


def test_folds_in_columns(spark):
    rows = spark.createDataFrame([("Ä b",), (None,)], "t string").select(text.folded("exact_key", "t").alias("k")).collect()
    assert [r.k for r in rows] == ["ab", None]


def test_parsers(spark):
    r = one(
        spark,
        clip=parse.clip(F.lit("90+60")), share=parse.clip(F.lit("30%+45")), bad=parse.clip(F.lit("120%+45")), short=parse.clip(F.lit("5+5")), ms=parse.time_ms(F.lit("1:02:03.45")), no=parse.time_ms(F.lit("0:75")),
        y=parse.year(F.lit("1999-02")), ny=parse.year(F.lit("1999-13")), ext=parse.extension(F.lit("a/b.TAR.Gz")), stem=parse.stem(F.lit("a/b/01 x.flac")), dir=parse.folder(F.lit("a/b/c.txt")),
        no1=parse.track_number(F.lit("1-03 Name.mp3"), F.lit(None).cast("string")), no2=parse.track_number(F.lit("x"), F.lit("3/12")), title=parse.clean_title(F.lit("01 - Name.mp3"), F.lit("")),
        named=parse.template("{a}[ ({b})]", {"a": F.lit("x"), "b": F.lit("")}), named2=parse.template("{a}[ ({b})]", {"a": F.lit("x"), "b": F.lit("y")}), size=parse.human_size(F.lit(1536)), html=parse.unescaped(F.lit("&lt;a&gt; &amp;amp;")),
    )
    assert (r.clip.start, r.clip.percent, r.clip.length) == (90, False, 60) and r.share.percent and r.bad is None and r.short is None
    assert (r.ms, r.no, r.y, r.ny, r.ext, r.stem, r.dir) == (3723450, None, 1999, None, "gz", "01 x", "a/b")
    assert (r.no1, r.no2, r.title, r.named, r.named2, r.size, r.html) == (3, 3, "Name", "x", "x (y)", "1.5 KB", "<a> &amp;")


def test_rules_are_checked():
    fields = {"name": predicates.Field("text", F.lit("a")), "kind": predicates.Field("enum", F.lit("x"), frozenset({"x"}))}
    for bad in (predicates.Rule("none", "is", 1), predicates.Rule("name", "over", 1), predicates.Rule("kind", "is", "y")):
        with pytest.raises(ValueError):
            predicates.predicate(bad, fields)
    with pytest.raises(ValueError):
        predicates.compiled(predicates.RuleSet("all", (predicates.Rule("name", "is", "a"),) * 21), fields)


def test_empty_rule_set_holds(spark):
    assert spark.range(3).where(predicates.compiled(predicates.RuleSet(), {})).count() == 3


def test_access_rules_agree(spark):
    opts = [None, "full", "clip", "off"]
    rows = [(r, a, b) for r in ("own", "licensed", "third_party", "unknown") for a in opts for b in opts]
    df = policy.effective(spark.createDataFrame(rows, "rights string, own_play string, default_play string")).withColumn("open", policy.open_rows())
    assert df.where((F.col("play") != "off") != F.col("open")).count() == 0


def test_tags(spark):
    r = one(spark, t=tags.overlaid(F.create_map(F.lit("a"), F.array(F.lit("1")), F.lit("b"), F.array(F.lit("2"))), F.create_map(F.lit("b"), F.array().cast("array<string>"), F.lit("c"), F.array(F.lit("3")))), c=tags.cleaned(F.array(F.lit(" x"), F.lit("x"), F.lit(""))), n=tags.split_number(F.lit("03/12")), p=tags.parsed(F.lit('{"k": ["1", "2"]}')), q=tags.parsed(F.lit("broken")))
    assert r.t == {"a": ["1"], "c": ["3"]} and r.c == ["x"] and (r.n.number, r.n.total) == (3, 12) and r.p == {"k": ["1", "2"]} and r.q == {}


def test_components_and_closure(spark):
    r = random.Random(1)
    pairs = [(r.randrange(60), r.randrange(60)) for _ in range(40)]
    up = list(range(60))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    got = {x.node: x.label for x in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: find(i) for p in pairs for i in p if p[0] != p[1]}
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(12)], "id long, parent_id long")
    assert graph.closure(chain).count() == 78


def prints(spark, seqs):
    return spark.createDataFrame(list(seqs.items()), "id long, v array<long>")


def test_matching_of_sequences(spark):
    r = random.Random(5)
    a = [r.getrandbits(32) for _ in range(830)]
    b = [v if r.random() > 0.2 else v ^ (1 << r.randrange(32)) for v in a]
    inside = [r.getrandbits(32) for _ in range(360)] + a[:420] + [r.getrandbits(32) for _ in range(50)]
    alone = [r.getrandbits(32) for _ in range(830)]
    q = prints(spark, {1: a}).withColumnRenamed("id", "q")
    o = prints(spark, {2: b, 3: inside, 4: alone}).withColumnRenamed("id", "o")
    got = {x.o: x for x in sequences.decided(sequences.candidates(q, o), q, o).collect()}
    assert set(got) == {2, 3}
    assert got[2].offset_ms == 0 and got[2].score > 0.9 and got[2].matched_ms > 100_000
    assert abs(got[3].offset_ms - 360 * sequences.STEP_MS) < 200 and 50_000 < got[3].matched_ms < 60_000


def test_log_laws(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", None)], "id long, s string, n int")
    new = spark.createDataFrame([(2, "c", 5), (3, "d", 6)], "id long, s string, n int")
    both = changelog.upsert(base, new, ["id"], refresh=["n"], keep=["s"])
    assert sorted(map(tuple, both.collect())) == [(1, 1, "a"), (2, 5, "b"), (3, 6, "d")]
    again = changelog.insert_new(changelog.insert_new(base, new, ["id"]), new, ["id"])
    assert again.count() == 3
    pairs = spark.createDataFrame([(1, 2, 0.5), (2, 3, 0.6), (3, 4, 0.7)], "a long, b long, score double")
    kept = changelog.replace_pairs(pairs, spark.createDataFrame([(2,)], "id long"), spark.createDataFrame([(5, 2, 0.9)], "a long, b long, score double"))
    assert sorted((x.a, x.b) for x in kept.collect()) == [(2, 5), (3, 4)]


def test_title_groups_as_sql(spark, tmp_path):
    import duckdb

    from shelfmark.plans import matching  # noqa: F401
    from shelfmark.plans.catalogue import QUERIES

    query = QUERIES["title_key_groups"]
    titles = ["Call +1 (915) 555", "call 1 915 555", "Call 1 555", "Ørsted [live]", "orsted", "がぎ", "かき", "Straße", "ΟΔΟΣ ες", "①²ﬁ", "한글 é", "  ", None, "İz", "ẞ"]
    rows = [(i, "u", None if t is None else f"<title>{t}</title>") for i, t in enumerate(titles)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = {tuple(r) for r in con.sql(f"SELECT key, n, first, title FROM ({query.sql})").fetchall()}
    assert {(r["key"], r["n"], r["first"], r["title"]) for r in query.run(spark, str(tmp_path)).collect()} == want


def test_parts_of_a_manifest(spark, tmp_path):
    """The last line is that of the last part, though Spark reads the largest part first."""
    for part, n in ((0, 1), (1, 400), (2, 40)):
        (tmp_path / f"part-{part:05}.json").write_text("".join(json.dumps({"sha256": "x", "duration": float(1000 * part + i)}) + "\n" for i in range(n)))
    assert [r.duration for r in tables.probe_manifest(spark, str(tmp_path)).collect()] == [2039.0]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        assert [r.duration for r in tables.probe_manifest(spark, str(tmp_path)).collect()] == [2039.0]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_sources(spark, tmp_path):
    (tmp_path / "probe.jsonl").write_text("\n".join(json.dumps({"sha256": s, "duration": d}) for s, d in (("x", 1.0), ("y", 2.0), ("x", 3.0))) + "\n\n")
    assert {r.sha256: r.duration for r in tables.probe_manifest(spark, str(tmp_path / "probe.jsonl")).collect()} == {"x": 3.0, "y": 2.0}
    (tmp_path / "a.json").write_text(json.dumps({"sha256": "z", "type": "zip", "status": "ok", "members": [{"path": "m", "size": 1, "crc32": "0", "sha256": "q"}, {"path": "n", "size": 2, "crc32": "1", "sha256": "r"}]}, indent=1))
    assert tables.archive_members(spark, str(tmp_path / "a.json")).count() == 2
    (tmp_path / "list.tsv").write_text("F\ta/b\t3\tt\nD\ta\t0\tt\n")
    assert [r.path for r in tables.inventory(spark, str(tmp_path / "list.tsv")).collect()] == ["a/b"]
    files = tmp_path / "files"
    files.mkdir()
    (files / "one").write_bytes(b"1")
    first = tables.directory_scan(spark, str(files)).cache()
    (files / "two").write_bytes(b"2")
    assert tables.directory_scan(spark, str(files), first).count() == 2
    assert one(spark, p=tables.rebased(F.lit("C:\\root\\a\\b.txt"), "root")).p == "a/b.txt"
    with pytest.raises(Exception, match="outside the root"):
        one(spark, p=tables.rebased(F.lit("C:\\other\\b.txt"), "root"))


def test_queue_limits(spark):
    rows = [("done", 0, "2024-01-01 00:00:00"), ("running", 1, "2024-01-30 11:45:00"), ("running", 1, "2024-01-30 11:30:00"), ("failed", 1, "2024-01-30 11:30:00"), ("failed", 1, "2024-01-30 10:00:00"), ("open", 3, "2024-01-01 00:00:00"), ("running", 3, "2024-01-30 11:00:00")]
    df = spark.createDataFrame(rows, "state string, attempts int, at string").withColumn("at", F.col("at").cast("timestamp"))
    asof = "2024-01-30 12:00:00"
    got = [tuple(r) for r in df.select(tasks.settled(asof).alias("s"), tasks.abandoned(asof).alias("a")).collect()]
    assert got == [(True, False), (True, False), (False, False), (True, False), (False, False), (True, False), (True, True)]


def test_stream_equals_batch(spark, tmp_path):
    from shelfmark.streaming.tasks import event_stream, state_stream

    events = tables.table(spark, "/root/testdata/sf0.001", "events")
    events.repartition(3).write.parquet(str(tmp_path / "events"))
    store, want = str(tmp_path / "states"), sorted(map(tuple, tasks.states(events).collect()))
    for _ in range(2):  # with nothing new, the store stays as it is
        query = state_stream(event_stream(spark, str(tmp_path / "events"), events.schema), store, str(tmp_path / "log"), buckets=4)
        query.awaitTermination()
        assert query.exception() is None
        assert sorted(map(tuple, spark.read.parquet(store).select("id", "state", "at", "attempts").collect())) == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_llm(tmp_path):
    """A copy without the corpus operators still imports and lists the other queries."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/shelfmark", tmp_path / "shelfmark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; names = set(e.queries()); assert len(names) > 150 and 'pipeline' not in names and not any(n.startswith('op') and n[2].isdigit() for n in names); assert set(e.oracle_sql()) <= names"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, check=True)


def test_sinks(spark, tmp_path):
    from shelfmark.sources import sinks

    a = spark.createDataFrame([(1, "x"), (2, None)], "id int, s string")
    sinks.snapshot({"a": a, "meta": a}, str(tmp_path / "b"))
    back = sinks.restore(spark, str(tmp_path / "b"))
    assert sorted(map(str, back["a"].collect())) == sorted(map(str, a.collect())) and back["meta"].count() == 0 and back["meta"].schema == a.schema
    wanted = spark.createDataFrame([("k1", 1), ("k2", 2), ("k3", 3)], "key string, size int")
    there = spark.createDataFrame([("k1", 1), ("k2", 9), ("k4", 4)], "key string, size int")
    assert sorted(r.key for r in sinks.copy_plan(wanted, there).collect()) == ["k2", "k3"]
    assert [r.key for r in sinks.orphans(there, wanted).collect()] == ["k4"]
    blobs = spark.createDataFrame([("k", b"abc", "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad")], "key string, content binary, sha256 string")
    assert [r.ok for r in sinks.verified(blobs).collect()] == [True]
    sinks.manifest_lines(a, "id", str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 2
