"""Merged folder trees and the backup in single cases."""

import hashlib

from pyspark.sql import functions as F

from shelfmark.operators import merging
from shelfmark.sources import backup

FOLDER = "id string, parent_id string, kind string, name string, readme int"
from shelfmark.operators import graph
from shelfmark.plans import matching
from shelfmark.streaming import stores


def test_merge_folders(spark):
    folders = [
        ("R", None, "release", "R", None), ("a", "R", "plain", "old", 90), ("a1", "a", "plain", "scans", 91), ("a11", "a1", "plain", "x", None), ("a2", "a", "plain", "Scans", None), ("a3", "a", "edition", "cd", None), ("a31", "a3", "plain", "in", None),
        ("S", None, "release", "S", None), ("b", "S", "plain", "new", None), ("b1", "b", "plain", "scans", 95), ("b11", "b1", "plain", "y", None), ("b3", "b", "plain", "cd", None), ("c", None, "plain", "loose", None), ("c1", "c", "plain", "x", None),
    ]
    files = [(1, "a", "unknown"), (2, "a1", "own"), (3, "a11", "unknown"), (4, "a2", "licensed"), (5, "a31", "unknown"), (6, "b1", "unknown"), (7, "R", "unknown"), (8, "c1", "unknown")]
    f, g = spark.createDataFrame(folders, FOLDER), spark.createDataFrame(files, "id int, folder string, rights string")
    steps = {tuple(r) for r in merging.merge_steps(f, spark.createDataFrame([("a", "b")], "id string, into string")).collect()}
    assert steps == {("a", "b", True), ("a1", "b1", True), ("a11", "b1", False), ("a2", "b", False), ("a3", "b", False)}
    places, changed = merging.merge_folders(f, g, spark.createDataFrame([("a", "b")], "id string, into string"))
    assert {tuple(r) for r in places.collect()} == {("a", "R", 90, True), ("a1", "a", 91, True), ("a11", "b1", None, False), ("a2", "b", None, False), ("a3", "b", None, False), ("b", "S", 90, False)}
    assert {tuple(r) for r in changed.collect()} == {(1, "b", "S", None, "own", True), (2, "b1", "S", None, "own", True), (3, "a11", "S", None, "own", True), (4, "a2", "S", None, "licensed", True), (5, "a31", "S", "a3", "own", True)}
    _, loose = merging.merge_folders(f, g, spark.createDataFrame([("a1", "c")], "id string, into string"))
    assert {tuple(r) for r in loose.collect()} == {(2, "c", None, None, "own", True), (3, "c1", None, None, "unknown", True)}


def test_backup(spark, tmp_path):
    text = lambda i: f"content {i}"
    rows = [(hashlib.sha256(text(i).encode()).hexdigest(), len(text(i)), bytearray(text(i).encode())) for i in range(30)]
    store = str(tmp_path / "store")
    df = spark.createDataFrame(rows + rows[:5], backup.BLOB)
    assert backup.copy_missing(df.where(F.col("sha256") < "8"), store).count() == sum(r[0] < "8" for r in rows)
    assert {r["sha256"] for r in backup.copy_missing(df, store).collect()} == {r[0] for r in rows if r[0] >= "8"}
    assert backup.copy_missing(df, store).count() == 0 and backup.backed(spark, store).count() == 30
    assert backup.read_back(spark, store, 10, 1).where("intact").count() == 10
    spark.createDataFrame([("f" * 64, 3, bytearray(b"bad"))], backup.BLOB).write.mode("append").parquet(store)
    found = {r["sha256"]: r["intact"] for r in backup.read_back(spark, store, 100, 1).collect()}
    assert len(found) == 31 and [k for k, ok in found.items() if not ok] == ["f" * 64]
    one, two = ({r["sha256"] for r in backup.read_back(spark, store, 8, s).collect()} for s in (1, 2))
    assert len(one) == len(two) == 8 and one != two


def test_shares_of_a_task_do_not_grow(spark):
    """Rows are dealt out by their number, whatever the session's number of partitions."""
    rows = spark.range(10)
    assert [graph.dealt(rows, n, "id", most=3).rdd.getNumPartitions() for n in (0, 3, 4, 10)] == [1, 1, 2, 4]


def test_pairs_of_parts_with_repeated_lines(spark, tmp_path):
    lines = [(1, 5, 2.0), (1, 5, 3.0), (1, 6, 10.0), (1, 7, None), (2, 6, 1.0), (2, 5, 1.0), (3, 5, 4.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    found = matching.part_pairs(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == [(5, 6, 2, 27.0), (5, 7, 1, None), (6, 7, 1, None)]
    assert "distinct" not in found._jdf.queryExecution().optimizedPlan().toString()  # orders are not counted by a second exchange


def test_first_batch_of_a_store_is_written_once(spark, tmp_path, monkeypatch):
    made = []
    monkeypatch.setattr(stores, "kept", lambda df: made.append(df.columns) or graph.kept(df))
    pairs = spark.createDataFrame([(1, 2, 0.5), (3, 1, 0.6)], "a long, b long, q double")
    stores.replace_pairs(spark.range(5), pairs, str(tmp_path / "store"), 0, 4)
    assert [c for c in made if "a" in c] == [["a", "b", "q"]]  # one way, and not once more with the store
    stores.replace_pairs(spark.createDataFrame([(1,)], "id long"), pairs.where("a = 1"), str(tmp_path / "store"), 1, 4)
    assert [tuple(r) for r in stores.pairs(spark, str(tmp_path / "store"), pairs.schema).collect()] == [(1, 2, 0.5)]
