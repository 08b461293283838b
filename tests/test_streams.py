"""Leases and matches as streams: equal to the batch, whatever order, repetition or failure."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import tasks
from shelfmark.streaming import stores
from shelfmark.streaming.tasks import event_stream, lease_stream, match_stream

START = datetime(2024, 5, 1)


def event(n, minute, action, worker="w", version=1, spec=None, id=1, error=None):
    return id, START + timedelta(minutes=minute), n, action, worker, version, spec, error


def one(spark, *events):
    r = tasks.leases(spark.createDataFrame(events, tasks.EVENT)).first()
    return r["state"], r["attempts"], r["holder"], r["refused"]


def test_claims(spark):
    claim = lambda n, m, **x: event(n, m, "claim", **x)
    assert one(spark, claim(1, 0), claim(2, 19, worker="v")) == ("running", 1, "w", 1)
    assert one(spark, claim(1, 0), claim(2, 20, worker="v")) == ("running", 2, "v", 0)  # the lease is over
    assert one(spark, claim(1, 0), event(2, 10, "heartbeat"), claim(3, 25, worker="v")) == ("running", 1, "w", 1)
    assert one(spark, claim(1, 0), event(2, 10, "heartbeat", worker="v"), claim(3, 25, worker="v")) == ("running", 2, "v", 1)
    assert one(spark, claim(1, 0), claim(2, 30), claim(3, 60), claim(4, 90)) == ("running", 3, "w", 1)  # no attempt left
    assert one(spark, claim(1, 0), claim(2, 30), claim(3, 60), claim(4, 90, version=2)) == ("running", 1, "w", 0)
    assert one(spark, claim(1, 0), claim(2, 30), claim(3, 60), claim(4, 90, spec="x")) == ("running", 1, "w", 0)


def test_ends(spark):
    claim = event(1, 0, "claim")
    assert one(spark, claim, event(2, 5, "finish")) == ("done", 1, None, 0)
    assert one(spark, claim, event(2, 5, "finish", worker="v")) == ("running", 1, "w", 1)
    assert one(spark, claim, event(2, 5, "finish", version=2)) == ("running", 1, "w", 1)
    assert one(spark, claim, event(2, 5, "finish"), event(3, 60, "claim")) == ("done", 1, None, 1)
    assert one(spark, claim, event(2, 5, "finish"), event(3, 60, "claim", spec="x")) == ("running", 1, "w", 0)
    assert one(spark, claim, event(2, 5, "fail"), event(3, 6, "claim")) == ("running", 2, "w", 0)
    assert one(spark, claim, event(2, 5, "finish"), event(3, 6, "redo"), event(4, 7, "claim")) == ("running", 1, "w", 0)
    assert one(spark, event(1, 0, "redo"), event(2, 1, "fail"), event(3, 1, "what")) == ("open", 0, None, 3)
    assert one(spark, claim, claim, event(2, 5, "fail"), event(2, 5, "fail")) == ("failed", 1, None, 0)  # repeated events
    failed = tasks.leases(spark.createDataFrame([claim, event(2, 5, "fail", error="e" * 900)], tasks.EVENT)).first()
    assert failed["error"] == "e" * 500


def random_events(n, seed=3):
    r = random.Random(seed)
    return [event(i, r.randrange(600), r.choice(["claim", "claim", "heartbeat", "finish", "fail", "redo"]), r.choice("vw"), r.choice([1, 1, 1, 2]), r.choice([None, None, "x"]), r.randrange(12), "e") for i in range(n)]


def test_lease_stream_equals_batch(spark, tmp_path):
    events = sorted(random_events(400), key=lambda e: e[1])
    r = random.Random(7)
    late = sorted(events, key=lambda e: e[1] + timedelta(minutes=r.randrange(50)))  # out of order by less than the delay
    parts = [late[i : i + 80] + late[max(0, i - 10) : i] for i in range(0, 400, 80)]  # and repeated
    for i, part in enumerate(parts):
        at = str(tmp_path / f"{i}")
        spark.createDataFrame(part, tasks.EVENT).coalesce(1).write.parquet(at)
        name = next(x for x in os.listdir(at) if x.endswith(".parquet"))
        os.makedirs(tmp_path / "events", exist_ok=True)
        os.rename(f"{at}/{name}", tmp_path / "events" / f"{i}.parquet")
        os.utime(tmp_path / "events" / f"{i}.parquet", (10**9 + i, 10**9 + i))
    store = str(tmp_path / "store")
    schema = spark.createDataFrame([], tasks.EVENT).schema
    lease_stream(event_stream(spark, str(tmp_path / "events"), schema), store, str(tmp_path / "check"), buckets=4).awaitTermination()
    got = spark.read.parquet(store).drop("bucket")
    want = tasks.leases(spark.createDataFrame(events, tasks.EVENT))
    key = lambda df: sorted(map(str, df.select(*want.columns).collect()))
    assert key(got) == key(want)


VALUE = "id long, v long"


def matching(spark, known):
    """Pairs of ids whose values differ by less than 3, as each batch meets all that is known so far."""

    def match(batch):
        for r in batch.collect():
            known[r["id"]] = r["v"]
        rows = spark.createDataFrame(list(known.items()), VALUE)
        a, b = batch.select(F.col("id").alias("a"), F.col("v").alias("x")), rows.select(F.col("id").alias("b"), F.col("v").alias("y"))
        return a.join(b, (F.col("a") != F.col("b")) & (F.abs(F.col("x") - F.col("y")) < 3)).select("a", "b", F.abs(F.col("x") - F.col("y")).alias("gap"))

    return match


def all_pairs(known):
    return {(a, b, abs(known[a] - known[b])) for a in known for b in known if a < b and abs(known[a] - known[b]) < 3}


def test_match_stream_equals_all_at_once(spark, tmp_path):
    r = random.Random(2)
    for i in range(3):
        rows = [(k, r.randrange(100)) for k in r.sample(range(60), 30)]
        spark.createDataFrame(rows, VALUE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    known, store = {}, str(tmp_path / "store")
    arrivals = event_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], VALUE).schema)
    match_stream(arrivals, matching(spark, known), store, str(tmp_path / "check"), buckets=16).awaitTermination()
    schema = spark.createDataFrame([], "a long, b long, gap long").schema
    assert {tuple(x) for x in stores.pairs(spark, store, schema).select("a", "b", "gap").collect()} == all_pairs(known)


def test_a_batch_writes_its_own_buckets(spark, tmp_path, monkeypatch):
    known, store = {}, str(tmp_path / "store")
    match, schema = matching(spark, known), spark.createDataFrame([], "a long, b long, gap long").schema

    def arrive(rows, batch):
        df = spark.createDataFrame(rows, VALUE)
        return stores.replace_pairs(df.select("id"), match(df), store, batch, buckets=64)

    arrive([(i, 10 * (i // 2)) for i in range(100)], 0)
    files = lambda: {d: sorted(os.listdir(f"{store}/{d}")) for d in os.listdir(store) if d.startswith("bucket")}
    before = files()
    written = arrive([(4, 60)], 1)  # leaves 5, joins 12 and 13
    assert len(written) <= 4 and {d for d, x in files().items() if before.get(d) != x} == {f"bucket={b}" for b in written}
    held = lambda: {tuple(x) for x in stores.pairs(spark, store, schema).select("a", "b", "gap").collect()}
    assert held() == all_pairs(known)

    # a batch that fails half-way leaves the buckets of its old partners; repeated, it finds them by its note
    put = stores.put
    first = {b for b in written}

    def broken(rows, at):
        own = rows.where(F.col("bucket") == rows.agg(F.max("bucket")).first()[0])
        put(own, at)
        raise OSError("lost")

    monkeypatch.setattr(stores, "put", broken)
    with pytest.raises(OSError):
        arrive([(4, 1000), (12, 2000)], 2)
    monkeypatch.setattr(stores, "put", put)
    arrive([(4, 1000), (12, 2000)], 2)
    assert held() == all_pairs(known) and first
    assert arrive([], 3) == []
