"""The work queue's leases and the store of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators import graph, tasks
from shelfmark.plans.catalogue import query
from shelfmark.plans.fields import _folder
from shelfmark.plans.matching import PAIRS, part_pairs
from shelfmark.sources.tables import table
from shelfmark.streaming import stores


def task_events(spark: SparkSession, d: str) -> DataFrame:
    e, kind = F.col("event_id"), F.col("event_type")
    action = F.when(kind == "view", "heartbeat").when(kind == "error", "fail").when(kind == "purchase", "finish").when((kind == "click") & (e % 10 == 0), "redo").otherwise("claim")
    return table(spark, d, "events").select(
        F.col("user_id").cast("long").alias("id"), F.col("ts").cast("timestamp").alias("at"), e.alias("seq"), action.alias("action"), F.concat(F.lit("w"), (e % 2).cast("string")).alias("worker"),
        (F.hour("ts") / 20 + F.lit(1)).cast("int").alias("version"), F.when(e % 50 == 0, "clip").alias("spec"), F.when(kind == "error", F.concat(F.lit("no "), e.cast("string"))).alias("error"),
    )


@query(
    "task_leases",
    """WITH RECURSIVE e AS (SELECT user_id AS id, ts, CASE WHEN event_type = 'view' THEN 'heartbeat' WHEN event_type = 'error' THEN 'fail' WHEN event_type = 'purchase' THEN 'finish' WHEN event_type = 'click' AND event_id % 10 = 0 THEN 'redo' ELSE 'claim' END AS action, 'w' || (event_id % 2) AS worker, CAST(floor(hour(ts) / 20 + 1) AS INTEGER) AS version, CASE WHEN event_id % 50 = 0 THEN 'clip' END AS spec, 'no ' || event_id AS error, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    s AS (SELECT DISTINCT id, CAST(0 AS BIGINT) AS n, 'open' AS state, 0 AS attempts, CAST(NULL AS INTEGER) AS version, CAST(NULL AS VARCHAR) AS spec, CAST(NULL AS VARCHAR) AS holder, CAST(NULL AS TIMESTAMP) AS started, CAST(NULL AS VARCHAR) AS error, 0 AS refused FROM e
    UNION ALL SELECT id, n, CASE WHEN NOT ok THEN state WHEN action = 'redo' THEN 'open' WHEN action = 'fail' THEN 'failed' WHEN action = 'finish' THEN 'done' ELSE 'running' END,
      CASE WHEN NOT ok THEN attempts WHEN action = 'redo' THEN 0 WHEN action = 'claim' THEN CASE WHEN fresh THEN 1 ELSE attempts + 1 END ELSE attempts END,
      CASE WHEN NOT ok THEN version WHEN action = 'redo' THEN NULL WHEN action = 'claim' THEN v ELSE version END, CASE WHEN NOT ok THEN spec WHEN action = 'redo' THEN NULL WHEN action = 'claim' THEN sp ELSE spec END,
      CASE WHEN NOT ok THEN holder WHEN action = 'claim' THEN worker WHEN action = 'heartbeat' THEN holder END, CASE WHEN NOT ok THEN started WHEN action = 'redo' THEN NULL WHEN action IN ('claim', 'heartbeat') THEN ts ELSE started END,
      CASE WHEN NOT ok OR action = 'heartbeat' THEN error WHEN action = 'fail' THEN err END, refused + CASE WHEN ok THEN 0 ELSE 1 END
    FROM (SELECT *, CASE action WHEN 'redo' THEN state <> 'open' WHEN 'claim' THEN NOT (state = 'running' AND started > ts - INTERVAL 480 MINUTE) AND (fresh OR NOT (state = 'done' OR attempts >= 3)) ELSE state = 'running' AND holder = worker AND version = v END AS ok
      FROM (SELECT s.* EXCLUDE (n), e.n, e.ts, e.action, e.worker, e.version AS v, e.spec AS sp, e.error AS err, s.state = 'open' OR s.version < e.version OR s.spec IS DISTINCT FROM e.spec AS fresh FROM s JOIN e ON e.id = s.id AND e.n = s.n + 1)))
    SELECT id, x.state AS state, x.attempts AS attempts, x.version AS version, x.spec AS spec, x.holder AS holder, x.started AS started_at, x.error AS error, x.refused AS refused FROM (SELECT id, arg_max({'state': state, 'attempts': attempts, 'version': version, 'spec': spec, 'holder': holder, 'started': started, 'error': error, 'refused': refused}, n) AS x FROM s GROUP BY id)""",
)
def task_leases(spark: SparkSession, d: str) -> DataFrame:
    """Claims, heartbeats, ends and redos of two workers, with leases of eight hours."""
    return tasks.leases(task_events(spark, d), tasks.Queue(lease_minutes=480))


@query(
    "pair_store",
    f"WITH {PAIRS} SELECT a, b, q FROM pairs WHERE a % 7 > 0 AND b % 7 > 0 OR q % 2 = 0",
)
def pair_store(spark: SparkSession, d: str) -> DataFrame:
    """Pairs written to a bucketed store; then a batch of ids is matched anew, and its pairs alone are replaced."""
    found = graph.kept(part_pairs(spark, d).select("a", "b", "q"))
    at = _folder(spark, "pairs")
    ids = table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    stores.replace_pairs(ids, found, at, 0)
    stores.replace_pairs(ids.where("id % 7 = 0"), found.where("(a % 7 = 0 or b % 7 = 0) and q % 2 = 0"), at, 1)
    return stores.pairs(spark, at, found.schema)
