"""The work queue and incremental matching as streams: the same results as in batch, kept up to date in bucketed stores."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shelfmark.operators import tasks
from shelfmark.streaming import stores


def state_stream(events: DataFrame, store: str, checkpoint: str, buckets: int = 64, trigger: dict | None = None) -> StreamingQuery:
    """Task states (id, state, at, attempts) from a stream of events, kept in a folder; by default, all that is there and then an end.

    Only keys that a batch changed leave the stream's state (one small row for each key), and only the buckets they fall into are
    written anew. A repeated batch writes the same rows again.
    """
    writer = tasks.states(events).writeStream.outputMode("update").foreachBatch(lambda batch, _: stores.update_latest(batch, store, buckets=buckets))
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def event_stream(spark: SparkSession, folder: str, schema, files_in_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_in_batch).parquet(folder)


def lease_stream(events: DataFrame, store: str, checkpoint: str, delay: str = "1 hour", queue: tasks.Queue = tasks.Queue(), buckets: int = 64, trigger: dict | None = None) -> StreamingQuery:
    """Tasks (tasks.LEASED) from a stream of events (tasks.EVENT) that may come out of order, by up to ``delay``, and repeatedly.

    A key's state is its task after all events that the watermark has passed, and the later events in a list; what is written is the
    task after those too. An event that comes after its place was passed is left out.
    """

    def step(key: tuple, parts, state: GroupState):
        folded, pending = map(json.loads, state.get) if state.exists else (tasks.NOTHING, [])
        came = [{k: None if pd.isna(v) else v for k, v in e.items() if k != "time"} for part in parts for e in part.to_dict("records")]
        came = [e | {k: int(e[k]) for k in ("at", "seq", "version") if e[k] is not None} for e in came]
        pending = sorted({(e["at"], e["seq"]): e for e in pending + came}.values(), key=lambda e: (e["at"], e["seq"]))
        passed = state.getCurrentWatermarkMs() * 1000
        folded = queue.folded(folded, [e for e in pending if e["at"] < passed])
        pending = [e for e in pending if e["at"] >= passed]
        state.update((json.dumps(folded), json.dumps(pending)))
        yield pd.DataFrame([tasks.leased_row(int(key[0]), queue.folded(folded, pending))]).astype({"version": "Int64", "started": "Int64"})

    rows = events.where("id is not null").withWatermark("at", delay).selectExpr("id", "at as time", "unix_micros(at) as at", "seq", "action", "worker", "version", "spec", "error")
    tasks_now = rows.groupBy("id").applyInPandasWithState(step, tasks._MICROS, "folded string, pending string", "update", GroupStateTimeout.NoTimeout)
    writer = tasks_now.writeStream.outputMode("update").foreachBatch(lambda batch, _: stores.update_latest(tasks.as_leased(batch), store, buckets=buckets))
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def match_stream(arrivals: DataFrame, match: Callable[[DataFrame], DataFrame], store: str, checkpoint: str, buckets: int = 256) -> StreamingQuery:
    """Incremental matching: each batch of new or changed sequences (id) is matched by ``match(batch) -> pairs (a, b, ...)``, and the
    pairs that touch its ids are replaced in the store, of which only the buckets of these ids and their partners are written."""

    def step(batch: DataFrame, number: int) -> None:
        stores.replace_pairs(batch.select("id"), match(batch), store, number, buckets)

    return arrivals.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
