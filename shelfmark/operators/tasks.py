"""A versioned work queue as a fold over its events."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Event types and the states they lead to.
STATES = {"purchase": "done", "error": "failed", "signup": "running"}


def state_of(event: Column) -> Column:
    return F.coalesce(*(F.when(event == e, s) for e, s in STATES.items()), F.lit("open"))


def states(events: DataFrame) -> DataFrame:
    """(id, state, at, attempts): the last event of each key decides, failures are attempts."""
    last = events.groupBy(F.col("user_id").alias("id")).agg(F.max(F.struct("ts", "event_id", "event_type")).alias("x"), F.count_if(F.col("event_type") == "error").alias("attempts"))
    return last.select("id", state_of(F.col("x.event_type")).alias("state"), F.col("x.ts").cast("timestamp").alias("at"), "attempts")


def settled(asof: str, lease_minutes: int = 20, retry_minutes: int = 60, most_attempts: int = 3) -> Column:
    """Done, out of attempts, running within its lease, or failed too short a time ago."""
    now = F.lit(asof).cast("timestamp")
    within = lambda m: F.col("at") > now - F.make_interval(mins=F.lit(m))
    state = F.col("state")
    return (state == "done") | (F.col("attempts") >= most_attempts) | (state == "running") & within(lease_minutes) | (state == "failed") & within(retry_minutes)


def abandoned(asof: str, lease_minutes: int = 20, most_attempts: int = 3) -> Column:
    """Running past its lease with no attempt left."""
    return (F.col("state") == "running") & (F.col("attempts") >= most_attempts) & (F.col("at") <= F.lit(asof).cast("timestamp") - F.make_interval(mins=F.lit(lease_minutes)))


# leases: claims, heartbeats and ends in order

EVENT = "id long, at timestamp, seq long, action string, worker string, version int, spec string, error string"
LEASED = "id long, state string, attempts int, version int, spec string, holder string, started_at timestamp, error string, refused int"
_MICROS = "id long, state string, attempts int, version int, spec string, holder string, started long, error string, refused int"
#: Fixed value: so much of an error is kept.
LONGEST_ERROR = 500


@dataclass(frozen=True)
class Queue:
    """What one event makes of a task.

    A claim takes a task unless it is held (running within its lease), or done or out of attempts for that version and what is asked for
    (``spec``); another spec or a higher version starts to count attempts anew. A heartbeat, an end and a failure count only from the
    holder of the lease, for the version it was given for. Redo forgets the task. Whatever doesn't count is refused.
    """

    lease_minutes: int = 20
    most_attempts: int = 3

    def after(self, task: dict | None, e: dict) -> tuple[dict | None, bool]:
        """The task (none: open) after an event, and whether the event counts."""
        if e["action"] == "redo":
            return None, task is not None
        if e["action"] == "claim":
            fresh = task is None or task["version"] < e["version"] or task["spec"] != e["spec"]
            held = task is not None and task["state"] == "running" and task["started"] > e["at"] - self.lease_minutes * 60_000_000
            spent = not fresh and (task["state"] == "done" or task["attempts"] >= self.most_attempts)
            if held or spent:
                return task, False
            return {"state": "running", "attempts": 1 if fresh else task["attempts"] + 1, "version": e["version"], "spec": e["spec"], "holder": e["worker"], "started": e["at"], "error": None}, True
        if task is None or task["state"] != "running" or (task["holder"], task["version"]) != (e["worker"], e["version"]):
            return task, False
        if e["action"] == "heartbeat":
            return task | {"started": e["at"]}, True
        if e["action"] == "finish":
            return task | {"state": "done", "holder": None, "error": None}, True
        if e["action"] == "fail":
            return task | {"state": "failed", "holder": None, "error": (e["error"] or "")[:LONGEST_ERROR]}, True
        return task, False

    def folded(self, kept: dict, events: list[dict]) -> dict:
        """kept (task, refused, last: place of the last event) after events in order; a repeated event counts once."""
        task, refused, last = kept["task"], kept["refused"], kept["last"]
        for e in events:
            place = [e["at"], e["seq"]]
            if last is not None and place <= last:
                continue
            last = place
            task, counts = self.after(task, e)
            refused += not counts
        return {"task": task, "refused": refused, "last": last}


NOTHING = {"task": None, "refused": 0, "last": None}


def leased_row(id: int, kept: dict) -> dict:
    return {"id": id, "refused": kept["refused"], **(kept["task"] or {"state": "open", "attempts": 0, "version": None, "spec": None, "holder": None, "started": None, "error": None})}


def events_in_micros(events: DataFrame) -> DataFrame:
    return events.select("id", F.unix_micros("at").alias("at"), "seq", "action", "worker", "version", "spec", "error")


def as_leased(rows: DataFrame) -> DataFrame:
    return rows.select("id", "state", "attempts", "version", "spec", "holder", F.timestamp_micros("started").alias("started_at"), "error", "refused")


def leases(events: DataFrame, queue: Queue = Queue()) -> DataFrame:
    """The task of each id (LEASED) after all of its events (EVENT), in order of time, then number.

    Partitions are sorted, and one task's state is held at a time; an id's events, which depend on each other, are followed by one task.
    """
    schema = StructType.fromDDL(_MICROS)
    arrow = to_arrow_schema(schema)

    def run(batches):
        at, kept = None, NOTHING
        for b in batches:
            out = []
            for id, own in itertools.groupby(b.to_pylist(), lambda e: e["id"]):
                if id != at:
                    if at is not None:
                        out.append(leased_row(at, kept))
                    at, kept = id, NOTHING
                kept = queue.folded(kept, own)
            yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if at is not None:
            yield pa.RecordBatch.from_pylist([leased_row(at, kept)], schema=arrow)

    rows = events_in_micros(events.where("id is not null")).repartition("id").sortWithinPartitions("id", "at", "seq")
    return as_leased(rows.mapInArrow(run, schema))
