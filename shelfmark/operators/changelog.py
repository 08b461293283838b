"""An append-only change log: diffs, upserts, undo and its conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def revisions(events: DataFrame) -> DataFrame:
    """Events as log rows: a batch is a user's day; before is the last value of the same field."""
    field = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return events.select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("at"),
        F.concat_ws(":", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("batch_id"),
        F.col("event_type").alias("entity"),
        F.col("user_id").alias("entity_id"),
        F.col("value").alias("after_v"),
        F.lag("value").over(field).alias("before_v"),
    )


def restored(log: DataFrame) -> DataFrame:
    """For each batch and field the value before its first change; a null before is a value too."""
    first = log.groupBy("batch_id", "entity", "entity_id").agg(F.min_by(F.struct("before_v"), "id").alias("x"))
    return first.select("batch_id", "entity", "entity_id", F.col("x.before_v").alias("restored"))


def conflicts(log: DataFrame) -> DataFrame:
    """(batch_id, conflicts): fields whose value a later batch has changed."""
    last = log.groupBy("batch_id", "entity", "entity_id").agg(F.max(F.struct("id", "after_v")).alias("x"))
    now = last.groupBy("entity", "entity_id").agg(F.max("x").alias("now"))
    changed = last.join(now, ["entity", "entity_id"]).where(~F.col("x.after_v").eqNullSafe(F.col("now.after_v")))
    return changed.groupBy("batch_id").agg(F.count(F.lit(1)).alias("conflicts"))


def diff(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(id, field, before_value, after_value) of the fields that differ, null-safe."""
    o = old.select(F.col(key).alias("id"), F.struct(*(F.col(f).cast("string").alias(f) for f in fields)).alias("o"))
    n = new.select(F.col(key).alias("id"), F.struct(*(F.col(f).cast("string").alias(f) for f in fields)).alias("n"))
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"o.{f}").alias("before_value"), F.col(f"n.{f}").alias("after_value")) for f in fields))
    return o.join(n, "id").select("id", F.explode(each).alias("x")).where(~F.col("x.before_value").eqNullSafe(F.col("x.after_value"))).select("id", "x.*")


def insert_new(base: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Adds the rows whose key is not there yet."""
    return base.unionByName(rows.dropDuplicates(key).join(base, key, "left_anti"))


def upsert(base: DataFrame, rows: DataFrame, key: list[str], refresh: list[str], keep: list[str]) -> DataFrame:
    """New rows are added; of known ones the refresh columns take the new value, the keep columns hold theirs."""
    a = base.select(*key, *(F.col(c).alias(f"__old_{c}") for c in refresh + keep))
    b = rows.select(*key, *(F.col(c).alias(f"__new_{c}") for c in refresh + keep))
    out = [F.coalesce(f"__new_{c}", f"__old_{c}").alias(c) for c in refresh] + [F.coalesce(f"__old_{c}", f"__new_{c}").alias(c) for c in keep]
    return a.join(b, key, "full").select(*key, *out)


def replace_pairs(pairs: DataFrame, ids: DataFrame, new: DataFrame) -> DataFrame:
    """Pairs (a, b) that touch the ids go, the new ones come in canonical order."""
    left = pairs.join(ids.select(F.col("id").alias("a")), "a", "left_anti").join(ids.select(F.col("id").alias("b")), "b", "left_anti")
    fresh = new.withColumns({"a": F.least("a", "b"), "b": F.greatest("a", "b")}).dropDuplicates(["a", "b"])
    return left.unionByName(fresh, allowMissingColumns=True)


def guarded(base: DataFrame, rows: DataFrame, key: str, deleted: DataFrame, parents: DataFrame, parent: str) -> DataFrame:
    """The rows that may be added: not there yet, not deleted in the log, under a parent that exists.

    deleted has the column ``key``, parents the column ``parent``. A second run adds nothing.
    """
    new = rows.dropDuplicates([key]).join(base.select(key), key, "left_anti").join(deleted.select(key), key, "left_anti")
    return new.join(parents.select(parent), parent, "left_semi").select(*rows.columns)


def ensured(folders: DataFrame, entities: DataFrame) -> DataFrame:
    """folders (id, entity_id) with one for each entity (entity_id); new ids come from the entity, so a second run changes nothing."""
    missing = entities.select("entity_id").distinct().join(folders, "entity_id", "left_anti")
    return folders.select("id", "entity_id").unionByName(missing.select(F.concat(F.lit("fd_"), F.left(F.sha1(F.col("entity_id").cast("binary")), F.lit(16))).alias("id"), "entity_id"))


def replaced(derived: DataFrame, outputs: DataFrame, contents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, orphans): the derived rows (content, key) of the contents go, their outputs come; orphans are keys that nothing uses then."""
    rows = derived.join(contents, "content", "left_anti").unionByName(outputs)
    before = derived.join(contents, "content", "left_semi").select("key").distinct()
    return rows, before.join(rows.select("key"), "key", "left_anti")


def refused(made: DataFrame, pointing: DataFrame) -> DataFrame:
    """(batch, later): batches whose made rows (batch, id) other batches' rows (batch, id of what they point to) use by now."""
    uses = pointing.groupBy("id", "batch").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("batch", "by")
    return made.join(uses, "id").where(F.col("by") != F.col("batch")).groupBy("batch").agg(F.sum("n").alias("later"))


def undo_marks(undos: DataFrame) -> DataFrame:
    """(batch, reverted_by) from (batch, undoes): the last undo of a batch marks it, unless that undo was undone itself."""
    standing = undos.join(undos.select(F.col("undoes").alias("batch")), "batch", "left_anti")
    return standing.groupBy(F.col("undoes").alias("batch")).agg(F.max("batch").alias("reverted_by"))
