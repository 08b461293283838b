"""Multi-valued tags: maps of lists, overlays, values that rows agree on, cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_VALUES = 50


def overlaid(own: Column, row: Column | None) -> Column:
    """own with the keys of row put over it; a key with an empty list goes. A null overlay changes nothing."""
    none = F.create_map().cast("map<string,array<string>>")
    both = F.map_zip_with(F.coalesce(own, none), F.coalesce(row, none), lambda _, a, b: F.coalesce(b, a))
    return F.map_filter(both, lambda _, v: F.size(v) > 0)


def cleaned(values: Column) -> Column:
    """Trimmed, without empty and repeated values, in first order, at most 50."""
    return F.slice(F.array_distinct(F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != "")), 1, MOST_VALUES)


def agreed(value: Column | str) -> Column:
    """The aggregate that gives the value all rows share, else null."""
    value = F.col(value) if isinstance(value, str) else value
    return F.when((F.min(value) == F.max(value)) & (F.count(value) == F.count(F.lit(1))), F.min(value))


def parsed(json: Column) -> Column:
    """A tag map from JSON text; single values become lists, malformed text an empty map."""
    lists = F.from_json(json, "map<string,array<string>>")
    plain = F.transform_values(F.from_json(json, "map<string,string>"), lambda _, v: F.array(v))
    return F.coalesce(lists, plain, F.create_map().cast("map<string,array<string>>"))


def split_number(value: Column) -> Column:
    """'3/12' as (number, total)."""
    return F.struct(F.regexp_extract(value, r"^0*(\d+)", 1).try_cast("int").alias("number"), F.regexp_extract(value, r"/0*(\d+)$", 1).try_cast("int").alias("total"))


def in_display_order(names: Column, known: list[str], performer: str = "performer:") -> Column:
    """Known names in their order, then performers, then the others by name."""
    rank = lambda n: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, known)), n), F.lit(0).cast("long")), F.when(n.startswith(performer), F.lit(10_000)).otherwise(20_000).cast("long"))
    return F.transform(F.array_sort(F.transform(names, lambda n: F.struct(rank(n).alias("rank"), n.alias("name")))), lambda x: x["name"])


def same(a: Column, b: Column) -> Column:
    """Whether two value lists say the same; none is an empty one."""
    none = F.array().cast("array<string>")
    return F.coalesce(a, none) == F.coalesce(b, none)
