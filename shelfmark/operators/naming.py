"""Names for new files, free in their folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split_name(name: Column) -> tuple[Column, Column]:
    """Stem and extension (with its dot); a dot at the start is no extension."""
    has = name.rlike(r"(?s)^.+\.[^.]*\z")
    return F.when(has, F.regexp_extract(name, r"(?s)^(.+)(\.[^.]*)\z", 1)).otherwise(name), F.when(has, F.regexp_extract(name, r"(?s)^(.+)(\.[^.]*)\z", 2)).otherwise("")


def free_names(new: DataFrame, there: DataFrame) -> DataFrame:
    """(id, folder, free) of new files (id, folder, name): a name that no file there (folder, name) and no other new one shows, letters
    of either case being equal.

    The first (by id) of the new files of a name keeps it where it is free. The others, in order, take «stem (n).ext» with the smallest
    numbers from 2 on that are free. With the taken numbers t(1) < t(2) < … of a stem, t(j) - 1 - j numbers are free below t(j), so
    the i-th new file gets i + 1 and one more for each j with t(j) - 1 - j < i: one sort of both sides together finds these counts.
    Files without a folder keep their names.
    """
    low = lambda c: F.lower(F.col(c))
    inside = new.where("folder is not null")
    shown = there.where("folder is not null").select("folder", low("name").alias("name")).distinct()
    taken = shown.withColumn("taken", F.lit(True))
    rank = F.row_number().over(Window.partitionBy("folder", low("name")).orderBy("id"))
    asked = inside.select("id", "folder", F.col("name").alias("shown"), low("name").alias("name"), rank.alias("rank")).join(taken, ["folder", "name"], "left")
    keeps = F.col("taken").isNull() & (F.col("rank") == 1)
    keep, rest = asked.where(keeps), asked.where(~keeps)

    stem, ext = split_name(F.col("name"))
    number = F.regexp_extract(stem, r"(?s)^.* \(([1-9]\d{0,8})\)\z", 1)
    used = shown.unionAll(keep.select("folder", "name")).where(number != "")
    used = used.select("folder", F.regexp_extract(stem, r"(?s)^(.*) \([1-9]\d{0,8}\)\z", 1).alias("stem"), ext.alias("ext"), number.cast("long").alias("t")).where("t >= 2")
    base = ["folder", "stem", "ext"]
    used = used.withColumn("j", F.row_number().over(Window.partitionBy(*base).orderBy("t")))
    marks = used.select(*base, (F.col("t") - F.col("j")).alias("at"), F.lit(0).alias("side"), F.lit(None).cast(dict(new.dtypes)["id"]).alias("id"), F.lit(None).cast("string").alias("shown"))
    own_stem, own_ext = split_name(F.col("shown"))
    rest = rest.select("id", "folder", "shown", F.lower(own_stem).alias("stem"), F.lower(own_ext).alias("ext"))
    rest = rest.select(*base, F.row_number().over(Window.partitionBy(*base).orderBy("id")).cast("long").alias("at"), F.lit(1).alias("side"), "id", "shown")
    before = F.count_if(F.col("side") == 0).over(Window.partitionBy(*base).orderBy("at", "side", "id"))
    found = marks.unionByName(rest).withColumn("n", F.col("at") + 1 + before).where("side = 1")
    numbered = found.select("id", "folder", F.concat(own_stem, F.lit(" ("), F.col("n").cast("string"), F.lit(")"), own_ext).alias("free"))
    plain = new.where("folder is null").select("id", "folder", F.col("name").alias("free"))
    return numbered.unionByName(keep.select("id", "folder", F.col("shown").alias("free"))).unionByName(plain)
