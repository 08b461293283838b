"""Releases of a catalogue that may be an edition: who meets whom, how well each fits, and editions compared by their sound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.text import folded
from shelfmark.operators.graph import kept

#: Least length of a title inside another, first characters that a number's match asks for, ms by which lengths may differ.
LEAST_INSIDE, FIRST, LENGTH_MS = 4, 4, 3000
#: Weights of lengths, count, number and title where lengths are known, and of the last three where they are not.
WITH_LENGTHS, WITHOUT = (0.35, 0.25, 0.25, 0.15), (0.5, 0.35, 0.15)
#: Share of the shorter file and score from which a match is one recording; one under that score is another mix.
MATCH_SHARE, MASTER_SCORE = 0.9, 0.93


def plain_number(number: Column) -> Column:
    """A catalogue number without white space, in upper case."""
    return F.upper(F.regexp_replace(number, r"\s", ""))


def contained(keys: DataFrame) -> DataFrame:
    """(short, long): pairs of different keys of which the first, of four characters or more, stands in the second.

    keys (key), distinct. A short key meets only the keys that hold its rarest four characters, so frequent ones bring no pairs.
    """
    size = F.length("key") - LEAST_INSIDE + 1
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), size), lambda i: F.substring("key", i, F.lit(LEAST_INSIDE))))
    held = keys.where(F.length("key") >= LEAST_INSIDE).select("key", F.explode(grams).alias("gram"))
    rare = held.join(held.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "gram").groupBy("key").agg(F.min(F.struct("n", "gram"))["gram"].alias("gram"))
    met = rare.withColumnRenamed("key", "short").join(held.withColumnRenamed("key", "long"), "gram")
    return met.where((F.length("short") < F.length("long")) & F.contains("long", "short")).select("short", "long")


def similar(editions: DataFrame, releases: DataFrame) -> DataFrame:
    """(edition, release): releases that may be an edition.

    editions (edition, title, number), releases (release, group, title, group_title, numbers). Titles are compared folded: equal, or
    one of four characters or more within the other (a release goes by its group's title, if it has one). Or a number of the release,
    without spaces, begins with the edition's, whatever the case, and the titles' first four characters agree. All releases of a
    fitting one's group are listed too. Null titles count as empty; null and empty numbers and null groups fit nothing.
    """
    key = lambda title: folded("title_key", F.coalesce(title, F.lit("")))
    e = editions.select("edition", key(F.col("title")).alias("key"), F.upper("number").alias("number"))
    r = releases.select("release", key(F.coalesce("group_title", "title")).alias("key"), key(F.col("title")).alias("own"), "numbers")
    e_keys, r_keys = e.select("key").distinct(), r.select("key").distinct()
    pairs = contained(e_keys.union(r_keys).distinct())
    both = pairs.select(F.col("short").alias("e_key"), F.col("long").alias("r_key")).union(pairs.select("long", "short")).union(e_keys.select("key", "key"))
    titled = e.select("edition", F.col("key").alias("e_key")).join(both, "e_key").join(r.select("release", F.col("key").alias("r_key")), "r_key").select("edition", "release")
    starts = lambda n: F.transform(F.sequence(F.lit(1), F.length(n)), lambda i: F.substring(n, F.lit(1), i))
    each = r.select("release", F.substring("own", 1, FIRST).alias("first"), F.explode(F.array_distinct(F.transform("numbers", plain_number))).alias("number")).where("number <> ''")
    begun = each.select("release", "first", F.explode(starts(F.col("number"))).alias("number")).distinct()
    numbered = e.select("edition", "number", F.substring("key", 1, FIRST).alias("first")).join(begun, ["number", "first"]).select("edition", "release")
    found = kept(titled.union(numbered).distinct())
    grouped = releases.where("group is not null").select("release", "group")
    whole = found.join(grouped, "release").select("edition", "group").distinct().join(grouped, "group").select("edition", "release")
    return found.union(whole).distinct()


def fit(durations: Column, number: Column, key: Column, c_durations: Column, c_count: Column, c_numbers: Column, c_key: Column) -> Column:
    """How well a release fits an edition, 0 to 1: tracks in number, lengths within 3 s at the same places, number, title.

    Lengths are in ms; null and zero ones are unknown. A release whose list is null has its lengths left out of the weights.
    """
    n, m = F.coalesce(F.size(durations), F.lit(0)), F.coalesce(c_count, F.lit(0))
    count = F.when((n > 0) & (m > 0), 1 - F.abs(m - n) / F.greatest(m, n)).otherwise(0.0)
    near = F.zip_with(durations, c_durations, lambda a, b: F.coalesce((a > 0) & (b > 0) & (F.abs(a - b) <= LENGTH_MS), F.lit(False)))
    lengths = F.when(n > 0, F.size(F.filter(near, lambda x: x)) / F.greatest(n, F.size(c_durations))).otherwise(0.0)
    same = F.exists(F.coalesce(c_numbers, F.array().cast("array<string>")), lambda x: F.coalesce(plain_number(x) == F.upper(number), F.lit(False)))
    numbered = F.when((F.coalesce(number, F.lit("")) != "") & same, 1.0).otherwise(0.0)
    titled = F.when(key == c_key, 1.0).otherwise(0.0)
    a, b, c, d = WITH_LENGTHS
    known = a * lengths + b * count + c * numbered + d * titled
    b, c, d = WITHOUT
    return F.when(c_durations.isNotNull(), known).otherwise(b * count + c * numbered + d * titled)


def ranked(editions: DataFrame, releases: DataFrame) -> DataFrame:
    """(edition, release, score, rank): each edition's candidates, best first, equals by release.

    As in similar; editions have durations, releases durations and count too.
    """
    key = lambda title: folded("title_key", F.coalesce(title, F.lit("")))
    e = editions.select("edition", "number", "durations", key(F.col("title")).alias("key"))
    r = releases.select("release", "numbers", F.col("durations").alias("c_durations"), "count", key(F.coalesce("group_title", "title")).alias("c_key"))
    met = similar(editions, releases).join(e, "edition").join(r, "release")
    score = fit(F.col("durations"), F.col("number"), F.col("key"), F.col("c_durations"), F.col("count"), F.col("numbers"), F.col("c_key"))
    scored = met.select("edition", "release", F.round(score, 6).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("edition").orderBy(F.desc("score"), "release")))


def compared(editions: DataFrame, rows: DataFrame, files: DataFrame, matches: DataFrame) -> DataFrame:
    """(release, track, edition, position, file, relation, share, score): a release's tracks against its editions, by their sound.

    editions (release, edition, date, place): columns, oldest first, undated ones last, then by place; those with neither rows nor files
    are none. rows (release, edition, track, disc, position); files (release, edition, track, file, sha, pcm, seconds), of which a cell
    takes the smallest; matches (a, b, score, matched_ms) with a < b, by sha. A cell with a row alone is nofile. The first file of a track
    is its reference: ref in the first column, new in a later one. The other files are the same (by sha or pcm), other (no match), or by
    their match: over nine tenths of the shorter file master or remix, by score, and part under that. share is that of the cell's own
    file, where its seconds are known.
    """
    cell = ["release", "edition", "track"]
    label = F.when(F.col("disc") > 1, F.concat_ws("-", "disc", "position")).otherwise(F.col("position").cast("string"))
    listed = rows.groupBy(*cell).agg(F.concat_ws(", ", F.transform(F.array_sort(F.collect_list(F.struct("disc", "position", label.alias("label")))), lambda x: x["label"])).alias("position"))
    heard = files.groupBy(*cell).agg(F.min(F.struct("file", "sha", "pcm", "seconds")).alias("f"))
    cells = listed.join(heard, cell, "full")
    used = cells.select("release", "edition").distinct().join(editions, ["release", "edition"])
    column = F.row_number().over(Window.partitionBy("release").orderBy(F.col("date").isNull(), "date", "place"))
    cells = cells.join(used.select("release", "edition", column.alias("column")), ["release", "edition"])
    ref = F.min(F.when(F.col("f").isNotNull(), F.struct("column", "f"))).over(Window.partitionBy("release", "track"))
    cells = cells.withColumn("r", ref).withColumns({"first": F.col("r.column") == F.col("column"), "r": F.col("r.f")})
    later = ~F.col("first") & F.col("f").isNotNull()
    ends = {"a": F.when(later, F.least("f.sha", "r.sha")), "b": F.when(later & F.col("f.sha").isNotNull() & F.col("r.sha").isNotNull(), F.greatest("f.sha", "r.sha"))}
    met = cells.withColumns(ends).join(matches, ["a", "b"], "left")
    same = F.coalesce(F.col("f.sha") == F.col("r.sha"), F.lit(False)) | F.coalesce(F.col("f.pcm") == F.col("r.pcm"), F.lit(False))
    told = heard_as(F.col("f").isNotNull(), F.col("first"), F.col("column") == 1, same, F.col("f.seconds"), F.col("r.seconds"), F.col("score"), F.col("matched_ms"))
    return met.select("release", "track", "edition", "position", "f.file", *(x.alias(name) for name, x in told.items()))


def heard_as(heard: Column, first: Column, oldest: Column, same: Column, seconds: Column, r_seconds: Column, score: Column, matched_ms: Column) -> dict[str, Column]:
    """relation, share and score of a cell, as in compared: whether it has a file, that is its track's first, stands in the release's oldest
    column, and is the same as the reference; then the lengths of both, and their match, if there is one."""
    shorter = F.least(F.coalesce(seconds, F.lit(0.0)), F.coalesce(r_seconds, F.lit(0.0)))
    of = lambda seconds: F.least(F.lit(1.0), matched_ms / 1000 / seconds)
    share = F.when(shorter > 0, of(shorter)).otherwise(0.0)
    by_match = F.when(matched_ms.isNull(), "other").when(share < MATCH_SHARE, "part").when(score >= MASTER_SCORE, "master").otherwise("remix")
    relation = F.when(~heard, "nofile").when(first, F.when(oldest, "ref").otherwise("new")).when(same, "same").otherwise(by_match)
    known = ~first & heard & ~same & matched_ms.isNotNull()
    own = F.when(known, F.when(seconds > 0, of(seconds)).otherwise(share))
    return {"relation": relation, "share": F.round(own, 6), "score": F.when(known, score)}
