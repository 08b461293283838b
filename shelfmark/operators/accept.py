"""Accepting suggestions: what would become of each file, and of the catalogue, before anything is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.graph import kept

#: The least confidence that is taken for many files at once, and how many destinations a summary names.
LEAST_CONFIDENCE, DESTINATIONS = 0.5, 8


def members_of(archives: DataFrame, files: DataFrame, most_depth: int = 64) -> DataFrame:
    """The ids of all files inside the archives (id), at any depth, level by level."""
    links = files.where("member_of is not null").select("id", "member_of")
    levels = [kept(links.join(archives.select(F.col("id").alias("member_of")), "member_of", "left_semi").select("id").distinct())]
    for _ in range(most_depth):
        below = kept(links.join(levels[-1].select(F.col("id").alias("member_of")), "member_of", "left_semi").select("id").distinct())
        if below.isEmpty():
            break
        levels.append(below)
    else:
        raise ValueError(f"a cycle, or more than {most_depth} archives in each other")
    out = levels[0]
    for x in levels[1:]:
        out = out.unionAll(x)
    return out.distinct()


def place(release: str, era: str, slot: str, edition: str, folder: str) -> Column:
    """The place that a suggestion names as a path; null for none."""
    below = F.when(F.col(slot).isNotNull(), F.concat(F.col(slot), F.lit(":"), F.coalesce(edition, F.lit(""))))
    path = F.concat_ws("/", F.coalesce(release, era), below, folder)
    return F.when(path != "", path)


def decided(files: DataFrame, slots: set[str], least: float = LEAST_CONFIDENCE) -> DataFrame:
    """The files (id) with outcome, place, and the rights, role and readme they get.

    files: id, member_of, sealed_in, archive (can be kept whole), and a suggestion in rule (null: none), confidence, release_id, era_id,
    slot, edition, folder, seal, readme, rights, role, state. Outcomes, the first that holds: hidden (lies in a sealed archive already);
    inside (of an archive that these suggestions seal, so it isn't filed by itself); none; unsure (of more than one file); no type (its
    edition type is gone); ignored; accepted; and nothing, where a suggestion gives no place, rights, role or seal.
    """
    many = files.limit(2).count() > 1
    visible = F.col("sealed_in").isNull()
    sure = F.col("rule").isNotNull() & ((F.col("confidence") >= least) | F.lit(not many))
    seals = F.coalesce(F.col("seal") & F.col("archive"), F.lit(False))
    inside = members_of(files.where(visible & sure & seals).select("id"), files).withColumn("inside", F.lit(True))
    gone = F.col("slot").isNotNull() & F.col("release_id").isNotNull() & ~F.col("slot").isin(*slots)
    at = place("release_id", "era_id", "slot", "edition", "folder")
    gives = at.isNotNull() | F.col("rights").isNotNull() | F.col("role").isNotNull() | seals
    outcome = (
        F.when(~visible, "hidden").when(F.col("inside"), "inside").when(F.col("rule").isNull(), "none").when(~sure, "unsure").when(gone, "no type").when(F.coalesce(F.col("state") == "ignored", F.lit(False)), "ignored").when(gives, "accepted").otherwise("nothing")
    )
    rows = files.join(inside, "id", "left").withColumn("outcome", outcome)
    taken = F.col("outcome") == "accepted"
    return rows.select("id", "outcome", F.when(taken, at).alias("place"), *(F.when(taken, F.col(c)).alias(c) for c in ("rights", "role", "readme")), (taken & seals).alias("sealed"), *(F.when(taken, F.col(c)).alias(c) for c in ("release_id", "slot", "edition")))


def summary(plan: DataFrame, files: DataFrame, editions: DataFrame, places: DataFrame) -> DataFrame:
    """One row: files of each outcome, placed ones, archives sealed and files hidden by that, editions (release, slot, name) and folders
    (place) that would be made, and the destinations of most files as «place (n)»."""
    counted = plan.agg(
        *(F.count_if(F.col("outcome") == o).alias(o.replace(" ", "_")) for o in ("accepted", "ignored", "unsure", "none", "no type", "nothing", "hidden", "inside")),
        F.count_if(F.col("place").isNotNull()).alias("placed"), F.count_if("sealed").alias("sealed"),
    )
    hides = members_of(plan.where("sealed").select("id"), files).join(files.where("sealed_in is null").select("id"), "id", "left_semi").agg(F.count(F.lit(1)).alias("hides"))
    wanted = plan.where("slot is not null and release_id is not null").select("release_id", "slot", F.coalesce("edition", F.lit("")).alias("name")).distinct()
    new = wanted.join(editions.select(F.col("release").alias("release_id"), "slot", "name"), ["release_id", "slot", "name"], "left_anti").agg(F.count(F.lit(1)).alias("editions"))
    parts = F.split("place", "/")
    each = plan.where("place is not null").select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("place")).distinct()
    folders = each.join(places.select("place"), "place", "left_anti").agg(F.count(F.lit(1)).alias("folders"))
    most = plan.where("place is not null").groupBy("place").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "place").limit(DESTINATIONS)
    named = most.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "place", "n"))), lambda x: F.concat(x["place"], F.lit(" ("), x["n"].cast("string"), F.lit(")"))), "; ").alias("destinations"))
    for x in (hides, new, folders, named):  # one row each
        counted = counted.join(F.broadcast(x))
    return counted
