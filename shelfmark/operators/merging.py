"""Merging folder trees by name, with the files that follow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.graph import context, kept


def merge_steps(folders: DataFrame, moves: DataFrame, most_depth: int = 64) -> DataFrame:
    """(id, into, merges) of moves (id, into): what becomes of each folder that is put into another one, level by level.

    A folder that merges gives its children to its target: plain folders that have a plain one of their name there merge
    with that one, and their children are the next level; all others move there as they are, with all below them. folders: id, parent_id, kind, name (unique for a parent's plain folders).
    """
    children = folders.where("parent_id is not null").select(F.col("id").alias("child"), F.col("parent_id").alias("id"), "kind", "name")
    named = folders.where("kind = 'plain' and parent_id is not null").groupBy(F.col("parent_id").alias("into"), "name").agg(F.min("id").alias("there"))
    levels = [kept(moves.select("id", "into", F.lit(True).alias("merges")))]
    for _ in range(most_depth + 1):
        last = levels[-1].where("merges").select("id", "into")
        met = last.join(children, "id").join(named, ["into", "name"], "left").withColumn("merges", (F.col("kind") == "plain") & F.col("there").isNotNull())
        below = kept(met.select(F.col("child").alias("id"), F.when(F.col("merges"), F.col("there")).otherwise(F.col("into")).alias("into"), "merges"))
        if below.isEmpty():
            out = levels[0]
            for x in levels[1:]:
                out = out.unionByName(x)
            return out
        levels.append(below)
    raise ValueError(f"a cycle, or a path of more than {most_depth} steps")


def merge_folders(folders: DataFrame, files: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The patches that merging makes: folders (id, parent_id, readme, removed) and files (id, folder, release, edition, rights,
    loses_track), changed ones alone.

    folders: id, parent_id, kind, name, readme (a file or null); files: id, folder, rights. No folder of moves lies inside another one
    of them. A merged folder goes; its files, and its readme where the target has none (of several the least), go to the target. Files
    take the release and edition nearest above them in the new tree; those of another release lose their track, and those of unknown
    rights that a merge or a new place brings into a release become the owner's.
    """
    steps = kept(merge_steps(folders, moves))
    merged, moved = steps.where("merges").select("id", "into"), steps.where("not merges").select("id", F.col("into").alias("new_parent"))
    parents = folders.select("id", "parent_id", "kind").join(moved, "id", "left").join(merged.select("id"), "id", "left_anti")
    ends = lambda tree, name: context(tree, ["release", "edition"]).select(F.col("id").alias(f"{name}_folder"), F.col("release").alias(f"{name}_release"), F.col("edition").alias(f"{name}_edition"))
    before = kept(ends(folders.select("id", "parent_id", "kind"), "old"))
    after = kept(ends(parents.select("id", F.coalesce("new_parent", "parent_id").alias("parent_id"), "kind"), "new"))
    f = files.select("id", F.col("folder").alias("old_folder"), "rights").join(merged.select(F.col("id").alias("old_folder"), "into"), "old_folder", "left").withColumn("new_folder", F.coalesce("into", "old_folder"))
    f = f.join(before, "old_folder", "left").join(after, "new_folder", "left")
    other = ~F.col("old_release").eqNullSafe(F.col("new_release"))
    placed = other | ~F.col("old_edition").eqNullSafe(F.col("new_edition"))
    rights = F.when(F.col("new_release").isNotNull() & (F.col("rights") == "unknown"), "own").otherwise(F.col("rights"))
    changed = f.where(F.col("into").isNotNull() | placed).select("id", F.col("new_folder").alias("folder"), F.col("new_release").alias("release"), F.col("new_edition").alias("edition"), rights.alias("rights"), other.alias("loses_track"))
    given = merged.join(folders.select("id", "readme"), "id").where("readme is not null").groupBy(F.col("into").alias("id")).agg(F.min("readme").alias("given"))
    # of a target that merges itself there is none: its files and children have gone on
    has = folders.select("id", "parent_id", "readme").join(given, "id", "left").join(moved, "id", "left").join(merged.select("id", F.lit(True).alias("removed")), "id", "left")
    takes = F.col("given").isNotNull() & F.col("readme").isNull()
    patches = has.where(F.col("removed") | F.col("new_parent").isNotNull() | takes)
    return patches.select("id", F.coalesce("new_parent", "parent_id").alias("parent_id"), F.when(takes, F.col("given")).otherwise(F.col("readme")).alias("readme"), F.coalesce("removed", F.lit(False)).alias("removed")), changed
