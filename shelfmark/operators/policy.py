"""Access settings capped by rights, and ordered classification rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN_RIGHTS = ("own", "licensed")


def effective(rows: DataFrame) -> DataFrame:
    """Adds visible and play: a row's own setting over its default, under what its rights allow."""
    rights = F.col("rights")
    play = F.coalesce("own_play", "default_play", F.lit("off"))
    return rows.withColumns({"visible": rights != "unknown", "play": F.when(rights.isin(*OPEN_RIGHTS), play).otherwise("off")})


def open_rows() -> Column:
    """The same rule as a predicate: what may be played."""
    return F.col("rights").isin(*OPEN_RIGHTS) & (F.coalesce("own_play", "default_play", F.lit("off")) != "off")


def classified(df: DataFrame, path: Column, rules: list[tuple[str, str, float]]) -> DataFrame:
    """Adds rule and confidence of the first rule (name, pattern, confidence) that a path meets; one chain of conditions."""
    name, confidence = F, F
    for i, (n, pattern, c) in enumerate(rules):
        hit = path.rlike(pattern)
        name = F.when(hit, n) if i == 0 else name.when(hit, n)
        confidence = F.when(hit, c) if i == 0 else confidence.when(hit, c)
    return df.withColumns({"rule": name.otherwise("none"), "confidence": confidence.otherwise(0.0)})


#: How open a quality is.
QUALITY_RANK = {"lossy": 0, "lossless": 1, "original": 2}


def play_versions(stream: Column, original: Column, lossless: Column, aac: Column, play: Column, cap: Column) -> Column:
    """The versions of a file in order, each with its level and whether the cap locks it; none where nothing may be played.

    stream, original and aac tell which there are; a stream that is the original (``same``) counts as lossless.
    """
    rank = lambda q: F.coalesce(*(F.when(q == n, r) for n, r in QUALITY_RANK.items()), F.lit(-1))
    same = stream == "same"
    own = F.when(same, "lossless").when(lossless, "original").otherwise("lossy")
    version = lambda name, level: F.struct(F.lit(name).alias("version"), level.alias("level"), (rank(level) > rank(cap)).alias("locked"))
    each = F.array(F.when(stream.isNotNull() & ~same, version("stream", F.lit("lossless"))), F.when(original, version("original", own)), F.when(aac, version("aac", F.lit("lossy"))))
    return F.when(play == "none", F.slice(F.array_compact(each), 1, 0)).otherwise(F.array_compact(each))
