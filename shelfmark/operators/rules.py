"""Ordered rules over paths, validated before they are used, and catalogue rows checked before they are taken in."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_NAME = 200


@dataclass(frozen=True)
class Rule:
    """The first rule whose pattern a path meets decides; keep adds the folders below the end of the match."""

    name: str
    pattern: str
    confidence: float
    values: tuple[tuple[str, str], ...] = ()
    keep: bool = False


def checked(rules: list[dict], allowed: dict[str, set[str]]) -> list[Rule]:
    """Rules from a file's rows: names once each, patterns that compile, a confidence of 0 to 1, and known values alone."""
    out, seen = [], set()
    for raw in rules:
        name, confidence = raw.get("name"), raw.get("confidence")
        if not name or name in seen:
            raise ValueError(f"rule without a name of its own: {name!r}")
        seen.add(name)
        if not isinstance(confidence, (int, float)) or not 0 <= confidence <= 1:
            raise ValueError(f"rule {name!r}: confidence {confidence!r}")
        try:  # the engine that will run it
            SparkSession.active().range(1).select(F.lit("").rlike(raw.get("pattern") or "")).collect()
        except PySparkException as e:
            raise ValueError(f"rule {name!r}: bad pattern {raw.get('pattern')!r}") from e
        values = {k: v for k, v in raw.items() if k not in ("name", "pattern", "confidence", "keep")}
        for k, v in values.items():
            if k not in allowed or v not in allowed[k]:
                raise ValueError(f"rule {name!r}: unknown {k} {v!r}")
        out.append(Rule(name, raw.get("pattern") or "", float(confidence), tuple(sorted(values.items())), bool(raw.get("keep"))))
    return out


def kept_folders(path: Column, pattern: str) -> Column:
    """The folders of a path below the end of the first match, joined by slashes."""
    rest = F.regexp_replace(path, rf"^[\s\S]*?(?:{pattern})", "")
    parts = F.split(F.trim(rest, F.lit("/")), "/")
    return F.array_join(F.transform(F.filter(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda x: x != ""), lambda x: F.substring(x, 1, MOST_NAME)), "/")


def applied(path: Column, rules: list[Rule], values: list[str]) -> Column:
    """A struct (rule, confidence, the values, folders) of the first rule that a path meets; null where it meets none."""
    out = None
    for r in rules:
        given = dict(r.values)
        hit = F.struct(F.lit(r.name).alias("rule"), F.lit(r.confidence).alias("confidence"), *(F.lit(given.get(v)).cast("string").alias(v) for v in values), (kept_folders(path, r.pattern) if r.keep else F.lit("")).alias("folders"))
        out = F.when(path.rlike(r.pattern), hit) if out is None else out.when(path.rlike(r.pattern), hit)
    return out


#: Forms of ids and dates.
ID, DATE = "^[a-z0-9][a-z0-9-]*$", r"^\d{4}(-\d{2}(-\d{2})?)?$"


def problems(releases: DataFrame, eras: set[str], kinds: set[str]) -> DataFrame:
    """(row, id, problem): the first problem of each release (row, id, era, kind, title, catalog_no, release_date, slot); null is none.

    Of equal ids or numbers (letters of either case) the first row stands. Counts are aggregated and joined back.
    """
    number = F.upper("catalog_no")
    first_id = releases.groupBy("id").agg(F.min("row").alias("first_id"))
    first_no = releases.where("catalog_no is not null").groupBy(number.alias("number")).agg(F.min("row").alias("first_no"))
    r = releases.join(first_id, "id", "left").withColumn("number", number).join(first_no, "number", "left")
    checks = [
        (~F.coalesce(F.col("id").rlike(ID), F.lit(False)), "bad id"),
        (F.col("row") != F.col("first_id"), "duplicate id"),
        (~F.coalesce(F.col("era").isin(*eras), F.lit(False)), "unknown era"),
        (~F.coalesce(F.col("kind").isin(*kinds), F.lit(False)), "unknown kind"),
        (F.coalesce("title", F.lit("")) == "", "no title"),
        (F.col("row") != F.col("first_no"), "duplicate number"),
        (~F.col("release_date").rlike(DATE), "bad date"),
        (F.col("slot").isNull(), "no status"),
    ]
    return r.select("row", "id", F.coalesce(*(F.when(c, p) for c, p in checks)).alias("problem"))


#: Most different first words of names that are told apart before runs are made.
MOST_FIRST = 10_000


def titles_in(texts: DataFrame, names: DataFrame, most_words: int | None = None) -> DataFrame:
    """(id, release): the release whose name stands in a text as whole words, the longest name; where two tie there is none.

    texts (id, words: array), names (release, name: words joined by spaces; at most most_words, or as many as they have). Where both have a column ``era``, a text's era, if it
    has one, must be the release's. Runs of words that begin like a name are joined to the names by equality, so no text meets
    every name, and of texts only such runs move. Where names begin with few different words (at most ``MOST_FIRST``), other runs are
    not even made.
    """
    has_era = "era" in texts.columns and "era" in names.columns
    names = names.select("release", "name", F.col("era").alias("its_era") if has_era else F.lit(None).cast("string").alias("its_era"))
    most = most_words or names.agg(F.max(F.size(F.split("name", " ")))).first()[0] or 1
    first = names.select(F.split("name", " ")[0].alias("word")).distinct()
    few = [r["word"] for r in first.limit(MOST_FIRST + 1).collect()]
    places = F.when(F.size("words") > 0, F.sequence(F.lit(1), F.size("words"))).otherwise(F.array().cast("array<int>"))
    if len(few) <= MOST_FIRST:
        places = F.filter(places, lambda i: F.get("words", i - 1).isin(few))
    starts = F.transform(places, lambda i: F.slice("words", i, most))
    runs = texts.select("id", (F.col("era") if has_era else F.lit(None).cast("string")).alias("era"), F.explode(starts).alias("run"))
    begun = runs.withColumn("word", F.get("run", F.lit(0))).join(first, "word", "left_semi")
    tried = begun.select("id", "era", F.explode(F.transform(F.sequence(F.lit(1), F.size("run")), lambda n: F.array_join(F.slice("run", F.lit(1), n), " "))).alias("name"))
    found = tried.join(names, "name").where(F.col("era").isNull() | F.col("era").eqNullSafe(F.col("its_era")))
    best = found.groupBy("id", F.length("name").alias("size")).agg(F.min("release").alias("a"), F.max("release").alias("b"))
    best = best.groupBy("id").agg(F.max(F.struct("size", "a", "b")).alias("x"))
    return best.where("x.a = x.b").select("id", F.col("x.a").alias("release"))
