"""Rules that suggest a place for each file, with releases resolved by id, catalogue number or title.

Rules stand in order. A rule meets a path by its extensions, its pattern, or both; one that names a release counts only if that is
found, else the next one that meets the path is tried. Every (path, rule) that could decide is a row; numbers and titles are
resolved by joins, and the least rule that is left decides.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.text import folded
from shelfmark.operators.rules import kept_folders, titles_in

OUT = {"rule": "string", "confidence": "double", "release_id": "string", "slot": "string", "edition": "string", "edition_catalog": "string", "folder": "string", "era_id": "string", "seal": "boolean", "readme": "boolean", "rights": "string", "role": "string", "state": "string", "note": "string"}
CHECKED = {"slot": "slots", "rights": "rights", "state": "states", "era": "eras"}


@dataclass(frozen=True)
class PathRule:
    """A checked rule: its pattern as the engine takes it, and the numbers of its named groups."""

    name: str
    pattern: str | None
    groups: dict[str, int]
    ext: tuple[str, ...] | None
    release: dict | None
    raw: dict = field(default_factory=dict)

    @property
    def sure(self) -> bool:
        """Nothing has to be looked up."""
        return self.release is None or "id" in self.release


def named_groups(pattern: str) -> dict[str, int]:
    """Numbers of the named groups of a pattern, by counting the parentheses that capture."""
    out, n, i, in_class = {}, 0, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if pattern.startswith("\\Q", i):
                i = pattern.find("\\E", i) if "\\E" in pattern[i:] else len(pattern)
            i += 2
            continue
        in_class = max(0, in_class + (c == "[") - (c == "]"))
        if c == "(" and not in_class:
            rest = pattern[i + 1 :]
            if rest.startswith("?<") and rest[2:3].isalpha():
                n += 1
                out[rest[2 : rest.index(">")]] = n
            elif not rest.startswith("?"):
                n += 1
        i += 1
    return out


def _faults(raw: dict, groups: dict[str, int] | None, known: dict[str, set[str]]):
    """What is wrong with a rule."""
    release, edition = raw.get("release"), raw.get("edition")
    if groups is None and not raw.get("ext"):
        yield "needs a pattern or extensions"
    for key in CHECKED:
        if raw.get(key) is not None and raw[key] not in known[CHECKED[key]]:
            yield f"unknown {key} {raw[key]!r}"
    wanted = []
    if release is not None:
        if not {"id", "catalog", "title"} & set(release):
            yield "a release needs an id, a number or a title"
        if release.get("era") is not None and release["era"] not in known["eras"]:
            yield f"unknown era {release['era']!r}"
        wanted += [release[k] for k in ("catalog", "title") if release.get(k) not in (None, "$name")]
        if raw.get("era"):
            yield "an era is for folders outside a release"
    elif raw.get("slot"):
        yield "a slot needs a release"
    if edition is not None:
        if not raw.get("slot"):
            yield "an edition needs a slot"
        wanted += [edition["catalog"]] if edition.get("catalog") else []
    yield from (f"the pattern has no group {g!r}" for g in wanted if g not in (groups or {}))
    folder = raw.get("folder")
    if folder is not None and not (isinstance(folder, str) and all(x.strip() for x in folder.split("/"))):
        yield f"bad folder {folder!r}"
    if raw.get("keep") and groups is None:
        yield "keeping folders needs a pattern"
    if not 0 <= float(raw.get("confidence", 0.5)) <= 1:
        yield f"confidence {raw['confidence']!r}"


def checked(spark: SparkSession, rules: list[dict], releases: DataFrame, known: dict[str, set[str]]) -> list[PathRule]:
    """Rules as a file holds them (``release`` and ``edition`` may be plain strings), or an error that names the first faulty one."""
    out = []
    for raw in rules:
        raw = dict(raw)
        name = raw.get("name") or raw.get("match") or "?"
        if isinstance(raw.get("release"), str):
            raw["release"] = {"id": raw["release"]}
        if isinstance(raw.get("edition"), str):
            raw["edition"] = {"name": raw["edition"]}
        pattern = raw["match"].replace("(?P<", "(?<") if raw.get("match") else None
        if pattern:
            try:  # the engine that will run it
                spark.range(1).select(F.lit("").rlike(pattern)).collect()
            except PySparkException as e:
                raise ValueError(f"rule {name!r}: bad pattern {pattern!r}") from e
        groups = named_groups(pattern) if pattern else None
        fault = next(_faults(raw, groups, known), None)
        if fault:
            raise ValueError(f"rule {name!r}: {fault}")
        out.append(PathRule(name, pattern, groups or {}, tuple(x.lower() for x in raw["ext"]) if raw.get("ext") else None, raw.get("release"), raw))
    ids = {r.release["id"] for r in out if r.release and "id" in r.release}
    there = {r["id"] for r in releases.where(F.col("id").isin(*ids)).select("id").distinct().collect()} if ids else set()
    for r in out:
        if r.release and r.release.get("id", None) not in (None, *there):
            raise ValueError(f"rule {r.name!r}: unknown release {r.release['id']!r}")
    return out


def _of_rule(rules: list[PathRule], value) -> Column:
    """A value for each rule, picked by the column ``at``."""
    picked = [F.when(F.col("at") == i, v) for i, r in enumerate(rules) if (v := value(r)) is not None]
    return F.coalesce(*picked) if picked else F.lit(None)


def suggested(files: DataFrame, rules: list[PathRule], releases: DataFrame, sealable: set[str]) -> DataFrame:
    """path and the columns of OUT for each distinct path that a rule decides.

    releases (id, catalog_no, era, names: array). A title is found as whole words of the folded text; the longest name decides, and
    where names of two releases tie there is none.
    """
    name = F.regexp_extract("path", r"[^/]*\z", 0)
    stem = F.when(name.rlike(r"(?s)^.+\.[^.]+\z"), F.regexp_replace(name, r"\.[^.]+\z", "")).otherwise(name)
    ext = F.lower(F.regexp_extract(name, r"(?s)^.+\.([^.]+)\z", 1))
    paths = files.select("path").where("path is not null").distinct().withColumns({"stem": stem, "ext": ext})

    def meets(r: PathRule) -> Column:
        found = F.col("ext").isin(*r.ext) if r.ext is not None else F.lit(True)
        return found & F.col("path").rlike(r.pattern) if r.pattern else found

    met = F.array_compact(F.array(*(F.when(meets(r), F.lit(i)) for i, r in enumerate(rules))))
    sure = [i for i, r in enumerate(rules) if r.sure]
    paths = paths.withColumn("met", met).withColumn("last", F.array_min(F.filter("met", lambda x: x.isin(*sure))))
    each = paths.select("path", "stem", "ext", F.explode(F.filter("met", lambda x: F.col("last").isNull() | (x <= F.col("last")))).alias("at"))
    group = lambda r, g: F.regexp_extract("path", r.pattern, r.groups[g])
    certain = each.where(F.col("at").isin(*sure)).select("path", "at", _of_rule(rules, lambda r: F.lit(r.release["id"]) if r.sure and r.release else None).cast("string").alias("release_id"))

    numbered = each.where(F.col("at").isin(*(i for i, r in enumerate(rules) if not r.sure and "catalog" in r.release)))
    numbered = numbered.withColumn("number", F.upper(_of_rule(rules, lambda r: group(r, r.release["catalog"]) if not r.sure and "catalog" in r.release else None).cast("string")))
    numbers = releases.where("catalog_no <> ''").groupBy(F.upper("catalog_no").alias("number")).agg(F.min("id").alias("release_id"))
    by_number = numbered.join(numbers, "number").select("path", "at", "release_id")

    titled = each.where(F.col("at").isin(*(i for i, r in enumerate(rules) if not r.sure and "catalog" not in r.release)))
    source = lambda r: (F.col("stem") if r.release["title"] == "$name" else group(r, r.release["title"])) if not r.sure and "catalog" not in r.release else None
    titled = titled.withColumns({"said": _of_rule(rules, source).cast("string"), "era": _of_rule(rules, lambda r: F.lit(r.release["era"]) if r.release and r.release.get("era") else None).cast("string")})
    words = lambda c: F.filter(F.split(folded("rule_key", c), " "), lambda w: w != "")
    asked = titled.select("said", "era").distinct()
    names = releases.select(F.col("id").alias("release"), "era", F.explode("names").alias("name")).select("release", "era", F.array_join(words("name"), " ").alias("name")).where("name <> ''").distinct()
    found = titles_in(asked.select(F.struct("said", "era").alias("id"), "era", words("said").alias("words")), names)
    by_title = titled.join(found, F.struct("said", "era").eqNullSafe(F.col("id"))).select("path", "at", F.col("release").alias("release_id"))

    first = certain.unionByName(by_number).unionByName(by_title).groupBy("path").agg(F.min(F.struct("at", "release_id")).alias("x"))
    rows = first.select("path", "x.at", "x.release_id").withColumn("ext", F.lower(F.regexp_extract(name, r"(?s)^.+\.([^.]+)\z", 1)))
    constant = lambda key: _of_rule(rules, lambda r: F.lit(r.raw[key]) if r.raw.get(key) else None)
    edition = lambda key: lambda r: (r.raw.get("edition") or {}).get(key)
    number = _of_rule(rules, lambda r: group(r, edition("catalog")(r)) if edition("catalog")(r) else None).cast("string")
    kept = _of_rule(rules, lambda r: kept_folders(F.col("path"), r.pattern) if r.raw.get("keep") else None).cast("string")
    values = {
        "rule": _of_rule(rules, lambda r: F.lit(r.name)),
        "confidence": _of_rule(rules, lambda r: F.lit(float(r.raw.get("confidence", 0.5)))),
        "release_id": F.col("release_id"),
        "edition": _of_rule(rules, lambda r: F.lit(edition("name")(r) or "") if r.raw.get("slot") else None),
        "edition_catalog": F.when(number != "", F.upper(number)),
        "folder": F.nullif(F.concat_ws("/", constant("folder").cast("string"), F.nullif(kept, F.lit(""))), F.lit("")),
        "era_id": constant("era"),
        "seal": F.when(F.col("ext").isin(*sealable), constant("seal")),
    }
    return rows.select("path", *(values.get(k, constant(k)).cast(kind).alias(k) for k, kind in OUT.items()))
