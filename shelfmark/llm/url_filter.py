"""URL filters: host-suffix and path-prefix expressions, met by short hash prefixes and confirmed by full digests.

A rule (host, path, verdict) fits a url whose host is the rule's host or a subdomain of it, and whose path starts with the
rule's. A rule's expression is its host and its path up to the last slash; a url's expressions are all suffixes of its host's
labels joined to all prefixes of its path that end in a slash, and to none, as deep as any rule goes. Both sides meet on the first 32
bits of the expressions' SHA-256; then full digests, and what the rule's path has after its last slash, are compared. Of the
rules that fit, the longest decides (ties: the longest host; of equal rules with both verdicts: block).

A verdict depends on host and path alone, and of the path on no more characters than the longest rule path. So distinct pairs of
these are judged, each once, and meet their rows again by equality; a hot url is one pair. Rules are sent to all tasks where they
are at most ``most_broadcast``; more are joined by a shuffle over ``salts`` copies, since every url has expressions such as
``com/``.

A null url, or one without ``://``, has an empty host and path, and no rule fits it. Rules with a null host, path or verdict, or an
empty host, fit nothing. Repeated rows are judged each; extra columns are not read. Without rules every url gets the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Host, path and verdict of the rules that the query applies.
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def suffixes(host: Column, most: int) -> Column:
    """The last one, two, ... labels, at most ``most`` of them."""
    labels = F.split(host, r"\.")
    last = F.slice(labels, -F.least(F.size(labels), F.lit(most)), most)
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(last, lambda _, i: F.array_join(F.slice(last, i + 1, F.size(last)), ".")))


def prefixes(path: Column, most: int) -> Column:
    """The empty prefix and those that end in one of the first ``most`` slashes."""
    parts = F.split(path, "/", most + 1)
    ended = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.concat(F.array(F.lit("")), F.transform(ended, lambda _, i: F.concat(F.array_join(F.slice(ended, F.lit(1), i + 1), "/"), F.lit("/"))))


def short(digest: Column) -> Column:
    return F.substring(digest, 1, 8)


def expressions_of_rules(rules: DataFrame) -> DataFrame:
    """host, path, verdict, tail (of the path, after its last slash), digest and short prefix, a row for each (host, path)."""
    rows = rules.select(F.translate(F.col("host").cast("string"), UPPER, LOWER).alias("rule_host"), F.col("path").cast("string").alias("rule_path"), F.col("verdict").cast("string").alias("rule_verdict"))
    rows = rows.where("rule_host <> '' and rule_path is not null and rule_verdict is not null").groupBy("rule_host", "rule_path").agg(F.max("rule_verdict").alias("rule_verdict"))  # block comes after allow
    tail = F.regexp_extract("rule_path", r"[^/]*$", 0)
    lead = F.substr("rule_path", F.lit(1), F.length("rule_path") - F.length(tail))
    return rows.withColumns({"digest": F.sha2(F.concat("rule_host", lead), 256), "slashes": F.length(F.regexp_replace("rule_path", "[^/]", "")), "labels": F.size(F.split("rule_host", r"\."))}).withColumn("short", short(F.col("digest")))


def judged(urls: DataFrame, rules: DataFrame, default: str = "allow", most_broadcast: int = 50_000, salts: int = 16) -> DataFrame:
    """The rows of ``urls`` (url, and columns to keep) with host, path, rule and verdict; of equal names, ours replace theirs."""
    ours = ("host", "path", "rule", "verdict")
    host, path = host_and_path(F.col("url").cast("string"))
    rows = urls.select(*(F.col(f"`{c}`") for c in urls.columns if c not in ours), host.alias("host"), path.alias("path"))
    known = written(expressions_of_rules(rules))
    facts = known.agg(F.count(F.lit(1)).alias("n"), F.max("slashes").alias("slashes"), F.max("labels").alias("labels"), F.max(F.length("rule_path")).alias("length")).first()
    if not facts["n"]:
        return rows.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    start = F.substr("path", F.lit(1), F.lit(facts["length"]))
    pairs = rows.where("host <> ''").select("host", start.alias("start")).distinct()
    asked = pairs.select("host", "start", F.explode(suffixes(F.col("host"), facts["labels"])).alias("suffix"), prefixes(F.col("start"), facts["slashes"]).alias("prefixes"))
    asked = asked.select("host", "start", F.explode(F.transform("prefixes", lambda p: F.sha2(F.concat("suffix", p), 256))).alias("asked"))
    asked = asked.withColumn("short", short(F.col("asked")))
    known = known.drop("slashes", "labels")
    if facts["n"] <= most_broadcast:
        met = asked.join(F.broadcast(known), "short")
    else:
        met = asked.withColumn("salt", F.pmod(F.xxhash64("host", "start"), F.lit(salts))).join(known.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))), ["short", "salt"])
    fits = met.where((F.col("asked") == F.col("digest")) & F.startswith("start", F.col("rule_path")))
    order = F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"))
    best = fits.groupBy("host", "start").agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict")), order).alias("best"))
    # written, so that the join below can split a hot url's rows
    best = written(best.select(F.col("host").alias("best_host"), F.col("start").alias("best_start"), "best"))
    both = rows.join(best, (F.col("host") == F.col("best_host")) & (start == F.col("best_start")), "left")
    return both.select(*rows.columns, F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def judge_pages(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule and verdict of every page by the fixed rules."""
    rules = pages.sparkSession.createDataFrame(RULES, "host string, path string, verdict string")
    return judged(pages.select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")
