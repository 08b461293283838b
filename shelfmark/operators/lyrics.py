"""Lyrics from text: timed lines (LRC) with offsets, repeats and translations, or plain verses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The format's white space, times, headers and times of words.
SPACE = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
TIME = r"(\d{1,3}):(\d{1,2})(?:[.:](\d{1,3}))?"
HEADER = rf"^{SPACE}*\[([A-Za-z#]+):([^\]]*)\]{SPACE}*\z"
_PLAIN_TIME = TIME.replace("(\\d", "(?:\\d")
LEAD = rf"^(?:{SPACE}*\[{_PLAIN_TIME}\])+"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+\z", "")


def rows_of(text: Column) -> Column:
    """The lines of a text, by any line end, without a byte order mark and without white space at their ends."""
    lines = F.split(F.regexp_replace(F.regexp_replace(text, r"^\uFEFF", ""), r"\r\n?", "\n"), "\n")
    return F.transform(lines, lambda x: F.regexp_replace(x, rf"{SPACE}+\z", ""))


def milliseconds(stamp: Column) -> Column:
    part = lambda i: F.regexp_extract(stamp, TIME, i)
    return (part(1).cast("long") * 60 + part(2).cast("long")) * 1000 + F.rpad(part(3), 3, "0").cast("long")


def parsed(texts: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """key, synced, at, t_ms, line and translations: a row for each line of each text; none for a text without a word.

    A text is timed if lines that begin with times make up at least half of its lines (headers and blank ones not counted), two at
    least, or if it has one line alone and that has a time. A line with several times is repeated; the last valid offset header
    shows lines earlier by its milliseconds, never before 0; times of words go. Lines of one time (in ms) are the first one and
    its translations; a line without text is a pause, after which the next one of the same time stands for itself.
    Pauses before the first line with text go. Plain texts keep one blank line between verses.
    """
    some = texts.select(*key, rows_of(F.col(text)).alias("rows"))
    is_timed = lambda x: x.rlike(LEAD)
    is_header = lambda x: x.rlike(HEADER)
    timed, spoken = F.size(F.filter("rows", is_timed)), F.size(F.filter("rows", lambda x: (x != "") & ~is_header(x)))
    given = F.filter("rows", lambda x: is_header(x) & (F.lower(F.regexp_extract(x, HEADER, 1)) == "offset") & trimmed(F.regexp_extract(x, HEADER, 2)).rlike(r"^[+-]?\d+\z"))
    offset = F.coalesce(F.try_element_at(F.transform(given, lambda x: trimmed(F.regexp_extract(x, HEADER, 2)).cast("long")), F.lit(-1)), F.lit(0))
    some = some.where(F.exists("rows", lambda x: x != "")).select(*key, "rows", offset.alias("offset"), F.when(timed >= 2, 2 * timed >= spoken).otherwise((timed == 1) & (spoken == 1)).alias("synced"))
    return _timed(some.where("synced"), key).unionByName(_plain(some.where("not synced"), key))


def _timed(some: DataFrame, key: list[str]) -> DataFrame:
    each = some.select(*key, "offset", F.posexplode("rows").alias("n", "row")).withColumn("lead", F.regexp_extract("row", LEAD, 0)).where("lead <> ''")
    line = trimmed(F.regexp_replace(F.substr("row", F.length("lead") + 1), f"<{_PLAIN_TIME}>", ""))
    stamps = F.regexp_extract_all("lead", F.lit(rf"\[{_PLAIN_TIME}\]"), F.lit(0))
    found = each.select(*key, "offset", "n", line.alias("line"), F.posexplode(stamps).alias("k", "stamp"))
    raw = milliseconds(F.col("stamp"))
    found = found.select(*key, F.greatest(F.lit(0), raw - F.col("offset")).alias("t_ms"), F.struct(raw.alias("raw"), "n", "k", "line").alias("x"))
    # a pause opens a line of its own
    same = Window.partitionBy(*key, "t_ms").orderBy("x")
    found = found.withColumn("part", F.count_if(F.col("x.line") == "").over(same))
    lines = found.groupBy(*key, "t_ms", "part").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    said = F.transform(F.filter("xs", lambda x: x["line"] != ""), lambda x: x["line"])
    lines = lines.select(*key, "t_ms", "part", F.coalesce(F.get(said, F.lit(0)), F.lit("")).alias("line"), F.slice(said, 2, F.greatest(F.size(said), F.lit(1))).alias("translations"))
    whole = Window.partitionBy(*key)
    first = F.min(F.when(F.col("line") != "", F.struct("t_ms", "part"))).over(whole)
    lines = lines.withColumn("first", first).where(F.struct("t_ms", "part") >= F.col("first"))
    return lines.select(*key, F.lit(True).alias("synced"), (F.row_number().over(whole.orderBy("t_ms", "part")) - 1).alias("at"), "t_ms", "line", "translations")


def _plain(some: DataFrame, key: list[str]) -> DataFrame:
    some = some.select(*key, F.transform("rows", trimmed).alias("rows"))
    verses = F.filter("rows", lambda x, i: (x != "") | (i > 0) & (F.coalesce(F.get("rows", i - 1), F.lit("")) != ""))
    some = some.select(*key, verses.alias("rows"))
    ended = F.when(F.element_at("rows", -1) == "", F.slice("rows", F.lit(1), F.size("rows") - 1)).otherwise(F.col("rows"))
    return some.select(*key, F.lit(False).alias("synced"), F.posexplode(ended).alias("at", "line"), F.lit(None).cast("long").alias("t_ms"), F.array().cast("array<string>").alias("translations"))
