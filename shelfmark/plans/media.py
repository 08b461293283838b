"""Lyrics, and files placed by rules that look releases up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators import classify, lyrics
from shelfmark.plans.catalogue import query
from shelfmark.sources.tables import table

STAMP = r"\[\d{1,3}:\d{1,2}(?:[.:]\d{1,3})?\]"
LRC = rf"""WITH c AS (SELECT conv_id, turn, string_split(text, '. ') AS s, CASE WHEN turn % 2 = 0 THEN chr(10) ELSE chr(13) || chr(10) END AS eol FROM conversations),
made AS (SELECT conv_id, turn, '[ti:' || conv_id || ']' || eol || '[OFFSET: ' || CASE WHEN conv_id % 3 = 0 THEN '+' ELSE '' END || (conv_id % 5 * 700 - CASE WHEN conv_id % 3 = 0 THEN 0 ELSE 700 END) || ' ]' || eol || replace(array_to_string([CASE WHEN (conv_id + i) % 11 = 0 OR conv_id % 4 = 0 AND i > 2 THEN '' WHEN i % 5 = 0 THEN '[00:' || lpad(CAST((i * 7 + turn) % 40 AS VARCHAR), 2, '0') || '.5] [1:' || (i % 60) || ']' WHEN i % 3 = 0 THEN '[00:' || (i * 7 % 40) || ':25]' ELSE '[0:' || lpad(CAST((i * 7 + turn) % 40 AS VARCHAR), 2, '0') || ']' END || CASE WHEN i % 6 = 0 THEN '  ' WHEN i % 4 = 0 THEN '<00:01.5> ' || x ELSE x END || CASE WHEN i % 9 = 0 THEN eol || eol ELSE '' END FOR x, i IN s], chr(1)), chr(1), eol) AS text FROM c),
l AS (SELECT conv_id, turn, n, regexp_replace(r[n], '\s+$', '') AS row FROM (SELECT conv_id, turn, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS r FROM made), unnest(range(1, len(r) + 1)) u(n)),
m AS (SELECT *, regexp_extract(row, '^(?:\s*{STAMP})+') AS lead, regexp_matches(row, '^\s*\[[A-Za-z#]+:[^\]]*\]$') AS head FROM l),
f AS (SELECT conv_id, turn, count(*) FILTER (lead <> '') AS timed, count(*) FILTER (row <> '' AND NOT head) AS spoken, coalesce(max(TRY_CAST(regexp_extract(row, '^\s*\[(?i:offset):\s*([+-]?\d+)\s*\]$', 1) AS BIGINT)) FILTER (regexp_matches(row, '^\s*\[(?i:offset):\s*[+-]?\d+\s*\]$')), 0) AS off FROM m GROUP BY ALL),
d AS (SELECT *, CASE WHEN timed >= 2 THEN 2 * timed >= spoken ELSE timed = 1 AND spoken = 1 END AS synced FROM f),
st AS (SELECT conv_id, turn, n, off, trim(regexp_replace(substring(row, length(lead) + 1), '<\d{{1,3}}:\d{{1,2}}(?:[.:]\d{{1,3}})?>', '', 'g'), ' ' || chr(9)) AS line, regexp_extract_all(lead, '{STAMP}') AS stamps FROM m JOIN d USING (conv_id, turn) WHERE synced AND lead <> ''),
e AS (SELECT conv_id, turn, n, k, line, off, (CAST(regexp_extract(stamps[k], '(\d+):', 1) AS BIGINT) * 60 + CAST(regexp_extract(stamps[k], ':(\d+)', 1) AS BIGINT)) * 1000 + CAST(rpad(regexp_extract(stamps[k], ':\d+[.:](\d+)', 1), 3, '0') AS BIGINT) AS raw FROM st, unnest(range(1, len(stamps) + 1)) u(k)),
g AS (SELECT *, greatest(0, raw - off) AS t, count(*) FILTER (line = '') OVER (PARTITION BY conv_id, turn, greatest(0, raw - off) ORDER BY raw, n, k) AS part FROM e),
h AS (SELECT conv_id, turn, t, part, list(line ORDER BY raw, n, k) FILTER (line <> '') AS said FROM g GROUP BY ALL),
w AS (SELECT *, min(CASE WHEN said IS NOT NULL THEN t * 1000000 + part END) OVER (PARTITION BY conv_id, turn) AS first FROM h),
p AS (SELECT conv_id, turn, n, trim(row, ' ' || chr(9)) AS line, lag(trim(row, ' ' || chr(9)), 1, '') OVER (PARTITION BY conv_id, turn ORDER BY n) AS before, max(CASE WHEN trim(row) <> '' THEN n END) OVER (PARTITION BY conv_id, turn) AS last FROM l JOIN d USING (conv_id, turn) WHERE NOT synced)
SELECT conv_id, turn, true AS synced, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY t, part) - 1 AS INTEGER) AS at, t AS t_ms, coalesce(said[1], '') AS line, array_to_string(coalesce(said[2:], []), '|') AS translations FROM w WHERE t * 1000000 + part >= first
UNION ALL SELECT conv_id, turn, false, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY n) - 1 AS INTEGER), NULL, line, '' FROM p WHERE n <= last AND (line <> '' OR before <> '')"""


@query("lyrics_parsed", LRC)
def lyrics_parsed(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations as lyrics: sentences are lines, with times, repeats, pauses, offsets and word times planted in them."""
    c, t, eol = F.col("conv_id"), F.col("turn"), F.col("eol")
    word = lambda x: x.cast("string")

    def line(x, at):
        i = at + 1
        second = (i * 7 + t) % 40
        stamp = (
            F.when(((c + i) % 11 == 0) | (c % 4 == 0) & (i > 2), "")
            .when(i % 5 == 0, F.concat(F.lit("[00:"), F.lpad(word(second), 2, "0"), F.lit(".5] [1:"), word(i % 60), F.lit("]")))
            .when(i % 3 == 0, F.concat(F.lit("[00:"), word(i * 7 % 40), F.lit(":25]")))
            .otherwise(F.concat(F.lit("[0:"), F.lpad(word(second), 2, "0"), F.lit("]")))
        )
        said = F.when(i % 6 == 0, "  ").when(i % 4 == 0, F.concat(F.lit("<00:01.5> "), x)).otherwise(x)
        return F.concat(stamp, said, F.when(i % 9 == 0, F.concat(eol, eol)).otherwise(""))

    offset = F.concat(F.when(c % 3 == 0, "+").otherwise(""), word(c % 5 * 700 - F.when(c % 3 == 0, 0).otherwise(700)))
    rows = table(spark, d, "conversations").withColumn("eol", F.when(t % 2 == 0, "\n").otherwise("\r\n"))
    text = F.concat(F.lit("[ti:"), word(c), F.lit("]"), eol, F.lit("[OFFSET: "), offset, F.lit(" ]"), eol, F.array_join(F.transform(F.split("text", r"\. "), line), "\0"))
    made = rows.select("conv_id", "turn", F.replace(text, F.lit("\0"), eol).alias("text"))
    return lyrics.parsed(made, ["conv_id", "turn"]).withColumn("translations", F.array_join("translations", "|"))


RULES = [
    {"name": "left over", "ext": ["download"], "state": "ignored"},
    {"name": "second rip", "match": r"^rips/\[(?P<cn>(?P<cat>AB-\d{4})A)\][^/]*/", "release": {"catalog": "cat"}, "slot": "cd_rip", "edition": {"name": "second", "catalog": "cn"}, "keep": True, "rights": "own", "confidence": 0.9},
    {"name": "rip", "match": r"^rips/\[(?P<cat>AB-\d{4})\][^/]*/", "release": {"catalog": "cat"}, "slot": "cd_rip"},
    {"name": "note", "match": "^notes/", "release": {"title": "$name", "era": "odd"}, "role": "text"},
    {"name": "shop", "match": r"^shop/(?P<t>[^/]+)/", "release": {"title": "t"}, "folder": "shop", "keep": True},
    {"name": "web", "match": "^web/", "era": "even", "folder": "pages/old", "keep": True},
    {"name": "packed", "match": "^bms/", "era": "odd", "folder": "BMS", "seal": True},
    {"name": "rest of rips", "match": "^rips/", "rights": "own", "confidence": 0.3},
]
KNOWN = {"slots": {"cd_rip"}, "rights": {"own"}, "states": {"ignored"}, "eras": {"odd", "even"}}


@query(
    "files_classified",
    r"""WITH f AS (SELECT CASE p_partkey % 7 WHEN 0 THEN 'rips/[AB-' || lpad(CAST(p_partkey % 600 AS VARCHAR), 4, '0') || 'A] ' || p_name || '/Scans//' || p_size || '/1.jpg' WHEN 1 THEN 'rips/[AB-' || lpad(CAST((p_partkey + 4) % 600 AS VARCHAR), 4, '0') || '] x/01.flac' WHEN 2 THEN 'notes/Und ' || p_name || '_' || ((p_partkey + 8) % 40) || ' (Live).TXT' WHEN 3 THEN 'shop/Músic: ' || upper(p_name) || ' ' || (p_partkey % 40) || '/a/b.mp3'
      WHEN 4 THEN 'web/2020/' || p_brand || '/index.html' WHEN 5 THEN 'bms/' || p_name || CASE WHEN p_size % 2 = 0 THEN '.ZIP' ELSE '.ogg' END ELSE CASE WHEN p_size % 2 = 0 THEN 'rips/' ELSE 'none/' END || p_partkey || '.download' || CASE WHEN p_size % 3 = 0 THEN '2' ELSE '' END END AS path FROM part),
    r AS (SELECT 'r' || p_partkey AS id, CASE WHEN p_partkey < 600 THEN 'ab-' || lpad(CAST(p_partkey AS VARCHAR), 4, '0') END AS no, CASE WHEN p_size % 2 = 1 THEN 'odd' ELSE 'even' END AS era, [p_name || ' ' || (p_partkey % 40), p_name || ' ' || (p_partkey % 40) || ' live'] AS names FROM part WHERE p_partkey % 4 = 0),
    n AS (SELECT DISTINCT id, era, lower(unnest(names)) AS name FROM r),
    u AS (SELECT DISTINCT path, lower(regexp_extract(path, '\.([^./]+)$', 1)) AS ext, CASE WHEN starts_with(path, 'rips/[') THEN upper(regexp_extract(path, '\[(AB-\d{4})', 1)) END AS no, CASE WHEN starts_with(path, 'notes/') THEN regexp_replace(path[7:], '\.[^.]*$', '') WHEN starts_with(path, 'shop/') THEN string_split(path, '/')[2] END AS said FROM f),
    k AS (SELECT path, ' ' || trim(regexp_replace(lower(strip_accents(said)), '[^a-z0-9]+', ' ', 'g')) || ' ' AS hay FROM u WHERE said IS NOT NULL),
    h AS (SELECT path, id, length(name) AS size FROM k JOIN n ON contains(hay, ' ' || name || ' ') WHERE starts_with(path, 'shop/') OR n.era = 'odd'),
    t AS (SELECT path, min(id) AS id FROM h JOIN (SELECT path, max(size) AS size FROM h GROUP BY path) USING (path, size) GROUP BY path HAVING count(DISTINCT id) = 1),
    x AS (SELECT u.*, c.id AS by_no, t.id AS by_title FROM u LEFT JOIN (SELECT upper(no) AS no, min(id) AS id FROM r WHERE no IS NOT NULL GROUP BY ALL) c ON c.no = u.no LEFT JOIN t ON t.path = u.path),
    y AS (SELECT *, CASE WHEN ext = 'download' THEN 'left over' WHEN by_no IS NOT NULL AND contains(path, 'A]') THEN 'second rip' WHEN by_no IS NOT NULL THEN 'rip' WHEN starts_with(path, 'notes/') AND by_title IS NOT NULL THEN 'note' WHEN starts_with(path, 'shop/') AND by_title IS NOT NULL THEN 'shop' WHEN starts_with(path, 'web/') THEN 'web' WHEN starts_with(path, 'bms/') THEN 'packed' WHEN starts_with(path, 'rips/') THEN 'rest of rips' END AS rule FROM x)
    SELECT path, rule, CASE rule WHEN 'second rip' THEN 0.9::DOUBLE WHEN 'rest of rips' THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END AS confidence, CASE WHEN rule IN ('second rip', 'rip') THEN by_no WHEN rule IN ('note', 'shop') THEN by_title END AS release_id, CASE WHEN rule IN ('second rip', 'rip') THEN 'cd_rip' END AS slot, CASE rule WHEN 'second rip' THEN 'second' WHEN 'rip' THEN '' END AS edition, CASE rule WHEN 'second rip' THEN no || 'A' END AS edition_catalog,
    CASE rule WHEN 'second rip' THEN 'Scans/' || regexp_extract(path, '//(\d+)/', 1) WHEN 'shop' THEN 'shop/a' WHEN 'web' THEN 'pages/old/2020/' || string_split(path, '/')[3] WHEN 'packed' THEN 'BMS' END AS folder, CASE rule WHEN 'web' THEN 'even' WHEN 'packed' THEN 'odd' END AS era_id, CASE WHEN rule = 'packed' AND ext = 'zip' THEN true END AS seal, CAST(NULL AS BOOLEAN) AS readme, CASE WHEN rule IN ('second rip', 'rest of rips') THEN 'own' END AS rights, CASE rule WHEN 'note' THEN 'text' END AS role, CASE rule WHEN 'left over' THEN 'ignored' END AS state, CAST(NULL AS VARCHAR) AS note FROM y WHERE rule IS NOT NULL""",
)
def files_classified(spark: SparkSession, d: str) -> DataFrame:
    """Paths by ordered rules: numbers and titles resolve to releases, and a rule whose release is unknown gives way to the next."""
    k, size = F.col("p_partkey"), F.col("p_size")
    text = lambda x: x.cast("string")
    number = lambda n: F.lpad(text(n % 600), 4, "0")
    kinds = [
        F.concat(F.lit("rips/[AB-"), number(k), F.lit("A] "), "p_name", F.lit("/Scans//"), text(size), F.lit("/1.jpg")),
        F.concat(F.lit("rips/[AB-"), number(k + 4), F.lit("] x/01.flac")),
        F.concat(F.lit("notes/Und "), "p_name", F.lit("_"), text((k + 8) % 40), F.lit(" (Live).TXT")),
        F.concat(F.lit("shop/Músic: "), F.upper("p_name"), F.lit(" "), text(k % 40), F.lit("/a/b.mp3")),
        F.concat(F.lit("web/2020/"), "p_brand", F.lit("/index.html")),
        F.concat(F.lit("bms/"), "p_name", F.when(size % 2 == 0, ".ZIP").otherwise(".ogg")),
        F.concat(F.when(size % 2 == 0, "rips/").otherwise("none/"), text(k), F.lit(".download"), F.when(size % 3 == 0, "2").otherwise("")),
    ]
    part = table(spark, d, "part")
    files = part.select(F.coalesce(*(F.when(k % 7 == i, x) for i, x in enumerate(kinds))).alias("path"))
    title = F.concat_ws(" ", "p_name", text(k % 40))
    releases = part.where(k % 4 == 0).select(F.concat(F.lit("r"), text(k)).alias("id"), F.when(k < 600, F.concat(F.lit("ab-"), number(k))).alias("catalog_no"), F.when(size % 2 == 1, "odd").otherwise("even").alias("era"), F.array(title, F.concat(title, F.lit(" Live"))).alias("names"))
    return classify.suggested(files, classify.checked(spark, RULES, releases, KNOWN), releases, {"zip"})
