"""Single fields: names, numbers, dates, keys, JSON, formats; and the readers and writers of files."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.functions import parse, tags
from shelfmark.functions.text import folded, page_of, read_bytes
from shelfmark.operators import graph, sequences
from shelfmark.plans.catalogue import query
from shelfmark.sources import sinks, tables
from shelfmark.sources.tables import table

TITLES = "t AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)"


def _titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


def _folder(spark: SparkSession, name: str) -> str:
    return f"{graph.shared_folder(spark)}/{name}/{uuid.uuid4().hex}"


def _n(name: str) -> Column:
    return F.col(name).cast("string")


@query("exact_title_keys", rf"WITH {TITLES} SELECT page_id, regexp_replace(lower(replace(strip_accents(title), 'ß', 'ss')), '[^\p{{L}}\p{{N}}]+', '', 'g') AS key FROM t")
def exact_title_keys(spark: SparkSession, d: str) -> DataFrame:
    return _titles(spark, d).select("page_id", folded("exact_key", "title").alias("key"))


@query("rule_keys", rf"WITH {TITLES} SELECT page_id, trim(regexp_replace(lower(replace(strip_accents(title), 'ß', 'ss')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS key FROM t")
def rule_keys(spark: SparkSession, d: str) -> DataFrame:
    return _titles(spark, d).select("page_id", folded("rule_key", "title").alias("key"))


@query("slugs", rf"WITH {TITLES} SELECT page_id, trim(regexp_replace(lower(replace(strip_accents(title), 'ß', 'ss')), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM t")
def slugs(spark: SparkSession, d: str) -> DataFrame:
    return _titles(spark, d).select("page_id", folded("slug", "title").alias("slug"))


@query("natural_order", "SELECT p_partkey, row_number() OVER (ORDER BY regexp_extract(p_brand, '^([^0-9]*)', 1), p_size, p_partkey) AS place FROM part QUALIFY place <= 200")
def natural_order(spark: SparkSession, d: str) -> DataFrame:
    """The first 200 parts by 'Brand#2 …' before 'Brand#10 …' (the top-k is the feature)."""
    name = F.concat(F.regexp_extract("p_brand", "^([^0-9]*)", 1), _n("p_size"), F.lit(" "), _n("p_partkey"))
    p = table(spark, d, "part").withColumn("key", folded("natural_key", name)).orderBy("key", "p_partkey").limit(200)
    return p.select("p_partkey", F.row_number().over(Window.orderBy("key", "p_partkey")).cast("long").alias("place"))  # 200 rows


FILES = "f AS (SELECT p_partkey AS id, p_size AS n, p_name AS title, CASE p_partkey % 4 WHEN 0 THEN '1-0' || (p_size % 9 + 1) || ' ' WHEN 1 THEN '0' || (p_size % 9 + 1) || ' - ' WHEN 2 THEN '' ELSE p_size || '_' END || p_name || CASE p_size % 3 WHEN 0 THEN '.flac' WHEN 1 THEN '.MP3' ELSE '' END AS name, CASE p_size % 5 WHEN 0 THEN '0' || p_size || '/50' WHEN 1 THEN 'side A' END AS tag FROM part)"


def _files(spark: SparkSession, d: str) -> DataFrame:
    """File names of the usual forms, made from the parts."""
    size = F.col("p_size")
    small = (size % 9 + 1).cast("string")
    head = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("1-0"), small, F.lit(" "))).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("0"), small, F.lit(" - "))).when(F.col("p_partkey") % 4 == 2, "").otherwise(F.concat(_n("p_size"), F.lit("_")))
    ext = F.when(size % 3 == 0, ".flac").when(size % 3 == 1, ".MP3").otherwise("")
    tag = F.when(size % 5 == 0, F.concat(F.lit("0"), _n("p_size"), F.lit("/50"))).when(size % 5 == 1, "side A")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), size.alias("n"), F.col("p_name").alias("title"), F.concat(head, F.col("p_name"), ext).alias("name"), tag.alias("tag"))


@query(
    "track_numbers",
    rf"WITH {FILES} SELECT id, coalesce(try_cast(regexp_extract(tag, '^0*(\d{{1,3}})(?:/\d+)?$', 1) AS INTEGER), CASE WHEN id % 4 = 0 THEN n % 9 + 1 WHEN id % 4 = 1 THEN n % 9 + 1 WHEN id % 4 = 3 THEN n END) AS track FROM f",
)
def track_numbers(spark: SparkSession, d: str) -> DataFrame:
    """From the tag, else from '1-03 title', '03 - title' or '3_title'."""
    f = _files(spark, d)
    return f.select("id", parse.track_number(F.col("name"), F.coalesce("tag", F.lit(""))).cast("int").alias("track"))


@query("track_titles", f"WITH {FILES} SELECT id, title FROM f")
def track_titles(spark: SparkSession, d: str) -> DataFrame:
    """The names' titles, without number and extension, are those they were made of."""
    return _files(spark, d).select("id", parse.clean_title(F.col("name"), F.lit("")).alias("title"))


@query(
    "path_parts",
    "WITH u AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS p FROM pages) SELECT page_id, string_split(p, '/')[-1] AS base, CASE WHEN len(string_split(p, '/')) > 1 THEN array_to_string(string_split(p, '/')[:-2], '/') ELSE '' END AS folder, lower(regexp_extract(p, '\\.([A-Za-z0-9]{1,8})$', 1)) AS ext FROM u",
)
def path_parts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("p"))
    return p.select("page_id", parse.base_name(F.col("p")).alias("base"), parse.folder(F.col("p")).alias("folder"), parse.extension(F.col("p")).alias("ext"))


DATES = "d AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 3 THEN strftime(o_orderdate, '%Y-%d-%m') ELSE strftime(o_orderdate, '%d.%m.%Y') END AS day FROM orders)"


def _dates(spark: SparkSession, d: str) -> DataFrame:
    form = lambda f: F.date_format("o_orderdate", f)
    k = F.col("o_orderkey") % 5
    return table(spark, d, "orders").select("o_orderkey", F.when(k == 0, form("yyyy")).when(k == 1, form("yyyy-MM")).when(k == 2, form("yyyy-MM-dd")).when(k == 3, form("yyyy-dd-MM")).otherwise(form("dd.MM.yyyy")).alias("day"))


@query("partial_dates", rf"WITH {DATES} SELECT o_orderkey, regexp_full_match(day, '\d{{4}}(-(0[1-9]|1[0-2])(-(0[1-9]|[12]\d|3[01]))?)?') AS ok, CASE WHEN ok THEN CAST(left(day, 4) AS INTEGER) END AS year FROM d")
def partial_dates(spark: SparkSession, d: str) -> DataFrame:
    return _dates(spark, d).select("o_orderkey", parse.partial_date_ok(F.col("day")).alias("ok"), parse.year(F.col("day")).alias("year"))


@query(
    "times_ms",
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(CASE l_linenumber % 4 WHEN 0 THEN (l_linenumber * 3600 + 5 * 60 + CAST(l_quantity AS BIGINT)) * 1000 + 250 WHEN 1 THEN (90 * 60 + CAST(l_quantity AS BIGINT)) * 1000 WHEN 2 THEN CAST(l_quantity AS BIGINT) * 1000 + 500 ELSE -1 END AS BIGINT) AS ms FROM lineitem",
)
def times_ms(spark: SparkSession, d: str) -> DataFrame:
    """'h:mm:ss.mmm', 'mm:ss', 'm:ss,m' and texts that are no time (-1)."""
    s = F.lpad(F.col("l_quantity").cast("long").cast("string"), 2, "0")
    k = F.col("l_linenumber") % 4
    t = F.when(k == 0, F.concat(_n("l_linenumber"), F.lit(":05:"), s, F.lit(".25"))).when(k == 1, F.concat(F.lit("90:"), s)).when(k == 2, F.concat(F.lit("0:"), s, F.lit(",5"))).otherwise(F.concat(F.lit("x"), s))
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.coalesce(parse.time_ms(t), F.lit(-1).cast("long")).alias("ms"))


@query(
    "typed_clips",
    "SELECT p_partkey, CASE WHEN p_size % 4 IN (0, 1) AND p_size BETWEEN 6 AND 600 AND (p_size % 4 = 0 OR p_size * 3 <= 100) THEN CAST(p_size * 3 AS DOUBLE) END AS start, CASE WHEN start IS NOT NULL THEN p_size % 4 = 1 END AS percent, CASE WHEN start IS NOT NULL THEN CAST(p_size AS BIGINT) END AS length FROM part",
)
def typed_clips(spark: SparkSession, d: str) -> DataFrame:
    """'start+length', the start in seconds or per cent; lengths of 6 to 600 seconds."""
    at, k = (F.col("p_size") * 3).cast("string"), F.col("p_size") % 4
    typed = F.when(k == 0, F.concat(at, F.lit("+"), _n("p_size"))).when(k == 1, F.concat(at, F.lit("%+"), _n("p_size"))).when(k == 2, F.concat(at, F.lit("s"))).otherwise("")
    c = parse.clip(typed)
    return table(spark, d, "part").select("p_partkey", c["start"].alias("start"), c["percent"].alias("percent"), c["length"].alias("length"))


@query("split_numbers", f"WITH {FILES} SELECT id, try_cast(regexp_extract(tag, '^0*([0-9]+)', 1) AS INTEGER) AS number, try_cast(regexp_extract(tag, '/0*([0-9]+)$', 1) AS INTEGER) AS total FROM f")
def split_numbers(spark: SparkSession, d: str) -> DataFrame:
    x = tags.split_number(F.col("tag"))
    return _files(spark, d).select("id", x["number"].alias("number"), x["total"].alias("total"))


@query(
    "catalogue_guesses",
    "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'RT' || (p_size % 7) || 'D-' || p_partkey WHEN p_size % 3 = 1 THEN 'ABC-' || p_size || 'B' END AS catalog_no, CASE WHEN p_size % 3 = 2 THEN 'no number ' || p_name ELSE p_name END AS title FROM part",
)
def catalogue_guesses(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_size") % 3
    head = F.when(k == 0, F.concat(F.lit(" rt"), (F.col("p_size") % 7).cast("string"), F.lit("d-"), _n("p_partkey"), F.lit("  "))).when(k == 1, F.concat(F.lit("Abc-"), _n("p_size"), F.lit("b "))).otherwise("no number ")
    g = parse.catalogue_guess(F.concat(head, F.col("p_name"), F.lit(" ")))
    return table(spark, d, "part").select("p_partkey", g["catalog_no"].alias("catalog_no"), g["title"].alias("title"))


@query("messages", "SELECT o_custkey, count(*) || CASE WHEN count(*) = 1 THEN ' order of ' ELSE ' orders of ' END || 'customer ' || o_custkey || ' {rest}' AS text FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey")
def messages(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return n.select("o_custkey", parse.message("{n} {n:order|orders} of customer {who} {rest}", {"n": F.col("n"), "who": F.col("o_custkey")}).alias("text"))


@query("safe_names", "SELECT page_id, left(trim(regexp_replace(regexp_replace(url, '[\\\\/:*?\"<>|]', '_', 'g'), '\\s+', ' ', 'g')), 150) AS name FROM pages")
def safe_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", parse.safe_name(F.col("url")).alias("name"))


@query(
    "rename_problems",
    "SELECT p_partkey, CASE WHEN p_size % 5 = 1 THEN 'bad characters' WHEN p_size % 5 = 2 THEN 'extension' WHEN p_size % 5 = 3 THEN 'too long' WHEN p_size % 5 = 4 THEN 'bad characters' END AS problem FROM part",
)
def rename_problems(spark: SparkSession, d: str) -> DataFrame:
    """Names with a slash, another extension, too many characters, or only dots are refused."""
    k = F.col("p_size") % 5
    new = F.when(k == 0, F.concat("p_name", F.lit(".FLAC "))).when(k == 1, F.concat(F.lit("a/"), "p_name", F.lit(".flac"))).when(k == 2, F.concat("p_name", F.lit(".mp3"))).when(k == 3, F.concat(F.repeat("p_name", 60), F.lit(".flac"))).otherwise("..")
    return table(spark, d, "part").select("p_partkey", parse.name_problem(new, F.lit("flac")).alias("problem"))


@query("junk_paths", r"SELECT page_id, CASE page_id % 5 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN true ELSE false END AS junk FROM pages")
def junk_paths(spark: SparkSession, d: str) -> DataFrame:
    k, host = F.col("page_id") % 5, F.regexp_extract("url", "//([^/]*)", 1)
    path = F.when(k == 0, F.concat(host, F.lit("/__MACOSX/a.txt"))).when(k == 1, F.concat(host, F.lit("/._cover.jpg"))).when(k == 2, F.concat(host, F.lit("/a._b/cover.jpg"))).when(k == 3, F.concat(host, F.lit("/Thumbs.DB"))).otherwise(F.concat(F.lit("my"), host, F.lit("/thumbs.db.txt")))
    return table(spark, d, "pages").select("page_id", path.rlike(parse.JUNK).alias("junk"))


@query("accepted_language", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'ja' WHEN doc_id % 4 = 1 THEN 'ja' ELSE 'zh' END AS language FROM documents")
def accepted_language(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 4
    header = F.when(k == 0, "ja-JP,en;q=0.8").when(k == 1, F.concat(F.lit(" JA, "), F.coalesce("lang", F.lit("x")))).when(k == 2, F.concat(F.coalesce("lang", F.lit("x")), F.lit(",ja")))
    return table(spark, d, "documents").select("doc_id", parse.language(header).alias("language"))


@query("expiry_marks", "SELECT event_id, CAST(ceil((floor(epoch(ts)) + 3600) / 600) * 600 AS BIGINT) AS expires FROM events")
def expiry_marks(spark: SparkSession, d: str) -> DataFrame:
    """Addresses made within ten minutes of each other end together."""
    return table(spark, d, "events").select("event_id", parse.expiry(F.unix_timestamp("ts"), 3600).alias("expires"))


@query("series_names", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_brand END AS series, coalesce(CASE WHEN p_size % 3 = 0 THEN p_brand END, p_type, p_name) AS shown FROM part")
def series_names(spark: SparkSession, d: str) -> DataFrame:
    """Placeholders count as none; the first of several columns that has something is shown."""
    k = F.col("p_size") % 3
    s = parse.series(F.when(k == 0, F.concat(F.lit(" "), "p_brand", F.lit(" "))).when(k == 1, " Other ").otherwise("-"))
    return table(spark, d, "part").select("p_partkey", s.alias("series"), F.coalesce(s, "p_type", "p_name").alias("shown"))


@query("audio_quality", "SELECT l_orderkey, CAST(max(CASE WHEN l_returnflag = 'A' THEN 1e6 ELSE 0 END + l_linenumber * 1e3 + l_quantity * 1e-3 + l_partkey * 1e-3) AS DOUBLE) AS best FROM lineitem GROUP BY l_orderkey")
def audio_quality(spark: SparkSession, d: str) -> DataFrame:
    fmt = F.struct((F.col("l_returnflag") == "A").alias("lossless"), F.col("l_linenumber").alias("bits"), F.col("l_quantity").alias("rate"), F.col("l_partkey").alias("kbps"))
    return table(spark, d, "lineitem").select("l_orderkey", fmt.alias("f")).select("l_orderkey", parse.quality(F.col("f")).alias("q")).groupBy("l_orderkey").agg(F.max("q").alias("best"))


@query("stable_ids", "SELECT p_partkey, 'fd_' || left(sha1('part' || chr(31) || p_brand || chr(31) || p_partkey), 16) AS id FROM part")
def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids from natural keys in place of random ones, so that tasks can be run again."""
    key = F.concat_ws("\x1f", F.lit("part"), "p_brand", _n("p_partkey"))
    return table(spark, d, "part").select("p_partkey", F.concat(F.lit("fd_"), F.left(F.sha1(key.cast("binary")), F.lit(16))).alias("id"))


@query(
    "cover_refs",
    "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN p_name END AS file, CASE WHEN p_size % 5 = 1 THEN sha256(p_name) END AS picture, CASE WHEN p_size % 5 = 0 THEN 'add' WHEN p_size % 5 = 1 THEN 'replace' END AS mode FROM part",
)
def cover_refs(spark: SparkSession, d: str) -> DataFrame:
    """References to a file or to an embedded picture; malformed ones, and pictures without a hash, are none."""
    k = F.col("p_size") % 5
    made = lambda *pairs: F.to_json(F.struct(*(v.alias(n) for n, v in pairs)))
    json = F.when(k == 0, made(("file", F.col("p_name")), ("mode", F.lit("add")))).when(k == 1, made(("picture", F.sha2("p_name", 256)), ("mode", F.lit("odd")))).when(k == 2, made(("picture", F.col("p_name")))).when(k == 3, "{not json")
    c = parse.cover(json)
    return table(spark, d, "part").select("p_partkey", c["file"].alias("file"), c["picture"].alias("picture"), c["mode"].alias("mode"))


@query(
    "probe_summary",
    "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'h264' END AS vcodec, CASE WHEN p_size % 2 = 0 THEN CASE WHEN p_size % 4 = 0 THEN 29.97 ELSE round(p_size / 2.0, 3) END::DOUBLE END AS fps, CASE WHEN p_size % 3 = 0 THEN 'flac' WHEN p_size % 3 = 1 THEN 'aac' ELSE 'pcm_s16le' END AS acodec, 44100 AS rate, CASE WHEN p_size % 3 <> 1 THEN true END AS lossless, CASE WHEN p_size % 3 = 0 THEN 24 END AS bits, CASE WHEN p_size % 2 = 1 THEN true END AS cover FROM part",
)
def probe_summary(spark: SparkSession, d: str) -> DataFrame:
    """Streams as a probe lists them: a picture first, then a video in every second file, then the sound."""
    size = F.col("p_size")

    def stream(**given: Column) -> Column:
        fields = {"codec_type": "string", "codec_name": "string", "width": "int", "height": "int", "attached_pic": "int", "avg_frame_rate": "string", "r_frame_rate": "string", "sample_rate": "string", "channels": "int", "bits_per_raw_sample": "string"}
        return F.struct(*(given.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields.items()))

    picture = stream(codec_type=F.lit("video"), codec_name=F.lit("mjpeg"), attached_pic=F.lit(1))
    video = stream(codec_type=F.lit("video"), codec_name=F.lit("h264"), avg_frame_rate=F.when(size % 4 == 0, "30000/1001").otherwise("0/0"), r_frame_rate=F.concat(_n("p_size"), F.lit("/2")))
    audio = stream(codec_type=F.lit("audio"), codec_name=F.when(size % 3 == 0, "flac").when(size % 3 == 1, "aac").otherwise("pcm_s16le"), sample_rate=F.lit("44100"), bits_per_raw_sample=F.when(size % 3 == 0, "24").otherwise("N/A"))
    streams = F.when(size % 2 == 0, F.array(picture, video, audio)).otherwise(F.array(picture, audio))
    rows = table(spark, d, "part").select("p_partkey", streams.alias("s"), F.when(size % 2 == 0, "video").otherwise("audio").alias("kind"))
    return rows.select("p_partkey", parse.probed(F.col("s"), F.col("kind")).alias("x")).select("p_partkey", "x.*")


@query(
    "tag_display_order",
    "SELECT p_partkey, string_agg(name, ',' ORDER BY rank, name) AS names FROM (SELECT DISTINCT p_partkey, u.name, CASE u.name WHEN 'title' THEN 0 WHEN 'artist' THEN 1 WHEN 'album' THEN 2 ELSE CASE WHEN starts_with(u.name, 'performer:') THEN 10000 ELSE 20000 END END AS rank FROM part, unnest(string_split(p_name, ' ') || ['album', 'performer:' || p_type, 'title', 'artist', 'album']) u(name)) GROUP BY p_partkey",
)
def tag_display_order(spark: SparkSession, d: str) -> DataFrame:
    """Names once each: known ones in their order, then performers, then the others by name."""
    names = F.array_distinct(F.concat(F.split("p_name", " "), F.array(F.lit("album"), F.concat(F.lit("performer:"), "p_type"), F.lit("title"), F.lit("artist"), F.lit("album"))))
    return table(spark, d, "part").select("p_partkey", F.array_join(tags.in_display_order(names, ["title", "artist", "album"]), ",").alias("names"))


@query("same_values", "SELECT p_partkey, p_size % 2 = 0 AS same FROM part")
def same_values(spark: SparkSession, d: str) -> DataFrame:
    """Lists are the same value by value in order; no list counts as an empty one."""
    words = F.split("p_name", " ")
    other = F.when(F.col("p_size") % 2 == 0, words).otherwise(F.concat(words, F.array(F.lit("more"))))
    empty = F.coalesce(F.lit(None).cast("array<string>"), F.array().cast("array<string>"))
    return table(spark, d, "part").select("p_partkey", (tags.same(words, other) & tags.same(F.lit(None).cast("array<string>"), empty)).alias("same"))


@query("byte_order_texts", "SELECT item_id, text FROM benchmark")
def byte_order_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts in UTF-8 with and without mark, and in UTF-16 of both orders, are read back."""
    b, k = table(spark, d, "benchmark"), F.col("item_id") % 4
    data = F.when(k == 0, F.encode("text", "UTF-8")).when(k == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8"))).when(k == 2, F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE"))).otherwise(F.encode("text", "UTF-16BE"))
    return b.select("item_id", read_bytes("decode", data).alias("text"))


@query("legacy_texts", f"WITH {TITLES} SELECT page_id, title AS text FROM t")
def legacy_texts(spark: SparkSession, d: str) -> DataFrame:
    """Old tag fields: UTF-8 in most rows; plain ASCII ones are the same in each code page."""
    t = _titles(spark, d)
    ascii_only = F.length("title") == F.octet_length("title")
    return t.select("page_id", read_bytes("legacy_text", F.when(ascii_only, F.encode("title", "ISO-8859-1")).otherwise(F.encode("title", "UTF-8"))).alias("text"))


@query("archive_code_pages", "SELECT page_id // 10 AS archive, CASE WHEN (page_id // 10) % 2 = 1 THEN 'utf-8' END AS page FROM pages GROUP BY ALL")
def archive_code_pages(spark: SparkSession, d: str) -> DataFrame:
    """One code page for all names of an archive, none where they are plain; here every second archive has Japanese names."""
    p = table(spark, d, "pages").withColumn("archive", F.floor(F.col("page_id") / 10))
    name = F.when(F.col("archive") % 2 == 1, F.concat(F.lit("テスト曲"), _n("page_id"))).otherwise(F.concat(F.lit("page "), _n("page_id")))
    t = p.groupBy("archive").agg(F.collect_list(F.encode(name, "UTF-8")).alias("names"))
    return t.select("archive", page_of("names").alias("page"))


HMAC_KEY = b"shelf"
_PADS = [bytes(b ^ x for b in HMAC_KEY.ljust(64, b"\0")).hex() for x in (0x36, 0x5C)]


@query("content_hashes", f"SELECT item_id, sha1(text) AS sha1, md5(text) AS md5, sha256(from_hex('{_PADS[1]}') || from_hex(sha256(from_hex('{_PADS[0]}') || encode(text)))) AS signature FROM benchmark")
def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    """SHA-1 and MD5 of contents, and the HMAC-SHA-256 signature of an address."""
    inner, outer = (F.unhex(F.lit(x)) for x in _PADS)
    data = F.encode("text", "UTF-8")
    signature = F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, data), 256))), 256)
    return table(spark, d, "benchmark").select("item_id", F.sha1(data).alias("sha1"), F.md5(data).alias("md5"), signature.alias("signature"))


@query("stored_prints", r"""SELECT item_id, list_aggregate([CAST(('0x' || substr(md5(x), 1, 8))::BIGINT AS VARCHAR) FOR x IN regexp_extract_all(text, '[^ \n\t\r]+')], 'string_agg', ',') AS print FROM benchmark""")
def stored_prints(spark: SparkSession, d: str) -> DataFrame:
    """Prints as base64 of little-endian 32-bit words, and read back."""
    v = sequences.values(table(spark, d, "benchmark"), "item_id", "text", "item_id")
    turned = lambda h: F.concat(*(F.substring(h, i, 2) for i in (7, 5, 3, 1)))
    stored = v.select("item_id", F.base64(F.unhex(F.array_join(F.transform("v", lambda x: turned(F.lpad(F.hex(x), 8, "0"))), ""))).alias("b64"))
    words = F.regexp_extract_all(F.hex(F.unbase64("b64")), F.lit("[0-9A-F]{8}"), F.lit(0))
    return stored.select("item_id", F.array_join(F.transform(words, lambda w: F.conv(turned(w), 16, 10)), ",").alias("print"))


# JSON


@query("children_json", "SELECT n_nationkey, coalesce(CAST(to_json(list({'id': s_suppkey, 'name': s_name} ORDER BY s_suppkey) FILTER (s_suppkey IS NOT NULL)) AS VARCHAR), '[]') AS children FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey")
def children_json(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))))).alias("children"))
    return table(spark, d, "nation").select("n_nationkey").join(own, "n_nationkey", "left").select("n_nationkey", F.coalesce("children", F.lit("[]")).alias("children"))


@query("key_value_json", "SELECT user_id, '{' || string_agg('\"' || event_type || '\":' || n, ',' ORDER BY event_type) || '}' AS counts FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def key_value_json(spark: SparkSession, d: str) -> DataFrame:
    """Rows of key and value as one object, keys in order."""
    n = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("user_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n"))))).alias("counts"))


@query("row_json", "SELECT p_partkey, CAST(to_json({'name': p_name, 'type': CASE WHEN p_size > 25 THEN p_type END, 'sizes': [p_size, p_size + 1]}) AS VARCHAR) AS row FROM part")
def row_json(spark: SparkSession, d: str) -> DataFrame:
    """Whole rows keep their null fields."""
    row = F.struct(F.col("p_name").alias("name"), F.when(F.col("p_size") > 25, F.col("p_type")).alias("type"), F.array("p_size", F.col("p_size") + 1).alias("sizes"))
    return table(spark, d, "part").select("p_partkey", F.to_json(row, {"ignoreNullFields": "false"}).alias("row"))


# readers and writers


@query("scanned_manifest", "SELECT 'part/' || p_partkey AS path, CAST(p_size AS BIGINT) AS size, sha256(p_name) AS sha256 FROM part")
def scanned_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Sorted JSON lines are written as a whole and read back."""
    at = _folder(spark, "manifests")
    rows = table(spark, d, "part").select(F.concat(F.lit("part/"), _n("p_partkey")).alias("path"), F.col("p_size").cast("long").alias("size"), F.lit("2024-01-01T00:00:00").alias("mtime"), F.sha2("p_name", 256).alias("sha256"))
    sinks.manifest_lines(rows, "path", at)
    return tables.scan_manifest(spark, at).select("path", "size", "sha256")


@query("probed_manifest", "SELECT sha256(p_brand) AS sha256, CAST(max(p_partkey) AS DOUBLE) AS duration FROM part GROUP BY p_brand")
def probed_manifest(spark: SparkSession, d: str) -> DataFrame:
    """A content that was probed several times has its last line."""
    at = _folder(spark, "manifests")
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("n"), F.sha2("p_brand", 256).alias("sha256"), F.col("p_partkey").cast("double").alias("duration"))
    rows.orderBy("n").drop("n").write.mode("overwrite").json(at)
    return tables.probe_manifest(spark, at).select("sha256", "duration")


@query("archive_records", "SELECT sha256(o_orderkey || '') AS sha256, l_linenumber || '/' || l_partkey || '-' || l_suppkey || '-' || CAST(l_quantity AS BIGINT) AS path, CAST(l_quantity AS BIGINT) AS size FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def archive_records(spark: SparkSession, d: str) -> DataFrame:
    """One record for each archive, one row for each member."""
    at = _folder(spark, "archives")
    size = F.col("l_quantity").cast("long")
    member = F.struct(F.concat(_n("l_linenumber"), F.lit("/"), _n("l_partkey"), F.lit("-"), _n("l_suppkey"), F.lit("-"), size.cast("string")).alias("path"), size.alias("size"))
    lines = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    lines.groupBy("o_orderkey").agg(F.collect_list(member).alias("members")).select(F.sha2(_n("o_orderkey"), 256).alias("sha256"), F.lit("zip").alias("type"), F.lit("ok").alias("status"), "members").write.json(at)
    return tables.archive_members(spark, at, lines=True).select("sha256", "path", "size")


@query("inventory_files", "SELECT 's/' || s_suppkey AS path, s_suppkey * 10 AS size, s_name AS mtime FROM supplier WHERE s_suppkey % 3 <> 0")
def inventory_files(spark: SparkSession, d: str) -> DataFrame:
    """Tab-separated listings; folders are left out."""
    at = _folder(spark, "inventories")
    rows = table(spark, d, "supplier").select(F.when(F.col("s_suppkey") % 3 == 0, "D").otherwise("F").alias("kind"), F.concat(F.lit("s/"), _n("s_suppkey")).alias("path"), (F.col("s_suppkey") * 10).alias("size"), F.col("s_name").alias("mtime"))
    rows.write.option("sep", "\t").csv(at)
    return tables.inventory(spark, at)


@query("rebased_paths", "SELECT page_id, regexp_extract(url, '^https?://(.*)$', 1) AS path FROM pages")
def rebased_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths of another machine, with backslashes, below the archive's root."""
    there = F.replace(F.concat(F.lit("D:/old/archive/"), F.regexp_extract("url", "^https?://(.*)$", 1)), F.lit("/"), F.lit("\\"))
    return table(spark, d, "pages").select("page_id", tables.rebased(there, "archive").alias("path"))


@query("scanned_folder", "SELECT CAST(count(*) AS BIGINT) AS files, CAST(count(*) AS BIGINT) AS again, true AS same FROM region")
def scanned_folder(spark: SparkSession, d: str) -> DataFrame:
    """A folder with one file for each region; a second scan takes the hashes of unchanged files from the first."""
    at = _folder(spark, "folders")
    table(spark, d, "region").select(F.concat(F.lit("text "), "r_name").alias("value"), "r_regionkey").write.partitionBy("r_regionkey").text(at)
    first = graph.kept(tables.directory_scan(spark, at).where("path like '%.txt'"))
    second = tables.directory_scan(spark, at, first).where("path like '%.txt'")
    both = first.join(second.select("path", F.col("sha256").alias("other")), "path", "full")
    return both.agg(F.count("sha256").alias("files"), F.count("other").alias("again"), F.coalesce(F.bool_and(F.col("sha256") == F.col("other")), F.lit(True)).alias("same"))


@query("snapshot_counts", "SELECT 'part' AS name, count(*) AS n FROM part UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'media_tasks', 0")
def snapshot_counts(spark: SparkSession, d: str) -> DataFrame:
    """Processing tables go into a snapshot as schemas alone."""
    at = _folder(spark, "snapshots")
    sinks.snapshot({"part": table(spark, d, "part"), "supplier": table(spark, d, "supplier"), "media_tasks": table(spark, d, "events")}, at)
    return spark.read.schema("name string, n long").json(f"{at}/manifest")


@query("copy_plan", "SELECT sha256(text) AS key, max(n_chars) AS size FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0) GROUP BY ALL")
def copy_plan(spark: SparkSession, d: str) -> DataFrame:
    """What a copy lacks."""
    rows = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("key"), F.col("n_chars").alias("size"))
    return sinks.copy_plan(rows.groupBy("key").agg(F.max("size").alias("size")), rows.where("doc_id % 3 = 0").select("key", "size").distinct())


#: Names as old systems wrote them: text, code page, bytes.
OLD_NAMES = [
    ("さくら", "cp932", "82b382ad82e7"),
    ("简体中文的名字", "gbk", "bcf2cce5d6d0cec4b5c4c3fbd7d6"),
    ("さくら", "utf-8", "e38195e3818fe38289"),
    ("繁體中文名稱", "big5", "c163c5e9a4a4a4e5a657bad9"),
    ("café", "latin-1", "636166e9"),
]
_OLD = ", ".join(f"({i}, '{t}', '{page}')" for i, (t, page, _) in enumerate(OLD_NAMES))


def _old_name(at, ending) -> Column:
    """The bytes of one of OLD_NAMES and an ASCII ending."""
    return F.concat(F.coalesce(*(F.when(at == i, F.unhex(F.lit(x))) for i, (_, _, x) in enumerate(OLD_NAMES))), F.encode(ending, "US-ASCII"))


@query("old_texts", f"WITH o(i, name, page) AS (VALUES {_OLD}) SELECT p_partkey, CASE WHEN page IN ('cp932', 'gbk', 'utf-8') THEN name || ' ' || p_partkey END AS text, CASE WHEN page IN ('cp932', 'utf-8', 'latin-1') THEN name || ' ' || p_partkey END AS tag FROM part JOIN o ON i = p_partkey % 5")
def old_texts(spark: SparkSession, d: str) -> DataFrame:
    """Bytes in Shift_JIS, GBK, UTF-8 and Latin-1 as texts (by what they decode to) and as tag fields (UTF-8, Shift_JIS, else Latin-1)."""
    at = F.col("p_partkey") % 5
    data = _old_name(at, F.concat(F.lit(" "), _n("p_partkey")))
    return table(spark, d, "part").select("p_partkey", F.when(at < 3, read_bytes("decode", data)).alias("text"), F.when(at.isin(0, 2, 4), read_bytes("legacy_text", data)).alias("tag"))


@query("old_archives", f"WITH o(i, name, page) AS (VALUES {_OLD}) SELECT archive, CASE WHEN archive % 6 < 4 THEN page END AS page FROM (SELECT DISTINCT p_partkey // 7 AS archive FROM part) LEFT JOIN o ON i = archive % 6")
def old_archives(spark: SparkSession, d: str) -> DataFrame:
    """The code page of each archive's names, some of them plain: Japanese ones, Chinese ones of two kinds, UTF-8, and archives of plain names alone."""
    archive = F.floor(F.col("p_partkey") / 7)
    ending = F.concat(F.lit(" "), _n("p_partkey"), F.lit(".mp3"))
    name = F.when((archive % 6 < 4) & (F.col("p_partkey") % 7 > 1), _old_name(archive % 6, ending)).otherwise(F.encode(ending, "US-ASCII"))
    t = table(spark, d, "part").groupBy(archive.alias("archive")).agg(F.collect_list(name).alias("names"))
    return t.select("archive", page_of("names").alias("page"))
