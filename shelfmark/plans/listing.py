"""Filters, facets, listings, searches and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.functions import parse
from shelfmark.operators.predicates import Field, Rule, RuleSet, compiled, counted
from shelfmark.plans.catalogue import query
from shelfmark.sources.tables import table

ASOF = "2024-01-31 00:00:00"
LANGS = frozenset({"en", "de", "fr", "es"})


def document_fields() -> dict[str, Field]:
    return {
        "text": Field("text", F.col("text")),
        "source": Field("text", F.col("source")),
        "lang": Field("enum", F.col("lang"), LANGS),
        "chars": Field("number", F.col("n_chars")),
        "kilochars": Field("number", F.col("n_chars"), scale=1000.0),
    }


@query(
    "smart_all",
    """SELECT doc_id, lang, source, n_chars FROM documents
    WHERE contains(lower(coalesce(text, '')), 'the') AND NOT contains(lower(coalesce(source, '')), 'src1') AND lang = 'en' AND coalesce(n_chars, 0) > 500 AND coalesce(n_chars, 0) < 5000""",
)
def smart_all(spark: SparkSession, d: str) -> DataFrame:
    rules = RuleSet("all", (Rule("text", "contains", "The"), Rule("source", "not_contains", "SRC1"), Rule("lang", "is", "en"), Rule("chars", "over", 500), Rule("kilochars", "under", 5)))
    return table(spark, d, "documents").where(compiled(rules, document_fields())).select("doc_id", "lang", "source", "n_chars")


@query(
    "smart_any",
    """SELECT doc_id, lang, source, n_chars FROM documents
    WHERE starts_with(lower(coalesce(text, '')), 'un') OR ends_with(lower(coalesce(text, '')), 'the.') OR lower(coalesce(source, '')) = 'src7' OR coalesce(n_chars, 0) > 10000 OR lang IS DISTINCT FROM 'en'""",
)
def smart_any(spark: SparkSession, d: str) -> DataFrame:
    rules = RuleSet("any", (Rule("text", "starts", "un"), Rule("text", "ends", "the."), Rule("source", "is", "Src7"), Rule("kilochars", "over", 10), Rule("lang", "is_not", "en")))
    return table(spark, d, "documents").where(compiled(rules, document_fields())).select("doc_id", "lang", "source", "n_chars")


@query("smart_recent", "SELECT event_id, user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY AND lower(event_type) IN ('click', 'view')")
def smart_recent(spark: SparkSession, d: str) -> DataFrame:
    fields = {"when": Field("recent", F.col("ts")), "type": Field("list", F.col("event_type"))}
    rules = RuleSet("all", (Rule("when", "days", 7), Rule("type", "in", ".CLICK, view")))
    return table(spark, d, "events").where(compiled(rules, fields, ASOF)).select("event_id", "user_id", "event_type")


@query("smart_has_copy", "SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM documents o WHERE sha256(o.text) = sha256(d.text) AND o.doc_id <> d.doc_id)")
def smart_has_copy(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    often = docs.groupBy("sha").count().where("count > 1")  # counts move, texts don't
    return docs.join(often, "sha", "left_semi").select("doc_id")


@query("subtree_members", "SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE')")
def subtree_members(spark: SparkSession, d: str) -> DataFrame:
    below = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region").where(F.col("r_name").isin("ASIA", "EUROPE"))), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "customer").join(F.broadcast(below), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select("c_custkey")  # at most one row for each nation


@query(
    "preset_counts",
    """SELECT v.view, v.n FROM (SELECT count(*) FILTER (n_chars >= 5000) AS long, count(*) FILTER (n_chars < 100) AS short, count(*) FILTER (lang = 'en') AS english,
    count(*) FILTER (lang IS NULL) AS unknown, count(*) FILTER (contains(text, '%')) AS marked FROM documents) UNPIVOT (n FOR view IN (long, short, english, unknown, marked)) v""",
)
def preset_counts(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    views = {"long": c("n_chars") >= 5000, "short": c("n_chars") < 100, "english": c("lang") == "en", "unknown": c("lang").isNull(), "marked": c("text").contains("%")}
    return counted(table(spark, d, "documents"), views)


@query(
    "desk_listing_page",
    """SELECT o_orderkey, o_orderstatus, o_totalprice, count(l_orderkey) AS n_lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey
    WHERE o_orderpriority <> '5-LOW' GROUP BY ALL ORDER BY o_totalprice DESC, o_orderkey LIMIT 200 OFFSET 200""",
)
def desk_listing_page(spark: SparkSession, d: str) -> DataFrame:
    """A page of 200: rows are ordered and cut first, so that only the page's orders meet their lines."""
    page = table(spark, d, "orders").where("o_orderpriority <> '5-LOW'").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(200).limit(200)
    lines = table(spark, d, "lineitem").join(F.broadcast(page.select("o_orderkey")), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return page.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "o_orderstatus", "o_totalprice", F.coalesce("n", F.lit(0)).alias("n_lines"))


@query(
    "search_ranked",
    """WITH s AS (SELECT 'part' AS kind, p_partkey AS id, p_name AS name, 3 AS w FROM part UNION ALL SELECT 'supplier', s_suppkey, s_name, 2 FROM supplier UNION ALL SELECT 'nation', n_nationkey, n_name, 1 FROM nation),
    r AS (SELECT *, CASE WHEN starts_with(lower(name), 'blue') THEN 2 WHEN contains(lower(name), 'blue') THEN 1 ELSE 0 END AS score FROM s)
    SELECT kind, CAST(id AS BIGINT) AS id, name, CAST(w * 10 + score AS INTEGER) AS rank FROM r WHERE score > 0 ORDER BY rank DESC, name, kind, id LIMIT 30""",
)
def search_ranked(spark: SparkSession, d: str) -> DataFrame:
    def source(name: str, kind: str, key: str, label: str, weight: int) -> DataFrame:
        rows = table(spark, d, name).select(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("id"), F.col(label).alias("name"))
        score = parse.search_score(F.col("name"), "blue")
        return rows.where(score > 0).withColumn("rank", (F.lit(weight * 10) + score).cast("int"))

    found = source("part", "part", "p_partkey", "p_name", 3).unionAll(source("supplier", "supplier", "s_suppkey", "s_name", 2)).unionAll(source("nation", "nation", "n_nationkey", "n_name", 1))
    return found.orderBy(F.desc("rank"), "name", "kind", "id").limit(30)


@query(
    "facet_matrix",
    """SELECT o_orderstatus, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority = '2-HIGH') AS high, count(*) FILTER (o_orderpriority = '3-MEDIUM') AS medium,
    count(*) FILTER (o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')) AS other FROM orders GROUP BY o_orderstatus""",
)
def facet_matrix(spark: SparkSession, d: str) -> DataFrame:
    names = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium"}
    label = F.coalesce(*(F.when(F.col("o_orderpriority") == k, v) for k, v in names.items()), F.lit("other"))
    return table(spark, d, "orders").withColumn("p", label).groupBy("o_orderstatus").pivot("p", [*names.values(), "other"]).count().na.fill(0)


@query("facet_values", "SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM documents WHERE source <> 'src0' GROUP BY ALL UNION ALL SELECT 'source', source, count(*) FROM documents WHERE source <> 'src0' GROUP BY ALL")
def facet_values(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("source <> 'src0'").select(F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in ("lang", "source")))).alias("x"))
    return rows.groupBy("x.facet", "x.value").agg(F.count(F.lit(1)).alias("n"))


@query(
    "storage_totals",
    """SELECT lang, count(*) AS contents, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(copies) AS BIGINT) AS documents FROM
    (SELECT lang, sha256(text) AS sha, max(n_chars) AS size, count(*) AS copies FROM documents GROUP BY ALL) GROUP BY lang""",
)
def storage_totals(spark: SparkSession, d: str) -> DataFrame:
    contents = table(spark, d, "documents").groupBy("lang", F.sha2("text", 256).alias("sha")).agg(F.max("n_chars").alias("size"), F.count(F.lit(1)).alias("copies"))
    return contents.groupBy("lang").agg(F.count(F.lit(1)).alias("contents"), F.sum("size").alias("bytes"), F.sum("copies").alias("documents"))


@query(
    "grand_totals",
    """SELECT (SELECT count(*) FROM orders) AS n_orders, (SELECT count(*) FROM customer) AS n_customers, (SELECT count(DISTINCT l_partkey) FROM lineitem) AS n_parts_sold, (SELECT count(*) FILTER (o_orderstatus = 'P') FROM orders) AS n_pending""",
)
def grand_totals(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").agg(F.count(F.lit(1)).alias("n_orders"), F.count_if(F.col("o_orderstatus") == "P").alias("n_pending"))
    one = table(spark, d, "customer").agg(F.count(F.lit(1)).alias("n_customers"))
    sold = table(spark, d, "lineitem").agg(F.countDistinct("l_partkey").alias("n_parts_sold"))
    return orders.crossJoin(one).crossJoin(sold).select("n_orders", "n_customers", "n_parts_sold", "n_pending")  # rows of totals


@query(
    "capped_list",
    """SELECT source, doc_id, n_chars, total FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn, count(*) OVER (PARTITION BY source) AS total FROM documents) WHERE rn <= 5""",
)
def capped_list(spark: SparkSession, d: str) -> DataFrame:
    """The first five of each source and how many there are; totals are counted apart, so a hot source keeps five rows a task."""
    docs = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    totals = docs.groupBy("source").agg(F.count(F.lit(1)).alias("total"))
    rank = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return docs.withColumn("rn", F.row_number().over(rank)).where("rn <= 5").join(totals, "source").select("source", "doc_id", "n_chars", "total")


@query(
    "keyset_page",
    "SELECT doc_id, sha256(text) AS sha FROM documents WHERE sha256(text) > '8' ORDER BY sha, doc_id LIMIT 100",
)
def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha")).where("sha > '8'").orderBy("sha", "doc_id").limit(100)


@query("random_queue")
def random_queue(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", "p_name").orderBy(F.rand(7)).limit(20)


@query(
    "ext_per_dir_check",
    r"""WITH p AS (SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+/([^/?#]*)', 1) AS dir, coalesce(nullif(regexp_extract(url, '\.([a-z]+)(?:[?#].*)?$', 1), ''), '-') AS ext FROM pages)
    SELECT dir, count(*) AS n, string_agg(DISTINCT ext, ',' ORDER BY ext) AS exts, count(DISTINCT host) AS hosts FROM p GROUP BY dir""",
)
def ext_per_dir_check(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    p = table(spark, d, "pages").select(
        F.regexp_extract(url, r"^https?://([^/?#]+)", 1).alias("host"), F.regexp_extract(url, r"^https?://[^/?#]+/([^/?#]*)", 1).alias("dir"), F.coalesce(F.nullif(F.regexp_extract(url, r"\.([a-z]+)(?:[?#].*)?$", 1), F.lit("")), F.lit("-")).alias("ext")
    )
    return p.groupBy("dir").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("ext")), ",").alias("exts"), F.countDistinct("host").alias("hosts"))


@query("declared_vs_actual", "SELECT o_orderkey, o_orderstatus, max(l_linenumber) AS declared, count(*) AS actual FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL HAVING max(l_linenumber) <> count(*)")
def declared_vs_actual(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("declared"), F.count(F.lit(1)).alias("actual")).where("declared <> actual")
    return table(spark, d, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", "o_orderstatus", "declared", "actual")


@query("missing_children", "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def missing_children(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("o_orderkey", "o_custkey")


@query(
    "rip_without_log",
    "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A') AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O')",
)
def rip_without_log(spark: SparkSession, d: str) -> DataFrame:
    """Has audio, has no log: one aggregate over the lines instead of two joins."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max(F.col("l_returnflag") == "A").alias("audio"), F.max(F.col("l_linestatus") == "O").alias("log")).where("audio and not log")
    return table(spark, d, "orders").where("o_orderstatus = 'F'").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("o_orderkey")


@query(
    "problem_list",
    """SELECT o_orderkey, string_agg(problem, ',' ORDER BY problem) AS problems FROM (
    SELECT o_orderkey, 'no_lines' AS problem FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) UNION ALL
    SELECT l_orderkey, 'count' FROM lineitem GROUP BY l_orderkey HAVING max(l_linenumber) <> count(*) UNION ALL
    SELECT l_orderkey, 'mixed_status' FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_linestatus) > 1) GROUP BY o_orderkey""",
)
def problem_list(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("declared"), F.count(F.lit(1)).alias("actual"), F.min("l_linestatus").alias("lo"), F.max("l_linestatus").alias("hi"))
    joined = table(spark, d, "orders").select("o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "full")
    problems = F.array_compact(F.array(F.when(F.col("declared") != F.col("actual"), "count"), F.when(F.col("lo") != F.col("hi"), "mixed_status"), F.when(F.col("actual").isNull(), "no_lines")))
    return joined.select(F.coalesce("o_orderkey", "l_orderkey").alias("o_orderkey"), F.array_join(problems, ",").alias("problems")).where("problems <> ''")


@query(
    "storage_orphans",
    """SELECT p_partkey, last_seen FROM (SELECT p_partkey, max(o_orderdate) AS last_seen FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_linestatus = 'O' LEFT JOIN orders ON o_orderkey = l_orderkey GROUP BY p_partkey)
    WHERE last_seen IS NULL OR last_seen + INTERVAL 400 DAY <= TIMESTAMP '2002-01-01'""",
)
def storage_orphans(spark: SparkSession, d: str) -> DataFrame:
    used = table(spark, d, "lineitem").where("l_linestatus = 'O'").join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("l_partkey").agg(F.max("o_orderdate").alias("last_seen"))
    old = F.col("last_seen") + F.make_interval(days=F.lit(400)) <= F.lit("2002-01-01").cast("timestamp")
    return table(spark, d, "part").select("p_partkey").join(used, F.col("p_partkey") == F.col("l_partkey"), "left").where(F.col("last_seen").isNull() | old).select("p_partkey", "last_seen")


@query(
    "usage_before_delete",
    "SELECT n_nationkey, n_name, count(DISTINCT c_custkey) AS customers, count(DISTINCT s_suppkey) AS suppliers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL",
)
def usage_before_delete(spark: SparkSession, d: str) -> DataFrame:
    """Each side is counted before it is joined."""
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"))
    s = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("suppliers"))
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    return n.join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("n_nationkey", "n_name", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@query(
    "url_canonical",
    r"""SELECT page_id, split_part(split_part(url, '#', 1), '?', 1) || CASE WHEN regexp_matches(url, '[?&]page=[0-9]{1,4}(&|#|$)') THEN '?page=' || regexp_extract(url, '[?&]page=([0-9]{1,4})(?:&|#|$)', 1) ELSE '' END AS canonical FROM pages""",
)
def url_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Known query keys with well-formed values stay; the others and fragments go."""
    url = F.col("url")
    page = F.regexp_extract(url, r"[?&]page=([0-9]{1,4})(?:&|#|$)", 1)
    bare = F.split_part(F.split_part(url, F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1))
    return table(spark, d, "pages").select("page_id", F.concat(bare, F.when(page != "", F.concat(F.lit("?page="), page)).otherwise("")).alias("canonical"))


@query(
    "path_children_counts",
    r"""WITH p AS (SELECT regexp_extract(url, '^https?://[^/?#]+/([^?#]*)', 1) AS path FROM pages) SELECT split_part(path, '/', 1) AS child, count(*) AS total, count(*) FILTER (contains(path, '/')) AS below FROM p GROUP BY ALL""",
)
def path_children_counts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select(F.regexp_extract("url", r"^https?://[^/?#]+/([^?#]*)", 1).alias("path"))
    return p.groupBy(F.split("path", "/")[0].alias("child")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("path").contains("/")).alias("below"))


@query(
    "html_embedded",
    r"""SELECT page_id, replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS title, CAST(len(regexp_extract_all(html, '<a href="[^"]*"')) AS INTEGER) AS links, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang FROM pages""",
)
def html_embedded(spark: SparkSession, d: str) -> DataFrame:
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        title = F.replace(title, F.lit(a), F.lit(b))
    return table(spark, d, "pages").select("page_id", title.alias("title"), F.size(F.regexp_extract_all("html", F.lit('<a href="[^"]*"'), F.lit(0))).alias("links"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"))


@query(
    "sitemap",
    """SELECT n_nationkey, l.lang, '<url><loc>/' || l.lang || '/n/' || n_nationkey || '</loc></url>' AS entry FROM nation, (VALUES ('en'), ('ja'), ('de')) l(lang)""",
)
def sitemap(spark: SparkSession, d: str) -> DataFrame:
    """Every row in every language: an explode, not a join."""
    rows = table(spark, d, "nation").select("n_nationkey", F.explode(F.array(F.lit("en"), F.lit("ja"), F.lit("de"))).alias("lang"))
    return rows.select("n_nationkey", "lang", F.format_string("<url><loc>/%s/n/%d</loc></url>", "lang", "n_nationkey").alias("entry"))
