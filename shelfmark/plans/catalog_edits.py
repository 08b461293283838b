"""More of the catalogue: coverage, orders of tracks, heard tracks, plans of edits, clips, names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.functions import parse
from shelfmark.operators import graph, naming, resolve, sequences
from shelfmark.plans.catalogue import query
from shelfmark.plans.matching import PAIRS, part_pairs
from shelfmark.sources.tables import table


@query(
    "path_coverage",
    r"""WITH p AS (SELECT array_to_string(string_split(regexp_extract(url, '^https?://([^?#]+)', 1), '/')[1:2], '/') AS prefix, regexp_matches(url, '[?&]utm_|#') AS ruled FROM pages) SELECT prefix, count(*) AS n, count(*) FILTER (ruled) AS ruled, CAST(round(100.0 * count(*) FILTER (ruled) / count(*), 1) AS DOUBLE) AS share FROM p GROUP BY prefix""",
)
def path_coverage(spark: SparkSession, d: str) -> DataFrame:
    prefix = F.array_join(F.slice(F.split(F.regexp_extract("url", r"^https?://([^?#]+)", 1), "/"), 1, 2), "/")
    p = table(spark, d, "pages").select(prefix.alias("prefix"), F.col("url").rlike("[?&]utm_|#").alias("ruled"))
    by = p.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"), F.count_if("ruled").alias("ruled"))
    return by.select("prefix", "n", "ruled", F.round(100.0 * F.col("ruled") / F.col("n"), 1).alias("share"))


@query(
    "heard_tracks",
    f"""WITH {PAIRS}, h AS (SELECT a AS file, b AS track, q FROM pairs WHERE q >= 70 UNION SELECT b, a, q FROM pairs WHERE q >= 70), u AS (SELECT l_partkey AS track, count(DISTINCT l_orderkey) AS editions FROM lineitem GROUP BY ALL)
    SELECT file, track FROM (SELECT file, track, row_number() OVER (PARTITION BY file ORDER BY editions DESC, track) AS rn FROM h JOIN u USING (track)) WHERE rn = 1""",
)
def heard_tracks(spark: SparkSession, d: str) -> DataFrame:
    """For each file the heard track that most editions list."""
    both = graph.both_ways(part_pairs(spark, d).where("q >= 70").select("a", "b"))
    listed = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("b")).agg(F.countDistinct("l_orderkey").alias("editions"))
    best = both.join(listed, "b").groupBy(F.col("a").alias("file")).agg(F.min(F.struct((-F.col("editions")).alias("e"), F.col("b").alias("track"))).alias("k"))
    return best.select("file", "k.track")


@query(
    "renumbered_tracks",
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey, l_linestatus ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS INTEGER) AS position FROM lineitem",
)
def renumbered_tracks(spark: SparkSession, d: str) -> DataFrame:
    """Positions per disc in list order."""
    w = Window.partitionBy("l_orderkey", "l_linestatus").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.row_number().over(w).alias("position"))


@query(
    "merged_order",
    """WITH RECURSIVE l AS (SELECT o_custkey AS c, o_orderdate AS day, o_orderkey AS o, l_partkey AS p, min(l_linenumber) AS no FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
    s AS (SELECT *, lag(p) OVER (PARTITION BY c, o ORDER BY no, p) AS before, row_number() OVER (PARTITION BY c ORDER BY day, o, no, p) AS t FROM l),
    f AS (SELECT c, p, arg_min(coalesce(before, -1), t) AS before, min(t) AS t FROM s GROUP BY c, p),
    tree AS (SELECT c, p, [-t] AS path FROM f WHERE before = -1 UNION ALL SELECT f.c, f.p, list_append(tree.path, -f.t) FROM tree JOIN f ON f.c = tree.c AND f.before = tree.p)
    SELECT c AS o_custkey, p AS l_partkey, CAST(row_number() OVER (PARTITION BY c ORDER BY path) AS INTEGER) AS position FROM tree""",
)
def merged_order(spark: SparkSession, d: str) -> DataFrame:
    """One order of a customer's parts that keeps each order's own, the oldest orders first."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    n = lines.count()
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    rows = graph.dealt(orders, n, "o_orderkey").join(graph.dealt(lines, n, "l_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.groupBy("o_custkey", "o_orderdate", "o_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("at"))
    return resolve.merged_orders(rows, "o_custkey", "l_partkey", ["o_orderdate", "o_orderkey"], ["at", "l_partkey"], n)


@query(
    "accept_plan",
    """WITH s AS (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 0.9 WHEN 'MACHINERY' THEN 0.6 ELSE 0.3 END AS confidence, c_nationkey FROM customer)
    SELECT c_nationkey AS place, count(*) AS files, count(*) FILTER (confidence >= 0.8) AS sure FROM s WHERE confidence >= 0.5 GROUP BY ALL ORDER BY files DESC, place LIMIT 8""",
)
def accept_plan(spark: SparkSession, d: str) -> DataFrame:
    """The eight places that most accepted suggestions lead to."""
    confidence = F.when(F.col("c_mktsegment") == "BUILDING", 0.9).when(F.col("c_mktsegment") == "MACHINERY", 0.6).otherwise(0.3)
    s = table(spark, d, "customer").withColumn("confidence", confidence).where("confidence >= 0.5")
    return s.groupBy(F.col("c_nationkey").alias("place")).agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("confidence") >= 0.8).alias("sure")).orderBy(F.desc("files"), "place").limit(8)


@query(
    "clip_items",
    """WITH want AS (SELECT DISTINCT l_partkey AS id, CAST(l_quantity AS BIGINT) * 1000 AS from_ms FROM lineitem WHERE l_returnflag = 'R'), have AS (SELECT DISTINCT l_partkey AS id, CAST(l_quantity AS BIGINT) * 1000 AS from_ms FROM lineitem WHERE l_linestatus = 'F')
    SELECT id, count(*) AS spans, string_agg(from_ms || '-' || (from_ms + 30000), ',' ORDER BY from_ms) AS spec FROM (SELECT * FROM want EXCEPT SELECT * FROM have) GROUP BY id""",
)
def clip_items(spark: SparkSession, d: str) -> DataFrame:
    """Wanted spans that are not cut yet, with the spec that identifies them."""
    span = lambda cond: table(spark, d, "lineitem").where(cond).select(F.col("l_partkey").alias("id"), (F.col("l_quantity").cast("long") * 1000).alias("from_ms")).distinct()
    open_ = span("l_returnflag = 'R'").join(span("l_linestatus = 'F'"), ["id", "from_ms"], "left_anti")
    spec = F.transform(F.array_sort(F.collect_list("from_ms")), lambda x: F.concat_ws("-", x.cast("string"), (x + 30000).cast("string")))
    return open_.groupBy("id").agg(F.count(F.lit(1)).alias("spans"), F.array_join(spec, ",").alias("spec"))


@query(
    "epoch_counters",
    """WITH b AS (SELECT user_id, CAST(ts AS DATE) AS day, max(CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END) AS public FROM events GROUP BY ALL) SELECT user_id, count(*) AS versions, CAST(sum(public) AS BIGINT) AS epochs FROM b GROUP BY user_id""",
)
def epoch_counters(spark: SparkSession, d: str) -> DataFrame:
    """Each batch bumps the version; the public epoch only where something public is touched."""
    b = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.max(F.col("event_type").isin("purchase", "signup").cast("long")).alias("public"))
    return b.groupBy("user_id").agg(F.count(F.lit(1)).alias("versions"), F.sum("public").alias("epochs"))


@query(
    "history_of_entity",
    "SELECT event_id, user_id, event_type FROM events WHERE user_id || '/' || CAST(ts AS DATE) IN (SELECT user_id || '/' || CAST(ts AS DATE) FROM events WHERE event_type = 'purchase' AND value > 30)",
)
def history_of_entity(spark: SparkSession, d: str) -> DataFrame:
    """Whole batches of which any row matches."""
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    hit = e.where("event_type = 'purchase' and value > 30").select("user_id", "day").distinct()
    return e.join(hit, ["user_id", "day"], "left_semi").select("event_id", "user_id", "event_type")


@query(
    "delete_images",
    """SELECT p_partkey AS id, 'delete' AS action, CAST(to_json({'p_partkey': p_partkey, 'p_name': p_name, 'p_brand': p_brand}) AS VARCHAR) AS before FROM part WHERE p_size < 5""",
)
def delete_images(spark: SparkSession, d: str) -> DataFrame:
    """A deletion logs whole rows."""
    image = F.to_json(F.struct("p_partkey", "p_name", "p_brand"), {"ignoreNullFields": "false"})
    return table(spark, d, "part").where("p_size < 5").select(F.col("p_partkey").alias("id"), F.lit("delete").alias("action"), image.alias("before"))


@query(
    "free_names",
    "SELECT p_partkey, CASE WHEN rn = 1 THEN p_name || '.ext' ELSE p_name || ' (' || rn || ').ext' END AS name FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS rn FROM part)",
)
def free_names(spark: SparkSession, d: str) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy("p_brand", "p_name").orderBy("p_partkey"))
    p = table(spark, d, "part").withColumn("rn", rn)
    return p.select("p_partkey", F.when(F.col("rn") == 1, F.concat("p_name", F.lit(".ext"))).otherwise(F.format_string("%s (%d).ext", "p_name", "rn")).alias("name"))


@query(
    "free_file_names",
    r"""WITH RECURSIVE n AS (SELECT p_partkey AS id, p_brand AS folder, CASE WHEN p_partkey % 7 = 0 THEN upper(p_name) ELSE p_name END || CASE WHEN p_partkey % 11 = 0 THEN ' (' || (p_partkey % 3 + 1) || ')' ELSE '' END || CASE WHEN p_partkey % 5 < 3 THEN '.ext' ELSE '' END AS name FROM part),
    t AS (SELECT DISTINCT folder, lower(name) AS name FROM n WHERE id % 4 = 0),
    a AS (SELECT id, folder, name, lower(name) IN (SELECT t.name FROM t WHERE t.folder = n.folder) OR row_number() OVER (PARTITION BY folder, lower(name) ORDER BY id) > 1 AS clash FROM n WHERE id % 4 > 0),
    used AS (SELECT * FROM t UNION SELECT folder, lower(name) FROM a WHERE NOT clash),
    c AS (SELECT *, lower(regexp_replace(name, '\.ext$', '')) AS stem, CASE WHEN ends_with(name, '.ext') THEN '.ext' ELSE '' END AS ext FROM a WHERE clash),
    q AS (SELECT *, row_number() OVER (PARTITION BY folder, stem, ext ORDER BY id) AS i FROM c),
    m AS (SELECT folder, stem, ext, max(i) AS most FROM q GROUP BY ALL),
    free AS (SELECT folder, stem, ext, k, row_number() OVER (PARTITION BY folder, stem, ext ORDER BY k) AS i FROM (SELECT m.*, unnest(range(2, most + 50)) AS k FROM m) x WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.folder = x.folder AND u.name = x.stem || ' (' || x.k || ')' || x.ext))
    SELECT id, folder, name AS free FROM a WHERE NOT clash UNION ALL SELECT id, folder, regexp_replace(name, '\.ext$', '') || ' (' || k || ')' || ext FROM q JOIN free USING (folder, stem, ext, i)""",
)
def free_file_names(spark: SparkSession, d: str) -> DataFrame:
    """New files in folders where names, and names with numbers, are shown already."""
    k = F.col("p_partkey")
    name = F.concat(F.when(k % 7 == 0, F.upper("p_name")).otherwise(F.col("p_name")), F.when(k % 11 == 0, F.concat(F.lit(" ("), (k % 3 + 1).cast("string"), F.lit(")"))).otherwise(""), F.when(k % 5 < 3, ".ext").otherwise(""))
    files = table(spark, d, "part").select(k.alias("id"), F.col("p_brand").alias("folder"), name.alias("name"))
    return naming.free_names(files.where("id % 4 > 0"), files.where("id % 4 = 0"))


@query(
    "bulk_rename",
    "SELECT s_suppkey, lpad(CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name, s_suppkey) AS VARCHAR), 3, '0') || ' ' || replace(s_name, 'Supplier#', '') AS name FROM supplier",
)
def bulk_rename(spark: SparkSession, d: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_name", "s_suppkey"))
    return table(spark, d, "supplier").select("s_suppkey", F.concat_ws(" ", F.lpad(n.cast("string"), 3, "0"), F.replace("s_name", F.lit("Supplier#"), F.lit(""))).alias("name"))


_SIZE = lambda u, p: f"CASE WHEN n / {1024.0**p:.1f} < 10 THEN printf('%.1f', round(n / {1024.0**p:.1f}, 1)) ELSE printf('%.0f', round(n / {1024.0**p:.1f})) END || ' {u}'"


@query(
    "human_sizes",
    f"""WITH s AS (SELECT doc_id, CAST(n_chars * CASE doc_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 1024 WHEN 2 THEN 1048576 WHEN 3 THEN 1073741824 WHEN 4 THEN 1 END AS DOUBLE) AS n FROM documents)
    SELECT doc_id, CASE WHEN n IS NULL THEN '—' WHEN n < 1024 THEN CAST(n AS BIGINT) || ' B' WHEN n < {1024**2} THEN {_SIZE("KB", 1)} WHEN n < {1024**3} THEN {_SIZE("MB", 2)} WHEN n < {1024**4} THEN {_SIZE("GB", 3)} ELSE {_SIZE("TB", 4)} END AS size FROM s""",
)
def human_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Characters as bytes, taken as kilo-, mega- and gigabytes in turn; every sixth has no size."""
    scale = F.when(F.col("doc_id") % 6 == 5, None).when(F.col("doc_id") % 6 < 4, F.pow(F.lit(1024), F.col("doc_id") % 6).cast("long")).otherwise(1)
    return table(spark, d, "documents").select("doc_id", parse.human_size(F.col("n_chars") * scale).alias("size"))


@query(
    "named_by_template",
    "SELECT o_orderkey, o_orderstatus || ' - ' || o_orderkey || CASE WHEN o_orderpriority = '1-URGENT' THEN ' [' || o_orderpriority || ']' ELSE '' END AS name FROM orders",
)
def named_by_template(spark: SparkSession, d: str) -> DataFrame:
    fields = {"status": F.col("o_orderstatus"), "id": F.col("o_orderkey").cast("string"), "note": F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("["), "o_orderpriority", F.lit("]")))}
    return table(spark, d, "orders").select("o_orderkey", parse.template("{status} - {id}[ {note}]", fields).alias("name"))


@query(
    "placement_patch",
    "SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'own' ELSE o_orderpriority END AS rights, CASE WHEN o_orderstatus = 'P' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) THEN 'collected' ELSE o_orderstatus END AS status FROM orders",
)
def placement_patch(spark: SparkSession, d: str) -> DataFrame:
    """Unknown rights become own inside a release; what was missing counts as collected once it has lines."""
    filled = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(True).alias("filled")).distinct()
    o = table(spark, d, "orders").join(filled, "o_orderkey", "left")
    return o.select("o_orderkey", F.when(F.col("o_orderpriority") == "5-LOW", "own").otherwise(F.col("o_orderpriority")).alias("rights"), F.when((F.col("o_orderstatus") == "P") & F.col("filled"), "collected").otherwise(F.col("o_orderstatus")).alias("status"))


@query(
    "best_edition",
    "SELECT o_custkey, o_orderkey, n FROM (SELECT o_custkey, o_orderkey, count(*) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, max(o_orderdate) DESC, o_orderkey) AS rn FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey, o_orderkey) WHERE rn = 1",
)
def best_edition(spark: SparkSession, d: str) -> DataFrame:
    """The edition with most tracks, the newest of equals."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    key = F.struct("n", "o_orderdate", (-F.col("o_orderkey")).alias("o"))
    return table(spark, d, "orders").join(lines, "o_orderkey").groupBy("o_custkey").agg(F.max(key).alias("k")).select("o_custkey", (-F.col("k.o")).alias("o_orderkey"), "k.n")


@query(
    "decoded_prints",
    """SELECT item_id, CAST(len(w) AS INTEGER) AS n, CAST(list_sum([('0x' || substr(md5(x), 1, 8))::BIGINT FOR x IN w]) AS BIGINT) AS total FROM (SELECT item_id, regexp_extract_all(text, '[^ \n\t\r]+') AS w FROM benchmark)""",
)
def decoded_prints(spark: SparkSession, d: str) -> DataFrame:
    v = sequences.values(table(spark, d, "benchmark"), "item_id", "text", "item_id")
    return v.select("item_id", F.size("v").alias("n"), F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))
