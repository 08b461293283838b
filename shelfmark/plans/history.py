"""Trees, change log, work queue, access policy, tags and lyrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.functions import parse, tags
from shelfmark.operators import changelog, graph, policy, tasks
from shelfmark.plans.catalogue import query
from shelfmark.sources.tables import table

TREE = """n AS (SELECT 'r' || r_regionkey AS id, CAST(NULL AS VARCHAR) AS parent_id, 'era' AS kind FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'release' FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'edition' FROM customer UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 'plain' FROM orders),
    tree AS (SELECT id AS ancestor, id AS descendant, 0 AS depth FROM n UNION ALL SELECT n.parent_id, n.id, 1 FROM n WHERE parent_id IS NOT NULL UNION ALL SELECT p.parent_id, n.id, 2 FROM n JOIN n p ON p.id = n.parent_id WHERE p.parent_id IS NOT NULL
    UNION ALL SELECT g.parent_id, n.id, 3 FROM n JOIN n p ON p.id = n.parent_id JOIN n g ON g.id = p.parent_id WHERE g.parent_id IS NOT NULL)"""


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """The folder tree: regions, nations, customers, orders."""

    def level(name: str, mark: str, key: str, up: str | None, up_key: str | None, kind: str) -> DataFrame:
        parent = F.concat(F.lit(up), F.col(up_key).cast("string")) if up else F.lit(None).cast("string")
        return table(spark, d, name).select(F.concat(F.lit(mark), F.col(key).cast("string")).alias("id"), parent.alias("parent_id"), F.lit(kind).alias("kind"))

    return (
        level("region", "r", "r_regionkey", None, None, "era")
        .unionAll(level("nation", "n", "n_nationkey", "r", "n_regionkey", "release"))
        .unionAll(level("customer", "c", "c_custkey", "n", "c_nationkey", "edition"))
        .unionAll(level("orders", "o", "o_orderkey", "c", "o_custkey", "plain"))
    )


@query("tree_closure", f"WITH {TREE} SELECT ancestor, descendant, CAST(depth AS INTEGER) AS depth FROM tree")
def tree_closure(spark: SparkSession, d: str) -> DataFrame:
    return graph.closure(nodes(spark, d))


@query(
    "tree_rollup",
    f"""WITH {TREE}, own AS (SELECT 'o' || l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY ALL) SELECT ancestor AS id, coalesce(max(own.n) FILTER (depth = 0), 0) AS own, CAST(coalesce(sum(own.n), 0) AS BIGINT) AS total FROM tree LEFT JOIN own ON own.id = descendant GROUP BY ancestor""",
)
def tree_rollup(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "lineitem").groupBy(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return graph.rolled_up(nodes(spark, d), own, "n")


@query(
    "tree_context",
    f"""WITH {TREE} SELECT t.descendant AS id, arg_min(t.ancestor, t.depth) FILTER (n.kind = 'era') AS era, arg_min(t.ancestor, t.depth) FILTER (n.kind = 'release') AS release, arg_min(t.ancestor, t.depth) FILTER (n.kind = 'edition') AS edition FROM tree t JOIN n ON n.id = t.ancestor GROUP BY t.descendant""",
)
def tree_context(spark: SparkSession, d: str) -> DataFrame:
    """The nearest era, release and edition above each node."""
    return graph.context(nodes(spark, d), ["era", "release", "edition"])


@query(
    "tree_paths",
    """SELECT 'o' || o_orderkey AS id, r_name || ' / ' || n_name || ' / ' || c_name AS path FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""",
)
def tree_paths(spark: SparkSession, d: str) -> DataFrame:
    small = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    who = table(spark, d, "customer").join(F.broadcast(small), F.col("c_nationkey") == F.col("n_nationkey"))  # a row for each nation
    return table(spark, d, "orders").join(who, F.col("o_custkey") == F.col("c_custkey")).select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), F.concat_ws(" / ", "r_name", "n_name", "c_name").alias("path"))


@query(
    "tree_full_paths",
    """WITH RECURSIVE n AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 50 > 0 THEN p_partkey // 2 END AS parent_id, CASE WHEN p_size % 9 > 0 THEN p_name END AS name FROM part WHERE p_partkey % 31 > 0 OR p_partkey % 50 = 0),
    r AS (SELECT id, coalesce(name, '') AS path FROM n WHERE parent_id IS NULL UNION ALL SELECT n.id, r.path || ' / ' || coalesce(n.name, '') FROM n JOIN r ON r.id = n.parent_id) SELECT id, path FROM r""",
)
def tree_full_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths of a tree of several depths, some of whose nodes are gone with all that hangs below them."""
    k = F.col("p_partkey")
    n = table(spark, d, "part").where((k % 31 > 0) | (k % 50 == 0)).select(k.alias("id"), F.when(k % 50 > 0, F.floor(k / 2)).alias("parent_id"), F.when(F.col("p_size") % 9 > 0, F.col("p_name")).alias("name"))
    return graph.full_paths(n)


@query(
    "delete_plan_levels",
    f"""WITH {TREE}, chosen AS (SELECT descendant AS id, min(depth) AS level FROM tree WHERE ancestor IN ('r0', 'n1', 'n2') GROUP BY ALL), blocked AS (SELECT DISTINCT t.ancestor AS id FROM tree t JOIN orders ON t.descendant = 'o' || o_orderkey WHERE o_orderstatus = 'P')
    SELECT id, CAST(level AS INTEGER) AS level, id IN (SELECT id FROM blocked) AS blocked FROM chosen""",
)
def delete_plan_levels(spark: SparkSession, d: str) -> DataFrame:
    """What goes with the chosen folders, by level; a pending order blocks itself and everything above it."""
    tree = graph.closure(nodes(spark, d))
    chosen = tree.where(F.col("ancestor").isin("r0", "n1", "n2")).groupBy(F.col("descendant").alias("id")).agg(F.min("depth").alias("level"))
    pending = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("descendant"))
    blocked = tree.join(pending, "descendant", "left_semi").select(F.col("ancestor").alias("id"), F.lit(True).alias("b")).distinct()
    return chosen.join(blocked, "id", "left").select("id", "level", F.coalesce("b", F.lit(False)).alias("blocked"))


@query(
    "nested_members",
    """WITH a AS (SELECT p_partkey AS id, CASE WHEN p_partkey >= 10 THEN p_partkey // 10 END AS holder, p_name AS name FROM part)
    SELECT x.id, coalesce(z.name || '!/', '') || coalesce(y.name || '!/', '') || x.name AS path, CAST((CASE WHEN y.id IS NULL THEN 0 WHEN z.id IS NULL THEN 1 ELSE 2 END) AS INTEGER) AS levels FROM a x LEFT JOIN a y ON y.id = x.holder LEFT JOIN a z ON z.id = y.holder""",
)
def nested_members(spark: SparkSession, d: str) -> DataFrame:
    """Members of members as virtual paths, at most three levels."""
    a = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") >= 10, F.floor(F.col("p_partkey") / 10)).alias("holder"), F.col("p_name").alias("name"))
    up = a.select(F.col("id").alias("holder"), F.col("name").alias("n1"), F.col("holder").alias("holder2"))
    up2 = a.select(F.col("id").alias("holder2"), F.col("name").alias("n2"))
    j = a.join(up, "holder", "left").join(up2, "holder2", "left")
    path = F.concat(F.coalesce(F.concat("n2", F.lit("!/")), F.lit("")), F.coalesce(F.concat("n1", F.lit("!/")), F.lit("")), F.col("name"))
    return j.select("id", path.alias("path"), F.when(F.col("n1").isNull(), 0).when(F.col("n2").isNull(), 1).otherwise(2).cast("int").alias("levels"))


@query(
    "version_chain",
    "SELECT o_orderkey, lag(o_orderkey) OVER w AS replaces, CAST(row_number() OVER w AS INTEGER) AS version, count(*) OVER (PARTITION BY o_custkey) AS versions FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
)
def version_chain(spark: SparkSession, d: str) -> DataFrame:
    own = Window.partitionBy("o_custkey")
    w = own.orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.lag("o_orderkey").over(w).alias("replaces"), F.row_number().over(w).alias("version"), F.count(F.lit(1)).over(own).alias("versions"))


@query(
    "version_pointers",
    """WITH RECURSIVE f AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 9 = 0 THEN -o_orderkey ELSE lag(o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 2 ELSE 1 END) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) END AS replaces FROM orders),
    c AS (SELECT id, id AS top, 0 AS depth FROM f UNION ALL SELECT g.id, c.top, c.depth + 1 FROM c JOIN f ON f.id = c.id JOIN f g ON g.id = f.replaces)
    SELECT top AS id, arg_max(id, depth) AS oldest, max(depth) AS depth, (SELECT min(f.id) FROM f WHERE f.replaces = top) AS replaced_by FROM c GROUP BY top""",
)
def version_pointers(spark: SparkSession, d: str) -> DataFrame:
    """Versions that point to the one they replace, with branches and pointers to versions that are gone, followed to the oldest."""
    o, w = F.col("o_orderkey"), Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    replaces = F.when(o % 5 == 0, None).when(o % 9 == 0, -o).when(o % 4 == 0, F.lag("o_orderkey", 2).over(w)).otherwise(F.lag("o_orderkey").over(w))
    return graph.chains(table(spark, d, "orders").select(o.alias("id"), replaces.alias("replaces")))


REV = "rev AS (SELECT event_id AS id, ts AS at, user_id || ':' || strftime(ts, '%Y-%m-%d') AS batch_id, event_type AS entity, user_id AS entity_id, value AS after_v, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before_v FROM events)"


@query(
    "batch_history",
    f"""WITH {REV} SELECT batch_id, min("at") AS started, count(*) AS changes, count(DISTINCT entity) AS entities, arg_min(entity, id) AS first_entity FROM rev GROUP BY batch_id""",
)
def batch_history(spark: SparkSession, d: str) -> DataFrame:
    r = changelog.revisions(table(spark, d, "events"))
    return r.groupBy("batch_id").agg(F.min("at").alias("started"), F.count(F.lit(1)).alias("changes"), F.countDistinct("entity").alias("entities"), F.min_by("entity", "id").alias("first_entity"))


@query(
    "batch_first_rows",
    f"WITH {REV} SELECT id, batch_id, entity FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY id) AS rn FROM rev) WHERE rn <= 3",
)
def batch_first_rows(spark: SparkSession, d: str) -> DataFrame:
    r = changelog.revisions(table(spark, d, "events"))
    return r.withColumn("rn", F.row_number().over(Window.partitionBy("batch_id").orderBy("id"))).where("rn <= 3").select("id", "batch_id", "entity")


@query(
    "trash_batches",
    f"WITH {REV} SELECT batch_id, count(*) AS deleted, string_agg(DISTINCT entity_id, ',' ORDER BY entity_id) AS ids FROM rev WHERE entity = 'error' GROUP BY batch_id HAVING count(*) > 1",
)
def trash_batches(spark: SparkSession, d: str) -> DataFrame:
    r = changelog.revisions(table(spark, d, "events")).where("entity = 'error'")
    return r.groupBy("batch_id").agg(F.count(F.lit(1)).alias("deleted"), F.array_join(F.array_sort(F.collect_set("entity_id")), ",").alias("ids")).where("deleted > 1")


@query(
    "undo_restore",
    f"WITH {REV} SELECT batch_id, entity, entity_id, before_v AS restored FROM (SELECT *, row_number() OVER (PARTITION BY batch_id, entity, entity_id ORDER BY id) AS rn FROM rev) WHERE rn = 1",
)
def undo_restore(spark: SparkSession, d: str) -> DataFrame:
    """Undoing each batch: the earliest recorded value of every field, nulls included."""
    return changelog.restored(changelog.revisions(table(spark, d, "events")))


@query(
    "undo_conflicts",
    f"""WITH {REV}, cur AS (SELECT entity, entity_id, arg_max(after_v, id) AS v FROM rev GROUP BY ALL), last AS (SELECT batch_id, entity, entity_id, arg_max(after_v, id) AS v FROM rev GROUP BY ALL)
    SELECT batch_id, count(*) AS conflicts FROM last JOIN cur USING (entity, entity_id) WHERE last.v IS DISTINCT FROM cur.v GROUP BY batch_id""",
)
def undo_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Batches that can't be undone: what they wrote is no longer what stands."""
    return changelog.conflicts(changelog.revisions(table(spark, d, "events")))


@query(
    "diff_patch_log",
    """WITH p AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'UNKNOWN' ELSE upper(c_mktsegment) END AS seg, CASE WHEN c_nationkey = 3 THEN 4 ELSE c_nationkey END AS nat FROM customer)
    SELECT customer.c_custkey AS id, f.field, f.before_value, f.after_value FROM customer JOIN p USING (c_custkey), LATERAL (VALUES ('c_mktsegment', c_mktsegment, seg), ('c_nationkey', CAST(c_nationkey AS VARCHAR), CAST(nat AS VARCHAR))) f(field, before_value, after_value) WHERE f.before_value IS DISTINCT FROM f.after_value""",
)
def diff_patch_log(spark: SparkSession, d: str) -> DataFrame:
    """Only changed fields are logged."""
    old = table(spark, d, "customer")
    new = old.withColumns({"c_mktsegment": F.when(F.col("c_acctbal") < 0, "UNKNOWN").otherwise(F.upper("c_mktsegment")), "c_nationkey": F.when(F.col("c_nationkey") == 3, 4).otherwise(F.col("c_nationkey"))})
    return changelog.diff(old, new, "c_custkey", ["c_mktsegment", "c_nationkey"])


@query(
    "upsert_refresh",
    """WITH inc AS (SELECT p_partkey, p_size + 1 AS p_size, 'X' AS p_name FROM part WHERE p_type = 'PROMO' UNION ALL SELECT p_partkey + 1000000, 1, 'new' FROM part WHERE p_size > 45)
    SELECT coalesce(p.p_partkey, i.p_partkey) AS p_partkey, coalesce(i.p_size, p.p_size) AS p_size, coalesce(p.p_name, i.p_name) AS p_name FROM part p FULL JOIN inc i ON i.p_partkey = p.p_partkey""",
)
def upsert_refresh(spark: SparkSession, d: str) -> DataFrame:
    """Machine columns are refreshed, human ones kept, new rows added."""
    part = table(spark, d, "part").select("p_partkey", "p_size", "p_name")
    inc = table(spark, d, "part").where("p_type = 'PROMO'").select("p_partkey", (F.col("p_size") + 1).alias("p_size"), F.lit("X").alias("p_name"))
    more = table(spark, d, "part").where("p_size > 45").select((F.col("p_partkey") + 1000000).alias("p_partkey"), F.lit(1).alias("p_size"), F.lit("new").alias("p_name"))
    return changelog.upsert(part, inc.unionAll(more), ["p_partkey"], refresh=["p_size"], keep=["p_name"])


TASKS = """t AS (SELECT user_id AS id, arg_max(event_type, (ts, event_id)) AS last, max(ts) AS at, count(*) FILTER (event_type = 'error') AS attempts FROM events GROUP BY user_id),
    st AS (SELECT *, CASE last WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'running' ELSE 'open' END AS state FROM t)"""
SETTLED = """(state = 'done' OR attempts >= 90 OR (state = 'running' AND "at" > TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 20 MINUTE) OR (state = 'failed' AND "at" > TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 60 MINUTE))"""


@query("task_wanted", f"WITH {TASKS} SELECT id, state, attempts FROM st WHERE NOT {SETTLED}")
def task_wanted(spark: SparkSession, d: str) -> DataFrame:
    state = tasks.states(table(spark, d, "events"))
    return state.where(~tasks.settled("2024-01-30 12:00:00", most_attempts=90)).select("id", "state", "attempts")


@query("task_pending", f"WITH {TASKS} SELECT state, count(*) AS n, CAST(sum(attempts) AS BIGINT) AS attempts FROM st GROUP BY state")
def task_pending(spark: SparkSession, d: str) -> DataFrame:
    return tasks.states(table(spark, d, "events")).groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.sum("attempts").alias("attempts"))


@query(
    "task_claims",
    f"""WITH {TASKS} SELECT id, CAST(attempts + 1 AS BIGINT) AS attempts FROM st WHERE NOT {SETTLED} ORDER BY "at" DESC, id LIMIT 25""",
)
def task_claims(spark: SparkSession, d: str) -> DataFrame:
    """The next 25 to claim, newest first."""
    state = tasks.states(table(spark, d, "events")).where(~tasks.settled("2024-01-30 12:00:00", most_attempts=90))
    return state.orderBy(F.desc("at"), "id").limit(25).select("id", (F.col("attempts") + 1).alias("attempts"))


@query("wave_peaks", "SELECT user_id, CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) * 100 / (30 * 86400000000)) AS BIGINT) AS slice, max(abs(value)) AS peak FROM events GROUP BY ALL")
def wave_peaks(spark: SparkSession, d: str) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))
    return table(spark, d, "events").groupBy("user_id", F.floor(us * 100 / F.lit(30 * 86400000000)).alias("slice")).agg(F.max(F.abs("value")).alias("peak"))


@query(
    "clip_spans",
    """SELECT DISTINCT l_orderkey, l_partkey, CAST(greatest(least(floor(l_quantity * 2000 * l_discount * 1000 / 100 + 0.5), l_quantity * 2000 - 30000), 0) AS BIGINT) AS from_ms,
    CAST(least(greatest(least(floor(l_quantity * 2000 * l_discount * 1000 / 100 + 0.5), l_quantity * 2000 - 30000), 0) + 30000, l_quantity * 2000) AS BIGINT) AS to_ms FROM lineitem""",
)
def clip_spans(spark: SparkSession, d: str) -> DataFrame:
    """Clips of 30 seconds that start at a share of the track (discount x 1000 per cent of its length)."""
    span = F.struct((F.col("l_discount") * 1000).alias("start"), F.lit(True).alias("percent"), F.lit(30).cast("long").alias("length"))
    rows = table(spark, d, "lineitem").withColumn("s", span).select("l_orderkey", "l_partkey", parse.clip_span(F.col("s"), F.col("l_quantity") * 2000).alias("c"))
    return rows.select("l_orderkey", "l_partkey", "c.from_ms", "c.to_ms").distinct()


RIGHTS = """a AS (SELECT o_orderkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'own' WHEN 'MACHINERY' THEN 'licensed' WHEN 'FURNITURE' THEN 'third_party' ELSE 'unknown' END AS rights, CASE o_orderpriority WHEN '1-URGENT' THEN 'full' WHEN '2-HIGH' THEN 'clip' END AS own_play, CASE o_orderstatus WHEN 'F' THEN 'full' WHEN 'O' THEN 'clip' ELSE 'off' END AS default_play FROM orders JOIN customer ON c_custkey = o_custkey),
    e AS (SELECT o_orderkey, rights, rights <> 'unknown' AS visible, CASE WHEN rights IN ('own', 'licensed') THEN coalesce(own_play, default_play) ELSE 'off' END AS play FROM a)"""


def _access(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    seg, pri, st = F.col("c_mktsegment"), F.col("o_orderpriority"), F.col("o_orderstatus")
    rows = rows.select(
        "o_orderkey",
        F.when(seg == "BUILDING", "own").when(seg == "MACHINERY", "licensed").when(seg == "FURNITURE", "third_party").otherwise("unknown").alias("rights"),
        F.when(pri == "1-URGENT", "full").when(pri == "2-HIGH", "clip").alias("own_play"),
        F.when(st == "F", "full").when(st == "O", "clip").otherwise("off").alias("default_play"),
    )
    return policy.effective(rows)


@query("access_effective", f"WITH {RIGHTS} SELECT o_orderkey, rights, visible, play FROM e")
def access_effective(spark: SparkSession, d: str) -> DataFrame:
    return _access(spark, d).select("o_orderkey", "rights", "visible", "play")


@query("access_counts", f"WITH {RIGHTS} SELECT count(*) FILTER (play = 'full') AS open, count(*) FILTER (play = 'clip') AS clips, count(*) FILTER (visible AND play = 'off') AS listed, count(*) FILTER (NOT visible) AS hidden FROM e")
def access_counts(spark: SparkSession, d: str) -> DataFrame:
    play = F.col("play")
    return _access(spark, d).agg(F.count_if(play == "full").alias("open"), F.count_if(play == "clip").alias("clips"), F.count_if(F.col("visible") & (play == "off")).alias("listed"), F.count_if(~F.col("visible")).alias("hidden"))


CLASSES = r"""r AS (SELECT page_id, CASE WHEN regexp_matches(url, '[?&]utm_') THEN 'junk' WHEN regexp_matches(url, '^https?://[^/]+/en/') THEN 'english' WHEN regexp_matches(url, '^https?://[^/]+/(de|fr|es)/') THEN 'other' WHEN regexp_matches(url, '#') THEN 'anchor' ELSE 'none' END AS rule FROM pages)"""


@query("rule_classify", f"WITH {CLASSES} SELECT page_id, rule, CAST(CASE rule WHEN 'junk' THEN 0.95 WHEN 'english' THEN 0.9 WHEN 'other' THEN 0.7 WHEN 'anchor' THEN 0.5 ELSE 0 END AS DOUBLE) AS confidence FROM r")
def rule_classify(spark: SparkSession, d: str) -> DataFrame:
    return policy.classified(table(spark, d, "pages"), F.col("url"), PAGE_RULES).select("page_id", "rule", "confidence")


PAGE_RULES = [("junk", r"[?&]utm_", 0.95), ("english", r"^https?://[^/]+/en/", 0.9), ("other", r"^https?://[^/]+/(de|fr|es)/", 0.7), ("anchor", r"#", 0.5)]


@query("rule_coverage", f"WITH {CLASSES} SELECT rule, count(*) AS n, CAST(round(100.0 * count(*) / (SELECT count(*) FROM pages), 2) AS DOUBLE) AS share FROM r GROUP BY rule")
def rule_coverage(spark: SparkSession, d: str) -> DataFrame:
    by = policy.classified(table(spark, d, "pages"), F.col("url"), PAGE_RULES).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    total = by.agg(F.sum("n").alias("t"))
    return by.crossJoin(F.broadcast(total)).select("rule", "n", F.round(100.0 * F.col("n") / F.col("t"), 2).alias("share"))  # one row


@query(
    "effective_tags",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, CASE WHEN value > 20 THEN NULL ELSE event_type END AS kind, CASE WHEN value > 10 THEN 'high' END AS level FROM events""",
)
def effective_tags(spark: SparkSession, d: str) -> DataFrame:
    """A file's own tags overlaid by its row's: an empty list removes a tag."""
    own = F.create_map(F.lit("k"), F.array(F.from_json("props", "k string")["k"]), F.lit("kind"), F.array("event_type"))
    row = F.when(F.col("value") > 20, F.create_map(F.lit("kind"), F.array().cast("array<string>"), F.lit("level"), F.array(F.lit("high")))).when(F.col("value") > 10, F.create_map(F.lit("level"), F.array(F.lit("high"))))
    t = tags.overlaid(own, row)
    return table(spark, d, "events").withColumn("t", t).select("event_id", *(F.col("t")[k][0].alias(k) for k in ("k", "kind", "level")))


@query(
    "common_tags",
    """SELECT p_brand, CASE WHEN count(DISTINCT p_type) = 1 AND count(p_type) = count(*) THEN min(p_type) END AS type, CASE WHEN count(DISTINCT p_size) = 1 AND count(p_size) = count(*) THEN min(CAST(p_size AS VARCHAR)) END AS size, count(*) AS n FROM part GROUP BY p_brand, p_name, p_size // 10""",
)
def common_tags(spark: SparkSession, d: str) -> DataFrame:
    """The values that all rows of a group agree on."""
    by = table(spark, d, "part").groupBy("p_brand", "p_name", F.floor(F.col("p_size") / 10).alias("g"))
    return by.agg(tags.agreed("p_type").alias("type"), tags.agreed(F.col("p_size").cast("string")).alias("size"), F.count(F.lit(1)).alias("n")).select("p_brand", "type", "size", "n")


@query(
    "lyrics_lines",
    r"""WITH l AS (SELECT conv_id, turn, i, s[i] AS line FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS s FROM conversations), unnest(range(1, len(s) + 1)) u(i)) SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS at, trim(line) AS line FROM l WHERE trim(line) <> ''""",
)
def lyrics_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return rows.select("conv_id", "turn", "at", F.trim("line").alias("line")).where("line <> ''")


@query(
    "line_at",
    """SELECT a.event_id, arg_max(b.event_id, (b.ts, b.event_id)) AS line FROM events a JOIN events b ON b.user_id = a.user_id AND b.event_type = 'view' AND (b.ts, b.event_id) <= (a.ts, a.event_id) WHERE a.event_type = 'click' GROUP BY a.event_id""",
)
def line_at(spark: SparkSession, d: str) -> DataFrame:
    """The line that plays at a time: the last one at or before it, by one sort of both sides together."""
    both = table(spark, d, "events").where("event_type in ('view', 'click')")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    line = F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w)
    return both.withColumn("line", line).where("event_type = 'click' and line is not null").select("event_id", "line")


@query(
    "translated_names",
    """WITH t AS (SELECT n_nationkey, l.lang, n_name || '-' || l.lang AS text FROM nation, (VALUES ('ja'), ('en'), ('zh')) l(lang) WHERE (n_nationkey + length(l.lang || n_name)) % 2 = 0 OR l.lang = 'zh' AND n_regionkey < 3)
    SELECT n.n_nationkey, coalesce(max(text) FILTER (lang = 'en'), max(text) FILTER (lang = 'ja'), max(text) FILTER (lang = 'zh'), n.n_name) AS shown FROM nation n LEFT JOIN t USING (n_nationkey) GROUP BY n.n_nationkey, n.n_name""",
)
def translated_names(spark: SparkSession, d: str) -> DataFrame:
    """Translations pivoted by language, the first that there is in order of fallback."""
    n = table(spark, d, "nation")
    t = n.select("n_nationkey", "n_name", "n_regionkey", F.explode(F.array(F.lit("ja"), F.lit("en"), F.lit("zh"))).alias("lang"))
    t = t.where(((F.col("n_nationkey") + F.length(F.concat("lang", "n_name"))) % 2 == 0) | (F.col("lang") == "zh") & (F.col("n_regionkey") < 3))
    wide = t.groupBy("n_nationkey").pivot("lang", ["en", "ja", "zh"]).agg(F.max(F.concat("n_name", F.lit("-"), "lang")))
    return n.join(wide, "n_nationkey", "left").select("n_nationkey", F.coalesce("en", "ja", "zh", "n_name").alias("shown"))
