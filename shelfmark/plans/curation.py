"""Curating a catalogue: checks before rows come in, guarded writes, placement, merging, undo, track lists, playing, publishing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.functions.text import folded
from shelfmark.operators import changelog, graph, placement, policy, predicates, rules, tasks, tracks
from shelfmark.plans.catalogue import query
from shelfmark.plans.editions import lines_of_orders, named_lines
from shelfmark.plans.fields import _folder, _n
from shelfmark.plans.history import REV, TREE, nodes
from shelfmark.sources.tables import table

# catalogue and rules


@query(
    "catalogue_problems",
    r"""WITH r AS (SELECT p_partkey AS row, CASE WHEN p_size % 11 = 0 THEN p_name ELSE 'r' || (p_partkey // 20 * 20 + p_size % 20) END AS id, CASE p_size % 7 WHEN 0 THEN 'old' ELSE 'new' END AS era, p_type AS kind, CASE WHEN p_size % 13 > 0 THEN p_name END AS title, CASE WHEN p_partkey % 5 = 0 THEN CASE WHEN p_size % 2 = 0 THEN 'ab-' ELSE 'AB-' END || (p_partkey % 100) END AS no, CASE p_size % 3 WHEN 0 THEN '2001-04' WHEN 1 THEN '2001-4' END AS day, CASE WHEN p_size % 17 > 0 THEN 'collected' END AS slot FROM part)
    SELECT row, id, CASE WHEN NOT regexp_matches(id, '^[a-z0-9][a-z0-9-]*$') THEN 'bad id' WHEN row <> min(row) OVER (PARTITION BY id) THEN 'duplicate id' WHEN era = 'old' THEN 'unknown era' WHEN kind NOT IN ('PROMO', 'ECONOMY', 'STANDARD') THEN 'unknown kind' WHEN title IS NULL THEN 'no title' WHEN no IS NOT NULL AND row <> min(row) OVER (PARTITION BY upper(no)) THEN 'duplicate number' WHEN NOT regexp_matches(day, '^\d{4}(-\d{2}(-\d{2})?)?$') THEN 'bad date' WHEN slot IS NULL THEN 'no status' END AS problem FROM r""",
)
def catalogue_problems(spark: SparkSession, d: str) -> DataFrame:
    """Catalogue rows as a file holds them (here JSON lines), read back and checked."""
    size, key = F.col("p_size"), F.col("p_partkey")
    made = table(spark, d, "part").select(
        key.alias("row"),
        F.when(size % 11 == 0, F.col("p_name")).otherwise(F.concat(F.lit("r"), (F.floor(key / 20) * 20 + size % 20).cast("string"))).alias("id"),
        F.when(size % 7 == 0, "old").otherwise("new").alias("era"),
        F.col("p_type").alias("kind"),
        F.when(size % 13 > 0, F.col("p_name")).alias("title"),
        F.when(key % 5 == 0, F.concat(F.when(size % 2 == 0, "ab-").otherwise("AB-"), (key % 100).cast("string"))).alias("catalog_no"),
        F.when(size % 3 == 0, "2001-04").when(size % 3 == 1, "2001-4").alias("release_date"),
        F.when(size % 17 > 0, "collected").alias("slot"),
    )
    at = _folder(spark, "catalogues")
    made.write.json(at)
    return rules.problems(spark.read.schema(made.schema).json(at), {"new"}, {"PROMO", "ECONOMY", "STANDARD"})


RULES = [
    {"name": "spanish", "pattern": r"^https?://[^/]+/es/", "confidence": 0.9, "role": "text", "keep": True},
    {"name": "feed", "pattern": r"[?&]utm_", "confidence": 0.6, "role": "copy"},
    {"name": "below host", "pattern": r"^https?://[^/]+", "confidence": 0.3, "keep": True},
]


@query(
    "rules_applied",
    r"""SELECT page_id, CASE WHEN regexp_matches(url, '^https?://[^/]+/es/') THEN 'spanish' WHEN regexp_matches(url, '[?&]utm_') THEN 'feed' ELSE 'below host' END AS rule, CASE rule WHEN 'spanish' THEN 0.9::DOUBLE WHEN 'feed' THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END AS confidence, CASE rule WHEN 'spanish' THEN 'text' WHEN 'feed' THEN 'copy' END AS role,
    CASE rule WHEN 'feed' THEN '' ELSE regexp_replace(regexp_replace(trim(regexp_replace(url, CASE rule WHEN 'spanish' THEN '^https?://[^/]+/es/' ELSE '^https?://[^/]+' END, ''), '/'), '/?[^/]*$', ''), '/+', '/', 'g') END AS folders FROM pages""",
)
def rules_applied(spark: SparkSession, d: str) -> DataFrame:
    """Validated rules in order; a rule may keep the folders below the end of its match."""
    found = rules.applied(F.col("url"), rules.checked(RULES, {"role": {"text", "copy"}}), ["role"])
    return table(spark, d, "pages").select("page_id", found.alias("x")).select("page_id", "x.rule", "x.confidence", "x.role", "x.folders")


@query(
    "title_in_text",
    r"""WITH w AS (SELECT doc_id AS id, ' ' || trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')) || ' ' AS hay FROM documents WHERE doc_id IS NOT NULL), n AS (SELECT DISTINCT item_id AS release, array_to_string(string_split(trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')), ' ')[2:2 + item_id % 3], ' ') AS name FROM benchmark),
    h AS (SELECT id, release, length(name) AS size FROM w JOIN n ON name <> '' AND contains(hay, ' ' || name || ' ')), m AS (SELECT id, size, min(release) AS a, max(release) AS b, row_number() OVER (PARTITION BY id ORDER BY size DESC) AS rn FROM h GROUP BY id, size)
    SELECT id, a AS release FROM m WHERE rn = 1 AND a = b""",
)
def title_in_text(spark: SparkSession, d: str) -> DataFrame:
    words = lambda c: F.split(F.trim(F.regexp_replace(F.lower(c), "[^a-z]+", " ")), " ")
    names = table(spark, d, "benchmark").select(F.col("item_id").alias("release"), F.array_join(F.slice(words("text"), F.lit(2), (F.col("item_id") % 3 + 1).cast("int")), " ").alias("name")).where("name <> ''").distinct()
    return rules.titles_in(table(spark, d, "documents").select(F.col("doc_id").alias("id"), words("text").alias("words")), names)


# guarded writes


@query(
    "guarded_insert",
    "SELECT c_custkey AS id, c_nationkey AS parent FROM customer WHERE c_custkey % 2 = 1 AND c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 50) AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey > 0)",
)
def guarded_insert(spark: SparkSession, d: str) -> DataFrame:
    """What was deleted stays deleted (undone deletions aside), and what has no parent waits."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("parent"))
    deleted = table(spark, d, "events").where("event_type = 'error' and value > 50").select(F.col("user_id").alias("id"))
    parents = table(spark, d, "nation").where("n_regionkey > 0").select(F.col("n_nationkey").alias("parent"))
    return changelog.guarded(rows.where("id % 2 = 0"), rows, "id", deleted, parents, "parent")


@query("ensured_folders", "SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'old' || s_suppkey ELSE 'fd_' || left(sha1('s' || s_suppkey), 16) END AS id, 's' || s_suppkey AS entity_id FROM supplier")
def ensured_folders(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("s"), _n("s_suppkey")).alias("entity_id"))
    there = s.where("s_suppkey % 3 = 0").select(F.concat(F.lit("old"), _n("s_suppkey")).alias("id"), "entity_id")
    once = changelog.ensured(there, s)
    return changelog.ensured(once, s)  # a second run changes nothing


@query("default_forms", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'own' WHEN p_type IN (SELECT p_type FROM part WHERE p_size < 3) THEN p_type END AS form FROM part")
def default_forms(spark: SparkSession, d: str) -> DataFrame:
    """A form that is null takes the kind, where that is a known form."""
    p = table(spark, d, "part")
    known = p.where("p_size < 3").select("p_type", F.lit(True).alias("known")).distinct()
    form = F.when(F.col("p_size") % 2 == 0, "own")
    return p.join(known, "p_type", "left").select("p_partkey", F.coalesce(form, F.when(F.col("known"), F.col("p_type"))).alias("form"))


@query(
    "derived_orphans",
    """WITH d AS (SELECT DISTINCT l_orderkey AS content, l_partkey * 1000 + l_suppkey AS key FROM lineitem), a AS (SELECT * FROM d WHERE content % 3 > 0 UNION ALL SELECT DISTINCT l_orderkey, l_partkey * 1000 + l_suppkey FROM lineitem WHERE l_orderkey % 3 = 0 AND l_returnflag = 'R')
    SELECT DISTINCT key FROM d WHERE content % 3 = 0 AND key NOT IN (SELECT key FROM a)""",
)
def derived_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Stored files that a content's new set and all other contents no longer use."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("content"), (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("key"), "l_returnflag")
    contents = lines.where("content % 3 = 0").select("content").distinct()
    outputs = lines.where("content % 3 = 0 and l_returnflag = 'R'").select("content", "key").distinct()
    return changelog.replaced(lines.select("content", "key").distinct(), outputs, contents)[1]


@query("inserted_new", "SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'old' ELSE 'new' END AS origin FROM part")
def inserted_new(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    base = p.where("p_size % 2 = 0").select(F.col("p_partkey").alias("id"), F.lit("old").alias("origin"))
    rows = p.select(F.col("p_partkey").alias("id"), F.lit("new").alias("origin"))
    return changelog.insert_new(base, rows.unionAll(rows), ["id"])


@query(
    "replaced_pairs",
    "WITH p AS (SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem WHERE l_partkey <> l_suppkey) SELECT a, b, 'old' AS run FROM p WHERE a % 4 > 0 AND b % 4 > 0 UNION ALL SELECT a, b, 'new' FROM p WHERE (a % 4 = 0 OR b % 4 = 0) AND (a + b) % 2 = 0",
)
def replaced_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The pairs that touch the new ids go; the new run's come in canonical order."""
    li = table(spark, d, "lineitem").where("l_partkey <> l_suppkey").select(F.col("l_partkey").alias("b"), F.col("l_suppkey").alias("a")).distinct()
    pairs = li.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    new = pairs.where("(a % 4 = 0 or b % 4 = 0) and (a + b) % 2 = 0").select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit("new").alias("run"))
    ids = pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")).where("id % 4 = 0").distinct()
    return changelog.replace_pairs(pairs.withColumn("run", F.lit("old")), ids, new)


# placement

CHOSEN = "id = 'r0' OR id LIKE 'n%' AND CAST(substr(id, 2) AS BIGINT) % 3 = 0 OR id LIKE 'c%' AND CAST(substr(id, 2) AS BIGINT) % 7 = 0"


@query("selection_roots", f"WITH {TREE}, c AS (SELECT id FROM n WHERE {CHOSEN}) SELECT id FROM c WHERE id NOT IN (SELECT descendant FROM tree WHERE depth > 0 AND ancestor IN (SELECT id FROM c))")
def selection_roots(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d)
    return placement.roots(n.where(CHOSEN).select("id"), graph.closure(n))


MOVES = """m AS (SELECT 'c' || c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'n' || (c_custkey % 25) WHEN 1 THEN 'r' || (c_custkey % 5) WHEN 2 THEN 'o0' END AS parent FROM customer UNION ALL SELECT 'n' || n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'r' || (n_nationkey % 5) WHEN 1 THEN 'n' || ((n_nationkey + 1) % 25) WHEN 2 THEN 'c' || n_nationkey END FROM nation UNION ALL SELECT 'r' || r_regionkey, CASE WHEN r_regionkey % 2 = 1 THEN 'n' || r_regionkey END FROM region)"""


@query(
    "placement_problems",
    f"""WITH {TREE}, {MOVES}, e AS (SELECT 'c' || c_custkey AS id, c_mktsegment AS slot, right(c_name, 1) AS name, 'n' || c_nationkey AS parent FROM customer),
    x AS (SELECT m.id, m.parent, k.kind, p.kind AS pk, m.parent IN (SELECT descendant FROM tree WHERE ancestor = m.id) AS inside, EXISTS (SELECT 1 FROM tree JOIN n a ON a.id = ancestor WHERE descendant = m.parent AND a.kind = 'era') AS in_era, EXISTS (SELECT 1 FROM tree JOIN n a ON a.id = ancestor WHERE descendant = m.parent AND a.kind = 'release') AS in_release, EXISTS (SELECT 1 FROM e JOIN e y ON y.id = m.id AND y.slot = e.slot AND y.name = e.name WHERE e.parent = m.parent AND e.id <> m.id) AS clash FROM m JOIN n k ON k.id = m.id LEFT JOIN n p ON p.id = m.parent)
    SELECT id, parent, CASE WHEN inside THEN 'inside itself' WHEN kind = 'era' THEN CASE WHEN parent IS NOT NULL THEN 'era below the top' END WHEN kind = 'edition' THEN CASE WHEN coalesce(pk, '') <> 'release' THEN 'edition outside a release' WHEN clash THEN 'same edition there' END WHEN NOT in_era THEN 'release outside an era' WHEN in_release THEN 'release inside a release' END AS problem FROM x""",
)
def placement_problems(spark: SparkSession, d: str) -> DataFrame:
    node = lambda mark, c: F.concat(F.lit(mark), c.cast("string"))
    c, n, r = F.col("c_custkey"), F.col("n_nationkey"), F.col("r_regionkey")
    moves = table(spark, d, "customer").select(node("c", c).alias("id"), F.when(c % 4 == 0, node("n", c % 25)).when(c % 4 == 1, node("r", c % 5)).when(c % 4 == 2, F.lit("o0")).alias("parent"))
    moves = moves.unionAll(table(spark, d, "nation").select(node("n", n), F.when(n % 4 == 0, node("r", n % 5)).when(n % 4 == 1, node("n", (n + 1) % 25)).when(n % 4 == 2, node("c", n))))
    moves = moves.unionAll(table(spark, d, "region").select(node("r", r), F.when(r % 2 == 1, node("n", r))))
    editions = table(spark, d, "customer").select(node("c", c).alias("id"), F.col("c_mktsegment").alias("slot"), F.right("c_name", F.lit(1)).alias("name"))
    folders = nodes(spark, d)
    return placement.problems(moves, folders, graph.closure(folders), editions)


PATHS = "p AS (SELECT page_id, string_split(regexp_extract(url, '^https?://[^/]*/([^?#]*)', 1), '/') AS s FROM pages), f AS (SELECT DISTINCT page_id % 2 AS side, array_to_string(s[1:i], '/') AS path FROM p, unnest(range(1, len(s) + 1)) u(i) WHERE s[i] <> '')"


@query(
    "folder_merge",
    f"WITH {PATHS} SELECT x.path, CASE WHEN x.path IN (SELECT path FROM f WHERE side = 1) THEN 'merge' WHEN up = '' OR up IN (SELECT path FROM f WHERE side = 1) THEN 'move' ELSE 'along' END AS action FROM (SELECT path, regexp_replace(path, '/?[^/]*$', '') AS up FROM f WHERE side = 0) x",
)
def folder_merge(spark: SparkSession, d: str) -> DataFrame:
    """The folders of even pages put into those of odd ones."""
    s = F.split(F.regexp_extract("url", r"^https?://[^/]*/([^?#]*)", 1), "/")
    p = table(spark, d, "pages").select((F.col("page_id") % 2).alias("side"), s.alias("s"))
    each = F.transform(F.sequence(F.lit(1), F.size("s")), lambda i: F.when(F.get(F.col("s"), i - 1) != "", F.array_join(F.slice("s", F.lit(1), i), "/")))
    f = p.select("side", F.explode(each).alias("path")).where("path is not null")
    return placement.merged(f.where("side = 0"), f.where("side = 1"))


# undo


@query(
    "undo_refused",
    "SELECT batch, CAST(count(*) AS BIGINT) AS later FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS batch FROM orders WHERE o_orderstatus = 'F') JOIN lineitem ON l_orderkey = o_orderkey AND strftime(l_shipdate, '%Y-%m') <> batch GROUP BY batch",
)
def undo_refused(spark: SparkSession, d: str) -> DataFrame:
    """Batches (months) whose orders later batches' lines point into: an undo would lose those."""
    made = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.date_format("o_orderdate", "yyyy-MM").alias("batch"), F.col("o_orderkey").alias("id"))
    pointing = table(spark, d, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM").alias("batch"), F.col("l_orderkey").alias("id"))
    return changelog.refused(made, pointing)


@query(
    "undo_marks",
    "WITH u AS (SELECT o_orderkey AS batch, o_orderpriority, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS undoes FROM orders), v AS (SELECT batch, undoes FROM u WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND undoes IS NOT NULL) SELECT undoes AS batch, batch AS reverted_by FROM v WHERE batch NOT IN (SELECT undoes FROM v)",
)
def undo_marks(spark: SparkSession, d: str) -> DataFrame:
    """Urgent batches undo the customer's batch before; undoing an undo takes its mark away."""
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    undos = table(spark, d, "orders").select(F.col("o_orderkey").alias("batch"), "o_orderpriority", before.alias("undoes")).where("o_orderpriority in ('1-URGENT', '2-HIGH') and undoes is not null")
    return changelog.undo_marks(undos.select("batch", "undoes"))


# playing and publishing


@query(
    "play_versions",
    """WITH f AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'own' WHEN 1 THEN 'same' END AS stream, p_size % 5 > 0 AS original, p_size % 2 = 0 AS lossless, p_size % 7 > 2 AS aac, CASE WHEN p_size % 11 = 0 THEN 'none' ELSE 'full' END AS play, CASE p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS cap FROM part),
    v AS (SELECT p_partkey, 1 AS place, 'stream' AS name, 1 AS rank, cap FROM f WHERE stream = 'own' AND play <> 'none' UNION ALL SELECT p_partkey, 2, 'original', CASE WHEN stream = 'same' THEN 1 WHEN lossless THEN 2 ELSE 0 END, cap FROM f WHERE original AND play <> 'none' UNION ALL SELECT p_partkey, 3, 'aac', 0, cap FROM f WHERE aac AND play <> 'none')
    SELECT f.p_partkey, coalesce(string_agg(name || ':' || CASE rank WHEN 0 THEN 'lossy' WHEN 1 THEN 'lossless' ELSE 'original' END || CASE WHEN rank > v.cap THEN ':locked' ELSE '' END, ' ' ORDER BY place), '') AS versions FROM f LEFT JOIN v USING (p_partkey) GROUP BY f.p_partkey""",
)
def play_versions(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    stream = F.when(s % 3 == 0, "own").when(s % 3 == 1, "same")
    cap = F.when(s % 4 == 0, "lossy").when(s % 4 == 1, "lossless").otherwise("original")
    found = policy.play_versions(stream, s % 5 > 0, s % 2 == 0, s % 7 > 2, F.when(s % 11 == 0, "none").otherwise("full"), cap)
    p = table(spark, d, "part").select("p_partkey", found.alias("v"))
    return p.select("p_partkey", F.array_join(F.transform("v", lambda v: F.concat_ws(":", v["version"], v["level"], F.when(v["locked"], "locked"))), " ").alias("versions"))


@query(
    "public_works",
    """WITH l AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL), e AS (SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y') AS year, n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderdate, o_orderkey) AS rn FROM orders LEFT JOIN l ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F')
    SELECT c_custkey, c_name AS title, n_name AS era, coalesce(count(o_orderkey), 0) AS editions, max(n) AS tracks, max(o_orderkey) FILTER (rn = 1) AS first_edition, max(year) FILTER (rn = 1) AS year FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN e ON o_custkey = c_custkey WHERE c_acctbal > 0 GROUP BY ALL""",
)
def public_works(spark: SparkSession, d: str) -> DataFrame:
    """Published works with their editions in order, the longest edition's tracks, and what the first edition says."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    e = table(spark, d, "orders").where("o_orderstatus = 'F'").join(lines, "o_orderkey", "left")
    first = F.min(F.struct("o_orderpriority", "o_orderdate", "o_orderkey")).alias("x")
    own = e.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("editions"), F.max("n").alias("tracks"), first)
    c = table(spark, d, "customer").where("c_acctbal > 0").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(own, "c_custkey", "left")
    return c.select("c_custkey", F.col("c_name").alias("title"), F.col("n_name").alias("era"), F.coalesce("editions", F.lit(0).cast("long")).alias("editions"), "tracks", F.col("x.o_orderkey").alias("first_edition"), F.date_format("x.o_orderdate", "yyyy").alias("year"))


@query(
    "edition_order",
    "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(list_position(['3-MEDIUM', '1-URGENT', '5-LOW'], o_orderpriority), 99), o_orderstatus, coalesce(CASE WHEN o_orderkey % 5 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END, '9999'), o_orderkey) AS place FROM orders",
)
def edition_order(spark: SparkSession, d: str) -> DataFrame:
    """By the types' order, their own order, date (none last), name."""
    at = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ("3-MEDIUM", "1-URGENT", "5-LOW"))), F.col("o_orderpriority")), F.lit(0).cast("long")), F.lit(99).cast("long"))
    day = F.coalesce(F.when(F.col("o_orderkey") % 5 > 0, F.date_format("o_orderdate", "yyyy-MM-dd")), F.lit("9999"))
    w = Window.partitionBy("o_custkey").orderBy(at, "o_orderstatus", day, "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("place"))


@query(
    "shuffled_queue",
    "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey = m DESC, md5('7:' || o_orderkey)) AS place FROM (SELECT *, max(o_orderkey) OVER (PARTITION BY o_custkey) AS m FROM orders)",
)
def shuffled_queue(spark: SparkSession, d: str) -> DataFrame:
    """A queue in an order that a seed decides, the current item first."""
    own = Window.partitionBy("o_custkey")
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") == F.max("o_orderkey").over(own)).alias("current"))
    return o.select("o_custkey", "o_orderkey", F.row_number().over(own.orderBy(F.desc("current"), F.md5(F.concat(F.lit("7:"), _n("o_orderkey")).cast("binary")))).cast("long").alias("place"))


# joins and filters


@query("author_and_editor", "SELECT o_orderkey, a.c_name AS author, e.c_name AS editor FROM orders LEFT JOIN customer a ON a.c_custkey = o_custkey LEFT JOIN customer e ON e.c_custkey = o_custkey + 100")
def author_and_editor(spark: SparkSession, d: str) -> DataFrame:
    who = table(spark, d, "customer")
    a, e = who.select(F.col("c_custkey").alias("a"), F.col("c_name").alias("author")), who.select(F.col("c_custkey").alias("e"), F.col("c_name").alias("editor"))
    o = table(spark, d, "orders")
    return o.join(a, F.col("o_custkey") == F.col("a"), "left").join(e, F.col("o_custkey") + 100 == F.col("e"), "left").select("o_orderkey", "author", "editor")


LISTED = "[7, 3, 11, 3, 100000, 20]"


@query("listed_ids", f"SELECT i - 1 AS at, p_partkey, p_name FROM (SELECT unnest({LISTED}) AS id, unnest(range(1, 7)) AS i) JOIN part ON p_partkey = id")
def listed_ids(spark: SparkSession, d: str) -> DataFrame:
    """A parameter list in JSON as a table, its order kept."""
    listed = spark.range(1).select(F.posexplode(F.from_json(F.lit(LISTED), "array<long>")).alias("at", "p_partkey"))
    return table(spark, d, "part").join(F.broadcast(listed), "p_partkey").select(F.col("at").cast("long").alias("at"), "p_partkey", "p_name")  # a parameter's ids


@query("distinct_coalesced", "SELECT p_brand, count(DISTINCT coalesce(CASE WHEN p_size % 2 = 0 THEN p_type END, p_name)) AS n FROM part GROUP BY p_brand")
def distinct_coalesced(spark: SparkSession, d: str) -> DataFrame:
    shown = F.coalesce(F.when(F.col("p_size") % 2 == 0, F.col("p_type")), F.col("p_name"))
    return table(spark, d, "part").groupBy("p_brand").agg(F.countDistinct(shown).alias("n"))


@query("unread_contents", "SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id AND quality >= 1)")
def unread_contents(spark: SparkSession, d: str) -> DataFrame:
    """Contents that were not read at the current version."""
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").where("quality >= 1").select("doc_id"), "doc_id", "left_anti")


ASOF, LATER = "2024-01-20 00:00:00", "2024-06-01 00:00:00"


@query(
    "wanted_pictures",
    f"""WITH s AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS last, max(ts) AS stamp, count(*) FILTER (event_type = 'error') AS attempts FROM events GROUP BY ALL)
    SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48) AND p_partkey NOT IN (SELECT user_id FROM s WHERE last = 'purchase' OR attempts >= 3 OR last = 'signup' AND stamp > TIMESTAMP '{ASOF}' - INTERVAL 20 MINUTE OR last = 'error' AND stamp > TIMESTAMP '{ASOF}' - INTERVAL 60 MINUTE)""",
)
def wanted_pictures(spark: SparkSession, d: str) -> DataFrame:
    """Pictures that are no files too and whose task is not settled."""
    files = table(spark, d, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey"))
    done = tasks.states(table(spark, d, "events")).where(tasks.settled(ASOF)).select(F.col("id").alias("p_partkey"))
    return table(spark, d, "part").select("p_partkey").join(files, "p_partkey", "left_anti").join(done, "p_partkey", "left_anti")


@query(
    "abandoned_tasks",
    f"""SELECT user_id AS id FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS last, max(ts) AS stamp, count(*) FILTER (event_type = 'error') AS attempts FROM events GROUP BY ALL) WHERE last = 'signup' AND attempts >= 3 AND stamp <= TIMESTAMP '{LATER}' - INTERVAL 20 MINUTE""",
)
def abandoned_tasks(spark: SparkSession, d: str) -> DataFrame:
    return tasks.states(table(spark, d, "events")).where(tasks.abandoned(LATER)).select("id")


@query("task_states", "SELECT user_id AS id, CASE arg_max(event_type, (ts, event_id)) WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'running' ELSE 'open' END AS state, count(*) FILTER (event_type = 'error') AS attempts FROM events GROUP BY user_id")
def task_states(spark: SparkSession, d: str) -> DataFrame:
    return tasks.states(table(spark, d, "events")).select("id", "state", "attempts")


@query(
    "open_rows",
    "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND coalesce(CASE o_orderstatus WHEN 'F' THEN 'full' WHEN 'O' THEN 'off' END, CASE WHEN o_orderkey % 2 = 0 THEN 'clip' END, 'off') <> 'off'",
)
def open_rows(spark: SparkSession, d: str) -> DataFrame:
    """The access rule as a predicate."""
    rights = F.when(F.col("o_orderpriority") == "1-URGENT", "own").when(F.col("o_orderpriority") == "2-HIGH", "licensed").otherwise("unknown")
    own = F.when(F.col("o_orderstatus") == "F", "full").when(F.col("o_orderstatus") == "O", "off")
    o = table(spark, d, "orders").withColumns({"rights": rights, "own_play": own, "default_play": F.when(F.col("o_orderkey") % 2 == 0, "clip")})
    return o.where(policy.open_rows()).select("o_orderkey")


@query("optional_filters", "SELECT p_partkey FROM part WHERE p_size > 20")
def optional_filters(spark: SparkSession, d: str) -> DataFrame:
    """Parameters that are not given filter nothing."""
    given = {"name": None, "size": 20}
    fields = {"name": predicates.Field("text", F.col("p_name")), "size": predicates.Field("number", F.col("p_size"))}
    ops = {"name": "contains", "size": "over"}
    chosen = predicates.RuleSet("all", tuple(predicates.Rule(k, ops[k], v) for k, v in given.items() if v is not None))
    return table(spark, d, "part").where(predicates.compiled(chosen, fields)).select("p_partkey")


@query(
    "title_differences",
    r"""WITH f AS (SELECT l_partkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_linestatus = 'F' DESC, l_extendedprice DESC, l_orderkey, l_linenumber, l_suppkey) AS rn, CAST(l_quantity AS BIGINT) % 4 AS k FROM lineitem), t AS (SELECT p_partkey, p_name, CASE k WHEN 0 THEN '01. ' || upper(p_name) WHEN 1 THEN p_name || ' (live)' WHEN 2 THEN p_name || ' two' ELSE replace(p_name, ' ', '-') END AS title FROM f JOIN part ON p_partkey = l_partkey WHERE rn = 1)
    SELECT p_partkey, title FROM t WHERE regexp_replace(regexp_replace(lower(regexp_replace(title, '^\d{1,3}\s*[.)]\s+', '')), '\([^()]*\)', '', 'g'), '[^a-z0-9]+', '', 'g') <> regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g')""",
)
def title_differences(spark: SparkSession, d: str) -> DataFrame:
    """Titles of each row's best file (lossless first, then the largest) that are not the entry's under the title fold."""
    best = F.max(F.struct((F.col("l_linestatus") == "F").alias("flac"), "l_extendedprice", (-F.col("l_orderkey")).alias("o"), (-F.col("l_linenumber")).alias("n"), (-F.col("l_suppkey")).alias("s"), (F.col("l_quantity").cast("long") % 4).alias("k"))).alias("x")
    f = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(best)
    name, k = F.col("p_name"), F.col("x.k")
    title = F.when(k == 0, F.concat(F.lit("01. "), F.upper(name))).when(k == 1, F.concat(name, F.lit(" (live)"))).when(k == 2, F.concat(name, F.lit(" two"))).otherwise(F.replace(name, F.lit(" "), F.lit("-")))
    t = f.join(table(spark, d, "part"), "p_partkey").select("p_partkey", "p_name", title.alias("title"))
    bare = F.regexp_replace("title", r"^\d{1,3}\s*[.．)）]\s+", "")
    return t.where(folded("title_key", bare) != folded("title_key", "p_name")).select("p_partkey", "title")


@query(
    "candidate_editions",
    """WITH c AS (SELECT o_custkey, o_orderkey, o_orderstatus <> 'O' AS cd, o_orderpriority, CASE WHEN o_orderkey % 6 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders), n AS (SELECT *, count(*) FILTER (cd) OVER (PARTITION BY o_custkey) AS cds, row_number() OVER (PARTITION BY o_custkey, cd ORDER BY coalesce(day, '9999'), o_orderkey) AS rn FROM c)
    SELECT o_orderkey, CASE WHEN cd THEN 'cd_rip' ELSE 'digital' END AS slot, CASE WHEN NOT cd THEN '' WHEN o_orderpriority = '2-HIGH' THEN 'second' WHEN cds = 1 OR rn = 1 THEN 'first' ELSE coalesce(day, '') END AS name FROM n""",
)
def candidate_editions(spark: SparkSession, d: str) -> DataFrame:
    """Type and name of a candidate: the first disc by date, second pressings, the others by their date; what is no disc is digital."""
    cd = F.col("o_orderstatus") != "O"
    day = F.when(F.col("o_orderkey") % 6 > 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", cd.alias("cd"), day.alias("day"))
    first = o.where("cd").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("cds"), F.min(F.struct(F.coalesce("day", F.lit("9999")).alias("d"), "o_orderkey")).alias("x"))
    j = o.join(first, "o_custkey", "left")
    name = F.when(~F.col("cd"), "").when(F.col("o_orderpriority") == "2-HIGH", "second").when((F.col("cds") == 1) | (F.col("x.o_orderkey") == F.col("o_orderkey")), "first").otherwise(F.coalesce("day", F.lit("")))
    return j.select("o_orderkey", F.when(F.col("cd"), "cd_rip").otherwise("digital").alias("slot"), name.alias("name"))


def _key(c: str) -> str:
    return f"regexp_replace(regexp_replace(lower({c}), '\\([^()]*\\)', '', 'g'), '[^a-z0-9]+', '', 'g')"


MATCH_FILES = """r AS (SELECT l_orderkey AS edition, l_linenumber AS row, any_value(p_name ORDER BY p_partkey, l_suppkey) AS title, max(l_quantity) * 1000 AS ms FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL),
    f AS (SELECT edition, row AS file, CASE row % 4 WHEN 0 THEN title WHEN 1 THEN title || ' (live)' WHEN 2 THEN string_split(title, ' ')[1] ELSE 'other' END AS name, ms / 1000 + (row % 3) * 2 AS seconds, edition % 7 = 0 AND row = 1 AS heard FROM r)"""


@query(
    "matched_files",
    rf"""WITH {MATCH_FILES}, k AS (SELECT f.edition, f.file, r.row, f.heard AND r.row = 2 AS heard, regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS fe, {_key("name")} AS fk, regexp_replace(lower(title), '[^a-z0-9]+', '', 'g') AS re, {_key("title")} AS rk, abs(seconds * 1000 - ms) AS gap FROM f JOIN r USING (edition)),
    s AS (SELECT *, CASE WHEN heard THEN 10 ELSE 0 END + CASE WHEN fe = re THEN 10 WHEN fk = rk THEN 6 WHEN least(len(fk), len(rk)) >= 3 AND (ends_with(rk, fk) OR starts_with(rk, fk) OR ends_with(fk, rk) OR starts_with(fk, rk)) THEN 3 ELSE 0 END AS said FROM k),
    t AS (SELECT edition, file, row, CASE WHEN said > 0 OR gap <= 3000 THEN said + CASE WHEN gap <= 1500 THEN 3 WHEN gap <= 3000 THEN 2 WHEN gap <= 6000 THEN 0 ELSE -6 END + CASE WHEN file = row THEN 1 ELSE 0 END ELSE 0 END AS score FROM s),
    b AS (SELECT *, row_number() OVER (PARTITION BY edition, file ORDER BY score DESC) AS rn, lead(score) OVER (PARTITION BY edition, file ORDER BY score DESC) AS next FROM t)
    SELECT edition, file, row, CAST(score AS INTEGER) AS score FROM b WHERE rn = 1 AND score >= 3 AND (next IS NULL OR next < score)""",
)
def matched_files(spark: SparkSession, d: str) -> DataFrame:
    """Files to the rows of their edition; pairs stay within an edition, which bounds them."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    n = lines.count()
    li = graph.dealt(lines, n, "l_partkey").join(graph.dealt(table(spark, d, "part").select("p_partkey", "p_name"), n, "p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
    r = graph.dealt(li, n, "l_orderkey").groupBy(F.col("l_orderkey").alias("edition"), F.col("l_linenumber").alias("row")).agg(F.min(F.struct("p_partkey", "l_suppkey", "p_name")).alias("x"), (F.max("l_quantity") * 1000).alias("ms")).select("edition", "row", F.col("x.p_name").alias("title"), "ms")
    exact = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    loose = lambda c: exact(F.regexp_replace(c, r"\([^()]*\)", ""))
    k = F.col("row") % 4
    name = F.when(k == 0, F.col("title")).when(k == 1, F.concat("title", F.lit(" (live)"))).when(k == 2, F.split("title", " ")[0]).otherwise("other")
    f = r.select("edition", F.col("row").alias("file"), name.alias("name"), (F.col("ms") / 1000 + (F.col("row") % 3) * 2).alias("seconds"))
    f = f.select(F.col("edition").alias("of"), "file", exact(F.col("name")).alias("f_exact"), loose(F.col("name")).alias("f_key"), "seconds", F.lit(1).alias("f_disc"), F.col("file").alias("f_track"))
    e = r.select("edition", "row", "ms", exact(F.col("title")).alias("r_exact"), loose(F.col("title")).alias("r_key"), F.lit(1).alias("r_disc"), F.col("row").alias("r_position"))
    e = e.withColumns({"e_exact": F.col("r_exact"), "e_key": F.col("r_key")})
    heard = (F.col("edition") % 7 == 0) & (F.col("file") == 1) & (F.col("row") == 2)
    return placement.matched(placement.match_scores(f.join(e, F.col("of") == F.col("edition")).withColumn("heard", heard)), ["edition", "file"], "row")


PRESETS = {
    "sure": "place IS NULL AND suggested AND confidence >= 0.8",
    "unsure": "place IS NULL AND suggested AND confidence < 0.5",
    "seal": "suggested_seal AND NOT sealed AND kind = 'archive'",
    "sealed": "sealed",
    "duplicates": "copies > 1",
    "recordings": "matches > 0",
    "third_party": "rights = 'third'",
    "unknown_rights": "rights = 'unknown' AND place IS NOT NULL",
    "recent": "added >= DATE '1998-06-01' - INTERVAL 7 DAY",
    "gone": "origin = 'nas' AND coalesce(last_seen < DATE '1997-01-01', true)",
    "unlinked": "kind = 'audio' AND place IS NOT NULL AND track IS NULL",
    "title_differs": "title_key <> entry_key",
    "format_differs": "ext <> folder_ext",
    "problem_editions": "problems > 0",
}

PRESET_FILES = [
    "CASE o_orderkey % 3 WHEN 0 THEN o_custkey END AS place",
    "o_orderkey % 4 > 0 AS suggested",
    "(o_orderkey % 11) / 10.0 AS confidence",
    "o_orderkey % 9 = 0 AS suggested_seal",
    "o_orderkey % 13 = 0 AS sealed",
    "CASE o_orderstatus WHEN 'F' THEN 'audio' WHEN 'O' THEN 'archive' ELSE 'text' END AS kind",
    "o_custkey % 3 AS copies",
    "o_custkey % 2 AS matches",
    "CASE o_orderpriority WHEN '1-URGENT' THEN 'third' WHEN '5-LOW' THEN 'unknown' ELSE 'own' END AS rights",
    "o_orderdate AS added",
    "CASE WHEN o_orderkey % 2 = 0 THEN 'nas' ELSE 'web' END AS origin",
    "CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate END AS last_seen",
    "CASE WHEN o_orderkey % 6 > 0 THEN o_orderkey END AS track",
    "o_orderkey % 7 AS title_key",
    "o_custkey % 7 AS entry_key",
    "o_orderkey % 2 AS ext",
    "o_custkey % 2 AS folder_ext",
    "o_custkey % 4 AS problems",
]


@query("preset_lists", f"SELECT v.view, v.n FROM (SELECT {', '.join(f'count(*) FILTER ({c}) AS {n}' for n, c in PRESETS.items())} FROM (SELECT {', '.join(PRESET_FILES)} FROM orders)) UNPIVOT (n FOR view IN ({', '.join(PRESETS)})) v")
def preset_lists(spark: SparkSession, d: str) -> DataFrame:
    """The fourteen lists of a desk, counted in one pass."""
    files = table(spark, d, "orders").selectExpr(*PRESET_FILES)
    return predicates.counted(files, {n: F.expr(c) for n, c in PRESETS.items()})


@query(
    "generated_tracks",
    """WITH f AS (SELECT l_orderkey AS edition, l_partkey * 1000000 + l_suppkey * 1000 + l_linenumber * 100 + CAST(l_quantity AS BIGINT) AS id, l_partkey, l_linenumber, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 2 END AS disc, p_name FROM lineitem JOIN part ON p_partkey = l_partkey),
    g AS (SELECT edition, disc, l_linenumber AS track, p_name AS title, count(*) AS n FROM f GROUP BY ALL)
    SELECT edition, CAST(disc AS INTEGER) AS disc, CAST(row_number() OVER (PARTITION BY edition, disc ORDER BY track, title) AS INTEGER) AS position, title, n AS files FROM g""",
)
def generated_tracks(spark: SparkSession, d: str) -> DataFrame:
    """Track lists of orders as editions, their lines as numbered files."""
    x, key = named_lines(spark, d, "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus"), F.replace(F.lower("p_name"), F.lit(" "), F.lit(""))
    none = F.lit(None).cast("long")
    file = F.struct(
        "id", F.when(F.col("l_linestatus") == "F", 1).otherwise(2).alias("disc"), F.col("l_linenumber").cast("int").alias("track"), F.col("p_name").alias("title"), key.alias("name"), key.alias("title_key"), F.col("l_quantity").cast("double").alias("seconds"),
        (F.col("l_returnflag") == "A").alias("lossless"), F.lit(None).cast("string").alias("audio"), none.alias("linked"), none.alias("said"),
    )
    entry = F.struct(F.crc32(key.cast("binary")).alias("track"), key.alias("name"), key.alias("title_key"), F.lit(1).alias("listed"))
    lists = tracks.track_lists_of(x.select(F.col("l_orderkey").alias("edition"), file.alias("file"), entry.alias("entry")), lines_of_orders(spark, d))
    return lists.select("edition", "disc", "position", "title", F.size(F.split("files", ",")).cast("long").alias("files"))


@query("logged_changes", f"WITH {REV} SELECT batch_id, count(*) AS changes, count(*) FILTER (before_v IS NULL) AS created FROM rev GROUP BY batch_id")
def logged_changes(spark: SparkSession, d: str) -> DataFrame:
    """What each batch made and changed."""
    log = changelog.revisions(table(spark, d, "events"))
    return log.groupBy("batch_id").agg(F.count(F.lit(1)).alias("changes"), F.count_if(F.col("before_v").isNull()).alias("created"))
