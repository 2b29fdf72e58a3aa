"""Queries of upkeep that reaches several tables: health, re-assignment, merges, names."""

from __future__ import annotations

from pyspark.sql import functions as F

from convolake.operators import activity as A
from convolake.operators import cascades as C
from convolake.operators import health
from convolake.operators import maintenance as M
from convolake.operators import memories as Y
from convolake.storage import table

_NOW = "2024-03-05"


def health_of_hubs(spark, sf_dir):
    """All twelve rules, each user standing for a hub."""
    e = table(spark, sf_dir, "events").withColumnRenamed("user_id", "hub")
    at = lambda kind, least: F.when((F.col("event_type") == kind) & (F.col("value") > least), F.col("ts"))
    status = e.groupBy("hub").agg(
        F.max(at("view", 100)).alias("written_at"),
        F.max(at("purchase", 120)).alias("last_reconcile_at"),
        F.min("ts").alias("started_at"),
        (F.count(at("error", 150)) == 0).alias("reachable"),
        F.round(F.avg(F.when(F.col("event_type") == "click", F.col("value"))), 3).alias("disk_free_gb"),
        F.count_if(F.col("event_type") == "signup").alias("pending_chunks"),
        F.min(at("signup", 100)).alias("oldest_pending_ts"),
    )
    devices = e.groupBy("hub", F.col("event_type").alias("name")).agg(
        (F.max("value") > 100).alias("connected"), F.max(F.when(F.col("value") > 60, F.col("ts"))).alias("last_seen")
    )
    conflicts = e.filter("event_type = 'error' AND value > 120").select("hub", F.col("props").alias("path"))
    imports = e.select("hub", at("click", 150).alias("ingested_at")).dropna()
    kind = F.when(F.col("event_type") == "error", "record_type").when(F.col("event_type") == "view", "entrypoint").otherwise("other")
    drift = e.filter("value > 130").select("hub", kind.alias("category"), F.col("props").alias("value"), F.lit(1).alias("n"))
    return health.warnings(status, devices, conflicts, imports, drift, F.lit(_NOW).cast("timestamp_ntz"))


HEALTH_SQL = f"""
WITH e AS (SELECT user_id AS hub, * FROM events),
s AS (SELECT hub, max(ts) FILTER (event_type = 'view' AND value > 100) AS w, max(ts) FILTER (event_type = 'purchase' AND value > 120) AS r, min(ts) AS b,
  count(*) FILTER (event_type = 'error' AND value > 150) = 0 AS reachable, round(avg(value) FILTER (event_type = 'click'), 3) AS disk,
  count(*) FILTER (event_type = 'signup') AS pending, min(ts) FILTER (event_type = 'signup' AND value > 100) AS o FROM e GROUP BY hub),
a AS (SELECT *, CAST(epoch(TIMESTAMP '{_NOW}') - floor(epoch(w)) AS BIGINT) AS wa, CAST(epoch(TIMESTAMP '{_NOW}') - floor(epoch(r)) AS BIGINT) AS ra,
  CAST(epoch(TIMESTAMP '{_NOW}') - floor(epoch(b)) AS BIGINT) AS ba, CAST(epoch(TIMESTAMP '{_NOW}') - floor(epoch(o)) AS BIGINT) AS oa FROM s),
d AS (SELECT hub, event_type AS name, max(value) > 100 AS connected, CAST(epoch(TIMESTAMP '{_NOW}') - floor(epoch(max(ts) FILTER (value > 60))) AS BIGINT) AS age FROM e GROUP BY ALL),
i AS (SELECT hub, CAST(epoch(TIMESTAMP '{_NOW}') - floor(epoch(max(ts))) AS BIGINT) AS age FROM e WHERE event_type = 'click' AND value > 150 GROUP BY hub)
SELECT hub, 'heartbeat_missing' AS rule, NULL::VARCHAR AS subject, NULL::BIGINT AS seconds, NULL::BIGINT AS n FROM a WHERE w IS NULL
UNION ALL SELECT hub, 'heartbeat_old', NULL, wa, NULL FROM a WHERE wa > 600
UNION ALL SELECT hub, 'reconcile_old', NULL, ra, NULL FROM a WHERE ra > 3600
UNION ALL SELECT hub, 'never_reconciled', NULL, ba, NULL FROM a WHERE r IS NULL AND ba > 3600
UNION ALL SELECT hub, 'sync_unreachable', NULL, NULL, NULL FROM a WHERE NOT reachable
UNION ALL SELECT hub, 'disk_low', NULL, NULL, CAST(floor(disk) AS BIGINT) FROM a WHERE disk < 30
UNION ALL SELECT hub, 'embedding_backlog', NULL, oa, pending FROM a WHERE oa > 86400
UNION ALL SELECT hub, 'device_never_seen', name, NULL, NULL FROM d WHERE NOT connected AND age IS NULL
UNION ALL SELECT hub, 'device_gone', name, age, NULL FROM d WHERE NOT connected AND age > 86400
UNION ALL SELECT hub, 'conflict_files', min(props), NULL, count(*) FROM e WHERE event_type = 'error' AND value > 120 GROUP BY hub
UNION ALL SELECT hub, 'export_old', NULL, age, NULL FROM i WHERE age > 45 * 86400
UNION ALL SELECT hub, 'format_drift', CASE event_type WHEN 'error' THEN 'record_type' ELSE 'entrypoint' END, NULL, count(*) FROM e
  WHERE value > 130 AND event_type IN ('error', 'view') GROUP BY hub, event_type
"""


def _moves(spark, sf_dir):
    """Nations are keys of regions: all of the first region's move to the second, and INDIA to the fourth."""
    n = table(spark, sf_dir, "nation")
    keys = n.select(F.col("n_nationkey").alias("key"), F.col("n_regionkey").alias("project_id"))
    first = n.filter("n_regionkey = 0").select(F.col("n_nationkey").alias("key"), F.lit(1).cast("long").alias("project_id"))
    india = n.filter("n_name = 'INDIA'").select(F.col("n_nationkey").alias("key"), F.lit(3).cast("long").alias("project_id"))
    return (*C.reassigned(keys.withColumn("project_id", F.col("project_id").cast("long")), first.unionByName(india)), keys)


_NOW_SQL = """
WITH k AS (SELECT n_nationkey AS key, n_regionkey::BIGINT AS old, CASE WHEN n_regionkey = 0 THEN 1 WHEN n_name = 'INDIA' THEN 3 ELSE n_regionkey END::BIGINT AS now FROM nation)
"""


def cascade_keys(spark, sf_dir):
    return _moves(spark, sf_dir)[0]


def cascade_memories(spark, sf_dir):
    """Customers carry their own key beside the project."""
    _, moves, emptied, keys = _moves(spark, sf_dir)
    rows = table(spark, sf_dir, "customer").join(F.broadcast(keys), F.col("c_nationkey") == F.col("key"))
    rows = rows.select("c_custkey", F.col("key").alias("project_key"), F.col("project_id").cast("long").alias("project_id"))
    return C.moved_rows(rows, moves, emptied)


def cascade_chunks(spark, sf_dir):
    """Suppliers only know their project; those whose project was emptied are pending again."""
    _, _, emptied, keys = _moves(spark, sf_dir)
    rows = table(spark, sf_dir, "supplier").join(F.broadcast(keys), F.col("s_nationkey") == F.col("key"))
    rows = rows.select("s_suppkey", F.col("project_id").cast("long").alias("project_id"), (F.col("s_suppkey") % 7 == 0).alias("pending"))
    return C.moved_projects(rows, emptied, "pending")


def cascade_projects(spark, sf_dir):
    _, _, emptied, _ = _moves(spark, sf_dir)
    rows = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("project_id"), "r_name", F.lit("auto").alias("created_by"))
    return C.remaining(rows, emptied)


def automated_flags(spark, sf_dir):
    """Orders as documents, flagged as their customer's kind has it now."""
    kinds = F.when(F.col("c_mktsegment") == "MACHINERY", "automated").otherwise("interactive")
    sessions = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session"), kinds.alias("kind"))
    docs = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("session"), (F.col("o_orderstatus") == "O").alias("automated"))
    return C.flagged(docs, sessions).groupBy("session").agg(F.count_if("automated").alias("automated"), F.count("*").alias("n"))


def title_documents(spark, sf_dir):
    """Conversations as documents, with one document for the title of each, its first prompt."""
    c = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "system", "session").otherwise("message")
    docs = c.select(kind.alias("doc_type"), F.col("conv_id").alias("session"), "text")
    prompt = F.when(F.col("role") == "user", F.col("turn"))
    sessions = c.groupBy(F.col("conv_id").alias("session")).agg(F.min_by(F.substring("text", 1, 60), prompt).alias("title"))
    return C.titled(docs, sessions)


def merge_without_stale(spark, sf_dir):
    """Customers of two segments each as two indexes; of theirs alone, those without an order are stale."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    ours = c.filter("c_mktsegment IN ('BUILDING', 'MACHINERY')").select("c_custkey", F.col("c_custkey").alias("place"), F.round("c_acctbal", 2).alias("hook"))
    theirs = c.filter("c_mktsegment IN ('MACHINERY', 'HOUSEHOLD')").select("c_custkey", F.col("c_custkey").alias("place"), F.round(F.col("c_acctbal") + 1, 2).alias("hook"))
    live = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    kept = M.without_stale(theirs, ours, live, "c_custkey")
    return M.union_merged(ours, kept, "c_custkey", "place", F.col("t.hook") > 1000)


def project_names(spark, sf_dir):
    """A unique name for the folder of every page."""
    path = F.regexp_extract("url", r"://([^?#]*)", 1)
    key = F.concat(F.lit("-"), F.regexp_replace(path, "[^A-Za-z0-9]", "-"))
    pages = table(spark, sf_dir, "pages").select("page_id", key.alias("key"), F.regexp_replace(path, "/[0-9]+/?$", "").alias("cwd"))
    return A.named(pages.select("page_id", A.alias(F.col("key"), F.col("cwd")).alias("base")), "base", "page_id")


NAMES_SQL = r"""
WITH p AS (SELECT page_id, regexp_replace(regexp_extract(url, '://([^?#]*)', 1), '/[0-9]+/?$', '') AS cwd FROM pages),
s AS (SELECT page_id, list_filter(string_split(cwd, '/'), lambda x: x <> '') AS parts FROM p),
b AS (SELECT page_id, coalesce(nullif(trim(regexp_replace(lower(array_to_string(parts[greatest(len(parts) - 1, 1):], '-')), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'project') AS base FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY page_id) AS k FROM b),
t AS (SELECT DISTINCT regexp_extract(base, '^(.*)-([1-9]\d{0,8})$', 1) AS of, CAST(regexp_extract(base, '-([1-9]\d{0,8})$', 1) AS INT) AS n
      FROM b WHERE regexp_matches(base, '^.+-[1-9]\d{0,8}$')),
g AS (SELECT of, list(n) AS taken FROM t GROUP BY of)
SELECT page_id, base, CASE WHEN k = 1 THEN base ELSE base || '-' ||
  list_filter(range(2, k + coalesce(len(taken), 0) + 2), lambda x: NOT coalesce(list_contains(taken, x), false))[k - 1] END AS name
FROM r LEFT JOIN g ON g.of = base
"""

def _memories(spark, sf_dir):
    """Customers as memories, and their orders as requests to save or archive them; a third of these have read another version."""
    c = table(spark, sf_dir, "customer").select(
        F.lit("p").alias("project"), F.concat(F.lit("m"), F.col("c_custkey").cast("string")).alias("name"), F.col("c_mktsegment").alias("title"),
        F.lit("").alias("description"), F.lit("user").alias("type"), F.concat(F.lit("body "), F.col("c_custkey").cast("string")).alias("body"),
    )
    c = c.withColumn("sha256", Y.digest(*Y.FIELDS))
    status = F.col("o_orderstatus")
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("seq"), F.lit("p").alias("project"),
        F.concat(F.when(status == "P", "n").otherwise("m"), F.col("o_custkey").cast("string")).alias("name"),
        F.when(status == "O", "append").when(status == "F", "replace").otherwise("create").alias("mode"),
    )
    read = c.select("name", F.col("sha256").alias("expected"))
    asked = o.join(read, "name", "left").withColumn("expected", F.when(F.col("seq") % 3 > 0, F.col("expected")))
    given = {"title": F.when(F.col("mode") == "append", "").otherwise("T"), "description": F.lit("d"), "type": F.lit("project")}
    return c, asked.withColumns(given | {"body": F.concat(F.lit("note "), F.col("seq").cast("string"))})


def memory_saves(spark, sf_dir):
    """Memories after all requests to save them."""
    after, _ = Y.saved(*_memories(spark, sf_dir))
    return after.select("name", "title", "description", "type", "body", "sha256")


def memory_outcomes(spark, sf_dir):
    """What became of each request."""
    return Y.saved(*_memories(spark, sf_dir))[1]


_MEMORIES_SQL = """
WITH m AS (SELECT 'm' || c_custkey AS name, c_mktsegment AS title, '' AS description, 'user' AS type, 'body ' || c_custkey AS body FROM customer),
v AS (SELECT *, sha256(title || chr(31) || description || chr(31) || type || chr(31) || body) AS sha256 FROM m),
o AS (SELECT o_orderkey AS seq, CASE o_orderstatus WHEN 'P' THEN 'n' ELSE 'm' END || o_custkey AS name, CASE o_orderstatus WHEN 'O' THEN 'append' WHEN 'F' THEN 'replace' ELSE 'create' END AS mode FROM orders),
j AS (SELECT o.*, v.title, v.type, v.body, v.sha256, CASE WHEN mode = 'create' THEN 'done' WHEN v.name IS NULL THEN 'missing' WHEN seq % 3 = 0 THEN 'changed' ELSE 'done' END AS first
  FROM o LEFT JOIN v ON v.name = o.name),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY first <> 'done', seq) AS k FROM j),
t AS (SELECT *, CASE WHEN first = 'done' AND k > 1 THEN CASE mode WHEN 'create' THEN 'exists' ELSE 'changed' END ELSE first END AS outcome FROM r),
f AS (SELECT name, CASE WHEN mode = 'append' THEN title ELSE 'T' END AS title, 'd' AS description, 'project' AS type,
  CASE WHEN mode = 'append' THEN body || chr(10) || chr(10) ELSE '' END || 'note ' || seq AS body FROM t WHERE outcome = 'done'),
n AS (SELECT *, sha256(title || chr(31) || description || chr(31) || type || chr(31) || body) AS sha256 FROM f)
"""


def drift_counters(spark, sf_dir):
    """Counts of events by kind and day, the later half added to the earlier."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("category"), F.date_format("ts", "yyyy-MM-dd").alias("value"), "event_id")
    early = e.filter("value < '2024-01-16'").groupBy("category", "value").agg(F.count("*").alias("n"))
    late = e.filter("value >= '2024-01-16'").select("category", F.lit("late").alias("value"), F.lit(1).cast("long").alias("n"))
    return Y.counted(early, late.unionByName(early), "category", "value")


QUERIES = {
    f.__name__: f
    for f in (
        health_of_hubs, cascade_keys, cascade_memories, cascade_chunks, cascade_projects, automated_flags, title_documents,
        merge_without_stale, project_names, memory_saves, memory_outcomes, drift_counters,
    )
}

ORACLE_SQL = {
    "health_of_hubs": HEALTH_SQL,
    "cascade_keys": f"{_NOW_SQL} SELECT key, now AS project_id FROM k",
    "cascade_memories": f"{_NOW_SQL} SELECT c_custkey, key AS project_key, now AS project_id FROM customer JOIN k ON c_nationkey = key",
    "cascade_chunks": f"""{_NOW_SQL} SELECT s_suppkey, CASE WHEN old = 0 THEN 1 ELSE old END AS project_id, s_suppkey % 7 = 0 OR old = 0 AS pending
        FROM supplier JOIN k ON s_nationkey = key""",
    "cascade_projects": "SELECT r_regionkey::BIGINT AS project_id, r_name, 'auto' AS created_by FROM region WHERE r_regionkey <> 0",
    "automated_flags": """SELECT o_custkey AS session, count(*) FILTER (coalesce(c_mktsegment = 'MACHINERY', o_orderstatus = 'O')) AS automated, count(*) AS n
        FROM orders LEFT JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey""",
    "title_documents": """WITH t AS (SELECT conv_id AS session, arg_min(substr(text, 1, 60), turn) FILTER (role = 'user') AS title FROM conversations GROUP BY conv_id),
        n AS (SELECT * FROM t WHERE coalesce(title, '') <> '')
        SELECT CASE WHEN role = 'system' THEN 'session' ELSE 'message' END AS doc_type, conv_id AS session, text FROM conversations
        WHERE NOT (role = 'system' AND conv_id IN (SELECT session FROM n))
        UNION ALL SELECT 'session', session, title FROM n""",
    "merge_without_stale": """WITH o AS (SELECT c_custkey, round(c_acctbal, 2) AS hook FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')),
        t AS (SELECT c_custkey, round(c_acctbal + 1, 2) AS hook FROM customer WHERE c_mktsegment IN ('MACHINERY', 'HOUSEHOLD')
              AND (c_custkey IN (SELECT c_custkey FROM o) OR c_custkey IN (SELECT o_custkey FROM orders)))
        SELECT coalesce(o.c_custkey, t.c_custkey) AS c_custkey, o.c_custkey IS NULL AS added, coalesce(o.c_custkey, t.c_custkey) AS place,
          CASE WHEN o.c_custkey IS NULL OR t.hook > 1000 THEN t.hook ELSE o.hook END AS hook FROM o FULL JOIN t ON o.c_custkey = t.c_custkey""",
    "project_names": NAMES_SQL,
    "memory_saves": f"{_MEMORIES_SQL} SELECT * FROM v WHERE name NOT IN (SELECT name FROM n) UNION ALL SELECT * FROM n",
    "memory_outcomes": f"{_MEMORIES_SQL} SELECT seq, outcome FROM t",
    "drift_counters": """WITH e AS (SELECT event_type AS category, strftime(ts, '%Y-%m-%d') AS value FROM events),
        a AS (SELECT category, value, 2 * count(*) AS n FROM e WHERE value < '2024-01-16' GROUP BY ALL)
        SELECT * FROM a UNION ALL SELECT category, 'late', count(*) FROM e WHERE value >= '2024-01-16' GROUP BY category""",
}
