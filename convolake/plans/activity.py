"""Listing, roll-up and paging queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from convolake.operators import activity as A
from convolake.operators import maintenance as M
from convolake.storage import table


def _groups(spark, sf_dir):
    """Events by (user group, type): the first level of the roll-up."""
    e = table(spark, sf_dir, "events").withColumn("project", F.pmod("user_id", F.lit(7)))
    machine = F.concat(F.lit("m"), F.pmod("event_id", F.lit(3)).cast("string"))
    return e.groupBy("project", F.col("event_type").alias("kind"), machine.alias("machine")).agg(
        F.count("*").alias("n"), F.max("ts").alias("last")
    )


def project_rollup(spark, sf_dir):
    kinds = {"click": "clicks", "view": "views", "purchase": "purchases"}
    return A.rolled_up(_groups(spark, sf_dir), "project", kinds, "n", "last", "machine").select(
        "project", *kinds.values(), "last", F.array_join("machine", ",").alias("machines")
    )


def source_kind_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("source", "lang").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))


def conditional_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("n_large"), F.min("ts").alias("oldest")
    )


def global_counts(spark, sf_dir):
    """Pending work as one row: how much, since when, of how many users."""
    e = table(spark, sf_dir, "events")
    open_ = F.col("event_type") == "click"
    return e.agg(
        F.count_if(open_).alias("pending"), F.min(F.when(open_, F.col("ts"))).alias("since"),
        F.countDistinct(F.when(open_, F.col("user_id"))).alias("users"),
    )


def drift_listagg(spark, sf_dir):
    return A.listed(table(spark, sf_dir, "documents"), "sources", "source", "lang")


def session_filter(spark, sf_dir):
    """Optional conditions: a project, a source without regard to case, bounds, nothing for what isn't given."""
    docs = table(spark, sf_dir, "documents")
    lang, source, least, most = None, "SRC3", 100, None
    return A.filtered(
        docs, (lang, F.col("lang") == lang), (source, F.lower("source") == source.lower()),
        (least, F.col("n_chars") >= least), (most, F.col("n_chars") <= F.lit(most)),
    ).select("doc_id", "source", "n_chars")


def inactive_hidden(spark, sf_dir):
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last"))
    return last.filter(F.col("last") >= F.lit("2024-01-30 20:00:00").cast("timestamp_ntz"))


def timeline_union_topn(spark, sf_dir):
    e, o = table(spark, sf_dir, "events"), table(spark, sf_dir, "orders")
    parts = [
        e.filter(F.col("event_type") == kind).select("ts", F.col("event_id").alias("key"), F.lit(kind).alias("kind"))
        for kind in ("click", "purchase")
    ]
    parts.append(o.select(F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("key"), F.lit("order").alias("kind")))
    return A.timeline(parts, "ts", "key", 30)


def sessions_keyset_page(spark, sf_dir):
    """The second page, after the cursor of a first one's last row."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    ts, key = A.place(A.cursor("2024-01-20 00:00:00", 5000))
    return A.page(e, "ts", "event_id", 20, (ts, key))


def budgeted_page(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return A.budgeted(rows, "conv_id", "turn", F.length("text"), 600).select("conv_id", "turn", "role")


def recent_per_section(spark, sf_dir):
    """The five latest events of every user."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", F.col("event_id").alias("key"), F.col("event_type").alias("kind"))
    return A.recent(e, "user_id", "ts", "key", 5)


def audit_failures_window(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter(F.col("event_type") == "error")
    recent = e.filter(F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz"))
    return recent.groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last"))


def busiest_users(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(20)


def rolling_rate(spark, sf_dir):
    """Events of the same user in the hour up to each event."""
    return spark.sql(
        """SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts
           RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n FROM {e}""",
        e=table(spark, sf_dir, "events"),
    )


def project_resolution(spark, sf_dir):
    names = table(spark, sf_dir, "documents").select("source").distinct()
    found = A.resolved(names, "SRC1", "source", "source").withColumn("q", F.lit("exact"))
    return found.unionByName(A.resolved(names, "src", "source", "source").withColumn("q", F.lit("prefix")))


def longest_prefix_match(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^https?://", "").alias("path"))
    folders = pages.select(F.substring_index("path", "/", 1).alias("folder")).unionByName(
        pages.select(F.substring_index("path", "/", 2).alias("folder"))
    )
    return A.longest_prefix(pages.distinct(), "path", folders, "folder")


def title_fallback(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.lit("")).otherwise(F.col("event_type")).alias("title"), "props")
    return e.select("event_id", A.first_of("title", "props").alias("title"))


def nested_keys(spark, sf_dir):
    """Names of a region's nations in one list, its first one ahead of the rest."""
    n = table(spark, sf_dir, "nation")
    first = n.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("primary"))
    keyed = n.join(F.broadcast(first), "n_regionkey")  # as many rows as there are regions
    item = F.struct((F.col("n_nationkey") != F.col("primary")).alias("a"), F.col("n_name").alias("k"))
    return keyed.groupBy("n_regionkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["k"]), ",").alias("keys"))


def health_rules(spark, sf_dir):
    """Warnings as rows, from a table of rules over one row of measurements."""
    e = table(spark, sf_dir, "events")
    now = F.lit("2024-01-31").cast("timestamp_ntz")
    m = e.agg(
        F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.max("ts").alias("last"),
        F.count_if(~F.col("event_type").isin("click", "view", "purchase", "error", "signup")).alias("unknown"),
    )
    idle = F.floor((F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("last").cast("timestamp"))) / 60)
    rules = [
        ("errors", F.col("errors") * 100 > F.col("n"), F.concat(F.col("errors").cast("string"), F.lit(" errors"))),
        ("idle", idle > 10, F.concat(F.lit("no event for "), idle.cast("string"), F.lit(" min"))),
        ("drift", F.col("unknown") > 0, F.concat(F.col("unknown").cast("string"), F.lit(" of unknown type"))),
    ]
    each = F.array(*[F.struct(F.lit(n).alias("rule"), c.alias("on"), t.alias("warning")) for n, c, t in rules])
    return m.select(F.explode(each).alias("r")).filter("r.on").select("r.rule", "r.warning")


def config_over_auto(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    ours = n.filter("n_nationkey < 10").select("n_nationkey", F.upper("n_name").alias("name"))
    auto = n.select("n_nationkey", F.lower("n_name").alias("name"))
    return M.prioritized([(0, ours), (1, auto)], "n_nationkey")


_E = "SELECT ts, event_id AS key, event_type AS kind FROM events"
QUERIES = {
    f.__name__: f
    for f in (
        project_rollup, source_kind_counts, conditional_counts, global_counts, drift_listagg, session_filter, inactive_hidden,
        timeline_union_topn, sessions_keyset_page, budgeted_page, recent_per_section, audit_failures_window, busiest_users,
        rolling_rate, project_resolution, longest_prefix_match, title_fallback, nested_keys, health_rules, config_over_auto,
    )
}

ORACLE_SQL = {
    "project_rollup": """SELECT user_id % 7 AS project, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'view') AS views,
        count(*) FILTER (event_type = 'purchase') AS purchases, max(ts) AS last,
        array_to_string(list_sort(list(DISTINCT 'm' || (event_id % 3))), ',') AS machines FROM events GROUP BY 1""",
    "source_kind_counts": "SELECT source, lang, count(*) AS n, max(doc_id) AS last FROM documents GROUP BY ALL",
    "conditional_counts": "SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS n_large, min(ts) AS oldest FROM events GROUP BY 1",
    "global_counts": """SELECT count(*) FILTER (event_type = 'click') AS pending, min(ts) FILTER (event_type = 'click') AS since,
        count(DISTINCT user_id) FILTER (event_type = 'click') AS users FROM events""",
    "drift_listagg": """WITH c AS (SELECT lang, source || ' (' || count(*) || ')' AS item FROM documents GROUP BY lang, source)
        SELECT lang, string_agg(item, ', ' ORDER BY item) AS sources FROM c GROUP BY lang""",
    "session_filter": "SELECT doc_id, source, n_chars FROM documents WHERE lower(source) = 'src3' AND n_chars >= 100",
    "inactive_hidden": "SELECT user_id, max(ts) AS last FROM events GROUP BY 1 HAVING max(ts) >= TIMESTAMP '2024-01-30 20:00:00'",
    "timeline_union_topn": f"""SELECT * FROM (({_E} WHERE event_type = 'click') UNION ALL ({_E} WHERE event_type = 'purchase')
        UNION ALL (SELECT o_orderdate, o_orderkey, 'order' FROM orders)) ORDER BY ts DESC, key DESC, kind LIMIT 30""",
    "sessions_keyset_page": """SELECT event_id, ts, user_id FROM events WHERE ts < TIMESTAMP '2024-01-20' OR (ts = TIMESTAMP '2024-01-20' AND event_id < 5000)
        ORDER BY ts DESC, event_id DESC LIMIT 20""",
    "budgeted_page": """WITH s AS (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS s,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) SELECT conv_id, turn, role FROM s WHERE s <= 600 OR n = 1""",
    "recent_per_section": """SELECT user_id, ts, event_id AS key, event_type AS kind FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5""",
    "audit_failures_window": "SELECT user_id, count(*) AS n, max(ts) AS last FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-20' GROUP BY 1",
    "busiest_users": "SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 20",
    "rolling_rate": """SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n
        FROM events""",
    "project_resolution": "SELECT DISTINCT source, 'exact' AS q FROM documents WHERE lower(source) = 'src1' UNION ALL SELECT DISTINCT source, 'prefix' FROM documents WHERE lower(source) LIKE 'src%'",
    "longest_prefix_match": """WITH p AS (SELECT DISTINCT regexp_replace(url, '^https?://', '') AS path FROM pages),
        f AS (SELECT DISTINCT array_to_string(string_split(path, '/')[1:1], '/') AS folder FROM p UNION SELECT DISTINCT array_to_string(string_split(path, '/')[1:2], '/') FROM p),
        m AS (SELECT path, arg_max(folder, length(folder)) AS folder FROM p JOIN f ON path = folder OR starts_with(path, folder || '/') GROUP BY path)
        SELECT path, folder FROM p LEFT JOIN m USING (path)""",
    "title_fallback": "SELECT event_id, coalesce(nullif(CASE WHEN event_id % 2 = 0 THEN '' ELSE event_type END, ''), props) AS title FROM events",
    "nested_keys": """WITH p AS (SELECT *, n_nationkey <> min(n_nationkey) OVER (PARTITION BY n_regionkey) AS a FROM nation)
        SELECT n_regionkey, string_agg(n_name, ',' ORDER BY a, n_name) AS keys FROM p GROUP BY 1""",
    "health_rules": """WITH m AS (SELECT count(*) AS n, count(*) FILTER (event_type = 'error') AS errors,
        floor((epoch(TIMESTAMP '2024-01-31') - floor(epoch(max(ts)))) / 60)::BIGINT AS idle,
        count(*) FILTER (event_type NOT IN ('click', 'view', 'purchase', 'error', 'signup')) AS unknown FROM events)
        SELECT 'errors' AS rule, errors || ' errors' AS warning FROM m WHERE errors * 100 > n
        UNION ALL SELECT 'idle', 'no event for ' || idle || ' min' FROM m WHERE idle > 10
        UNION ALL SELECT 'drift', unknown || ' of unknown type' FROM m WHERE unknown > 0""",
    "config_over_auto": "SELECT n_nationkey, CASE WHEN n_nationkey < 10 THEN upper(n_name) ELSE lower(n_name) END AS name FROM nation",
}
