"""Upkeep queries, and joins and set operations over the star schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from convolake.operators import maintenance as M
from convolake.operators import relational as J
from convolake.operators.activity import activity
from convolake.storage import table

_TS = "timestamp_ntz"


def latest_version(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return M.latest(e, "user_id", "ts", "event_id").select("user_id", "event_id", "ts", "event_type")


def upsert_newer(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    old = e.filter("event_type <> 'purchase'").groupBy("user_id").agg(F.max("ts").alias("ts"), F.max_by("event_id", "ts").alias("event_id"))
    return M.upserted(old, e.filter("event_type = 'purchase'").drop("event_type"), "user_id", "ts")


def retention_prune(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_id") % 10 > 0, F.col("ts")).alias("ended"), F.when(F.col("event_id") % 20 > 0, F.col("ts")).alias("started"))
    return M.pruned(e, activity("ended", "started"), F.lit("2024-01-20").cast(_TS)).select("event_id", "user_id")


def union_merge(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_name", "n_nationkey", F.col("n_regionkey").alias("hook"))
    ours, theirs = n.filter("n_nationkey < 15"), n.filter("n_nationkey >= 8").withColumn("hook", F.col("hook") + 100)
    return M.union_merged(ours, theirs, "n_name", "n_nationkey", F.col("t.hook") > 102)


def anti_vanished(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    seen = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return M.vanished(o, seen, "o_orderkey")


def cascade_delete(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    gone = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return M.cascade(items, gone, "l_orderkey").groupBy("l_linenumber").agg(F.count("*").alias("n"))


def semi_in_subquery(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    rich = table(spark, sf_dir, "orders").filter("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(rich, "c_custkey", "left_semi")


def recovery_plan(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), "ts")
    live = e.filter("path % 3 = 0").select("path").distinct()
    archived = e.filter("path % 3 = 1").groupBy("path").agg(F.max("ts").alias("ts"))
    return M.recoverable(e, live, archived, "path", "ts", F.lit("2024-01-30").cast(_TS))


def audit_prune(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kept = M.pruned(e, F.col("ts"), F.lit("2024-01-15").cast(_TS))
    return kept.groupBy("event_type").agg(F.count("*").alias("n"), F.min("ts").alias("oldest"))


def range_join_cover(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    begins = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", F.col("turn").alias("lo"))
    after = F.lead("lo").over(Window.partitionBy("conv_id").orderBy("lo"))
    ends = rows.groupBy("conv_id").agg(F.max("turn").alias("end"))
    spans = begins.withColumn("after", after).join(ends, "conv_id").withColumn("hi", F.coalesce(F.col("after") - 1, "end")).withColumn("chunk", F.col("lo"))
    return J.covering(rows, "conv_id", "turn", spans, "lo", "hi", "chunk", 16)


def as_of_join(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    buys = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    errors = e.filter("event_type = 'error'").groupBy("user_id", "ts").agg(F.max("event_id").alias("error_id"))
    return J.as_of(buys, errors, "user_id", "ts", "error_id")


def left_conditional_join(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    return J.conditional_left(items, orders, ["l_orderkey"], F.col("l_returnflag") != "R")


def self_parent(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.when(F.col("n_nationkey") > 4, F.pmod("n_nationkey", F.lit(5))).cast("int").alias("parent"))
    return J.children(n, "n_nationkey", "parent", "n_name", "n_nationkey")


def star_join(spark, sf_dir):
    """Inner, outer and dimension joins in one roll-up; Catalyst broadcasts what is small."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    dims = n.join(r, n.n_regionkey == r.r_regionkey)
    both = c.join(dims, c.c_nationkey == n.n_nationkey).join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return both.groupBy("r_name", "o_orderstatus").agg(F.count("o_orderkey").alias("n_orders"), F.countDistinct("c_custkey").alias("n_customers"))


def rollup_cube(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    up = items.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("g")).withColumn("how", F.lit("rollup"))
    cube = items.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("g")).withColumn("how", F.lit("cube"))
    return up.unionByName(cube)


def set_operations(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a, b = o.filter("o_totalprice > 200000").select("o_custkey"), o.filter("o_orderstatus = 'F'").select("o_custkey")
    tag = lambda df, how: df.withColumn("how", F.lit(how))
    return tag(a.intersect(b), "intersect").unionByName(tag(a.subtract(b), "except")).unionByName(tag(a.exceptAll(b), "except all"))


def full_outer(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    return s.join(c, "k", "full")


def window_frames(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.select(
        "o_orderkey", F.row_number().over(w).cast("long").alias("n"), F.rank().over(w).cast("long").alias("r"),
        F.lag("o_orderkey").over(w).alias("before"), F.ntile(4).over(w).cast("long").alias("quarter"),
        F.max("o_totalprice").over(w.rowsBetween(-2, 0)).alias("top3"),
    )


def approx_aggregates(spark, sf_dir):
    """Estimates, whose error is bounded, beside exact counts.

    Both are taken from the distinct keys: with both in one aggregate of all
    rows, Spark would hold a sketch of some 3 KB for each key.
    """
    keys = table(spark, sf_dir, "orders").select("o_custkey").distinct()
    exact = F.count("o_custkey")
    return keys.agg((F.abs(F.approx_count_distinct("o_custkey", 0.02) - exact) <= 0.1 * exact).alias("close"), exact.alias("customers"))


def tumbling_events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    w = F.window("ts", "1 hour")
    return e.groupBy(w["start"].alias("start"), "event_type").agg(F.count("*").alias("n"))


def session_events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    w = F.session_window("ts", "2 hours")
    return e.groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


QUERIES = {
    f.__name__: f
    for f in (
        latest_version, upsert_newer, retention_prune, union_merge, anti_vanished, cascade_delete, semi_in_subquery, recovery_plan,
        audit_prune, range_join_cover, as_of_join, left_conditional_join, self_parent, star_join, rollup_cube, set_operations,
        full_outer, window_frames, approx_aggregates, tumbling_events, session_events,
    )
}

ORACLE_SQL = {
    "latest_version": "SELECT user_id, event_id, ts, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "upsert_newer": """WITH o AS (SELECT user_id, max(ts) AS ts, arg_max(event_id, ts) AS event_id FROM events WHERE event_type <> 'purchase' GROUP BY 1),
        c AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1)
        SELECT coalesce(o.user_id, c.user_id) AS user_id, CASE WHEN o.ts IS NULL OR c.ts > o.ts THEN c.ts ELSE o.ts END AS ts,
        CASE WHEN o.ts IS NULL OR c.ts > o.ts THEN c.event_id ELSE o.event_id END AS event_id FROM o FULL JOIN c ON o.user_id = c.user_id""",
    "retention_prune": "SELECT event_id, user_id FROM events WHERE (event_id % 20 = 0) OR ts >= TIMESTAMP '2024-01-20'",
    "union_merge": """WITH o AS (SELECT n_name, n_nationkey, n_regionkey AS hook FROM nation WHERE n_nationkey < 15), t AS (SELECT n_name, n_nationkey, n_regionkey + 100 AS hook FROM nation WHERE n_nationkey >= 8)
        SELECT coalesce(o.n_name, t.n_name) AS n_name, o.n_name IS NULL AS added, coalesce(o.n_nationkey, t.n_nationkey) AS n_nationkey,
        CASE WHEN o.n_name IS NULL OR coalesce(t.hook > 102, false) THEN t.hook ELSE o.hook END AS hook FROM o FULL JOIN t ON o.n_name = t.n_name""",
    "anti_vanished": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)",
    "cascade_delete": "SELECT l_linenumber, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1",
    "semi_in_subquery": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)",
    "recovery_plan": "SELECT user_id AS path, max(ts) AS ts FROM events WHERE user_id % 3 = 2 GROUP BY 1 HAVING max(ts) >= TIMESTAMP '2024-01-30'",
    "audit_prune": "SELECT event_type, count(*) AS n, min(ts) AS oldest FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1",
    "range_join_cover": """WITH b AS (SELECT conv_id, turn AS lo, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) - 1, 2147483647) AS hi FROM conversations WHERE role = 'user')
        SELECT c.conv_id, c.turn, min(b.lo) AS chunk FROM conversations c LEFT JOIN b ON b.conv_id = c.conv_id AND c.turn BETWEEN lo AND hi GROUP BY ALL""",
    "as_of_join": """WITH b AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
        e AS (SELECT user_id, ts, max(event_id) AS error_id FROM events WHERE event_type = 'error' GROUP BY ALL)
        SELECT b.event_id, b.user_id, b.ts, e.error_id FROM b ASOF LEFT JOIN e ON b.user_id = e.user_id AND b.ts >= e.ts""",
    "left_conditional_join": """SELECT l_orderkey, l_linenumber, l_returnflag, o_orderstatus FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND l_returnflag <> 'R'""",
    "self_parent": """WITH n AS (SELECT n_nationkey, n_name, CASE WHEN n_nationkey > 4 THEN n_nationkey % 5 END AS parent FROM nation)
        SELECT p.n_nationkey AS parent, c.n_nationkey AS child, row_number() OVER (PARTITION BY p.n_nationkey ORDER BY c.n_name, c.n_nationkey) AS n FROM n p JOIN n c ON c.parent = p.n_nationkey""",
    "star_join": """SELECT r_name, o_orderstatus, count(o_orderkey) AS n_orders, count(DISTINCT c_custkey) AS n_customers FROM customer JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL""",
    "rollup_cube": """SELECT l_returnflag, l_linestatus, count(*) AS n, grouping_id(l_returnflag, l_linestatus) AS g, 'rollup' AS how FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)
        UNION ALL SELECT l_returnflag, l_linestatus, count(*), grouping_id(l_returnflag, l_linestatus), 'cube' FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""",
    "set_operations": """WITH a AS (SELECT o_custkey FROM orders WHERE o_totalprice > 200000), b AS (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
        SELECT *, 'intersect' AS how FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT *, 'except' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
        UNION ALL SELECT *, 'except all' FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)""",
    "full_outer": """SELECT coalesce(s.k, c.k) AS k, suppliers, customers FROM (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier GROUP BY 1) s
        FULL JOIN (SELECT c_nationkey AS k, count(*) AS customers FROM customer GROUP BY 1) c ON s.k = c.k""",
    "window_frames": """SELECT o_orderkey, row_number() OVER w AS n, rank() OVER w AS r, lag(o_orderkey) OVER w AS before, ntile(4) OVER w AS quarter,
        max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS 2 PRECEDING) AS top3 FROM orders
        WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
    "approx_aggregates": "SELECT true AS close, count(DISTINCT o_custkey) AS customers FROM orders",
    "tumbling_events": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "session_events": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s""",
}
