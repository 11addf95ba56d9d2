"""Classical operators on the plain tables: joins, grouping sets, windows, sets, event time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .registry import query


@query("q1_pricing", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def _(t):
    disc = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return t.raw("lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz")).groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(disc), 2).alias("sum_disc"), F.round(F.sum(disc * (1 + F.col("l_tax"))), 2).alias("sum_charge"), F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.count("*").alias("n"))


@query("q3_shipping", """SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10""")
def _(t):
    c = t.raw("customer").where(F.col("c_mktsegment") == "BUILDING").select("c_custkey")
    o = t.raw("orders").select("o_orderkey", "o_custkey", "o_orderdate").join(c, F.col("o_custkey") == F.col("c_custkey"))
    x = t.raw("lineitem").select("l_orderkey", "l_extendedprice", "l_discount").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return x.groupBy("l_orderkey", "o_orderdate").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue")).orderBy(F.desc("revenue"), "l_orderkey").limit(10)


@query("q5_region", """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name""")
def _(t):
    n = t.raw("nation").join(t.raw("region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name")
    s = t.raw("supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", "n_name")
    o = t.raw("orders").join(t.raw("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    x = t.raw("lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(o, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    return x.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("q6_forecast", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
def _(t):
    return t.raw("lineitem").where(F.col("l_discount").between(0.05, 0.07) & (F.col("l_quantity") < 24)).agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("revenue"))


@query("q18_large_orders", "SELECT o_orderkey, o_custkey, round(sum(l_quantity), 2) AS qty FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_custkey HAVING sum(l_quantity) > 150 ORDER BY qty DESC, o_orderkey LIMIT 100")
def _(t):
    big = t.raw("lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("qty")).where("qty > 150")
    return t.raw("orders").join(big, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_custkey", F.round("qty", 2).alias("qty")).orderBy(F.desc("qty"), "o_orderkey").limit(100)


@query("join_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def _(t):
    o = t.raw("orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return t.raw("customer").select("c_custkey").join(o, "c_custkey", "left_semi")


@query("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def _(t):
    return t.raw("customer").select("c_custkey").join(t.raw("orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("join_full", "SELECT coalesce(s.k, c.k) AS k, coalesce(s.n, 0) AS suppliers, coalesce(c.n, 0) AS customers FROM (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) s FULL OUTER JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9500 GROUP BY 1) c ON s.k = c.k")
def _(t):
    s = t.raw("supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    c = t.raw("customer").where("c_acctbal > 9500").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    return s.join(c, "k", "full_outer").na.fill(0, ["suppliers", "customers"])


@query("join_range", "SELECT a.user_id, count(*) AS n FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 10 MINUTE WHERE a.event_type = 'click' AND b.event_type = 'purchase' GROUP BY 1")
def _(t):
    # A range join by time slots: each click looks in its own slot of ten minutes and in the next.
    e = t.raw("events").select("user_id", "ts", "event_type", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 600).alias("slot"))
    a = e.where("event_type = 'click'").select("user_id", F.col("ts").alias("a"), F.explode(F.array("slot", F.col("slot") + 1)).alias("slot"))
    b = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("b"), "slot")
    x = a.join(b, ["user_id", "slot"]).where((F.col("b") > F.col("a")) & (F.col("b") <= F.col("a") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(10))))
    return x.groupBy("user_id").agg(F.count("*").alias("n"))


@query("cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping_id(o_orderstatus, o_orderpriority) AS g FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def _(t):
    return t.raw("orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))


@query("rollup", "SELECT coalesce(c_mktsegment, 'all') AS segment, coalesce(c_nationkey, -1) AS nation, count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
def _(t):
    x = t.raw("customer").rollup("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"))
    return x.select(F.coalesce("c_mktsegment", F.lit("all")).alias("segment"), F.coalesce("c_nationkey", F.lit(-1)).alias("nation"), "n")


@query("window_rank", "SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)) WHERE rn <= 2")
def _(t):
    w = Window.partitionBy("o_custkey")
    x = t.raw("orders").select("o_custkey", "o_orderkey", F.row_number().over(w.orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("rn"), F.rank().over(w.orderBy("o_orderpriority")).alias("rk"))
    return x.where("rn <= 2")


@query("window_frame", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS run, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events")
def _(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.raw("events").select("event_id", F.round(F.sum("value").over(w.rowsBetween(-2, 0)), 6).alias("run"), F.lag("event_type").over(w).alias("prev"))


@query("set_ops", "SELECT k FROM ((SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def _(t):
    c, s = t.raw("customer").select(F.col("c_nationkey").alias("k")), t.raw("supplier").select("s_nationkey")
    return c.intersect(s).subtract(t.raw("nation").where("n_regionkey = 1").select("n_nationkey"))


@query("pivot", "SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY user_id")
def _(t):
    p = t.raw("events").groupBy("user_id").pivot("event_type", ["click", "view"]).count()
    return p.na.fill(0, ["click", "view"])


@query("tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def _(t):
    return t.raw("events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("sliding", "SELECT s AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY 1")
def _(t):
    return t.raw("events").groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


@query("session_window", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), i AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM i GROUP BY user_id, i")
def _(t):
    return t.raw("events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


@query("json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(t):
    return t.raw("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("recursive_reach", "WITH RECURSIVE r AS (SELECT 's:' || s_suppkey AS node, 0 AS d FROM supplier UNION ALL SELECT l.target_id, d + 1 FROM r JOIN concept_links l ON l.source_id = r.node WHERE d < 4) SELECT node, d, count(*) AS n FROM r GROUP BY node, d")
def _(t):
    """What suppliers reach over links, with the number of ways: at each depth one join with the links."""
    return t.spark.sql("WITH RECURSIVE r(node, d) AS (SELECT concat('s:', s_suppkey), 0 FROM {supplier} UNION ALL SELECT l.target_id, d + 1 FROM r JOIN {links} l ON l.source_id = r.node WHERE d < 4) SELECT node, d, count(*) AS n FROM r GROUP BY node, d", supplier=t.raw("supplier"), links=t.concept_links)
