"""Extensions beyond the reference's own operators: star-schema joins, as-of and range joins,
cubes, sketches and event-time windows. They show that the engine's plans hold there too."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gradus.plans.base import Registry, tables
from gradus.streaming.resume import session_counts, window_counts

R = Registry()


@R.add("pricing_summary", """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, avg(l_quantity) AS avg_qty, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")  # fmt: skip
def pricing_summary(spark, sf_dir):
    li = tables(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.avg("l_quantity").alias("avg_qty"), F.count("*").alias("n"),
    )


@R.add("nation_revenue", """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""")  # fmt: skip
def nation_revenue(spark, sf_dir):
    c, o, li, s, n = tables(spark, sf_dir, "customer", "orders", "lineitem", "supplier", "nation")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(s, (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))).join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@R.add("segment_cube", "SELECT c_mktsegment, o_orderstatus, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY CUBE (1, 2)")
def segment_cube(spark, sf_dir):
    o, c = tables(spark, sf_dir, "orders", "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).cube("c_mktsegment", "o_orderstatus").agg(F.count("*").alias("n"))


@R.add("as_of_join", """SELECT e.event_id, max(p.event_id) AS last_purchase FROM events e LEFT JOIN events p ON p.user_id = e.user_id AND p.event_type = 'purchase' AND (p.ts, p.event_id) <= (e.ts, e.event_id) AND e.event_type = 'view'
WHERE e.event_type = 'view' GROUP BY 1""")  # fmt: skip
def as_of_join(spark, sf_dir):
    """The last purchase before each view: one sorted pass over the union, no range join."""
    e = tables(spark, sf_dir, "events").where("event_type in ('view', 'purchase')").select("event_id", "ts", "user_id", "event_type")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bought = F.max(F.when(F.col("event_type") == "purchase", F.struct("ts", "event_id"))).over(w)
    return e.withColumn("b", bought).where("event_type = 'view'").select("event_id", F.col("b.event_id").alias("last_purchase"))


@R.add("range_join", """SELECT a.event_id, count(*) AS near FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts - INTERVAL 1 HOUR AND a.ts + INTERVAL 1 HOUR WHERE a.event_type = 'purchase' GROUP BY 1""")
def range_join(spark, sf_dir):
    """Events of a user within an hour of a purchase: an equality join on (user, hour bucket)."""
    e = tables(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    hour = 3_600_000_000
    bucket = F.floor(F.col("t") / hour)
    a = e.where("event_type = 'purchase'").select("event_id", "user_id", F.col("t").alias("at"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
    b = e.select("user_id", F.col("t").alias("bt"), bucket.alias("bucket"))
    return a.join(b, ["user_id", "bucket"]).where(F.abs(F.col("at") - F.col("bt")) <= hour).groupBy("event_id").agg(F.count("*").alias("near"))


@R.add("tumbling_windows", "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, event_type, count(*) AS events, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(spark, sf_dir):
    e = tables(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = window_counts(e, "ts", "6 hours", by=["event_type"])
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "events", F.round("total", 6).alias("total"))


@R.add("sessions", """WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM s) SELECT user_id, min(ts) AS session_start, count(*) AS events FROM g GROUP BY user_id, session""")  # fmt: skip
def sessions(spark, sf_dir):
    e = tables(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return session_counts(e, "ts", "2 hours", ["user_id"]).select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "events")


@R.add("approximate_distinct")
def approximate_distinct(spark, sf_dir):
    """A sketch; SQL engines differ in theirs, a test compares it with the exact count."""
    return tables(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"))
