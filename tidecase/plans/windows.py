"""Window functions, sorting, top-n and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidecase.functions.business import add_business_days
from tidecase.functions.timeid import at_midnight
from tidecase.jobs.touches import last_on_day
from tidecase.operators.events import asof, dwell, last_event, top_n
from tidecase.operators.joins import with_group
from tidecase.operators.shapes import union_padded
from tidecase.operators.slices import hot_keys, numbered, with_prev
from tidecase.plans.registry import query
from tidecase.plans.scalars import CHRISTMAS


@query(
    "row_number",
    "SELECT event_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events",
)
def row_number(t):
    return numbered(t.events, ["user_id"], ["ts", "event_id"]).select("event_id", "rn")


@query(
    "row_number_sliced",
    "SELECT event_id, ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events",
)
def row_number_sliced(t):
    """Few keys with very many rows each: every one is cut into slices."""
    return numbered(t.events, ["event_type"], ["ts", "event_id"], rows_per_task=500).select("event_id", "rn")


@query(
    "asof_sliced",
    """
    WITH p AS (SELECT event_id, user_id % 3 AS grp, ts FROM events WHERE event_type = 'purchase'),
    s AS (SELECT event_id, user_id % 3 AS grp, ts FROM events WHERE event_type = 'signup')
    SELECT event_id, last_id FROM (SELECT p.event_id, s.event_id AS last_id, ROW_NUMBER() OVER (PARTITION BY p.event_id
      ORDER BY s.ts DESC, s.event_id DESC) AS rn FROM p LEFT JOIN s ON s.grp = p.grp AND s.ts < p.ts) WHERE rn = 1
    """,
)
def asof_sliced(t):
    def side(kind: str):
        return t.events.filter(F.col("event_type") == kind).select("event_id", (F.col("user_id") % 3).alias("grp"), "ts")

    found = asof(side("purchase"), side("signup"), ["grp"], "ts", "ts", {"last_id": "event_id"}, ties=["event_id"], rows_per_task=500)
    return found.select("event_id", "last_id")


@query(
    "dwell_sliced",
    """
    WITH n AS (SELECT user_id % 4 AS grp, event_type, date_diff('second', ts, COALESCE(LEAD(ts)
      OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id), TIMESTAMP '2024-02-01')) AS s FROM events)
    SELECT grp, event_type, SUM(s)::BIGINT AS seconds, COUNT(*) AS visits FROM n GROUP BY 1, 2
    """,
)
def dwell_sliced(t):
    log = t.events.withColumn("grp", F.col("user_id") % 4).select("grp", "ts", "event_id", "event_type")
    return dwell(log, ["grp"], ["ts", "event_id"], "event_type", at_midnight("2024-02-01 00:00:00"), rows_per_task=500)


@query(
    "latest_per_key",
    """
    SELECT user_id, event_type, event_id, ts FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, event_type
      ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1
    """,
)
def latest_per_key(t):
    return last_event(t.events, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "ts")


@query(
    "lag_prev",
    """
    SELECT o_orderkey, LAG(o_orderstatus) OVER w AS prev_status, LAG(o_orderdate) OVER w AS prev_date
      FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
    """,
)
def lag_prev(t):
    return with_prev(
        t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], {"prev_status": "o_orderstatus", "prev_date": "o_orderdate"}
    ).select("o_orderkey", "prev_status", "prev_date")


@query(
    "rank_ties",
    """
    SELECT o_orderkey, RANK() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o_orderdate) AS rnk
      FROM orders
    """,
)
def rank_ties(t):
    return numbered(t.orders, ["o_orderpriority", "o_orderstatus"], ["o_orderdate"], "rnk", ties=True).select("o_orderkey", "rnk")


@query(
    "rank_ties_sliced",
    """
    SELECT l_orderkey, l_linenumber, RANK() OVER (PARTITION BY l_returnflag ORDER BY CAST(l_shipdate AS DATE)) AS first_rank,
      RANK() OVER (PARTITION BY l_returnflag ORDER BY CAST(l_shipdate AS DATE) DESC) AS last_rank FROM lineitem
    """,
)
def rank_ties_sliced(t):
    """Few keys and crowded days: ranks come from counts per (key, day), no day's rows meet."""
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", F.to_date("l_shipdate").alias("day"))
    hot = hot_keys(lines.select("l_returnflag", "day", "l_orderkey", "l_linenumber"), ["l_returnflag"], ["day"], 500)
    for name, late in (("first_rank", False), ("last_rank", True)):
        lines = numbered(lines, ["l_returnflag"], ["day"], name, descending=late, ties=True, rows_per_task=500, hot=hot)
    return lines.select("l_orderkey", "l_linenumber", "first_rank", "last_rank")


@query(
    "rank_coalesce",
    """
    WITH e AS (SELECT event_id, ts, CASE WHEN event_type <> 'view' THEN user_id
      END AS a, CAST(json_extract_string(props, '$.k') AS BIGINT) + 1000 AS b FROM events)
    SELECT event_id, COALESCE(a, b) AS thread, RANK() OVER (PARTITION BY COALESCE(a, b) ORDER BY ts) AS rnk FROM e
    """,
)
def rank_coalesce(t):
    owner = F.when(F.col("event_type") != "view", F.col("user_id"))
    other = F.get_json_object("props", "$.k").cast("bigint") + 1000
    keyed = t.events.select("event_id", "ts", F.coalesce(owner, other).alias("thread"))
    return numbered(keyed, ["thread"], ["ts"], "rnk", ties=True).drop("ts")


@query(
    "count_over",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, COUNT(l_partkey) OVER (PARTITION BY l_suppkey) AS supplier_lines
      FROM lineitem
    """,
)
def count_over(t):
    return with_group(t.lineitem, ["l_suppkey"], F.count("l_partkey").alias("supplier_lines")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "supplier_lines"
    )


@query(
    "window_in_case",
    """
    SELECT event_id, CASE WHEN event_type = 'view' THEN 0 ELSE rn END AS position, CASE WHEN last_rn = 1 THEN 1
      ELSE 0 END AS last_on_day FROM (SELECT *,
      ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, ROW_NUMBER()
        OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS last_rn FROM events)
    """,
)
def window_in_case(t):
    rows = numbered(t.events, ["user_id"], ["ts", "event_id"])
    marked = last_on_day(rows, ["user_id"], "ts", "event_id")
    position = F.when(F.col("event_type") == "view", 0).otherwise(F.col("rn"))
    return marked.select("event_id", position.cast("bigint").alias("position"), "last_on_day")


@query(
    "nth_business_day",
    """
    WITH cal AS (SELECT d, ROW_NUMBER() OVER (ORDER BY d) AS n FROM (SELECT CAST(unnest(generate_series((SELECT
      MIN(o_orderdate)::DATE FROM orders), (SELECT MAX(o_orderdate)::DATE + 40
      FROM orders), INTERVAL 1 DAY)) AS DATE) AS d)
      WHERE dayofweek(d) BETWEEN 1 AND 5 AND NOT (month(d) = 12 AND day(d) = 25)),
    o AS (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders),
    x AS (SELECT DISTINCT o.d, COALESCE((SELECT MAX(n) FROM cal WHERE cal.d <= o.d), 0) AS n FROM o)
    SELECT o.o_orderkey, cal.d AS expires FROM o JOIN x ON x.d = o.d JOIN cal ON cal.n = x.n + 10
    """,
)
def nth_business_day(t):
    return t.orders.select("o_orderkey", add_business_days("o_orderdate", 10, CHRISTMAS).alias("expires"))


@query(
    "late_business_day",
    """
    WITH cal AS (SELECT d, ROW_NUMBER() OVER (ORDER BY d) AS n FROM (SELECT CAST(unnest(generate_series((SELECT
      MIN(o_orderdate)::DATE FROM orders) - 7, (SELECT MAX(o_orderdate)::DATE + 800
      FROM orders), INTERVAL 1 DAY)) AS DATE) AS d)
      WHERE dayofweek(d) BETWEEN 1 AND 5 AND NOT (month(d) = 12 AND day(d) = 25)),
    x AS (SELECT d.d, MAX(cal.n) AS n FROM (SELECT DISTINCT o_orderdate::DATE AS d FROM orders) d JOIN cal ON cal.d <= d.d GROUP BY 1)
    SELECT o.o_orderkey, cal.d AS expires FROM orders o JOIN x ON x.d = o.o_orderdate::DATE JOIN cal ON cal.n = x.n + 500
    """,
)
def late_business_day(t):
    return t.orders.select("o_orderkey", add_business_days("o_orderdate", 500, CHRISTMAS).alias("expires"))


@query(
    "order_multi",
    """
    SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders
      ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey
    """,
)
def order_multi(t):
    return t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice").orderBy(
        "o_orderpriority", F.col("o_totalprice").desc(), "o_orderkey"
    )


@query("order_ordinal", "SELECT l_returnflag, COUNT(*) AS lines FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1")
def order_ordinal(t):
    t.views("lineitem")
    return t.spark.sql("SELECT l_returnflag, count(*) AS lines FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1")


@query(
    "order_expr",
    """
    SELECT o_orderkey, o_orderpriority FROM orders ORDER BY CAST(left(o_orderpriority, 1) AS INT) DESC, CASE
      WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, o_orderkey
    """,
)
def order_expr(t):
    code = F.left("o_orderpriority", F.lit(1)).cast("int")
    return t.orders.orderBy(
        code.desc(), F.when(F.col("o_orderstatus") == "F", 0).otherwise(1), "o_orderkey"
    ).select("o_orderkey", "o_orderpriority")


@query("limit_n")
def limit_n(t):
    return t.lineitem.limit(100)


@query(
    "limit_n_checked",
    "SELECT least(100, COUNT(*))::BIGINT AS rows, least(100, COUNT(*))::BIGINT AS found FROM lineitem",
)
def limit_n_checked(t):
    """Which rows a sample holds is open; how many, and that the table has them, is not."""
    picked = t.lineitem.limit(100)
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    sizes = picked.agg(F.count(F.lit(1)).alias("rows"))
    found = picked.select(key).join(t.lineitem.select(key).distinct(), key, "left_semi").agg(F.count(F.lit(1)).alias("found"))
    return sizes.select("rows", found.scalar().alias("found"))


@query(
    "priority_pick",
    """
    SELECT user_id, event_type, event_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY CASE
      WHEN event_type IN ('error','signup') THEN 1 WHEN event_type ILIKE '%click' THEN -1
      ELSE 0 END DESC, ts, event_id) AS rn FROM events) WHERE rn = 1
    """,
)
def priority_pick(t):
    kind = F.col("event_type")
    urgency = F.when(kind.isin("error", "signup"), 1).when(kind.ilike("%click"), -1).otherwise(0)
    return top_n(t.events, ["user_id"], [urgency.desc(), F.col("ts"), F.col("event_id")], 1).select(
        "user_id", "event_type", "event_id"
    )


@query(
    "union_all",
    """
    SELECT event_id, user_id, 'replied' AS action, value FROM events WHERE event_type = 'click'
    UNION ALL SELECT event_id, user_id, 'received', CAST(NULL AS DOUBLE) FROM events WHERE event_type = 'view'
    """,
)
def union_all(t):
    replied = t.events.filter("event_type = 'click'").select("event_id", "user_id", F.lit("replied").alias("action"), "value")
    received = t.events.filter("event_type = 'view'").select("event_id", "user_id", F.lit("received").alias("action"))
    return union_padded(replied, received)


@query(
    "union_distinct",
    """
    SELECT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'click' UNION ALL
      SELECT user_id, CAST(ts AS DATE) FROM events WHERE event_type = 'view'
    UNION SELECT user_id, CAST(ts AS DATE) FROM events WHERE event_type = 'error'
    """,
)
def union_distinct(t):
    def days(kind: str):
        return t.events.filter(F.col("event_type") == kind).select("user_id", F.to_date("ts").alias("day"))

    return days("click").union(days("view")).union(days("error")).distinct()
