"""Grouping, conditional aggregates, subtotals, pivots."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidecase.functions.measures import any_flag, count_if, money_avg, money_sum, safe_ratio, sum_if
from tidecase.functions.timeid import datediff_boundary, dateid, timeid
from tidecase.operators.events import last_event, nth_event
from tidecase.operators.shapes import pivot_fixed, subtotals, unpivot_nonnull
from tidecase.plans.registry import query
from tidecase.sources.calendar import calendar, days_of

@query("group_count", "SELECT l_returnflag, l_linestatus, COUNT(*) AS lines FROM lineitem GROUP BY 1, 2")
def group_count(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("lines"))


@query(
    "count_nonnull",
    """
    SELECT o_orderstatus AS status, COUNT(*) AS orders, COUNT(first_return) AS with_return FROM orders
    LEFT JOIN (SELECT l_orderkey, MIN(l_shipdate) AS first_return FROM lineitem WHERE l_returnflag='R'
      GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1
    """,
)
def count_nonnull(t):
    returns = t.lineitem.filter("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first_return"))
    return (
        t.orders.join(returns, F.col("l_orderkey") == F.col("o_orderkey"), "left")
        .groupBy(F.col("o_orderstatus").alias("status"))
        .agg(F.count("*").alias("orders"), F.count("first_return").alias("with_return"))
    )


@query(
    "count_distinct",
    """
    SELECT l_returnflag, COUNT(*) AS lines, COUNT(DISTINCT l_orderkey) AS orders,
      COUNT(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1
    """,
)
def count_distinct(t):
    return t.lineitem.groupBy("l_returnflag").agg(
        F.count("*").alias("lines"),
        F.count_distinct("l_orderkey").alias("orders"),
        F.count_distinct("l_suppkey").alias("suppliers"),
    )


@query(
    "count_if",
    """
    SELECT user_id, COUNT(CASE WHEN event_type='purchase' THEN 1 END) AS answered, COUNT(CASE
      WHEN event_type='error' THEN 1 END) AS missed,
      COUNT(CASE WHEN event_type='purchase' AND value >= 180 THEN 1 END) AS long_calls FROM events GROUP BY 1
    """,
)
def count_if_query(t):
    kind = F.col("event_type")
    return t.events.groupBy("user_id").agg(
        count_if(kind == "purchase").alias("answered"),
        count_if(kind == "error").alias("missed"),
        count_if((kind == "purchase") & (F.col("value") >= 180)).alias("long_calls"),
    )


@query(
    "count_distinct_if",
    """
    SELECT l_suppkey, COUNT(DISTINCT CASE WHEN l_returnflag <> 'N' THEN l_orderkey END) AS orders,
      COUNT(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1
    """,
)
def count_distinct_if(t):
    return t.lineitem.groupBy("l_suppkey").agg(
        F.count_distinct(F.when(F.col("l_returnflag") != "N", F.col("l_orderkey"))).alias("orders"),
        F.count_distinct("l_partkey").alias("parts"),
    )


@query(
    "sum_if",
    """
    SELECT CAST(ts AS DATE) AS day, SUM(CASE WHEN event_type='error' THEN 1 ELSE 0 END)::BIGINT AS errors,
      CAST(SUM(CASE WHEN event_type='purchase' THEN CAST(value AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS spent
        FROM events GROUP BY 1
    """,
)
def sum_if_query(t):
    kind = F.col("event_type")
    amount = F.col("value").cast("decimal(18,2)")
    return t.events.groupBy(F.to_date("ts").alias("day")).agg(
        sum_if(kind == "error").alias("errors"), sum_if(kind == "purchase", amount).cast("double").alias("spent")
    )


@query(
    "sum_scaled",
    """
    SELECT user_id, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / 60.0::DOUBLE AS hours FROM events
      WHERE event_type='view' GROUP BY 1
    """,
)
def sum_scaled(t):
    return t.events.filter("event_type = 'view'").groupBy("user_id").agg((money_sum("value") / 60.0).alias("hours"))


@query(
    "avg_rate",
    """
    SELECT o_orderpriority AS priority, CAST(SUM(CASE WHEN o_orderstatus='F' THEN 1 ELSE 0 END) AS DOUBLE) /
      COUNT(*) AS finished_rate,
      CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / COUNT(o_totalprice) AS avg_price FROM orders
        GROUP BY 1
    """,
)
def avg_rate(t):
    finished = F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)
    return t.orders.groupBy(F.col("o_orderpriority").alias("priority")).agg(
        (F.sum(finished).cast("double") / F.count("*")).alias("finished_rate"), money_avg("o_totalprice").alias("avg_price")
    )


@query(
    "min_max",
    """
    SELECT o_custkey, MIN(o_orderdate) AS first_order, MAX(o_orderdate) AS last_order FROM orders GROUP BY 1
    """,
)
def min_max(t):
    return t.orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_order"), F.max("o_orderdate").alias("last_order"))


@query(
    "min_struct",
    """
    SELECT user_id, MIN(d*100000+s) // 100000 AS date_id, MIN(d*100000+s) % 100000 AS time_id
      FROM (SELECT user_id, year(ts)*10000+month(ts)*100+day(ts) AS d,
      hour(ts)*3600+minute(ts)*60+second(ts)+1 AS s FROM events WHERE event_type = 'purchase') GROUP BY 1
    """,
)
def min_struct(t):
    first = F.min(F.struct(dateid("ts").alias("date_id"), timeid("ts").alias("time_id"))).alias("first")
    bought = t.events.filter("event_type = 'purchase'")
    return bought.groupBy("user_id").agg(first).select("user_id", "first.date_id", "first.time_id")


@query(
    "safe_ratio",
    """
    SELECT user_id, CAST(ts AS DATE) AS day, 100.0::DOUBLE * COUNT(CASE
      WHEN event_type='purchase' THEN 1 END) / NULLIF(COUNT(CASE
      WHEN event_type IN ('purchase','error') THEN 1 END), 0) AS rate FROM events GROUP BY 1, 2
    """,
)
def safe_ratio_query(t):
    kind = F.col("event_type")
    rate = safe_ratio(count_if(kind == "purchase"), count_if(kind.isin("purchase", "error")), 100.0)
    return t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(rate.alias("rate"))


@query(
    "group_expr",
    """
    SELECT CASE WHEN l_shipdate < o_orderdate THEN 'early' WHEN
      date_diff('day', o_orderdate, l_shipdate) <= 365 THEN 'within a year' ELSE 'late' END AS timing,
      COUNT(*) AS lines
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1
    """,
)
def group_expr(t):
    timing = (
        F.when(F.col("l_shipdate") < F.col("o_orderdate"), "early")
        .when(datediff_boundary("DAY", "o_orderdate", "l_shipdate") <= 365, "within a year")
        .otherwise("late")
    )
    joined = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy(timing.alias("timing")).agg(F.count("*").alias("lines"))


@query(
    "group_distinct",
    """
    SELECT l_orderkey, l_returnflag FROM lineitem WHERE l_linestatus = 'O' GROUP BY l_orderkey, l_returnflag
    """,
)
def group_distinct(t):
    return t.lineitem.filter("l_linestatus = 'O'").select("l_orderkey", "l_returnflag").distinct()


@query(
    "global_agg",
    """
    SELECT COUNT(*) AS events, COUNT(DISTINCT user_id) AS users, MIN(ts) AS first_ts, MAX(ts) AS last_ts,
      CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events
    """,
)
def global_agg(t):
    return t.events.agg(
        F.count("*").alias("events"),
        F.count_distinct("user_id").alias("users"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        money_sum("value").alias("total"),
    )


@query(
    "having",
    """
    SELECT l_orderkey, COUNT(*) AS lines, MIN(l_shipdate) AS first_ship FROM lineitem GROUP BY 1
    HAVING COUNT(*) >= 5 AND MIN(l_shipdate) > TIMESTAMP '1996-01-01' AND SUM(CAST(l_quantity AS DECIMAL(18,2))) > 100
    """,
)
def having(t):
    return (
        t.lineitem.groupBy("l_orderkey")
        .agg(F.count("*").alias("lines"), F.min("l_shipdate").alias("first_ship"), money_sum("l_quantity").alias("_q"))
        .filter((F.col("lines") >= 5) & (F.col("first_ship") > F.lit("1996-01-01").cast("timestamp_ntz")) & (F.col("_q") > 100))
        .drop("_q")
    )


HIERARCHY = """
    base AS (SELECT r_name AS region, n_name AS nation, c_mktsegment AS segment, o_orderpriority AS priority,
      o_custkey, o_totalprice
      FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region
        ON r_regionkey = n_regionkey)
    """


def hierarchy(t):
    return (
        t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
        .join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
        .join(t.region, F.col("r_regionkey") == F.col("n_regionkey"))
        .select(
            F.col("r_name").alias("region"), F.col("n_name").alias("nation"), F.col("c_mktsegment").alias("segment"),
            F.col("o_orderpriority").alias("priority"), "o_custkey", "o_totalprice",
        )
    )


@query(
    "grouping_sets",
    f"""
    WITH {HIERARCHY} SELECT region, nation, segment, priority, COUNT(*) AS orders,
      COUNT(DISTINCT o_custkey) AS customers, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amount
    FROM base
      GROUP BY GROUPING SETS ((region), (region, nation), (region, nation, segment), (region, nation, segment,
        priority))
    """,
)
def grouping_sets(t):
    sets = [["region"], ["region", "nation"], ["region", "nation", "segment"], ["region", "nation", "segment", "priority"]]
    # one row per customer and finest group first: the grouping-sets expansion then multiplies these rows, not the orders
    fine = hierarchy(t).groupBy("region", "nation", "segment", "priority", "o_custkey").agg(
        F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("a")
    )
    return fine.groupingSets(
        [[F.col(c) for c in s] for s in sets], "region", "nation", "segment", "priority"
    ).agg(
        F.sum("n").alias("orders"), F.count_distinct("o_custkey").alias("customers"), F.sum("a").cast("double").alias("amount")
    )


@query(
    "grouping_sets_expr",
    f"""
    WITH e AS (SELECT user_id, CASE WHEN event_type IN ('click','view') THEN 'browse'
      WHEN event_type = 'purchase' THEN 'buy' ELSE 'other' END AS job, value, CAST(ts AS DATE) AS d FROM events)
    SELECT user_id, CASE WHEN GROUPING(job) = 1 THEN 'Total' ELSE job END AS job, COUNT(*) AS touches,
      COUNT(DISTINCT d) AS days FROM e GROUP BY GROUPING SETS ((user_id, job), (user_id))
    """,
)
def grouping_sets_expr(t):
    kind = F.col("event_type")
    job = F.when(kind.isin("click", "view"), "browse").when(kind == "purchase", "buy").otherwise("other")
    daily = t.events.groupBy("user_id", job.alias("job"), F.to_date("ts").alias("d")).agg(F.count("*").alias("n"))
    return subtotals(
        daily,
        [["user_id", "job"], ["user_id"]],
        [F.sum("n").alias("touches"), F.count_distinct("d").alias("days")],
        total_label="Total",
        keep=["user_id"],
    )


GROUPING_LABEL = """
    WITH b AS (SELECT l_returnflag AS flag, CASE WHEN l_quantity < 25 THEN l_linestatus END AS status FROM lineitem)
    SELECT CASE WHEN GROUPING(flag) = 1 THEN 'All' ELSE COALESCE(flag, 'Unknown') END AS flag,
      CASE WHEN GROUPING(status) = 1 THEN 'All' ELSE COALESCE(status, 'Unknown') END AS status, COUNT(*) AS lines
    FROM b GROUP BY GROUPING SETS ((), (flag), (flag, status))
    """


def labelled_lines(t, depth: str | None = None):
    small = F.when(F.col("l_quantity") < 25, F.col("l_linestatus"))
    base = t.lineitem.select(F.col("l_returnflag").alias("flag"), small.alias("status"))
    return subtotals(base, [[], ["flag"], ["flag", "status"]], [F.count("*").alias("lines")], depth=depth)


@query("grouping_label", GROUPING_LABEL)
def grouping_label(t):
    return labelled_lines(t)


@query("order_grouping", GROUPING_LABEL + " ORDER BY GROUPING(flag) DESC, GROUPING(status) DESC, 1, 2")
def order_grouping(t):
    return labelled_lines(t, "depth").orderBy(F.col("depth").desc(), "flag", "status").drop("depth")


@query(
    "count_of_counts",
    """
    SELECT rounds, COUNT(*) AS users FROM (SELECT user_id, COUNT(*) AS rounds FROM events
      WHERE event_type='error' GROUP BY 1) GROUP BY 1
    """,
)
def count_of_counts(t):
    rounds = t.events.filter("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("rounds"))
    return rounds.groupBy("rounds").agg(F.count("*").alias("users"))


@query(
    "nth_event",
    """
    SELECT c_custkey, COALESCE(n, 0) AS errors, fourth FROM customer LEFT JOIN (SELECT user_id, MAX(rn) AS n,
      MAX(CASE WHEN rn = 4 THEN ts END) AS fourth
      FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events
        WHERE event_type='error') GROUP BY 1) ON user_id = c_custkey
    """,
)
def nth_event_query(t):
    errors = t.events.filter("event_type = 'error'")
    counts = errors.groupBy("user_id").agg(F.count("*").alias("errors"))
    fourth = nth_event(errors, ["user_id"], ["ts", "event_id"], 4).select("user_id", F.col("ts").alias("fourth"))
    summary = counts.join(fourth, "user_id", "left")
    return (
        t.customer.join(summary, F.col("user_id") == F.col("c_custkey"), "left")
        .select("c_custkey", "errors", "fourth")
        .fillna(0, ["errors"])
    )


TYPES = ["signup", "purchase", "error", "view", "click"]


@query(
    "pivot_sum",
    "SELECT user_id, " + ", ".join(f"CAST(SUM(CASE WHEN event_type='{k}' THEN CAST(value AS DECIMAL(18,2)) END) AS DOUBLE) AS {k}" for k in TYPES) + " FROM events GROUP BY 1",
)
def pivot_sum(t):
    return pivot_fixed(t.events, ["user_id"], "event_type", TYPES, money_sum("value"))


@query(
    "pivot_max",
    "SELECT l_orderkey, " + ", ".join(f"MAX(CASE WHEN l_linenumber={i} THEN l_shipdate END) AS ship_{i}" for i in (1, 2, 3)) + " FROM lineitem GROUP BY 1",
)
def pivot_max(t):
    named = t.lineitem.select(
        "l_orderkey", F.concat(F.lit("ship_"), F.col("l_linenumber").cast("string")).alias("name"), "l_shipdate"
    )
    return pivot_fixed(named, ["l_orderkey"], "name", ["ship_1", "ship_2", "ship_3"], F.max("l_shipdate"))


@query(
    "unpivot",
    """
    WITH m AS (SELECT l_orderkey, MIN(CASE WHEN l_returnflag='R' THEN l_shipdate END) AS returned, MIN(CASE
      WHEN l_returnflag='A' THEN l_shipdate END) AS accepted FROM lineitem GROUP BY 1)
    SELECT l_orderkey, 'returned' AS step, returned AS at FROM m WHERE returned IS NOT NULL UNION ALL
      SELECT l_orderkey, 'accepted', accepted FROM m WHERE accepted IS NOT NULL
    """,
)
def unpivot(t):
    f, s = F.col("l_returnflag"), F.col("l_shipdate")
    marks = t.lineitem.groupBy("l_orderkey").agg(
        F.min(F.when(f == "R", s)).alias("returned"), F.min(F.when(f == "A", s)).alias("accepted")
    )
    return unpivot_nonnull(marks, ["l_orderkey"], ["returned", "accepted"], "step", "at")


@query(
    "unpivot_pivot",
    """
    WITH cur AS (SELECT user_id, event_type, CAST(value AS DECIMAL(18,2))::VARCHAR AS amount, strftime(ts,
      '%Y-%m-%d %H:%M:%S') AS since
      FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn
      FROM events WHERE event_type IN ('error','view')) WHERE rn = 1)
    SELECT user_id, MAX(CASE WHEN event_type='error' THEN amount END) AS error_amount, MAX(CASE
      WHEN event_type='error' THEN since END) AS error_since,
      MAX(CASE WHEN event_type='view' THEN amount END) AS view_amount, MAX(CASE
        WHEN event_type='view' THEN since END) AS view_since FROM cur GROUP BY 1
    """,
)
def unpivot_pivot(t):
    latest = last_event(t.events, ["user_id", "event_type"], ["ts", "event_id"], F.col("event_type").isin("error", "view"))
    texts = latest.select(
        "user_id",
        "event_type",
        F.col("value").cast("decimal(18,2)").cast("string").alias("amount"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("since"),
    )
    long = unpivot_nonnull(texts, ["user_id", "event_type"], ["amount", "since"], "attribute", "text")
    named = long.select("user_id", F.concat_ws("_", "event_type", "attribute").alias("name"), "text")
    names = ["error_amount", "error_since", "view_amount", "view_since"]
    return pivot_fixed(named, ["user_id"], "name", names, F.max("text"))


@query(
    "any_flag",
    """
    SELECT l_orderkey, CASE WHEN SUM(CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END) > 0 THEN 'Yes' ELSE 'No'
      END AS any_returned,
      CASE WHEN SUM(CASE WHEN l_quantity >= 45 THEN 1 ELSE 0 END) > 0 THEN 'Yes' ELSE 'No' END AS any_large
        FROM lineitem GROUP BY 1
    """,
)
def any_flag_query(t):
    return t.lineitem.groupBy("l_orderkey").agg(
        any_flag(F.col("l_returnflag") == "R").alias("any_returned"), any_flag(F.col("l_quantity") >= 45).alias("any_large")
    )


@query(
    "count_distinct_pair",
    "SELECT l_returnflag, COUNT(DISTINCT (l_suppkey, l_shipdate)) AS supplier_days FROM lineitem GROUP BY 1",
)
def count_distinct_pair(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.count_distinct("l_suppkey", "l_shipdate").alias("supplier_days"))


@query(
    "calendar_count",
    """
    SELECT year(o_orderdate)*100+month(o_orderdate) AS month_key, monthname(o_orderdate) AS month_name,
      COUNT(*) AS orders,
      COUNT(CASE WHEN dayofweek(o_orderdate) IN (0, 6) THEN 1 END) AS weekend_orders FROM orders GROUP BY 1, 2
    """,
)
def calendar_count(t):
    cal = calendar(days_of(t.orders, "o_orderdate")).select("date", "month_key", "month_name", "weekend_flag")
    # counting per day before the join leaves one row per date on each side
    daily = t.orders.groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count("*").alias("n"))
    return (
        daily.join(cal, "date")
        .groupBy("month_key", "month_name")
        .agg(F.sum("n").alias("orders"), F.sum(F.col("n") * F.col("weekend_flag")).alias("weekend_orders"))
    )
