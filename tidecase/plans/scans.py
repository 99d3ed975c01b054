"""Sources, sinks and multi-step composition."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidecase.functions.measures import money_sum
from tidecase.functions.timeid import datediff_boundary, half_hour
from tidecase.operators.events import first_event
from tidecase.operators.joins import apply_agg
from tidecase.plans.registry import query
from tidecase.sources.scratch import session_path
from tidecase.sources.sinks import write_new_table, write_report
from tidecase.sources.tables import read_import, union_years


@query(
    "src_view",
    """
    SELECT o_orderpriority AS priority, COUNT(*) AS open_orders
    FROM (SELECT * FROM orders WHERE o_orderstatus = 'O') GROUP BY o_orderpriority
    """,
)
def src_view(t):
    t.orders.filter(F.col("o_orderstatus") == "O").createOrReplaceTempView("open_orders_v")
    return t.spark.sql(
        "SELECT o_orderpriority AS priority, count(*) AS open_orders FROM open_orders_v GROUP BY o_orderpriority"
    )


@query(
    "src_year_union",
    """
    SELECT year(o_orderdate) AS order_year, month(o_orderdate) AS order_month, COUNT(*) AS orders
    FROM (SELECT * FROM orders WHERE year(o_orderdate) = 1997
          UNION ALL SELECT * FROM orders WHERE year(o_orderdate) = 1998) u
    GROUP BY 1, 2
    """,
)
def src_year_union(t):
    def year_table(year: int):
        day = F.col("o_orderdate")
        first, after = (F.lit(f"{y}-01-01").cast("timestamp_ntz") for y in (year, year + 1))
        return t.orders.filter((day >= first) & (day < after))

    return (
        union_years(year_table(1997), year_table(1998))
        .groupBy(F.year("o_orderdate").alias("order_year"), F.month("o_orderdate").alias("order_month"))
        .agg(F.count(F.lit(1)).alias("orders"))
    )


@query(
    "src_csv_lookup",
    """
    WITH invoices AS (
      SELECT l_orderkey, l_suppkey, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount
      FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey, l_suppkey)
    SELECT o_orderkey, o_orderstatus, l_suppkey AS supplier_id, amount
    FROM orders JOIN invoices ON l_orderkey = o_orderkey
    """,
)
def src_csv_lookup(t):
    path = session_path(t.spark, "invoices")
    invoices = (
        t.lineitem.filter("l_returnflag = 'R'")
        .groupBy("l_orderkey", "l_suppkey")
        .agg(money_sum("l_extendedprice").alias("amount"))
    )
    write_report(invoices, path)
    imported = read_import(t.spark, path, "l_orderkey bigint, l_suppkey bigint, amount double")
    return t.orders.join(imported, F.col("o_orderkey") == F.col("l_orderkey")).select(
        "o_orderkey", "o_orderstatus", F.col("l_suppkey").alias("supplier_id"), "amount"
    )


@query(
    "cube_extract",
    """
    SELECT CAST(ts AS DATE) AS call_date, user_id AS agent,
           CAST(hour(ts) * 2 + minute(ts) // 30 AS INT) AS slot, COUNT(*) AS calls,
           COUNT(CASE WHEN event_type = 'purchase' THEN 1 END) AS answered,
           CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS talk_time
    FROM events GROUP BY 1, 2, 3
    """,
)
def cube_extract(t):
    return t.events.groupBy(
        F.to_date("ts").alias("call_date"), F.col("user_id").alias("agent"), half_hour("ts").alias("slot")
    ).agg(
        F.count(F.lit(1)).alias("calls"),
        F.count(F.when(F.col("event_type") == "purchase", 1)).alias("answered"),
        money_sum("value").alias("talk_time"),
    )


@query(
    "multi_stage",
    """
    WITH firsts AS (SELECT l_orderkey, MIN(l_shipdate) AS first_ship FROM lineitem GROUP BY 1),
    stage1 AS (SELECT o_orderpriority AS priority, o_orderstatus AS status,
                      date_diff('day', o_orderdate, first_ship) AS days
               FROM orders JOIN firsts ON l_orderkey = o_orderkey WHERE first_ship >= o_orderdate),
    stage2 AS (SELECT priority, COUNT(*) AS shipped, MAX(days) AS slowest FROM stage1 GROUP BY 1),
    stage3 AS (SELECT priority, status, COUNT(*) AS late FROM stage1 WHERE days > 365 GROUP BY 1, 2)
    SELECT stage3.priority, status, late, shipped, slowest FROM stage3 JOIN stage2
      ON stage2.priority = stage3.priority
    """,
)
def multi_stage(t):
    firsts = t.lineitem.groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first_ship"))
    stage1 = (
        t.orders.join(firsts, F.col("l_orderkey") == F.col("o_orderkey"))
        .filter(F.col("first_ship") >= F.col("o_orderdate"))
        .select(
            F.col("o_orderpriority").alias("priority"),
            F.col("o_orderstatus").alias("status"),
            datediff_boundary("DAY", "o_orderdate", "first_ship").alias("days"),
        )
    )
    # One pass over the join; both results come from its small groups.
    fine = stage1.groupBy("priority", "status").agg(
        F.count(F.lit(1)).alias("n"), F.max("days").alias("most"), F.count(F.when(F.col("days") > 365, 1)).alias("late")
    )
    whole = Window.partitionBy("priority")
    both = fine.withColumn("shipped", F.sum("n").over(whole)).withColumn("slowest", F.max("most").over(whole))
    return both.filter("late > 0").select("priority", "status", "late", "shipped", "slowest")


SINK_SQL = """
    SELECT o_orderpriority AS priority, COUNT(*) AS orders,
           CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amount
    FROM orders GROUP BY 1
    """


def _priority_totals(t):
    return t.orders.groupBy(F.col("o_orderpriority").alias("priority")).agg(
        F.count(F.lit(1)).alias("orders"), money_sum("o_totalprice").alias("amount")
    )


@query("sink_table", SINK_SQL)
def sink_table(t):
    path = session_path(t.spark, "totals")
    write_new_table(_priority_totals(t), path)
    return t.spark.read.schema("priority string, orders bigint, amount double").parquet(path)


@query("sink_csv", SINK_SQL)
def sink_csv(t):
    path = session_path(t.spark, "totals-report")
    write_report(_priority_totals(t), path)
    return read_import(t.spark, path, "priority string, orders bigint, amount double")


@query(
    "multi_result",
    """
    WITH base AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, COUNT(l_orderkey) AS lines
                  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3)
    SELECT 'by status' AS result, o_orderstatus AS label, COUNT(*) AS orders, SUM(lines)::BIGINT AS lines
      FROM base GROUP BY 2
    UNION ALL
    SELECT 'by priority', o_orderpriority, COUNT(*), SUM(lines)::BIGINT FROM base GROUP BY 2
    UNION ALL
    SELECT 'without lines', NULL, COUNT(*), NULL FROM base WHERE lines = 0
    """,
)
def multi_result(t):
    base = apply_agg(
        t.orders, t.lineitem, {"o_orderkey": "l_orderkey"}, [F.count(F.lit(1)).alias("lines")], "left", ["lines"]
    )
    # all result sets in one pass: small groups first, then one grouping set per result
    fine = base.groupBy("o_orderstatus", "o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.sum("lines").alias("lines"), F.count(F.when(F.col("lines") == 0, 1)).alias("none")
    )
    sets = fine.groupingSets(
        [[F.col("o_orderstatus")], [F.col("o_orderpriority")], []], "o_orderstatus", "o_orderpriority"
    ).agg(F.sum("n").alias("n"), F.sum("lines").alias("lines"), F.sum("none").alias("none"), F.grouping_id().alias("set"))
    result = F.when(F.col("set") == 1, "by status").when(F.col("set") == 2, "by priority").otherwise("without lines")
    total = F.col("set") == 3
    return sets.select(
        result.alias("result"),
        F.coalesce("o_orderstatus", "o_orderpriority").alias("label"),
        F.when(total, F.col("none")).otherwise(F.col("n")).alias("orders"),
        F.when(~total, F.col("lines")).alias("lines"),
    )


@query(
    "scalar_subquery",
    """
    SELECT event_id, user_id, ts FROM events
    WHERE CAST(ts AS DATE) = (SELECT MAX(CAST(ts AS DATE)) FROM events WHERE event_type = 'signup')
    """,
)
def scalar_subquery(t):
    last_day = t.events.filter("event_type = 'signup'").agg(F.max(F.to_date("ts")))
    return t.events.filter(F.to_date("ts") == last_day.scalar()).select("event_id", "user_id", "ts")


CTE = """
    WITH buyers AS (SELECT user_id, COUNT(*) AS purchases FROM events WHERE event_type = 'purchase' GROUP BY user_id),
    members AS (SELECT c_custkey, c_mktsegment, c_nationkey FROM customer),
    joined AS (SELECT c_mktsegment AS segment, purchases FROM members JOIN buyers ON user_id = c_custkey)
    SELECT segment, COUNT(*) AS buyers, CAST(SUM(purchases) AS BIGINT) AS purchases FROM joined GROUP BY segment
    """


@query("cte_chain", CTE)
def cte_chain(t):
    t.views("events", "customer")
    return t.spark.sql(CTE)


@query(
    "derived_table",
    """
    SELECT d.first_flag, COUNT(*) AS orders
    FROM (SELECT l_orderkey, l_returnflag AS first_flag,
                 ROW_NUMBER() OVER (PARTITION BY l_orderkey
                   ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_returnflag) AS rn FROM lineitem) d
    WHERE d.rn = 1 GROUP BY 1
    """,
)
def derived_table(t):
    order = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"]
    firsts = first_event(t.lineitem, ["l_orderkey"], order)
    return firsts.groupBy(F.col("l_returnflag").alias("first_flag")).agg(F.count(F.lit(1)).alias("orders"))
