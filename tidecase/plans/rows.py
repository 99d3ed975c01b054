"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidecase.functions.measures import flag, yes_no
from tidecase.functions.text import contains_ci
from tidecase.functions.timeid import datediff_boundary, dateid, dateid_between, timeid
from tidecase.operators.events import milestones
from tidecase.operators.intervals import current, live
from tidecase.operators.joins import apply_agg
from tidecase.plans.registry import query
from tidecase.sources.derived import state_versions


@query(
    "project_rename",
    "SELECT c_custkey AS customer_id, c_name AS customer, c_mktsegment AS segment FROM customer",
)
def project_rename(t):
    return t.customer.select(
        F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer"), F.col("c_mktsegment").alias("segment")
    )


@query("project_star", "SELECT o.*, year(o_orderdate) AS order_year FROM orders o")
def project_star(t):
    return t.orders.alias("o").select("o.*", F.year("o_orderdate").alias("order_year"))


@query(
    "arith",
    """
    SELECT l_orderkey, l_linenumber, l_partkey // 7 AS whole, l_partkey % 7 AS rest, l_partkey / 7.0::DOUBLE AS exact,
           power(l_linenumber, 2) AS squared, 100.0::DOUBLE * l_tax AS tax_pct,
             l_extendedprice * (1 - l_discount) AS net
    FROM lineitem
    """,
)
def arith(t):
    part = F.col("l_partkey")
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        F.expr("l_partkey div 7").alias("whole"),
        (part % 7).alias("rest"),
        (part / F.lit(7.0)).alias("exact"),
        F.power("l_linenumber", F.lit(2)).alias("squared"),
        (F.lit(100.0) * F.col("l_tax")).alias("tax_pct"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
    )


@query("distinct_rows", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def distinct_rows(t):
    return t.lineitem.select("l_suppkey", "l_returnflag").distinct()


@query(
    "case_searched",
    """
    SELECT p_partkey, CASE WHEN p_type ILIKE '%economy%' AND p_size < 10 THEN 'small economy'
      WHEN p_type ILIKE '%economy%' THEN 'economy' WHEN p_size >= 40 THEN 'large' ELSE 'other' END AS bucket FROM part
    """,
)
def case_searched(t):
    economy = contains_ci("p_type", "%economy%")
    return t.part.select(
        "p_partkey",
        F.when(economy & (F.col("p_size") < 10), "small economy")
        .when(economy, "economy")
        .when(F.col("p_size") >= 40, "large")
        .otherwise("other")
        .alias("bucket"),
    )


@query(
    "earliest_of",
    """
    WITH m AS (SELECT l_orderkey, MIN(CASE WHEN l_returnflag = 'R' THEN l_shipdate END) AS returned,
                      MIN(CASE WHEN l_returnflag = 'A' THEN l_shipdate END) AS accepted FROM lineitem GROUP BY 1)
    SELECT l_orderkey, CASE WHEN returned IS NULL AND accepted IS NULL THEN NULL
        WHEN returned IS NULL THEN accepted WHEN accepted IS NULL THEN returned
        WHEN returned < accepted THEN returned ELSE accepted END AS first_date,
      CASE WHEN returned IS NULL AND accepted IS NULL THEN NULL
        WHEN accepted IS NULL THEN 'Returned' WHEN returned IS NULL THEN 'Accepted'
        WHEN returned < accepted THEN 'Returned' ELSE 'Accepted' END AS first_kind FROM m
    """,
)
def earliest_of(t):
    flags = F.col("l_returnflag")
    marks = milestones(t.lineitem, ["l_orderkey"], "l_shipdate", {"returned": flags == "R", "accepted": flags == "A"})
    earliest = F.least("returned", "accepted")
    return marks.select(
        "l_orderkey",
        earliest.alias("first_date"),
        F.when(F.col("accepted") == earliest, "Accepted").when(F.col("returned") == earliest, "Returned").alias("first_kind"),
    )


@query(
    "case_simple",
    """
    SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'pending'
      END AS status FROM orders
    """,
)
def case_simple(t):
    status = F.col("o_orderstatus")
    return t.orders.select(
        "o_orderkey", F.when(status == "F", "finished").when(status == "O", "open").otherwise("pending").alias("status")
    )


@query(
    "flags",
    """
    SELECT event_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS is_error,
           CASE WHEN value >= 100 THEN 'Yes' ELSE 'No' END AS is_large FROM events
    """,
)
def flags(t):
    return t.events.select(
        "event_id", flag(F.col("event_type") == "error").alias("is_error"), yes_no(F.col("value") >= 100).alias("is_large")
    )


@query(
    "exclusive_buckets",
    """
    WITH f AS (SELECT l_orderkey, MAX(CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END) r,
                      MAX(CASE WHEN l_returnflag='A' THEN 1 ELSE 0 END) a FROM lineitem GROUP BY 1)
    SELECT l_orderkey, CASE WHEN r=1 AND a=1 THEN 'both' WHEN r=1 THEN 'returned only'
      WHEN a=1 THEN 'accepted only' ELSE 'neither' END AS bucket FROM f
    """,
)
def exclusive_buckets(t):
    kind = F.col("l_returnflag")
    found = t.lineitem.groupBy("l_orderkey").agg(
        F.max(flag(kind == "R")).alias("r"), F.max(flag(kind == "A")).alias("a")
    )
    r, a = F.col("r") == 1, F.col("a") == 1
    bucket = F.when(r & a, "both").when(r, "returned only").when(a, "accepted only").otherwise("neither")
    return found.select("l_orderkey", bucket.alias("bucket"))


@query(
    "filter_and",
    """
    SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE 1=1 AND l_returnflag = 'R'
      AND l_linestatus = 'O' AND l_quantity > 45
    """,
)
def filter_and(t):
    return t.lineitem.filter("l_returnflag = 'R' AND l_linestatus = 'O' AND l_quantity > 45").select(
        "l_orderkey", "l_linenumber", "l_partkey"
    )


@query(
    "filter_or",
    """
    SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 400000)
      OR (o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')
    """,
)
def filter_or(t):
    status = F.col("o_orderstatus")
    finished = (status == "F") & (F.col("o_totalprice") > 400000)
    urgent = (status == "P") & (F.col("o_orderpriority") == "1-URGENT")
    return t.orders.filter(finished | urgent).select("o_orderkey")


@query(
    "filter_in",
    """
    SELECT event_id, event_type FROM events WHERE event_type IN ('signup','error')
      AND NULLIF(json_extract_string(props, '$.k'), '5') NOT IN ('1', '2', '3')
    """,
)
def filter_in(t):
    k = F.nullif(F.get_json_object("props", "$.k"), F.lit("5"))
    return t.events.filter(F.col("event_type").isin("signup", "error") & ~k.isin("1", "2", "3")).select(
        "event_id", "event_type"
    )


@query(
    "lit_in_cols",
    """
    SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE 5 IN (l_linenumber, l_partkey % 10, l_suppkey % 10)
    """,
)
def lit_in_cols(t):
    return t.lineitem.filter(
        F.lit(5).isin(F.col("l_linenumber"), F.col("l_partkey") % 10, F.col("l_suppkey") % 10)
    ).select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    "between_dateid",
    """
    SELECT o_orderkey, year(o_orderdate)*10000+month(o_orderdate)*100+day(o_orderdate) AS date_id
    FROM orders WHERE year(o_orderdate)*10000+month(o_orderdate)*100+day(o_orderdate) BETWEEN 19970100 AND 19970599
    """,
)
def between_dateid(t):
    return t.orders.filter(dateid_between("o_orderdate", 19970100, 19970599)).select(
        "o_orderkey", dateid("o_orderdate").alias("date_id")
    )


@query(
    "point_in_interval",
    """
    SELECT user_id, state FROM (SELECT user_id, event_type AS state, ts,
       LEAD(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to FROM events)
    WHERE TIMESTAMP '2024-01-15 12:00:00' BETWEEN ts AND COALESCE(valid_to, TIMESTAMP '2199-12-31')
    """,
)
def point_in_interval(t):
    point = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    far = F.lit("2199-12-31").cast("timestamp_ntz")
    return (
        state_versions(t.events)
        .filter(point.between(F.col("valid_from"), F.coalesce("valid_to", far)))
        .select("user_id", "state")
    )


@query(
    "like_patterns",
    """
    SELECT p_partkey, p_name FROM part WHERE (p_name ILIKE 'RED%' OR p_name ILIKE '%gea_')
      AND p_brand NOT ILIKE '%#1_'
      AND p_type NOT ILIKE 'standard'
    """,
)
def like_patterns(t):
    wanted = contains_ci("p_name", "RED%") | contains_ci("p_name", "%gea_")
    return t.part.filter(
        wanted & ~contains_ci("p_brand", "%#1_") & ~contains_ci("p_type", "standard")
    ).select("p_partkey", "p_name")


@query(
    "null_tests",
    """
    WITH m AS (SELECT l_orderkey, MIN(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN l_shipdate END) AS a,
       MIN(CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN l_shipdate END) AS b FROM lineitem GROUP BY 1)
    SELECT l_orderkey, COALESCE(a, b) AS first_date, CASE WHEN a IS NULL THEN 1 ELSE 0 END AS a_missing FROM m
      WHERE COALESCE(a, b) IS NOT NULL
    """,
)
def null_tests(t):
    f, s = F.col("l_returnflag"), F.col("l_linestatus")
    marks = {"a": (f == "R") & (s == "O"), "b": (f == "A") & (s == "F")}
    return (
        milestones(t.lineitem, ["l_orderkey"], "l_shipdate", marks)
        .filter(F.coalesce("a", "b").isNotNull())
        .select("l_orderkey", F.coalesce("a", "b").alias("first_date"), flag(F.col("a").isNull()).alias("a_missing"))
    )


@query(
    "null_safe_ne",
    """
    WITH x AS (SELECT event_id, CASE WHEN event_type IN ('signup', 'view') THEN event_type END AS status FROM events)
    SELECT event_id, status FROM x WHERE COALESCE(status, 'NULL') <> 'signup'
    """,
)
def null_safe_ne(t):
    status = F.when(F.col("event_type").isin("signup", "view"), F.col("event_type"))
    return t.events.select("event_id", status.alias("status")).filter(~F.col("status").eqNullSafe("signup"))


@query(
    "lexi_compare",
    """
    WITH e AS (SELECT *, year(ts)*10000+month(ts)*100+day(ts) AS d, hour(ts)*3600+minute(ts)*60+second(ts)+1 AS s
      FROM events),
    f AS (SELECT user_id, MIN(d*100000+s) AS p FROM e WHERE event_type = 'signup' GROUP BY 1)
    SELECT e.event_id, d AS date_id, s AS time_id FROM e JOIN f ON f.user_id = e.user_id WHERE d*100000+s > p
      AND event_type = 'error'
    """,
)
def lexi_compare(t):
    log = t.events.select(
        "event_id", "user_id", "event_type", dateid("ts").alias("date_id"), timeid("ts").alias("time_id")
    )
    at = F.struct("date_id", "time_id")
    first = F.min(at).alias("first_signup")
    errors = log.filter("event_type = 'error'")
    return (
        apply_agg(errors, log.filter("event_type = 'signup'"), ["user_id"], [first], "inner")
        .filter(at > F.col("first_signup"))
        .select("event_id", "date_id", "time_id")
    )


@query(
    "rule_violation",
    """
    SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE CASE WHEN o_orderstatus = 'F'
      AND o_totalprice >= 50000 THEN 1
      WHEN o_orderstatus = 'O' AND o_totalprice < 450000 THEN 1 ELSE 0 END = 0
    """,
)
def rule_violation(t):
    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    holds = ((status == "F") & (price >= 50000)) | ((status == "O") & (price < 450000))
    return t.orders.filter(~F.coalesce(holds, F.lit(False))).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query(
    "col_vs_col",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_tax, l_discount FROM lineitem WHERE l_tax > l_discount
    """,
)
def col_vs_col(t):
    return t.lineitem.filter(F.col("l_tax") > F.col("l_discount")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_tax", "l_discount"
    )


@query(
    "case_bound",
    """
    SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity < (CASE
      WHEN l_returnflag = 'R' THEN 20 ELSE 5 END)
    """,
)
def case_bound(t):
    bound = F.when(F.col("l_returnflag") == "R", 20).otherwise(5)
    return t.lineitem.filter(F.col("l_quantity") < bound).select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    "live_rows",
    """
    SELECT o_orderstatus AS status, COUNT(*) AS live_orders FROM (SELECT *, CASE WHEN o_orderstatus = 'P'
      AND o_totalprice < 10000 THEN 1 ELSE 0 END AS delete_flag,
      CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END AS reverse_flag FROM orders) WHERE delete_flag = 0
        AND reverse_flag = 0 GROUP BY 1
    """,
)
def live_rows(t):
    flagged = t.orders.select(
        F.col("o_orderstatus").alias("status"),
        flag((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") < 10000)).alias("delete_flag"),
        flag(F.col("o_orderpriority") == "5-LOW").alias("reverse_flag"),
    )
    return live(flagged, "delete_flag", "reverse_flag").groupBy("status").agg(F.count(F.lit(1)).alias("live_orders"))


@query(
    "scd2_current",
    """
    SELECT user_id, event_type AS state, ts AS valid_from FROM (SELECT *, LEAD(ts) OVER (PARTITION BY user_id
      ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NULL
    """,
)
def scd2_current(t):
    return current(state_versions(t.events), "valid_to").select("user_id", "state", "valid_from")


@query(
    "implicit_cast",
    """
    SELECT event_id, props FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) BETWEEN 21 AND 41
    """,
)
def implicit_cast(t):
    return t.events.filter(F.get_json_object("props", "$.k").cast("int").between(21, 41)).select("event_id", "props")


@query(
    "age_filter",
    """
    SELECT o_orderkey, l_linenumber, l_partkey, date_diff('day', o_orderdate, l_shipdate) AS age FROM orders
      JOIN lineitem ON l_orderkey = o_orderkey
    WHERE date_diff('day', o_orderdate, l_shipdate) BETWEEN 60 AND 90
    """,
)
def age_filter(t):
    age = datediff_boundary("DAY", "o_orderdate", "l_shipdate")
    return (
        t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"))
        .select("o_orderkey", "l_linenumber", "l_partkey", age.alias("age"))
        .filter(F.col("age").between(60, 90))
    )
