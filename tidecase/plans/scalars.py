"""Scalar functions: dates, calendars, text, casts, JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidecase.functions import business, text, timeid
from tidecase.jobs.scorecard import weight
from tidecase.operators.slices import with_next, with_prev
from tidecase.plans.registry import query
from tidecase.sources.calendar import calendar, days_of

CHRISTMAS = [(12, 25)]  # of every year
DID = "year({c})*10000+month({c})*100+day({c})"


def first_and_last(t):
    """Per user: first and last event time."""
    return t.events.groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))


def order_lines(t):
    return t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"))


@query(
    "datediff_units",
    """
    WITH n AS (SELECT event_id, ts AS a, LEAD(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)
    SELECT event_id, date_diff('second', a, b) AS seconds, date_diff('minute', a, b) AS minutes,
      date_diff('hour', a, b) AS hours, date_diff('day', a, b) AS days FROM n
    """,
)
def datediff_units(t):
    units = {"seconds": "SECOND", "minutes": "MINUTE", "hours": "HOUR", "days": "DAY"}
    stepped = with_next(t.events, ["user_id"], ["ts", "event_id"], {"next_ts": "ts"})
    return stepped.select("event_id", *[timeid.datediff_boundary(u, "ts", "next_ts").alias(n) for n, u in units.items()])


@query(
    "dateadd_units",
    """
    SELECT event_id, ts + INTERVAL 90 SECOND AS plus_seconds, ts + INTERVAL 20 DAY AS plus_days,
      ts - INTERVAL 1 YEAR AS last_year, ts + to_hours(CAST(floor(value) AS INT)) AS plus_hours
      FROM events
    """,
)
def dateadd_units(t):
    return t.events.select(
        "event_id",
        timeid.dateadd("SECOND", 90, "ts").alias("plus_seconds"),
        timeid.dateadd("DAY", 20, "ts").alias("plus_days"),
        timeid.dateadd("YEAR", -1, "ts").alias("last_year"),
        timeid.dateadd("HOUR", F.floor("value").cast("int"), "ts").alias("plus_hours"),
    )


@query(
    "date_plus_int",
    """
    SELECT o_orderkey, o_orderdate + INTERVAL 45 DAY AS due, CAST(o_orderdate AS DATE) - 1 AS day_before FROM orders
    """,
)
def date_plus_int(t):
    return t.orders.select(
        "o_orderkey", timeid.dateadd("DAY", 45, "o_orderdate").alias("due"), F.date_sub(F.to_date("o_orderdate"), 1).alias("day_before")
    )


@query(
    "dateid_to_date",
    f"""
    SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CASE
      WHEN day(o_orderdate) <= 28 THEN make_date(year(o_orderdate), month(o_orderdate), day(o_orderdate))
      END AS checked
    FROM orders
    """,
)
def dateid_to_date(t):
    ids = t.orders.select("o_orderkey", timeid.dateid("o_orderdate").alias("date_id"))
    impossible = F.when(F.col("date_id") % 100 <= 28, F.col("date_id")).otherwise(F.floor(F.col("date_id") / 100) * 100)
    return ids.select(
        "o_orderkey",
        timeid.from_dateid("date_id").alias("day"),
        timeid.from_dateid(impossible, strict=False).alias("checked"),
    )


@query(
    "date_to_dateid",
    f"""
    SELECT event_id, {DID.format(c='ts')} AS date_id, hour(ts)*3600+minute(ts)*60+second(ts)+1 AS time_id FROM events
    """,
)
def date_to_dateid(t):
    return t.events.select("event_id", timeid.dateid("ts").alias("date_id"), timeid.timeid("ts").alias("time_id"))


@query("ids_to_ts", "SELECT event_id, date_trunc('second', ts)::TIMESTAMP AS composed FROM events")
def ids_to_ts(t):
    ids = t.events.select("event_id", timeid.dateid("ts").alias("d"), timeid.timeid("ts").alias("s"))
    return ids.select("event_id", timeid.ids_to_ts("d", "s").alias("composed"))


@query(
    "date_parts",
    """
    SELECT event_id, year(ts) AS y, month(ts) AS m, day(ts) AS d, dayofweek(ts) + 1 AS weekday, hour(ts) AS h,
      minute(ts) AS mi, second(ts) AS s
      FROM events
    """,
)
def date_parts(t):
    return t.events.select(
        "event_id", F.year("ts").alias("y"), F.month("ts").alias("m"), F.dayofmonth("ts").alias("d"),
        F.dayofweek("ts").alias("weekday"), F.hour("ts").alias("h"), F.minute("ts").alias("mi"), F.second("ts").alias("s"),
    )


@query("month_name", "SELECT monthname(o_orderdate) AS month_name, COUNT(*) AS orders FROM orders GROUP BY 1")
def month_name(t):
    return t.orders.groupBy(timeid.month_name("o_orderdate").alias("month_name")).agg(F.count(F.lit(1)).alias("orders"))


@query("to_date", "SELECT CAST(ts AS DATE) AS day, COUNT(*) AS events FROM events GROUP BY 1")
def to_date(t):
    return t.events.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("events"))


@query(
    "prev_business_day",
    """
    SELECT o_orderkey, CAST(o_orderdate AS DATE) - CAST(CASE dayofweek(o_orderdate) WHEN 1 THEN 3 WHEN 0 THEN 2
      ELSE 1 END AS INT) AS prev_day FROM orders
    """,
)
def prev_business_day(t):
    return t.orders.select("o_orderkey", timeid.prev_business_day("o_orderdate").alias("prev_day"))


@query(
    "business_days",
    """
    WITH cal AS (SELECT d, SUM(CASE WHEN dayofweek(d) BETWEEN 1 AND 5 AND NOT (month(d) = 12
      AND day(d) = 25) THEN 1 ELSE 0 END) OVER (ORDER BY d)::BIGINT AS n
      FROM (SELECT CAST(unnest(generate_series((SELECT MIN(o_orderdate)::DATE - 2 FROM orders), (SELECT
      MAX(l_shipdate)::DATE FROM lineitem), INTERVAL 1 DAY)) AS DATE) AS d))
    SELECT o_orderkey, l_linenumber, l_partkey, b.n - a.n AS days FROM orders JOIN lineitem
      ON l_orderkey = o_orderkey JOIN cal a ON a.d = CAST(o_orderdate AS DATE) - 1 JOIN cal b
      ON b.d = CAST(l_shipdate AS DATE)
    WHERE l_shipdate >= o_orderdate
    """,
)
def business_days(t):
    return (
        order_lines(t)
        .filter("l_shipdate >= o_orderdate")
        .select("o_orderkey", "l_linenumber", "l_partkey", business.business_days("o_orderdate", "l_shipdate", CHRISTMAS).alias("days"))
    )


@query(
    "business_minutes",
    """
    WITH n AS (SELECT user_id, MIN(ts) AS a, MAX(ts) AS b FROM events GROUP BY 1),
    d AS (SELECT user_id, a, b, CAST(unnest(generate_series(a::DATE, b::DATE, INTERVAL 1 DAY)) AS DATE) AS day
      FROM n),
    o AS (SELECT user_id, greatest(least(CASE WHEN day = b::DATE THEN hour(b)*60+minute(b)
      ELSE 1440 END, 1080), 540) - greatest(least(CASE WHEN day = a::DATE THEN hour(a)*60+minute(a)
      ELSE 0 END, 1080), 540) AS m, day FROM d)
    SELECT user_id, SUM(CASE WHEN dayofweek(day) BETWEEN 1 AND 5 THEN m ELSE 0 END)::BIGINT AS minutes FROM o
      GROUP BY 1
    """,
)
def business_minutes(t):
    minutes = business.business_minutes("a", "b", 9 * 60, 18 * 60)
    return first_and_last(t).select("user_id", minutes.cast("bigint").alias("minutes"))


@query(
    "week_of",
    """
    SELECT o_orderkey, CAST(o_orderdate AS DATE) - CAST((dayofweek(o_orderdate) + 2) % 7 AS INT) AS week_of
      FROM orders
    """,
)
def week_of(t):
    return t.orders.select("o_orderkey", timeid.week_of("o_orderdate", "Fri").alias("week_of"))


@query(
    "date_literal",
    """
    SELECT event_id FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-09' AND CAST(ts AS DATE) < DATE '2024-01-21'
    """,
)
def date_literal(t):
    day = F.to_date("ts")
    first, after = F.to_date(F.lit("1/9/2024"), "M/d/yyyy"), F.to_date(F.lit("1/21/24"), "M/d/yy")
    return t.events.filter((day >= first) & (day < after)).select("event_id")


@query(
    "calendar_dim",
    """
    WITH d AS (SELECT CAST(unnest(generate_series((SELECT MIN(o_orderdate)::DATE FROM orders), (SELECT
      MAX(o_orderdate)::DATE FROM orders), INTERVAL 1 DAY)) AS DATE) AS date)
    SELECT date, year(date)*10000+month(date)*100+day(date) AS date_id, dayname(date) AS day_name,
      monthname(date) AS month_name, year(date)*100+month(date) AS month_key,
      year(date)*10+quarter(date) AS quarter_key,
      dayofweek(date) + 1 AS weekday_key, CASE WHEN dayofweek(date) IN (0, 6) THEN 1 ELSE 0 END AS weekend_flag,
        CASE WHEN month(date)=12 AND day(date)=25 THEN 1 ELSE 0 END AS holiday_flag,
      CASE WHEN dayofweek(date) IN (0, 6) OR (month(date)=12 AND day(date)=25) THEN 0 ELSE 1
        END AS business_flag, COUNT(o_orderkey) AS orders FROM d LEFT JOIN orders
        ON CAST(o_orderdate AS DATE) = date GROUP BY ALL
    """,
)
def calendar_dim(t):
    cal = calendar(days_of(t.orders, "o_orderdate"), CHRISTMAS)
    daily = t.orders.groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count(F.lit(1)).alias("orders"))
    return cal.join(daily, "date", "left").fillna(0, ["orders"])


@query(
    "concat_null",
    """
    WITH x AS (SELECT event_id, event_type, CASE WHEN event_type <> 'view' THEN props END AS p, user_id FROM events)
    SELECT event_id, concat(event_type, p, user_id) AS blank, event_type || p AS strict FROM x
    """,
)
def concat_null(t):
    p = F.when(F.col("event_type") != "view", F.col("props"))
    return t.events.select(
        "event_id", text.concat_blank("event_type", p, "user_id").alias("blank"), F.concat("event_type", p).alias("strict")
    )


@query(
    "normalize_phone",
    """
    WITH x AS (SELECT c_custkey, '(' || lpad(CAST(c_custkey % 900 + 100 AS VARCHAR), 3,
      '0') || ') 555-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS phone
      FROM customer)
    SELECT c_custkey, replace(replace(replace(replace(phone, '(', ''), ')', ''), ' ', ''), '-', '') AS digits,
      replace(right(phone, 6), '-', '') AS ext
      FROM x
    """,
)
def normalize_phone(t):
    def digits(c, width):
        return F.lpad(c.cast("string"), width, "0")

    key = F.col("c_custkey")
    phone = F.concat(F.lit("("), digits(key % 900 + 100, 3), F.lit(") 555-"), digits(key % 10000, 4))
    return t.customer.select(
        "c_custkey", text.normalize_phone(phone).alias("digits"), text.extension(phone).alias("ext")
    )


@query(
    "parse_user",
    """
    WITH x AS (SELECT c_custkey, c_mktsegment, c_name, lpad(CAST(c_custkey AS VARCHAR), 5, '0') AS ext FROM customer)
    SELECT c_custkey, c_mktsegment AS first_name, c_name || ' Jr' AS last_name, ext,
      length(rtrim(c_mktsegment || '  ' || c_name || ' Jr - ' || ext || ' ')) AS len FROM x
    """,
)
def parse_user(t):
    user = F.concat("c_mktsegment", F.lit("  "), "c_name", F.lit(" Jr - "), F.lpad(F.col("c_custkey").cast("string"), 5, "0"), F.lit(" "))
    return t.customer.select("c_custkey", text.parse_user(user).alias("p"), text.text_length(user).alias("len")).select(
        "c_custkey", "p.first_name", "p.last_name", "p.ext", "len"
    )


@query(
    "strip_prefix",
    """
    SELECT c_custkey, CAST(replace(c_name, 'Customer#', '') AS INT) AS number, trim(replace(c_name, 'Customer#',
      '')) AS code
      FROM customer
    """,
)
def strip_prefix(t):
    code = text.strip_prefix("c_name", "Customer#")
    return t.customer.select("c_custkey", code.cast("int").alias("number"), code.alias("code"))


@query(
    "null_funcs",
    """
    SELECT event_id, COALESCE(CASE
      WHEN event_type = 'error' THEN value END, -1.0::DOUBLE) AS defaulted, NULLIF(event_type, 'view') AS not_view,
      COALESCE(NULLIF(event_type, 'view'), 'none') AS named FROM events
    """,
)
def null_funcs(t):
    not_view = F.nullif("event_type", F.lit("view"))
    return t.events.select(
        "event_id",
        F.coalesce(F.when(F.col("event_type") == "error", F.col("value")), F.lit(-1.0)).alias("defaulted"),
        not_view.alias("not_view"),
        F.ifnull(not_view, F.lit("none")).alias("named"),
    )


@query(
    "casts",
    """
    SELECT event_id, CAST(trunc(value) AS INT) AS as_int, CAST(user_id AS BIGINT) AS as_big,
      CAST(CAST(value AS DECIMAL(9,2)) AS DOUBLE) AS as_numeric, left(CAST(event_id AS VARCHAR), 2) AS short,
      CAST(ts AS DATE) AS as_date, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS as_float,
        TRY_CAST(event_type AS INT) AS not_int
        FROM events
    """,
)
def casts(t):
    return t.events.select(
        "event_id",
        F.col("value").cast("int").alias("as_int"),
        F.col("user_id").cast("bigint").alias("as_big"),
        F.col("value").cast("decimal(9,2)").cast("double").alias("as_numeric"),
        F.left(F.col("event_id").cast("string"), F.lit(2)).alias("short"),
        F.col("ts").cast("date").alias("as_date"),
        F.get_json_object("props", "$.k").cast("double").alias("as_float"),
        F.col("event_type").try_cast("int").alias("not_int"),
    )


@query(
    "is_numeric",
    """
    WITH x AS (SELECT event_id, CASE WHEN event_type = 'click' THEN event_type
      ELSE json_extract_string(props, '$.k') END AS agent FROM events)
    SELECT event_id, CAST(agent AS INT) AS agent FROM x WHERE TRY_CAST(agent AS DOUBLE) IS NOT NULL
    """,
)
def is_numeric(t):
    agent = F.when(F.col("event_type") == "click", F.col("event_type")).otherwise(F.get_json_object("props", "$.k"))
    return (
        t.events.select("event_id", agent.alias("agent"))
        .filter(text.is_numeric("agent"))
        .select("event_id", F.col("agent").try_cast("int").alias("agent"))
    )


@query(
    "json_value",
    """
    SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.missing') AS missing
      FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) BETWEEN 10 AND 60
    """,
)
def json_value(t):
    k = F.get_json_object("props", "$.k")
    return t.events.filter(k.cast("int").between(10, 60)).select(
        "event_id", k.alias("k"), F.get_json_object("props", "$.missing").alias("missing")
    )


@query(
    "duration_label",
    """
    WITH n AS (SELECT event_id, LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a, ts AS b FROM events)
    SELECT event_id, CASE WHEN date_diff('hour', a, b) > 24 THEN date_diff('day', a, b) || ' days'
      WHEN a IS NULL THEN 'No start time'
      ELSE (date_diff('minute', a, b) // 60) || ':' || lpad(CAST(date_diff('minute', a, b) % 60 AS VARCHAR), 2,
        '0') || ' Hours'
        END AS label FROM n
    """,
)
def duration_label(t):
    stepped = with_prev(t.events, ["user_id"], ["ts", "event_id"], {"since": "ts"})
    return stepped.select("event_id", text.duration_label("since", "ts").alias("label"))


@query("text_key", "SELECT o_orderkey, concat(o_custkey, month(o_orderdate), day(o_orderdate)) AS key FROM orders")
def text_key(t):
    return t.orders.select(
        "o_orderkey", text.concat_blank("o_custkey", F.month("o_orderdate"), F.dayofmonth("o_orderdate")).alias("key")
    )


@query(
    "rule_weights",
    """
    SELECT o_orderkey, CASE WHEN concat(o_orderstatus, o_orderpriority) = 'F1-URGENT' THEN 2.25::DOUBLE
      WHEN concat(o_orderstatus, o_orderpriority) LIKE 'F%' THEN 1.75
      WHEN concat(o_orderstatus, o_orderpriority) LIKE 'P4%' THEN 1.25
      WHEN concat(o_orderstatus, o_orderpriority) LIKE 'P%' THEN 1.0 WHEN o_orderpriority = '5-LOW' THEN 0.5
        END AS units FROM orders
    """,
)
def rule_weights(t):
    rules = [("F1-URGENT", 2.25), ("F%", 1.75), ("P4%", 1.25), ("P%", 1.0), ("%5-LOW", 0.5)]
    return t.orders.select("o_orderkey", weight(text.concat_blank("o_orderstatus", "o_orderpriority"), rules).alias("units"))
