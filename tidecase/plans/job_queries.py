"""Composite jobs bound to the test tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidecase.functions import text, timeid
from tidecase.functions.measures import count_if, money, money_avg, money_sum
from tidecase.jobs import (
    billing, calls, cohort, dwell, eventlog, expiry, history, matching, people, pipeline, process, productivity, reasons,
    scorecard, threads, touches, turntime, worklist,
)
from tidecase.operators.events import asof, nth_event
from tidecase.operators.joins import exists_flag, semi, spread_join
from tidecase.operators.slices import hot_keys
from tidecase.plans.join_queries import (
    FUZZY_SQL, ROLE_VERSIONS, SNAPSHOT_SQL, by_type, clearances, named_tables, role_at, role_log, role_versions, snapshot_store, staff_list,
    typed_entries,
)
from tidecase.plans.registry import QUERIES, query
from tidecase.plans.scalars import DID
from tidecase.sources.derived import OPEN_END, daily_snapshot, daily_versions
from tidecase.sources.scratch import session_path
from tidecase.sources.sinks import read_result, result_rows, write_result_sets

AS_OF = "2024-02-01 09:30:00"
ORDERS_AS_OF = "2002-01-01 00:00:00"


def K():
    return F.get_json_object("props", "$.k").cast("int")


KS = "CAST(json_extract_string(props, '$.k') AS INT)"
DEC = "CAST({c} AS DECIMAL(18,2))"


def log(t):
    """The event log as case log: case_id, ts, event_id, status, value."""
    return t.events.select(
        F.col("user_id").alias("case_id"), "ts", "event_id", F.col("event_type").alias("status"), "value"
    )


def cases(t):
    return t.orders.select(
        F.col("o_orderkey").alias("case_id"), F.col("o_custkey").alias("client"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("opened"), F.col("o_totalprice").alias("amount"),
    )


def items(t):
    return items_of(t.lineitem)


def items_of(lines):
    return lines.select(
        F.col("l_orderkey").alias("case_id"), F.col("l_shipdate").alias("ts"), F.col("l_returnflag").alias("status"),
        F.col("l_linestatus").alias("phase"), F.col("l_linenumber").alias("line"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").alias("tie"),
    )


ITEM_SQL = "l_linenumber, l_partkey, l_suppkey, l_returnflag"
ITEM_DESC = "l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_returnflag DESC"


def worker_hours(t):
    """Minutes worked: 'view' events of the user as worker."""
    return by_type(t, "view").select(
        F.col("user_id").alias("worker"), timeid.dateid("ts").alias("date_id"), "event_id", money("value").alias("minutes"), (K() % 3).alias("code")
    )


def worker_touches(t):
    """Sessions: 'click' events; the worker is the JSON number."""
    return by_type(t, "click").select(
        F.col("user_id").alias("case_id"), K().cast("bigint").alias("worker"), "ts", "event_id", timeid.dateid("ts").alias("date_id"),
        F.floor("value").cast("bigint").alias("seconds"),
    )


@query(
    "turn_time",
    """
    WITH f AS (SELECT o_orderkey, MIN(CASE WHEN l_linestatus = 'F' THEN l_shipdate END) AS shipped, MIN(CASE
      WHEN l_returnflag = 'R' THEN l_shipdate END) AS returned
      FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate GROUP BY 1)
    SELECT o_orderpriority AS priority, COUNT(*) AS cases, COUNT(shipped) AS shipped_cases,
      COUNT(returned) AS returned_cases,
      CAST(SUM(date_diff('day', o_orderdate, shipped)) AS DOUBLE) / COUNT(shipped) AS shipped_avg_days,
        CAST(SUM(date_diff('day', o_orderdate, returned)) AS DOUBLE) / COUNT(returned) AS returned_avg_days
    FROM orders o LEFT JOIN f ON f.o_orderkey = o.o_orderkey GROUP BY 1
    """,
)
def turn_time(t):
    return turn_time_of(t)


def turn_time_of(t):
    marks = {"shipped": F.col("phase") == "F", "returned": F.col("status") == "R"}
    lines = items(t).select("case_id", "ts", "status", "phase")
    opened = cases(t).select("case_id", "priority", "opened")
    turned = turntime.turn_times(opened, lines, "case_id", "opened", "ts", marks)
    return turntime.average_turn_times(turned, ["priority"], list(marks))


@query("turn_time_catalog", QUERIES["turn_time"].sql)
def turn_time_catalog(t):
    """Over tables of the catalog that are bucketed by case: the lines meet their cases without a shuffle."""
    return turn_time_of(named_tables(t))


MARKS_SQL = """
    f AS (SELECT o_orderkey, MIN(CASE WHEN l_linestatus = 'F' THEN l_shipdate END) AS shipped, MIN(CASE
      WHEN l_returnflag = 'R' THEN l_shipdate END) AS returned, MAX(CASE WHEN l_linestatus = 'F' THEN l_shipdate
      END) AS last_shipped, MAX(CASE WHEN l_returnflag = 'R' THEN l_shipdate END) AS last_returned
      FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate GROUP BY 1)
    """


def _marked(t, last: bool):
    marks = {"shipped": F.col("phase") == "F", "returned": F.col("status") == "R"}
    lines = items(t).select("case_id", "ts", "status", "phase")
    opened = cases(t).select("case_id", "priority", "opened")
    return turntime.turn_times(opened, lines, "case_id", "opened", "ts", marks, last=last)


@query(
    "turn_time_last",
    f"""
    WITH {MARKS_SQL}
    SELECT o_orderpriority AS priority, COUNT(*) AS cases, COUNT(last_shipped) AS shipped_cases,
      COUNT(last_returned) AS returned_cases,
      CAST(SUM(date_diff('day', o_orderdate, last_shipped)) AS DOUBLE) / COUNT(last_shipped) AS shipped_avg_days,
      CAST(SUM(date_diff('day', o_orderdate, last_returned)) AS DOUBLE) / COUNT(last_returned) AS returned_avg_days
    FROM orders o LEFT JOIN f ON f.o_orderkey = o.o_orderkey GROUP BY 1
    """,
)
def turn_time_last(t):
    return turntime.average_turn_times(_marked(t, last=True), ["priority"], ["shipped", "returned"])


@query(
    "turn_time_between",
    f"""
    WITH {MARKS_SQL}
    SELECT o.o_orderkey AS case_id, shipped, returned, least(shipped, returned) AS first_mark,
      CASE WHEN returned >= shipped THEN date_diff('day', shipped, returned) END AS back_days,
      CASE WHEN returned >= shipped THEN date_diff('hour', shipped, returned) END AS back_hours,
      CASE WHEN least(shipped, returned) >= o_orderdate THEN date_diff('day', o_orderdate, least(shipped, returned)) END AS mark_days,
      CASE WHEN least(shipped, returned) >= o_orderdate THEN date_diff('hour', o_orderdate, least(shipped, returned)) END AS mark_hours
    FROM orders o LEFT JOIN f ON f.o_orderkey = o.o_orderkey
    """,
)
def turn_time_between(t):
    """From one mark to another, and to the earlier of two, the one there is where a case has one only."""
    marked = _marked(t, last=False).withColumn("first_mark", turntime.earlier_of("first_mark", "shipped", "returned"))
    spans = turntime.turn_times_between(marked, {"back": ("shipped", "returned"), "mark": ("opened", "first_mark")})
    return spans.select("case_id", "shipped", "returned", "first_mark", "back_days", "back_hours", "mark_days", "mark_hours")


@query(
    "dwell_time",
    f"""
    WITH n AS (SELECT *, date_diff('second', ts, COALESCE(LEAD(ts) OVER (PARTITION BY user_id
      ORDER BY ts, event_id), TIMESTAMP '{AS_OF}')) AS s FROM events),
    m AS (SELECT c_custkey AS case_id, MIN(CASE WHEN event_type = 'purchase' THEN ts END) AS bought
      FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY 1)
    SELECT case_id, bought, COUNT(n.user_id) AS visits, COUNT(CASE
      WHEN n.ts < bought THEN 1 END) AS visits_before, COUNT(CASE
      WHEN n.ts > bought THEN 1 END) AS visits_after, CAST(SUM(s) AS DOUBLE) / 3600.0::DOUBLE AS hours
    FROM m LEFT JOIN n ON n.user_id = case_id AND n.event_type = 'error' GROUP BY 1, 2
    """,
)
def dwell_time(t):
    bought = by_type(t, "purchase").groupBy(F.col("user_id").alias("case_id")).agg(F.min("ts").alias("bought"))
    marked = t.customer.select(F.col("c_custkey").alias("case_id")).join(bought, "case_id", "left")
    return dwell.visits_to_state(log(t).drop("value"), marked, "error", "bought", timeid.at_midnight(AS_OF))


PRESENCE_SQL = """
    n AS (SELECT user_id AS agent, CAST(ts AS DATE) AS day, event_type, date_diff('second', ts, LEAD(ts)
      OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id)) AS s FROM events),
    r AS (SELECT day, agent, event_type, SUM(s) AS s FROM n GROUP BY 1, 2, 3 HAVING SUM(s) > 0),
    presence AS (SELECT day, agent, SUM(CASE WHEN event_type <> 'error' THEN s
      ELSE 0 END)::BIGINT AS logged_in, SUM(CASE WHEN event_type = 'click' THEN s ELSE 0 END)::BIGINT AS online
      FROM r GROUP BY 1, 2)
    """


def presence(t):
    states = t.events.select(F.col("user_id").alias("agent"), "ts", "event_id", F.col("event_type").alias("status"))
    return dwell.presence_time(states, away="error", online="click")


@query("presence_time", f"WITH {PRESENCE_SQL} SELECT * FROM presence")
def presence_time(t):
    return presence(t)


@query(
    "pipeline_size",
    """
    WITH daily AS (SELECT user_id, CAST(ts AS DATE) AS d, event_type AS state FROM (SELECT *, ROW_NUMBER()
      OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS rn FROM events)
      WHERE rn = 1),
    v AS (SELECT *, LEAD(d) OVER (PARTITION BY user_id ORDER BY d) AS nxt FROM daily),
    days AS (SELECT CAST(unnest(generate_series((SELECT MIN(ts)::DATE FROM events), (SELECT MAX(ts)::DATE
      FROM events), INTERVAL 1 DAY)) AS DATE) AS day),
    states AS (SELECT DISTINCT state FROM daily)
    SELECT s.state, days.day, COUNT(v.user_id) AS cases FROM states s CROSS JOIN days LEFT JOIN v
      ON v.state = s.state AND v.d <= days.day AND (v.nxt > days.day OR v.nxt IS NULL) GROUP BY 1, 2
    """,
)
def pipeline_size(t):
    changes = t.events.withColumnRenamed("event_type", "state")
    versions = daily_versions(changes, ["user_id"], ["ts", "event_id"], "state")
    bounds = t.events.agg(F.min(F.to_date("ts")).alias("a"), F.max(F.to_date("ts")).alias("b"))
    return pipeline.pipeline_size(versions, bounds.select("a").scalar(), bounds.select("b").scalar())


@query(
    "pipeline_size_window",
    """
    WITH daily AS (SELECT user_id, CAST(ts AS DATE) AS d, event_type AS state FROM (SELECT *, ROW_NUMBER()
      OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS rn FROM events)
      WHERE rn = 1),
    v AS (SELECT *, LEAD(d) OVER (PARTITION BY user_id ORDER BY d) AS nxt FROM daily),
    days AS (SELECT CAST(unnest(generate_series((SELECT MIN(ts)::DATE + 5 FROM events), (SELECT MIN(ts)::DATE + 15
      FROM events), INTERVAL 1 DAY)) AS DATE) AS day),
    states AS (SELECT DISTINCT state FROM daily)
    SELECT s.state, days.day, COUNT(v.user_id) AS cases FROM states s CROSS JOIN days LEFT JOIN v
      ON v.state = s.state AND v.d <= days.day AND (v.nxt > days.day OR v.nxt IS NULL) GROUP BY 1, 2
    """,
)
def pipeline_size_window(t):
    """A window inside the data: what was in a state before it counts from its first day."""
    changes = t.events.withColumnRenamed("event_type", "state")
    versions = daily_versions(changes, ["user_id"], ["ts", "event_id"], "state")
    start = t.events.agg(F.min(F.to_date("ts")).alias("a"))
    return pipeline.pipeline_size(
        versions, start.select(F.date_add("a", 5)).scalar(), start.select(F.date_add("a", 15)).scalar()
    )


@query(
    "pull_through",
    """
    WITH l AS (SELECT l_orderkey, MAX(l_shipdate) AS last_ship FROM lineitem GROUP BY 1),
    c AS (SELECT o_orderpriority || CASE WHEN o_totalprice > 250000 THEN ' Jumbo' ELSE '' END AS product, CASE
      WHEN o_orderstatus = 'F' THEN last_ship END AS closed_at, CASE WHEN o_orderstatus = 'P' THEN o_orderdate
      END AS fallout_at FROM orders LEFT JOIN l ON l_orderkey = o_orderkey)
    SELECT year(COALESCE(closed_at, fallout_at))*100+month(COALESCE(closed_at, fallout_at)) AS month_key, product,
      COUNT(closed_at) AS closed, COUNT(fallout_at) AS fallout,
      1.0::DOUBLE * COUNT(closed_at) / (COUNT(closed_at) + COUNT(fallout_at)) AS pull_through FROM c WHERE
        COALESCE(closed_at, fallout_at) IS NOT NULL GROUP BY 1, 2
    """,
)
def pull_through(t):
    last = t.lineitem.groupBy(F.col("l_orderkey").alias("case_id")).agg(F.max("l_shipdate").alias("last_ship"))
    size = F.when(F.col("amount") > 250000, " Jumbo").otherwise("")
    ended = cases(t).join(last, "case_id", "left").select(
        F.concat("priority", size).alias("product"),
        F.when(F.col("status") == "F", F.col("last_ship")).alias("closed_at"),
        F.when(F.col("status") == "P", F.col("opened")).alias("fallout_at"),
    )
    return pipeline.pull_through(ended, ["product"])


@query(
    "aged_backlog",
    f"""
    WITH h AS (SELECT l_orderkey, COUNT(*) AS holds, MAX(l_shipdate) AS last_hold, MAX(CASE
      WHEN rn = 4 THEN l_shipdate END) AS fourth_hold FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey
      ORDER BY l_shipdate, {ITEM_SQL}) AS rn FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1)
    SELECT o_orderkey AS case_id, NULLIF(o_orderstatus, 'P') AS status,
      date_diff('day', o_orderdate, TIMESTAMP '{ORDERS_AS_OF}') AS age_days,
      COALESCE(holds, 0) AS holds, last_hold, fourth_hold
    FROM orders LEFT JOIN h ON l_orderkey = o_orderkey WHERE COALESCE(NULLIF(o_orderstatus, 'P'), 'NULL') <> 'F'
      AND o_totalprice >= 1000 AND date_diff('day', o_orderdate, TIMESTAMP '{ORDERS_AS_OF}') >= 365
    """,
)
def aged_backlog(t):
    listed = cases(t).select(
        "case_id",
        F.nullif("status", F.lit("P")).alias("status"),
        "opened",
        F.when(F.col("amount") < 1000, 1).otherwise(0).alias("closed"),
    )
    return pipeline.aged_backlog(listed, items(t), timeid.at_midnight(ORDERS_AS_OF), 365, "R", "F")


EVENT_LOG_SQL = """
    bp AS (SELECT user_id AS case_id, MIN(ts) AS ts FROM events WHERE event_type = 'error' AND value > 50 GROUP BY 1),
    final2 AS (SELECT case_id, 'scrubbed' AS status, ts FROM bp UNION ALL SELECT case_id, 'help requested', e.ts
      FROM bp JOIN events e ON user_id = case_id AND event_type = 'signup' AND e.ts > bp.ts
      UNION ALL SELECT case_id, 'suspended', e.ts FROM bp JOIN events e ON user_id = case_id
        AND event_type = 'error' AND value > 100 AND e.ts > bp.ts
      UNION SELECT case_id, 'closed', MIN(e.ts) FROM bp JOIN events e ON user_id = case_id
        AND event_type = 'purchase' AND e.ts > bp.ts GROUP BY case_id),
    final AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY case_id ORDER BY ts, status) AS row_num FROM final2)
    """


def event_log_frame(t):
    events = log(t)
    entered = events.filter("status = 'error' AND value > 50").groupBy("case_id").agg(F.min("ts").alias("entered"))
    hot = hot_keys(events.select("case_id", "ts", "event_id"), ["case_id"], ["ts"])
    later = spread_join(events, entered, ["case_id"], hot=hot).filter("ts > entered")
    status = F.col("status")
    labels = {
        "help requested": status == "signup",
        "suspended": (status == "error") & (F.col("value") > 100),
        "closed": status == "purchase",
    }
    scrubbed = entered.select("case_id", F.lit("scrubbed").alias("status"), F.col("entered").alias("ts"))
    return eventlog.assemble([scrubbed, eventlog.labelled(later, labels, first_only=("closed",))], hot=hot)


@query("event_log", f"WITH {EVENT_LOG_SQL} SELECT * FROM final")
def event_log(t):
    return event_log_frame(t)


@query(
    "funnel_counts",
    f"""
    WITH {EVENT_LOG_SQL} SELECT status, COUNT(*) AS events, COUNT(DISTINCT case_id) AS cases, COUNT(DISTINCT
      CASE WHEN row_num = 1 THEN case_id END) AS started_with FROM final GROUP BY 1
    """,
)
def funnel_counts(t):
    return eventlog.funnel(event_log_frame(t))


@query(
    "funnel_rounds",
    f"""
    WITH {EVENT_LOG_SQL} SELECT round, COUNT(*) AS cases FROM (SELECT case_id, COUNT(*) AS round FROM final
      WHERE status = 'help requested' GROUP BY 1) GROUP BY 1
    """,
)
def funnel_rounds(t):
    return eventlog.rounds(event_log_frame(t), "help requested")


@query(
    "process_entry",
    f"""
    WITH f AS (SELECT user_id AS case_id, MIN(CASE WHEN event_type='view'
      AND value > 100 THEN ts END) AS scrubbed, MIN(CASE WHEN event_type='error'
      AND value > 100 THEN ts END) AS suspended,
      MIN(CASE WHEN event_type='signup' AND value > 100 THEN ts END) AS helped, COUNT(CASE
        WHEN event_type='signup' AND value > 100 THEN 1 END) AS help_count, MAX(CASE WHEN event_type='purchase'
        AND value > 100 THEN ts END) AS closed FROM events GROUP BY 1),
    e AS (SELECT *, CASE WHEN scrubbed IS NOT NULL AND suspended IS NOT NULL THEN CASE
      WHEN scrubbed < suspended THEN scrubbed ELSE suspended END WHEN suspended IS NULL THEN scrubbed
      ELSE suspended END AS entered_at,
      CASE WHEN scrubbed IS NOT NULL AND suspended IS NOT NULL THEN CASE WHEN scrubbed < suspended THEN 'scrub'
        ELSE 'hold' END WHEN suspended IS NULL THEN 'scrub' ELSE 'hold' END AS entry_event FROM f
        WHERE scrubbed IS NOT NULL OR suspended IS NOT NULL),
    x AS (SELECT *, COALESCE(CASE WHEN closed >= entered_at THEN closed END, TIMESTAMP '{AS_OF}') AS left_at FROM e)
    SELECT case_id, CAST(entered_at AS DATE) AS entered, entry_event, help_count, CASE
      WHEN suspended IS NOT NULL THEN 'True' ELSE 'False' END AS ever_held,
      CASE WHEN help_count > 0 AND suspended IS NOT NULL THEN COALESCE(CASE WHEN scrubbed IS NOT NULL THEN CASE
        WHEN helped < suspended THEN 'help then hold' ELSE 'hold then help' END END, '')
        WHEN help_count > 0 THEN 'help only' WHEN suspended IS NOT NULL THEN 'hold only' ELSE 'neither'
          END AS sub_bucket, CAST(left_at AS DATE) AS exited,
          date_diff('day', entered_at, left_at) AS days_in_process FROM x
    """,
)
def process_entry(t):
    large = F.col("value") > 100

    def mark(kind: str):
        return (F.col("status") == kind) & large

    return process.process_entry(
        log(t), mark("view"), mark("error"), mark("signup"), mark("purchase"), timeid.at_midnight(AS_OF)
    )


COHORT_SQL = f"""
    {SNAPSHOT_SQL}, c AS (SELECT user_id AS case_id, MIN(ts) AS opened, MAX(CASE WHEN event_type='purchase'
      AND value > 100 THEN ts END) AS closed_at, CAST(NULL AS TIMESTAMP) AS none FROM events GROUP BY 1),
    f AS (SELECT user_id AS case_id, MAX(ts) AS fell FROM events WHERE event_type='error' AND value > 200 GROUP BY 1),
    cc AS (SELECT c.case_id, opened, closed_at, CASE WHEN closed_at IS NULL THEN fell END AS fallout_at FROM c
      LEFT JOIN f ON f.case_id = c.case_id),
    aged AS (SELECT s.user_id, snapshot_id, s.state, cc.*, strptime(CAST(snapshot_id AS VARCHAR),
      '%Y%m%d')::DATE AS day
      FROM snap s JOIN cc ON cc.case_id = s.user_id WHERE s.state IN ('view', 'click')
      AND snapshot_id < 20240120
      AND date_diff('day', opened, strptime(CAST(snapshot_id AS VARCHAR), '%Y%m%d')) = 10),
    j AS (SELECT aged.*, l.state AS later_state FROM aged LEFT JOIN snap l ON l.user_id = aged.user_id
      AND l.snapshot_id = 20240120),
    cohort AS (SELECT case_id, snapshot_id, state AS entry_state, later_state, CASE
      WHEN CAST(fallout_at AS DATE) <= DATE '2024-01-20' THEN 'Fallout'
      WHEN later_state IN ('view','click') THEN 'Pipeline' ELSE 'Closed' END AS bucket,
      CASE WHEN closed_at IS NOT NULL THEN 1 ELSE 0 END AS pulled_through,
        date_diff('day', day, CAST(COALESCE(closed_at, fallout_at) AS DATE)) AS turn_days,
      date_diff('day', day, CASE
        WHEN CAST(fallout_at AS DATE) <= DATE '2024-01-20' THEN CAST(fallout_at AS DATE)
        WHEN later_state IN ('view','click') THEN DATE '2024-01-20'
        ELSE CAST(closed_at AS DATE) END) AS bucket_days FROM j)
    """


@query("cohort_compare_stored", f"WITH {COHORT_SQL} SELECT * FROM cohort")
def cohort_compare_stored(t):
    """The same from the stored snapshots: days and the comparison day are partitions."""
    days = snapshot_store(t).read().select(F.col("user_id").alias("case_id"), "snapshot_id", "state")
    return pipeline.cohort_compare(compared_cases(t), days, 10, ["view", "click"], 20240120)


@query("cohort_compare", f"WITH {COHORT_SQL} SELECT * FROM cohort")
def cohort_compare(t):
    days, compared = (
        daily_snapshot(t.events, only_id=day).select(F.col("user_id").alias("case_id"), "snapshot_id", "state") for day in (None, 20240120)
    )
    return pipeline.cohort_compare(compared_cases(t), days, 10, ["view", "click"], 20240120, compared)


def compared_cases(t):
    marked = t.events.groupBy(F.col("user_id").alias("case_id")).agg(
        F.min("ts").alias("opened"),
        F.max(F.when((F.col("event_type") == "purchase") & (F.col("value") > 100), F.col("ts"))).alias("closed_at"),
        F.max(F.when((F.col("event_type") == "error") & (F.col("value") > 200), F.col("ts"))).alias("_fell"),
    )
    fallout = F.when(F.col("closed_at").isNull(), F.col("_fell"))
    return marked.withColumn("fallout_at", fallout).drop("_fell")


UNIT_RULES = [("F1-URGENT", 2.25), ("F%", 1.75), ("P4%", 1.25), ("P%", 1.0)]


@query(
    "unit_scorecard",
    f"""
    WITH w AS (SELECT o_custkey AS worker, o_orderkey, CASE
      WHEN concat(o_orderstatus, o_orderpriority) = 'F1-URGENT' THEN 2.25
      WHEN concat(o_orderstatus, o_orderpriority) LIKE 'F%' THEN 1.75
      WHEN concat(o_orderstatus, o_orderpriority) LIKE 'P4%' THEN 1.25
        WHEN concat(o_orderstatus, o_orderpriority) LIKE 'P%' THEN 1.0 END::DECIMAL(9,2) AS units, o_totalprice
          FROM orders),
    s AS (SELECT worker, COUNT(*) AS n, CAST(SUM(units) AS DOUBLE) AS u, COUNT(CASE
      WHEN units IS NULL THEN 1 END) AS m FROM w JOIN lineitem ON l_orderkey = o_orderkey
      WHERE l_returnflag = 'R' AND l_quantity > 48 GROUP BY 1),
    c AS (SELECT worker, COUNT(*) AS n, CAST(SUM(units) AS DOUBLE) AS u, COUNT(CASE
      WHEN units IS NULL THEN 1 END) AS m FROM w WHERE o_totalprice > 450000 GROUP BY 1)
    SELECT COALESCE(s.worker, c.worker) AS worker, COALESCE(s.n, 0) AS status_count,
      COALESCE(s.u, 0) AS status_units, COALESCE(c.n, 0) AS closing_count, COALESCE(c.u, 0) AS closing_units,
      COALESCE(s.u, 0) * 0.75::DOUBLE + COALESCE(c.u, 0) * 0.25::DOUBLE AS total, COALESCE(s.m, 0) +
        COALESCE(c.m, 0) AS unmapped, c_name AS leader
    FROM s FULL JOIN c ON s.worker = c.worker LEFT JOIN customer ON c_custkey = COALESCE(s.worker, c.worker)
    """,
)
def unit_scorecard(t):
    units = scorecard.weight(text.concat_blank("status", "priority"), UNIT_RULES).cast("decimal(9,2)")
    weighted = cases(t).select(F.col("client").alias("worker"), "case_id", units.alias("units"), "amount")
    returned = t.lineitem.filter("l_returnflag = 'R' AND l_quantity > 48").select(F.col("l_orderkey").alias("case_id"))
    scores = scorecard.unit_scorecard(
        weighted.join(returned, "case_id").select("worker", "units"), weighted.filter("amount > 450000").select("worker", "units"), "worker"
    )
    staff = t.customer.select("c_custkey", F.col("c_name").alias("leader"))
    return scorecard.with_leaders(scores, staff, "worker", "c_custkey", ["leader"])


@query(
    "unit_scorecard_adjusted",
    """
    WITH low AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_discount = 0 AND l_tax = 0),
    w AS (SELECT o_custkey AS worker, CASE WHEN concat(o_orderstatus, o_orderpriority) = 'F1-URGENT' THEN 2.25
      WHEN concat(o_orderstatus, o_orderpriority) LIKE 'F%' THEN CASE WHEN l_orderkey IS NOT NULL THEN 0.5
      ELSE 1.75 END
        WHEN concat(o_orderstatus, o_orderpriority) LIKE 'P4%' THEN CASE WHEN l_orderkey IS NOT NULL THEN 0.5
          ELSE 1.25 END
          WHEN concat(o_orderstatus, o_orderpriority) LIKE 'P%' THEN 1.0 END::DECIMAL(9,2) AS units FROM orders
          LEFT JOIN low ON l_orderkey = o_orderkey)
    SELECT worker, COUNT(*) AS closings, CAST(SUM(units) AS DOUBLE) AS units FROM w GROUP BY 1
    """,
)
def unit_scorecard_adjusted(t):
    low = t.lineitem.filter("l_discount = 0 AND l_tax = 0").select(F.col("l_orderkey").alias("case_id"))
    marked = exists_flag(cases(t), low, ["case_id"], "low_risk")
    key = text.concat_blank("status", "priority")
    rules = [(p, u, 0.5 if p in ("F%", "P4%") else u) for p, u in UNIT_RULES]
    units = scorecard.adjusted_weight(key, F.col("low_risk") == 1, rules).cast("decimal(9,2)")
    return marked.groupBy(F.col("client").alias("worker")).agg(
        F.count("*").alias("closings"), F.sum(units).cast("double").alias("units")
    )


GRID_SQL = f"""
    {PRESENCE_SQL}, days AS (SELECT CAST(unnest(generate_series(DATE '2024-02-01' - 120, DATE '2024-02-01',
      INTERVAL 1 DAY)) AS DATE) AS day), w AS (SELECT DISTINCT user_id AS worker
      FROM events),
    a AS (SELECT user_id AS worker, CAST(ts AS DATE) AS day, COUNT(*) AS statuses, COUNT(DISTINCT CASE
      WHEN event_type <> 'view' THEN {KS} END) AS distinct_cases, COUNT(CASE
      WHEN event_type = 'purchase' THEN 1 END) AS answered, COUNT(CASE WHEN event_type='purchase'
      AND value >= 180 THEN 1 END) AS long_calls FROM events GROUP BY 1, 2),
    s AS (SELECT user_id AS worker, CAST(ts AS DATE) AS day,
      COUNT(*) AS surveys, SUM({KS} % 5 + 1)::BIGINT AS score, COUNT(CASE
      WHEN {KS} % 5 + 1 IN (4, 5) THEN 1 END) AS fours_and_fives FROM events WHERE event_type='signup'
      GROUP BY 1, 2)
    SELECT w.worker, days.day, statuses, distinct_cases, answered, long_calls, surveys, score, fours_and_fives,
      logged_in, online, 1.0::DOUBLE * online / NULLIF(logged_in, 0) AS online_rate
    FROM w CROSS JOIN days LEFT JOIN a ON a.worker = w.worker AND a.day = days.day LEFT JOIN s
      ON s.worker = w.worker AND s.day = days.day LEFT JOIN presence p ON p.agent = w.worker
      AND p.day = days.day
    """


@query("productivity_grid", f"WITH {GRID_SQL}")
def productivity_grid(t):
    return dashboard(t, historical=True)


def dashboard(t, historical: bool, as_of: str = AS_OF):
    sessions = t.events.select(F.col("user_id").alias("worker"), "ts", "event_type", "value", K().alias("k"))
    kind = F.col("event_type")
    activity = productivity.worker_days(
        sessions,
        F.count("*").alias("statuses"),
        F.count_distinct(F.when(kind != "view", F.col("k"))).alias("distinct_cases"),
        count_if(kind == "purchase").alias("answered"),
        count_if((kind == "purchase") & (F.col("value") >= 180)).alias("long_calls"),
    )
    score = F.col("k") % 5 + 1
    surveys = productivity.worker_days(
        sessions.filter(kind == "signup"),
        F.count("*").alias("surveys"), F.sum(score).alias("score"), count_if(score.isin(4, 5)).alias("fours_and_fives"),
    )
    workers = sessions.select("worker").distinct()
    online = presence(t).withColumnRenamed("agent", "worker")
    return productivity.dashboard(workers, timeid.at_midnight(as_of), [activity, surveys], online, historical)


@query("productivity_today", f"WITH {GRID_SQL} WHERE days.day = DATE '2024-02-01'")
def productivity_today(t):
    """The procedure's other mode: the day of the run only."""
    return dashboard(t, historical=False)


@query("productivity_kept", f"WITH {GRID_SQL}")
def productivity_kept(t):
    """A kept grid: the historical run of the day before, then today's run, twice; its first day has left the window by then."""
    path = session_path(t.spark, "grid")
    before = dashboard(t, True, "2024-01-31 09:30:00")
    productivity.keep_dashboard(before, path)
    for _ in range(2):
        productivity.keep_dashboard(dashboard(t, False), path)
    kept = t.spark.read.schema(before.schema).parquet(path)
    return kept.filter(F.col("day") >= F.date_sub(F.to_date(timeid.at_midnight(AS_OF)), 120))


@query(
    "productivity_full",
    f"""
    WITH {PRESENCE_SQL}, days AS (SELECT CAST(unnest(generate_series(DATE '2024-02-01' - 120, DATE '2024-02-01',
      INTERVAL 1 DAY)) AS DATE) AS day), w AS (SELECT DISTINCT user_id AS worker FROM events),
    e AS (SELECT user_id AS worker, CAST(ts AS DATE) AS day, event_type, CAST(floor(value) AS BIGINT) AS sec, {KS} AS k, value FROM events),
    calls AS (SELECT worker, day, SUM(sec)::BIGINT AS talk, SUM(2 * sec + k)::BIGINT AS staff, SUM(k)::BIGINT AS aux, SUM(3 * k)::BIGINT AS avail,
      COUNT(*) AS inbound, COUNT(CASE WHEN k % 7 = 0 THEN 1 END) AS missed FROM e WHERE event_type = 'purchase' GROUP BY 1, 2),
    chats AS (SELECT worker, day, SUM(sec)::BIGINT AS talk, SUM(sec + k)::BIGINT AS staff FROM e WHERE event_type = 'error' GROUP BY 1, 2),
    texts AS (SELECT worker, day, COUNT(*) AS text_replies FROM e WHERE event_type = 'click' AND k % 2 = 0 GROUP BY 1, 2),
    hours AS (SELECT worker, day, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / 60.0::DOUBLE AS hours FROM e WHERE event_type = 'view' AND k % 3 < 2 GROUP BY 1, 2)
    SELECT w.worker, days.day, CASE WHEN calls.worker IS NULL AND chats.worker IS NULL THEN NULL
        ELSE (COALESCE(calls.talk, 0) + COALESCE(chats.talk, 0)) / 86400.0::DOUBLE END AS talk_time,
      CASE WHEN calls.worker IS NULL AND chats.worker IS NULL THEN NULL
        ELSE (COALESCE(calls.staff, 0) + COALESCE(chats.staff, 0)) / 86400.0::DOUBLE END AS staff_time,
      aux / 86400.0::DOUBLE AS aux_time, avail / 86400.0::DOUBLE AS avail_time, inbound AS inbound_calls, missed AS missed_calls,
      text_replies, hours, logged_in, online, 1.0::DOUBLE * online / NULLIF(logged_in, 0) AS online_rate
    FROM w CROSS JOIN days LEFT JOIN calls ON calls.worker = w.worker AND calls.day = days.day
      LEFT JOIN chats ON chats.worker = w.worker AND chats.day = days.day LEFT JOIN texts ON texts.worker = w.worker AND texts.day = days.day
      LEFT JOIN hours ON hours.worker = w.worker AND hours.day = days.day LEFT JOIN presence p ON p.agent = w.worker AND p.day = days.day
    """,
)
def productivity_full(t):
    """Telephone and chat cubes, text replies and hours worked on the same grid."""
    k, seconds, day = F.col("k"), F.floor("value").cast("bigint"), F.to_date("ts").alias("day")
    log = t.events.select(F.col("user_id").alias("worker"), "ts", day, "event_type", "value", seconds.alias("sec"), K().alias("k"))
    calls = log.filter("event_type = 'purchase'").select(
        "worker", "day", F.col("sec").alias("talk"), (2 * F.col("sec") + k).alias("staff"), k.alias("aux"), (3 * k).alias("avail"),
        F.lit(1).alias("inbound"), F.when(k % 7 == 0, 1).otherwise(0).alias("missed"),
    )
    chats = log.filter("event_type = 'error'").select("worker", "day", F.col("sec").alias("talk"), (F.col("sec") + k).alias("staff"))
    texts = productivity.worker_days(log.filter("event_type = 'click' AND k % 2 = 0"), F.count("*").alias("text_replies"))
    worked = productivity.worker_days(log.filter("event_type = 'view' AND k % 3 < 2"), (F.sum(money("value")).cast("double") / F.lit(60.0)).alias("hours"))
    online = presence(t).withColumnRenamed("agent", "worker")
    facts = [productivity.both_cubes(calls, chats), texts, worked]
    return productivity.dashboard(log.select("worker").distinct(), timeid.at_midnight(AS_OF), facts, online, True)


@query(
    "answer_rate",
    """
    SELECT user_id AS agent, CAST(ts AS DATE) AS day, COUNT(CASE
      WHEN event_type='purchase' THEN 1 END) AS answered, COUNT(CASE
      WHEN event_type='error' THEN 1 END) AS missed,
      100.0::DOUBLE * COUNT(CASE WHEN event_type='purchase' THEN 1 END) / NULLIF(COUNT(CASE
        WHEN event_type IN ('purchase', 'error') THEN 1 END), 0) AS rate FROM events WHERE event_type <> 'view'
        GROUP BY 1, 2
    """,
)
def answer_rate(t):
    offered = t.events.filter("event_type <> 'view'").select(F.col("user_id").alias("agent"), F.to_date("ts").alias("day"), "event_type")
    kind = F.col("event_type")
    return calls.answer_rate(offered, ["agent", "day"], kind == "purchase", kind == "error")


@query(
    "response_time",
    """
    WITH m AS (SELECT r.user_id AS thread, r.ts, r.event_id AS post_id, c.ts AS client_post,
      c.event_id AS client_post_id,
      ROW_NUMBER() OVER (PARTITION BY r.event_id ORDER BY c.ts DESC, c.event_id DESC) AS rn
      FROM (SELECT * FROM events WHERE event_type = 'purchase') r LEFT JOIN (SELECT * FROM events
        WHERE event_type = 'click') c ON c.user_id = r.user_id AND c.ts < r.ts)
    SELECT thread, ts, post_id, client_post, client_post_id, CASE WHEN client_post IS NULL THEN 'Team post'
      ELSE 'Client' END AS who_posted, CASE WHEN date_diff('hour', client_post, ts) > 24 THEN
      date_diff('day', client_post, ts) || ' days'
      WHEN client_post IS NULL THEN 'No start time'
        ELSE (date_diff('minute', client_post, ts) // 60) || ':' || lpad(CAST(date_diff('minute', client_post,
          ts) % 60 AS VARCHAR), 2, '0') || ' Hours'
        END AS delay FROM m WHERE rn = 1
    """,
)
def response_time(t):
    def posts(kind: str):
        return by_type(t, kind).select(F.col("user_id").alias("thread"), "ts", F.col("event_id").alias("post_id"))

    return threads.response_times(posts("click"), posts("purchase"))


@query(
    "response_turns",
    """
    SELECT a.conv_id, a.turn, MAX(u.turn) AS asked_turn FROM conversations a LEFT JOIN conversations u
      ON u.conv_id = a.conv_id AND u.role = 'user' AND u.turn < a.turn WHERE a.role = 'assistant' GROUP BY 1, 2
    """,
)
def response_turns(t):
    turns = t.conversations.select("conv_id", "turn", "role")
    asked, answered = turns.filter("role = 'user'"), turns.filter("role = 'assistant'").drop("role")
    return asof(answered, asked, ["conv_id"], "turn", "turn", {"asked_turn": "turn"})


TOUCH_SQL = f"""
    {ROLE_VERSIONS}, s AS (SELECT user_id AS case_id, CAST({KS} AS BIGINT) AS worker, event_id, ts,
      {DID.format(c='ts')} AS date_id, CAST(floor(value) AS BIGINT) AS seconds
      FROM events WHERE event_type = 'click'),
    touched AS (SELECT s.*, COALESCE(role, 'Other') AS role FROM s LEFT JOIN dim ON dim.user_id = s.worker
      AND date_id BETWEEN start_id AND end_id)
    """


def touched_by_role(t):
    return role_at(t, worker_touches(t), "worker").withColumn("role", F.coalesce("role", F.lit("Other")))


@query(
    "touches_by_role",
    f"""
    WITH {TOUCH_SQL}, g AS (SELECT case_id, role, COUNT(DISTINCT (worker, date_id)) AS n FROM touched GROUP BY 1, 2)
    SELECT case_id, SUM(CASE WHEN role='signup' THEN n END)::BIGINT AS signup, SUM(CASE
      WHEN role='view' THEN n END)::BIGINT AS view, SUM(CASE
      WHEN role='Other' THEN n END)::BIGINT AS "Other", SUM(n)::BIGINT AS "Total" FROM g GROUP BY 1
    """,
)
def touches_by_role(t):
    daily = touches.distinct_touches(touched_by_role(t), "case_id", "worker", "ts", F.col("seconds"), ["role"])
    return touches.touches_by_role(daily, "case_id", "role", ["signup", "view", "Other"])


TEAM_SQL = f"""
    {TOUCH_SQL}, members AS (SELECT touched.*, p.c_mktsegment AS pilot, CASE
      WHEN w.c_custkey % 4 > 0 THEN w.c_mktsegment END AS division, n_name AS title, w.c_custkey % 2 AS member
      FROM touched JOIN customer p ON p.c_custkey = case_id JOIN customer w ON w.c_custkey = worker JOIN nation
      ON n_nationkey = w.c_nationkey),
    tm AS (SELECT case_id, pilot, worker, role, division, title, member, SUM(seconds) AS seconds,
      COUNT(*) AS touches, COUNT(DISTINCT date_id) AS n FROM members GROUP BY ALL)
    """


@query(
    "touch_summary",
    f"""
    WITH {TEAM_SQL}
    SELECT pilot, CASE WHEN GROUPING(role) = 1 THEN 'All' ELSE COALESCE(role, 'Unknown') END AS team, CASE
      WHEN GROUPING(division) = 1 THEN 'All' ELSE COALESCE(division, 'Unknown') END AS division,
      CASE WHEN GROUPING(title) = 1 THEN 'All' ELSE COALESCE(title, 'Unknown') END AS title, CASE
        WHEN GROUPING(member) = 1 THEN 'All' WHEN member = 1 THEN 'TM' WHEN member = 0 THEN 'TL' ELSE 'Unknown'
        END AS member,
      COUNT(DISTINCT case_id) AS cases, COUNT(DISTINCT worker) AS workers, CAST(SUM(n) AS DOUBLE) /
        COUNT(DISTINCT case_id) AS avg_touches, CAST(SUM(seconds) AS DOUBLE) / 3600.0::DOUBLE /
        COUNT(DISTINCT case_id) AS avg_hours,
      CAST(SUM(seconds) AS DOUBLE) / 60.0::DOUBLE / SUM(touches) AS avg_session_minutes
    FROM tm
      GROUP BY GROUPING SETS ((pilot), (pilot, role), (pilot, role, division), (pilot, role, division, title, member))
    """,
)
def touch_summary(t):
    people_of = t.customer.select(
        F.col("c_custkey").alias("worker"),
        F.when(F.col("c_custkey") % 4 > 0, F.col("c_mktsegment")).alias("division"),
        F.col("c_nationkey").alias("n_nationkey"),
        F.when(F.col("c_custkey") % 2 == 1, "TM").otherwise("TL").alias("member"),
    ).join(t.nation.select("n_nationkey", F.col("n_name").alias("title")), "n_nationkey")
    pilots = t.customer.select(F.col("c_custkey").alias("case_id"), F.col("c_mktsegment").alias("pilot"))
    sessions = touched_by_role(t).withColumnRenamed("role", "team").join(people_of, "worker").join(pilots, "case_id")
    return touches.team_summary(sessions, "pilot", [["team"], ["division"], ["title", "member"]])


@query(
    "distinct_touches",
    f"""
    WITH s AS (SELECT user_id AS case_id, {KS} AS worker, ts, value, ROW_NUMBER()
      OVER (PARTITION BY user_id, {KS}, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS rn FROM events
      WHERE event_type = 'click')
    SELECT case_id, COUNT(*) AS touches, COUNT(CASE WHEN rn = 1 THEN 1 END) AS distinct_touches, COUNT(CASE
      WHEN rn = 1 AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25' THEN 1 END) AS in_window
      FROM s GROUP BY 1
    """,
)
def distinct_touches(t):
    marked = touches.last_on_day(worker_touches(t), ["case_id", "worker"], "ts", "event_id")
    last = F.col("last_on_day") == 1
    within = (F.col("ts") >= timeid.at_midnight("2024-01-05 00:00:00")) & (F.col("ts") < timeid.at_midnight("2024-01-25 00:00:00"))
    return marked.groupBy("case_id").agg(
        F.count("*").alias("touches"), count_if(last).alias("distinct_touches"), count_if(last & within).alias("in_window")
    )


@query(
    "state_at_event",
    """
    WITH s AS (SELECT * FROM events
      WHERE event_type IN ('signup', 'view', 'error')), now AS (SELECT user_id, event_type AS status_now
      FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM s)
      WHERE rn = 1),
    m AS (SELECT c.event_id, c.user_id, s.event_type AS status_at_call, ROW_NUMBER()
      OVER (PARTITION BY c.event_id ORDER BY s.ts DESC, s.event_id DESC) AS rn FROM events c LEFT JOIN s
      ON s.user_id = c.user_id AND s.ts < c.ts WHERE c.event_type = 'purchase')
    SELECT event_id, status_at_call, status_now FROM m LEFT JOIN now ON now.user_id = m.user_id WHERE rn = 1
    """,
)
def state_at_event(t):
    called = by_type(t, "purchase").select(F.col("user_id").alias("case_id"), "ts", "event_id")
    statuses = log(t).filter("status IN ('signup', 'view', 'error')").drop("value")
    return history.state_at_event(called, statuses).select("event_id", "status_at_call", "status_now")


@query(
    "increase_after",
    """
    WITH a AS (SELECT user_id AS case_id, MAX(ts) AS approved_at FROM events WHERE event_type = 'view'
      GROUP BY 1), v AS (SELECT * FROM events WHERE event_type = 'purchase'),
    b AS (SELECT case_id, approved_at, value AS approved_value, ROW_NUMBER() OVER (PARTITION BY case_id
      ORDER BY ts DESC, event_id DESC) AS rn FROM a JOIN v ON user_id = case_id AND ts <= approved_at),
    c AS (SELECT user_id, value AS current_value, ts AS changed_at, ROW_NUMBER() OVER (PARTITION BY user_id
      ORDER BY ts DESC, event_id DESC) AS rn FROM v)
    SELECT case_id, approved_at, approved_value, current_value, changed_at FROM b JOIN c ON user_id = case_id
      AND c.rn = 1 WHERE b.rn = 1 AND current_value > approved_value
    """,
)
def increase_after(t):
    approvals = log(t).filter("status = 'view'").select("case_id", "ts")
    return history.increase_after(approvals, log(t).filter("status = 'purchase'").drop("status"))


RECONCILE_SQL = """
    f AS (SELECT o_orderkey AS case_id, o_orderstatus AS status,
      CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM lineitem JOIN orders
      ON l_orderkey = o_orderkey GROUP BY 1, 2),
    bad AS (SELECT * FROM f WHERE CASE WHEN status = 'F' AND total >= 100000 THEN 1 WHEN status = 'P'
      AND total < 250000 THEN 1 ELSE 0 END = 0)
    """


def order_charges(t):
    return t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").alias("case_id"), F.col("o_orderstatus").alias("status"), "l_linenumber", "l_partkey", "l_extendedprice"
    )


def unexpected(t):
    status, total = F.col("status"), F.col("total")
    rule = ((status == "F") & (total >= 100000)) | ((status == "P") & (total < 250000))
    return billing.unexpected_totals(order_charges(t), ["case_id", "status"], "l_extendedprice", rule)


@query("reconcile", f"WITH {RECONCILE_SQL} SELECT * FROM bad")
def reconcile(t):
    return unexpected(t)


@query(
    "reconcile_detail",
    f"""
    WITH {RECONCILE_SQL} SELECT case_id, status, l_linenumber, l_partkey, l_extendedprice, total FROM bad
      JOIN lineitem ON l_orderkey = case_id
    """,
)
def reconcile_detail(t):
    return billing.charges_behind(order_charges(t), unexpected(t), ["case_id", "status"])


@query(
    "repeat_reason",
    f"""
    WITH b AS (SELECT DISTINCT {KS} AS g, {KS} % 5 AS reason FROM events UNION SELECT DISTINCT {KS}, {KS} % 3
      FROM events)
    SELECT user_id AS case_id, reason, COUNT(*) AS times, MIN(ts) AS first_time, MAX(ts) AS last_time
      FROM events JOIN b ON g = {KS} WHERE event_type = 'error' GROUP BY 1, 2 HAVING COUNT(*) >= 3
    """,
)
def repeat_reason(t):
    groups = t.events.select(K().alias("group_id")).distinct()
    bridge = groups.select("group_id", F.explode(F.array(F.col("group_id") % 5, F.col("group_id") % 3)).alias("reason"))
    suspensions = by_type(t, "error").select(F.col("user_id").alias("case_id"), "ts", K().alias("group_id"))
    return reasons.repeat_reasons(suspensions, bridge, 3)


@query(
    "nth_suspension_report",
    """
    WITH n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events
      WHERE event_type = 'error')
    SELECT user_id, MAX(rn) AS suspensions, MAX(CASE WHEN rn = 4 THEN ts END) AS fourth FROM n GROUP BY 1 HAVING
      MAX(rn) >= 4
    """,
)
def nth_suspension_report(t):
    errors = by_type(t, "error").select("user_id", "ts", "event_id")
    counts = errors.groupBy("user_id").agg(F.count("*").alias("suspensions")).filter("suspensions >= 4")
    fourth = nth_event(errors, ["user_id"], ["ts", "event_id"], 4).select("user_id", F.col("ts").alias("fourth"))
    return counts.join(fourth, "user_id")


@query(
    "reopened_aging",
    f"""
    WITH n AS (SELECT *, LAG(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events),
    r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM n
      WHERE event_type = 'error' AND prev IN ('purchase', 'view'))
    SELECT user_id AS case_id, ts AS reopened_at,
      date_diff('minute', ts, TIMESTAMP '{AS_OF}') / 1440.0::DOUBLE AS days_open FROM r WHERE rn = 1
    """,
)
def reopened_aging(t):
    return history.reopened_aging(log(t).drop("value"), "error", ["purchase", "view"], timeid.at_midnight(AS_OF))


HOURS_SQL = f"hours AS (SELECT user_id AS worker, {DID.format(c='ts')} AS date_id, CAST(SUM({DEC.format(c='value')}) AS DOUBLE) / 60.0::DOUBLE AS hours FROM events WHERE event_type = 'view' AND {KS} % 3 IN (0, 1) GROUP BY 1, 2)"


@query(
    "hours_worked",
    f"""
    WITH {ROLE_VERSIONS}, {HOURS_SQL} SELECT worker, date_id, hours, role AS leader FROM hours LEFT JOIN dim
      ON dim.user_id = worker AND date_id BETWEEN start_id AND end_id
    """,
)
def hours_worked(t):
    entries = worker_hours(t)
    leaders = role_versions(t).select(F.col("user_id").alias("worker"), F.col("role").alias("leader"), "start_id", "end_id")
    changes = role_log(t).select(F.col("user_id").alias("worker"), timeid.dateid("ts").alias("date_id"), "event_id")
    hot = hot_keys(entries.select("worker", "date_id", "event_id").unionByName(changes), ["worker"], ["date_id"])
    return people.hours_by_leader(people.hours_worked(entries, [0, 1]), leaders, hot)


@query(
    "effort_hours",
    f"""
    WITH pop AS (SELECT user_id FROM events WHERE event_type = 'error' GROUP BY 1 HAVING COUNT(*) >= 15),
    w AS (SELECT DISTINCT {KS} AS worker, {DID.format(c='ts')} AS date_id FROM events WHERE event_type = 'click'
      AND user_id IN (SELECT user_id FROM pop)),
    h AS (SELECT user_id AS worker, {DID.format(c='ts')} AS date_id, SUM({DEC.format(c='value')}) AS minutes
      FROM events WHERE event_type = 'view' GROUP BY 1, 2)
    SELECT w.date_id, COUNT(*) AS workers, CAST(SUM(minutes) AS DOUBLE) / 60.0::DOUBLE AS hours FROM w JOIN h
      ON h.worker = w.worker AND h.date_id = w.date_id GROUP BY 1
    """,
)
def effort_hours(t):
    population = by_type(t, "error").groupBy(F.col("user_id").alias("case_id")).agg(F.count("*").alias("n")).filter("n >= 15")
    return people.effort_hours(worker_touches(t), population, worker_hours(t))


MESSAGES_SQL = f"""
    replied AS (SELECT event_id AS message_id, user_id AS client, CASE WHEN {KS} BETWEEN 21
      AND 60 THEN CAST({KS} AS BIGINT) + 100000 END AS loan, ts, CAST({KS} AS BIGINT) AS worker FROM events
      WHERE event_type = 'click' AND (user_id * 100 + {KS}) IN (SELECT user_id * 100 + {KS} FROM events
        WHERE event_type = 'purchase' UNION SELECT user_id * 100 + {KS} + 1 FROM events
        WHERE event_type = 'signup')),
    received AS (SELECT event_id AS message_id, user_id AS client, CASE WHEN {KS} BETWEEN 21
      AND 41 THEN CAST({KS} AS BIGINT) + 100000 END AS loan, ts, CAST(NULL AS BIGINT) AS worker FROM events
      WHERE event_type = 'view' AND value >= 20),
    base AS (SELECT *, 'replied' AS action FROM replied UNION ALL SELECT *, 'received'
      FROM received), ranked AS (SELECT *, RANK() OVER (PARTITION BY COALESCE(loan, client) ORDER BY ts) AS rnk
      FROM base),
    messages AS (SELECT message_id, client, loan, ts, worker, CASE WHEN action = 'replied'
      AND rnk = 1 THEN 'initiated' ELSE action END AS action FROM ranked)
    """


def messages(t):
    def loan(low: int, high: int):
        return F.when(K().between(low, high), K().cast("bigint") + 100000).alias("loan")

    key = F.col("user_id") * 100 + K()
    base = [F.col("event_id").alias("message_id"), F.col("user_id").alias("client"), "ts"]
    replied = by_type(t, "click").select(*base, loan(21, 60), K().cast("bigint").alias("worker"), key.alias("sent_key"))
    received = by_type(t, "view").select(*base, loan(21, 41))
    sent = by_type(t, "purchase").select(key.alias("sent_key")).union(by_type(t, "signup").select(key + 1))
    routed = t.events.filter("value >= 20").select(F.col("event_id").alias("message_id"))
    return threads.attribute_messages(replied, received, sent, routed)


@query("conversation_attribution", f"WITH {MESSAGES_SQL} SELECT * FROM messages")
def conversation_attribution(t):
    return messages(t)


@query(
    "optin_chain",
    f"""
    WITH {MESSAGES_SQL}, e AS (SELECT c_custkey AS id, c_name AS name, CASE
      WHEN c_custkey > 0 THEN c_custkey // 10 END AS leader FROM customer),
    chain AS (SELECT e.id, e.name, l1.name AS team_leader, l2.name AS director, l3.name AS vp FROM e LEFT
      JOIN e l1 ON l1.id = e.leader LEFT JOIN e l2 ON l2.id = l1.leader LEFT JOIN e l3 ON l3.id = l2.leader),
    f AS (SELECT *, CAST(ts AS DATE) AS day, ROW_NUMBER() OVER (PARTITION BY client, CAST(ts AS DATE)
      ORDER BY ts, message_id) AS rn FROM messages WHERE message_id IN (SELECT event_id FROM events
      WHERE value >= 10))
    SELECT message_id, client, loan, ts, worker, action, day, name, team_leader, director, vp FROM f JOIN chain
      ON id = worker WHERE rn = 1
    """,
)
def optin_chain(t):
    staff = t.customer.select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
        F.expr("CASE WHEN c_custkey > 0 THEN c_custkey div 10 END").alias("leader"),
    )
    opted = t.events.filter("value >= 10").select(F.col("event_id").alias("message_id"))
    return threads.first_opt_in(messages(t), opted, threads.leader_chain(staff, ["team_leader", "director", "vp"]))


@query(
    "feature_table",
    """
    WITH l AS (SELECT l_orderkey, COUNT(*) AS lines, COUNT(DISTINCT l_suppkey) AS suppliers, MAX(CASE
      WHEN l_returnflag='R' THEN 1 ELSE 0 END) AS any_returned,
      CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity, MIN(l_shipdate) AS first_ship
      FROM lineitem GROUP BY 1)
    SELECT o_orderkey AS case_id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS closed, CASE
      WHEN o_totalprice > 300000 THEN 1 ELSE 0
      END AS jumbo, c_mktsegment AS segment, n_name AS nation, r_name AS region, COALESCE(lines, 0) AS lines,
      COALESCE(suppliers, 0) AS suppliers,
      COALESCE(any_returned, 0) AS any_returned, quantity,
        date_diff('day', o_orderdate, first_ship) AS days_to_ship, month(o_orderdate) AS open_month,
          dayofweek(o_orderdate) + 1 AS open_weekday
    FROM orders LEFT JOIN l ON l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey LEFT
      JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey
    """,
)
def feature_table(t):
    per_case = t.lineitem.groupBy(F.col("l_orderkey").alias("case_id")).agg(
        F.count("*").alias("lines"),
        F.count_distinct("l_suppkey").alias("suppliers"),
        F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("any_returned"),
        money_sum("l_quantity").alias("quantity"),
        F.min("l_shipdate").alias("first_ship"),
    )
    return (
        cases(t).join(per_case, "case_id", "left")
        .join(t.customer, F.col("c_custkey") == F.col("client"), "left")
        .join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"), "left")
        .join(t.region, F.col("r_regionkey") == F.col("n_regionkey"), "left")
        .fillna(0, ["lines", "suppliers", "any_returned"])
        .select(
            "case_id",
            F.when(F.col("status") == "F", 1).otherwise(0).alias("closed"),
            F.when(F.col("amount") > 300000, 1).otherwise(0).alias("jumbo"),
            F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"),
            "lines", "suppliers", "any_returned", "quantity",
            timeid.datediff_boundary("DAY", "opened", "first_ship").alias("days_to_ship"),
            F.month("opened").alias("open_month"), F.dayofweek("opened").alias("open_weekday"),
        )
    )


WORK_SQL = f"""
    it AS (SELECT l_orderkey AS case_id, 'line' || (l_linenumber % 3) AS kind, l_returnflag AS status,
      l_shipdate AS ts, {ITEM_SQL}
      FROM lineitem),
    lead AS (SELECT case_id, status AS review_status, ts AS review_since FROM (SELECT *, ROW_NUMBER()
      OVER (PARTITION BY case_id ORDER BY CASE WHEN status = 'R' THEN 1 ELSE 0 END DESC, ts, {ITEM_SQL}) AS rn
      FROM it) WHERE rn = 1),
    cond AS (SELECT l_orderkey AS case_id, COUNT(*) AS open_conditions, MIN(l_shipdate) AS oldest FROM lineitem
      WHERE l_linestatus = 'O' AND l_partkey IN (SELECT p_partkey FROM part WHERE p_type ILIKE '%econ_my%')
      GROUP BY 1),
    cur AS (SELECT case_id, kind, status FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY case_id, kind
      ORDER BY ts DESC, {ITEM_DESC}) AS rn FROM it) WHERE rn = 1),
    pv AS (SELECT case_id, MAX(CASE WHEN kind='line1' THEN status END) AS l1, MAX(CASE
      WHEN kind='line2' THEN status END) AS l2 FROM cur GROUP BY 1),
    wide AS (SELECT o_orderkey AS case_id, review_status,
      date_diff('second', o_orderdate, TIMESTAMP '{ORDERS_AS_OF}') / 86400.0::DOUBLE AS days_open,
      date_diff('second', review_since, TIMESTAMP '{ORDERS_AS_OF}') / 86400.0::DOUBLE AS days_in_review,
      COALESCE(open_conditions, 0) AS open_conditions,
        date_diff('second', oldest, TIMESTAMP '{ORDERS_AS_OF}') / 86400.0::DOUBLE AS days_with_condition, l1, l2
        FROM orders LEFT JOIN lead ON lead.case_id = o_orderkey LEFT JOIN cond ON cond.case_id = o_orderkey LEFT
        JOIN pv ON pv.case_id = o_orderkey WHERE o_orderstatus = 'O')
    """


def work_rows(t, listed):
    """Reviews and open conditions of the listed cases, from one stored table of their lines."""
    columns = ["l_orderkey", "l_shipdate", "l_returnflag", "l_linestatus", "l_linenumber", "l_partkey", "l_suppkey"]
    lines = worklist.case_rows(t.lineitem.select(*columns), "l_orderkey", listed)
    reviews = items_of(lines).withColumn("kind", F.concat(F.lit("line"), (F.col("line") % 3).cast("string")))
    wanted = t.part.filter(F.col("p_type").ilike("%econ_my%"))
    conditions = semi(lines.filter("l_linestatus = 'O'"), wanted, {"l_partkey": "p_partkey"}).select(
        F.col("l_orderkey").alias("case_id"), F.col("l_shipdate").alias("ts")
    )
    return reviews, conditions


@query(
    "work_list",
    f"""
    WITH {WORK_SQL} SELECT 'conditions' AS result, case_id, days_with_condition AS days FROM wide
      WHERE open_conditions > 0 UNION ALL SELECT 'incomplete', case_id, days_in_review FROM wide
      WHERE l1 = 'R' OR l2 = 'R'
    UNION ALL SELECT 'never reviewed', case_id, days_open FROM wide WHERE review_status IS NULL UNION ALL
      SELECT 'line1', case_id, days_open FROM wide WHERE l1 = 'R' UNION ALL SELECT 'line2', case_id, days_open
      FROM wide WHERE l2 = 'R'
    """,
)
def work_list(t):
    kinds, waiting = ["line1", "line2"], ["R"]
    open_cases = cases(t).filter("status = 'O'").select("case_id", "status", "opened")
    reviews, conditions = work_rows(t, open_cases)
    wide = worklist.work_list(open_cases, reviews, conditions, kinds, waiting, timeid.at_midnight(ORDERS_AS_OF))
    return worklist.signal_rows(wide, worklist.signals(kinds, waiting))


@query(
    "reason_matching",
    FUZZY_SQL
    + """,
    m AS (SELECT w.entry_id, c.clear_id, ROW_NUMBER() OVER (PARTITION BY w.entry_id
      ORDER BY c.ts DESC, c.clear_id DESC) AS rn
      FROM who w JOIN clears c ON c.loan = w.loan AND c.worker = w.worker AND CAST(c.ts AS DATE) = CAST(w.ts AS DATE)
        AND c.ts <= w.ts),
    reasons AS (SELECT m.clear_id, m.entry_id, e.props AS reason FROM m JOIN events e ON e.event_id = m.entry_id
      WHERE rn = 1),
    per_loan AS (SELECT loan, COUNT(*) AS loan_clearances FROM clears GROUP BY 1)
    SELECT c.clear_id, c.loan, loan_clearances, c.ts AS cleared_at, r.entry_id, COALESCE(r.reason, ' ') AS reason
    FROM clears c JOIN per_loan p ON p.loan = c.loan LEFT JOIN reasons r ON r.clear_id = c.clear_id
    """,
)
def reason_matching(t):
    text_of = t.events.select(F.col("event_id").alias("entry_id"), F.col("props").alias("reason"))
    entries = typed_entries(t).join(text_of, "entry_id")
    return matching.match_reasons(clearances(t), entries, staff_list(t))


@query(
    "business_expiry",
    f"""
    WITH cal AS (SELECT d, ROW_NUMBER() OVER (ORDER BY d) AS n
      FROM (SELECT CAST(unnest(generate_series(DATE '2023-12-01', DATE '2024-04-30', INTERVAL 1 DAY)) AS DATE) AS d)
      WHERE dayofweek(d) BETWEEN 1 AND 5 AND d <> DATE '2024-01-15'),
    h AS (SELECT user_id AS case_id, COUNT(*) AS requests, MAX(CAST(ts AS DATE)) AS last_request FROM events
      WHERE event_type = 'error' GROUP BY 1)
    SELECT case_id, requests, last_request, (SELECT cal.d FROM cal WHERE cal.n = 10 + (SELECT COUNT(*)
      FROM cal c2 WHERE c2.d <= h.last_request)) AS expires, (SELECT COUNT(*) FROM cal c3
      WHERE c3.d > h.last_request AND c3.d <= DATE '2024-02-01') AS business_days FROM h
    """,
)
def business_expiry(t):
    requests = by_type(t, "error").select(F.col("user_id").alias("case_id"), "ts")
    as_of = F.to_date(timeid.at_midnight(AS_OF))
    return expiry.business_expiry(requests, 10, as_of, [dt.date(2024, 1, 15)])


@query(
    "second_order",
    """
    SELECT o_custkey AS client, MIN(CASE WHEN o_totalprice > 400000 THEN o_orderdate END) AS ordered, CASE WHEN
      MIN(CASE WHEN o_totalprice > 300000 AND o_orderstatus = 'F' THEN o_orderdate END) >= MIN(CASE
      WHEN o_totalprice > 400000 THEN o_orderdate END)
      THEN MIN(CASE WHEN o_totalprice > 300000 AND o_orderstatus = 'F' THEN o_orderdate END) ELSE MIN(CASE
        WHEN o_totalprice > 400000 THEN o_orderdate END) END AS report_date
    FROM orders GROUP BY 1 HAVING COUNT(CASE WHEN o_totalprice > 400000 THEN 1 END) = 1
    """,
)
def second_order(t):
    placed = cases(t).select("client", F.col("opened").alias("ts"), "amount", "status")
    return history.second_order(placed, F.col("amount") > 400000, (F.col("amount") > 300000) & (F.col("status") == "F"))


@query(
    "prior_match",
    """
    SELECT o.o_orderkey AS case_id, p.o_orderkey AS prior_case, p.o_orderdate AS prior_ts FROM orders o LEFT
      JOIN LATERAL (SELECT * FROM orders p WHERE p.o_custkey = o.o_custkey
      AND p.o_orderpriority = o.o_orderpriority AND p.o_orderstatus = 'F' AND p.o_orderdate < o.o_orderdate
      ORDER BY p.o_orderdate DESC, p.o_orderkey DESC LIMIT 1) p ON true
    """,
)
def prior_match(t):
    listed = cases(t).withColumnRenamed("opened", "ts")
    served = listed.filter("status = 'F'")
    return history.prior_match(listed.select("case_id", "client", "priority", "ts"), served, ["client", "priority"]).select(
        "case_id", "prior_case", "prior_ts"
    )


@query(
    "call_daily",
    """
    SELECT CAST(ts AS DATE) AS day, COUNT(DISTINCT user_id) AS agents,
      CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS talk_time, COUNT(value) AS calls, 1.0::DOUBLE *
      COUNT(value) / COUNT(DISTINCT user_id) AS calls_per_agent FROM events
      WHERE event_type IN ('purchase', 'click') GROUP BY 1
    """,
)
def call_daily(t):
    connected = t.events.filter("event_type IN ('purchase', 'click')")
    return calls.daily_averages(connected, "ts", "user_id", "value")


@query(
    "roster_class",
    """
    SELECT CASE WHEN c_mktsegment ILIKE 'auto%' THEN 'Vehicles'
      WHEN c_mktsegment ILIKE '%build%' OR c_mktsegment ILIKE '%furn%' THEN 'Home'
      WHEN c_acctbal < 0 THEN 'Arrears' ELSE 'Other' END AS class, n_name AS office, COUNT(*) AS people,
      CAST(SUM(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) / COUNT(c_acctbal) AS avg_balance FROM customer
        JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2
    """,
)
def roster_class(t):
    title = F.col("c_mktsegment")
    label = (
        F.when(text.contains_ci(title, "auto%"), "Vehicles")
        .when(text.contains_ci(title, "%build%") | text.contains_ci(title, "%furn%"), "Home")
        .when(F.col("c_acctbal") < 0, "Arrears")
        .otherwise("Other")
    )
    return (
        t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
        .groupBy(label.alias("class"), F.col("n_name").alias("office"))
        .agg(F.count("*").alias("people"), money_avg("c_acctbal").alias("avg_balance"))
    )


@query(
    "first_in_role",
    f"""
    WITH {ROLE_VERSIONS} SELECT user_id AS worker, MIN(start_id) AS first_id FROM dim WHERE role = 'signup'
      GROUP BY 1 HAVING MAX(end_id) = 21991231
    """,
)
def first_in_role(t):
    return people.first_in_role(role_versions(t).withColumnRenamed("user_id", "worker"), "signup", OPEN_END)


@query(
    "missing_followup",
    f"""
    WITH f AS (SELECT l_orderkey, MIN(CASE WHEN l_returnflag = 'A' THEN l_shipdate END) AS taken_up
      FROM lineitem GROUP BY 1),
    c AS (SELECT o_orderkey AS case_id, o_orderdate AS opened, taken_up, CASE
      WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 90 DAY
      END AS closed_at, o_orderdate + INTERVAL 60 DAY AS expired FROM orders LEFT JOIN f
      ON l_orderkey = o_orderkey
      WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R'
        AND l_linestatus = 'O')),
    k AS (SELECT * FROM c WHERE expired < CASE WHEN taken_up IS NULL THEN closed_at ELSE taken_up END),
    m AS (SELECT k.*, l_returnflag AS status_at_expiry, ROW_NUMBER() OVER (PARTITION BY case_id
      ORDER BY l_shipdate DESC, {ITEM_DESC}) AS rn FROM k LEFT JOIN lineitem ON l_orderkey = case_id
      AND l_shipdate < expired)
    SELECT case_id, opened, taken_up, closed_at, expired, status_at_expiry FROM m WHERE rn = 1
    """,
)
def missing_followup(t):
    closed = F.when(F.col("status") == "F", timeid.dateadd("DAY", 90, "opened"))
    taken_up = items(t).filter("status = 'A'").groupBy("case_id").agg(F.min("ts").alias("taken_up"))
    listed = cases(t).join(taken_up, "case_id", "left").select("case_id", "opened", "taken_up", closed.alias("closed_at"))
    followups = items(t).filter("status = 'R' AND phase = 'O'")
    return history.missing_followup(listed, followups, items(t), 60)


COHORT_MARKS = ("view", "purchase")
WIDE_SQL = f"""
    {TOUCH_SQL}, cs AS (SELECT user_id AS case_id, MIN(ts) AS opened FROM events WHERE event_type = 'signup'
      GROUP BY 1),
    c AS (SELECT case_id, c_mktsegment AS pilot, opened, c_acctbal AS amount FROM cs JOIN customer
      ON c_custkey = case_id),
    f AS (SELECT c.case_id, MIN(CASE WHEN event_type = 'view' THEN ts END) AS view, MIN(CASE
      WHEN event_type = 'purchase' THEN ts END) AS purchase FROM c JOIN events ON user_id = case_id
      AND ts >= opened GROUP BY 1),
    n AS (SELECT user_id, event_type, ts, date_diff('second', ts, COALESCE(LEAD(ts) OVER (PARTITION BY user_id
      ORDER BY ts, event_id), TIMESTAMP '{AS_OF}')) AS s FROM events),
    h AS (SELECT c.case_id, COUNT(n.user_id) AS visits, COUNT(CASE
      WHEN n.ts < purchase THEN 1 END) AS visits_before, COUNT(CASE
      WHEN n.ts > purchase THEN 1 END) AS visits_after, CAST(SUM(s) AS DOUBLE) / 3600.0::DOUBLE AS hours FROM c
      LEFT JOIN f ON f.case_id = c.case_id LEFT JOIN n ON n.user_id = c.case_id AND n.event_type = 'error'
      GROUP BY 1),
    tt AS (SELECT case_id, COUNT(*) AS touches, SUM(seconds)::BIGINT AS touch_seconds,
      COUNT(DISTINCT (worker, date_id)) AS distinct_touches, COUNT(DISTINCT CASE
      WHEN role='signup' THEN (worker, date_id) END) AS r1, COUNT(DISTINCT CASE
      WHEN role='view' THEN (worker, date_id) END) AS r2, COUNT(DISTINCT CASE
      WHEN role='Other' THEN (worker, date_id) END) AS r3 FROM touched GROUP BY 1),
    wide AS (SELECT c.case_id, pilot, opened, amount,
      CAST(opened AS DATE) - CAST((dayofweek(opened) + 4) % 7 AS INT) AS week_of, view, purchase,
      date_diff('second', opened, view) AS view_seconds,
      date_diff('second', opened, purchase) AS purchase_seconds, visits, visits_before, visits_after, hours,
      touches, touch_seconds, distinct_touches, NULLIF(r1, 0) AS role_signup, NULLIF(r2, 0) AS role_view,
        NULLIF(r3, 0) AS role_other
        FROM c LEFT JOIN f ON f.case_id = c.case_id LEFT JOIN h ON h.case_id = c.case_id LEFT JOIN tt
        ON tt.case_id = c.case_id)
    """
ROLE_NAMES = ["role_signup", "role_view", "role_other"]
WEEK_LABEL = "CASE WHEN GROUPING(week_of) = 1 THEN 'Total' ELSE CAST(week_of AS VARCHAR) END AS week_of"
WEEK_SETS = "GROUP BY GROUPING SETS ((pilot, week_of), (pilot))"


def cohort_wide(t):
    opened = by_type(t, "signup").groupBy(F.col("user_id").alias("case_id")).agg(F.min("ts").alias("opened"))
    members = t.customer.select(
        F.col("c_custkey").alias("case_id"), F.col("c_mktsegment").alias("pilot"), F.col("c_acctbal").alias("amount")
    )
    listed = opened.join(members, "case_id").select("case_id", "pilot", "opened", "amount")
    marks = {m: F.col("status") == m for m in COHORT_MARKS}
    sessions = touched_by_role(t).withColumn("role", F.concat(F.lit("role_"), F.lower("role")))
    return cohort.wide_row(
        listed, log(t).drop("value"), sessions, marks, "error", "purchase", ROLE_NAMES, "Wed", timeid.at_midnight(AS_OF)
    )


def cohort_stage(t):
    """The wide row, computed once for all reports on the same state of its tables."""
    return t.stages.get("cohort_wide", [t.events, t.customer], lambda: cohort_wide(t))


@query("cohort_wide", f"WITH {WIDE_SQL} SELECT * FROM wide")
def cohort_wide_query(t):
    return cohort_wide(t)


@query(
    "cohort_speed_report",
    f"""
    WITH {WIDE_SQL} SELECT pilot, {WEEK_LABEL}, COUNT(*) AS cases,
      CAST(SUM(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) / COUNT(amount) AS avg_amount,
      CAST(COUNT(view) AS DOUBLE) / COUNT(*) AS view_share, CAST(COUNT(purchase) AS DOUBLE) /
        COUNT(*) AS purchase_share, CAST(SUM(view_seconds) AS DOUBLE) /
        COUNT(view_seconds) / 3600.0::DOUBLE AS view_avg_hours,
      CAST(SUM(purchase_seconds) AS DOUBLE) / COUNT(purchase_seconds) / 3600.0::DOUBLE AS purchase_avg_hours
        FROM wide {WEEK_SETS}
    """,
)
def cohort_speed_report(t):
    return cohort.speed_report(cohort_stage(t), list(COHORT_MARKS))


@query(
    "cohort_touch_report",
    f"""
    WITH {WIDE_SQL} SELECT pilot, {WEEK_LABEL}, COUNT(*) AS cases, CAST(SUM(touches) AS DOUBLE) /
      COUNT(touches) AS avg_touches, CAST(SUM(distinct_touches) AS DOUBLE) /
      COUNT(distinct_touches) AS avg_distinct,
      CAST(SUM(touch_seconds) AS DOUBLE) / COUNT(touch_seconds) / 3600.0::DOUBLE AS avg_hours,
        CAST(SUM(role_signup) AS DOUBLE) / COUNT(role_signup) AS avg_role_signup,
        CAST(SUM(role_view) AS DOUBLE) / COUNT(role_view) AS avg_role_view,
      CAST(SUM(role_other) AS DOUBLE) / COUNT(role_other) AS avg_role_other FROM wide {WEEK_SETS}
    """,
)
def cohort_touch_report(t):
    return cohort.touch_report(cohort_stage(t), ROLE_NAMES)


@query(
    "cohort_quality_report",
    f"""
    WITH {WIDE_SQL} SELECT pilot, {WEEK_LABEL}, COUNT(*) AS cases, CAST(COUNT(CASE
      WHEN visits > 0 THEN 1 END) AS DOUBLE) / COUNT(*) AS held_share, CAST(COUNT(CASE
      WHEN visits_before > 0 THEN 1 END) AS DOUBLE) / COUNT(*) AS held_before_share,
      CAST(COUNT(CASE WHEN visits_after > 0 THEN 1 END) AS DOUBLE) / COUNT(*) AS held_after_share
        FROM wide {WEEK_SETS}
    """,
)
def cohort_quality_report(t):
    return cohort.quality_report(cohort_stage(t))


@query(
    "cohort_profile_report",
    f"""
    WITH {WIDE_SQL}, p AS (SELECT wide.*, CAST(c_custkey % 100 AS DOUBLE) / 100 AS ltv, c_nationkey AS dti, CASE
      WHEN c_custkey % 7 > 0 THEN 600 + c_custkey % 200 END AS score FROM wide JOIN customer ON c_custkey = case_id)
    SELECT pilot, {WEEK_LABEL}, COUNT(*) AS cases,
      CAST(SUM(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) / COUNT(amount) AS avg_amount,
      CAST(SUM(CAST(ltv AS DECIMAL(18,2))) AS DOUBLE) / COUNT(ltv) AS avg_ltv,
      CAST(SUM(CAST(dti AS DECIMAL(18,2))) AS DOUBLE) / COUNT(dti) AS avg_dti,
      CAST(SUM(CAST(score AS DECIMAL(18,2))) AS DOUBLE) / COUNT(score) AS avg_score FROM p {WEEK_SETS}
    """,
)
def cohort_profile_report(t):
    key = F.col("c_custkey")
    traits = t.customer.select(
        key.alias("case_id"), ((key % 100).cast("double") / 100).alias("ltv"), F.col("c_nationkey").alias("dti"), F.when(key % 7 > 0, 600 + key % 200).alias("score")
    )
    return cohort.profile_report(cohort_stage(t).join(traits, "case_id"), ["amount", "ltv", "dti", "score"])


WORK_KINDS = ("line0", "line1", "line2")
WORK_SETS_SQL = f"""
    it AS (SELECT l_orderkey AS case_id, 'line' || (l_linenumber % 3) AS kind, l_returnflag AS status, l_shipdate AS ts, {ITEM_SQL} FROM lineitem),
    lead AS (SELECT case_id, status AS review_status, ts AS review_since FROM (SELECT *, ROW_NUMBER()
      OVER (PARTITION BY case_id ORDER BY CASE WHEN status = 'R' THEN 1 ELSE 0 END DESC, ts, {ITEM_SQL}) AS rn FROM it) WHERE rn = 1),
    cond AS (SELECT l_orderkey AS case_id, COUNT(*) AS open_conditions, MIN(l_shipdate) AS oldest FROM lineitem
      WHERE l_linestatus = 'O' AND l_partkey IN (SELECT p_partkey FROM part WHERE p_type ILIKE '%econ_my%') GROUP BY 1),
    cur AS (SELECT case_id, kind, status, ts FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY case_id, kind ORDER BY ts DESC, {ITEM_DESC}) AS rn FROM it) WHERE rn = 1),
    pv AS (SELECT case_id, {", ".join(f"MAX(CASE WHEN kind='{k}' THEN status END) AS s{i}, MAX(CASE WHEN kind='{k}' THEN ts END) AS t{i}" for i, k in enumerate(WORK_KINDS))} FROM cur GROUP BY 1),
    w0 AS (SELECT o_orderkey AS case_id, o_orderpriority AS priority, o_totalprice AS amount, review_status,
      date_diff('second', o_orderdate, TIMESTAMP '{ORDERS_AS_OF}') / 86400.0::DOUBLE AS days_open,
      date_diff('second', review_since, TIMESTAMP '{ORDERS_AS_OF}') / 86400.0::DOUBLE AS days_in_review,
      COALESCE(open_conditions, 0) AS open_conditions,
      date_diff('second', oldest, TIMESTAMP '{ORDERS_AS_OF}') / 86400.0::DOUBLE AS days_with_condition, s0, s1, s2,
      {", ".join(f"date_diff('second', t{i}, TIMESTAMP '{ORDERS_AS_OF}') / 86400.0::DOUBLE AS d{i}" for i in range(3))}
      FROM orders LEFT JOIN lead ON lead.case_id = o_orderkey LEFT JOIN cond ON cond.case_id = o_orderkey
      LEFT JOIN pv ON pv.case_id = o_orderkey WHERE o_orderstatus = 'O'),
    wide AS (SELECT *, CASE WHEN s0 = 'R' OR s1 = 'R' OR s2 = 'R' THEN 'Yes' ELSE 'No' END AS review_incomplete,
      CASE WHEN open_conditions > 0 THEN 'Yes' ELSE 'No' END AS has_conditions, CASE WHEN days_open >= 1500 THEN 'Yes' ELSE 'No' END AS aging,
      CASE WHEN s0 = 'N' AND s1 = 'N' THEN 'Both' WHEN s0 = 'N' THEN 'line0' WHEN s1 = 'N' THEN 'line1' ELSE 'No' END AS suspense FROM w0)
    """


def work_wide(t):
    open_cases = cases(t).filter("status = 'O'").select("case_id", "status", "opened", "priority", "amount")
    reviews, conditions = work_rows(t, open_cases)
    return worklist.work_list(open_cases, reviews, conditions, list(WORK_KINDS), ["R"], timeid.at_midnight(ORDERS_AS_OF))


def work_sets():
    return worklist.layouts(list(WORK_KINDS), ["R"], "N", ["A", "N"], 1500, timeid.at_midnight(ORDERS_AS_OF))


def work_result(name: str):
    """One result set of the report; the first to be asked for writes all ten in one job."""

    def run(t):
        wide, sets = work_wide(t), work_sets()
        layout = result_rows(wide, sets).drop("result").schema
        path = t.stages.place("work_sets", [t.orders, t.lineitem, t.part], lambda to: write_result_sets(wide, sets, to))
        return read_result(t.spark, f"{path}/data", name, sets[name], layout)

    return run


_DAYS = "case_id, {days} AS days, priority, days_open"
WORK_RESULTS = {
    "all": "SELECT case_id, priority, days_open, review_status, days_in_review, open_conditions, review_incomplete, has_conditions, days_with_condition, suspense, aging FROM wide",
    "high_risk": f"SELECT {_DAYS.format(days='days_in_review')} FROM wide WHERE amount > 300000",
    "first_review": f"SELECT {_DAYS.format(days='d0')}, has_conditions, days_with_condition FROM wide WHERE s0 = 'R'",
    "second_review": f"SELECT {_DAYS.format(days='d1')}, s0 AS other_status, d0 AS other_days, suspense FROM wide WHERE s1 = 'R'",
    "third_review": f"SELECT {_DAYS.format(days='d2')} FROM wide WHERE s2 = 'R'",
    "conditions": f"SELECT {_DAYS.format(days='days_with_condition')}, open_conditions, review_incomplete FROM wide WHERE open_conditions > 0",
    "aging": f"SELECT {_DAYS.format(days='days_open')}, review_status, days_in_review, open_conditions, has_conditions, days_with_condition FROM wide WHERE aging = 'Yes' AND review_incomplete = 'Yes'",
    "sitting": f"SELECT {_DAYS.format(days='days_in_review')}, review_status, aging, has_conditions, days_with_condition FROM wide WHERE priority LIKE '%2-%' AND (review_status IN ('A', 'N') OR aging = 'No')",
    "never_reviewed": f"SELECT {_DAYS.format(days='days_open')}, amount FROM wide WHERE review_status IS NULL",
    "suspense": "SELECT case_id, suspense, greatest(d0, d1) AS days, priority, days_open, s0 AS other_status, s1 AS last_status FROM wide WHERE suspense <> 'No'",
}
for _name, _sql in WORK_RESULTS.items():
    query(f"work_list_{_name}", f"WITH {WORK_SETS_SQL} {_sql}")(work_result(_name))
