"""Joins: dimensions, correlated applies, as-of, interval, semi and anti joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidecase.functions.measures import count_if, money_sum
from tidecase.functions.timeid import datediff_boundary, dateid
from tidecase.jobs import people, threads
from tidecase.jobs.calls import volume_by_half_hour
from tidecase.jobs.matching import nearest_clearance, resolve_people
from tidecase.operators.events import asof, first_event, last_event
from tidecase.operators.intervals import interval_join, state_on, sweep_join, version_join
from tidecase.operators.joins import anti, apply_agg, exists_flag, left_fan_out, semi, spread_join, with_group
from tidecase.operators.shapes import dense_grid, fill_grid
from tidecase.operators.slices import hot_keys, with_next, with_prev
from tidecase.plans.registry import query
from tidecase.sources.calendar import calendar, days_of
from tidecase.sources.catalog import catalog_of
from tidecase.sources.derived import daily_snapshot, daily_versions
from tidecase.sources.snapshots import SnapshotStore

LINE_ORDER = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"]
LINE_SQL = "l_shipdate, l_linenumber, l_partkey, l_suppkey, l_returnflag"
LINE_DESC = "l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_returnflag DESC"


def by_type(t, kind: str):
    return t.events.filter(F.col("event_type") == kind)


@query(
    "star_join",
    """
    SELECT r_name AS region, c_mktsegment AS segment, COUNT(*) AS orders,
      CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amount
    FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region
      ON r_regionkey = n_regionkey GROUP BY 1, 2
    """,
)
def star_join(t):
    return star(t)


def named_tables(t):
    """The tables under names in the catalog, with statistics; cases and their lines bucketed by case."""
    by = {"orders": ["o_orderkey"], "lineitem": ["l_orderkey"], "customer": ["c_custkey"], "nation": None, "region": None}
    frames = {name: (getattr(t, name), keys) for name, keys in by.items()}
    version = t.stages.version([df for df, _ in frames.values()])
    return catalog_of(t.spark, f"tidecase_{version}", frames, f"{t.stages.folder}/catalog-{version}")


@query(
    "star_join_catalog",
    """
    SELECT r_name AS region, c_mktsegment AS segment, COUNT(*) AS orders,
      CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amount
    FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region
      ON r_regionkey = n_regionkey GROUP BY 1, 2
    """,
)
def star_join_catalog(t):
    return star(named_tables(t))


def star(t):
    # nation and region hold a few rows; customer is joined by whatever Spark's size statistics allow
    return (
        t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
        .join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
        .join(t.region, F.col("r_regionkey") == F.col("n_regionkey"))
        .groupBy(F.col("r_name").alias("region"), F.col("c_mktsegment").alias("segment"))
        .agg(F.count(F.lit(1)).alias("orders"), money_sum("o_totalprice").alias("amount"))
    )


@query(
    "left_chain",
    """
    SELECT s_suppkey, n_name AS nation, r_name AS region FROM supplier LEFT JOIN (SELECT * FROM nation
      WHERE n_nationkey < 20) n ON n_nationkey = s_nationkey
    LEFT JOIN (SELECT * FROM region WHERE r_name <> 'ASIA') r ON r_regionkey = n_regionkey
    """,
)
def left_chain(t):
    return (
        t.supplier.join(t.nation.filter("n_nationkey < 20"), F.col("n_nationkey") == F.col("s_nationkey"), "left")
        .join(t.region.filter("r_name <> 'ASIA'"), F.col("r_regionkey") == F.col("n_regionkey"), "left")
        .select("s_suppkey", F.col("n_name").alias("nation"), F.col("r_name").alias("region"))
    )


@query(
    "left_on_filter",
    """
    SELECT o_orderkey, l_linenumber, l_partkey FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey
      AND l_returnflag = 'R' AND l_quantity > 40
    """,
)
def left_on_filter(t):
    lines = t.lineitem.filter("l_returnflag = 'R' AND l_quantity > 40").select(
        F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey"
    )
    return left_fan_out(t.orders.select("o_orderkey"), lines, ["o_orderkey"])


@query(
    "full_outer",
    """
    WITH a AS (SELECT user_id, COUNT(*) AS purchases FROM events WHERE event_type='purchase' AND value > 100
      GROUP BY 1),
         b AS (SELECT user_id, COUNT(*) AS errors FROM events WHERE event_type='error' AND value > 100 GROUP BY 1)
    SELECT COALESCE(a.user_id, b.user_id) AS user_id, COALESCE(purchases, 0) AS purchases,
      COALESCE(errors, 0) AS errors FROM a FULL JOIN b ON a.user_id = b.user_id
    """,
)
def full_outer(t):
    def count(kind: str, name: str):
        return by_type(t, kind).filter("value > 100").groupBy("user_id").agg(F.count(F.lit(1)).alias(name))

    return count("purchase", "purchases").join(count("error", "errors"), "user_id", "full").fillna(0, ["purchases", "errors"])


@query(
    "dense_grid",
    """
    WITH w AS (SELECT DISTINCT user_id FROM events), d AS (SELECT CAST(unnest(generate_series(
        (SELECT MIN(ts)::DATE FROM events), (SELECT MAX(ts)::DATE FROM events), INTERVAL 1 DAY)) AS DATE) AS day),
    p AS (SELECT user_id, CAST(ts AS DATE) AS day, COUNT(*) AS purchases FROM events WHERE event_type='purchase'
      GROUP BY 1, 2),
    e AS (SELECT user_id, CAST(ts AS DATE) AS day, COUNT(*) AS errors FROM events WHERE event_type='error'
      GROUP BY 1, 2)
    SELECT w.user_id, d.day, purchases, errors FROM w CROSS JOIN d LEFT JOIN p ON p.user_id = w.user_id
      AND p.day = d.day
    LEFT JOIN e ON e.user_id = w.user_id AND e.day = d.day
    """,
)
def dense_grid_query(t):
    bounds = t.events.agg(F.min(F.to_date("ts")).alias("a"), F.max(F.to_date("ts")).alias("b"))

    def count(kind: str, name: str):
        day = F.to_date("ts").alias("day")
        return by_type(t, kind).groupBy("user_id", day).agg(F.count(F.lit(1)).alias(name))

    grid = dense_grid(
        t.events.select("user_id").distinct(), bounds.select("a").scalar(), bounds.select("b").scalar()
    )
    return fill_grid(grid, [count("purchase", "purchases"), count("error", "errors")], ["user_id", "day"])


@query(
    "composite_key",
    """
    SELECT a.l_orderkey, a.l_linenumber, a.l_partkey, COUNT(*) AS same_day_lines FROM lineitem a JOIN lineitem b
      ON b.l_orderkey = a.l_orderkey AND b.l_shipdate = a.l_shipdate AND b.l_returnflag = a.l_returnflag
        AND b.l_linestatus = a.l_linestatus
    WHERE a.l_quantity > 25 GROUP BY a.l_orderkey, a.l_linenumber, a.l_partkey
    """,
)
def composite_key(t):
    keys = ["l_orderkey", "l_shipdate", "l_returnflag", "l_linestatus"]
    counts = t.lineitem.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return (
        t.lineitem.filter("l_quantity > 25")
        .join(counts, keys)
        .groupBy("l_orderkey", "l_linenumber", "l_partkey")
        .agg(F.sum("n").alias("same_day_lines"))
    )


@query(
    "argmin_group",
    """
    SELECT l.* FROM lineitem l JOIN (SELECT l_suppkey, l_returnflag, l_linestatus, l_linenumber,
      MIN(l_shipdate) AS first_ship FROM lineitem GROUP BY ALL) m
      ON m.l_suppkey = l.l_suppkey AND m.l_returnflag = l.l_returnflag AND m.l_linestatus = l.l_linestatus
        AND m.l_linenumber = l.l_linenumber AND l.l_shipdate = m.first_ship
    """,
)
def argmin_group(t):
    keys = ["l_suppkey", "l_returnflag", "l_linestatus", "l_linenumber"]
    return (
        with_group(t.lineitem, keys, F.min("l_shipdate").alias("first_ship"))
        .filter(F.col("l_shipdate") == F.col("first_ship"))
        .drop("first_ship")
    )


@query(
    "bridge_join",
    """
    WITH bridge AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
    SELECT o_orderpriority AS priority, p_brand AS brand, COUNT(*) AS pairs FROM orders JOIN bridge
      ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2
    """,
)
def bridge_join(t):
    bridge = t.lineitem.select("l_orderkey", "l_partkey").distinct()
    return (
        t.orders.join(bridge, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.part, F.col("p_partkey") == F.col("l_partkey"))
        .groupBy(F.col("o_orderpriority").alias("priority"), F.col("p_brand").alias("brand"))
        .agg(F.count(F.lit(1)).alias("pairs"))
    )


@query(
    "role_dims",
    """
    SELECT cn.n_name AS buyer_nation, sn.n_name AS seller_nation, COUNT(*) AS lines FROM lineitem JOIN orders
      ON o_orderkey = l_orderkey
    JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation cn
      ON cn.n_nationkey = c_nationkey
    JOIN nation sn ON sn.n_nationkey = s_nationkey GROUP BY 1, 2
    """,
)
def role_dims(t):
    def nation(role: str):
        return t.nation.select(F.col("n_nationkey").alias(f"{role}_key"), F.col("n_name").alias(f"{role}_nation"))

    return (
        t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
        .join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
        .join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey"))
        .join(nation("buyer"), F.col("buyer_key") == F.col("c_nationkey"))
        .join(nation("seller"), F.col("seller_key") == F.col("s_nationkey"))
        .groupBy("buyer_nation", "seller_nation")
        .agg(F.count(F.lit(1)).alias("lines"))
    )


@query(
    "leader_chain",
    """
    WITH e AS (SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey > 0 THEN c_custkey // 10
      END AS leader FROM customer)
    SELECT e.id, e.name, l1.name AS team_leader, l2.name AS director, l3.name AS vp FROM e LEFT JOIN e l1
      ON l1.id = e.leader
    LEFT JOIN e l2 ON l2.id = l1.leader LEFT JOIN e l3 ON l3.id = l2.leader
    """,
)
def leader_chain(t):
    staff = t.customer.select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.expr("CASE WHEN c_custkey > 0 THEN c_custkey div 10 END").alias("leader"),
    )
    return threads.leader_chain(staff, ["team_leader", "director", "vp"])


@query(
    "leader_top",
    """
    WITH RECURSIVE s AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 1000 = 1 THEN NULL WHEN c_custkey % 500 = 1 THEN c_custkey + 3
      ELSE c_custkey - 1 END AS leader FROM customer),
    r AS (SELECT id, id AS top_leader, 0::BIGINT AS levels FROM s WHERE leader IS NULL OR leader NOT IN (SELECT c_custkey FROM customer)
      UNION ALL SELECT s.id, r.top_leader, r.levels + 1 FROM s JOIN r ON s.leader = r.id)
    SELECT s.id, r.top_leader, r.levels FROM s LEFT JOIN r ON r.id = s.id
    """,
)
def leader_top(t):
    """Chains of hundreds of levels, and circles."""
    leader = F.expr("CASE WHEN c_custkey % 1000 = 1 THEN NULL WHEN c_custkey % 500 = 1 THEN c_custkey + 3 ELSE c_custkey - 1 END")
    return people.top_leaders(t.customer.select(F.col("c_custkey").alias("id"), leader.alias("leader")))


@query(
    "expr_key_join",
    """
    WITH o AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_custkey ELSE o_orderkey % 100 END AS who
      FROM orders)
    SELECT o_orderkey, c_name AS owner FROM o LEFT JOIN customer ON c_custkey = who
    """,
)
def expr_key_join(t):
    who = F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")).otherwise(F.col("o_orderkey") % 100)
    keyed = t.orders.select("o_orderkey", who.alias("who"))
    return keyed.join(t.customer, F.col("c_custkey") == F.col("who"), "left").select(
        "o_orderkey", F.col("c_name").alias("owner")
    )


ROLE_VERSIONS = """
    daily AS (SELECT user_id, CAST(ts AS DATE) AS d, arg_max(event_type, event_id) AS role FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS rn
        FROM events WHERE event_type IN ('signup', 'view')) WHERE rn = 1 GROUP BY 1, 2),
    dim AS (SELECT user_id, role, year(d)*10000+month(d)*100+day(d) AS start_id,
        COALESCE(LEAD(year(d - 1)*10000+month(d - 1)*100+day(d - 1)) OVER (PARTITION BY user_id
          ORDER BY d), 21991231) AS end_id FROM daily)
    """


def role_log(t):
    return t.events.filter("event_type IN ('signup', 'view')").withColumnRenamed("event_type", "role")


def role_versions(t):
    return daily_versions(role_log(t), ["user_id"], ["ts", "event_id"], "role")


def role_at(t, facts, worker: str):
    """Add the worker's role on the fact's ``date_id``."""
    roles = role_versions(t).withColumnRenamed("user_id", worker)
    # hot workers are found in the two base tables: the versions need not be computed for it
    changes = role_log(t).select(F.col("user_id").alias(worker), dateid("ts").alias("date_id"), "event_id")
    hot = hot_keys(facts.select(worker, "date_id", "event_id").unionByName(changes), [worker], ["date_id"])
    return version_join(facts, roles, [worker], "date_id", "start_id", "end_id", {"role": "role"}, hot=hot)


@query(
    "scd2_join",
    f"""
    WITH {ROLE_VERSIONS}, calls AS (SELECT event_id, user_id, year(ts)*10000+month(ts)*100+day(ts) AS date_id
      FROM events WHERE event_type = 'purchase')
    SELECT event_id, date_id, role FROM calls LEFT JOIN dim ON dim.user_id = calls.user_id
      AND date_id BETWEEN start_id AND end_id
    """,
)
def scd2_join(t):
    calls = by_type(t, "purchase").select("event_id", "user_id", dateid("ts").alias("date_id"))
    return role_at(t, calls, "user_id").drop("user_id")


@query(
    "interval_join",
    """
    WITH sessions AS (SELECT user_id, event_id AS session_id, ts AS start_ts,
      ts + to_minutes(CAST(floor(value) AS INT)) AS end_ts
      FROM events WHERE event_type = 'view')
    SELECT c.event_id, s.session_id FROM events c JOIN sessions s ON s.user_id = c.user_id
      AND c.ts BETWEEN s.start_ts AND s.end_ts WHERE c.event_type = 'click'
    """,
)
def interval_join_query(t):
    minutes = F.floor("value").cast("int")
    sessions = by_type(t, "view").select(
        "user_id", F.col("event_id").alias("session"), F.col("ts").alias("start_ts"), (F.col("ts") + F.make_dt_interval(mins=minutes)).alias("end_ts")
    )
    calls = by_type(t, "click").select("event_id", "user_id", "ts")
    return interval_join(
        calls, sessions, ["user_id"], "ts", "start_ts", F.col("end_ts"), {"session_id": "session"}
    ).select("event_id", "session_id")


@query(
    "interval_join_hot",
    """
    WITH s AS (SELECT user_id % 2 AS grp, event_id AS session_id, ts AS a, CASE WHEN event_id % 10 > 0
      THEN ts + to_minutes(CAST(floor(value) AS INT)) END AS b FROM events WHERE event_type = 'view')
    SELECT e.event_id, COUNT(*) AS alive, MAX(session_id) AS latest, COUNT(CASE WHEN b IS NULL THEN 1 END) AS open
      FROM events e JOIN s ON s.grp = e.user_id % 2 AND s.a <= e.ts AND (b IS NULL OR e.ts <= b)
      WHERE e.event_type = 'error' GROUP BY 1
    """,
)
def interval_join_hot(t):
    """Two keys with all points and intervals, a tenth of them without an end."""
    grp = (F.col("user_id") % 2).alias("grp")
    end = F.when(F.col("event_id") % 10 > 0, F.col("ts") + F.make_dt_interval(mins=F.floor("value").cast("int")))
    sessions = by_type(t, "view").select(grp, F.col("event_id").alias("session"), F.col("ts").alias("a"), end.alias("b"))
    errors = by_type(t, "error").select("event_id", grp, "ts")
    counts = {"alive": ("count", F.lit(1)), "latest": ("max", F.col("session_id")), "open": ("count", F.when(F.col("until").isNull(), 1))}
    found = sweep_join(errors, sessions, ["grp"], "ts", "a", "b", {"session_id": "session", "until": "b"}, points=64, rows_per_task=500, aggs=counts)
    return found.groupBy("event_id").agg(F.sum("alive").alias("alive"), F.max("latest").alias("latest"), F.sum("open").alias("open"))


@query(
    "open_interval_join",
    """
    WITH v AS (SELECT user_id, props, ts AS a, LEAD(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b
      FROM events WHERE event_type = 'signup')
    SELECT e.event_id, v.props AS plan FROM events e JOIN v ON v.user_id = e.user_id AND v.a <= e.ts
      AND (e.ts < v.b OR v.b IS NULL) WHERE e.event_type = 'error'
    """,
)
def open_interval_join(t):
    plans = with_next(by_type(t, "signup"), ["user_id"], ["ts", "event_id"], {"until": "ts"}).withColumnRenamed("ts", "since")
    errors = by_type(t, "error").select("event_id", "user_id", "ts")
    return version_join(
        errors, plans, ["user_id"], "ts", "since", "until", {"plan": "props"}, end_inclusive=False, how="inner"
    ).select("event_id", "plan")


def _asof_sql(op: str, direction: str) -> str:
    return f"""
    SELECT o_orderkey, l_shipdate AS ship_date, l_linenumber AS line, l_partkey AS part FROM orders LEFT JOIN (
      SELECT * FROM (SELECT l.*, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY {direction}) AS rn
        FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey AND l.l_shipdate {op} o.o_orderdate)
          WHERE rn = 1) m ON m.l_orderkey = o_orderkey
    """


def _order_asof(t, direction: str):
    lines = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    return asof(
        t.orders.select("o_orderkey", "o_orderdate"),
        lines,
        ["o_orderkey"],
        "o_orderdate",
        "l_shipdate",
        {"ship_date": "l_shipdate", "line": "l_linenumber", "part": "l_partkey"},
        direction=direction,
        ties=LINE_ORDER[1:],
    ).drop("o_orderdate")


@query("asof_backward", _asof_sql("<", LINE_DESC))
def asof_backward(t):
    return _order_asof(t, "backward")


@query("asof_forward", _asof_sql(">", LINE_SQL))
def asof_forward(t):
    return _order_asof(t, "forward")


@query(
    "prev_event",
    """
    SELECT event_id, LAG(event_type) OVER w AS prev_type, LAG(ts) OVER w AS prev_ts FROM events
    WINDOW w AS (PARTITION BY user_id, CAST(json_extract_string(props, '$.k') AS INT) % 3 ORDER BY ts, event_id)
    """,
)
def prev_event(t):
    log = t.events.withColumn("item", F.get_json_object("props", "$.k").cast("int") % 3)
    return with_prev(
        log, ["user_id", "item"], ["ts", "event_id"], {"prev_type": "event_type", "prev_ts": "ts"}
    ).select("event_id", "prev_type", "prev_ts")


@query(
    "first_event",
    f"""
    SELECT o_orderkey, l_shipdate AS first_ship, l_linenumber AS line, l_partkey AS part FROM orders
      JOIN (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY {LINE_SQL}) AS rn
      FROM lineitem WHERE l_returnflag = 'R') f ON l_orderkey = o_orderkey AND rn = 1
    """,
)
def first_event_query(t):
    first = first_event(t.lineitem, ["l_orderkey"], LINE_ORDER, F.col("l_returnflag") == "R")
    return t.orders.join(first, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "o_orderkey", F.col("l_shipdate").alias("first_ship"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part")
    )


@query(
    "last_event",
    f"""
    SELECT o_orderkey, l_shipdate AS last_ship, l_linenumber AS line, l_partkey AS part FROM orders LEFT
      JOIN (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY {LINE_DESC}) AS rn
      FROM lineitem) f ON l_orderkey = o_orderkey AND rn = 1
    """,
)
def last_event_query(t):
    last = last_event(t.lineitem, ["l_orderkey"], LINE_ORDER)
    return t.orders.join(last, F.col("l_orderkey") == F.col("o_orderkey"), "left").select(
        "o_orderkey", F.col("l_shipdate").alias("last_ship"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part")
    )


@query(
    "apply_minmax",
    """
    SELECT o_orderkey, first_ship, last_ship FROM orders JOIN (SELECT l_orderkey, MIN(l_shipdate) AS first_ship,
      MAX(l_shipdate) AS last_ship FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) ON l_orderkey = o_orderkey
    """,
)
def apply_minmax(t):
    shipped = t.lineitem.filter("l_linestatus = 'F'")
    aggs = [F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship")]
    return apply_agg(t.orders.select("o_orderkey"), shipped, {"o_orderkey": "l_orderkey"}, aggs, "inner")


COUNT_SQL = """
    SELECT o_orderkey, {n} AS returned FROM orders LEFT JOIN (SELECT l_orderkey, COUNT(*) AS n FROM lineitem
      WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey
    """


@query("apply_count_zero", COUNT_SQL.format(n="COALESCE(n, 0)"))
def apply_count_zero(t):
    counted = [F.count(F.lit(1)).alias("returned")]
    lines = t.lineitem.filter("l_returnflag = 'R'")
    return apply_agg(t.orders.select("o_orderkey"), lines, {"o_orderkey": "l_orderkey"}, counted, "left", ["returned"])


@query("apply_count_null", COUNT_SQL.format(n="n"))
def apply_count_null(t):
    counted = [F.count(F.lit(1)).alias("returned")]
    lines = t.lineitem.filter("l_returnflag = 'R'")
    return apply_agg(t.orders.select("o_orderkey"), lines, {"o_orderkey": "l_orderkey"}, counted, "left")


@query(
    "apply_rows",
    """
    SELECT o_orderkey, l_linenumber, l_partkey, l_shipdate FROM orders JOIN lineitem ON l_orderkey = o_orderkey
      AND l_shipdate > o_orderdate AND l_returnflag = 'A'
    """,
)
def apply_rows(t):
    lines = t.lineitem.filter("l_returnflag = 'A'")
    on = (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_shipdate") > F.col("o_orderdate"))
    return t.orders.join(lines, on).select("o_orderkey", "l_linenumber", "l_partkey", "l_shipdate")


@query(
    "semi_apply",
    """
    SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem
      WHERE l_returnflag = 'R' AND l_linestatus = 'O')
    """,
)
def semi_apply(t):
    lines = t.lineitem.filter("l_returnflag = 'R' AND l_linestatus = 'O'")
    return semi(t.orders, lines, {"o_orderkey": "l_orderkey"}).select("o_orderkey", "o_orderstatus")


@query(
    "exists_flag",
    """
    SELECT o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey
      AND l_quantity >= 49) THEN 1 ELSE 0 END AS has_large FROM orders
    """,
)
def exists_flag_query(t):
    large = t.lineitem.filter("l_quantity >= 49")
    return exists_flag(t.orders.select("o_orderkey"), large, {"o_orderkey": "l_orderkey"}, "has_large")


@query(
    "semi_exists",
    """
    SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem JOIN part ON p_partkey = l_partkey
      WHERE p_size >= 45 AND l_linestatus = 'F' AND l_orderkey = o_orderkey)
    """,
)
def semi_exists(t):
    lines = semi(t.lineitem.filter("l_linestatus = 'F'"), t.part.filter("p_size >= 45"), {"l_partkey": "p_partkey"})
    return semi(t.orders.select("o_orderkey"), lines, {"o_orderkey": "l_orderkey"})


@query(
    "anti_not_exists",
    """
    SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey
      AND o_orderpriority = '1-URGENT')
    """,
)
def anti_not_exists(t):
    urgent = t.orders.filter("o_orderpriority = '1-URGENT'")
    return anti(t.customer, urgent, {"c_custkey": "o_custkey"}).select("c_custkey", "c_name")


@query(
    "anti_left_null",
    """
    SELECT o_orderkey, o_orderdate FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey
      AND l_returnflag = 'R' WHERE l_orderkey IS NULL
    """,
)
def anti_left_null(t):
    returned = t.lineitem.filter("l_returnflag = 'R'")
    return anti(t.orders, returned, {"o_orderkey": "l_orderkey"}).select("o_orderkey", "o_orderdate")


@query(
    "in_subquery",
    """
    SELECT o_orderkey, COUNT(l_orderkey) AS matching FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey
      AND l_partkey IN (SELECT p_partkey FROM part WHERE p_name ILIKE '%red_w%' OR p_type ILIKE '%PROMO%') GROUP BY 1
    """,
)
def in_subquery(t):
    wanted = t.part.filter(F.col("p_name").ilike("%red_w%") | F.col("p_type").ilike("%PROMO%"))
    lines = semi(t.lineitem, wanted, {"l_partkey": "p_partkey"})
    counted = [F.count(F.lit(1)).alias("matching")]
    return apply_agg(t.orders.select("o_orderkey"), lines, {"o_orderkey": "l_orderkey"}, counted, "left", ["matching"])


@query(
    "computed_apply",
    """
    SELECT o_orderkey, hot FROM (SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH')
      AND o_totalprice > 300000 THEN 'hot'
      WHEN o_orderstatus = 'P' THEN 'warm' ELSE 'cold' END AS hot FROM orders) WHERE hot <> 'cold'
    """,
)
def computed_apply(t):
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_totalprice") > 300000)
    heat = F.when(urgent, "hot").when(F.col("o_orderstatus") == "P", "warm").otherwise("cold")
    return t.orders.withColumn("hot", heat).filter("hot <> 'cold'").select("o_orderkey", "hot")


@query(
    "adjacent_rows",
    """
    WITH n AS (SELECT user_id, event_id, event_type, ts, ROW_NUMBER() OVER (PARTITION BY user_id
      ORDER BY ts, event_id) AS rn FROM events)
    SELECT a.event_id, a.event_type AS state, b.event_type AS next_state,
      date_diff('second', a.ts, b.ts) AS seconds FROM n a LEFT JOIN n b ON b.user_id = a.user_id AND b.rn - 1 = a.rn
    """,
)
def adjacent_rows(t):
    stepped = with_next(t.events, ["user_id"], ["ts", "event_id"], {"next_state": "event_type", "next_ts": "ts"})
    return stepped.select(
        "event_id", F.col("event_type").alias("state"), "next_state", datediff_boundary("SECOND", "ts", "next_ts").alias("seconds")
    )


FUZZY_SQL = """
    WITH staff AS (SELECT c_custkey AS worker, c_mktsegment AS first_name, c_name AS last_name,
      lpad(CAST(c_custkey AS VARCHAR), 5, '0') AS ext, CASE WHEN c_custkey % 3 = 0 THEN 'Nick' || c_custkey % 10 END AS preferred_first,
      CASE WHEN c_custkey % 4 < 2 THEN 'Vander' || c_custkey END AS preferred_last
      FROM customer),
    entries AS (SELECT event_id AS entry_id, CAST(json_extract_string(props, '$.k') AS INT) % 5 AS loan, ts,
      CASE WHEN event_id % 4 = 1 THEN COALESCE(preferred_first, first_name) ELSE first_name END || ' ' ||
      CASE WHEN event_id % 5 = 2 AND preferred_last IS NOT NULL THEN left(preferred_last, length(preferred_last) - CAST(event_id % 3 AS INT))
        ELSE left(last_name, length(last_name) - CAST(event_id % 3 AS INT)) END || ' - ' || ext AS user_text
      FROM events JOIN staff ON worker = user_id WHERE event_type = 'error'),
    parsed AS (SELECT *, trim(split_part(user_text, ' ', 1)) AS f, trim(regexp_extract(user_text,
      '^\\S+\\s+(.*?)\\s*-[^-]*$', 1)) AS l, trim(regexp_extract(user_text, '-([^-]*)$', 1)) AS x
      FROM entries),
    who AS (SELECT entry_id, loan, ts, worker FROM parsed JOIN staff ON staff.ext = x
      AND (staff.first_name = f OR COALESCE(preferred_first, '') = f) AND (contains(staff.last_name, l) OR contains(COALESCE(preferred_last, ''), l))),
    clears AS (SELECT event_id AS clear_id, CAST(json_extract_string(props, '$.k') AS INT) % 5 AS loan,
      user_id AS worker, ts
      FROM events WHERE event_type = 'purchase')
    """


@query(
    "fuzzy_match",
    FUZZY_SQL
    + """
    SELECT entry_id, worker, clear_id FROM (SELECT w.entry_id, w.worker, c.clear_id, ROW_NUMBER()
      OVER (PARTITION BY w.entry_id ORDER BY c.ts DESC, c.clear_id DESC) AS rn
      FROM who w JOIN clears c ON c.loan = w.loan AND c.worker = w.worker
        AND CAST(c.ts AS DATE) = CAST(w.ts AS DATE) AND c.ts <= w.ts) WHERE rn = 1
    """,
)
def fuzzy_match(t):
    return nearest_clearance(resolve_people(typed_entries(t), staff_list(t)), clearances(t)).select(
        "entry_id", "worker", "clear_id"
    )


def staff_list(t):
    return t.customer.select(
        F.col("c_custkey").alias("worker"),
        F.col("c_mktsegment").alias("first_name"),
        F.col("c_name").alias("last_name"),
        F.lpad(F.col("c_custkey").cast("string"), 5, "0").alias("ext"),
        F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("Nick"), F.col("c_custkey") % 10)).alias("preferred_first"),
        F.when(F.col("c_custkey") % 4 < 2, F.concat(F.lit("Vander"), "c_custkey")).alias("preferred_last"),
    )


def typed_entries(t):
    """Entries under the name or a preferred one, the last name cut short at times."""
    event = F.col("event_id")
    first = F.when(event % 4 == 1, F.coalesce("preferred_first", "first_name")).otherwise(F.col("first_name"))
    last = F.when(event % 5 == 2, F.coalesce("preferred_last", "last_name")).otherwise(F.col("last_name"))
    text = F.concat_ws("", first, F.lit(" "), F.left(last, (F.length(last) - event % 3).cast("int")), F.lit(" - "), "ext")
    return by_type(t, "error").join(staff_list(t), F.col("worker") == F.col("user_id")).select(
        F.col("event_id").alias("entry_id"),
        (F.get_json_object("props", "$.k").cast("int") % 5).alias("loan"),
        "ts",
        text.alias("user_text"),
    )


def clearances(t):
    return by_type(t, "purchase").select(
        F.col("event_id").alias("clear_id"),
        (F.get_json_object("props", "$.k").cast("int") % 5).alias("loan"),
        F.col("user_id").alias("worker"),
        "ts",
    )


@query(
    "exclusive_left",
    """
    WITH f AS (SELECT user_id, MIN(ts) AS first_error FROM events WHERE event_type='error' AND value > 50 GROUP BY 1),
    s AS (SELECT user_id, MIN(ts) AS first_signup FROM events WHERE event_type='signup' GROUP BY 1)
    SELECT COUNT(*) AS calls, COUNT(f.user_id) AS escalated, COUNT(s.user_id) AS signed_up, COUNT(CASE
      WHEN f.user_id IS NULL AND s.user_id IS NULL THEN 1 END) AS offline, CAST(e.ts AS DATE) AS day
    FROM events e LEFT JOIN f ON f.user_id = e.user_id AND f.first_error <= e.ts LEFT JOIN s
      ON s.user_id = e.user_id AND s.first_signup <= e.ts AND f.user_id IS NULL
    WHERE e.event_type = 'purchase' GROUP BY CAST(e.ts AS DATE)
    """,
)
def exclusive_left(t):
    marks = t.events.groupBy("user_id").agg(
        F.min(F.when((F.col("event_type") == "error") & (F.col("value") > 50), F.col("ts"))).alias("first_error"),
        F.min(F.when(F.col("event_type") == "signup", F.col("ts"))).alias("first_signup"),
    )
    calls = by_type(t, "purchase").select("user_id", "ts").join(marks, "user_id", "left")
    escalated = F.coalesce(F.col("first_error") <= F.col("ts"), F.lit(False))
    signed_up = ~escalated & F.coalesce(F.col("first_signup") <= F.col("ts"), F.lit(False))
    return calls.groupBy(F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("calls"),
        count_if(escalated).alias("escalated"),
        count_if(signed_up).alias("signed_up"),
        count_if(~escalated & ~signed_up).alias("offline"),
    )


@query(
    "join_agg",
    """
    SELECT c_custkey, c_name, orders, amount FROM customer JOIN (SELECT o_custkey, COUNT(*) AS orders,
      CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM orders GROUP BY 1)
      ON o_custkey = c_custkey
    """,
)
def join_agg(t):
    aggs = [F.count(F.lit(1)).alias("orders"), money_sum("o_totalprice").alias("amount")]
    return apply_agg(t.customer.select("c_custkey", "c_name"), t.orders, {"c_custkey": "o_custkey"}, aggs, "inner")


@query(
    "share_of_total",
    """
    WITH v AS (SELECT CAST(ts AS DATE) AS day, CAST(hour(ts)*2 + minute(ts)//30 AS INT) AS slot,
      COUNT(*) AS calls FROM events GROUP BY 1, 2)
    SELECT day, slot, calls, CAST(calls AS DOUBLE) / SUM(calls) OVER (PARTITION BY day) AS share FROM v
    """,
)
def share_of_total(t):
    return volume_by_half_hour(t.events, "ts")


@query(
    "chained_apply",
    f"""
    WITH a AS (SELECT l_orderkey, MAX(l_shipdate) AS approved FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1),
    b AS (SELECT a.l_orderkey, approved, MIN(l.l_shipdate) AS returned_after FROM a LEFT JOIN lineitem l
      ON l.l_orderkey = a.l_orderkey AND l.l_returnflag = 'R' AND l.l_shipdate > approved GROUP BY 1, 2)
    SELECT o_orderkey, approved, returned_after FROM orders JOIN b ON l_orderkey = o_orderkey
    """,
)
def chained_apply(t):
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag", "l_shipdate")
    approved = lines.filter("l_returnflag = 'A'").groupBy("o_orderkey").agg(F.max("l_shipdate").alias("approved"))
    later = (
        spread_join(lines.filter("l_returnflag = 'R'"), approved, ["o_orderkey"])
        .filter("l_shipdate > approved")
        .groupBy("o_orderkey")
        .agg(F.min("l_shipdate").alias("returned_after"))
    )
    return t.orders.select("o_orderkey").join(approved, "o_orderkey").join(later, "o_orderkey", "left")


SNAPSHOT_SQL = """
    snap AS (SELECT user_id, snapshot_id, event_id, event_type AS state
      FROM (SELECT *, year(ts)*10000+month(ts)*100+day(ts) AS snapshot_id,
      ROW_NUMBER() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS rn
        FROM events) WHERE rn = 1)
    """


@query(
    "state_on_date",
    f"""
    WITH {SNAPSHOT_SQL} SELECT c_custkey, state FROM customer LEFT JOIN snap ON user_id = c_custkey
      AND snapshot_id = 20240115
    """,
)
def state_on_date(t):
    on_day = state_on(daily_snapshot(t.events, only_id=20240115), "snapshot_id", 20240115)
    return t.customer.join(on_day, F.col("user_id") == F.col("c_custkey"), "left").select("c_custkey", "state")


def snapshot_store(t) -> SnapshotStore:
    """The daily snapshot of the events as a stored table, built once for a state of the events."""

    def of(day_id: int | None):
        return daily_snapshot(t.events, only_id=day_id)

    path = t.stages.place("snapshot", [t.events], lambda to: SnapshotStore(t.spark, to, of).rebuild())
    return SnapshotStore(t.spark, f"{path}/data", of)


@query(
    "snapshot_mondays",
    f"""
    WITH {SNAPSHOT_SQL} SELECT snapshot_id, state, COUNT(*) AS users FROM snap
      WHERE dayofweek(strptime(CAST(snapshot_id AS VARCHAR), '%Y%m%d')) = 1 GROUP BY 1, 2
    """,
)
def snapshot_mondays(t):
    mondays = calendar(days_of(t.events, "ts")).filter("day_name = 'Monday'")
    return snapshot_store(t).on(mondays, "date_id").groupBy("snapshot_id", "state").agg(F.count(F.lit(1)).alias("users"))


@query(
    "snapshot_join",
    f"""
    WITH {SNAPSHOT_SQL} SELECT snap.snapshot_id, e.event_type AS state, COUNT(*) AS users,
      CAST(SUM(CAST(e.value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM snap JOIN events e
      ON e.event_id = snap.event_id GROUP BY 1, 2
    """,
)
def snapshot_join(t):
    rows = daily_snapshot(t.events).select("event_id", "snapshot_id")
    return (
        rows.join(t.events, "event_id")
        .groupBy("snapshot_id", F.col("event_type").alias("state"))
        .agg(F.count(F.lit(1)).alias("users"), money_sum("value").alias("total"))
    )
