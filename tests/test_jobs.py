"""Jobs on real rows with forced slicing against the plain path, and on hand-made edge cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidecase.functions.timeid import at_midnight
from tidecase.jobs import billing, cohort, dwell, eventlog, history, matching, people, pipeline, process, reasons, scorecard, threads, turntime
from tidecase.operators.slices import hot_keys
from tidecase.sources.derived import daily_versions
from tidecase.sources.tables import Tables

AS_OF = "2024-02-01 00:00:00"
T0 = dt.datetime(2024, 1, 1)
LOG = "case_id long, ts timestamp_ntz, event_id long, status string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def events(spark, data):
    """Events with a third of the rows moved to one user."""
    e = Tables(spark, data).events
    return e.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("user_id")))


@pytest.fixture(scope="module")
def log(events):
    return events.select(
        F.col("user_id").alias("case_id"), "ts", "event_id", F.col("event_type").alias("status"), "value"
    ).cache()


def kind(log, *names):
    return log.filter(F.col("status").isin(*names))


def test_one_key_is_hot(log):
    assert [r["_hot0"] for r in hot_keys(log, ["case_id"], ["ts"], 200).table.collect()] == [0]


def jobs(log, limit):
    posts = log.select(F.col("case_id").alias("thread"), "ts", F.col("event_id").alias("post_id"), "status")
    agents = log.select(F.col("case_id").alias("agent"), "ts", "event_id", "status")
    cases = kind(log, "purchase").groupBy("case_id").agg(F.min("ts").alias("bought"))
    message = [F.col("event_id").alias("message_id"), F.col("case_id").alias("client"), "ts"]
    loan = F.when(F.col("value") > 50, F.col("case_id") + 1000).alias("loan")
    replied = kind(log, "click").select(*message, loan, F.col("case_id").alias("worker"), F.col("case_id").alias("sent_key"))
    received = kind(log, "view").select(*message, loan)
    return {
        "responses": threads.response_times(
            posts.filter("status = 'click'").drop("status"), posts.filter("status = 'purchase'").drop("status"), limit
        ),
        "messages": threads.attribute_messages(
            replied, received, kind(log, "error").select(F.col("case_id").alias("sent_key")), received.select("message_id"), limit
        ),
        "state": history.state_at_event(kind(log, "purchase").select("case_id", "ts"), kind(log, "view", "error"), limit),
        "increase": history.increase_after(kind(log, "view").select("case_id", "ts"), kind(log, "purchase"), limit),
        "prior": history.prior_match(
            log.select("status", "ts", F.col("event_id").alias("case_id")),
            log.filter("value > 20").select("status", "ts", F.col("event_id").alias("case_id")), ["status"], limit,
        ),
        "reopened": history.reopened_aging(log, "view", ["error", "click"], at_midnight(AS_OF), limit),
        "followup": history.missing_followup(
            cases.select("case_id", F.col("bought").alias("opened"), F.lit(None).cast("timestamp_ntz").alias("taken_up"), at_midnight(AS_OF).alias("closed_at")),
            kind(log, "error").filter("value > 1e9").select("case_id"), log.select("case_id", "ts", "status", F.col("event_id").alias("tie")), 1, limit,
        ),
        "visits": dwell.visits_to_state(log, cases, "error", "bought", at_midnight(AS_OF), limit),
        "presence": dwell.presence_time(agents, "error", "click", limit),
        "versions": daily_versions(log, ["case_id"], ["ts", "event_id"], "status", limit),
        "log": eventlog.assemble([kind(log, "view"), kind(log, "error"), kind(log, "view")], limit),
        "turn": turntime.turn_times(
            cases, log, "case_id", "bought", "ts", {"viewed": F.col("status") == "view"},
            hot_keys(log.select("case_id", "ts", "event_id"), ["case_id"], ["ts"], limit),
        ),
    }


def test_sliced_jobs_equal_plain_jobs(log):
    plain, sliced = jobs(log, 10**7), jobs(log, 40)
    for name in plain:
        assert rows(plain[name]) == rows(sliced[name]), name
        assert plain[name].count() > 0


def test_process_entry_buckets(spark):
    hour = dt.timedelta(hours=1)
    log = spark.createDataFrame(
        [
            (1, T0, 1, "scrub"), (1, T0 + hour, 2, "hold"), (1, T0 + 2 * hour, 3, "help"),
            (2, T0, 4, "hold"), (2, T0 + hour, 5, "exit"),
            (3, T0, 6, "help"),
            (4, T0, 7, "hold"), (4, T0 + hour, 8, "help"),
            (5, T0, 9, "scrub"), (5, T0 - 24 * hour, 10, "exit"),
        ],
        LOG,
    )
    marks = [F.col("status") == s for s in ("scrub", "hold", "help", "exit")]
    got = {r["case_id"]: r for r in process.process_entry(log, *marks, at_midnight("2024-01-04 00:00:00")).collect()}
    assert set(got) == {1, 2, 4, 5}
    assert (got[1]["entry_event"], got[1]["sub_bucket"], got[1]["days_in_process"]) == ("scrub", "hold then help", 3)
    assert (got[2]["entry_event"], got[2]["sub_bucket"], got[2]["days_in_process"]) == ("hold", "hold only", 0)
    assert got[4]["sub_bucket"] == ""
    assert (got[5]["sub_bucket"], got[5]["days_in_process"]) == ("neither", 3)


def test_event_log_drops_repeats_and_numbers_by_time(spark):
    a = spark.createDataFrame([(1, "x", T0), (1, "x", T0)], "case_id int, status string, ts timestamp_ntz")
    b = spark.createDataFrame([(1, "a", T0), (2, "b", T0)], "case_id int, status string, ts timestamp_ntz")
    log = eventlog.assemble([a, b, a])
    assert rows(log) == [(1, "a", T0, 1), (1, "x", T0, 2), (2, "b", T0, 1)]
    assert rows(eventlog.funnel(log)) == [("a", 1, 1, 1), ("b", 1, 1, 1), ("x", 1, 1, 0)]


def test_scorecard_keeps_workers_of_one_side_and_counts_unmapped(spark):
    schema = "worker string, units decimal(9,2)"
    from decimal import Decimal as D

    statuses = spark.createDataFrame([("a", D("1.75")), ("a", None)], schema)
    closings = spark.createDataFrame([("b", D("2"))], schema)
    assert rows(scorecard.unit_scorecard(statuses, closings, "worker")) == [
        ("a", 2, 1.75, 0, 0.0, 1.3125, 1), ("b", 0, 0.0, 1, 2.0, 0.5, 0),
    ]
    key = spark.createDataFrame([("0PurchaseFHA",), ("zz",)], "k string")
    got = key.select(scorecard.weight(F.col("k"), [("0Purchase%", 1.5), ("%", None)]))
    assert [r[0] for r in got.collect()] == [1.5, None]


def test_bridge_fan_out_counts_each_event_once(spark):
    events = spark.createDataFrame([(1, T0, 7), (1, T0, 8)], "case_id int, ts timestamp_ntz, group_id int")
    bridge = spark.createDataFrame([(7, "r"), (7, "r"), (7, "s"), (8, "r")], "group_id int, reason string")
    assert rows(reasons.repeat_reasons(events, bridge, 2)) == [(1, "r", 2, T0, T0)]


def test_reconcile_reports_unknown_states(spark):
    charges = spark.createDataFrame([(1, "Closed", 16.5), (2, "Closed", 8.0), (2, "Closed", 8.0), (3, None, 1.0)], "c int, s string, a double")
    rule = (F.col("s") == "Closed") & (F.col("total") == 16.5)
    assert rows(billing.unexpected_totals(charges, ["c", "s"], "a", rule)) == [(2, "Closed", 16.0), (3, None, 1.0)]


def test_first_in_role_only_for_current_holders(spark):
    versions = spark.createDataFrame(
        [("a", "uw", 20240101, 20240131), ("a", "uw", 20240301, 21991231), ("b", "uw", 20240101, 20240131)],
        "worker string, role string, start_id int, end_id int",
    )
    assert rows(people.first_in_role(versions, "uw", 21991231)) == [("a", 20240101)]


def test_speed_report_labels_total(spark):
    wide = spark.createDataFrame(
        [("p", "2024-01-03", 10.0, T0, 3600), ("p", None, 20.0, None, None)],
        "pilot string, week_of string, amount double, view timestamp_ntz, view_seconds long",
    )
    got = rows(cohort.speed_report(wide, ["view"]))
    assert got == [
        ("p", "2024-01-03", 1, 10.0, 1.0, 1.0), ("p", "Total", 2, 15.0, 0.5, 1.0), ("p", "Unknown", 1, 20.0, 0.0, None),
    ]


def test_scorecard_keeps_cases_without_a_worker_apart(spark):
    statuses = spark.createDataFrame([(None, 1), (0, 2), (5, None)], "worker long, units long").withColumn("units", F.col("units").cast("decimal(9,2)"))
    closings = spark.createDataFrame([(None, 4), (7, 8)], "worker long, units long").withColumn("units", F.col("units").cast("decimal(9,2)"))
    out = {r["worker"]: r for r in scorecard.unit_scorecard(statuses, closings, "worker").collect()}
    assert set(out) == {None, 0, 5, 7} and len(out) == 4
    assert out[None]["total"] == 0.75 * 1 + 0.25 * 4 and out[0]["total"] == 1.5 and out[5]["unmapped"] == 1


def test_people_by_preferred_names_and_not_by_blank_ones(spark):
    staff = spark.createDataFrame(
        [(1, "Robert", "Smithers", "12", "Bob", None), (2, "Ann", "Lee", "12", None, "Leeds")],
        "worker int, first_name string, last_name string, ext string, preferred_first string, preferred_last string",
    )
    typed = ["Robert Smith - 12", "bob SMITHERS - 12", "Ann Leeds - 12", "Ann - 12", "Bob Lee - 12", "Ann Lee - 13"]
    entries = spark.createDataFrame([(t,) for t in typed], "user_text string")
    found = rows(matching.resolve_people(entries, staff))
    assert found == sorted([("Robert Smith - 12", 1), ("bob SMITHERS - 12", 1), ("Ann Leeds - 12", 2)], key=str)
    plain = staff.drop("preferred_first", "preferred_last")
    assert rows(matching.resolve_people(entries, plain)) == [("Robert Smith - 12", 1)]


def test_pipeline_window_opens_with_what_was_there(spark):
    versions = spark.createDataFrame(
        [("a", 20240101, 20240103), ("a", 20240102, None), ("a", 20240106, 20240107), ("b", 20240120, None)], "state string, start_id int, end_id int"
    )
    out = pipeline.pipeline_size(versions, F.lit(dt.date(2024, 1, 3)), F.lit(dt.date(2024, 1, 8)))
    assert [r["cases"] for r in sorted(out.filter("state = 'a'").collect(), key=lambda r: r["day"])] == [2, 1, 1, 2, 2, 1]
    assert {r["cases"] for r in out.filter("state = 'b'").collect()} == {0}
