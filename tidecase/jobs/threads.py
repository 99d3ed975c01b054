"""Message threads: first-response time, who started a conversation, opt-ins with their leaders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecase.functions.text import duration_label
from tidecase.operators.events import asof, top_n
from tidecase.operators.joins import semi
from tidecase.operators.shapes import union_padded
from tidecase.operators.slices import ROWS_PER_TASK, hot_keys, numbered


def response_times(posts: DataFrame, replies: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Each reply with the last client post before it in the same thread and a readable delay.

    ``posts`` and ``replies``: thread, ts, post_id.
    """
    matched = asof(
        replies, posts, ["thread"], "ts", "ts", {"client_post": "ts", "client_post_id": "post_id"},
        ties=["post_id"], rows_per_task=rows_per_task,
    )
    return matched.select(
        *matched.columns,
        F.when(F.col("client_post").isNull(), "Team post").otherwise("Client").alias("who_posted"),
        duration_label("client_post", "ts").alias("delay"),
    )


def attribute_messages(
    replied: DataFrame, received: DataFrame, sent: DataFrame, routed: DataFrame, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Label messages 'initiated', 'replied' or 'received'.

    Replies count when a sent record exists for them, received ones when they were routed. The first message of a
    loan (or of the client where there is none) that is a reply started the conversation.

    ``replied``: message_id, client, loan, ts, worker, sent_key; ``received``: message_id, client, loan, ts.
    """
    outgoing = semi(replied, sent, ["sent_key"]).drop("sent_key").withColumn("action", F.lit("replied"))
    incoming = semi(received, routed, ["message_id"]).withColumn("action", F.lit("received"))
    thread = F.coalesce("loan", "client").alias("_thread")
    every = replied.select(thread, "ts", "message_id").unionByName(received.select(thread, "ts", "message_id"))
    hot = hot_keys(every, ["_thread"], ["ts"], rows_per_task)
    base = union_padded(outgoing, incoming).withColumn("_thread", thread)
    ranked = numbered(base, ["_thread"], ["ts"], "_rank", ties=True, rows_per_task=rows_per_task, hot=hot)
    started = (F.col("action") == "replied") & (F.col("_rank") == 1)
    return ranked.withColumn("action", F.when(started, "initiated").otherwise(F.col("action"))).drop("_thread", "_rank")


def leader_chain(staff: DataFrame, titles: list[str]) -> DataFrame:
    """Add one column per title by walking ``leader`` upwards. ``staff``: id, name, leader.

    Only people who lead someone can match, so the lookup side stays small.
    """
    leaders = semi(staff, staff, {"id": "leader"})
    chain = staff.withColumn("_next", F.col("leader"))
    for title in titles:
        step = leaders.select(
            F.col("id").alias("_id"), F.col("name").alias(title), F.col("leader").alias("_up")
        )
        chain = chain.join(step, F.col("_id") == F.col("_next"), "left").withColumn("_next", F.col("_up")).drop("_id", "_up")
    return chain.select("id", "name", *titles)


def first_opt_in(messages: DataFrame, opted_in: DataFrame, chain: DataFrame) -> DataFrame:
    """The earliest opted-in message per client and day, with the worker's leaders (workers outside the chain drop out)."""
    wanted = semi(messages, opted_in, ["message_id"]).withColumn("day", F.to_date("ts"))
    first = top_n(wanted, ["client", "day"], [F.col("ts"), F.col("message_id")], 1).drop("_rn")
    return first.join(chain, F.col("id") == F.col("worker")).drop("id")
