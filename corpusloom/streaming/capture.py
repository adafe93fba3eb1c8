"""Streams that capture final messages and keep the latest body per title."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import markdown as md
from corpusloom.streaming.keyed import KeyedTable, run

HOOK = (
    "hookEventName string, hook_event_name string, lastAssistantMessage string, last_assistant_message string, text string, "
    "session_id string, turn_id string, conversation_id string, generation_id string, sessionId string, promptId string"
)
SOURCE_FIELDS = ("session_id", "turn_id", "conversation_id", "generation_id", "sessionId", "promptId")


def final_messages(events: DataFrame) -> DataFrame:
    """events(client, payload JSON, received) -> (client, text, source, received).

    Each client's own response event counts; anything else is not a final message.
    """
    e = F.from_json("payload", HOOK)
    native = e["hookEventName"].isNotNull()
    text = (
        F.when(F.col("client") == "grok", F.when(e["hookEventName"] == "stop", e["lastAssistantMessage"]))
        .when(native, F.lit(None))
        .when((F.col("client") == "cursor") & (e["hook_event_name"] == "afterAgentResponse"), e["text"])
        .when(F.col("client").isin("codex", "claude", "kimi") & (e["hook_event_name"] == "Stop"), e["last_assistant_message"])
    )
    fields = F.filter(F.array(*[F.struct(F.lit(n).alias("key"), e[n].alias("value")) for n in SOURCE_FIELDS]), lambda f: f["value"].isNotNull())
    source = F.map_concat(F.create_map(F.lit("client"), F.col("client")), F.map_from_entries(fields))
    return events.select("client", text.alias("text"), source.alias("source"), "received").where("text is not null")


def summaries(messages: DataFrame) -> DataFrame:
    """Messages worth keeping, with the title and identity their text gives them."""
    kept = messages.withColumn("text", md.summary_text(F.col("text"))).where("text is not null")
    titled = kept.withColumn("title", md.summary_title(F.col("text")))
    return titled.withColumn("slug", md.note_slug(F.col("title")))


def first_deliveries(rows: DataFrame, order: str = "received", key: str = "slug") -> DataFrame:
    """One row per key: of the earliest micro-batch, and in it the first by ``order``."""
    others = [c for c in rows.columns if c != key]
    first = F.min_by(F.struct(*others), F.struct("arrived", order)).alias("row")
    return rows.groupBy(key).agg(first).select(key, "row.*").select(*rows.columns)


def captured(spark: SparkSession, target: str, order: str = "received") -> KeyedTable:
    """The table of captured messages below ``target``."""
    return KeyedTable(spark, target, lambda rows: first_deliveries(rows, order))


def capture_stream(events: DataFrame, target: str, checkpoint: str, order: str = "received"):
    """Run the capture stream until the input is used up; returns the finished query.

    Insert-if-absent by state: the first delivery of a message keeps its provenance and
    time, replays change nothing, and no batch reads what earlier ones stored. Within a
    micro-batch the time of arrival is one value.
    """
    rows = summaries(events).withColumn("arrived", F.current_timestamp())
    return run(rows, captured(events.sparkSession, target, order), checkpoint)


def latest_titles(captures: DataFrame, key: str = "title", order: str = "received", keep: tuple[str, ...] = ()) -> DataFrame:
    """Latest body per title. Fields in ``keep`` that a newer capture leaves out stay.

    Of captures received at the same time the one with the greatest body stays, whatever
    order they arrive in.
    """
    newest = F.struct(order, "body")
    latest = [F.max_by(c, newest).alias(c) for c in captures.columns if c not in (key, *keep)]
    retained = [F.max_by(c, F.when(F.col(c).isNotNull(), newest)).alias(c) for c in keep]
    return captures.groupBy(key).agg(*latest, *retained).select(*captures.columns)


def merge_titles(previous: DataFrame, batch: DataFrame, key: str = "title", order: str = "received", keep: tuple[str, ...] = ()) -> DataFrame:
    """Latest body per title. Fields in ``keep`` that a newer capture leaves out stay.

    Captures without a body are refused.
    """
    return latest_titles(previous.unionByName(with_body(batch)), key, order, keep)


def with_body(captures: DataFrame) -> DataFrame:
    return captures.where(F.btrim("body") != "")


def titles(spark: SparkSession, root: str, keep: tuple[str, ...] = ()) -> KeyedTable:
    """The table of the latest note per title below ``root``."""
    return KeyedTable(spark, root, lambda rows: latest_titles(rows, keep=keep))


def update_stream(captures: DataFrame, root: str, checkpoint: str, keep: tuple[str, ...] = ()):
    """Keep the latest note per title current until the input is used up."""
    return run(with_body(captures), titles(captures.sparkSession, root, keep), checkpoint)
