"""Inputs of the registered queries, derived by Spark from the given tables.

The given ``conversations`` rows hold turns but no calls. These functions give every role an
attendee entry, so that all cases of speaker labelling occur: an address, an empty or missing
address with a name, neither but a second entry, and nothing at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARKER = "acme"

# The same texts are valid in Spark SQL and in the checking engine.
SPEAKER_ID_SQL = "CAST(conv_id AS STRING) || '-' || role"
EMAIL_SQL = (
    "CASE WHEN conv_id % 3 = 0 THEN '' WHEN conv_id % 3 = 1 THEN NULL "
    "ELSE role || CAST(conv_id AS STRING) || "
    "CASE WHEN role = 'assistant' THEN '@acme.example' ELSE '@client.example' END END"
)
NAME_SQL = (
    "CASE WHEN conv_id % 4 = 0 THEN '' WHEN conv_id % 4 = 1 THEN NULL "
    "ELSE CASE WHEN role = 'assistant' THEN 'Acme Agent ' ELSE 'Client ' END "
    "|| CAST(conv_id AS STRING) END"
)
SECOND_NAME_SQL = (
    "CASE WHEN conv_id % 5 = 0 THEN NULL ELSE 'Second ' || role || ' ' || CAST(conv_id AS STRING) END"
)
HAS_ATTENDEE_SQL = "role <> 'system'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns_as_sentences(turns: DataFrame) -> DataFrame:
    """A turn as a sentence. A character takes a tenth of a second; turns start 100 seconds apart."""
    start = 100.0 * F.col("turn")
    return turns.select(
        F.col("conv_id").alias("conversation_id"),
        F.col("turn").alias("order_number"),
        F.expr(SPEAKER_ID_SQL).alias("recording_attendee_id"),
        start.alias("start_time"),
        (start + F.length("text") / 10.0).alias("end_time"),
        "text",
    )


def roles_as_attendees(turns: DataFrame) -> DataFrame:
    """Two entries with the same id for every role of a conversation but ``system``."""
    entries = F.expr(
        f"array(struct({EMAIL_SQL} AS email, {NAME_SQL} AS full_name),"
        f" struct(CAST(NULL AS STRING) AS email, {SECOND_NAME_SQL} AS full_name))"
    )
    return (
        turns.filter(HAS_ATTENDEE_SQL)
        .select("conv_id", "role")
        .distinct()
        .select(
            F.col("conv_id").alias("conversation_id"),
            F.expr(SPEAKER_ID_SQL).alias("attendee_id"),
            F.posexplode(entries).alias("position", "entry"),
        )
        .select("conversation_id", "attendee_id", "position", "entry.email", "entry.full_name")
    )


def turns_as_calls(turns: DataFrame) -> DataFrame:
    """A call document per conversation. A document is one value, as it is in a file of calls."""
    sentence = F.struct(
        F.col("turn").alias("order_number"),
        F.lit("transcription").alias("id"),
        (100.0 * F.col("turn")).alias("start_time"),
        (100.0 * F.col("turn") + F.length("text") / 10.0).alias("end_time"),
        F.expr(SPEAKER_ID_SQL).alias("recording_attendee_id"),
        F.col("text").alias("text"),
    )
    attendee = F.struct(
        F.expr(SPEAKER_ID_SQL).alias("id"),
        F.expr(EMAIL_SQL).alias("email"),
        F.expr(NAME_SQL).alias("full_name"),
        F.expr(SECOND_NAME_SQL).alias("second_name"),
    )
    grouped = turns.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(sentence)).alias("sentences"),
        F.sort_array(F.collect_set(F.when(F.expr(HAS_ATTENDEE_SQL), attendee))).alias("people"),
        F.sum(F.length("text") * 100).alias("duration"),
    )
    attendees = F.concat(
        F.transform("people", lambda p: F.struct(p["id"], p["email"], p["full_name"])),
        F.transform(
            "people",
            lambda p: F.struct(
                p["id"], F.lit(None).cast("string").alias("email"), p["second_name"].alias("full_name")
            ),
        ),
    )
    conv = F.col("conv_id").cast("string")
    head = [
        conv.alias("id"),
        F.col("duration"),
        F.concat(F.lit("Conversation "), conv).alias("title"),
        F.lit("en-US").alias("language_code"),
        F.lit("2024-01-01T00:00:00.000Z").alias("event_start_date"),
        F.lit("2024-01-01T01:00:00.000Z").alias("event_end_date"),
    ]
    return grouped.select(
        F.struct(*head).alias("conversation"),
        F.struct(
            F.struct(
                *head,
                attendees.alias("attendees"),
                F.array().cast("array<string>").alias("invitees"),
            ).alias("data")
        ).alias("extensiveConversation"),
        "sentences",
    )


def turns_as_moments(turns: DataFrame) -> DataFrame:
    """Call documents with key moments and action items made of turns.

    An item per role, a category for even and one for odd turns, and a mention per turn, which spans up to two more;
    assistants' categories have no mentions, but every assistant's turn is an action item. Conversations
    whose number ends in 7 have neither block, those in 8 key moments without items.
    """
    ends = F.col("turn") + F.col("conv_id") % 3
    mention = F.struct(
        F.expr(SPEAKER_ID_SQL).alias("recording_attendee_id"),
        F.col("turn").alias("index_start"),
        ends.alias("index_end"),
        (100.0 * F.col("turn")).alias("start_time"),
    )
    last = F.col("conv_id") % 10
    of_category = turns.groupBy("conv_id", "role", (F.col("turn") % 2).alias("category")).agg(
        F.sort_array(F.collect_list(F.when(F.col("role") != "assistant", F.struct("turn", mention.alias("m"))))).alias("m"),
    )
    of_category = of_category.select("conv_id", "role", "category", F.transform("m", lambda x: x["m"]).alias("mentions"))
    category = F.struct(
        F.col("category").cast("string").alias("category"),
        F.size("mentions").cast("long").alias("mentions_count"),
        F.lit(None).cast("string").alias("summary"),
        "mentions",
    )
    of_item = of_category.groupBy("conv_id", "role").agg(F.sort_array(F.collect_list(category)).alias("categories"))
    item = F.struct(F.col("role").alias("name"), "categories")
    moments = of_item.groupBy("conv_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    actions = turns.groupBy("conv_id").agg(
        F.sort_array(
            F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", F.col("turn").cast("string").alias("id"), F.col("text").alias("original_text"))))
        ).alias("actions")
    )
    nothing = F.array().cast(moments.schema["items"].dataType)
    held = moments.join(actions, "conv_id")
    return held.select(
        F.struct(F.col("conv_id").cast("string").alias("id")).alias("conversation"),
        F.struct(
            F.struct(
                F.when(last != 7, F.struct(F.when(last == 8, nothing).otherwise(F.col("items")).alias("items"))).alias("key_moments"),
                F.when(last != 7, F.struct(F.transform("actions", lambda a: F.struct(a["id"], a["original_text"])).alias("items"))).alias("action_items"),
            ).alias("data")
        ).alias("extensiveConversation"),
    )
