"""Reading call documents and chat messages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnwise.schemas import CALL


def read_calls(spark: SparkSession, folder: str, one_per_file: bool = True) -> DataFrame:
    """All ``*.json`` call documents of a folder.

    A pretty-printed document per file is read whole by one task. For large collections store one
    document per line and pass ``one_per_file=False``: such files can be split.
    """
    reader = spark.read.schema(CALL).option("pathGlobFilter", "*.json")
    return reader.option("multiLine", one_per_file).json(folder)


def read_inferred(spark: SparkSession, folder: str, one_per_file: bool = True) -> DataFrame:
    """All ``*.json`` documents of a folder with the columns that any of them has; null where a document lacks one.

    The schema is aggregated over all documents, each parsed once as a variant. Whole numbers become long, others
    double; a field that has values of several kinds, or only nulls, becomes text. Documents that are not JSON
    give a row of nulls.
    """
    reader = spark.read.option("pathGlobFilter", "*.json").option("wholetext", one_per_file)
    texts = reader.text(folder)
    found = texts.agg(F.schema_of_variant_agg(F.try_parse_json("value")).alias("found")).first()["found"]
    schema = T.StructType.fromDDL(f"document {declared_type(found)}")["document"].dataType
    if not isinstance(schema, T.StructType):
        raise ValueError(f"documents have no common fields: {found}")
    return texts.select(F.from_json("value", schema).alias("document")).select("document.*")


def declared_type(variant_type: str) -> str:
    """The column type for a variant's type."""
    for pattern, kind in ((r"\bOBJECT<", "STRUCT<"), (r"\bDECIMAL\(\d+,\s*\d+\)", "DOUBLE"), (r"\b(VOID|VARIANT)\b(?!:)", "STRING")):
        variant_type = re.sub(pattern, kind, variant_type)
    return variant_type


def parse_calls(df: DataFrame, text: Column) -> DataFrame:
    """The same documents where their JSON text is a column of a table."""
    return df.withColumn("call", F.from_json(text, CALL)).select("call.*")


def sentence_rows(calls: DataFrame) -> DataFrame:
    """One row per sentence. (conversation_id, order_number) is the key; ``id`` is not one."""
    return calls.select(
        F.col("conversation.id").alias("conversation_id"), F.explode("sentences").alias("s")
    ).select(
        "conversation_id",
        F.col("s.order_number").alias("order_number"),
        F.col("s.recording_attendee_id").alias("recording_attendee_id"),
        F.col("s.start_time").alias("start_time"),
        F.col("s.end_time").alias("end_time"),
        F.col("s.text").alias("text"),
    )


def attendee_rows(calls: DataFrame) -> DataFrame:
    """One row per attendee, with its place in the call's list."""
    return calls.select(
        F.col("conversation.id").alias("conversation_id"),
        F.posexplode("extensiveConversation.data.attendees").alias("position", "a"),
    ).select(
        "conversation_id",
        F.col("position").cast("long").alias("position"),
        F.col("a.id").alias("attendee_id"),
        F.col("a.email").alias("email"),
        F.col("a.full_name").alias("full_name"),
        F.col("a.is_internal").alias("is_internal"),
        F.col("a.talk_time").alias("stored_talk_time"),
        F.col("a.percent_talk_time").alias("stored_percent"),
    )
