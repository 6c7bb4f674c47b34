"""The three jobs: assess calls, keep the participant index, answer chats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.config import Names
from turnwise.functions.models import ModelFactory
from turnwise.functions.nested import flatten
from turnwise.operators.assess import assess_prompts, explode_participants, merge_parts
from turnwise.operators.chat import answer_chats
from turnwise.operators.distribution import stored
from turnwise.operators.index import Index, create_or_sync, open_index
from turnwise.operators.transcript import (
    PART_LINES,
    assessment_template,
    build_prompt,
    label_speakers,
    transcript_text,
)
from turnwise.schemas import EMBEDDED
from turnwise.sources.tables import replace_table, scan, stream_table
from turnwise.streaming.embedding import embed_stream, participant_content, read_vectors, sync_vectors

CALL_COLUMNS = ["conversation_id", "title", "event_start_date", "event_end_date"]


def prompts_of_calls(labelled: DataFrame, marker: str, width: int = PART_LINES) -> DataFrame:
    """A prompt per part of ``width`` lines of a call; a call without lines has one, of no lines."""
    lines = F.col("sentences_updated")
    starts = F.sequence(F.lit(0), F.greatest(F.size(lines) - 1, F.lit(0)), F.lit(width))
    parts = F.transform(starts, lambda at: F.slice(lines, at + 1, F.lit(width)))
    return labelled.select(
        F.col("`conversation.id`").alias("conversation_id"),
        F.col("`conversation.title`").alias("title"),
        F.col("`conversation.event_start_date`").alias("event_start_date"),
        F.col("`conversation.event_end_date`").alias("event_end_date"),
        F.posexplode(F.coalesce(parts, F.array(lines))).alias("part", "part_lines"),
    ).select(
        *CALL_COLUMNS,
        F.col("part").cast("long").alias("part"),
        build_prompt(transcript_text(F.col("part_lines")), assessment_template(marker)).alias("prompt"),
    )


def assess_calls(
    calls: DataFrame, names: Names, marker: str, model: ModelFactory, answers: str, **options
) -> DataFrame:
    """Call documents to the tables of labelled calls, assessments and participants.

    Calls of more than ``PART_LINES`` lines are assessed in parts, and the parts' answers merged by ``merge_parts``.
    Returns the quarantine: calls without a usable answer, with what was wrong.
    """
    spark = calls.sparkSession
    replace_table(label_speakers(flatten(calls)), names.table("labelled_calls"))
    prompts = prompts_of_calls(spark.table(names.table("labelled_calls")), marker)
    good, bad = assess_prompts(prompts, model, answers, **options)
    good = stored(good.select(*CALL_COLUMNS, "part", "participant_analysis"), "assessed-parts")
    several = stored(good.filter("part > 0").select(F.col("conversation_id").alias("_several")).distinct(), "calls-of-parts")
    is_long = F.col("conversation_id").eqNullSafe(F.col("_several"))
    people = explode_participants(good.join(several, is_long, "left_semi"), [*CALL_COLUMNS, "part"])
    merged = merge_parts(people, CALL_COLUMNS, model, f"{answers}/merged", **options)
    analysis = F.struct(F.collect_list("participant").alias("participants")).alias("participant_analysis")
    whole = good.join(several, is_long, "left_anti").drop("part")
    replace_table(whole.unionByName(merged.groupBy(*CALL_COLUMNS).agg(analysis)), names.table("call_assessments"))
    replace_table(
        explode_participants(scan(spark, names.table("call_assessments")), CALL_COLUMNS),
        names.table("participant_rows"),
    )
    return bad


def index_participants(
    spark: SparkSession, names: Names, folder: str, model: ModelFactory, dim: int
) -> Index:
    """Embed the participants that are new and bring the index to the table's present state.

    The participant table is replaced by each assessment; vectors of rows that it no longer has are
    taken out of the folder of vectors and so of the index.
    """
    vectors, checkpoint = f"{folder}/{names.participant_vectors}", f"{folder}/{names.checkpoint_folder}"
    present = participant_content(spark.table(names.table("participant_rows")))
    stream = participant_content(stream_table(spark, names.table("participant_rows")))
    key = ["conversation_id", "name", "content"]
    embed_stream(stream, vectors, checkpoint, model, key)
    sync_vectors(present, vectors, model, key)
    current = read_vectors(spark, vectors, EMBEDDED)
    index_folder = f"{folder}/{names.index_folder}"
    create_or_sync(current, index_folder, "id", "content", dim, vector="embedding")
    return open_index(spark, index_folder)


def answer(
    rows: DataFrame, names: Names, folder: str, embedder: ModelFactory, chat_model: ModelFactory, **options
) -> DataFrame:
    index = open_index(rows.sparkSession, f"{folder}/{names.index_folder}")
    return answer_chats(rows, index, embedder, chat_model, **options)
