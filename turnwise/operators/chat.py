"""Answering a table of chat conversations from an index.

Conversations come as rows (conv_id, turn, role, text), turn being a whole number unique in its
conversation, or as one ``messages`` array per request. Everything up to the finished prompt works
on rows, so a conversation of any length is spread over tasks. Only the call of a model needs a
conversation in one piece; it is put together from sorted rows by the task that calls.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from turnwise.config import work_folder
from turnwise.functions.models import ModelFactory, infer_conversations
from turnwise.functions.nested import all_but_last, fill_template, last_or_null
from turnwise.operators.assess import infer_once, store_answers, stored_answers, unanswered
from turnwise.operators.distribution import order_slices, spread_join, stored
from turnwise.operators.index import CONTENT, PK, Index
from turnwise.operators.search import (
    FUSION_DEPTH,
    QUERY,
    embed_queries,
    search_hybrid,
    search_keyword,
    search_vector,
    with_columns,
)

REWRITE_TEMPLATE = (
    "Turn the question below into one search query that finds texts related to it. Use the earlier "
    "messages to fill in what the question leaves out. Give the query only.\n\n"
    "Earlier messages: {chat_history}\n\nQuestion: {question}"
)
ANSWER_TEMPLATE = (
    "Answer the question from the passages below and from nothing else. If they do not hold the "
    "answer, say that you do not know. Come to the point at once.\n\n{context}\n"
    "Question: {question}"
)

# Passage format, retrieval depth, and the roles that a prompt repeats.
CHUNK_TEMPLATE = "Passage: {chunk_text}\n"
RETRIEVAL_DEPTH = 10
SPEAKER_OF_ROLE = {"user": "human", "assistant": "ai"}

SYSTEM_TURN = -1


@dataclass(frozen=True)
class RetrieverColumns:
    """Which index columns hold the text, the source and the name of a passage."""

    chunk_text: str = CONTENT
    document_uri: str = "conversation_id"
    name: str = "name"
    primary_key: str = PK


# --- requests as one array of (role, content) per row ---------------------------------------


def question_of(messages: Column) -> Column:
    """The content of the last message, whoever wrote it; null for an empty request."""
    return last_or_null(messages)["content"]


def history_of(messages: Column) -> Column:
    return all_but_last(messages)


def formatted_history_of(messages: Column) -> Column:
    """User and assistant messages before the last one; other roles are left out."""
    return F.filter(history_of(messages), lambda m: m["role"].isin(*SPEAKER_OF_ROLE))


def needs_rewrite(messages: Column) -> Column:
    """Whether anything precedes the question, also if it is only a system message."""
    return F.size(history_of(messages)) > 0


def prompt_of(messages: Column, context: Column, template: str = ANSWER_TEMPLATE) -> Column:
    """System message with context and question, the history, and the question again."""
    question = question_of(messages)
    system = fill_template(template, context=context, question=question)

    def message(role: str, content: Column) -> Column:
        return F.array(F.struct(F.lit(role).alias("role"), content.alias("content")))

    return F.concat(
        message("system", system), formatted_history_of(messages), message("user", question)
    )


# --- requests as rows -----------------------------------------------------------------------


def check_messages(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split off messages without conversation, turn, role or text, and those that share a turn.

    Good rows and the copies of bad rows add up to the rows given. Copies are counted before anything
    is joined, so no task sees a message as often as it occurs.
    """
    in_turn = rows.groupBy("conv_id", "turn").agg(
        F.count(F.lit(1)).alias("in_turn"), F.first("role").alias("role"), F.first("text").alias("text")
    )
    alone = F.col("in_turn") == 1
    for column in ("conv_id", "turn", "role", "text"):
        alone = alone & F.col(column).isNotNull()
    good = in_turn.filter(alone).select("conv_id", "turn", "role", "text")

    copies = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    shared = in_turn.filter(F.col("in_turn") > 1).select("conv_id", "turn", "in_turn")
    joined = spread_join(copies, shared, ["conv_id", "turn"], [F.col("role"), F.col("text")], how="left")
    problem = (
        F.when(F.col("conv_id").isNull(), "no conversation")
        .when(F.col("turn").isNull(), "no turn")
        .when(F.col("role").isNull(), "no role")
        .when(F.col("text").isNull(), "no text")
        .when(F.col("in_turn").isNotNull(), "turn is not unique")
    )
    bad = joined.withColumn("problem", problem).filter(F.col("problem").isNotNull())
    return good, bad.select("conv_id", "turn", "role", "text", "copies", "problem")


def last_questions(rows: DataFrame) -> DataFrame:
    """(conv_id, question, last_turn, n_turns) per conversation, by one partial aggregation."""
    return rows.groupBy("conv_id").agg(
        F.max_by("text", "turn").alias("question"),
        F.max("turn").alias("last_turn"),
        F.count(F.lit(1)).alias("n_turns"),
    )


def chat_history(rows: DataFrame, last: DataFrame | None = None) -> DataFrame:
    """All messages but the last of each conversation."""
    if last is None:
        last = rows.groupBy("conv_id").agg(F.max("turn").alias("last_turn"))
    ends = last.select("conv_id", F.col("last_turn").alias("turn"))
    return rows.join(ends, ["conv_id", "turn"], "left_anti")


def formatted_history(rows: DataFrame) -> DataFrame:
    """The history's user and assistant messages, with the speaker they stand for."""
    speaker = F.create_map(*[F.lit(x) for pair in SPEAKER_OF_ROLE.items() for x in pair])
    return (
        chat_history(rows)
        .filter(F.col("role").isin(*SPEAKER_OF_ROLE))
        .withColumn("speaker", speaker[F.col("role")])
    )


def rewrite_needed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("conv_id").agg((F.count(F.lit(1)) > 1).alias("needs_rewrite"))


def newest_turns(rows: DataFrame, n: int) -> DataFrame:
    """Only the newest ``n`` messages per conversation, for models with a short context."""
    window = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return rows.withColumn("_age", F.row_number().over(window)).filter(F.col("_age") <= n).drop("_age")


def turns_within(rows: DataFrame, budget: int, width: int = 1024) -> DataFrame:
    """The newest messages of each conversation whose texts together have at most ``budget`` characters.

    The column ``n_left_out`` counts the older ones; a conversation whose newest message is longer has no row.
    Lengths are added within slices of ``width`` turns and then over the slices, so a long conversation is
    spread over tasks. Rows without a turn count as the oldest.
    """
    cut = stored(rows.withColumn("_slice", order_slices(F.col("turn"), width)).withColumn("_size", F.coalesce(F.length("text"), F.lit(0))), "turns")
    newer = Window.partitionBy("conv_id").orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy("conv_id", "_slice").agg(F.sum("_size").alias("_sum"))
    after = sizes.select(F.col("conv_id").alias("_conv"), F.col("_slice").alias("_of"), F.coalesce(F.sum("_sum").over(newer), F.lit(0)).alias("_after"))
    within = Window.partitionBy("conv_id", "_slice").orderBy(F.col("turn").desc_nulls_last(), "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_slice") == F.col("_of"))
    used = F.sum("_size").over(within) + F.col("_after")
    summed = cut.join(after, same).withColumn("_used", used)
    out = summed.groupBy(F.col("conv_id").alias("_key")).agg(F.count_if(F.col("_used") > budget).alias("n_left_out"))
    kept = summed.filter(F.col("_used") <= budget).select(*rows.columns)
    return kept.join(out, F.col("conv_id").eqNullSafe(F.col("_key"))).drop("_key")


def rewrite_prompts(rows: DataFrame, template: str = REWRITE_TEMPLATE, tasks: int | None = None) -> DataFrame:
    """(conv_id, prompt) for conversations that have a history.

    Rows are dealt to ``tasks`` tasks by conversation and sorted there; a prompt is built while its rows
    are read, so a task holds one prompt and no conversation is left out for its length.
    """
    schema = T.StructType([rows.schema["conv_id"], T.StructField("prompt", T.StringType())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def built(conv_id: object, messages: list[str], question: str | None) -> pa.RecordBatch:
            filled = None
            if question is not None:
                values = {"{chat_history}": "[" + ",".join(messages) + "]", "{question}": question}
                pieces = re.split(r"(\{chat_history\}|\{question\})", template)
                filled = "".join(values.get(p, p) for p in pieces)
            types = [to_arrow_type(f.dataType) for f in schema.fields]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((conv_id, filled), types)], names=schema.names)

        now, messages, last = None, [], None
        for batch in batches:
            for conv_id, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if last is not None and conv_id != now:
                    if messages:
                        yield built(now, messages, last["content"])
                    messages, last = [], None
                if last is not None:
                    known = {k: v for k, v in last.items() if v is not None}
                    messages.append(json.dumps(known, ensure_ascii=False, separators=(",", ":")))
                now, last = conv_id, {"role": role, "content": text}
        if messages:
            yield built(now, messages, last["content"])

    tasks = tasks or rows.sparkSession.sparkContext.defaultParallelism
    dealt = rows.repartition(tasks, "conv_id").sortWithinPartitions("conv_id", "turn")
    return dealt.select("conv_id", "role", "text").mapInArrow(build, schema)


def search_queries(
    rows: DataFrame, model: ModelFactory | None, store: str | None = None, tasks: int | None = None, **options
) -> DataFrame:
    """(conv_id, text, problem) to search with: rewritten by the model where there is a history.

    Rewrites are kept in the ``store`` folder and not asked for again. Without a model, and where a
    rewrite failed, it is the question itself; ``problem`` then says what went wrong.
    """
    asked = last_questions(rows).select("conv_id", "question")
    if model is None:
        return asked.select("conv_id", F.col("question").alias("text"), F.lit(None).cast("string").alias("problem"))
    prompts = stored(rewrite_prompts(rows, tasks=tasks), "rewrite-prompts")
    store = store or work_folder(rows.sparkSession, "rewrites")
    answers = infer_once(prompts, "prompt", model, store, tasks, **options)
    rewritten = answers.select(
        "conv_id", "response", F.concat(F.lit("rewrite failed: "), F.col("error")).alias("problem")
    )
    return asked.join(rewritten, "conv_id", "left").select(
        "conv_id", F.coalesce("response", "question").alias("text"), "problem"
    )


def retrieve(
    queries: DataFrame,
    index: Index,
    embedder: ModelFactory | None,
    k: int = RETRIEVAL_DEPTH,
    query_type: str = "hybrid",
    depth: int = FUSION_DEPTH,
    tasks: int | None = None,
) -> DataFrame:
    """Hits (query_id, pk, score, rank) for (conv_id, text) rows; ``depth`` is that of the fusion."""
    asked = queries.select(F.col("conv_id").alias(QUERY), "text")
    if query_type == "keyword":
        return search_keyword(asked, index, k, tasks)
    if embedder is None:
        raise ValueError(f"a {query_type} search needs an embedder")
    asked = embed_queries(asked, embedder, tasks=tasks)
    if query_type == "hybrid":
        return search_hybrid(asked, index, k, depth, tasks)
    return search_vector(asked, index, k, tasks)


def contexts(
    hits: DataFrame,
    index: Index,
    columns: RetrieverColumns | None = None,
    chunk_template: str = CHUNK_TEMPLATE,
) -> DataFrame:
    """(conv_id, context, sources): the passages of a conversation's hits in rank order.

    Sources carry key, uri and name where the index has such columns, else null.
    """
    columns = columns or RetrieverColumns()
    optional = {columns.document_uri, columns.name, columns.primary_key} & set(index.docs.columns) - {PK}
    joined = with_columns(hits, index, [columns.chunk_text, *sorted(optional - {columns.chunk_text})])

    def text_of(name: str) -> Column:
        return (F.col(name) if name in joined.columns else F.lit(None)).cast("string")

    key = F.col(columns.primary_key if columns.primary_key in joined.columns else PK)
    passage = F.struct(
        "rank",
        key.alias("pk"),
        text_of(columns.document_uri).alias("uri"),
        text_of(columns.name).alias("name"),
        F.col(columns.chunk_text).alias("text"),
    )
    chunk = lambda p: fill_template(chunk_template, chunk_text=p["text"], document_uri=p["uri"])
    return (
        joined.groupBy(F.col(QUERY).alias("conv_id"))
        .agg(F.sort_array(F.collect_list(passage)).alias("passages"))
        .select(
            "conv_id",
            F.array_join(F.transform("passages", chunk), "").alias("context"),
            F.transform("passages", lambda p: F.struct(p["pk"], p["uri"], p["name"], p["rank"])).alias("sources"),
        )
    )


def prompt_rows(
    rows: DataFrame, found: DataFrame, template: str = ANSWER_TEMPLATE, history_chars: int | None = None
) -> DataFrame:
    """The finished prompts as rows (conv_id, turn, role, content), the system message at turn -1.

    The question is the original one, not its rewrite, and stands in the system message and at the
    end. No hits give an empty context. With ``history_chars`` only the newest messages of the history go in that
    have no more characters together.
    """
    asked = last_questions(rows).join(found.select("conv_id", "context"), "conv_id", "left")
    system = fill_template(template, context=F.col("context"), question=F.col("question"))
    ends = asked.select(
        "conv_id",
        F.explode(
            F.array(
                F.struct(
                    F.lit(SYSTEM_TURN).cast("long").alias("turn"),
                    F.lit("system").alias("role"),
                    system.alias("content"),
                ),
                F.struct(
                    F.col("last_turn").cast("long").alias("turn"),
                    F.lit("user").alias("role"),
                    F.col("question").alias("content"),
                ),
            )
        ).alias("m"),
    ).select("conv_id", "m.turn", "m.role", "m.content")
    history = formatted_history(rows)
    if history_chars is not None:
        history = turns_within(history, history_chars)
    history = history.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), "role", F.col("text").alias("content")
    )
    return ends.unionByName(history)


def prompt_sizes(prompts: DataFrame) -> DataFrame:
    """(conv_id, n_messages, prompt_chars, prompt_key) per prompt, by one partial aggregation.

    The key is a hash over all messages and their order; equal prompts have equal keys. Nothing is
    shortened to fit a model: a caller who wants that uses ``newest_turns``, or looks at the size.
    """
    message = F.sha2(F.to_json(F.array(F.col("turn").cast("string"), F.col("role"), F.col("content"))), 256)
    halves = [F.conv(F.substring(message, at, 15), 16, 10).cast("long") for at in (1, 16, 31, 46)]
    mixed = [F.bit_xor(h).cast("string") for h in halves]
    return prompts.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.sum(F.length("content")).alias("prompt_chars"),
        F.sha2(F.concat_ws(",", F.count(F.lit(1)).cast("string"), *mixed), 256).alias("prompt_key"),
    )


def generate(
    prompts: DataFrame, model: ModelFactory, store: str | None = None, tasks: int | None = None, **options
) -> DataFrame:
    """(conv_id, answer, error, n_messages, prompt_chars) from prompt rows; every conversation gets a row.

    Answers are kept in the ``store`` folder before they are used: equal prompts are sent once, repeated
    reads call nothing, and a failed call is tried again in the next run.
    """
    spark = prompts.sparkSession
    store = store or work_folder(spark, "answers")
    tasks = tasks or spark.sparkContext.defaultParallelism
    sizes = stored(prompt_sizes(prompts), "prompt-sizes")
    wanted = unanswered(sizes.groupBy("prompt_key").agg(F.min("conv_id").alias("conv_id")), store)
    wanted = stored(wanted, "wanted-answers")
    sent = spread_join(prompts, wanted, ["conv_id"], [F.col("turn")])
    answered = infer_conversations(sent.drop("prompt_key"), model, tasks, **options)
    store_answers(answered.join(wanted, "conv_id"), store)
    answers = stored_answers(sizes, store)
    joined = spread_join(sizes, answers, ["prompt_key"], [F.col("conv_id")], how="left")
    return joined.select("conv_id", F.col("response").alias("answer"), "error", "n_messages", "prompt_chars")


def answer_chats(
    rows: DataFrame,
    index: Index,
    embedder: ModelFactory,
    chat_model: ModelFactory,
    k: int = RETRIEVAL_DEPTH,
    query_type: str = "hybrid",
    columns: RetrieverColumns | None = None,
    depth: int = FUSION_DEPTH,
    store: str | None = None,
    tasks: int | None = None,
    history_chars: int | None = None,
    **options,
) -> DataFrame:
    """(conv_id, answer, error, problem, n_messages, prompt_chars, sources) for every conversation.

    Only messages that pass ``check_messages`` are used; a conversation none of whose messages do has
    an error instead of an answer. ``problem`` tells of messages left out and of a failed rewrite.
    Rewrites and answers are kept below ``store``.
    """
    good, bad = check_messages(rows)
    good = stored(good, "messages")
    store = store or work_folder(rows.sparkSession, "chat-answers")
    queries = stored(search_queries(good, chat_model, f"{store}/rewrites", tasks, **options), "search-queries")
    hits = retrieve(queries, index, embedder, k, query_type, depth, tasks)
    found = stored(contexts(hits, index, columns), "contexts")
    prompts = stored(prompt_rows(good, found, history_chars=history_chars), "prompts")
    answers = generate(prompts, chat_model, f"{store}/answers", tasks, **options)
    left_out = bad.filter(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.sum("copies").alias("n_bad"))
    told = F.concat(F.lit("messages left out: "), F.col("n_bad").cast("string"))
    whole = (
        answers.join(queries.select("conv_id", "problem"), "conv_id", "left")
        .join(found.select("conv_id", "sources"), "conv_id", "left")
        .join(left_out, "conv_id", "full_outer")
    )
    unusable = F.when(F.col("n_messages").isNull(), F.lit("no usable message"))
    problems = F.concat_ws("; ", told, F.col("problem"))
    return whole.select(
        "conv_id",
        "answer",
        F.coalesce("error", unusable).alias("error"),
        F.when(problems != "", problems).alias("problem"),
        "n_messages",
        "prompt_chars",
        "sources",
    )
