"""Model assessments: calling, parsing, checking, one row per participant, and reports on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.config import path_exists, work_folder
from turnwise.functions.models import ModelFactory, infer
from turnwise.functions.nested import fill_template
from turnwise.functions.text import content_key
from turnwise.operators.distribution import spread_join, stored
from turnwise.schemas import (
    ASSESSMENT,
    PARTICIPANT_INTEGERS,
    PARTICIPANT_KEYS,
    PARTICIPANT_TEXT_LISTS,
)


def store_answers(answered: DataFrame, store: str) -> None:
    """Append (prompt_key, response, error) to a store, in folders by the key's first digit."""
    kept = answered.select("prompt_key", "response", "error", F.substring("prompt_key", 1, 1).alias("prefix"))
    kept.write.mode("append").partitionBy("prefix").parquet(store)


def stored_answers(keys: DataFrame, store: str) -> DataFrame:
    """One (prompt_key, response, error) per wanted key; an answer wins over errors of earlier runs."""
    schema = "prompt_key string, response string, error string, prefix string"
    found = keys.sparkSession.read.schema(schema).parquet(store)
    wanted = keys.select("prompt_key", F.substring("prompt_key", 1, 1).alias("prefix")).distinct()
    return (
        found.join(wanted, ["prefix", "prompt_key"], "left_semi")
        .groupBy("prompt_key")
        .agg(
            F.max("response").alias("response"),
            F.when(F.max("response").isNull(), F.max("error")).alias("error"),
        )
    )


def unanswered(keys: DataFrame, store: str) -> DataFrame:
    """The wanted keys that the store has no answer for."""
    spark = keys.sparkSession
    if not path_exists(spark, store):
        return keys
    done = stored_answers(keys, store).filter(F.col("response").isNotNull())
    return keys.join(done.select("prompt_key"), "prompt_key", "left_anti")


def infer_once(
    prompts: DataFrame, prompt_col: str, model: ModelFactory, store: str, tasks: int | None = None, **options
) -> DataFrame:
    """Answers for all prompts, calling the model only for prompts not answered before.

    Answers live in the ``store`` folder under a key made from the prompt. Equal prompts are sent
    once, in ``tasks`` tasks (the cluster's default parallelism if not given). Failed calls are tried
    again in the next run; in this run they come back with their error. The answers are written before
    they are used, so later filters and repeated reads never repeat a call.
    """
    keyed = prompts.withColumn("prompt_key", content_key(F.col(prompt_col)))
    wanted = unanswered(keyed.groupBy("prompt_key").agg(F.first(prompt_col).alias(prompt_col)), store)
    wanted = wanted.repartition(tasks or prompts.sparkSession.sparkContext.defaultParallelism, "prompt_key")
    store_answers(infer(wanted, prompt_col, model, **options), store)
    rest = [c for c in prompts.columns if c != prompt_col]
    spread = [F.col(c) for c in rest] or [F.lit(0)]
    return spread_join(keyed, stored_answers(keyed, store), ["prompt_key"], spread)


def parse_assessment(df: DataFrame, response: str = "response") -> DataFrame:
    """Response text to the typed struct. Bad text gives a struct of nulls, never a failed job."""
    return df.withColumn("participant_analysis", F.from_json(F.col(response), ASSESSMENT))


def assessment_problems(response: Column) -> Column:
    """What a response breaks of the strict schema, as an array of texts; empty if nothing.

    Every one of the 18 keys is required, no other key is allowed, types must match. The score's
    range is not part of the schema.
    """
    document = F.try_parse_json(response)
    top = F.try_variant_get(document, "$", "map<string,variant>")
    items = F.try_variant_get(document, "$.participants", "array<variant>")
    expected = F.array(*[F.lit(k) for k in PARTICIPANT_KEYS])

    def named(prefix: str, keys: Column) -> Column:
        return F.transform(keys, lambda k: F.concat(F.lit(prefix), k))

    def of_participant(item: Column) -> Column:
        fields = F.try_variant_get(item, "$", "map<string,variant>")
        keys = F.map_keys(fields)
        wrong = F.filter(
            F.map_entries(fields),
            lambda e: F.array_contains(expected, e["key"])
            & ~_allowed(e["key"], F.coalesce(F.schema_of_variant(e["value"]), F.lit("VOID"))),
        )
        found = F.concat(
            named("missing ", F.array_except(expected, keys)),
            named("unexpected ", F.array_except(keys, expected)),
            named("wrong type ", F.transform(wrong, lambda e: e["key"])),
        )
        return F.coalesce(found, F.array(F.lit("participant is not an object")))

    other_keys = F.array_except(F.map_keys(top), F.array(F.lit("participants")))
    return (
        F.when(top.isNull(), F.array(F.lit("not a JSON object")))
        .when(~F.array_contains(F.map_keys(top), "participants"), F.array(F.lit("missing participants")))
        .when(items.isNull(), F.array(F.lit("participants is not an array")))
        .otherwise(
            F.array_sort(
                F.array_union(
                    named("unexpected ", other_keys), F.flatten(F.transform(items, of_participant))
                )
            )
        )
    )


def _allowed(key: Column, json_type: Column) -> Column:
    """Whether the JSON type of a value is the one the schema names for its key."""
    lists = json_type.isin("ARRAY<STRING>", "ARRAY<VOID>")
    return (
        F.when(key.isin(PARTICIPANT_TEXT_LISTS), lists)
        .when(key.isin(PARTICIPANT_INTEGERS), json_type == "BIGINT")
        .otherwise(json_type == "STRING")
    )


def validate_assessment(df: DataFrame, response: str = "response") -> tuple[DataFrame, DataFrame]:
    """Split into rows that keep to the strict schema, parsed, and the rest with their problems."""
    checked = df.withColumn("problems", assessment_problems(F.col(response)))
    good = parse_assessment(checked.filter(F.size("problems") == 0), response).drop("problems")
    return good, checked.filter(F.size("problems") > 0)


def explode_participants(df: DataFrame, keep: list[str], outer: bool = False) -> DataFrame:
    """One row per participant. A call without participants gives no row, with ``outer`` one."""
    explode = F.explode_outer if outer else F.explode
    return df.select(*keep, explode("participant_analysis.participants").alias("participant")).select(
        *keep, F.col("participant.name").alias("name"), "participant"
    )


def meetings_per_participant(df: DataFrame) -> DataFrame:
    """How many different conversations each participant took part in."""
    return df.groupBy("name").agg(F.count_distinct("conversation_id").alias("n_meetings"))


def consistency(df: DataFrame, score: Column) -> DataFrame:
    """How even the scores of each participant are over all conversations."""
    return df.groupBy("name").agg(
        F.count(score).alias("n_scores"),
        F.avg(score).alias("avg_score"),
        F.stddev_samp(score).alias("stddev_score"),
        F.min(score).alias("min_score"),
        F.max(score).alias("max_score"),
    )


def assess_prompts(
    prompts: DataFrame, model: ModelFactory, store: str, tasks: int | None = None, **options
) -> tuple[DataFrame, DataFrame]:
    """Prompts to checked assessments and a quarantine of failed calls and bad answers."""
    answered = infer_once(prompts, "prompt", model, store, tasks, **options)
    good, bad = validate_assessment(answered.filter(F.col("error").isNull()))
    failed = answered.filter(F.col("error").isNotNull()).withColumn(
        "problems", F.array(F.concat(F.lit("call failed: "), F.col("error")))
    )
    return good, bad.unionByName(failed)


MERGE_MARK = " - ASSESSMENTS: "
MERGE_END = "\n\nAnswer format:\n"
MERGE_PROMPT = (
    "Below are assessments of one person, made from parts of one call that follow each other. Make one assessment "
    "of them. Keep everything that any of them says, in order, and say nothing else."
    + MERGE_MARK
    + "{assessments}"
    + MERGE_END
    + "A JSON object with the key participants: an array with one object that has the keys of those above."
)


def combined(parts: Column) -> Column:
    """One participant of several, without a model: nothing is left out.

    Lists hold the entries of all parts, each once, in their order; texts are the different texts of all parts, joined;
    the score is the mean, rounded.
    """

    def field(key: str) -> Column:
        return F.filter(F.transform(parts, lambda p: p[key]), lambda v: v.isNotNull())

    def of(key: str) -> Column:
        values = field(key)
        if key in PARTICIPANT_TEXT_LISTS:
            return F.when(F.size(values) > 0, F.array_distinct(F.flatten(values)))
        if key in PARTICIPANT_INTEGERS:
            total = F.aggregate(values, F.lit(0).cast("long"), lambda a, v: a + v)
            return F.when(F.size(values) > 0, F.round(total / F.size(values)).cast("long"))
        texts = F.array_distinct(F.filter(values, lambda v: v != ""))
        return F.when(F.size(values) > 0, F.array_join(texts, " "))

    return F.struct(*[(F.get(parts, F.lit(0))["name"] if k == "name" else of(k)).alias(k) for k in PARTICIPANT_KEYS])


def merge_parts(
    participants: DataFrame,
    keep: list[str],
    model: ModelFactory | None = None,
    store: str | None = None,
    tasks: int | None = None,
    fan_in: int = 8,
    part: str = "part",
    **options,
) -> DataFrame:
    """One row (``keep``, name, participant) per person of a call, from rows per part of a long call.

    In each round the answers of up to ``fan_in`` neighbouring parts become one prompt, and the model's answers are the
    next round's parts, until each person has one; the number of rounds is the logarithm of the number of parts. So no
    task and no prompt holds more than ``fan_in`` answers, and every part's answer has been in a prompt. Without a
    model, and where its answer fails or is not one valid participant, ``combined`` joins the answers. Persons
    with one part are not sent. Answers are kept in the ``store`` folder.
    """
    spark = participants.sparkSession
    store = store or work_folder(spark, "merged-parts")
    keys = [*keep, "name"]
    level = participants.select(*keys, F.col(part).cast("long").alias("part"), "participant")
    # Of several entries of one name in one part, all count.
    level = stored(level, "parts")
    while level.agg(F.max("part")).first()[0]:
        held = F.sort_array(F.collect_list(F.struct("part", F.to_json("participant").alias("text"), "participant")))
        groups = level.groupBy(*keys, F.floor(F.col("part") / fan_in).alias("part")).agg(held.alias("held"))
        groups = stored(groups.withColumn("held", F.transform("held", lambda h: h["participant"])), "part-groups")
        several = groups.filter(F.size("held") > 1)
        joined = several.select(*keys, "part", combined(F.col("held")).alias("joined"), F.to_json("held").alias("assessments"))
        if model is None:
            merged = joined.select(*keys, "part", F.col("joined").alias("participant"))
        else:
            prompts = joined.withColumn("prompt", fill_template(MERGE_PROMPT, assessments=F.col("assessments"))).drop("assessments")
            answered = parse_assessment(infer_once(prompts, "prompt", model, store, tasks, **options))
            found = F.col("participant_analysis.participants")
            is_good = (F.size(assessment_problems(F.col("response"))) == 0) & (F.size(found) == 1)
            # The person's name stays, whatever the model calls them.
            answer = F.get(found, F.lit(0)).withField("name", F.col("name"))
            merged = answered.select(*keys, "part", F.when(F.coalesce(is_good, F.lit(False)), answer).otherwise(F.col("joined")).alias("participant"))
        single = groups.filter(F.size("held") == 1).select(*keys, "part", F.get("held", F.lit(0)).alias("participant"))
        level = stored(single.unionByName(merged), "parts")
    one = level.groupBy(*keys).agg(F.collect_list("participant").alias("held"))
    return one.select(*keys, F.when(F.size("held") == 1, F.get("held", F.lit(0))).otherwise(combined(F.col("held"))).alias("participant"))
