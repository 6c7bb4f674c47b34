"""Speaker labels, transcripts, prompts and talk time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.functions.nested import fill_template, first_or_null, quoted
from turnwise.operators.distribution import order_slices, spread_join, stored

PART_LINES = 1024  # lines of a transcript that go into one prompt

# Fixed value: what stands between a speaker and the spoken text.
SPEAKER_SEPARATOR = " : "

# Columns kept of a flattened call, besides the labelled sentences.
KEPT_COLUMNS = [
    "conversation.id",
    "conversation.duration",
    "conversation.title",
    "extensiveConversation.data.title",
    "extensiveConversation.data.language_code",
    "conversation.event_start_date",
    "conversation.event_end_date",
    "extensiveConversation.data.attendees",
    "extensiveConversation.data.invitees",
]


def attendee_label(email: Column, full_name: Column) -> Column:
    """The address if there is one, else the name if there is one, else null."""
    return F.coalesce(F.nullif(email, F.lit("")), F.nullif(full_name, F.lit("")))


def speaker_line(label: Column, speaker_id: Column, text: Column) -> Column:
    """A null text gives a null line."""
    return F.concat(F.coalesce(label, speaker_id), F.lit(SPEAKER_SEPARATOR), text)


def labelled_sentences(sentences: Column, attendees: Column) -> Column:
    """The array of ``speaker : text`` lines, in the order of the sentences."""

    def line(sentence: Column) -> Column:
        labels = F.transform(
            F.filter(attendees, lambda a: a["id"] == sentence["recording_attendee_id"]),
            lambda a: attendee_label(a["email"], a["full_name"]),
        )
        label = first_or_null(F.filter(labels, lambda found: found.isNotNull()))
        return speaker_line(label, sentence["recording_attendee_id"], sentence["text"])

    return F.transform(sentences, line)


def label_speakers(flat_calls: DataFrame) -> DataFrame:
    """Flattened call documents to kept columns plus ``sentences_updated``. No shuffle."""
    return flat_calls.select(
        *[F.col(quoted(c)) for c in KEPT_COLUMNS],
        labelled_sentences(
            F.col("sentences"), F.col(quoted("extensiveConversation.data.attendees"))
        ).alias("sentences_updated"),
    )


def label_speakers_rows(sentences: DataFrame, attendees: DataFrame) -> DataFrame:
    """The same lines where sentences and attendees are tables, joined on call and speaker."""
    labels = (
        attendees.withColumn("label", attendee_label(F.col("email"), F.col("full_name")))
        .filter(F.col("label").isNotNull())
        .groupBy("conversation_id", F.col("attendee_id").alias("recording_attendee_id"))
        .agg(F.min_by("label", "position").alias("label"))
    )
    joined = spread_join(
        sentences,
        labels,
        ["conversation_id", "recording_attendee_id"],
        [F.col("order_number")],
        how="left",
    )
    line = speaker_line(F.col("label"), F.col("recording_attendee_id"), F.col("text"))
    speaker = F.coalesce("label", "recording_attendee_id")
    return joined.select("conversation_id", "order_number", speaker.alias("speaker"), line.alias("line"))


def positions(lines: DataFrame, key: str, order: str, width: int) -> DataFrame:
    """``lines`` with ``position``, their place in the conversation from 0, in order of ``order``.

    Lines are numbered within slices of ``width`` order numbers and shifted by the sizes of the slices
    before, so a long conversation is not one task's work. Lines without an order number come first, in
    slices by a hash.
    """
    by_order = order_slices(F.col(order), width)
    slot = F.when(F.col(order).isNull(), -1 - F.pmod(F.xxhash64("line"), F.lit(width))).otherwise(by_order)
    cut = stored(lines.withColumn("_slice", slot), "lines")
    before = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        cut.groupBy(key, "_slice")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(F.col(key).alias("_key"), F.col("_slice").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    )
    within = Window.partitionBy(key, "_slice").orderBy(order, "line")
    numbered = cut.withColumn("_row", F.row_number().over(within) - 1)
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_slice") == F.col("_of"))
    return numbered.join(shifts, same).select(*lines.columns, (F.col("_row") + F.col("_shift")).alias("position"))


def transcript_parts(
    lines: DataFrame,
    key: str = "conversation_id",
    order: str = "order_number",
    line: str = "line",
    width: int = PART_LINES,
) -> DataFrame:
    """Transcripts as JSON arrays of lines in their order.

    A conversation of at most ``width`` lines is one row, whatever its order numbers. Longer ones go on
    in rows with ``part`` 1, 2, ... of ``width`` lines each, so that no task gathers more; assessments of
    parts are put together again by ``merged_parts``. Positions are only made for conversations that have
    more lines; which these are is counted first.
    """
    rows = lines.select(key, order, F.col(line).alias("line"))
    long = stored(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > width).select(F.col(key).alias("_long")), "long-calls")

    def gathered(held: DataFrame, by: Column, part: Column) -> DataFrame:
        ordered = F.sort_array(F.collect_list(F.struct(by.alias("by"), "line")))
        whole = held.groupBy(key, part.alias("part")).agg(ordered.alias("ordered"))
        return whole.select(key, "part", F.transform("ordered", lambda o: o["line"]).alias("sentences_updated"))

    first = F.lit(0).cast("long")
    if long.isEmpty():
        return gathered(rows, F.col(order), first)
    is_long = F.col(key).eqNullSafe(F.col("_long"))
    whole = gathered(rows.join(long, is_long, "left_anti"), F.col(order), first)
    placed = positions(rows.join(long, is_long, "left_semi"), key, order, width)
    return whole.unionByName(gathered(placed, F.col("position"), F.floor(F.col("position") / width)))


def transcript_text(sentences_updated: Column) -> Column:
    return F.to_json(sentences_updated)


TRANSCRIPT_MARK = " - TRANSCRIPT: "
TRANSCRIPT_END = "\n\nAnswer format:\n"

ASSESSMENT_PROMPT = (
    "You assess the people in a recorded business call. Write in English. A speaker whose label "
    "contains {{marker}} works for us and has the role 'sales rep'. Use invented stand-ins for "
    "people, companies and other sensitive details, the same one each time, and do not list them. "
    "Judge only by what was said."
    + TRANSCRIPT_MARK
    + "{transcript}"
    + TRANSCRIPT_END
    + "A JSON object with the key participants: an array with one object per speaker, holding "
    "name, email_id, role, performance_score (1 to 10), engagement_level, sales_impact, "
    "meeting_summary_from_my_perspective, meeting_summary_from_their_perspective and these arrays "
    "of short texts: celebrations, communication, customer_focus, impact_assessment, "
    "manager_actions, performance_metrics, platform_expertise, recommendations, sales_skills, "
    "strengths."
)


def assessment_template(marker: str) -> str:
    return ASSESSMENT_PROMPT.replace("{{marker}}", marker)


def build_prompt(transcript: Column, template: str) -> Column:
    """The instruction with the transcript in its ``{transcript}`` place."""
    return fill_template(template, transcript=transcript)


def talk_time(sentences: DataFrame) -> DataFrame:
    """Talk time in milliseconds per speaker and its share of the call, in percent."""
    spoken = F.sum(F.col("end_time") - F.col("start_time"))
    speakers = sentences.groupBy("conversation_id", "recording_attendee_id").agg(
        spoken.alias("seconds"), F.count(F.lit(1)).alias("n_sentences")
    )
    totals = sentences.groupBy("conversation_id").agg(spoken.alias("call_seconds"))
    joined = spread_join(
        speakers, totals, ["conversation_id"], [F.col("recording_attendee_id")]
    )
    share = F.when(F.col("call_seconds") != 0, 100 * F.col("seconds") / F.col("call_seconds"))
    return joined.select(
        "conversation_id",
        "recording_attendee_id",
        "n_sentences",
        F.round(1000 * F.col("seconds")).cast("long").alias("talk_time"),
        F.round(share, 2).alias("percent_talk_time"),
    )


def talk_time_beside_stored(sentences: DataFrame, attendees: DataFrame) -> DataFrame:
    """Talk time from the sentences beside the one stored in the call; the two may differ."""
    claimed = F.struct("stored_talk_time", "stored_percent")
    claims = (
        attendees.groupBy("conversation_id", F.col("attendee_id").alias("recording_attendee_id"))
        .agg(F.min_by(claimed, "position").alias("claimed"))
        .select("conversation_id", "recording_attendee_id", "claimed.*")
    )
    return talk_time(sentences).join(claims, ["conversation_id", "recording_attendee_id"], "left")


def talk_overlaps(sentences: DataFrame, span: float = 3600.0) -> DataFrame:
    """Talk time in milliseconds per speaker: the plain sum, the time in which they spoke at all, and crosstalk.

    Sentences may overlap, also those of one speaker. A speaker's sentences are merged into stretches, and a sweep
    over the ends of all stretches tells when more than one speaker was heard. Calls are cut into pieces of
    ``span`` seconds, and times of the pieces are added, so a long call is not one task's work. Sentences
    without both times count nothing; one that ends before it starts counts in the plain sum only.
    """
    keys = ["conversation_id", "recording_attendee_id"]
    first, last = (F.floor(F.col(c) / span).cast("long") for c in ("start_time", "end_time"))
    cut = sentences.filter("end_time > start_time").withColumn("piece", F.explode(F.sequence(first, last)))
    cut = cut.select(
        *keys,
        "piece",
        F.greatest("start_time", F.col("piece") * span).alias("start_time"),
        F.least("end_time", (F.col("piece") + 1) * span).alias("end_time"),
    ).filter("end_time > start_time")
    before = Window.partitionBy(*keys, "piece").orderBy("start_time", "end_time").rowsBetween(Window.unboundedPreceding, -1)
    opened = cut.withColumn("reached", F.max("end_time").over(before))
    opens = F.when(F.col("reached").isNull() | (F.col("start_time") > F.col("reached")), 1).otherwise(0)
    so_far = Window.partitionBy(*keys, "piece").orderBy("start_time", "end_time").rowsBetween(Window.unboundedPreceding, 0)
    stretches = (
        opened.withColumn("stretch", F.sum(opens).over(so_far))
        .groupBy(*keys, "piece", "stretch")
        .agg(F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"))
    )
    ends = stretches.select(
        *keys, "piece", F.inline(F.array(F.struct(F.col("start_time").alias("at"), F.lit(1).alias("step")), F.struct(F.col("end_time").alias("at"), F.lit(-1).alias("step"))))
    )
    in_time = Window.partitionBy("conversation_id", "piece").orderBy("at", "step", "recording_attendee_id")
    heard = ends.withColumn("n", F.sum("step").over(in_time.rowsBetween(Window.unboundedPreceding, -1)))
    waited = F.col("at") - F.lag("at").over(in_time)
    heard = heard.withColumn("shared", F.when(F.col("n") > 1, waited).otherwise(0.0))
    heard = heard.withColumn("shared_so_far", F.sum("shared").over(in_time.rowsBetween(Window.unboundedPreceding, 0)))
    times = heard.groupBy(*keys).agg(
        F.sum(-F.col("step") * F.col("at")).alias("distinct"), F.sum(-F.col("step") * F.col("shared_so_far")).alias("crosstalk")
    )
    plain = sentences.groupBy(*keys).agg(F.sum(F.col("end_time") - F.col("start_time")).alias("spoken"))
    joined = plain.join(times.withColumnsRenamed({k: f"_{k}" for k in keys}), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left")
    parts = (("spoken", "talk_time"), ("distinct", "distinct_time"), ("crosstalk", "crosstalk"))
    return joined.select(*keys, *[F.round(1000 * F.coalesce(a, F.lit(0.0))).cast("long").alias(b) for a, b in parts])


def moment_rows(calls: DataFrame) -> DataFrame:
    """Key moments of call documents, one row per mention, with the positions that lead to it.

    A call without the block, an item without categories and a category without mentions give one row each, with
    nulls below that level.
    """
    items = calls.select(
        F.col("conversation.id").alias("conversation_id"),
        F.posexplode_outer("extensiveConversation.data.key_moments.items").alias("item_at", "i"),
    )
    categories = items.select(
        "conversation_id", "item_at", F.col("i.name").alias("item"), F.posexplode_outer("i.categories").alias("category_at", "c")
    )
    mentions = categories.select(
        "conversation_id",
        "item_at",
        "item",
        "category_at",
        F.col("c.category").alias("category"),
        F.posexplode_outer("c.mentions").alias("mention_at", "m"),
    )
    places = [F.col(c).cast("long").alias(c) for c in ("item_at", "category_at", "mention_at")]
    return mentions.select(
        "conversation_id", *places, "item", "category", "m.recording_attendee_id", "m.index_start", "m.index_end", "m.start_time"
    )


def action_item_rows(calls: DataFrame) -> DataFrame:
    """Action items of call documents, one row each with its position; a call without any gives one row."""
    items = calls.select(
        F.col("conversation.id").alias("conversation_id"),
        F.posexplode_outer("extensiveConversation.data.action_items.items").alias("item_at", "i"),
    )
    return items.select("conversation_id", F.col("item_at").cast("long").alias("item_at"), "i.*")


def mentioned_sentences(mentions: DataFrame, sentences: DataFrame, width: int = 64) -> DataFrame:
    """Each mention with every sentence whose order number lies in its span (ends included).

    Order numbers are cut into bins of ``width``; a mention is copied to the bins that its span touches, a sentence
    lies in one, and both meet by call and bin. So a long call's sentences and mentions are spread over tasks.
    Mentions without a span, or with one that ends before it begins, meet nothing.
    """
    bin_of = lambda c: F.floor(c / width)
    spans = mentions.filter("index_start <= index_end").withColumn(
        "_bin", F.explode(F.sequence(bin_of(F.col("index_start")), bin_of(F.col("index_end"))))
    )
    lines = sentences.select("conversation_id", "order_number", "text", bin_of(F.col("order_number")).alias("_bin"))
    within = F.col("order_number").between(F.col("index_start"), F.col("index_end"))
    return spans.join(lines, ["conversation_id", "_bin"]).filter(within).drop("_bin")
