"""Quality rules: a table of thresholds compiled into Spark projections, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]+"
# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that it for was with as on be by at this from or an are not have which you "
    "le la les de des du et en un une est que qui dans pour par sur au pas avec ce il elle ou "
    "der die das und in den von zu mit sich dem nicht ein eine als auch auf ist im es an werden aus er "
    "el los las y del se con para una por su lo como más o pero sus ha me si sin"
).split()


@dataclass(frozen=True)
class Threshold:
    """A text passes if ``metric`` is between ``least`` and ``most``, both allowed; no bound where None."""

    metric: str
    least: float | None = None
    most: float | None = None

    def passes(self) -> Column:
        value = F.col(self.metric)
        bounds = [value >= F.lit(self.least)] if self.least is not None else []
        bounds += [value <= F.lit(self.most)] if self.most is not None else []
        both = bounds[0]
        for bound in bounds[1:]:
            both = both & bound
        return both


THRESHOLDS = (
    Threshold("n_words", least=50, most=100_000),
    Threshold("mean_word_chars", least=2.0, most=15.0),
    Threshold("symbol_ratio", most=0.1),
    Threshold("stop_word_ratio", least=0.02),
    Threshold("dup_line_ratio", most=0.5),
    Threshold("repeat_word_ratio", most=0.5),
    Threshold("capital_ratio", most=0.5),
)
METRICS = ("mean_word_chars", "symbol_ratio", "stop_word_ratio", "dup_line_ratio", "repeat_word_ratio", "capital_ratio")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _same_words(a: Column, b: Column) -> Column:
    return (a["a"] == b["a"]) & (a["b"] == b["b"]) & (a["c"] == b["c"])


def text_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and the counts that the thresholds are about, one row per row of ``docs``.

    Repeated windows are found by sorting the windows of a text with their places: equal ones are then
    neighbours, so the work per text is n log n. Each step is a projection of its own because the next
    one reads its array several times.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    split = docs.select(
        *[F.col(f"`{k}`") for k in keep],
        text.alias("_text"),
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("_words"),
        F.filter(F.split(text, "\n"), lambda line: F.rlike(line, F.lit(WORD))).alias("_lines"),
    )
    n = F.size("_words")
    windows = F.arrays_zip(
        F.slice("_words", F.lit(1), F.greatest(n - 2, F.lit(0))).alias("a"),
        F.slice("_words", F.lit(2), F.greatest(n - 2, F.lit(0))).alias("b"),
        F.slice("_words", F.lit(3), F.greatest(n - 2, F.lit(0))).alias("c"),
        F.when(n > 2, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>")).alias("at"),
    ).cast("array<struct<a:string,b:string,c:string,at:int>>")
    no_spaces = F.regexp_replace("_text", SPACES, "")
    counted = split.select(
        *[F.col(f"`{k}`") for k in keep],
        n.cast("long").alias("n_words"),
        F.length(no_spaces).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.regexp_replace("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.length(F.regexp_replace("_text", r"[^\p{Lu}]+", "")).cast("long").alias("n_capitals"),
        F.length(F.regexp_replace("_text", r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
        F.sort_array(windows).alias("_sorted"),
    )
    twice = F.filter(
        "_sorted",
        lambda x, i: F.coalesce(_same_words(x, F.get("_sorted", i - 1)), F.lit(False))
        | F.coalesce(_same_words(x, F.get("_sorted", i + 1)), F.lit(False)),
    )
    covered = F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["at"], x["at"] + 1, x["at"] + 2))))
    names = [c for c in counted.columns if c != "_sorted"]
    return counted.select(*[F.col(f"`{c}`") for c in names], F.size(covered).cast("long").alias("n_repeat_words"))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def score_quality(docs: DataFrame, thresholds: tuple[Threshold, ...] = THRESHOLDS) -> DataFrame:
    """Counts, ratios and verdict of every whole text.

    Result: one row per row of ``docs``: doc_id as it is (also null), the counts, ``base_failed`` (fewer
    than 50 words, or more than half of the words in repeated windows of three), ``kept`` (not base_failed
    and within every threshold) and the ratios that the thresholds are about, each 0 where its
    denominator is 0. A null or empty text has zeros and fails. Other columns are not read; an empty
    table gives an empty result.
    """
    counts = text_counts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"])
    ratios = counts.select(
        "doc_id",
        *COUNTS,
        _ratio(F.col("word_chars"), F.col("n_words")).alias("mean_word_chars"),
        _ratio(F.col("n_symbols"), F.col("n_words")).alias("symbol_ratio"),
        _ratio(F.col("n_stop_words"), F.col("n_words")).alias("stop_word_ratio"),
        _ratio(F.col("n_dup_lines"), F.col("n_lines")).alias("dup_line_ratio"),
        _ratio(F.col("n_repeat_words"), F.col("n_words")).alias("repeat_word_ratio"),
        _ratio(F.col("n_capitals"), F.col("n_letters")).alias("capital_ratio"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    passed = ~failed
    for threshold in thresholds:
        passed = passed & threshold.passes()
    return ratios.select("doc_id", *COUNTS, failed.alias("base_failed"), passed.alias("kept"), *METRICS)
