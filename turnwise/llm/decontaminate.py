"""Benchmark items in texts, also with other numbers, names and units, by canonical templates.

Numbers, names and units become typed placeholders, so a question that was asked again with other values
has the same windows of words as the item. Windows are joined by hash. Matches with nearly the same
distance between their places in text and item form an alignment; each is judged by itself: how many of
the item's words it covers, how long a run it holds, and whether the values that fill the item's slots map
one to one to the values in the text. The best alignment speaks for a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.operators.distribution import stored

WINDOW = 5  # words that have to match in a row; shorter items are only found as whole texts
SHARE = 0.5  # of an item's words that an alignment must cover
RUN = 13  # or so many words in a row
BROADCAST_ROWS = 200_000

NUMBER, NAME, UNIT = "0", "1", "2"
SLOTS = (NUMBER, NAME, UNIT)
RAW = r"\p{N}+(?:[.,]\p{N}+)*|\p{L}+"
CANONICAL = r"[012]|\p{L}+"
NUMBERS = r"\p{N}+(?:[.,]\p{N}+)*"
# A capitalised word within a sentence, or the first of a sentence or text, which may be a name.
NAMES = r"(?<=(?:^|[.?!\n\"“(][ \t]?|[\p{Ll}0,;:][ \t]))\p{Lu}\p{Ll}+(?!\p{L})"
# Words that measure the number before them.
UNIT_WORDS = (
    "mm cm m km in ft yd mi mg g kg lb oz t ml cl l s sec min h hr hrs ms "
    "meters metres kilometers kilometres miles feet inches grams kilograms pounds liters litres seconds minutes "
    "hours days weeks months years dollars euros cents percent degrees mph kmh kw kwh w v a hz khz mhz ghz kb mb gb tb"
).split()
UNITS = rf"(?<=0[ \t]?)(?i:{'|'.join(sorted(UNIT_WORDS, key=len, reverse=True))})(?!\p{{L}})"


def raw_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(RAW), F.lit(0))


def canonical_words(text: Column) -> Column:
    """The words of ``text`` with placeholders, one for one with ``raw_words``; case is left as it is."""
    plain = F.regexp_replace(text, NUMBERS, NUMBER)
    named = F.regexp_replace(plain, NAMES, NAME)
    return F.regexp_extract_all(F.regexp_replace(named, UNITS, UNIT), F.lit(CANONICAL), F.lit(0))


def _windows(rows: DataFrame, keep: list[str], size: int) -> DataFrame:
    """(``keep``, at, window): the hash of each run of ``size`` of the column ``hashes``."""
    n = F.greatest(F.size("hashes") - (size - 1), F.lit(0))
    names = [f"w{i}" for i in range(size)]
    runs = F.arrays_zip(*[F.slice("hashes", F.lit(i + 1), n).alias(names[i]) for i in range(size)])
    return rows.select(*keep, F.posexplode(runs).alias("at", "run")).select(
        *keep, "at", F.xxhash64(*[F.col(f"run.{name}") for name in names]).alias("window")
    )


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(F.lower(w)))


def item_windows(items: DataFrame) -> DataFrame:
    """(item_id, n_words, item_at, window, has_slot) of every item that has a window."""
    words = items.select("item_id", "words", _hashes(F.col("words")).alias("hashes"))
    run = F.slice("words", F.col("at") + 1, F.lit(WINDOW))
    return _windows(words, ["item_id", "words"], WINDOW).select(
        "item_id",
        F.size("words").alias("n_words"),
        F.col("at").alias("item_at"),
        "window",
        F.arrays_overlap(run, F.array(*map(F.lit, SLOTS))).alias("has_slot"),
    )


def _small(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcasting if it has few enough rows; else Spark joins by shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _prepared(table: DataFrame, id_column: str) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return table.select(F.col(id_column).cast("long").alias(id_column), F.xxhash64(text).alias("text_key"), text.alias("body"))


def _reach(places: Column) -> Column:
    """(covered, run): the words that windows at the sorted ``places`` cover, and the most of them in a row."""
    zero = F.lit(0)
    start = F.struct(F.lit(-WINDOW).alias("last"), zero.alias("covered"), zero.alias("now"), zero.alias("run"))

    def add(seen: Column, place: Column) -> Column:
        new = F.least(place - seen["last"], F.lit(WINDOW))
        now = F.when(place - seen["last"] <= WINDOW, seen["now"]).otherwise(0) + new
        return F.struct(place.alias("last"), (seen["covered"] + new).alias("covered"), now.alias("now"), F.greatest(seen["run"], now).alias("run"))

    return F.aggregate(places, start, add, lambda seen: F.struct(seen["covered"], seen["run"]))


def _aligned(votes: DataFrame, pair: list[str]) -> DataFrame:
    """``votes`` with ``alignment``: matches whose shifts follow each other without a gap of more than one word."""
    shifts = votes.select(*pair, (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    by_shift = Window.partitionBy(*pair).orderBy("shift")
    opens = F.when(F.col("shift") - F.lag("shift").over(by_shift) <= 1, 0).otherwise(1)
    numbered = shifts.withColumn("opens", opens).withColumn("alignment", F.sum("opens").over(by_shift))
    numbered = numbered.select(*[F.col(c).alias(f"_{c}") for c in pair], F.col("shift").alias("_shift"), "alignment")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in pair]
    return votes.join(numbered, [*same, F.col("at") - F.col("item_at") == F.col("_shift")]).drop(*[f"_{c}" for c in pair], "_shift")


def find_contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """Items of ``benchmark`` that whole texts of ``docs`` hold.

    An item is held if one alignment covers ``share`` of its words by windows of five, or thirteen words in a row, so
    copies with a word changed, left out or put in are found, and long parts of long items. If an
    alignment's values do not map one to one, only windows without values count. An item of fewer than
    five words is held by a text that consists of just its words.

    Result: one row per doc_id, text and item_id found, with text_key (a hash of the text), n_words (of the item),
    n_found (words covered), longest_run, coverage (n_found by n_words) and kind: ``exact`` where no value
    differs, ``template`` where values differ consistently. Null and empty texts and items, and texts without
    words, are in no row. Rows repeated in ``docs`` are reported once; items repeated in ``benchmark`` under
    one item_id count as one text each, the most covered wins, and of equally covered ones the longer, then
    ``template``. Items without item_id are not looked for. Other columns are not read; an empty
    table on either side gives an empty result.

    Words never leave their task: the windows of ``benchmark`` are broadcast if a count shows them to be
    few, and only windows that match are shuffled. With a large benchmark both sides are shuffled by
    window hash.
    """
    items = _prepared(benchmark, "item_id").filter(F.col("item_id").isNotNull()).dropDuplicates(["item_id", "text_key"])
    items = items.withColumn("words", canonical_words(F.col("body"))).withColumn("item_id", F.struct("item_id", "text_key"))
    bench = stored(item_windows(items.select("item_id", "words")), "item-windows")
    source = _prepared(docs, "doc_id")
    key = ["doc_id", "text_key"]
    pair = [*key, "item_id"]
    hashed = source.select(*key, _hashes(canonical_words(F.col("body"))).alias("hashes"))
    votes = _windows(hashed, key, WINDOW).join(_small(bench), "window").groupBy(*pair, "n_words", "item_at", "at", "has_slot").agg(F.lit(1).alias("seen"))
    votes = stored(_aligned(stored(votes.drop("seen"), "window-votes"), pair), "aligned-votes")
    one = [*pair, "alignment"]
    places = F.sort_array(F.collect_set("item_at"))
    plain = F.sort_array(F.collect_set(F.when(~F.col("has_slot"), F.col("item_at"))))
    reached = votes.groupBy(*one, "n_words").agg(_reach(places).alias("all"), _reach(plain).alias("plain"))

    def is_held(reach: str) -> Column:
        return (F.col(f"{reach}.covered") >= F.col("n_words") * F.lit(share)) | (F.col(f"{reach}.run") >= RUN)

    candidates = stored(reached.filter(is_held("all")), "candidates")
    verdicts = _slot_verdicts(votes, candidates, one, items, source)
    judged = candidates.join(verdicts, [F.col(c).eqNullSafe(F.col(f"v_{c}")) for c in one], "left")
    consistent = F.coalesce("consistent", F.lit(True))
    counted = judged.withColumn("all", F.when(consistent, F.col("all")).otherwise(F.col("plain"))).filter(is_held("all"))
    kind = F.when(consistent & F.coalesce("changed", F.lit(False)), "template").otherwise("exact")

    def best(covered: Column, run: Column, kind: Column) -> Column:
        return F.struct(
            (covered / F.col("n_words")).alias("coverage"),
            covered.cast("long").alias("n_found"),
            F.col("n_words").cast("long").alias("n_words"),
            run.cast("long").alias("longest_run"),
            kind.alias("kind"),
        ).alias("best")

    held = counted.select(*key, F.col("item_id.item_id").alias("item_id"), best(F.col("all.covered"), F.col("all.run"), kind))
    # Short items: the hash of all words of the text is that of the item's.
    short = items.select("item_id.item_id", F.lower(F.array_join(_raw(), " ")).alias("whole"), F.size("words").alias("n_words"))
    short = _small(short.filter(F.col("n_words").between(1, WINDOW - 1)).distinct())
    brief = source.select(*key, F.lower(F.array_join(_raw(), " ")).alias("whole"), F.size(_raw()).alias("n")).filter(F.col("n") < WINDOW)
    wholes = brief.join(short, "whole").select(*key, "item_id", best(F.col("n_words"), F.col("n_words"), F.lit("exact")))
    result = held.unionByName(wholes).groupBy(*key, "item_id").agg(F.max("best").alias("best"))
    return result.select(*key, "item_id", "best.n_words", "best.n_found", "best.longest_run", "best.coverage", "best.kind")


def _raw() -> Column:
    return raw_words(F.col("body"))


def _slots(rows: DataFrame, keep: list[str], place: str, value: str) -> DataFrame:
    """(``keep``, place, slot, value) for each placeholder of ``body``; values in lower case."""
    zipped = F.arrays_zip(canonical_words(F.col("body")).alias("slot"), _raw().alias("value"))
    words = rows.select(*keep, F.posexplode(zipped).alias(place, "word"))
    return words.filter(F.col("word.slot").isin(*SLOTS)).select(
        *keep, place, F.col("word.slot").alias(f"{value}_slot"), F.lower("word.value").alias(value)
    )


def _slot_verdicts(votes: DataFrame, candidates: DataFrame, one: list[str], items: DataFrame, source: DataFrame) -> DataFrame:
    """For each candidate with placeholders: do item values and text values map one to one, do they differ?"""
    mine = [f"v_{c}" for c in one]
    named = candidates.select(*[F.col(c).alias(v) for c, v in zip(one, mine)])
    asked = votes.filter("has_slot").join(named, [F.col(c).eqNullSafe(F.col(v)) for c, v in zip(one, mine)])
    spots = (
        asked.select(*mine, (F.col("at") - F.col("item_at")).alias("shift"), F.explode(F.sequence("item_at", F.col("item_at") + WINDOW - 1)).alias("spot"))
        .groupBy(*mine, "spot")
        .agg(F.min("shift").alias("shift"))
    )
    same_doc = F.col("doc_id").eqNullSafe(F.col("v_doc_id")) & (F.col("text_key") == F.col("v_text_key"))
    item_slots = _slots(items.select(F.col("item_id").alias("slot_item"), "body"), ["slot_item"], "item_spot", "item_value")
    texts = source.join(named.select("v_doc_id", "v_text_key").distinct(), same_doc, "left_semi").dropDuplicates(["doc_id", "text_key"])
    text_slots = _slots(texts.select(F.col("doc_id").alias("t_doc"), F.col("text_key").alias("t_text"), "body"), ["t_doc", "t_text"], "text_spot", "text_value")
    filled = (
        spots.join(item_slots, (F.col("v_item_id") == F.col("slot_item")) & (F.col("spot") == F.col("item_spot")))
        .join(
            text_slots,
            F.col("v_doc_id").eqNullSafe(F.col("t_doc"))
            & (F.col("v_text_key") == F.col("t_text"))
            & (F.col("spot") + F.col("shift") == F.col("text_spot")),
        )
        .select(*mine, "item_value_slot", "item_value", "text_value")
        .distinct()
    )
    source_value = F.struct("item_value_slot", "item_value")
    target_value = F.struct("item_value_slot", "text_value")
    return filled.groupBy(*mine).agg(
        (
            (F.count(F.lit(1)) == F.count_distinct(source_value)) & (F.count(F.lit(1)) == F.count_distinct(target_value))
        ).alias("consistent"),
        F.bool_or(F.col("item_value") != F.col("text_value")).alias("changed"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item of ``benchmark``, all columns as they are, whatever their names.

    A row goes if its own doc_id and text are reported by ``find_contaminated``, and then all rows that repeat it. Null
    and empty texts stay, so do rows without doc_id if their text is clean. An empty table gives an empty
    result, an empty benchmark all rows.
    """
    found = stored(find_contaminated(docs, benchmark).select("doc_id", "text_key").distinct(), "contaminated")
    own = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.join(found, docs["doc_id"].cast("long").eqNullSafe(found["doc_id"]) & (own == found["text_key"]), "left_anti")
