"""What filters do to a corpus in every order: paths through the lattice of applied filters.

A row fails a set of filters, a mask of bits; rows are counted by mask, so nothing later depends on
their number. A state of the lattice is the set of filters applied so far, an edge applies one more. What
an edge removes depends on its state alone: the rows that fail its filter and none of the state. Orders
are paths from the empty to the full set. Forward counting tells how many orders reach a state, backward
counting how many leave it; their product weighs an edge's removals in the sum over all orders (the
Shapley value, not divided), and the steps of a single order are read from the same edges.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words are runs of other characters than these; the symbols of filter D.
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = r"[#$%&*|]"
NULL_SLICES = 1024
MOST_FILTERS = 8


@dataclass(frozen=True)
class Edge:
    """Filter number ``step`` applied after the filters in ``state``; ``weight`` orders take it."""

    state: int
    step: int
    weight: int


def forward_counts(n: int) -> list[int]:
    """For each state, the number of orders in which its filters can have been applied."""
    counts = [1] + [0] * ((1 << n) - 1)
    for state in range(1, 1 << n):
        counts[state] = sum(counts[state ^ (1 << f)] for f in range(n) if state >> f & 1)
    return counts


def backward_counts(n: int) -> list[int]:
    """For each state, the number of orders in which the other filters can follow."""
    full = (1 << n) - 1
    counts = [0] * full + [1]
    for state in range(full - 1, -1, -1):
        counts[state] = sum(counts[state | (1 << f)] for f in range(n) if not state >> f & 1)
    return counts


def lattice_edges(n: int) -> list[Edge]:
    reach, leave = forward_counts(n), backward_counts(n)
    return [
        Edge(state, f, reach[state] * leave[state | 1 << f])
        for state in range(1 << n)
        for f in range(n)
        if not state >> f & 1
    ]


def order_steps(letters: str) -> Iterator[tuple[str, int, int, int]]:
    """(order, step from 1, state before it, filter number) of every order."""
    for order in permutations(range(len(letters))):
        state = 0
        for step, f in enumerate(order, 1):
            yield "".join(letters[g] for g in order), step, state, f
            state |= 1 << f


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def text_filters(text: Column, words: Column) -> list[tuple[str, Column]]:
    """The filters that look at one text, by letter: whether it fails."""
    n_words = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return [
        ("A", n_words < 200),
        ("B", 100 * F.size(F.array_distinct(words)).cast("long") < 50 * n_words.cast("long")),
        ("C", 100 * capitals.cast("long") > 3 * F.length(text).cast("long")),
        ("D", text.rlike(SYMBOLS)),
    ]


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, n_good, n_toxic): documents by language and by the set of filters A to E that they fail.

    Bits 0 to 4 of ``mask`` stand for A to E. E compares whole texts by their SHA-256: a document fails if
    a smaller doc_id has the same text anywhere in the table. Equal texts are aggregated before they are
    shuffled, so a text that a third of all rows share is no task's work.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text")
    ).select("doc_id", "part", "text", _words(F.col("text")).alias("words"))
    fails = text_filters(F.col("text"), F.col("words"))
    mask = reduce(lambda a, b: a + b, [F.when(failed, 1 << i).otherwise(0) for i, (_, failed) in enumerate(fails)])
    # Rows without an id have no label; a salt keeps them from meeting in one task of the join.
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(NULL_SLICES))).otherwise(F.lit(0).cast("long"))
    rows = rows.select("doc_id", salt.alias("salt"), "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("same"))
    known = (
        labels.filter(F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("salt"))
        .agg(
            F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
            F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"),
        )
    )
    marked = rows.join(known, ["doc_id", "salt"], "left").na.fill(0, ["good", "toxic"])
    of_id = marked.groupBy("doc_id", "salt", "part", "mask", "same", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))
    # Per text: all rows, and how many of them bear the smallest doc_id (rows without one never fail E).
    of_text = of_id.groupBy("part", "mask", "same", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_free"),
    )
    beside = of_text.withColumn("first_id", F.min("least.doc_id").over(Window.partitionBy("same")))
    first = F.when(F.col("least.doc_id") == F.col("first_id"), F.col("least.n")).otherwise(F.lit(0).cast("long"))
    passed = F.col("n_free") + F.coalesce(first, F.lit(0).cast("long"))
    cases = F.array(
        F.struct(F.col("mask").alias("mask"), passed.alias("n")),
        F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - passed).alias("n")),
    )
    split = beside.select("part", "good", "toxic", F.inline(cases)).filter("n > 0")
    return split.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("n_good"), F.sum(F.col("n") * F.col("toxic")).alias("n_toxic")
    )


def audit_orders(counts: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """The audit of every order of the filters from rows (part, mask, n, n_good, n_toxic).

    Bit i of ``mask`` says that a row fails the filter named by letter i. Result: a row per part, order and
    step (see ``audit_filters``). At most eight filters: eight have 40,320 orders.
    """
    n = len(letters)
    if n > MOST_FILTERS:
        raise ValueError(f"{n} filters have too many orders to list")
    spark = counts.sparkSession
    edges = lattice_edges(n)
    edge = F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in vars(e).items()]) for e in edges])).alias("edge")
    step = F.call_function("shiftleft", F.lit(1), F.col("edge.step"))
    fails = F.col("mask").bitwiseAND(step) != 0
    passed_before = F.col("mask").bitwiseAND(F.col("edge.state")) == 0
    removed = fails & passed_before

    def total(when: Column, what: str) -> Column:
        return F.sum(F.when(when, F.col(what)).otherwise(F.lit(0).cast("long")))

    of_edge = counts.select("*", edge).groupBy("part", "edge").agg(
        total(passed_before & ~fails, "n").alias("kept"),
        total(removed, "n").alias("removed"),
        total(fails & ~passed_before, "n").alias("redundant"),
        total(F.col("mask") == step, "n").alias("unique_fails"),
        total(removed, "n_good").alias("good_lost"),
        total(removed, "n_toxic").alias("toxic_lost"),
    )
    shapley = of_edge.groupBy("part", F.col("edge.step").alias("f")).agg(F.sum(F.col("removed") * F.col("edge.weight")).alias("shapley"))
    steps = spark.createDataFrame([*order_steps(letters)], "filter_order string, step int, state int, f int")
    values = of_edge.select("part", "edge.state", F.col("edge.step").alias("f"), *of_edge.columns[2:])
    return (
        values.join(shapley, ["part", "f"])
        .join(F.broadcast(steps), ["state", "f"])
        .select("part", "filter_order", "step", *of_edge.columns[2:], "shapley")
    )


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """How filters A to E act on each other, for every language and every order.

    A document fails A with fewer than 200 words, B if less than half of its words are distinct, C if more
    than three in a hundred characters are ``A`` to ``Z``, D if it holds one of ``#$%&*|``, E if a smaller
    doc_id has the same text. Result: a row per part (the languages of ``docs``; null is the empty string),
    filter_order (all 120) and step (1 to 5), with the documents of the part that are kept after the step,
    removed in it, redundant (fail its filter but went before), unique_fails (fail its filter alone), good
    and toxic ones removed, and shapley, what its filter removes in all orders together.

    A null text is an empty one. A document without doc_id never fails E and has no label; repeated rows
    count each, and do not make each other fail E. Of repeated labels one that says 1 is enough; other
    values and nulls say nothing. Other columns are not read. An empty table gives no rows. Work per text is
    one pass of SQL functions; what is shuffled is an id, a hash and some bits per document.
    """
    return audit_orders(failure_counts(docs, labels))
