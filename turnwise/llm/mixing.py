"""Interleaving of sources to target weights by Pfair scheduling.

A source's rows are cut into blocks of equal size. With weight ``w`` its block ``i`` (from 1) is released
at ``floor((i - 1) / w)`` and due at ``ceil(i / w)``; in each slot the released block with the earliest
deadline is placed. Every block then lies between its release and its deadline, so in every prefix a
source is less than one block away from its share. Releases and deadlines are worked out in whole
numbers from the weights as they are.

The slots are cut into segments that tasks fill side by side. What earliest deadline first has placed before a
segment follows without going through the slots before it (``placed_before``), so the segments together
are the schedule that one pass over all slots would give. Rows find their slots by a join.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnwise.operators.distribution import stored

BLOCK_ROWS = 16
BUCKET_ROWS = 20_000
ROWS_OUT = 8192
SCALE = 1 << 40
SEGMENT_SLOTS = 1 << 18
# A segment's start looks back over at most as many slots as the rarest source waits for a block. Beyond this many
# (a weight below a four millionth) all slots are one segment.
MOST_SLOTS_BACK = 1 << 22
MOST_TASKS = 4096


def numbered(docs: DataFrame) -> DataFrame:
    """Rows numbered from 0 within their source, in order of a hash of doc_id, without one task per source.

    A source is cut into ranges of the hash of about ``BUCKET_ROWS`` rows; rows are numbered within a
    range and shifted by the sizes of the ranges before it, which are few.
    """
    order = F.xxhash64("doc_id")
    sizes = docs.groupBy("source").agg(F.count(F.lit(1)).alias("_rows"))
    ranges = sizes.select(F.col("source").alias("_source"), F.ceil(F.col("_rows") / BUCKET_ROWS).alias("_ranges"))
    share = (F.shiftright(order, 32) + F.lit(1 << 31)) / F.lit(float(1 << 32))
    spread = docs.join(ranges, F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id", "source", order.alias("_order"), F.floor(share * F.col("_ranges")).alias("_range")
    )
    spread = stored(spread, "mixing-rows")
    before = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        spread.groupBy("source", "_range")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(
            F.col("source").alias("_source"),
            F.col("_range").alias("_of"),
            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_shift"),
        )
    )
    within = Window.partitionBy("source", "_range").orderBy("_order", "doc_id")
    rows = spread.withColumn("_row", F.row_number().over(within) - 1)
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("_range") == F.col("_of"))
    return rows.join(shifts, same).select("doc_id", "source", (F.col("_row") + F.col("_shift")).alias("number"))


def exact_parts(weights: dict[str | None, float]) -> dict[str | None, int]:
    """Whole numbers in exactly the proportions of ``weights``, read as the decimals they are written as."""
    if not all(w > 0 for w in weights.values()):
        raise ValueError("positive weights are needed")
    exact = {s: Fraction(str(w)) for s, w in weights.items()}
    whole = math.lcm(*[w.denominator for w in exact.values()])
    return {s: int(w * whole) for s, w in exact.items()}


def placed_before(parts: list[int], slot: int) -> list[int]:
    """How many blocks of each source earliest deadline first places before ``slot``, with ``parts`` as weights.

    Of the sets of blocks that can be placed before ``slot``, no block before its release, it places the one
    with the earliest deadlines: each further slot, open to all that is released, adds the earliest block left out.
    All that is due by ``slot`` is in this set, and of each source at most one block more. So the blocks that are due
    take the first places open to them, and the others, the earliest deadline first, what is left.
    """
    total = sum(parts)
    done = [part * slot // total for part in parts]
    open_slots = slot - sum(done)
    if not open_slots:
        return done
    later = sorted((-(-(done[n] + 1) * total // part), n, done[n] * total // part) for n, part in enumerate(parts) if part * slot % total)
    # Slots before all these releases set no limit but that on the number of blocks: shares leave room there for as many.
    start = min(release for _, _, release in later)
    released = [0] * (slot - start)
    for n, part in enumerate(parts):
        block = done[n] - 1
        while block >= 0 and (release := block * total // part) >= start:
            released[release - start] += 1
            block -= 1
    # next_open[i]: an open slot at or after i, or a step towards it; the last entry stands for none.
    next_open, behind = list(range(slot - start + 1)), 0
    for at, new in enumerate(released):
        behind += new
        if behind:
            behind -= 1
            next_open[at] = at + 1
    for _, n, release in later:
        at = release - start
        while next_open[at] != at:
            next_open[at] = next_open[next_open[at]]
            at = next_open[at]
        if at < slot - start:
            next_open[at] = at + 1
            done[n] += 1
            open_slots -= 1
            if not open_slots:
                break
    return done


def schedule(
    sources: list[tuple[str | None, int, int]], first: int = 0, last: int | None = None
) -> Iterator[tuple[str | None, int, int, int, int]]:
    """(source, block, slot, release, deadline) of the blocks in slots ``first`` to before ``last``, from (source, part of the slots, blocks).

    Blocks count from 0; ties go by name, null last. A source that has run out still takes its slots.
    """
    sources = sorted(sources, key=lambda s: (s[0] is None, s[0] or ""))
    shared = math.gcd(*[part for _, part, _ in sources])
    parts = [part // shared for _, part, _ in sources]
    total, done = sum(parts), placed_before(parts, first)
    left = sum(max(blocks - n, 0) for (*_, blocks), n in zip(sources, done))
    waiting = [(block * total // parts[n], n, block) for n, block in enumerate(done)]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int, int]] = []
    slot = first
    while left and slot != last:
        while waiting and waiting[0][0] <= slot:
            release, n, block = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(block + 1) * total // parts[n]), n, block, release))
        deadline, n, block, release = heapq.heappop(ready)
        name, _, blocks = sources[n]
        if block < blocks:
            left -= 1
            yield name, block, slot, release, deadline
        heapq.heappush(waiting, ((block + 1) * total // parts[n], n, block + 1))
        slot += 1


def _segments(sources: DataFrame) -> tuple[int, int | None]:
    """How many segments the slots are cut into, and the slots in each (None for all)."""
    part = F.col("part").cast("double")
    total = sources.agg(F.sum(part)).first()[0]
    if total is None or not math.isfinite(total):
        return 1, None
    end, longest = sources.agg(F.max(F.col("blocks") * (F.lit(total) / part)), F.max(F.lit(total) / part)).first()
    if longest > MOST_SLOTS_BACK:
        return 1, None
    slots = max(SEGMENT_SLOTS, 2 * math.ceil(longest))
    return math.ceil((end * (1 + 1e-9) + 2) / slots), slots


def _plan(sources: DataFrame) -> DataFrame:
    """``schedule`` of the table (source, part, blocks) as rows, each segment made from a copy of the table."""
    n_segments, slots = _segments(sources)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = (row for b in batches for row in zip(*[c.to_pylist() for c in b.columns]))
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        names = ["plan_source", "plan_block", "slot", "release", "deadline"]
        for segment, own in itertools.groupby(entries, key=lambda row: row[0]):
            first, last = (0, None) if slots is None else (segment * slots, (segment + 1) * slots)
            rows = schedule([(s, int(p), n) for _, s, p, n in own], first, last)
            while part := list(itertools.islice(rows, ROWS_OUT)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), types)], names=names)

    schema = "plan_source string, plan_block long, slot long, release long, deadline long"
    copies = sources.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_segments - 1).cast("long"))).alias("segment"), "source", "part", "blocks")
    return copies.repartition(min(n_segments, MOST_TASKS), "segment").sortWithinPartitions("segment").mapInArrow(work, schema)


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The place of every row in an order that follows the target weights.

    ``weights`` names every source of ``docs`` (null is a source of its own), however many; without it
    the square roots of the row counts are taken. They hold in every prefix to less than one block while
    all sources last, over any number of slots; a source that has run out leaves its slots empty, and the
    others keep their proportions. No row is left out or repeated.
    Tasks that make the schedule hold one entry per source.

    Result: one row per row of ``docs``: doc_id as it is, source, block (from 0 within its source), slot,
    rank_in_block, release and deadline (release <= slot < deadline). Order by slot and rank_in_block.
    Equal doc_ids of one source take neighbouring places. A row whose source has no weight raises an error.
    An empty table gives an empty result. Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"))
    sizes = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    blocks = F.ceil(F.col("n") / block_rows).cast("long")
    if weights is None:
        part = F.round(F.sqrt("n") * F.lit(SCALE)).cast("long").cast("string")
        sources = sizes.select("source", part.alias("part"), blocks.alias("blocks"))
    else:
        own = [(s, str(part)) for s, part in exact_parts(weights).items()]
        parts = docs.sparkSession.createDataFrame(own, "part_source string, own_part string")
        known = F.when(F.col("own_part").isNull(), F.raise_error(F.lit("a source has no target weight"))).otherwise(F.col("own_part"))
        both = sizes.join(parts, F.col("source").eqNullSafe(F.col("part_source")), "full")
        sources = both.select(
            F.coalesce("source", "part_source").alias("source"), known.cast("string").alias("part"), F.coalesce(blocks, F.lit(0).cast("long")).alias("blocks")
        )
    placed = numbered(rows).withColumn("block", F.floor(F.col("number") / block_rows).cast("long"))
    same = F.col("source").eqNullSafe(F.col("plan_source")) & (F.col("block") == F.col("plan_block"))
    return placed.join(_plan(stored(sources, "mixing-sources")), same).select(
        "doc_id",
        "source",
        "block",
        "slot",
        (F.col("number") - F.col("block") * block_rows).cast("long").alias("rank_in_block"),
        "release",
        "deadline",
    )
