"""Repair of conversation structure: the lightest derivation of a well-formed conversation.

A conversation is well formed if the initials of its roles read ``s?(ua)+``, or if it is empty. Rows are
kept, given another role, or deleted, and empty rows are inserted, at least cost.

Deductions. An item (i, q) says that the rows from the i-th on can be made to continue an output that is in
state q, with a weight (cost, audit): the price and the initials of the edits, in order. Axioms are the ends
at which the output may stop, and the edits of each row with their prices. A deduction joins an edit with
the item that holds after it: its weight is the sum of the costs and the edit's letter before the audit.

Knuth's agenda pops items by weight and finalises each at its first pop. That is right for superior
functions: a result must not weigh less than what it is made from, and must not fall if that rises. Costs
never fall; Keep costs nothing, but covers one row more. So weights are ordered by cost, then by rows
covered, then by audit: within one item rows covered are equal, so there it is (cost, audit) that decides.
Two deductions of one item never begin with the same letter, so letters decide between audits.

Conversations of ordinary size are repaired whole. Larger ones are cut into pieces: the agenda gives, per
piece, the least cost between any two states; these are added up from the end, which tells every piece
what its exits cost; each piece is then repaired alone, towards these exits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.operators.distribution import stored

# States of the output by the last role's initial, prices, and the faults of rows.
START, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = ("", "s", "u", "a")
ROLES = ("", "", "user", "assistant")
DELETE, REROLE, INSERT, TRUNCATED_KEPT = 4, 3, 3, 3
BLANK, DUPLICATE, TRUNCATED, SOUND = "blank", "duplicate", "truncated", ""
SPACES = " \t\n\x0b\x0c\r"
ENDS = (0, None, None, 0)  # an output may stop before its first row or after an assistant's
BEFORE = ((), (START,), (START, SYSTEM, ASSISTANT), (USER,))  # the states that a state can follow
LEGAL_PAIRS = ("su", "ua", "au")

HOT_ROWS, HOT_CHARS = 16_384, 1 << 24
PIECE_ROWS = 4096
PREFIX = 64
ROWS_OUT = 1024
ROW_SCHEMA = "conv_id long, place long, step int, turn long, role string, text string, edit string, fault string, role_before string"
DIGEST_SCHEMA = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)
Goals = Sequence[int | None]


@dataclass(frozen=True)
class Lightest:
    """Finalised items: cost, letter of the first edit, and the item after it."""

    items: dict[int, tuple[int, str, int]]

    def cost(self, state: int) -> int | None:
        return self.items[state][0] if state in self.items else None

    def path(self, state: int) -> Iterator[tuple[str, int]]:
        """(letter, state of the output after it) from ``state`` before the first row on."""
        _, letter, item = self.items[state]
        while letter:
            yield letter, item % 4
            _, letter, item = self.items[item]

    def exit(self, state: int) -> int:
        """The state in which the edits end."""
        for _, state in self.path(state):
            pass
        return state


def lightest(rows: Sequence[tuple[str, str]], goals: Goals = ENDS, wanted: Sequence[int] = (START,)) -> Lightest:
    """The lightest derivations of the items before the first row, for rows of (role's initial, fault).

    ``goals`` is what stopping in each state costs, None if it is not allowed; the agenda stops when the
    items ``wanted`` are final. An item is the number 4 i + q.
    """
    agenda = sorted((cost, 0, "", 4 * len(rows) + q, -1) for q, cost in enumerate(goals) if cost is not None)
    final: dict[int, tuple[int, str, int]] = {}
    missing = set(wanted)
    while agenda and missing:
        cost, covered, letter, item, after = heappop(agenda)
        if item in final:
            continue
        final[item] = cost, letter, after
        missing.discard(item)
        i, q = divmod(item, 4)
        if q >= USER:
            for p in BEFORE[q]:
                if 4 * i + p not in final:
                    heappush(agenda, (cost + INSERT, covered, "I", 4 * i + p, item))
        if not i:
            continue
        initial, fault = rows[i - 1]
        before = 4 * (i - 1)
        heappush(agenda, (cost + DELETE, covered + 1, "D", before + q, item))
        if fault in (BLANK, DUPLICATE) or not q:
            continue
        price = cost + (TRUNCATED_KEPT if fault == TRUNCATED else 0)
        for p in BEFORE[q]:
            if initial == INITIALS[q]:
                heappush(agenda, (price, covered + 1, "K", before + p, item))
            if q >= USER:
                heappush(agenda, (price + REROLE, covered + 1, "R", before + p, item))
    return Lightest(final)


def edited(path: Iterator[tuple[str, int]], places: Sequence[int]) -> Iterator[tuple[int, int, int, str, str | None]]:
    """(number of the row, place, step, edit, new role or None) per edit; inserted rows stand at the next row's
    place, or the last's, in the order of their steps."""
    at, step, last = 0, 0, len(places) - 1
    for letter, state in path:
        number = min(at, last)
        yield number, places[number], step, letter, ROLES[state] if letter in "RI" else None
        step += 1
        if letter != "I":
            at += 1
            step = 0 if at <= last else step


def faults_of(rows: Sequence[tuple[str, str]]) -> list[str]:
    """The first fault of each (role, text), in order."""
    seen, found = set(), []
    for row in rows:
        text = row[1].strip(SPACES)
        found.append(BLANK if not text else DUPLICATE if row in seen else SOUND if text[-1] in ".!?" else TRUNCATED)
        seen.add(row)
    return found


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """(key, columns) per run of rows with equal first ``n_keys`` columns, also across batches."""
    key, held = None, None
    for whole in batches:
        columns = [c.to_pylist() for c in whole.columns]
        at = 0
        for i, new in enumerate(zip(*columns[:n_keys])):
            if new != key or held is None:
                if held is not None:
                    for kept, column in zip(held, columns):
                        kept += column[at:i]
                    yield key, held
                key, held, at = new, [[] for _ in columns], i
        if held is not None:
            for kept, column in zip(held, columns):
                kept += column[at:]
    if held is not None:
        yield key, held


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in schema.split(", "))])


def _batches(rows: Iterator[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    fields, held = _arrow(schema), []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), fields)], schema=fields)

    for row in rows:
        held.append(row)
        if len(held) >= ROWS_OUT:
            yield batch()
            held = []
    if held:
        yield batch()


def _map_groups(df: DataFrame, n_keys: int, work: Callable[[tuple, list[list]], Iterator[tuple]], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches((row for key, columns in _groups(batches, n_keys) for row in work(key, columns)), schema)

    return df.mapInArrow(run, schema)


def _whole(rows: DataFrame) -> DataFrame:
    """Conversations of ordinary size, each repaired at once."""

    def repair(key: tuple, columns: list[list]) -> Iterator[tuple]:
        _, turns, roles, texts = columns
        faults = faults_of([*zip(roles, texts)])
        path = lightest([(r[:1], f) for r, f in zip(roles, faults)]).path(START)
        for i, place, step, edit, role in edited(path, range(len(roles))):
            if edit == "I":
                yield *key, place, step, None, role, "", edit, SOUND, None
            else:
                yield *key, place, step, turns[i], role or roles[i], texts[i], edit, faults[i], roles[i]

    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return _map_groups(dealt, 1, repair, ROW_SCHEMA)


def _fault(text: Column, is_first: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACES))
    return (
        F.when(trimmed == "", BLANK).when(~is_first, DUPLICATE).when(F.right(trimmed, F.lit(1)).isin(".", "!", "?"), SOUND).otherwise(TRUNCATED)
    )


def _in_pieces(rows: DataFrame, piece_rows: int) -> DataFrame:
    """Very long conversations, piece by piece; every step is written, none holds a conversation."""
    order = ["conv_id", "turn", "role"]
    sorted_rows = rows.repartitionByRange(*order, F.substring("text", 1, PREFIX)).sortWithinPartitions(*order, "text")
    placed = stored(sorted_rows.select(F.monotonically_increasing_id().alias("place"), "*"), "placed-turns")

    key = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    firsts = placed.groupBy("conv_id", key.alias("same")).agg(F.min("place").alias("place")).select("place", F.lit(True).alias("is_first"))
    facts = placed.select("conv_id", "place", F.substring("role", 1, 1).alias("initial"), "text").join(firsts, "place", "left")
    facts = stored(
        facts.select(
            "conv_id",
            F.floor(F.col("place") / piece_rows).alias("piece"),
            "place",
            "initial",
            _fault(F.col("text"), F.coalesce("is_first", F.lit(False))).alias("fault"),
        ),
        "turn-faults",
    )

    def by_piece(df: DataFrame) -> DataFrame:
        return df.repartition("conv_id", "piece").sortWithinPartitions("conv_id", "piece", "place")

    def beside(df: DataFrame, other: DataFrame) -> DataFrame:
        renamed = other.withColumnsRenamed({"conv_id": "_conv", "piece": "_piece"})
        same = df["conv_id"].eqNullSafe(renamed["_conv"]) & (df["piece"] == renamed["_piece"])
        return df.join(renamed, same).drop("_conv", "_piece")

    def between(key: tuple, columns: list[list]) -> Iterator[tuple]:
        rows, costs = [*zip(columns[3], columns[4])], []
        for end in range(4):
            found = lightest(rows, [0 if q == end else None for q in range(4)], range(4))
            costs += [found.cost(q) for q in range(4)]
        yield *key, costs

    def ends(key: tuple, columns: list[list]) -> Iterator[tuple]:
        goals = [*ENDS]
        for piece, costs in zip(columns[1], columns[2]):
            yield *key, piece, goals
            ways = [[(costs[4 * r + q], goals[r]) for r in range(4)] for q in range(4)]
            goals = [min((a + b for a, b in way if a is not None and b is not None), default=None) for way in ways]

    def exits(key: tuple, columns: list[list]) -> Iterator[tuple]:
        found = lightest([*zip(columns[3], columns[4])], columns[5][0], range(4))
        yield *key, [found.exit(q) if q in found.items else None for q in range(4)]

    def entries(key: tuple, columns: list[list]) -> Iterator[tuple]:
        state = START
        for piece, after in zip(columns[1], columns[2]):
            yield *key, piece, state
            state = after[state]

    def repair(key: tuple, columns: list[list]) -> Iterator[tuple]:
        entry = columns[6][0]
        found = lightest([*zip(columns[3], columns[4])], columns[5][0], (entry,))
        for i, place, step, edit, role in edited(found.path(entry), columns[2]):
            yield place, step, edit, role, SOUND if edit == "I" else columns[4][i]

    costs = _map_groups(by_piece(facts), 2, between, "conv_id long, piece long, costs array<long>")
    backward = costs.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("piece"))
    goals = stored(_map_groups(backward, 1, ends, "conv_id long, piece long, goals array<long>"), "piece-goals")
    left = _map_groups(by_piece(beside(facts, goals)), 2, exits, "conv_id long, piece long, after array<long>")
    forward = left.repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    entered = _map_groups(forward, 1, entries, "conv_id long, piece long, entry long")
    edits = _map_groups(
        by_piece(beside(beside(facts, goals), entered)), 2, repair, "place long, step int, edit string, new_role string, fault string"
    )
    inserted = F.col("edit") == "I"
    return edits.join(placed, "place").select(
        "conv_id",
        "place",
        "step",
        F.when(~inserted, F.col("turn")).alias("turn"),
        F.coalesce("new_role", "role").alias("role"),
        F.when(inserted, "").otherwise(F.col("text")).alias("text"),
        "edit",
        "fault",
        F.when(~inserted, F.col("role")).alias("role_before"),
    )


def _repaired(rows: DataFrame, hot_rows: int, hot_chars: int, piece_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """Repaired rows of ordinary conversations, in order within their partitions, and of very long ones, in none."""
    turns = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")],
    )
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars"))
    hot = sizes.filter((F.col("n") > hot_rows) | (F.col("n_chars") > hot_chars)).select(F.col("conv_id").alias("_hot"))
    hot = stored(hot, "long-conversations")
    if hot.isEmpty():
        return _whole(turns), None
    is_hot = F.col("conv_id").eqNullSafe(F.col("_hot"))
    return _whole(turns.join(hot, is_hot, "left_anti")), _in_pieces(turns.join(hot, is_hot, "left_semi"), piece_rows)


def repair_conversations(
    rows: DataFrame, hot_rows: int = HOT_ROWS, hot_chars: int = HOT_CHARS, piece_rows: int = PIECE_ROWS
) -> DataFrame:
    """The rows of every conversation with the cheapest edits that make it well formed.

    ``rows`` has conv_id, turn, role and text; a conversation is read by turn, nulls first, then by role and
    text. A row is faulty, by the first that holds, if it is blank, if role and text were seen earlier, or
    if its last character that is no blank is not one of ``.!?`` (truncated). Keep (K) costs 0; another role
    (R, user or assistant) 3; Delete (D) 4 and must happen to blank and duplicate rows; Insert (I) of an empty
    row 3; a truncated row that stays costs 3. Of equally cheap ways that with the ASCII-least initials is taken.

    Result: one row per edit: conv_id, place and step (their order in the conversation), turn, role and text
    after the edit, edit, fault (empty if none) and role_before. Rows without ``D`` are the repaired
    conversation; inserted rows have neither turn nor role_before. A null role or text is one blank; a null
    conv_id is a conversation of its own. Repeated rows are duplicates. Other columns are not read; an empty
    table gives an empty result.

    A conversation of up to ``hot_rows`` rows and ``hot_chars`` characters is one task's work; a longer one is
    sorted by range and repaired in pieces of at most ``piece_rows`` rows, with the same result.
    """
    whole, pieces = _repaired(rows, hot_rows, hot_chars, piece_rows)
    return whole if pieces is None else whole.unionByName(pieces)


def _digest(rows: DataFrame) -> DataFrame:
    """A row per conversation from rows that come in order, holding no more than one of its texts and its audit."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def conversations() -> Iterator[tuple]:
            key, seen = None, None
            for batch in batches:
                conv_ids, _, _, turns, roles, texts, edits, faults, befores = (c.to_pylist() for c in batch.columns)
                for i, conv_id in enumerate(conv_ids):
                    if seen is None or conv_id != key:
                        if seen is not None:
                            yield key, *seen.row()
                        key, seen = conv_id, _Seen()
                    seen.add(turns[i], roles[i], texts[i], edits[i], faults[i], befores[i])
            if seen is not None:
                yield key, *seen.row()

        return _batches(conversations(), DIGEST_SCHEMA)

    return rows.mapInArrow(digest, DIGEST_SCHEMA)


class _Seen:
    """What a digest keeps of the rows so far."""

    def __init__(self) -> None:
        self.first = self.last = self.initial = None
        self.n_turns = self.illegal = self.cost = self.n_left = 0
        self.faults = dict.fromkeys((BLANK, DUPLICATE, TRUNCATED), 0)
        self.audit: list[str] = []
        self.hash = hashlib.sha256()

    def add(self, turn: int | None, role: str, text: str, edit: str, fault: str, before: str | None) -> None:
        self.audit.append(edit)
        self.cost += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[edit]
        if edit != "D":
            self.cost += TRUNCATED_KEPT if fault == TRUNCATED else 0
            self.hash.update(f"{chr(10) if self.n_left else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            self.n_left += 1
        if edit == "I":
            return
        if fault:
            self.faults[fault] += 1
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last = turn
            self.n_turns += 1
        initial = before[:1]
        self.illegal += self.initial is not None and self.initial + initial not in LEGAL_PAIRS
        self.initial = initial

    def row(self) -> tuple:
        gaps = self.last - self.first + 1 - self.n_turns if self.n_turns else 0
        return gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


def conversation_digests(
    rows: DataFrame, conv_ids: DataFrame, hot_rows: int = HOT_ROWS, hot_chars: int = HOT_CHARS, piece_rows: int = PIECE_ROWS
) -> DataFrame:
    """One row per conv_id of ``conv_ids``: what is wrong with the conversation in ``rows`` and how it is repaired.

    Columns: gaps (turn numbers missing between the first and the last), blank, duplicate and truncated rows,
    illegal (neighbours whose roles do not follow each other), cost, audit (the edits' initials in order) and
    repaired_sha256 of the repaired ``role:text`` lines. A conversation without rows has zeros, an empty audit
    and the hash of the empty string. A hash is made in order, so a very long conversation is read by one
    task, but as a stream: it keeps one row, and the audit.
    """
    whole, pieces = _repaired(rows, hot_rows, hot_chars, piece_rows)
    found = _digest(whole)
    if pieces is not None:
        found = found.unionByName(_digest(pieces.repartition("conv_id").sortWithinPartitions("conv_id", "place", "step")))
    every = conv_ids.select(F.col("conv_id").cast("long").alias("_conv")).distinct()
    joined = every.join(found, F.col("_conv").eqNullSafe(F.col("conv_id")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in found.columns[1:7]]
    empty = hashlib.sha256(b"").hexdigest()
    return joined.select(
        F.col("_conv").alias("conv_id"),
        *counts,
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"),
    )


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with faults planted by a hash of conv_id and turn; nulls are one blank.

    Of twenty rows one is dropped, one emptied, one loses its ``.!?``, one is repeated and one becomes the user's.
    """
    blank = F.lit(" ")
    conv_id, turn, role, text = (F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn", "role", "text"))
    name = F.concat(conv_id, F.lit(":"), turn)
    fate = F.crc32(name.cast("binary")) % 20
    kept = rows.select(
        "conv_id",
        "turn",
        F.when(fate == 4, "user").otherwise(role).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        fate.alias("fate"),
    ).filter("fate <> 0")
    copies = F.explode(F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return kept.select("conv_id", "turn", "role", "text", copies.alias("copy")).drop("copy")
