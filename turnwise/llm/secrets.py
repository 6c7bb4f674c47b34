"""Secrets in texts: one pass over the bytes by an automaton of all rules, then spans of the rules that occur."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from turnwise.llm.automata import DEAD, Automaton, compile_patterns


@dataclass(frozen=True)
class Rule:
    """``head`` then ``body``; a match counts if what follows its head has ``least`` characters or more."""

    kind: str
    head: str
    body: str
    least: int


# The kinds that are always looked for, in the order in which ties are listed.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", "[A-Za-z0-9+/_.=-]+", 6),
    Rule("access", "", "AKIA[A-Z0-9]+", 20),
    Rule("hex", "", "[0-9a-f]{24,}", 24),
)
MORE_RULES = (
    Rule("private_key", "", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 27),
    Rule("github", "", "gh[opsu]_[A-Za-z0-9]+", 40),
    Rule("slack", "", "xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("google", "", "AIza[A-Za-z0-9_-]+", 39),
    Rule("stripe", "", "[rs]k_(live|test)_[A-Za-z0-9]+", 24),
    Rule("jwt", "", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
)
RULES = BASE_RULES + MORE_RULES
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
ROWS_OUT = 1024


def _joined(head: str, body: str) -> str:
    if head.startswith("(?i)") and not body.startswith("(?i)"):
        return f"{head}{body}"
    return head + body


@dataclass(frozen=True)
class Scanner:
    rules: tuple[Rule, ...]
    combined: Automaton
    heads: tuple[Automaton | None, ...]
    wholes: tuple[Automaton, ...]
    backwards: tuple[Automaton, ...]

    def present(self, data: bytes) -> set[int]:
        """The rules with a match somewhere in ``data``: one pass, one look-up per byte."""
        machine = self.combined
        moves, state, first_end = machine.moves, machine.start, machine.first_end
        ended = set()
        for c in data.translate(machine.classes):
            state = moves[state + c]
            if state >= first_end:
                ended.add(state)
        return {number for s in ended for number in machine.ends[s]}

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) in code points, leftmost and non-overlapping per kind, in order of start and rule."""
        data = text.encode("utf-8", "surrogatepass")
        found = []
        for number in self.present(data):
            rule = self.rules[number]
            for start, head_end, end in matches(self.wholes[number], self.backwards[number], self.heads[number], data):
                if end - head_end >= rule.least:
                    found.append((start, number, end))
        if len(data) == len(text):
            return [(start, end, self.rules[number].kind) for start, number, end in sorted(found)]
        result, at, chars = [], 0, 0
        for start, number, end in sorted(found):
            chars += len(data[at:start].decode("utf-8", "surrogatepass"))
            at = start
            result.append((chars, chars + end - start, self.rules[number].kind))
        return result


def longest(machine: Automaton, classes: bytes, at: int) -> int:
    """Where the longest match that begins at ``at`` ends, or -1."""
    moves, state, end = machine.moves, machine.start, -1
    for i in range(at, len(classes)):
        state = moves[state + classes[i]]
        if state == DEAD:
            break
        if state >= machine.first_end:
            end = i + 1
    return end


def starts(backwards: Automaton, data: bytes) -> list[int]:
    """The places where a match starts, the last first: one pass from the end of the text."""
    moves, state, first_end = backwards.moves, backwards.start, backwards.first_end
    found, at = [], len(data)
    for c in reversed(data.translate(backwards.classes)):
        at -= 1
        state = moves[state + c]
        if state >= first_end:
            found.append(at)
    return found


def matches(whole: Automaton, backwards: Automaton, head: Automaton | None, data: bytes) -> Iterator[tuple[int, int, int]]:
    """Starts, ends of heads and ends of leftmost, longest matches that don't overlap.

    Only places where a match is known to start are followed, and what a match covers is not looked at again.
    """
    classes = data.translate(whole.classes)
    head_classes = data.translate(head.classes) if head else b""
    end = 0
    for at in reversed(starts(backwards, data)):
        if at >= end:
            end = longest(whole, classes, at)
            yield at, longest(head, head_classes, at) if head else at, end


@cache
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    """The automata of ``rules``, compiled once per Python worker."""
    wholes = [_joined(r.head, r.body) for r in rules]
    return Scanner(
        rules,
        compile_patterns(wholes, anywhere=True),
        tuple(compile_patterns([r.head], anywhere=False) if r.head else None for r in rules),
        tuple(compile_patterns([w], anywhere=False) for w in wholes),
        tuple(compile_patterns([w], anywhere=True, backwards=True) for w in wholes),
    )


def joined_spans(spans: Sequence[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All secrets of every whole text.

    Result: one row per row of ``docs``: doc_id as it is (also null), the number of matches of each base
    kind, the SHA-256 of the joined base spans, and all spans joined (``kind:start:end``, code points,
    end exclusive). A null or empty text has none: zeros, the SHA-256 of the empty string, an empty
    string. Other columns of ``docs`` are not read; an empty table gives an empty result. Work per text
    is one look-up per byte for all kinds together, and for each kind that occurs a pass backwards, which marks where
    matches start, and the reading of the matches: it grows with the length of the text, whatever stands in it.
    Memory is that of one text.
    """
    base = [r.kind for r in BASE_RULES]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = scanner(rules)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_OUT):
                rows = whole.slice(at, ROWS_OUT)
                found = [machine.spans(t or "") for t in rows.column(1).to_pylist()]
                based = [[s for s in spans if s[2] in base] for spans in found]
                counts = [pa.array([sum(s[2] == k for s in spans) for spans in based], pa.int64()) for k in base]
                hashes = [hashlib.sha256(joined_spans(s).encode()).hexdigest() for s in based]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), *counts, pa.array(hashes, pa.string()), pa.array(map(joined_spans, found), pa.string())],
                    names=["doc_id", *(f"n_{k}" for k in base), "base_sha256", "spans"],
                )

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(scan, SCHEMA)


def redacted(text: str, spans: Sequence[tuple[int, int, str]]) -> str:
    """``text`` with every stretch covered by spans replaced by the kind of the first of them."""
    parts, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            parts += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` with secrets in ``text`` replaced by ``[kind]``; all other columns as they are.

    Rows are kept in number; null texts stay null; a column ``n_chars`` is brought in line with the new
    text where it changed. Texts without a secret come back unchanged. An empty table gives an empty result.
    """
    names = docs.columns
    at, n_at = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = scanner(rules)
        for whole in batches:
            texts = whole.column(at).to_pylist()
            found = {i: s for i, t in enumerate(texts) if t and (s := machine.spans(t))}
            if found:
                columns = whole.columns
                for i, spans in found.items():
                    texts[i] = redacted(texts[i], spans)
                columns[at] = pa.array(texts, whole.column(at).type)
                if n_at is not None:
                    sizes = whole.column(n_at).to_pylist()
                    for i in found:
                        sizes[i] = len(texts[i])
                    columns[n_at] = pa.array(sizes, whole.column(n_at).type)
                whole = pa.RecordBatch.from_arrays(columns, schema=whole.schema)
            yield whole

    return docs.mapInArrow(redact, docs.schema)
