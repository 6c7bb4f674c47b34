"""Regular expressions over bytes compiled into one minimal deterministic automaton.

The dialect is small: literals, ``\\xHH`` and escaped characters, ``[...]`` classes with ranges,
``(...)``, ``|``, ``?``, ``*``, ``+``, ``{m}``, ``{m,}``, ``{m,n}`` and a leading ``(?i)``.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

DEAD = -1


def _both_cases(chars: frozenset[int]) -> frozenset[int]:
    return frozenset(x for c in chars for x in (ord(chr(c).lower()), ord(chr(c).upper())) if x < 128) | chars


class _Parser:
    """A pattern as nested tuples: ("set", bytes), ("cat", parts), ("alt", parts), ("rep", part, least, most)."""

    def __init__(self, pattern: str):
        self.any_case = pattern.startswith("(?i)")
        self.text = pattern.removeprefix("(?i)")
        self.at = 0

    def tree(self) -> tuple:
        found = self._alternatives()
        if self.at != len(self.text):
            raise ValueError(f"unexpected {self.text[self.at]!r} in {self.text!r}")
        return found

    def _next(self) -> str:
        char = self.text[self.at : self.at + 1]
        self.at += 1
        return char

    def _sees(self, char: str) -> bool:
        return self.text.startswith(char, self.at)

    def _alternatives(self) -> tuple:
        parts = [self._sequence()]
        while self._sees("|"):
            self.at += 1
            parts.append(self._sequence())
        return ("alt", parts)

    def _sequence(self) -> tuple:
        parts = []
        while self.at < len(self.text) and not self._sees("|") and not self._sees(")"):
            parts.append(self._repeated(self._atom()))
        return ("cat", parts)

    def _repeated(self, part: tuple) -> tuple:
        for sign, least, most in (("?", 0, 1), ("*", 0, None), ("+", 1, None)):
            if self._sees(sign):
                self.at += 1
                return ("rep", part, least, most)
        if self._sees("{"):
            inner = self.text[self.at + 1 : self.text.index("}", self.at)]
            self.at += len(inner) + 2
            low, comma, high = inner.partition(",")
            return ("rep", part, int(low), int(high) if high else None if comma else int(low))
        return part

    def _atom(self) -> tuple:
        if self._sees("("):
            self.at += 1
            part = self._alternatives()
            self.at += 1
            return part
        if self._sees("["):
            self.at += 1
            return self._set(self._class())
        return self._set(frozenset([self._char()]))

    def _set(self, chars: frozenset[int]) -> tuple:
        return ("set", _both_cases(chars) if self.any_case else chars)

    def _char(self) -> int:
        char = self._next()
        if char == "\\" and self._sees("x"):
            self.at += 3
            return int(self.text[self.at - 2 : self.at], 16)
        return ord(self._next() if char == "\\" else char)

    def _class(self) -> frozenset[int]:
        chars: set[int] = set()
        while not self._sees("]"):
            low = self._char()
            if self._sees("-") and self.text[self.at + 1] != "]":
                self.at += 1
                chars.update(range(low, self._char() + 1))
            else:
                chars.add(low)
        self.at += 1
        return frozenset(chars)


def _mirrored(tree: tuple) -> tuple:
    """The tree of all matches read from their ends."""
    kind = tree[0]
    if kind == "set":
        return tree
    if kind == "rep":
        return ("rep", _mirrored(tree[1]), *tree[2:])
    parts = [_mirrored(part) for part in tree[1]]
    return (kind, parts[::-1] if kind == "cat" else parts)


class _Nfa:
    def __init__(self) -> None:
        self.silent: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.silent.append([])
        self.moves.append([])
        return len(self.silent) - 1

    def add(self, tree: tuple, start: int) -> int:
        """Add what ``tree`` matches from ``start`` on; the state where it ends."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            self.moves[start].append((tree[1], end))
            return end
        if kind == "cat":
            for part in tree[1]:
                start = self.add(part, start)
            return start
        if kind == "alt":
            ends = []
            for part in tree[1]:
                inner = self.state()
                self.silent[start].append(inner)
                ends.append(self.add(part, inner))
            end = self.state()
            for e in ends:
                self.silent[e].append(end)
            return end
        _, part, least, most = tree
        for _ in range(least):
            start = self.add(part, start)
        if most is None:
            loop = self.state()
            self.silent[start].append(loop)
            self.silent[self.add(part, loop)].append(loop)
            end = self.state()
            self.silent[loop].append(end)
            return end
        end = self.state()
        self.silent[start].append(end)
        for _ in range(most - least):
            start = self.add(part, start)
            self.silent[start].append(end)
        return end

    def closed(self, states: Iterable[int]) -> frozenset[int]:
        found, todo = set(), list(states)
        while todo:
            s = todo.pop()
            if s not in found:
                found.add(s)
                todo.extend(self.silent[s])
        return frozenset(found)


@dataclass(frozen=True)
class Automaton:
    """``moves[state + class]`` is the next state or ``DEAD``; states are multiples of the number of classes.

    ``classes`` turns bytes into classes by ``bytes.translate``. States from ``first_end`` on end at
    least one pattern; ``ends[state]`` are the numbers of these patterns.
    """

    classes: bytes
    moves: list[int]
    start: int
    first_end: int
    ends: dict[int, tuple[int, ...]]
    n_states: int


def _byte_classes(nfa: _Nfa) -> tuple[bytes, list[int]]:
    """Bytes that no pattern tells apart form one class; the class of each byte and a byte of each class."""
    sets = list({chars for moves in nfa.moves for chars, _ in moves})
    seen: dict[tuple[bool, ...], int] = {}
    table, samples = [], []
    for byte in range(256):
        kind = tuple(byte in s for s in sets)
        if kind not in seen:
            seen[kind] = len(seen)
            samples.append(byte)
        table.append(seen[kind])
    return bytes(table), samples


def _minimal(moves: list[list[int]], ends: list[tuple[int, ...]]) -> list[int]:
    """The block of each state: two states share one if no text tells them apart."""
    names: dict = {}
    block = [names.setdefault(e, len(names)) for e in ends]
    while True:
        names = {}
        finer = [
            names.setdefault((block[s], *(block[t] if t >= 0 else DEAD for t in row)), len(names))
            for s, row in enumerate(moves)
        ]
        if len(set(finer)) == len(set(block)):
            return block
        block = finer


def compile_patterns(patterns: Sequence[str], anywhere: bool, backwards: bool = False) -> Automaton:
    """One automaton for all patterns, by subset construction and minimisation.

    With ``anywhere`` a match may begin at every byte, no state is dead, and a pattern that has just
    ended begins anew: enough to know which patterns occur, with few states. Otherwise matches begin
    at the first byte and run on as far as they can.

    With ``backwards`` texts are read from their end, a match may end at every byte, and the automaton is in a
    state that ends a pattern wherever one of its matches starts, also while others go on.
    """
    nfa = _Nfa()
    start = nfa.state()
    end_of, owner = {}, {}
    for number, pattern in enumerate(patterns):
        inner = nfa.state()
        nfa.silent[start].append(inner)
        tree = _Parser(pattern).tree()
        end_of[nfa.add(_mirrored(tree) if backwards else tree, inner)] = number
        owner.update((s, number) for s in range(inner, len(nfa.silent)))
    classes, samples = _byte_classes(nfa)
    first = nfa.closed([start])
    numbers = {first: 0}
    todo, moves, ends = deque([first]), [], []
    while todo:
        states = todo.popleft()
        ends.append(tuple(sorted(end_of[s] for s in states if s in end_of)))
        row = []
        for byte in samples:
            to = nfa.closed(t for s in states for chars, t in nfa.moves[s] if byte in chars)
            if backwards:
                to = first | to
            elif anywhere:
                over = {end_of[s] for s in to if s in end_of}
                to = first | {s for s in to if s in end_of or owner[s] not in over}
            if not to:
                row.append(DEAD)
                continue
            if to not in numbers:
                numbers[to] = len(numbers)
                todo.append(to)
            row.append(numbers[to])
        moves.append(row)
    block = _minimal(moves, ends)
    of_block = {b: s for s, b in reversed([*enumerate(block)])}
    ordered = sorted(of_block, key=lambda b: (bool(ends[of_block[b]]), b))
    width = len(samples)
    place = {b: i * width for i, b in enumerate(ordered)}
    flat = [
        place[block[t]] if t >= 0 else DEAD for b in ordered for t in moves[of_block[b]]
    ]
    finals = {place[b]: ends[of_block[b]] for b in ordered if ends[of_block[b]]}
    return Automaton(classes, flat, place[block[0]], min(finals), finals, len(ordered))
