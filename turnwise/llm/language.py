"""Language of texts by cross parsing: the language whose sample needs the fewest phrases wins.

A phrase is the longest stretch that occurs somewhere in a language's sample; a text is parsed into
phrases from left to right. Every stretch of a sample is a path of its suffix automaton from the start,
so a parse is one walk: follow the path as long as it goes on, else count a phrase and start anew. The
transitions lie interleaved in one array per language, whose size does not depend on the alphabet. Many
stretches of text walk side by side in NumPy; where a stretch was entered in another state than the one
before it was left in, it is walked again, so counts are those of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
UNDETERMINED = "und"
SPACE, OTHER = 0, 1
BLOCK = 1024
# Symbols before a block that are walked first: nearly always enough to come to the state of the whole parse.
WARM_UP = 128
LANES = 4096
PIECE = 200
ROWS_OUT = 512


@dataclass(frozen=True)
class Settings:
    """Bounds of the sample: documents per language, characters per document, characters per language.

    A text that is longer than ``chars_per_doc`` gives pieces of ``PIECE`` characters from all over it."""

    docs_per_language: int = 60
    chars_per_doc: int = 4_000
    chars_per_language: int = 24_000


def letters_of(text: str) -> np.ndarray:
    """Lower-cased code points of ``text``; each run of anything but letters is one space (0)."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kept = np.where(_is_letter()[codes], codes, SPACE)
    return kept[np.r_[True, (kept[1:] != SPACE) | (kept[:-1] != SPACE)]] if len(kept) else kept


_LETTERS: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def suffix_automaton(sample: list[int]) -> list[dict[int, int]]:
    """The transitions of the suffix automaton of ``sample``; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, longest, last = [-1], [0], 0
    for c in sample:
        new = len(moves)
        moves.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if longest[p] + 1 == longest[q]:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                longest.append(longest[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return moves


@dataclass(frozen=True)
class Parser:
    """The automaton of one sample: from ``state`` the symbol ``c`` leads to ``to[base[state] + c]`` if
    ``owner[base[state] + c]`` is the state; otherwise a new phrase begins and leads to ``first[c]``. In state 0
    each symbol begins a phrase; symbols that the sample does not hold lead there."""

    base: np.ndarray
    owner: np.ndarray
    to: np.ndarray
    first: np.ndarray


@dataclass(frozen=True)
class Model:
    """``classes`` turns code points into symbols, which all ``parsers`` share."""

    languages: list[str]
    classes: np.ndarray
    parsers: list[Parser]
    weights: np.ndarray


def compiled(moves: list[dict[int, int]], width: int) -> Parser:
    """The transitions ``moves`` over ``width`` symbols, each state's laid into gaps of the others'."""
    first = np.zeros(width, np.int32)
    for symbol, to in moves[0].items():
        first[symbol] = to
    size = sum(map(len, moves)) * 2 + 2 * width
    owner, to = np.full(size, -1, np.int32), np.zeros(size, np.int32)
    base = np.zeros(len(moves), np.int64)
    several = sorted((s for s in range(1, len(moves)) if len(moves[s]) > 1), key=lambda s: -len(moves[s]))
    open_from = width
    for state in several:
        symbols = np.fromiter(moves[state], np.int64, len(moves[state]))
        at, look = open_from, 256
        while True:
            if at + look + width > len(owner):
                owner, to = np.r_[owner, np.full(size, -1, np.int32)], np.r_[to, np.zeros(size, np.int32)]
            gaps = at + np.flatnonzero(owner[at : at + look] < 0)
            bases = gaps - symbols.min()
            fitting = np.flatnonzero((owner[bases[:, None] + symbols] < 0).all(1))
            if len(fitting):
                break
            at, look = at + look, 2 * look
        base[state] = bases[fitting[0]]
        owner[base[state] + symbols] = state
        to[base[state] + symbols] = np.fromiter(moves[state].values(), np.int64, len(symbols))
        if owner[open_from : open_from + 256].min() >= 0:
            open_from += 256
    single = [s for s in range(1, len(moves)) if len(moves[s]) == 1]
    gaps = width + np.flatnonzero(owner[width : len(owner) - width] < 0)
    if len(gaps) < len(single):
        more = len(single) - len(gaps) + width
        owner, to = np.r_[owner, np.full(more, -1, np.int32)], np.r_[to, np.zeros(more, np.int32)]
        gaps = width + np.flatnonzero(owner[width : len(owner) - width] < 0)
    for state, gap in zip(single, gaps.tolist()):
        ((symbol, target),) = moves[state].items()
        base[state], owner[gap], to[gap] = gap - symbol, state, target
    used = int(base.max()) + width
    return Parser(base, owner[:used].copy(), to[:used].copy(), first)


def train(samples: dict[str, list[str]], settings: Settings = Settings()) -> Model:
    """One automaton per language from its sample texts, joined by spaces and cut at the bound."""
    languages = sorted(samples)
    codes = []
    for language in languages:
        parts = [np.append(letters_of(t), SPACE) for t in samples[language]]
        whole = np.concatenate([*parts, np.array([SPACE])])
        codes.append(whole[: settings.chars_per_language])
    alphabet = np.unique(np.concatenate([*codes, np.array([SPACE])]))
    classes = np.full(0x110000, OTHER, np.int32)
    classes[alphabet] = np.arange(len(alphabet)) + 2
    classes[SPACE] = SPACE
    parsers = [compiled(suffix_automaton(classes[own].tolist()), len(alphabet) + 2) for own in codes]
    return Model(languages, classes, parsers, np.log2([len(own) + 2.0 for own in codes]))


def _walk(parser: Parser, grid: np.ndarray, sizes: np.ndarray, warm_up: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """State after ``warm_up`` steps, state at the end and phrases in between of each lane (column) of ``grid``.

    Lanes begin in state 0 and are sorted by ``sizes``, the longest first."""
    state, found = np.zeros(grid.shape[1], np.int64), np.zeros(grid.shape[1], np.int64)
    entry = state.copy()
    alive = np.searchsorted(-sizes, -np.arange(len(grid)), side="left")
    for step, symbols in enumerate(grid):
        if step == warm_up:
            entry, found = state.copy(), np.zeros_like(found)
        n = alive[step]
        now, symbol = state[:n], symbols[:n]
        at = parser.base[now] + symbol
        goes_on = parser.owner[at] == now
        goes_on &= now > 0
        found[:n] += ~goes_on
        state[:n] = np.where(goes_on, parser.to[at], parser.first[symbol])
    return entry, state, found


def _follow(parser: Parser, state: int, symbols: np.ndarray) -> tuple[int, int]:
    """State at the end and number of phrases that begin when ``symbols`` are read from ``state`` on."""
    base, owner, to, first, found = parser.base, parser.owner, parser.to, parser.first, 0
    for symbol in symbols.tolist():
        at = base[state] + symbol
        if state and owner[at] == state:
            state = to[at]
        else:
            state = first[symbol]
            found += 1
    return state, found


def phrases(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """The number of phrases of each whole text (rows) in each language (columns).

    Texts are walked in blocks, so that one long text is as quick as many short ones. A block is entered in
    the state that the symbols just before it lead to; if the block before it ends in another one, as repetitive texts
    can make it, it is walked again from there, so each symbol is read at most twice. A symbol that a
    sample does not hold is a phrase of its own.
    """
    counts = np.zeros((len(texts), len(model.parsers)), np.int64)
    symbols = [model.classes[t] for t in texts]
    blocks = [(i, at) for i, t in enumerate(symbols) for at in range(0, len(t), BLOCK)]
    owners = np.array([i for i, _ in blocks], np.int64)
    entry, leave, found = (np.zeros((len(blocks), len(model.parsers)), np.int64) for _ in range(3))
    for warm_up, group in ((0, [k for k, (_, at) in enumerate(blocks) if not at]), (WARM_UP, [k for k, (_, at) in enumerate(blocks) if at])):
        pieces = {k: symbols[blocks[k][0]][blocks[k][1] - warm_up : blocks[k][1] + BLOCK] for k in group}
        group.sort(key=lambda k: -len(pieces[k]))
        for start in range(0, len(group), LANES):
            lanes = group[start : start + LANES]
            sizes = np.array([len(pieces[k]) for k in lanes])
            grid = np.zeros((sizes[0], len(lanes)), np.int32)
            for lane, k in enumerate(lanes):
                grid[: sizes[lane], lane] = pieces[k]
            for number, parser in enumerate(model.parsers):
                entry[lanes, number], leave[lanes, number], found[lanes, number] = _walk(parser, grid, sizes, warm_up)
    for number, parser in enumerate(model.parsers):
        for k, (i, at) in enumerate(blocks):
            if at and entry[k, number] != leave[k - 1, number]:
                leave[k, number], found[k, number] = _follow(parser, int(leave[k - 1, number]), symbols[i][at : at + BLOCK])
        np.add.at(counts[:, number], owners, found[:, number])
    return counts


def predict(model: Model, texts: list[str | None]) -> list[tuple[str, float]]:
    """Language and score of each text; the score is how much shorter the best parse is than the next."""
    codes = [letters_of(t or "") for t in texts]
    known = [i for i, c in enumerate(codes) if c.any()] if model.languages else []
    result = [(UNDETERMINED, 0.0)] * len(texts)
    if not known:
        return result
    bits = phrases(model, [codes[i] for i in known]) * model.weights
    for i, row in zip(known, bits):
        order = np.argsort(row, kind="stable")
        score = 1.0 if len(order) == 1 else 1 - row[order[0]] / row[order[1]]
        result[i] = (model.languages[order[0]], float(score))
    return result


def held_out(doc_id: Column) -> Column:
    """The rows that are never learned from; a row without an id is one of them."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(True))


def _pieces(text: Column, most: int) -> Column:
    """The whole text if it has at most ``most`` characters, else pieces at even distances from its start to its end."""
    n = max(most // PIECE, 2)
    starts = F.sequence(F.lit(0), F.lit(n - 1))
    room = (F.length(text) - PIECE).cast("double")
    cut = F.transform(starts, lambda j: F.substring(text, F.floor(j * room / (n - 1)).cast("int") + 1, F.lit(PIECE)))
    return F.when(F.length(text) <= most, F.array(text)).otherwise(cut)


def fit_language(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """A model from a bounded sample of the documents with a language that are not held out.

    Per language the ids with the smallest hashes are taken, of their texts pieces from all over them up to the
    bound per document, and of these, in the order of a hash, as many as the bound per language allows. Only
    these pieces reach the driver.
    """
    doc_id = F.col("doc_id").cast("long")
    usable = docs.filter(F.col("lang").isNotNull() & ~held_out(doc_id) & (F.length("text") > 0))
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = (
        usable.select(doc_id.alias("doc_id"), F.col("lang").cast("string").alias("lang"))
        .withColumn("n", F.row_number().over(by_hash))
        .filter(F.col("n") <= settings.docs_per_language)
        .drop("n")
    )
    texts = usable.select(doc_id.alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(ids.distinct()), ["doc_id", "lang"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    cut = rows.select("lang", "doc_id", F.posexplode(_pieces(F.col("text"), settings.chars_per_doc)).alias("place", "piece"))
    pieces = cut.withColumn("order", F.xxhash64("doc_id", "place"))
    samples: dict[str, list[str]] = {}
    for row in pieces.toArrow().sort_by([("lang", "ascending"), ("order", "ascending"), ("doc_id", "ascending"), ("place", "ascending")]).to_pylist():
        samples.setdefault(row["lang"], []).append(row["piece"])
    return train(samples, settings)


def identify_language(docs: DataFrame, model: Model) -> DataFrame:
    """The language of every whole text of ``docs``.

    Result: one row per row of ``docs``: doc_id as it is (also null, then held_out is true), held_out,
    lang_pred and score (0 to 1). A text that is null or has no letter is ``und`` with score 0, and so is
    every text where nothing could be learned. Of languages with equal parses the first in the alphabet
    wins, with score 0. Other columns are not read; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_OUT):
                rows = whole.slice(at, ROWS_OUT)
                found = predict(shared.value, rows.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0),
                        rows.column(1),
                        pa.array([language for language, _ in found], pa.string()),
                        pa.array([score for _, score in found], pa.float64()),
                    ],
                    names=["doc_id", "held_out", "lang_pred", "score"],
                )

    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, SCHEMA)
