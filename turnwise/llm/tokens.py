"""Token counts of whole texts, by a public tokenizer file, without keeping the ids."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
BATCH_BYTES = 1 << 20
KEPT_PIECES = 1_000_000
KEPT_LENGTH = 64
ROWS_OUT = 1024

# Byte-level BPE begins a new word at a single white space between two other characters (a space goes
# with the word after it), whatever stands around it, so counts of such parts add up to the whole count.
SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")
UNSAFE_SPACE = re.compile(r"\s\s|^\s|\s$")


@cache
def _encoder(path: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to token counts; opened once per Python worker."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def split_text(text: str) -> list[str]:
    """The parts between safe places; ``whole_part`` gives back the space that all but the first begin with."""
    if UNSAFE_SPACE.search(text):
        return SAFE_SPACE.split(text)
    return text.replace("\n", " \n").split(" ")


def whole_part(part: str) -> str:
    """A part that is not the first of its text, as it stands in the text."""
    return part if part.startswith("\n") else f" {part}"


def byte_batches(texts: Iterable[str], most: int) -> Iterator[list[str]]:
    """Lists of texts of about ``most`` bytes; a longer text is a list of its own."""
    batch: list[str] = []
    size = 0
    for text in texts:
        n = len(text.encode("utf-8", "replace"))
        if batch and size + n > most:
            yield batch
            batch, size = [], 0
        batch.append(text)
        size += n
    if batch:
        yield batch


class PieceCounter:
    """Counts by part: parts seen before are looked up, new ones encoded together in byte-balanced batches."""

    def __init__(self, encode: Callable[[list[str]], list[int]], batch_bytes: int, split: bool):
        self.encode, self.batch_bytes, self.split = encode, batch_bytes, split
        self.known: dict[str, int] = {}

    def _encoded(self, texts: Iterable[str]) -> Iterator[int]:
        for batch in byte_batches(texts, self.batch_bytes):
            yield from self.encode(batch)

    def counts(self, texts: list[str]) -> list[int]:
        if not self.split:
            return list(self._encoded(texts))
        firsts, rests = [], []
        for text in texts:
            first, *rest = split_text(text)
            firsts.append(first)
            rests.append(rest)
        known = self.known
        new = [*set(chain.from_iterable(rests)).difference(known)]
        known.update(zip(new, self._encoded(map(whole_part, new))))
        result = [n + sum(map(known.__getitem__, rest)) for n, rest in zip(self._encoded(firsts), rests)]
        for part in new:
            if len(part) > KEPT_LENGTH:
                del known[part]
        if len(known) > KEPT_PIECES:
            known.clear()
        return result


@cache
def _counter(path: str, batch_bytes: int, split: bool) -> PieceCounter:
    return PieceCounter(_encoder(path), batch_bytes, split)


def count_tokens(
    docs: DataFrame, path: str, limit: int = 1024, batch_bytes: int = BATCH_BYTES, safe_spaces: bool = True
) -> DataFrame:
    """Bytes and tokens of every whole text.

    ``path`` names a ``.json`` file of the tokenizers library or a ``.model`` file of sentencepiece and
    has to exist on every machine. No begin or end tokens are added; special strings inside a text are
    handled as that library does. With ``safe_spaces`` (right for byte-level BPE) a text is cut at
    spaces where a new word begins anyway; without it every text goes to the library whole. Texts are
    worked through in groups of about ``batch_bytes``, so memory is bounded by the longest text.

    Result: one row per row of ``docs``, with doc_id as it is (also null), n_bytes (UTF-8), n_tokens and
    over_limit (more than ``limit`` tokens). A null or empty text has 0 bytes and 0 tokens. Other columns
    of ``docs`` are not read. An empty table gives an empty result.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path, batch_bytes, safe_spaces)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_OUT):
                rows = whole.slice(at, ROWS_OUT)
                texts = [t or "" for t in rows.column(1).to_pylist()]
                n_tokens = [n for group in byte_batches(texts, batch_bytes) for n in counter.counts(group)]
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0),
                        pa.array([len(t.encode("utf-8", "replace")) for t in texts], pa.int64()),
                        pa.array(n_tokens, pa.int64()),
                        pa.array([n > limit for n in n_tokens], pa.bool_()),
                    ],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(count, SCHEMA)
