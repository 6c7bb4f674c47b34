"""Calling a user's model from Spark tasks, and two stand-in models for tests.

A model is given as a *factory*: a picklable callable without arguments that opens a client and
returns a function from a list of inputs to a list of outputs, in the same order. The factory
runs once per task.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable, Iterator
from hashlib import md5
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

ModelFactory = Callable[[], Callable[[list[Any]], list[Any]]]

# Fixed value: an embedding request takes at most this many texts.
EMBEDDING_REQUEST_LIMIT = 150


def _in_requests(call: Callable[[list[Any]], list[Any]], inputs: list[Any], size: int) -> list[Any]:
    outputs: list[Any] = []
    for start in range(0, len(inputs), size):
        request = inputs[start : start + size]
        answer = list(call(request))
        if len(answer) != len(request):
            raise ValueError(f"model returned {len(answer)} outputs for {len(request)} inputs")
        outputs.extend(answer)
    return outputs


def embed(text: Column, model: ModelFactory, request_size: int = EMBEDDING_REQUEST_LIMIT) -> Column:
    """A vector per text. Null texts are not sent and stay null; a failing request fails the task."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        call = model()
        for batch in batches:
            present = batch.notna()
            result = pd.Series([None] * len(batch), index=batch.index, dtype=object)
            if present.any():
                found = _in_requests(call, batch[present].tolist(), request_size)
                result[present] = pd.Series(found, index=batch.index[present], dtype=object)
            yield result

    return vectors.asNondeterministic()(text)


def answers_of(
    call: Callable[[list[Any]], list[Any]], request: list[Any], request_size: int, attempts: int, pause_seconds: float
) -> list[tuple[str | None, str | None]]:
    """(answer, error) per input. A request that fails is repeated input by input, each up to ``attempts`` times."""
    try:
        return [(text, None) for text in _in_requests(call, request, request_size)]
    except Exception:
        return [_retried(call, value, attempts, pause_seconds) for value in request]


def _retried(call: Callable, value: Any, attempts: int, pause_seconds: float) -> tuple[str | None, str | None]:
    for attempt in range(attempts):
        try:
            return _in_requests(call, [value], 1)[0], None
        except Exception as problem:
            error = f"{type(problem).__name__}: {problem}"
        if attempt + 1 < attempts:
            time.sleep(pause_seconds * 2**attempt)
    return None, error


def infer_conversations(
    rows: DataFrame,
    model: ModelFactory,
    tasks: int,
    key: str = "conv_id",
    order: str = "turn",
    request_size: int = 16,
    attempts: int = 3,
    pause_seconds: float = 1.0,
) -> DataFrame:
    """(key, response, error): one model answer per conversation, from rows (key, order, role, content).

    Rows are dealt to ``tasks`` tasks by key and sorted there, and a conversation is put together while
    it is read, so only one request of conversations is in memory. What is too long for a model is
    its own error and ends in the error column.
    """
    schema = T.StructType(
        [rows.schema[key], T.StructField("response", T.StringType()), T.StructField("error", T.StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = model()

        def answered(chats: list[tuple[Any, list[dict]]]) -> pa.RecordBatch:
            answers = answers_of(call, [messages for _, messages in chats], request_size, attempts, pause_seconds)
            columns = [[k for k, _ in chats], [a for a, _ in answers], [e for _, e in answers]]
            types = [to_arrow_type(f.dataType) for f in schema.fields]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=schema.names)

        chats: list[tuple[Any, list[dict]]] = []
        for batch in batches:
            for k, role, content in zip(*(c.to_pylist() for c in batch.columns)):
                if not chats or chats[-1][0] != k:
                    if len(chats) == request_size:
                        yield answered(chats)
                        chats = []
                    chats.append((k, []))
                chats[-1][1].append({"role": role, "content": content})
        if chats:
            yield answered(chats)

    dealt = rows.repartition(tasks, key).sortWithinPartitions(key, order)
    return dealt.select(key, "role", "content").mapInArrow(run, schema)


def infer(
    df: DataFrame,
    input_col: str,
    model: ModelFactory,
    output_col: str = "response",
    error_col: str = "error",
    request_size: int = 16,
    attempts: int = 3,
    pause_seconds: float = 1.0,
    max_chars: int | None = None,
) -> DataFrame:
    """One model answer per row. A row whose call keeps failing gets an error text, not a failed job.

    Inputs are texts or arrays of (role, content) messages. A request that fails is repeated row by
    row, so one bad input does not take its neighbours along. Inputs longer than ``max_chars``, which
    a model with a limited context would refuse, are reported in the error column.
    """
    schema = T.StructType(
        df.schema.fields
        + [T.StructField(output_col, T.StringType()), T.StructField(error_col, T.StringType())]
    )
    input_is_text = isinstance(df.schema[input_col].dataType, T.StringType)

    def length(value: Any) -> int:
        return len(value) if input_is_text else sum(len(m["content"] or "") for m in value)

    def answer(call: Callable, request: list[Any]) -> list[tuple[str | None, str | None]]:
        return answers_of(call, request, request_size, attempts, pause_seconds)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = model()
        for batch in batches:
            outcome: list[tuple[str | None, str | None]] = []
            for start in range(0, len(batch), request_size):
                values = batch[input_col].iloc[start : start + request_size].tolist()
                sendable = [
                    v is not None and (max_chars is None or length(v) <= max_chars) for v in values
                ]
                answers = iter(answer(call, [v for v, ok in zip(values, sendable) if ok]))
                for value, ok in zip(values, sendable):
                    if ok:
                        outcome.append(next(answers))
                    elif value is None:
                        outcome.append((None, "input is null"))
                    else:
                        outcome.append((None, f"input exceeds {max_chars} characters"))
            yield batch.assign(
                **{output_col: [o[0] for o in outcome], error_col: [o[1] for o in outcome]}
            )

    return df.mapInPandas(run, schema)


class _Buckets(dict):
    """The bucket of each token, worked out once as long as there are few. Tokens are texts, or bytes in Latin-1."""

    MOST = 1 << 18

    def __init__(self, dim: int):
        self.dim = dim

    def __missing__(self, token: str | bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        text = token if isinstance(token, str) else token.decode("latin-1")
        bucket = self[token] = int.from_bytes(md5(text.encode("utf-8")).digest()[:4]) % self.dim
        return bucket


class HashEmbedder:
    """Token counts in hashed buckets, scaled to length 1. A stand-in, not a language model."""

    def __init__(self, dim: int):
        self.dim = dim

    def __call__(self) -> Callable[[list[str]], list[list[float]]]:
        import regex

        from turnwise.functions.text import TOKEN_PATTERN

        find = regex.compile(TOKEN_PATTERN).findall
        dim, bucket_of = self.dim, _Buckets(self.dim).__getitem__
        # Texts in Latin-1 are cut as bytes: what is no part of a token becomes a space.
        spaced = bytes(c if find(chr(c)) else ord(" ") for c in range(256))

        def tokens_of(lowered: str) -> list[str] | list[bytes]:
            try:
                return lowered.encode("latin-1").translate(spaced).split()
            except UnicodeEncodeError:
                return find(lowered)

        def vectors(texts: list[str]) -> list[list[float]]:
            result = []
            for text in texts:
                found = tokens_of(text.lower())
                buckets = np.fromiter(map(bucket_of, found), np.intp, len(found))
                counts = np.bincount(buckets, minlength=dim).astype(float)
                norm = math.sqrt(counts @ counts)
                result.append((counts / norm if norm else counts).tolist())
            return result

        return vectors


class ExtractiveAssessor:
    """Fills an assessment from the transcript in the prompt. A stand-in, not a language model.

    Per speaker: the score is 1 + 9 * lines / all lines in whole numbers, the two summaries are the
    speaker's first and last line, the role depends on the company marker, and the impact is a digest
    of the whole prompt.
    """

    def __init__(self, marker: str, transcript_mark: str, transcript_end: str):
        self.marker = marker
        self.transcript_mark = transcript_mark
        self.transcript_end = transcript_end

    def __call__(self) -> Callable[[list[str]], list[str]]:
        from turnwise.schemas import PARTICIPANT_TEXT_LISTS

        def assess(prompt: str) -> str:
            start = prompt.index(self.transcript_mark) + len(self.transcript_mark)
            lines = json.loads(prompt[start : prompt.rindex(self.transcript_end)])
            spoken: dict[str, list[str]] = {}
            for line in lines:
                speaker, _, said = line.partition(" : ")
                spoken.setdefault(speaker, []).append(said)
            participants = []
            for speaker, said in spoken.items():
                inside = self.marker in speaker.lower()
                participants.append(
                    {
                        **{key: [] for key in PARTICIPANT_TEXT_LISTS},
                        "performance_metrics": [f"lines: {len(said)}"],
                        "name": speaker,
                        "email_id": speaker if "@" in speaker else "",
                        "role": "sales rep" if inside else "customer",
                        "performance_score": 1 + 9 * len(said) // len(lines),
                        "engagement_level": "high" if 2 * len(said) >= len(lines) else "low",
                        "sales_impact": md5(prompt.encode("utf-8")).hexdigest(),
                        "meeting_summary_from_my_perspective": said[0],
                        "meeting_summary_from_their_perspective": said[-1],
                    }
                )
            return json.dumps({"participants": participants}, ensure_ascii=False)

        return lambda prompts: [assess(p) for p in prompts]


class DigestModel:
    """Answers with a digest of its whole input: any change of a prompt changes the answer. A stand-in.

    Messages count as role, colon, content and line end each.
    """

    def __call__(self) -> Callable[[list[Any]], list[str]]:
        def answer(value: Any) -> str:
            text = value if isinstance(value, str) else "".join(f"{m['role']}:{m['content']}\n" for m in value)
            return md5(text.encode("utf-8")).hexdigest()

        return lambda values: [answer(v) for v in values]


class LastMessageModel:
    """Answers with the text after the last mark of a prompt, or the last message. A stand-in."""

    def __init__(self, mark: str = "Question: "):
        self.mark = mark

    def __call__(self) -> Callable[[list[Any]], list[str]]:
        def answer(value: Any) -> str:
            if isinstance(value, str):
                return value.rsplit(self.mark, 1)[-1]
            return value[-1]["content"]

        return lambda values: [answer(v) for v in values]


class RewriteOrDigest:
    """One stand-in for texts (rewrite prompts) and one for message lists (answer prompts)."""

    def __init__(self, texts: ModelFactory, messages: ModelFactory):
        self.texts, self.messages = texts, messages

    def __call__(self) -> Callable[[list[Any]], list[str]]:
        texts, messages = self.texts(), self.messages()
        return lambda values: [(texts if isinstance(v, str) else messages)([v])[0] for v in values]
