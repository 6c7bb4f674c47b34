from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from turnwise.functions.models import HashEmbedder, LastMessageModel
from turnwise.functions.nested import fill_template, json_schema_of
from turnwise.operators import chat
from turnwise.operators.index import build_index
from turnwise.schemas import MESSAGES, struct
from turnwise.schemas import TEXT

DIM = 16

CHATS = {
    "single": [("user", "alpha?")],
    "usual": [("user", "alpha?"), ("assistant", "beta."), ("user", "gamma?")],
    "system first": [("system", "be kind"), ("user", "alpha?"), ("assistant", "b"), ("user", "delta?")],
    "only system": [("system", "be kind"), ("user", "beta?")],
    "assistant last": [("user", "alpha?"), ("assistant", "gamma and delta")],
    "no hit": [("user", "zzz")],
    "placeholders": [("user", "{context} {question}"), ("assistant", "{0}"), ("user", "alpha {context}")],
}


@pytest.fixture(scope="module")
def rows(spark):
    values = [
        (name, 10 * turn, role, text)
        for name, messages in CHATS.items()
        for turn, (role, text) in enumerate(messages)
    ]
    return spark.createDataFrame(values, "conv_id string, turn bigint, role string, text string")


@pytest.fixture(scope="module")
def arrays(spark):
    values = [
        (name, [{"role": r, "content": t} for r, t in messages]) for name, messages in CHATS.items()
    ]
    return spark.createDataFrame(
        [*values, ("empty", [])], struct(conv_id=TEXT, messages=MESSAGES)
    )


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    texts = ["alpha", "beta beta", "gamma {question}", "delta alpha", "epsilon", "beta gamma"]
    values = [(n, t, f"conversation {n}", f"name {n}") for n, t in enumerate(texts)]
    df = spark.createDataFrame(values, "id bigint, content string, conversation_id string, name string")
    return build_index(
        df, str(tmp_path_factory.mktemp("chat")), "id", "content", DIM, model=HashEmbedder(DIM)
    )


def test_question_and_history_of_arrays(arrays):
    found = arrays.select(
        "conv_id",
        chat.question_of(F.col("messages")).alias("question"),
        chat.history_of(F.col("messages")).alias("history"),
        chat.formatted_history_of(F.col("messages")).alias("formatted"),
        chat.needs_rewrite(F.col("messages")).alias("rewrite"),
    )
    by_name = {r["conv_id"]: r for r in found.collect()}
    assert by_name.pop("empty")["question"] is None
    for name, messages in CHATS.items():
        row = by_name[name]
        assert row["question"] == messages[-1][1]
        assert [(m["role"], m["content"]) for m in row["history"]] == messages[:-1]
        assert [(m["role"], m["content"]) for m in row["formatted"]] == [
            m for m in messages[:-1] if m[0] in ("user", "assistant")
        ]
        assert row["rewrite"] == (len(messages) > 1)
    assert by_name["only system"]["rewrite"] and not by_name["only system"]["formatted"]


def test_rows_say_the_same(rows):
    last = {r["conv_id"]: r["question"] for r in chat.last_questions(rows).collect()}
    assert last == {name: messages[-1][1] for name, messages in CHATS.items()}
    history = chat.chat_history(rows).orderBy("conv_id", "turn").collect()
    assert [(r["conv_id"], r["role"], r["text"]) for r in history] == [
        (name, *m) for name, messages in sorted(CHATS.items()) for m in messages[:-1]
    ]
    speakers = {(r["role"], r["speaker"]) for r in chat.formatted_history(rows).collect()}
    assert speakers == {("user", "human"), ("assistant", "ai")}
    needed = {r["conv_id"]: r["needs_rewrite"] for r in chat.rewrite_needed(rows).collect()}
    assert needed == {name: len(messages) > 1 for name, messages in CHATS.items()}


def test_rewrite_prompts(rows):
    prompts = {r["conv_id"]: r["prompt"] for r in chat.rewrite_prompts(rows, "{chat_history}|{question}").collect()}
    assert set(prompts) == {name for name, messages in CHATS.items() if len(messages) > 1}
    for name, prompt in prompts.items():
        history, question = prompt.rsplit("|", 1)
        assert [(m["role"], m["content"]) for m in json.loads(history)] == CHATS[name][:-1]
        assert question == CHATS[name][-1][1]


def test_prompt_has_the_question_twice_and_filled_text_stays(rows, index):
    hits = chat.retrieve(chat.search_queries(rows, None), index, None, 3, "keyword")
    found = chat.contexts(hits, index)
    prompts = chat.prompt_rows(rows, found, "C[{context}] Q[{question}]")
    by_name: dict[str, list] = {}
    for r in prompts.orderBy("conv_id", "turn").collect():
        by_name.setdefault(r["conv_id"], []).append((r["role"], r["content"]))
    assert set(by_name) == set(CHATS)
    for name, messages in CHATS.items():
        system, *history, last = by_name[name]
        question = messages[-1][1]
        assert system[0] == "system" and system[1].endswith(f"Q[{question}]")
        assert history == [m for m in messages[:-1] if m[0] in ("user", "assistant")]
        assert last == ("user", question)
    assert by_name["no hit"][0][1] == "C[] Q[zzz]"
    assert by_name["single"][0][1] == "C[Passage: alpha\nPassage: delta alpha\n] Q[alpha?]"
    assert "Passage: gamma {question}\n" in by_name["usual"][0][1]


def test_array_prompt_equals_row_prompt(rows, arrays, index):
    hits = chat.retrieve(chat.search_queries(rows, None), index, HashEmbedder(DIM), 4)
    found = chat.contexts(hits, index)
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", "content")))
    packed = chat.prompt_rows(rows, found).groupBy("conv_id").agg(ordered.alias("messages"))
    joined = arrays.filter("size(messages) > 0").join(found, "conv_id", "left").select(
        "conv_id", chat.prompt_of(F.col("messages"), F.coalesce("context", F.lit(""))).alias("messages")
    )

    def texts(frame):
        return {r["conv_id"]: [(m["role"], m["content"]) for m in r["messages"]] for r in frame.collect()}

    assert texts(packed) == texts(joined)


def test_sources_follow_the_column_mapping(rows, index):
    hits = chat.retrieve(chat.search_queries(rows, None), index, None, 2, "keyword")
    found = {r["conv_id"]: r["sources"] for r in chat.contexts(hits, index).collect()}
    assert [(s["pk"], s["uri"], s["name"], s["rank"]) for s in found["single"]] == [
        (0, "conversation 0", "name 0", 1), (3, "conversation 3", "name 3", 2)
    ]
    assert "no hit" not in found
    other = chat.contexts(hits, index, chat.RetrieverColumns(document_uri="name"), "{document_uri};")
    assert {r["conv_id"]: r["context"] for r in other.collect()}["single"] == "name 0;name 3;"


def test_all_chats_are_answered(rows, index):
    def factory():
        def call(values):
            if any(isinstance(v, str) and "gamma and delta" in v for v in values):
                raise RuntimeError("refused")
            return ["epsilon" if isinstance(v, str) else f"{len(v)}:{v[0]['content']}" for v in values]

        return call

    answers = chat.answer_chats(
        rows, index, HashEmbedder(DIM), factory, 1, pause_seconds=0, query_type="keyword"
    )
    by_name = {r["conv_id"]: r for r in answers.collect()}
    assert set(by_name) == set(CHATS)
    assert all(r["error"] is None for r in by_name.values())
    # Rewritten to "epsilon" where there is a history; where the rewrite fails the question is used.
    assert by_name["usual"]["sources"][0]["pk"] == 4
    assert by_name["single"]["sources"][0]["pk"] == 0
    assert by_name["assistant last"]["sources"][0]["pk"] in (2, 3, 5)
    assert by_name["no hit"]["sources"] is None
    assert by_name["usual"]["answer"].startswith("4:")
    assert by_name["assistant last"]["problem"] == "rewrite failed: RuntimeError: refused"
    assert by_name["usual"]["problem"] is None
    assert (by_name["usual"]["n_messages"], by_name["single"]["n_messages"]) == (4, 2)


def test_damaged_messages_are_told_of(spark, index):
    values = [("a", 0, "user", "alpha?"), ("a", 1, None, "x"), ("b", None, "user", "beta?")]
    df = spark.createDataFrame(values, "conv_id string, turn bigint, role string, text string")
    answers = chat.answer_chats(df, index, HashEmbedder(DIM), LastMessageModel(), 1)
    by_name = {r["conv_id"]: (r["answer"], r["error"], r["problem"]) for r in answers.collect()}
    assert by_name == {
        "a": ("alpha?", None, "messages left out: 1"),
        "b": (None, "no usable message", "messages left out: 1"),
    }


def long_chat(spark, n):
    return spark.range(n).select(
        F.lit("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"),
        F.col("id").cast("string").alias("text"),
    )


def test_conversations_of_any_length_are_sent(spark, rows, folder):
    log = f"{folder}/log"

    def factory():
        def call(values):
            with open(log, "a") as file:
                file.writelines("x\n" for _ in values)
            if any(len(m) > 9_000 for m in values):
                raise RuntimeError("context is too short")
            return [str(len(m)) for m in values]

        return call

    both = rows.unionByName(long_chat(spark, 10_000))
    prompts = both.withColumnRenamed("text", "content")
    answers = chat.generate(prompts, factory, f"{folder}/store", attempts=1)
    by_name = {r["conv_id"]: (r["answer"], r["error"], r["n_messages"]) for r in answers.collect()}
    assert by_name.pop("long") == (None, "RuntimeError: context is too short", 10_000)
    assert by_name == {name: (str(len(messages)), None, len(messages)) for name, messages in CHATS.items()}
    with open(log) as file:
        sent = len(file.readlines())
    assert answers.count() == len(CHATS) + 1
    chat.generate(rows.withColumnRenamed("text", "content"), factory, f"{folder}/store").collect()
    with open(log) as file:
        assert len(file.readlines()) == sent


def test_equal_prompts_are_sent_once(spark, folder):
    values = [(c, t, "user", f"text {t}") for c in ("a", "b", "c") for t in range(3)] + [("d", 0, "user", "text 1"), ("d", 1, "user", "text 0")]
    prompts = spark.createDataFrame(values, "conv_id string, turn bigint, role string, content string")
    counted = chat.generate(prompts, lambda: lambda v: [f"{len(v)} {m[0]['content']}" for m in v], f"{folder}/s", tasks=1)
    assert sorted((r["conv_id"], r["answer"]) for r in counted.collect()) == [
        ("a", "2 text 0"), ("b", "2 text 0"), ("c", "2 text 0"), ("d", "2 text 1")
    ]


def test_a_long_history_is_rewritten_whole(spark):
    prompt = chat.rewrite_prompts(long_chat(spark, 10_000), "{chat_history}|{question}").first()["prompt"]
    history, question = prompt.rsplit("|", 1)
    assert [m["content"] for m in json.loads(history)] == [str(n) for n in range(9_999)] and question == "9999"


def test_newest_turns(rows):
    found = chat.newest_turns(rows, 2).filter("conv_id = 'system first'").orderBy("turn").collect()
    assert [r["text"] for r in found] == ["b", "delta?"]


def test_message_check(spark):
    values = [
        ("a", 0, "user", "x"), ("a", 1, None, "x"), ("a", 2, "user", None),
        ("b", 0, "user", "x"), ("b", 0, "user", "x"), ("b", 1, "user", "x"), ("b", 1, "user", "y"),
        ("b", 2, "user", ""), ("b", None, "user", "x"), ("b", None, "user", "x"), (None, 3, "user", "x"),
    ]
    df = spark.createDataFrame(values, "conv_id string, turn bigint, role string, text string")
    good, bad = chat.check_messages(df)
    assert sorted((r["conv_id"], r["turn"]) for r in good.collect()) == [("a", 0), ("b", 2)]
    lost = bad.filter("conv_id IS NULL OR turn IS NULL").collect()
    rest = bad.filter("conv_id IS NOT NULL AND turn IS NOT NULL").collect()
    assert sorted((r["conv_id"], r["turn"], r["copies"], r["problem"]) for r in rest) == [
        ("a", 1, 1, "no role"),
        ("a", 2, 1, "no text"),
        ("b", 0, 2, "turn is not unique"),
        ("b", 1, 1, "turn is not unique"),
        ("b", 1, 1, "turn is not unique"),
    ]
    assert sorted((r["conv_id"] or "", r["copies"], r["problem"]) for r in lost) == [
        ("", 1, "no conversation"), ("b", 2, "no turn")
    ]
    assert good.count() + sum(r["copies"] for r in bad.collect()) == len(values)


def test_templates(spark):
    row = spark.range(1).select(
        fill_template("{{x}} {a}{b}", a=F.lit("{b}"), b=F.lit(None).cast("string")).alias("t"),
        json_schema_of('{"a": [1], "b": "x"}').alias("ddl"),
    ).first()
    assert row["t"] == "{x} {b}"
    assert row["ddl"] == "STRUCT<a: ARRAY<BIGINT>, b: STRING>"
    with pytest.raises(KeyError):
        fill_template("{unknown}", a=F.lit(1))


@pytest.mark.parametrize("width", [1, 3, 1024])
def test_turns_within_a_budget(spark, width):
    rows = [("c", t, "user", "x" * (t % 4 + 1)) for t in range(20)] + [("long", 0, "user", "y" * 50), ("n", None, "user", "zz"), ("n", 1, "user", None)]
    df = spark.createDataFrame(rows, "conv_id string, turn bigint, role string, text string")
    found = sorted((r["conv_id"], r["turn"], r["n_left_out"]) for r in chat.turns_within(df, 12, width).collect() if r["turn"] is not None)
    used, kept = 0, []
    for _, t, _, text in rows[19::-1]:
        used += len(text)
        kept += [t] if used <= 12 else []
    assert found == sorted([("c", t, 20 - len(kept)) for t in kept] + [("n", 1, 0)])
