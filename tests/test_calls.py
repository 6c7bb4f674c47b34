from __future__ import annotations

import json
import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from turnwise.functions.nested import flatten
from turnwise.operators.transcript import (
    KEPT_COLUMNS,
    action_item_rows,
    label_speakers,
    label_speakers_rows,
    mentioned_sentences,
    moment_rows,
    talk_overlaps,
    talk_time,
    talk_time_beside_stored,
    transcript_parts,
)
from turnwise.plans import queries
from turnwise.sources.calls import attendee_rows, parse_calls, read_calls, read_inferred, sentence_rows


def attendee(id, email="", full_name="", talk_time=0, percent=0.0):
    return {
        "id": id,
        "user_guid": "",
        "full_name": full_name,
        "email": email,
        "phone_number": "",
        "auto_generated": False,
        "is_internal": False,
        "percent_talk_time": percent,
        "talk_time": talk_time,
        "external_id": "line-7",
    }


def call(id, sentences, attendees, **data):
    head = {
        "id": id,
        "duration": 42000,
        "is_api": False,
        "platform": "phone",
        "title": f"Call {id}",
        "language_code": "en-US",
        "event_start_date": "2031-02-03T04:05:06.007Z",
        "event_end_date": "2031-02-03T04:05:48.007Z",
        "person": {"id": "1", "_href": "https://people.example/1"},
    }
    return {
        "conversation": head,
        "extensiveConversation": {
            "data": {**head, "attendees": attendees, "invitees": [], **data}
        },
        "sentences": [
            {
                "id": "transcription",
                "order_number": n,
                "recording_attendee_id": who,
                "start_time": start,
                "end_time": end,
                "text": text,
            }
            for n, who, start, end, text in sentences
        ],
    }


CASES = [
    # The label is the address, else the name, else the id; the first entry with a label counts.
    ("address", [attendee("a", "ann@x.example", "Ann")], "ann@x.example : hi"),
    ("empty address", [attendee("a", "", "Ann")], "Ann : hi"),
    ("null address", [attendee("a", None, "Ann")], "Ann : hi"),
    ("neither", [attendee("a", "", "")], "a : hi"),
    ("nulls", [attendee("a", None, None)], "a : hi"),
    ("no attendees", None, "a : hi"),
    ("empty attendees", [], "a : hi"),
    ("unknown id", [attendee("b", "bob@x.example")], "a : hi"),
    ("id in another case", [attendee("A", "ann@x.example")], "a : hi"),
    ("twice", [attendee("a", "", "Ann"), attendee("a", "ann@x.example")], "Ann : hi"),
    ("second has label", [attendee("a"), attendee("a", "ann@x.example")], "ann@x.example : hi"),
    ("blank address", [attendee("a", " ", "Ann")], "  : hi"),
]


@pytest.fixture(scope="module")
def calls(spark):
    documents = [call(name, [(0, "a", 0, 1.5, "hi")], people) for name, people, _ in CASES]
    documents += [
        call("null text", [(0, "a", 0, 1, None)], [attendee("a", "ann@x.example")]),
        call("no sentences", [], [attendee("a", "ann@x.example")]),
        call(
            "order",
            [(4, "a", 9, 10, "second"), (1, "b", 20, 30, "first"), (6, "a", 0, 4, "third")],
            [attendee("a", "", "Ann", 5000, 33.33), attendee("b", "", "Bob", 10000, 66.67)],
        ),
    ]
    texts = spark.createDataFrame([(json.dumps(d),) for d in documents], "document string")
    return parse_calls(texts, F.col("document"))


def lines_of(calls):
    labelled = label_speakers(flatten(calls))
    return {r["conversation.id"]: r["sentences_updated"] for r in labelled.collect()}


def test_labels(calls):
    lines = lines_of(calls)
    for name, _, expected in CASES:
        assert lines[name] == [expected], name
    assert lines["null text"] == [None]
    assert lines["no sentences"] == []
    assert lines["order"] == ["Ann : second", "Bob : first", "Ann : third"]


def test_row_form_equals_array_form(calls):
    rows = label_speakers_rows(sentence_rows(calls), attendee_rows(calls)).collect()
    by_rows: dict[str, list] = {}
    for row in sorted(rows, key=lambda r: (r["conversation_id"], r["order_number"])):
        by_rows.setdefault(row["conversation_id"], []).append(row["line"])
    arrays = {k: v for k, v in lines_of(calls).items() if v and k != "order"}
    assert by_rows.pop("order") == ["Bob : first", "Ann : second", "Ann : third"]
    assert by_rows == arrays


def test_kept_columns(calls):
    assert label_speakers(flatten(calls)).columns == [*KEPT_COLUMNS, "sentences_updated"]


def test_files_with_one_document_each(spark, folder):
    documents = [
        call("one", [(0, "a", 1, 2, "x")], [attendee("a", "ann@x.example")], unknown={"field": 1}),
        call("two", [(0, "b", 1, 2, "y"), (1, "b", 2, 3, "z")], []),
    ]
    for number, document in enumerate(documents):
        with open(f"{folder}/call ({number}).json", "w") as file:
            json.dump(document, file, indent=2)
    with open(f"{folder}/notes.txt", "w") as file:
        file.write("not a call")
    found = read_calls(spark, folder)
    assert found.count() == 2
    assert lines_of(found) == {"one": ["ann@x.example : x"], "two": ["b : y", "b : z"]}
    flat = flatten(found)
    assert "extensiveConversation.data.person._href" in flat.columns
    row = flat.filter("`conversation.id` = 'one'").first()
    assert row["conversation.account.id"] is None
    assert row["extensiveConversation.data.invitees"] == []


def test_talk_time_beside_the_stored_one(calls):
    order = calls.filter("conversation.id = 'order'")
    found = talk_time_beside_stored(sentence_rows(order), attendee_rows(order)).collect()
    values = {
        r["recording_attendee_id"]: (
            r["talk_time"], r["percent_talk_time"], r["stored_talk_time"], r["stored_percent"]
        )
        for r in found
    }
    assert values == {"a": (5000, 33.33, 5000, 33.33), "b": (10000, 66.67, 10000, 66.67)}


def test_silent_call_has_no_share(spark):
    rows = [("c", 0, "a", 1.0, 1.0, "x")]
    columns = "conversation_id string, order_number bigint, recording_attendee_id string, "
    columns += "start_time double, end_time double, text string"
    row = talk_time(spark.createDataFrame(rows, columns)).first()
    assert row["talk_time"] == 0 and row["percent_talk_time"] is None


def test_one_conversation_with_most_rows(spark):
    """Lines and transcripts of a conversation that is far longer than a part."""
    long, width = 5000, 1024
    sentences = spark.range(long).select(
        F.lit("long").alias("conversation_id"),
        F.col("id").alias("order_number"),
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("recording_attendee_id"),
        F.col("id").cast("string").alias("text"),
    )
    others = spark.range(300).select(
        F.concat(F.lit("c"), F.col("id").cast("string")).alias("conversation_id"),
        F.lit(0).cast("long").alias("order_number"),
        F.lit("a").alias("recording_attendee_id"),
        F.lit("x").alias("text"),
    )
    attendees = spark.createDataFrame(
        [("long", 0, "a", "ann@x.example", None)],
        "conversation_id string, position bigint, attendee_id string, email string, full_name string",
    )
    lines = label_speakers_rows(sentences.unionByName(others), attendees)
    parts = transcript_parts(lines, width=width).collect()
    long_parts = sorted((r for r in parts if r["conversation_id"] == "long"), key=lambda r: r["part"])
    assert len(parts) == 300 + len(long_parts)
    assert [len(p["sentences_updated"]) for p in long_parts] == [1024, 1024, 1024, 1024, 904]
    joined = [line for p in long_parts for line in p["sentences_updated"]]
    speakers = ["ann@x.example", "b"]
    assert joined == [f"{speakers[n % 2]} : {n}" for n in range(long)]


def test_numbers_do_not_cut_a_short_call(spark):
    numbers = [1022, 1023, 1024, 1025, 5000, None]
    lines = spark.createDataFrame([("c", n, f"line {n}") for n in numbers], "conversation_id string, order_number bigint, line string")
    (row,) = transcript_parts(lines).collect()
    assert row["part"] == 0
    assert row["sentences_updated"] == ["line None", *(f"line {n}" for n in numbers[:5])]


def test_order_number_may_be_null(spark):
    columns = "conversation_id string, order_number bigint, recording_attendee_id string, text string"
    sentences = spark.createDataFrame([("c", None, "a", "x")], columns)
    attendees = spark.createDataFrame(
        [("c", 0, "a", "ann@x.example", None)],
        "conversation_id string, position bigint, attendee_id string, email string, full_name string",
    )
    assert label_speakers_rows(sentences, attendees).first()["line"] == "ann@x.example : x"


def test_the_schema_is_found_by_reading(spark, folder):
    documents = [
        '{"id": 1, "a": {"x": 1.5, "list": [{"k": 1}]}}',
        '{"id": 2, "a": {"x": 2, "y": null}, "only_here": {"deep": "t"}}',
        '{"id": 3, "a": {"list": [{"j": "s"}]}}',
        "not json",
    ]
    for n, text in enumerate(documents):
        with open(f"{folder}/{n}.json", "w") as file:
            file.write(text)
    flat = flatten(read_inferred(spark, folder))
    assert sorted(flat.columns) == ["a.list", "a.x", "a.y", "id", "only_here.deep"]
    found = sorted(map(tuple, flat.select("id", "`a.x`", "`only_here.deep`", "`a.y`").collect()), key=repr)
    assert found == [(1, 1.5, None, None), (2, 2.0, "t", None), (3, None, None, None), (None, None, None, None)]


def intervals(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        start = rng.randrange(0, 300) / 2
        rows.append(("c", rng.choice(["a", "b", "d"]), i, start, start + rng.randrange(-2, 60) / 2))
    return rows


@pytest.mark.parametrize("span", [7.5, 3600.0])
def test_overlapping_talk(spark, span):
    rows = intervals(5, 60) + [("e", "a", 0, 0.0, 1.0), ("e", "a", 1, 0.5, 2.0), ("e", "b", 2, None, 3.0)]
    df = spark.createDataFrame(rows, "conversation_id string, recording_attendee_id string, order_number int, start_time double, end_time double")
    found = {tuple(r)[:2]: tuple(r)[2:] for r in talk_overlaps(df, span).collect()}
    expected = {}
    for call in ("c", "e"):
        ticks = [{r[1] for r in rows if r[0] == call and r[3] is not None and r[3] <= t / 2 < r[4]} for t in range(400)]
        for who in {r[1] for r in rows if r[0] == call}:
            plain = sum(r[4] - r[3] for r in rows if r[:2] == (call, who) and r[3] is not None)
            expected[call, who] = (1000 * plain, 500 * sum(who in t for t in ticks), 500 * sum(who in t and len(t) > 1 for t in ticks))
    assert found == expected


def test_sentences_of_mentions(spark):
    mentions = spark.createDataFrame(
        [("c", 0, 5, 7), ("c", 1, 0, 200), ("c", 2, 9, 3), ("c", 3, None, 4), ("d", 4, 5, 5), (None, 5, 0, 9)],
        "conversation_id string, mention_at int, index_start bigint, index_end bigint",
    )
    lines = [("c", n, f"line {n}") for n in range(0, 300, 2)] + [("c", 6, "again")]
    sentences = spark.createDataFrame(lines, "conversation_id string, order_number bigint, text string")
    for width in (1, 10, 64):
        found = [(r["mention_at"], r["order_number"], r["text"]) for r in mentioned_sentences(mentions, sentences, width).collect()]
        expected = [(0, n, t) for _, n, t in lines if 5 <= n <= 7] + [(1, n, t) for _, n, t in lines if n <= 200]
        assert sorted(found) == sorted(expected)


def test_key_moments_keep_absent_levels(spark):
    document = {
        "conversation": {"id": "one"},
        "extensiveConversation": {"data": {"key_moments": {"items": [
            {"name": "m", "categories": [{"category": "c", "mentions": [{"index_start": 1, "index_end": 2}, {"index_start": 3, "index_end": 3}]}, {"category": "e"}]},
            {"name": "n", "categories": []},
        ]}, "action_items": {"items": [{"id": "x", "original_text": "do"}]}}},
    }
    texts = spark.createDataFrame([(json.dumps(document),), ('{"conversation": {"id": "two"}}',)], "t string")
    calls = parse_calls(texts, F.col("t"))
    found = [tuple(r)[:6] for r in moment_rows(calls).collect()]
    assert sorted(found, key=repr) == sorted(
        [("one", 0, 0, 0, "m", "c"), ("one", 0, 0, 1, "m", "c"), ("one", 0, 1, None, "m", "e"), ("one", 1, None, None, "n", None), ("two", None, None, None, None, None)],
        key=repr,
    )
    actions = sorted((r["conversation_id"], r["item_at"], r["original_text"]) for r in action_item_rows(calls).collect() if r["id"])
    assert actions == [("one", 0, "do")] and action_item_rows(calls).count() == 2


def test_files_of_calls_are_dealt_out_to_all_tasks(spark, folder, monkeypatch):
    turns = [(n, turn, "user" if turn % 2 else "assistant", f"text {n} {turn}") for n in range(200) for turn in range(2)]
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    monkeypatch.setattr(queries, "work_folder", lambda spark, purpose: f"{folder}/{purpose}")
    found = queries.QUERIES["read_pretty_calls"](spark, folder).collect()
    assert sorted((r["conversation_id"], r["order_number"], r["text"]) for r in found) == sorted((str(n), t, x) for n, t, _, x in turns)
    names = [path.name for path in Path(folder, "pretty-calls").glob("*.json")]
    tasks = Counter(name.split("-")[1] for name in names)
    assert len(names) == 200 and len(tasks) >= spark.sparkContext.defaultParallelism and max(tasks.values()) < 30
