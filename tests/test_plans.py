"""The three jobs one after the other, on calls in files."""

from __future__ import annotations

import json

from test_calls import attendee, call
from test_search import DIM

from turnwise.config import Names, reset_tables, use_database
from turnwise.functions.models import ExtractiveAssessor, HashEmbedder, LastMessageModel
from turnwise.operators.transcript import TRANSCRIPT_END, TRANSCRIPT_MARK
from turnwise.plans.coaching import answer, assess_calls, index_participants
from turnwise.sources.calls import read_calls

NAMES = Names(database="coaching")
PEOPLE = [attendee("a", "ann@acme.example", "Ann"), attendee("b", "", "Bob")]


def write_calls(folder, documents):
    for document in documents:
        with open(f"{folder}/{document['conversation']['id']}.json", "w") as file:
            json.dump(document, file, indent=2)


def test_calls_to_answers(spark, tmp_path):
    calls, work = tmp_path / "calls", str(tmp_path / "work")
    calls.mkdir()
    use_database(spark, NAMES)
    reset_tables(spark, NAMES)
    assessor = ExtractiveAssessor("acme", TRANSCRIPT_MARK, TRANSCRIPT_END)
    embedder = HashEmbedder(DIM)

    def run():
        found = read_calls(spark, str(calls))
        bad = assess_calls(found, NAMES, "acme", assessor, f"{work}/answers")
        return bad, index_participants(spark, NAMES, work, embedder, DIM)

    first = [(0, "a", 0, 1, "our price is fine"), (1, "b", 1, 2, "too high"), (2, "a", 2, 3, "goodbye")]
    write_calls(calls, [call("one", first, PEOPLE), call("two", [(0, "b", 0, 1, "hello")], PEOPLE)])
    bad, index = run()
    assert bad.count() == 0
    people = spark.table(NAMES.table("participant_rows")).collect()
    assert sorted((r["conversation_id"], r["name"], r["participant"]["role"]) for r in people) == [
        ("one", "Bob", "customer"), ("one", "ann@acme.example", "sales rep"), ("two", "Bob", "customer")
    ]
    assert index.docs.count() == 3

    # A call is replaced and one is added: the rows of its old state leave the index.
    write_calls(calls, [call("two", [(0, "a", 0, 1, "refund")], PEOPLE), call("three", first, PEOPLE)])
    _, index = run()
    found = sorted((r["conversation_id"], r["name"]) for r in index.docs.collect())
    assert found == [
        ("one", "Bob"), ("one", "ann@acme.example"),
        ("three", "Bob"), ("three", "ann@acme.example"), ("two", "ann@acme.example"),
    ]

    chats = spark.createDataFrame(
        [("q", 0, "user", "Who spoke of a refund?")], "conv_id string, turn bigint, role string, text string"
    )
    row = answer(chats, NAMES, work, embedder, LastMessageModel(), k=1, query_type="keyword").first()
    assert row["answer"] == "Who spoke of a refund?" and row["error"] is None
    assert row["sources"][0]["uri"] == "two"
    spark.catalog.setCurrentDatabase("default")
