from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from turnwise.functions.models import embed, infer
from turnwise.operators.assess import (
    MERGE_END,
    MERGE_MARK,
    assess_prompts,
    consistency,
    explode_participants,
    infer_once,
    meetings_per_participant,
    merge_parts,
    parse_assessment,
    validate_assessment,
)
from turnwise.schemas import PARTICIPANT_KEYS, PARTICIPANT_TEXT_LISTS


def participant(**changes):
    values = {k: [] if k in PARTICIPANT_TEXT_LISTS else "text" for k in PARTICIPANT_KEYS}
    values |= {"performance_score": 8, "strengths": ["clear"], "name": "Ann"}
    values |= changes
    return {k: v for k, v in values.items() if v != "left out"}


def response(*participants, **more):
    return json.dumps({"participants": list(participants), **more})


CASES = [
    ("whole", response(participant(), participant(name="Bob")), []),
    ("nobody", response(), []),
    ("score out of range", response(participant(performance_score=11)), []),
    ("not JSON", "I cannot do that", ["not a JSON object"]),
    ("cut off", response(participant())[:-4], ["not a JSON object"]),
    ("empty", "", ["not a JSON object"]),
    ("null", None, ["not a JSON object"]),
    ("bare array", json.dumps([participant()]), ["not a JSON object"]),
    ("no key", "{}", ["missing participants"]),
    ("object", '{"participants": {}}', ["participants is not an array"]),
    ("null array", '{"participants": null}', ["participants is not an array"]),
    ("more keys", response(participant(), note=1), ["unexpected note"]),
    ("text in array", '{"participants": ["Ann"]}', ["participant is not an object"]),
    ("score as text", response(participant(performance_score="8")), ["wrong type performance_score"]),
    ("broken score", response(participant(performance_score=8.5)), ["wrong type performance_score"]),
    ("key missing", response(participant(role="left out")), ["missing role"]),
    ("key more", response(participant(age=5)), ["unexpected age"]),
    ("null text", response(participant(role=None)), ["wrong type role"]),
    ("number as text", response(participant(role=5)), ["wrong type role"]),
    ("mixed list", response(participant(strengths=["a", 1])), ["wrong type strengths"]),
    ("list of lists", response(participant(strengths=[["a"]])), ["wrong type strengths"]),
    ("text as list", response(participant(strengths="a")), ["wrong type strengths"]),
    (
        "several",
        response(participant(), participant(role="left out", age=5, performance_score=None)),
        ["missing role", "unexpected age", "wrong type performance_score"],
    ),
]


@pytest.fixture(scope="module")
def responses(spark):
    return spark.createDataFrame([(n, r) for n, r, _ in CASES], "name string, response string")


def test_strict_schema(responses):
    good, bad = validate_assessment(responses)
    assert {r["name"] for r in good.collect()} == {n for n, _, p in CASES if not p}
    problems = {r["name"]: r["problems"] for r in bad.collect()}
    assert problems == {n: p for n, _, p in CASES if p}


def test_parsing_never_fails(responses):
    assert parse_assessment(responses).count() == len(CASES)


def test_explode(responses):
    good, _ = validate_assessment(responses.withColumnRenamed("name", "conversation_id"))
    inner = explode_participants(good, ["conversation_id"]).collect()
    assert sorted((r["conversation_id"], r["name"]) for r in inner) == [
        ("score out of range", "Ann"),
        ("whole", "Ann"),
        ("whole", "Bob"),
    ]
    outer = explode_participants(good, ["conversation_id"], outer=True).collect()
    assert ("nobody", None) in [(r["conversation_id"], r["name"]) for r in outer]


def test_reports(spark):
    rows = [("Ann", "c1", 4), ("Ann", "c1", 6), ("Ann", "c2", 8), ("Bob", "c1", None)]
    scores = spark.createDataFrame(rows, "name string, conversation_id string, score bigint")
    meetings = {r["name"]: r["n_meetings"] for r in meetings_per_participant(scores).collect()}
    assert meetings == {"Ann": 2, "Bob": 1}
    ann, bob = consistency(scores, F.col("score")).orderBy("name").collect()
    assert (ann["n_scores"], ann["avg_score"], ann["min_score"], ann["max_score"]) == (3, 6.0, 4, 8)
    assert ann["stddev_score"] == pytest.approx(2.0)
    assert bob["n_scores"] == 0 and bob["avg_score"] is None


class Logged:
    """Upper case; notes every request in a file; refuses texts that contain ``bad``."""

    def __init__(self, log):
        self.log = log

    def __call__(self):
        def call(texts):
            with open(self.log, "a") as file:
                file.write(json.dumps(texts) + "\n")
            if any("bad" in t for t in texts):
                raise RuntimeError("refused")
            return [t.upper() for t in texts]

        return call

    def requests(self):
        if not os.path.exists(self.log):
            return []
        with open(self.log) as file:
            return [json.loads(line) for line in file]


def test_infer_isolates_bad_rows(spark, folder):
    model = Logged(f"{folder}/log")
    rows = spark.createDataFrame(
        [(1, "a"), (2, "bad b"), (3, "c"), (4, None), (5, "far too long")], "id bigint, prompt string"
    ).coalesce(1)
    found = infer(rows, "prompt", model, pause_seconds=0, max_chars=8).orderBy("id").collect()
    assert [r["response"] for r in found] == ["A", None, "C", None, None]
    assert [r["error"] for r in found] == [
        None, "RuntimeError: refused", None, "input is null", "input exceeds 8 characters"
    ]
    assert model.requests().count(["bad b"]) == 3


def test_infer_notices_missing_outputs(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "prompt string").coalesce(1)
    found = infer(rows, "prompt", lambda: lambda texts: texts[:-1], attempts=1).collect()
    assert all("0 outputs for 1 inputs" in r["error"] for r in found)


def test_infer_once_repeats_no_call(spark, folder):
    model, store = Logged(f"{folder}/log"), f"{folder}/store"
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id bigint, prompt string")
    first = infer_once(rows, "prompt", model, store).orderBy("id")
    assert [r["response"] for r in first.collect()] == ["A", "B", "A"]
    first.filter("response = 'A'").count()
    assert sorted(t for request in model.requests() for t in request) == ["a", "b"]
    more = rows.unionByName(spark.createDataFrame([(4, "d"), (5, "bad")], rows.schema))
    second = infer_once(more, "prompt", model, store, pause_seconds=0, attempts=1).orderBy("id").collect()
    assert [r["response"] for r in second] == ["A", "B", "A", "D", None]
    assert second[4]["error"] == "RuntimeError: refused"
    sent = [t for request in model.requests() for t in request]
    assert sent.count("a") == 1 and sent.count("b") == 1
    third = infer_once(more, "prompt", lambda: lambda t: [x.upper() for x in t], store).orderBy("id")
    assert [r["error"] for r in third.collect()] == [None] * 5


def test_calls_are_dealt_to_the_tasks_asked_for(spark, folder):
    def factory():
        from pyspark import TaskContext

        return lambda texts: [str(TaskContext.get().partitionId()) for _ in texts]

    rows = spark.range(2000).select(F.concat(F.lit("prompt "), F.col("id").cast("string")).alias("prompt"))
    found = infer_once(rows, "prompt", factory, f"{folder}/store", tasks=6)
    assert {r["response"] for r in found.collect()} == {str(n) for n in range(6)}


def test_parts_of_a_conversation_become_one_row_per_person(spark):
    prompts = [("c", 1, response(participant(strengths=["b", "a"], performance_score=5), participant(name="Bob"))),
               ("c", 0, response(participant(strengths=["a"], performance_score=8, role="first")))]
    df = spark.createDataFrame(prompts, "conversation_id string, part bigint, response string")
    rows = explode_participants(parse_assessment(df), ["conversation_id", "part"])
    ann, bob = merge_parts(rows, ["conversation_id"]).orderBy("name").collect()
    assert (ann["participant"]["strengths"], ann["participant"]["performance_score"]) == (["a", "b"], 7)
    assert (ann["participant"]["role"], bob["participant"]["role"]) == ("first text", "text")
    assert set(ann["participant"].asDict()) == set(PARTICIPANT_KEYS)


class Joiner:
    """Merges assessments by joining their summaries; refuses what mentions ``refused``."""

    def __init__(self, log):
        self.log = log

    def __call__(self):
        def merge(prompt):
            with open(self.log, "a") as file:
                file.write("x\n")
            texts = json.loads(prompt[prompt.index(MERGE_MARK) + len(MERGE_MARK) : prompt.rindex(MERGE_END)])
            if any("refused" in t["sales_impact"] for t in texts):
                return "no"
            joined = {**texts[0], "name": "someone", "sales_impact": "+".join(t["sales_impact"] for t in texts)}
            return json.dumps({"participants": [joined]})

        return lambda prompts: [merge(p) for p in prompts]


def test_parts_are_merged_in_rounds(spark, folder):
    def rows(call, n, said):
        return [(call, i, response(participant(sales_impact=said(i)))) for i in range(n)]

    parts = rows("c", 23, lambda i: f"<{i}>") + rows("d", 1, lambda i: "alone") + rows("e", 3, lambda i: f"refused{i}")
    df = spark.createDataFrame(parts, "conversation_id string, part bigint, response string")
    people = explode_participants(parse_assessment(df), ["conversation_id", "part"])
    found = merge_parts(people, ["conversation_id"], Joiner(f"{folder}/log"), f"{folder}/store", fan_in=4).collect()
    said = {r["conversation_id"]: r["participant"]["sales_impact"] for r in found}
    assert said == {"c": "+".join(f"<{i}>" for i in range(23)), "d": "alone", "e": "refused0 refused1 refused2"}
    assert {r["name"] for r in found} == {r["participant"]["name"] for r in found} == {"Ann"}
    # 23 parts give 6, then 2, then 1: nine prompts; the three of the other call one.
    with open(f"{folder}/log") as file:
        assert len(file.readlines()) == 6 + 2 + 1 + 1


def test_quarantine_holds_failed_calls_and_bad_answers(spark, folder):
    prompts = spark.createDataFrame(
        [("c1", "fine"), ("c2", "nonsense"), ("c3", "down")], "conversation_id string, prompt string"
    )

    def factory():
        def call(texts):
            if "down" in texts:
                raise RuntimeError("no line")
            return [response(participant()) if t == "fine" else "?" for t in texts]

        return call

    good, bad = assess_prompts(prompts, factory, f"{folder}/store", pause_seconds=0)
    assert [r["conversation_id"] for r in good.collect()] == ["c1"]
    assert {r["conversation_id"]: r["problems"] for r in bad.collect()} == {
        "c2": ["not a JSON object"],
        "c3": ["call failed: RuntimeError: no line"],
    }


def test_embedding_requests(spark, folder):
    def factory():
        def call(texts):
            assert len(texts) <= limit
            return [[float(len(t)), 1.0] for t in texts]

        return call

    rows = [(n, None if n % 10 == 0 else "x" * n) for n in range(400)]
    df = spark.createDataFrame(rows, "id bigint, text string").repartition(3)
    results = []
    for limit in (1, 7, 150):
        found = df.select("id", embed(F.col("text"), factory, limit).alias("v")).orderBy("id").collect()
        results.append([r["v"] for r in found])
    assert results[0] == results[1] == results[2]
    assert results[0] == [None if n % 10 == 0 else [float(n), 1.0] for n in range(400)]


def test_embedding_failure_fails_the_job(spark):
    def factory():
        def call(texts):
            raise RuntimeError("no line")

        return call

    df = spark.createDataFrame([("a",)], "text string")
    with pytest.raises(Exception, match="no line"):
        df.select(embed(F.col("text"), factory)).collect()
