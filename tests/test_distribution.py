from __future__ import annotations

from pyspark.sql import functions as F

from turnwise.functions.nested import append_frames
from turnwise.operators import chat, distribution, transcript
from turnwise.functions.text import mask_pii, stand_in, tag_role, tokens
from turnwise.operators.changes import change_rows
from turnwise.operators.distribution import hash_slices, spread_join, stored, top_k
from turnwise.plans import derived


def hot_rows(spark):
    """A key with half of all rows, a key without facts, and keys with one row."""
    key = (
        F.when(F.col("id") < 5000, "hot").when(F.col("id") < 5100, "none").otherwise(F.col("id").cast("string"))
    )
    return spark.range(10_000).select(key.alias("key"), F.col("id").alias("n"))


def test_spread_join_equals_join(spark):
    rows = hot_rows(spark)
    facts = rows.filter("key <> 'none'").groupBy("key").agg(F.max("n").alias("top"))
    for how in ("inner", "left"):
        for hot in (100, 4000, 1_000_000):
            found = spread_join(rows, facts, ["key"], [F.col("n")], how, hot_rows=hot)
            expected = rows.join(facts, ["key"], how)
            assert found.columns == expected.columns
            assert found.exceptAll(expected).count() == 0
            assert expected.exceptAll(found).count() == 0


def test_spread_join_keeps_null_keys(spark):
    rows = spark.createDataFrame([(None, 1), ("a", 2), ("a", 3)], "key string, n bigint")
    facts = spark.createDataFrame([("a", 5), (None, 6)], "key string, top bigint")
    found = spread_join(rows, facts, ["key"], [F.col("n")], "left", hot_rows=1)
    assert sorted((r["n"], r["top"]) for r in found.collect()) == [(1, None), (2, 5), (3, 5)]


def test_spread_join_spreads_a_hot_key(spark):
    """Without broadcasts, no task of the final join holds the hot key as a whole."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        rows = hot_rows(spark)
        facts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
        joined = spread_join(rows, facts, ["key"], [F.col("n")], hot_rows=100)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 10_000
        assert max(sizes) < 2500
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_operators_with_a_hot_conversation(spark, monkeypatch):
    """The same results with every key of more than 20 rows cut into slices."""
    n = F.col("id")
    turns = spark.range(3000).select(
        F.when(n < 1000, 0).otherwise((n / 5).cast("long")).cast("long").alias("conv_id"),
        F.when(n < 1000, n).otherwise(n % 5).alias("turn"),
        F.when(n % 3 == 0, "user").otherwise("assistant").alias("role"),
        F.concat(F.lit("text "), n.cast("string")).alias("text"),
    )
    sentences, attendees = derived.turns_as_sentences(turns), derived.roles_as_attendees(turns)

    def results():
        lines = transcript.label_speakers_rows(sentences, attendees)
        packed = chat.rewrite_prompts(turns)
        return [
            sorted(map(tuple, df.collect()))
            for df in (lines, transcript.talk_time(sentences), packed)
        ]

    plain = results()
    monkeypatch.setattr(distribution, "HOT_ROWS", 20)
    assert results() == plain
    assert [len(rows) for rows in plain] == [3000, 802, 401]


def test_top_k_by_slices_equals_top_k(spark):
    rows = hot_rows(spark).withColumn("score", F.pmod(F.col("n") * 7, F.lit(50)))
    order = [F.col("score").desc(), F.col("n").asc()]
    plain = top_k(rows, ["key"], order, 5)
    sliced = top_k(rows, ["key"], order, 5, slice_of=hash_slices(F.col("n"), slices=8))
    assert plain.exceptAll(sliced).count() == 0 and sliced.exceptAll(plain).count() == 0


def test_stored_rows_are_computed_once(spark):
    drawn = stored(spark.range(5).withColumn("x", F.rand()), "drawn")
    assert drawn.collect() == drawn.collect()


def test_changes_see_nulls_and_moved_values(spark):
    schema = "k bigint, a string, b string"
    before = [(1, "x", None), (2, "x", "y"), (3, None, None), (4, "x", "y")]
    after = [(1, None, "x"), (2, "x", "y"), (3, None, ""), (5, "x", "y")]
    found = change_rows(spark.createDataFrame(before, schema), spark.createDataFrame(after, schema), ["k"])
    assert {(r["k"], r["change"]) for r in found.collect()} == {
        (1, "update"), (3, "update"), (4, "delete"), (5, "insert")
    }


def test_append_frames(spark):
    a = spark.createDataFrame([(1, "x")], "n bigint, a string")
    b = spark.createDataFrame([("y", 2)], "b string, n bigint")
    found = append_frames(a, b).orderBy("n").collect()
    assert [tuple(r) for r in found] == [(1, "x", None), (2, None, "y")]


def test_masking(spark):
    names = F.array(F.lit("Ann"), F.lit("Ann Lee"), F.lit(""), F.lit(None), F.lit("person"), F.lit("1"))
    text = "Ann Lee (ann.lee@x.example, +44 20 7946 0958) and Ann, a person with 123456 and 1."
    row = spark.range(1).select(
        mask_pii(F.lit(text), names, "salt").alias("masked"),
        stand_in(F.lit("Ann"), "salt", "person-").alias("ann"),
        stand_in(F.lit("Ann Lee"), "salt", "person-").alias("lee"),
        stand_in(F.lit("person"), "salt", "person-").alias("person"),
        stand_in(F.lit("1"), "salt", "person-").alias("one"),
        mask_pii(F.lit("x Ann"), F.lit(None).cast("array<string>"), "salt").alias("unnamed"),
        mask_pii(F.lit(None).cast("string"), names, "salt").alias("null_text"),
    ).first()
    assert "Ann" not in row["masked"] and "@" not in row["masked"] and "7946" not in row["masked"]
    assert row["masked"].startswith(f"{row['lee']} ([email], ")
    assert f" and {row['ann']}, a {row['person']} with " in row["masked"]
    assert row["masked"].endswith(f" and {row['one']}.")
    assert row["unnamed"] == "x Ann" and row["null_text"] is None


def test_roles_and_tokens(spark):
    row = spark.range(1).select(
        tag_role(F.lit("bob@ACME.example"), "acme").alias("inside"),
        tag_role(F.lit("ann@x.example"), "acme").alias("outside"),
        tokens(F.lit("Été, 2nd-hand Straße!")).alias("tokens"),
    ).first()
    assert (row["inside"], row["outside"]) == ("sales rep", "customer")
    assert row["tokens"] == ["été", "2nd", "hand", "straße"]
