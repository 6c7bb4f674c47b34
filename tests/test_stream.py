from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F
from test_search import Counting

from turnwise.schemas import EMBEDDED
from turnwise.sources.tables import (
    append_batch,
    create_table,
    read_batches,
    replace_table,
    scan,
    stream_table,
)
from turnwise.streaming import embedding
from turnwise.streaming.embedding import append_stream, embed_stream, read_vectors, sync_vectors

SCHEMA = "conversation_id string, content string, name string"
KEY = ["conversation_id", "name", "content"]


def rows(spark, *numbers):
    values = [(f"c{n}", f"content {n}", f"name {n}") for n in numbers]
    return spark.createDataFrame(values, SCHEMA)


def sent(path):
    if not os.path.exists(path):
        return []
    with open(path) as file:
        return sorted(file.read().split("\n")[:-1])


def test_only_new_rows_are_embedded(spark, folder):
    model = Counting(f"{folder}/log")
    source, sink, checkpoint = f"{folder}/source", f"{folder}/sink", f"{folder}/checkpoint"

    def run():
        stream = stream_table(spark, source, rows(spark).schema)
        embed_stream(stream, sink, checkpoint, model, KEY)
        found = read_vectors(spark, sink)
        return sorted(r["conversation_id"] for r in found.collect())

    rows(spark, 1, 2, 3).write.parquet(source)
    assert run() == ["c1", "c2", "c3"]
    assert run() == ["c1", "c2", "c3"]
    # Known rows in a new file, a row twice in it, and a new row.
    rows(spark, 2, 3, 4, 4).write.mode("append").parquet(source)
    assert run() == ["c1", "c2", "c3", "c4"]
    assert sent(f"{folder}/log") == [f"content {n}" for n in (1, 2, 3, 4)]
    found = read_vectors(spark, sink)
    assert set(EMBEDDED.names) <= set(found.columns)
    assert found.select("id").distinct().count() == 4


def test_a_repeated_batch_changes_nothing(spark, folder):
    source, sink = f"{folder}/source", f"{folder}/sink"
    model = Counting(f"{folder}/log")
    rows(spark, 1, 2).write.parquet(source)
    for attempt in (1, 2):  # a new checkpoint brings all rows again
        embed_stream(stream_table(spark, source, rows(spark).schema), sink, f"{folder}/checkpoint{attempt}", model, KEY)
    assert sorted(r["conversation_id"] for r in read_vectors(spark, sink).collect()) == ["c1", "c2"]
    assert len(sent(f"{folder}/log")) == 2


def test_a_replaced_source_leaves_no_stale_rows(spark, folder):
    """Three rows replaced by four: one goes, one changes, one stays and two are new."""
    source, sink, checkpoint = f"{folder}/source", f"{folder}/sink", f"{folder}/checkpoint"
    model, key = Counting(f"{folder}/log"), ["conversation_id"]

    def run(df):
        df.write.mode("overwrite").parquet(source)
        embed_stream(stream_table(spark, source, df.schema), sink, checkpoint, model, key, buckets=2)
        sync_vectors(spark.read.parquet(source), sink, model, key, buckets=2)
        return sorted((r["conversation_id"], r["content"]) for r in read_vectors(spark, sink, EMBEDDED).collect())

    changed = F.when(F.col("conversation_id") == "c2", "changed").otherwise(F.col("content"))
    assert run(rows(spark, 1, 2, 3)) == [(f"c{n}", f"content {n}") for n in (1, 2, 3)]
    expected = [("c2", "changed"), ("c3", "content 3"), ("c4", "content 4"), ("c5", "content 5")]
    assert run(rows(spark, 2, 3, 4, 5).withColumn("content", changed)) == expected
    assert sent(f"{folder}/log") == sorted([f"content {n}" for n in (1, 2, 3, 4, 5)] + ["changed"])
    assert run(rows(spark)) == []


@pytest.mark.parametrize("with_folder", [False, True])
def test_a_replacement_that_was_stopped_is_finished_by_the_next_use(spark, folder, with_folder):
    spark.sql("DROP TABLE IF EXISTS stopped")
    spark.sql("DROP TABLE IF EXISTS stopped__fresh")
    place = folder if with_folder else None
    replace_table(rows(spark, 1), "stopped", place)
    replace_table(rows(spark, 1, 2), "stopped", place)
    assert scan(spark, "stopped").count() == 2
    # The state after the old table was dropped: only the second table is there.
    rows(spark, 1, 2, 3).drop("name").write.format("parquet").saveAsTable("stopped__fresh")
    spark.sql("DROP TABLE stopped")
    assert scan(spark, "stopped").columns == ["conversation_id", "content"] and scan(spark, "stopped").count() == 3
    replace_table(scan(spark, "stopped").limit(1), "stopped", place)
    assert scan(spark, "stopped").count() == 1 and not spark.catalog.tableExists("stopped__fresh")


def test_append_stream_into_a_table(spark, folder):
    spark.sql("DROP TABLE IF EXISTS stream_source")
    spark.sql("DROP TABLE IF EXISTS stream_sink")
    rows(spark, 1, 2).write.format("parquet").saveAsTable("stream_source")
    for expected in (2, 2):
        append_stream(stream_table(spark, "stream_source"), "stream_sink", f"{folder}/checkpoint")
        assert spark.table("stream_sink").count() == expected
    rows(spark, 3).write.mode("append").format("parquet").saveAsTable("stream_source")
    append_stream(stream_table(spark, "stream_source"), "stream_sink", f"{folder}/checkpoint")
    assert sorted(r["conversation_id"] for r in scan(spark, "stream_sink").collect()) == ["c1", "c2", "c3"]


def test_batches_may_bring_columns(spark, folder):
    append_batch(rows(spark, 1), f"{folder}/sink", 0)
    append_batch(rows(spark, 2).withColumn("score", F.lit(5)), f"{folder}/sink", 1)
    append_batch(rows(spark, 3).withColumn("score", F.lit(6)), f"{folder}/sink", 1)
    found = read_batches(spark, f"{folder}/sink").orderBy("conversation_id").collect()
    assert [(r["conversation_id"], r["score"]) for r in found] == [("c1", None), ("c3", 6)]
    assert read_batches(spark, f"{folder}/none", EMBEDDED).count() == 0


def test_replace_table_may_read_itself(spark):
    spark.sql("DROP TABLE IF EXISTS replaced")
    replace_table(rows(spark, 1, 2), "replaced")
    replace_table(spark.table("replaced").filter("conversation_id = 'c2'").drop("name"), "replaced")
    assert spark.table("replaced").columns == ["conversation_id", "content"]
    assert spark.table("replaced").count() == 1
    assert not spark.catalog.tableExists("replaced__fresh")


@pytest.mark.parametrize("times", [1, 2])
def test_create_table_is_idempotent(spark, times):
    spark.sql("DROP TABLE IF EXISTS vectors")
    for _ in range(times):
        create_table(spark, "vectors", EMBEDDED)
    assert spark.table("vectors").schema["embedding"].dataType.simpleString() == "array<float>"
    spark.sql("DROP TABLE vectors")


def test_a_table_that_is_a_folder_of_files_is_streamed_by_its_name(spark, folder):
    rows(spark, 1, 2, 3, 4).repartition(3).write.parquet(f"{folder}/calls.parquet")
    rows(spark, 5).coalesce(1).write.parquet(f"{folder}/others.parquet")
    stream = stream_table(spark, folder, rows(spark).schema, files="calls.parquet")
    embed_stream(stream, f"{folder}/sink", f"{folder}/checkpoint", Counting(f"{folder}/log"), KEY)
    found = read_vectors(spark, f"{folder}/sink")
    assert sorted(r["conversation_id"] for r in found.collect()) == ["c1", "c2", "c3", "c4"]


def test_texts_are_shuffled_once_per_merge(spark, folder, monkeypatch):
    schema, model = "key string, content string", Counting(f"{folder}/log")
    monkeypatch.setattr(embedding, "FEW_IDS", 0)
    written, write = [], embedding.stored

    def narrow(df, purpose):
        written.append(df.columns)
        return write(df, purpose)

    monkeypatch.setattr(embedding, "stored", narrow)

    def sync(*given):
        df = spark.createDataFrame(list(given), schema)
        sync_vectors(df, f"{folder}/sink", model, ["key"], buckets=2)
        found = read_vectors(spark, f"{folder}/sink")
        assert all(len(r["embedding"]) > 0 for r in found.filter("content IS NOT NULL").collect())
        return sorted((r["key"], r["content"]) for r in found.collect())

    one = [("a", "one"), ("b", "two"), ("b", "two"), ("c", "three"), ("d", None)]
    assert sync(*one) == [("a", "one"), ("b", "two"), ("c", "three"), ("d", None)]
    two = [("b", "two"), ("c", "other"), ("c", "other"), ("e", "new"), ("d", None)]
    assert sync(*two) == [("b", "two"), ("c", "other"), ("d", None), ("e", "new")]
    assert sync(("e", "new")) == [("e", "new")]
    assert sent(f"{folder}/log") == sorted(["one", "two", "three", "other", "new"])
    # Only keys and hashes are written on the way.
    assert not any("content" in columns for columns in written)
