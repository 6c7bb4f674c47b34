"""Keeping embeddings up to date with a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnwise.config import path_exists, remove_folder
from turnwise.functions.models import EMBEDDING_REQUEST_LIMIT, ModelFactory, embed
from turnwise.operators.changes import content_hash, with_content_key
from turnwise.operators.distribution import stored

ID_BUCKET = "id_bucket"
ID_BUCKETS = 16
FEW_IDS = 50_000  # changed ids that are broadcast, so that only their texts are shuffled
KEPT, GIVEN, MARK = 0, 1, 2


def append_stream(stream: DataFrame, table: str, checkpoint: str) -> None:
    """Append all rows that are new since the last run to a table, then stop."""
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
    if "/" in table:
        writer.format("parquet").option("path", table).start().awaitTermination()
    else:
        writer.toTable(table).awaitTermination()


def participant_content(participants: DataFrame) -> DataFrame:
    """Participant rows with the text to embed: the whole struct as JSON."""
    return participants.select(
        "conversation_id", F.to_json("participant").alias("content"), "name"
    )


def _keyed_rows(rows: DataFrame, key: list[str], buckets: int) -> DataFrame:
    """``rows`` with an id made from the key columns, a hash of the rest and a bucket."""
    named = with_content_key(rows, key)
    hashed = named.withColumn("content_hash", content_hash(named, ["id"]))
    return hashed.withColumn(ID_BUCKET, F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))


def _states(rows: DataFrame) -> DataFrame:
    """(id, id_bucket, content_hash), one row per id: of several rows that with the largest hash counts."""
    return rows.groupBy("id", ID_BUCKET).agg(F.max("content_hash").alias("content_hash"))


def _known(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(f"id string, content_hash string, {ID_BUCKET} int").parquet(folder)


def _numbers(df: DataFrame) -> set[int]:
    """At most as many numbers as there are buckets."""
    return {r[ID_BUCKET] for r in df.select(ID_BUCKET).distinct().collect()}


def _changes(states: DataFrame, folder: str) -> DataFrame:
    """(id, id_bucket, content_hash, replaced): the ids of ``states`` that the sink lacks or has with other content."""
    known = _known(states.sparkSession, folder).filter(F.col(ID_BUCKET).isin(_numbers(states)))
    there = known.select("id", F.col("content_hash").alias("old_hash"))
    found = states.join(there, "id", "left").filter("old_hash IS NULL OR old_hash <> content_hash")
    return found.select("id", ID_BUCKET, "content_hash", F.col("old_hash").isNotNull().alias("replaced"))


def _merge(rows: DataFrame, changes: DataFrame, folder: str, model: ModelFactory, text: str, request_size: int, tasks: int | None) -> None:
    """Bring the ids of ``changes`` (id, id_bucket, content_hash, replaced) in the sink to the state of ``rows``.

    A null content_hash takes an id out. Rows of other ids are not embedded; new ids are appended; a bucket that loses or
    changes a row is rewritten. Texts go through one shuffle, together with the rows that a rewritten bucket
    keeps. A merge that was stopped can be repeated.
    """
    spark = rows.sparkSession
    schema = T.StructType([*rows.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])
    touched, changed = _numbers(changes), _numbers(changes.filter("replaced"))
    there = path_exists(spark, folder)
    if there and not touched:
        return
    wanted = changes.filter("content_hash IS NOT NULL").select("id", "content_hash")
    if wanted.count() <= FEW_IDS:
        rows = rows.join(F.broadcast(wanted), ["id", "content_hash"], "left_semi").select(rows.columns)
    old = spark.read.schema(schema).parquet(folder) if there else spark.createDataFrame([], schema)

    def brought(buckets: set[int]) -> DataFrame:
        here = F.col(ID_BUCKET).isin(buckets)
        marks = changes.filter(here).select("id", ID_BUCKET, "content_hash", F.lit(MARK).alias("_kind"))
        parts = [old.filter(here).withColumn("_kind", F.lit(KEPT)), rows.filter(here).withColumn("_kind", F.lit(GIVEN)), marks]
        whole = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
        dealt = whole.repartitionByRange(tasks or spark.sparkContext.defaultParallelism, ID_BUCKET, "id")
        # An id's mark comes first, then the given rows by hash.
        order = Window.partitionBy(ID_BUCKET, "id").orderBy(F.desc("_kind"), "content_hash")
        seen = dealt.select(
            "*",
            (F.first("_kind").over(order) == MARK).alias("_marked"),
            F.first("content_hash").over(order).alias("_wanted"),
            F.lag("_kind").over(order).eqNullSafe(F.lit(GIVEN)).alias("_again"),
            F.lag("content_hash").over(order).eqNullSafe(F.col("content_hash")).alias("_same"),
        )
        stays = (F.col("_kind") == KEPT) & ~F.col("_marked")
        counts = (F.col("_kind") == GIVEN) & F.col("_marked") & F.col("content_hash").eqNullSafe(F.col("_wanted")) & ~(F.col("_again") & F.col("_same"))
        kept = seen.filter(stays | counts)
        given = F.col("_kind") == GIVEN
        fresh = kept.withColumn("_fresh", embed(F.when(given, F.col(text)), model, request_size))
        return fresh.withColumn("embedding", F.when(given, F.col("_fresh")).otherwise(F.col("embedding"))).select(schema.names)

    if changed:
        known = _known(spark, folder).filter(F.col(ID_BUCKET).isin(changed))
        left = _numbers(known.join(changes.select("id"), "id", "left_anti")) | _numbers(changes.filter("content_hash IS NOT NULL"))
        writer = brought(changed).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(ID_BUCKET).parquet(folder)
        for empty in changed - left:
            remove_folder(spark, f"{folder}/{ID_BUCKET}={empty}")
    if touched - changed or not there:
        old = old.limit(0)
        brought(touched - changed).write.mode("append").partitionBy(ID_BUCKET).parquet(folder)


def _bring(rows: DataFrame, folder: str, model: ModelFactory, text: str, request_size: int, tasks: int | None) -> None:
    states = stored(_states(rows), "vector-states")
    if path_exists(rows.sparkSession, folder):
        changes = stored(_changes(states, folder), "vector-changes")
    else:
        changes = states.withColumn("replaced", F.lit(False))
    _merge(rows, changes, folder, model, text, request_size, tasks)


def embed_stream(
    stream: DataFrame,
    folder: str,
    checkpoint: str,
    model: ModelFactory,
    key: list[str],
    text: str = "content",
    request_size: int = EMBEDDING_REQUEST_LIMIT,
    tasks: int | None = None,
    buckets: int = ID_BUCKETS,
) -> None:
    """Embed the rows that are new since the last run and merge them into a folder, then stop.

    A backlog is cut into batches by the ``files_per_trigger`` of the stream's source; each batch is
    embedded in ``tasks`` tasks, the cluster's default parallelism if not given. Rows get an ``id`` made from
    their ``key`` columns and are kept in ``buckets`` folders by it; a batch reads only the buckets that its ids
    are in. A row whose id is there with the same content is not embedded again; with other content it
    takes the old one's place. Of several rows with one id in a batch one counts. A repeated batch changes
    nothing. Rows that left the source are not seen by a stream: see ``sync_vectors``.
    """

    def write(batch: DataFrame, number: int) -> None:
        _bring(_keyed_rows(batch, key, buckets), folder, model, text, request_size, tasks)

    query = (
        stream.writeStream.trigger(availableNow=True)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()


def sync_vectors(
    present: DataFrame,
    folder: str,
    model: ModelFactory,
    key: list[str],
    text: str = "content",
    request_size: int = EMBEDDING_REQUEST_LIMIT,
    tasks: int | None = None,
    buckets: int = ID_BUCKETS,
) -> None:
    """Bring the folder of ``embed_stream`` to the ids of ``present``, the source as it is now.

    A source that was replaced leaves vectors of rows it no longer has: these are found by a diff of ids and
    hashes and taken out of their buckets; rows that no batch has brought are embedded.
    """
    spark = present.sparkSession
    rows = _keyed_rows(present, key, buckets)
    if not path_exists(spark, folder):
        _bring(rows, folder, model, text, request_size, tasks)
        return
    states = stored(_states(rows), "vector-states")
    gone = _known(spark, folder).join(states.select("id"), "id", "left_anti").select("id", ID_BUCKET)
    gone = gone.select("id", ID_BUCKET, F.lit(None).cast("string").alias("content_hash"), F.lit(True).alias("replaced"))
    changes = stored(_changes(states, folder).unionByName(gone), "vector-changes")
    _merge(rows, changes, folder, model, text, request_size, tasks)


def read_vectors(spark: SparkSession, folder: str, schema: T.StructType | None = None) -> DataFrame:
    """The rows of the folder, one per id: id, the source's columns and embedding.

    With ``schema`` these columns; a folder that is absent or has lost all rows then gives no rows.
    """
    if schema is not None:
        return spark.read.schema(schema).parquet(folder) if path_exists(spark, folder) else spark.createDataFrame([], schema)
    return spark.read.parquet(folder).drop("content_hash", ID_BUCKET)
