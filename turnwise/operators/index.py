"""A search index as ordinary tables in one folder, partitioned by a hash of the key.

``docs`` holds pk, content, payload columns, vector, its length and content hash. Two tables are
made from it, bucket by bucket, in the form in which a search reads them:

``postings`` has a row per term and block. A block is some hundred documents of one bucket that are alike in
length; the row lists the block's documents with the term, and the largest count and the smallest
length among them, from which follows the most that the term can add to a score in the block.

``vectors`` has a row per list of up to about a thousand vectors of one bucket and one cell. Cells are the
surroundings of centroids, which are fitted on a bounded sample; the row also holds the smallest cosine
of its vectors to the centroid, from which follows the best score that a query can have in the list.

``terms`` (term, df, tf) and ``totals`` (n, sum_dl) are the statistics that keyword scores need, ``cells`` the centroids.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from turnwise.config import path_exists, remove_folder
from turnwise.functions.models import EMBEDDING_REQUEST_LIMIT, ModelFactory, embed
from turnwise.functions.text import tokens
from turnwise.operators.changes import change_kinds, content_hash
from turnwise.operators.distribution import stored, use_all_cores

PK = "pk"
CONTENT = "content"
EMBEDDING = "embedding"
BUCKET = "bucket"
BUCKETS = 16
TEXTS_PER_COUNT = 256
BLOCK_DOCS = 512  # documents per block of postings
PART_CHARS = 1 << 26  # characters of documents that a task sorts or writes
CHUNK_ROWS = 1024  # vectors that are packed into one row
SAMPLE_VECTORS = 8192  # vectors at most that centroids are fitted on
VECTORS_PER_CELL, MOST_CELLS = 64, 1024  # per bucket
FIT_ROUNDS = 8


@dataclass(frozen=True)
class Index:
    """The readable state of an index; only ``docs`` is needed for a search by vector."""

    docs: DataFrame
    postings: DataFrame | None = None
    terms: DataFrame | None = None
    totals: DataFrame | None = None
    vectors: DataFrame | None = None
    cells: DataFrame | None = None


def check_dimension(df: DataFrame, dim: int, vector_col: str = EMBEDDING) -> tuple[DataFrame, DataFrame]:
    """Split into rows whose vector has the declared length and the rest, nulls included."""
    fits = F.coalesce(F.size(vector_col) == dim, F.lit(False))
    return df.filter(fits), df.filter(~fits)


def vector_norm(vector: Column) -> Column:
    squares = F.aggregate(
        vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")
    )
    return F.sqrt(squares)


def _posting_schema(pk_type: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("term", T.StringType()),
            T.StructField(PK, pk_type),
            T.StructField("tf", T.IntegerType()),
            T.StructField("dl", T.IntegerType()),
        ]
    )


def term_counts(df: DataFrame, pk: str, text: str) -> DataFrame:
    """(term, pk, tf, dl) per document and token. Each document is counted where it is read."""
    schema = _posting_schema(df.schema[pk].dataType)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, TEXTS_PER_COUNT):
                batch = whole.slice(start, TEXTS_PER_COUNT)
                keys, lists = batch.column(0), batch.column(1)
                lengths = pc.list_value_length(lists).cast(pa.int32())
                counted = (
                    pa.table({"row": pc.list_parent_indices(lists), "term": pc.list_flatten(lists)})
                    .group_by(["row", "term"])
                    .aggregate([([], "count_all")])
                )
                rows = counted.column("row")
                out = pa.table(
                    {
                        "term": counted.column("term"),
                        PK: pc.take(keys, rows),
                        "tf": counted.column("count_all").cast(pa.int32()),
                        "dl": pc.take(lengths, rows),
                    }
                )
                yield from out.combine_chunks().to_batches(max_chunksize=1 << 16)

    return df.select(F.col(pk), tokens(F.col(text)).alias("tokens")).mapInArrow(count, schema)


def _block_schema(pk_type: T.DataType) -> T.StructType:
    numbers = [T.StructField(name, T.IntegerType()) for name in (BUCKET, "block")]
    lists = [T.StructField(name, T.ArrayType(kind)) for name, kind in (("pks", pk_type), ("tfs", T.IntegerType()), ("dls", T.IntegerType()))]
    bounds = [T.StructField(name, T.IntegerType()) for name in ("n", "sum_tf", "max_tf", "min_dl")]
    return T.StructType([*numbers, T.StructField("term", T.StringType()), *lists, *bounds])


def posting_blocks(docs: DataFrame) -> DataFrame:
    """(bucket, block, term, pks, tfs, dls, n, sum_tf, max_tf, min_dl) of documents (bucket, pk, content).

    Documents are dealt out in ranges of bucket and length and cut into blocks of at most ``BLOCK_DOCS`` there; each
    block is counted where it is read, with no more than its own texts in memory. A block's number is unique
    in its bucket.
    """
    schema = _block_schema(docs.schema[PK].dataType)
    fields = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields])

    def counted(rows: pa.Table) -> list[pa.RecordBatch]:
        keys, lists = rows.column(PK).combine_chunks(), rows.column("tokens").combine_chunks()
        lengths = pc.list_value_length(lists).to_numpy()
        coded = lists.flatten().dictionary_encode()
        numbers = coded.indices.to_numpy().astype(np.int64) * len(keys) + np.repeat(np.arange(len(keys)), lengths)
        pair, tf = np.unique(numbers, return_counts=True)
        term, row = np.divmod(pair, len(keys))
        starts = np.flatnonzero(np.diff(term, prepend=-1))
        ends, dl = np.append(starts, len(pair)), lengths[row]
        place = [np.full(len(starts), rows.column(i)[0].as_py()) for i in (0, 1)]
        values = [keys.take(pa.array(row)), pa.array(tf), pa.array(dl)]
        bounds = [np.diff(ends), np.add.reduceat(tf, starts), np.maximum.reduceat(tf, starts), np.minimum.reduceat(dl, starts)]
        lists_of = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x) for x in values]
        whole = pa.table([*place, coded.dictionary, *lists_of, *bounds], names=fields.names).cast(fields)
        return whole.combine_chunks().to_batches(max_chunksize=1 << 14)

    n, most = parts_of(docs), BLOCK_DOCS

    def with_tokens(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pc.greater(pc.list_value_length(batch.column(2)), 0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, rows in enumerate(_blocks(map(with_tokens, batches), most)):
            block = pa.array(np.full(rows.num_rows, number * n + task), pa.int32())
            yield from counted(rows.add_column(1, "block", block))

    # Ranges are alike in size, whatever the buckets are; a bucket may end in one range and go on in the next. Rows
    # without tokens go in the tasks that count: a filter here would be moved before the ranges, where texts are cut in vain.
    sized = docs.select(BUCKET, PK, CONTENT, F.length(CONTENT).alias("size"))
    dealt = sized.repartitionByRange(n, BUCKET, "size", PK).sortWithinPartitions(BUCKET, "size", PK)
    return dealt.select(BUCKET, PK, tokens(F.col(CONTENT)).alias("tokens")).mapInArrow(count, schema)


def parts_of(docs: DataFrame) -> int:
    """Into how many parts a table (content) is dealt: as many as there are cores, more where these were large."""
    chars = docs.agg(F.sum(F.length(CONTENT)).alias("n")).first()["n"] or 0
    return max(docs.sparkSession.sparkContext.defaultParallelism, -(-chars // PART_CHARS))


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Rows in their order, ``most`` at a time; rows of two buckets are never in one block."""
    held, size, bucket = [], 0, None
    for batch in batches:
        buckets = batch.column(0).to_numpy()
        cuts = np.flatnonzero(buckets[1:] != buckets[:-1]) + 1
        for start, end in zip([0, *cuts], [*cuts, batch.num_rows]):
            while start < end:
                if held and (size == most or buckets[start] != bucket):
                    yield pa.Table.from_batches(held).combine_chunks()
                    held, size = [], 0
                taken = min(end - start, most - size)
                held.append(batch.slice(start, taken))
                size, bucket, start = size + taken, buckets[start], start + taken
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def posting_rows(index: Index) -> DataFrame:
    """(term, pk, tf, dl), one row per document and term."""
    lists = F.inline(F.arrays_zip(F.col("pks").alias(PK), F.col("tfs").alias("tf"), F.col("dls").alias("dl")))
    return index.postings.select("term", lists)


# --- cells ------------------------------------------------------------------------------------


def _unit(vectors: np.ndarray) -> np.ndarray:
    lengths = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return np.divide(vectors, lengths, out=np.zeros_like(vectors), where=lengths > 0)


def _matrix(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1).astype(np.float64)


def fit_cells(docs: DataFrame, dim: int, buckets: int) -> np.ndarray:
    """Centroids of unit length, one per ``VECTORS_PER_CELL`` vectors of a bucket, ``MOST_CELLS`` at most.

    They are fitted (k-means by cosine) on at most ``SAMPLE_VECTORS`` vectors, drawn by a hash of the key from
    all over the table. Every vector is indexed, whatever the sample was.
    """
    rows = docs.filter(F.col("norm") > 0)
    n = rows.count()
    share = min(1.0, 1.1 * SAMPLE_VECTORS / max(n, 1))
    drawn = rows.filter(F.pmod(F.xxhash64(F.col(PK), F.lit("sample")), F.lit(1 << 20)) < int(share * (1 << 20)))
    table = drawn.select(EMBEDDING).limit(SAMPLE_VECTORS).toArrow()
    n_cells = max(1, min(MOST_CELLS, n // (VECTORS_PER_CELL * buckets), table.num_rows))
    if not table.num_rows:
        return np.zeros((1, dim))
    sample = _unit(_matrix(table.column(0)))
    rng = np.random.default_rng(0)
    centroids = sample[rng.choice(len(sample), n_cells, replace=False)]
    for _ in range(FIT_ROUNDS):
        nearest = np.argmax(sample @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        empty = ~sums.any(axis=1)
        sums[empty] = sample[rng.choice(len(sample), int(empty.sum()))]
        centroids = _unit(sums)
    return centroids


def _in_cell(centroids: np.ndarray) -> Column:
    @F.pandas_udf("cell int, cosine double")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        if not len(vectors):
            return pd.DataFrame({"cell": pd.Series(dtype="int32"), "cosine": pd.Series(dtype="float64")})
        cosines = _unit(np.stack(vectors.to_numpy()).astype(np.float64)) @ centroids.T
        cell = cosines.argmax(axis=1)
        return pd.DataFrame({"cell": cell.astype("int32"), "cosine": cosines[np.arange(len(cell)), cell]})

    return nearest(F.col(EMBEDDING))


def vector_chunks(docs: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(bucket, cell, chunk, least, rows): lists of vectors of one cell, and their smallest cosine to its centroid.

    A cell of any size is cut into lists of about ``CHUNK_ROWS`` vectors, by a hash.
    """
    placed = docs.filter(F.col("norm") > 0).select(BUCKET, PK, EMBEDDING, "norm", _in_cell(centroids).alias("near"))
    placed = placed.select(BUCKET, PK, EMBEDDING, "norm", "near.cell", "near.cosine")
    chunks = F.ceil(F.count(F.lit(1)).over(Window.partitionBy(BUCKET, "cell")) / CHUNK_ROWS)
    chunk = F.pmod(F.xxhash64(F.col(PK), F.lit("chunk")), chunks).cast("int")
    return (
        placed.withColumn("chunk", chunk)
        .groupBy(BUCKET, "cell", "chunk")
        .agg(F.min("cosine").alias("least"), F.collect_list(F.struct(PK, EMBEDDING, "norm")).alias("rows"))
    )


# --- writing ----------------------------------------------------------------------------------


def _bucket(pk: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(pk), F.lit(buckets)).cast("int")


def _source_rows(df: DataFrame, pk: str, content: str, vector: str | None) -> DataFrame:
    names = {pk: PK, content: CONTENT, **({vector: EMBEDDING} if vector else {})}
    renamed = df.select(
        *[F.col(f"`{c}`").alias(names.get(c, c)) for c in df.columns],
    )
    return renamed.withColumn("content_hash", content_hash(renamed, [PK]))


def _with_vectors(rows: DataFrame, model: ModelFactory | None, dim: int, request_size: int) -> DataFrame:
    if model is not None:
        rows = rows.withColumn(EMBEDDING, embed(F.col(CONTENT), model, request_size))
    wrong = F.raise_error(F.concat(F.lit(f"vector is not {dim} wide, pk: "), F.col(PK).cast("string")))
    size = F.size(EMBEDDING)
    checked = F.when(F.col(EMBEDDING).isNull() | (size == dim), F.col(EMBEDDING)).otherwise(wrong)
    return rows.withColumn(EMBEDDING, checked).withColumn("norm", vector_norm(F.col(EMBEDDING)))


def _write_buckets(rows: DataFrame, folder: str, *order: str) -> None:
    """Replace the buckets that ``rows`` has rows of; the others stay as they are."""
    writer = rows.sortWithinPartitions(BUCKET, *order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(BUCKET).parquet(folder)


def _numbers(df: DataFrame) -> set[int]:
    """The buckets of ``df``: at most as many numbers as an index has buckets."""
    return {r[BUCKET] for r in df.select(BUCKET).distinct().collect()}


def _term_counts(postings: DataFrame) -> DataFrame:
    """(term, df, tf): the documents with a term, and how often it occurs in all."""
    return postings.groupBy("term").agg(F.sum("n").alias("df"), F.sum("sum_tf").alias("tf"))


def _totals(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """One row (n, sum_dl): how many documents there are, and the tokens of all of them."""
    parts = docs.select(F.lit(1).alias("n"), F.lit(0).cast("long").alias("tf")).unionByName(terms.select(F.lit(0).alias("n"), "tf"))
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("tf"), F.lit(0)).cast("long").alias("sum_dl"))


def _write_index(docs: DataFrame, folder: str, centroids: np.ndarray, touched: set[int] | None) -> dict[str, str]:
    """Bring the buckets ``touched`` (None: all) to the state ``docs``; ``docs`` itself is written last.

    Postings, vectors and statistics follow from the documents of a bucket alone. While the old ``docs`` are
    there, a sync finds the same changes again, so one that was stopped anywhere before is repeated in full. Gives the schemas of the bucketed tables, which
    a table without rows does not tell.
    """
    spark = docs.sparkSession
    remaining = _numbers(docs)
    postings, vectors = posting_blocks(docs), vector_chunks(docs, centroids)

    def put(rows: DataFrame, name: str, *order: str) -> None:
        _write_buckets(rows, f"{folder}/{name}", *order)
        for empty in (touched or set()) - remaining:
            remove_folder(spark, f"{folder}/{name}/{BUCKET}={empty}")

    parts = parts_of(docs)
    put(postings, "postings", "term", "block")
    pieces = -(-parts // max(1, len(remaining)))  # a bucket is as large as the data make it: no task has to hold one
    put(vectors.repartition(parts, BUCKET, F.pmod(F.col("cell"), F.lit(pieces))), "vectors", "cell", "chunk")
    _term_counts(spark.read.schema(postings.schema).parquet(f"{folder}/postings")).write.mode("overwrite").parquet(f"{folder}/terms")
    keys = docs.select(PK)
    if touched is not None:
        keys = keys.unionByName(spark.read.schema(docs.schema).parquet(f"{folder}/docs").filter(~F.col(BUCKET).isin(touched)).select(PK))
    _totals(keys, spark.read.parquet(f"{folder}/terms")).write.mode("overwrite").parquet(f"{folder}/totals")
    put(docs.repartitionByRange(parts, BUCKET, PK), "docs", PK)
    return {"docs": docs.schema.json(), "postings": postings.schema.json(), "vectors": vectors.schema.json()}


def _cells_of(spark: SparkSession, folder: str) -> np.ndarray:
    rows = spark.read.parquet(f"{folder}/cells").orderBy("cell").toArrow()
    return _matrix(rows.column("centroid"))


def _bucketed(spark: SparkSession, folder: str, name: str) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(spark.read.parquet(f"{folder}/settings").first()[name]))
    return spark.read.schema(schema).parquet(f"{folder}/{name}")


def create_or_sync(
    df: DataFrame,
    folder: str,
    pk: str,
    content: str,
    dim: int,
    vector: str | None = None,
    model: ModelFactory | None = None,
    request_size: int = EMBEDDING_REQUEST_LIMIT,
    buckets: int = BUCKETS,
    tasks: int | None = None,
) -> None:
    """Create the index of a table, or bring an existing one to the table's present state.

    Vectors come from the ``vector`` column or from ``model`` applied to ``content``, in ``tasks`` tasks
    (the cluster's default parallelism if not given). A sync finds what changed by a diff of keys and
    hashes, embeds only inserted and updated rows, and rewrites the buckets they and the deleted rows
    are in; it runs when called and never by itself. A row with a vector of another width than ``dim``
    stops the write; put such rows aside with ``check_dimension`` first. The columns of the table have to
    stay the same. Choose ``buckets`` at creation so that a bucket is some gigabytes.

    A call that was stopped leaves a note of the buckets it was about to change; the next call makes these
    anew, and until then the index cannot be opened. A creation that was stopped is begun again.
    """
    if (vector is None) == (model is None):
        raise ValueError("give either a vector column or a model")
    spark = df.sparkSession
    tasks = tasks or spark.sparkContext.defaultParallelism
    rows = _source_rows(df, pk, content, vector)
    settings, pending = f"{folder}/settings", f"{folder}/pending"
    if not path_exists(spark, f"{settings}/_SUCCESS"):
        remove_folder(spark, folder)
        docs = _with_vectors(rows.repartition(tasks), model, dim, request_size)
        docs = stored(docs.withColumn(BUCKET, _bucket(F.col(PK), buckets)), "index-docs")
        centroids = fit_cells(docs, dim, buckets)
        cells = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>")
        cells.coalesce(1).write.mode("overwrite").parquet(f"{folder}/cells")
        schemas = _write_index(docs, folder, centroids, None)
        spark.range(1).select(F.lit(buckets).alias("buckets"), *[F.lit(v).alias(k) for k, v in schemas.items()]).write.mode("overwrite").parquet(settings)
        return
    buckets = spark.read.parquet(settings).first()["buckets"]
    bucketed = _bucketed(spark, folder, "docs")
    changed = stored(
        change_kinds(
            bucketed.select(PK, F.col("content_hash").alias("old_hash")),
            rows.select(PK, F.col("content_hash").alias("new_hash")),
            [PK],
        ).withColumn(BUCKET, _bucket(F.col(PK), buckets)),
        "index-changes",
    )
    touched = _numbers(changed)
    if path_exists(spark, f"{pending}/_SUCCESS"):
        touched |= _numbers(spark.read.parquet(pending))
    if not touched:
        return
    fresh = rows.join(changed.filter("change <> 'delete'").select(PK), PK, "left_semi").repartition(tasks)
    fresh = _with_vectors(fresh, model, dim, request_size).withColumn(BUCKET, _bucket(F.col(PK), buckets))
    kept = bucketed.filter(F.col(BUCKET).isin(touched)).join(changed.select(PK), PK, "left_anti")
    docs = stored(kept.unionByName(fresh.select(bucketed.columns)), "index-docs")
    spark.createDataFrame([(b,) for b in sorted(touched)], f"{BUCKET} int").write.mode("overwrite").parquet(pending)
    _write_index(docs, folder, _cells_of(spark, folder), touched)
    remove_folder(spark, pending)


def open_index(spark: SparkSession, folder: str) -> Index:
    if not path_exists(spark, f"{folder}/settings/_SUCCESS"):
        raise FileNotFoundError(f"no index in {folder}")
    if path_exists(spark, f"{folder}/pending/_SUCCESS"):
        raise RuntimeError(f"a sync of {folder} has not ended; call create_or_sync again")
    plain = [spark.read.parquet(f"{folder}/{name}") for name in ("terms", "totals")]
    docs, postings, vectors = (_bucketed(spark, folder, name) for name in ("docs", "postings", "vectors"))
    return Index(docs.drop(BUCKET), postings, *plain, vectors, spark.read.parquet(f"{folder}/cells"))


def build_index(
    df: DataFrame,
    folder: str,
    pk: str,
    content: str,
    dim: int,
    vector: str | None = None,
    model: ModelFactory | None = None,
    request_size: int = EMBEDDING_REQUEST_LIMIT,
    buckets: int = BUCKETS,
) -> Index:
    create_or_sync(df, folder, pk, content, dim, vector, model, request_size, buckets)
    return open_index(df.sparkSession, folder)


def keyword_index(df: DataFrame, pk: str, content: str, buckets: int = BUCKETS) -> Index:
    """Postings and statistics of a table without vectors and without a folder of its own."""
    rows = df.select(F.col(pk).alias(PK), F.col(content).alias(CONTENT))
    docs = stored(use_all_cores(rows), "keyword-docs")
    postings = stored(posting_blocks(docs.select(_bucket(F.col(PK), buckets).alias(BUCKET), PK, CONTENT)), "postings")
    terms = stored(_term_counts(postings), "terms")
    return Index(docs, postings, terms, stored(_totals(docs, terms), "totals"))
