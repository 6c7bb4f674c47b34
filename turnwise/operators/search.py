"""Top-k retrieval for a table of queries: by vector, by keyword, or both.

Queries and index meet in few distributed jobs, however many queries there are. With a stored index only
what can matter is read: lists of vectors in the cells near a query, and blocks of postings of the asked
terms, first where the best hits are likely; then a bound on what the rest can score leaves out what cannot
reach the ``k``-th hit found. Results are exact unless the caller asks for the near cells only. Where queries are
so many that their pairs with lists or blocks are too many to be written out, slices of the index meet parts of the
queries instead: a pair of slice and part is one task's work and gives the best ``k`` per query, so rows that
are shuffled are as many as queries and slices make. A plain table of vectors is cut into slices, to which
the queries are copied.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from turnwise.functions.models import EMBEDDING_REQUEST_LIMIT, ModelFactory, embed
from turnwise.functions.text import tokens
from turnwise.operators.distribution import SPREAD, arrow_runs, spread_join, stored, top_k
from turnwise.operators.index import BLOCK_DOCS, BUCKET, CHUNK_ROWS, EMBEDDING, PK, Index

# Our choices: BM25 constants, the fusion constant, how many rows each side gives to the fusion
# (part of the fusion's definition; callers set another), and the decimals that count in a ranking.
K1, B = 1.2, 0.75
FUSION_CONSTANT = 60
FUSION_DEPTH = 50
DECIMALS = 6

BLOCK_QUERIES = 512  # query vectors that are packed into one row
PROBES = 8  # cells that are searched first
SEED_BLOCKS = 4  # blocks of postings that are searched first
MOST_PAIRS = 4_000_000  # pairs of query and list, or of asked term and block, that are written out
SLICE_ROWS = 1 << 16  # indexed rows per slice
PART_QUERIES = 1 << 15  # queries per part
PASS_QUERIES = 128  # queries of a part that are compared at once
PASS_ROWS = 1 << 15  # vectors of a slice that are compared at once
PASS_PAIRS = 1 << 16  # pairs of query and vector that are compared in full at once
HELD_HITS = 1 << 19  # hits that are held before all but the best are dropped
SLICE_POSTINGS = 1 << 23  # postings of asked terms per slice
GROUPED = 32  # numbers of which only the highest counts for a bound
MOST_COMMON = 256  # terms whose sums a product gives
COMMON_SHARE = 0.015  # the share of all pairs of query and document that such a term is in
HALF_UNIT = 2.0**-24  # what rounding to single precision can add to a number, as a share of it
SLACK = 2e-6  # bounds may be wrong by rounding in the last decimal that counts

QUERY = "query_id"


def _slices(df: DataFrame, tasks: int | None) -> int:
    return tasks or df.sparkSession.sparkContext.defaultParallelism


def _slice(key: Column, slices: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slices)).cast("int")


def _copied(df: DataFrame, slices: int) -> DataFrame:
    return df.withColumn(SPREAD, F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))


def _hit_schema(queries: DataFrame, index: Index) -> T.StructType:
    return T.StructType(
        [
            T.StructField(QUERY, queries.schema[QUERY].dataType),
            T.StructField(PK, index.docs.schema[PK].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )


def _packed(df: DataFrame, key: str, columns: list[str], rows: int, slices: int, names: tuple[str, str]) -> DataFrame:
    """Rows gathered into lists of about ``rows``, each list within one slice."""
    total = df.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    parts = max(1, -(-total // (rows * slices)))
    part = F.pmod(F.xxhash64(key, F.lit(1)), F.lit(parts))
    return df.groupBy(_slice(F.col(key), slices).alias(names[0]), part.alias("part")).agg(
        F.collect_list(F.struct(*columns)).alias(names[1])
    )


def _best(scores: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, query) of the ``k`` highest scores of each column; ties go to the smaller key."""
    if len(keys) > k:
        floor = np.partition(scores, len(keys) - k, axis=0)[len(keys) - k]
        rows, queries = np.nonzero(scores >= floor)
    else:
        rows, queries = np.nonzero(np.ones_like(scores, dtype=bool))
    places = np.unique(keys, return_inverse=True)[1]
    order = np.lexsort((places[rows], -scores[rows, queries], queries))
    rows, queries = rows[order], queries[order]
    first = np.searchsorted(queries, queries)
    kept = np.arange(len(queries)) - first < k
    return rows[kept], queries[kept]


def _nearest(pairs: DataFrame, schema: T.StructType, k: int) -> DataFrame:
    """The best ``k`` (query, pk, score) of each pair of a list ``rows`` of vectors and a list ``asked`` of queries."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                held, asked = (batch.column(c)[at].values for c in (0, 1))

                def matrix(part: pa.StructArray) -> np.ndarray:
                    flat = part.field(EMBEDDING).flatten().to_numpy(zero_copy_only=False)
                    return flat.reshape(len(part), -1).astype(np.float64)

                wanted = matrix(asked)
                lengths = np.sqrt((wanted * wanted).sum(axis=1))
                known = np.flatnonzero(lengths > 0)
                if not len(known):
                    continue
                norms = held.field("norm").to_numpy(zero_copy_only=False)
                cosine = matrix(held) @ (wanted[known] / lengths[known, None]).T / norms[:, None]
                scores = np.round(cosine, DECIMALS) + 0.0
                row, query = _best(scores, held.field(PK).to_numpy(zero_copy_only=False), k)
                arrays = [
                    asked.field(QUERY).take(pa.array(known[query])),
                    held.field(PK).take(pa.array(row)),
                    pa.array(scores[row, query], pa.float64()),
                ]
                typed = [a.cast(to_arrow_type(f.dataType)) for a, f in zip(arrays, schema.fields)]
                yield pa.RecordBatch.from_arrays(typed, names=schema.names)

    return pairs.select("rows", "asked").mapInArrow(nearest, schema)


def _best_hits(hits: DataFrame, k: int) -> DataFrame:
    return top_k(hits, [QUERY], [F.col("score").desc(), F.col(PK).asc()], k)


def _reach(near: np.ndarray, k: int) -> np.ndarray:
    """For each line a value that ``k`` of its numbers reach or exceed, hardly below the ``k``-th highest.

    Of every ``GROUPED`` numbers only the highest counts, so few have to be put in order.
    """
    width = near.shape[1] // GROUPED
    if width >= 4 * k:
        near = near[:, : width * GROUPED].reshape(len(near), GROUPED, width).max(axis=1)
    n = near.shape[1]
    return np.partition(near, n - k, axis=1)[:, n - k] if n > k else np.full(len(near), -np.inf, near.dtype)


class _RunningBest:
    """The ``k`` best hits of some queries so far; rows are numbered as their keys are ordered.

    ``floor`` is what a further hit has to reach.
    """

    def __init__(self, n_queries: int, k: int):
        self.k = k
        self.floor = np.full(n_queries, -np.inf)
        self.hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, queries: np.ndarray, rows: np.ndarray, scores: np.ndarray) -> None:
        self.hits.append((queries, rows, np.round(scores, DECIMALS) + 0.0))
        self.size += len(rows)
        if self.size > HELD_HITS:
            self.best()

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of the best hits; ties go to the smaller key."""
        if not self.hits:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        queries, rows, scores = (np.concatenate(parts) for parts in zip(*self.hits))
        order = np.lexsort((rows, -scores, queries))
        queries, rows, scores = queries[order], rows[order], scores[order]
        place = np.arange(len(queries)) - np.searchsorted(queries, queries)
        last = place == self.k - 1
        self.floor[queries[last]] = scores[last]
        kept = place < self.k
        self.hits = [(queries[kept], rows[kept], scores[kept])]
        self.size = int(kept.sum())
        return self.hits[0]


def _places(keys: pa.Array) -> np.ndarray:
    """The place of each key in their order."""
    return pc.rank(keys, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()


def keys_apart(spark: SparkSession, n: int) -> list[int]:
    """``n`` different numbers that, as keys of a shuffle, go to ``n`` different partitions, so no task gets two."""
    number = F.col("id").cast("int")
    place = F.pmod(F.hash(number), F.lit(n))
    first = {r["place"]: r["key"] for r in spark.range(32 * n).groupBy(place.alias("place")).agg(F.min(number).alias("key")).collect()}
    return [first.get(i, 32 * n + i) for i in range(n)]


def _met(rows: DataFrame, of: list[str], asked: DataFrame, slices: int, n_queries: int, compare, schema: T.StructType) -> DataFrame:
    """``compare`` (rows, asked) of every slice of ``rows``, cut by a hash of ``of``, and every part of ``asked``."""
    parts = max(1, -(-n_queries // PART_QUERIES))
    n = slices * parts
    keys = F.lit(keys_apart(rows.sparkSession, n))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    def dealt(df: DataFrame, slice_of: Column, part_of: Column) -> DataFrame:
        placed = df.select("*", slice_of.alias(SPREAD)).select("*", part_of.alias("part"))
        pair = F.element_at(keys, F.col(SPREAD) * F.lit(parts) + F.col("part") + 1)
        return placed.withColumn("pair", pair).drop(SPREAD, "part").repartition(n, "pair").groupBy("pair")

    part = F.pmod(F.xxhash64(F.col(QUERY)), F.lit(parts)).cast("int")
    return dealt(rows, _slice(F.struct(*of), slices), every(parts)).cogroup(dealt(asked, every(slices), part)).applyInArrow(compare, schema)


def _list_schema(schema: T.StructType) -> T.StructType:
    """(query_id, hits): a query's hits in one row, in an order in which the best come first."""
    hit = T.StructType([T.StructField("minus", T.DoubleType()), schema[PK]])
    return T.StructType([schema[QUERY], T.StructField("hits", T.ArrayType(hit))])


def _hit_lists(names: pa.Array, keys: pa.Array, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], schema: T.StructType) -> pa.Table:
    """The table of ``_list_schema`` from (query, row, score), places in ``names`` and ``keys``, in the order of queries."""
    fields = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields])
    queries, rows, scores = (np.concatenate(parts) for parts in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    if not len(queries):
        return fields.empty_table()
    starts = np.flatnonzero(np.diff(queries, prepend=-1))
    kind = fields.field("hits").type.value_type
    hits = [pa.array(0.0 - scores, pa.float64()), keys.take(pa.array(rows)).cast(kind.field(PK).type)]
    lists = pa.ListArray.from_arrays(pa.array([*starts, len(queries)], pa.int32()), pa.StructArray.from_arrays(hits, fields=[*kind]))
    return pa.table([names.take(pa.array(queries[starts])), lists], names=fields.names).cast(fields)


def _best_of_lists(lists: DataFrame, k: int) -> DataFrame:
    """(query_id, pk, score, rank) of the best ``k`` in all lists of a query."""
    whole = lists.groupBy(QUERY).agg(F.slice(F.sort_array(F.flatten(F.collect_list("hits"))), 1, k).alias("hits"))
    ranked = whole.select(QUERY, F.posexplode("hits").alias("place", "hit"))
    return ranked.select(QUERY, f"hit.{PK}", (F.lit(0.0) - F.col("hit.minus")).alias("score"), (F.col("place") + 1).cast("long").alias("rank"))


def _vector_slices(asked: DataFrame, index: Index, n_queries: int, k: int, tasks: int | None, schema: T.StructType) -> DataFrame:
    """The best ``k`` hits of every query in each slice of the index's vectors, as ``_list_schema`` has it.

    Products of single precision, and how wrong they can be, tell which pairs have to be compared in full.
    """

    def compare(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not rows.num_rows or not asked.num_rows:
            return _hit_lists(None, None, [], schema)
        held = rows.column("rows").combine_chunks().flatten()
        order = np.argsort(_places(held.field(PK)), kind="stable")
        finite = np.isfinite(held.field(EMBEDDING).flatten().to_numpy(zero_copy_only=False).reshape(len(held), -1)).all(axis=1)
        held = held.take(pa.array(order[finite[order]]))
        if not len(held):
            return _hit_lists(None, None, [], schema)
        keys, norms = held.field(PK), held.field("norm").to_numpy(zero_copy_only=False)
        values = held.field(EMBEDDING).flatten().to_numpy(zero_copy_only=False).reshape(len(held), -1)
        names, wanted = asked.column(QUERY).combine_chunks(), asked.column(EMBEDDING).combine_chunks()
        wanted = wanted.flatten().to_numpy(zero_copy_only=False).reshape(len(wanted), -1).astype(np.float64)
        lengths = np.sqrt((wanted * wanted).sum(axis=1))
        short = (values / norms[:, None]).astype(np.float32)
        slack = SLACK + 2 * (values.shape[1] + 8) * HALF_UNIT
        known, found = np.flatnonzero(lengths > 0), []
        for at in range(0, len(known), PASS_QUERIES):
            of = known[at : at + PASS_QUERIES]
            unit = wanted[of] / lengths[of, None]
            best, short_unit = _RunningBest(len(of), k), unit.astype(np.float32)
            for start in range(0, len(held), PASS_ROWS):
                near = short_unit @ short[start : start + PASS_ROWS].T
                floor = np.maximum(_reach(near, k), best.floor) - slack
                places = np.flatnonzero(near >= floor[:, None].astype(np.float32))
                for some in range(0, len(places), PASS_PAIRS):
                    query, row = np.divmod(places[some : some + PASS_PAIRS], near.shape[1])
                    row += start
                    best.add(query, row, np.einsum("ij,ij->i", values[row].astype(np.float64), unit[query]) / norms[row])
            query, row, score = best.best()
            found.append((of[query], row, score))
        return _hit_lists(names, keys, found, schema)

    keys, schema = [BUCKET, "cell", "chunk"], _list_schema(schema)
    slices = max(2 * _slices(asked, tasks), -(-index.docs.count() // SLICE_ROWS))
    return _met(index.vectors.select(*keys, "rows"), keys, asked, slices, n_queries, compare, schema)


def search_vector(
    queries: DataFrame, index: Index, k: int = 10, tasks: int | None = None, probes: int = PROBES, exact: bool = True
) -> DataFrame:
    """(query_id, pk, score, rank) of the ``k`` rows with the highest cosine.

    ``queries`` holds query_id and embedding. Rows and queries without direction have no cosine and
    are left out. With the lists of a stored index, those of the ``probes`` cells nearest to a query are
    compared first; then, unless ``exact`` is false, every other list whose bound reaches the ``k``-th score
    found. Of more than ``MOST_PAIRS`` pairs of query and list none is written out: slices of the
    index then meet parts of the queries. Without, vectors are packed into lists and compared list by list; the number of ``tasks``
    (the cluster's default parallelism if not given) is the number of slices.
    """
    schema = _hit_schema(queries, index)
    asked = stored(queries.filter(F.col(EMBEDDING).isNotNull()).select(QUERY, EMBEDDING), "queries")
    if index.vectors is not None:
        return _search_cells(asked, index, k, probes, exact, schema, tasks)
    slices = _slices(queries, tasks)
    blocks = _packed(asked, QUERY, [QUERY, EMBEDDING], BLOCK_QUERIES, 1, ("one", "asked"))
    rows = index.docs.filter(F.col("norm") > 0)
    chunks = _packed(rows, PK, [PK, EMBEDDING, "norm"], CHUNK_ROWS, slices, (SPREAD, "rows"))
    pairs = chunks.join(_copied(blocks.select("asked"), slices), SPREAD)
    return _best_hits(_nearest(pairs, schema, k), k)


def cells_of_queries(asked: DataFrame, cells: DataFrame) -> DataFrame:
    """(query_id, cell, cosine, place) of every query and centroid, the nearest at place 1.

    There are ``MOST_CELLS`` centroids at most; every task holds them.
    """
    found = cells.orderBy("cell").toArrow()
    centroids = found.column("centroid").combine_chunks()
    width = len(centroids)
    centroids = centroids.flatten().to_numpy().reshape(width, -1)
    schema = T.StructType(
        [
            asked.schema[QUERY],
            T.StructField("cell", T.IntegerType()),
            T.StructField("cosine", T.DoubleType()),
            T.StructField("place", T.IntegerType()),
        ]
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_QUERIES):
                batch = whole.slice(at, BLOCK_QUERIES)
                wanted = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64)
                lengths = np.sqrt((wanted * wanted).sum(axis=1))
                known = np.flatnonzero(lengths > 0)
                cosine = (wanted[known] / lengths[known, None]) @ centroids.T
                order = np.argsort(-cosine, axis=1, kind="stable")
                n = len(known)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(np.repeat(known, width))),
                        pa.array(order.ravel().astype(np.int32)),
                        pa.array(np.take_along_axis(cosine, order, axis=1).ravel()),
                        pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), n)),
                    ],
                    names=schema.names,
                )

    return asked.select(QUERY, EMBEDDING).mapInArrow(compare, schema)


def _query_lists(wanted: DataFrame, asked: DataFrame, by: list[str], n_queries: int) -> DataFrame:
    """Queries gathered into lists of some hundred per value of ``by``."""
    part = F.pmod(F.xxhash64(F.col(QUERY)), F.lit(max(1, -(-n_queries // BLOCK_QUERIES))))
    return (
        wanted.join(asked, QUERY)
        .groupBy(*by, part.alias("part"))
        .agg(F.collect_list(F.struct(QUERY, EMBEDDING)).alias("asked"))
        .drop("part")
    )


def lists_left(near: DataFrame, first: DataFrame, index: Index, k: int) -> DataFrame:
    """(query_id, bucket, cell, chunk) of the lists not yet searched that can hold one of the best ``k``.

    No vector of a list is farther from its centroid than the list's smallest cosine tells, so by the
    triangle inequality of angles none is nearer to the query than the difference of both angles.
    """
    kth = first.filter(F.col("rank") == k).select(QUERY, F.col("score").alias("kth"))
    lists = index.vectors.select(BUCKET, "cell", "chunk", "least")
    unit = lambda c: F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0))
    apart = F.greatest(F.acos(unit(F.col("cosine"))) - F.acos(unit(F.col("least") - SLACK)), F.lit(0.0))
    can = F.cos(apart) + SLACK >= F.coalesce("kth", F.lit(-2.0))
    return near.join(kth, QUERY, "left").join(lists, "cell").filter(can).select(QUERY, BUCKET, "cell", "chunk")


def probes_for_recall(asked: DataFrame, index: Index, k: int = 10, recall: float = 0.95) -> int:
    """How many cells a search has to visit to find this share of the true ``k`` nearest rows of ``asked``.

    ``asked`` (query_id, embedding) is a sample of queries that the caller bounds. Each of their true neighbours lies
    in some cell, the n-th nearest to its query; the answer is the quantile of n.
    """
    true = search_vector(asked, index, k).select(QUERY, PK)
    homes = index.vectors.select("cell", F.inline("rows")).select("cell", PK)
    places = true.join(homes, PK).join(cells_of_queries(asked, index.cells), [QUERY, "cell"])
    found = places.agg(F.percentile("place", F.lit(recall)).alias("n")).first()["n"]
    return max(1, math.ceil(found or 1))


def _search_cells(
    asked: DataFrame, index: Index, k: int, probes: int, exact: bool, schema: T.StructType, tasks: int | None
) -> DataFrame:
    n_queries = asked.count()
    if exact and n_queries * index.vectors.count() > MOST_PAIRS:
        asked = asked.select(QUERY).join(asked, QUERY)  # rows of one id count as they do over cells, and none without
        return _best_of_lists(_vector_slices(asked, index, n_queries, k, tasks, schema), k)
    near = stored(cells_of_queries(asked, index.cells), "query-cells")
    probed = near.filter(F.col("place") <= probes).select(QUERY, "cell")
    pairs = index.vectors.select("cell", "rows").join(_query_lists(probed, asked, ["cell"], n_queries), "cell")
    first = _best_hits(_nearest(pairs, schema, k), k)
    if not exact:
        return first
    first = stored(first, "first-hits")
    left = lists_left(near.filter(F.col("place") > probes), first, index, k)
    keys = [BUCKET, "cell", "chunk"]
    pairs = index.vectors.select(*keys, "rows").join(_query_lists(left, asked, keys, n_queries), keys)
    rest = _nearest(pairs, schema, k)
    return _best_hits(first.select(schema.names).unionByName(rest), k)


def _gain(idf: Column, tf: Column, dl: Column, average: float) -> Column:
    """What a term adds to a score; it rises with ``tf`` and falls with ``dl``."""
    tf = tf.cast("double")
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(average)))


def _block_hits(
    wanted: DataFrame, weighed: DataFrame, n_queries: int, index: Index, average: float, k: int, schema: T.StructType
) -> DataFrame:
    """The best ``k`` (query_id, pk, score) of every block in ``wanted`` (query_id, bucket, block).

    A block's lists of asked terms meet some hundred queries at a time; their sums are made as one matrix of
    documents and queries.
    """
    part = F.pmod(F.xxhash64(F.col(QUERY)), F.lit(max(1, -(-n_queries // BLOCK_QUERIES)))).cast("int")
    keys = [BUCKET, "block", "term"]
    asked = wanted.join(weighed, QUERY).groupBy(*keys, part.alias("part")).agg(F.collect_list(F.struct(QUERY, "idf")).alias("asked"))
    asked = stored(asked, "asked-lists")  # its size is known then: if it is small, postings are filtered where they are read
    rows = index.postings.select(*keys, "pks", "tfs", "dls").join(asked, keys)
    dealt = rows.select(BUCKET, "block", "part", "pks", "tfs", "dls", "asked").repartition(BUCKET, "block", "part")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in arrow_runs(batches, 3):
            pks, tfs, dls, asked = (run.column(c).combine_chunks() for c in ("pks", "tfs", "dls", "asked"))
            tf = tfs.flatten().to_numpy().astype(np.float64)
            gain = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dls.flatten().to_numpy() / average))
            row, held = pd.factorize(pks.flatten().to_pandas(), sort=True)
            flat = asked.flatten()
            idf = flat.field("idf").to_numpy()
            column, queries = pd.factorize(flat.field(QUERY).to_pandas())
            sums = np.zeros((len(held), len(queries)))
            ends, asked_ends = pks.offsets.to_numpy(), asked.offsets.to_numpy()
            for i in range(run.num_rows):
                own, of = slice(ends[i], ends[i + 1]), slice(asked_ends[i], asked_ends[i + 1])
                sums[np.ix_(row[own], column[of])] += np.outer(gain[own], idf[of])
            sums = np.round(sums, DECIMALS)
            at, query = _best(np.where(sums > 0, sums, -1.0), np.asarray(held), k)
            real = sums[at, query] > 0
            at, query = at[real], query[real]
            arrays = [pa.array(np.asarray(queries)[query]), pa.array(np.asarray(held)[at]), pa.array(sums[at, query])]
            typed = [a.cast(to_arrow_type(f.dataType)) for a, f in zip(arrays, schema.fields)]
            yield pa.RecordBatch.from_arrays(typed, names=schema.names)

    return dealt.sortWithinPartitions(BUCKET, "block", "part").mapInArrow(score, schema)


def _postings_of(rows: pa.Table, average: float) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, doc, added, ends) of lists of postings ordered by term.

    ``doc`` numbers the documents, those of two blocks apart, in the order of their ``keys``; a posting adds ``added`` to its
    document's score. List ``i`` goes from ``ends[i]`` to ``ends[i + 1]``. Of a document's postings in one list the last counts.
    """
    lists = rows.column("pks").combine_chunks()
    sizes = pc.list_value_length(lists).to_numpy()
    ends = np.concatenate([[0], np.cumsum(sizes)])
    tfs, dls = (rows.column(c).combine_chunks().flatten().to_numpy() for c in ("tfs", "dls"))
    added = tfs.astype(np.float64)
    added = np.repeat(rows.column("idf").to_numpy(), sizes) * (added * (K1 + 1) / (added + K1 * (1 - B + B * dls / average)))
    del tfs, dls
    known = lists.flatten().dictionary_encode(null_encoding="encode")
    blocks = (rows.column(BUCKET).to_numpy().astype(np.int64) << 32) + rows.column("block").to_numpy()
    block = np.unique(blocks, return_inverse=True)[1].astype(np.int64)
    one = pa.array(np.repeat(block * len(known.dictionary), sizes) + known.indices.to_numpy()).dictionary_encode()
    keys = known.dictionary.take(pa.array(one.dictionary.to_numpy() % len(known.dictionary)))
    order = np.argsort(_places(keys), kind="stable")
    number = np.empty(len(order), np.int32)
    number[order] = np.arange(len(order))
    doc = number[one.indices.to_numpy()]
    del known, one

    def pairs() -> np.ndarray:
        return np.repeat(np.arange(len(sizes)) * len(order), sizes) + doc

    (ordered := pairs()).sort()
    if (ordered[1:] == ordered[:-1]).any():
        pair = pairs()
        by = np.argsort(pair, kind="stable")
        kept = np.ones(len(pair), bool)
        kept[by[:-1][pair[by[1:]] == pair[by[:-1]]]] = False
        ends = np.concatenate([[0], np.cumsum(kept)])[ends]
        doc, added = doc[kept], added[kept]
    return keys.take(pa.array(order)), doc, added, ends


def _block_slices(
    weighed: DataFrame, n_queries: int, index: Index, n_docs: int, average: float, k: int, tasks: int | None, schema: T.StructType
) -> DataFrame:
    """The best ``k`` hits of every query in each slice of the index's blocks, as ``_list_schema`` has it.

    What a term adds to a document's score is the same for every query. Of terms that are frequent on both sides it stands
    in a matrix, and a product of single precision gives the sums over them; the lists of the other terms are added to
    it query by query. Documents that can be among the best, by how wrong the product can be, are summed in full.
    """

    def compare(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not rows.num_rows or not asked.num_rows:
            return _hit_lists(None, None, [], schema)
        rows = rows.sort_by([("id", "ascending"), (BUCKET, "ascending"), ("block", "ascending")])
        keys, doc, added, ends = _postings_of(rows, average)
        ids, first = np.unique(rows.column("id").to_numpy(), return_index=True)
        ends, n = ends[[*first, rows.num_rows]], len(keys)
        del rows
        names, lists = asked.column(QUERY).combine_chunks(), asked.column("ids").combine_chunks()
        of_query = np.repeat(np.arange(len(names)), pc.list_value_length(lists).to_numpy())
        of_term = lists.flatten().to_numpy()
        term = np.minimum(np.searchsorted(ids, of_term), len(ids) - 1)
        here = ids[term] == of_term
        of_query, term = of_query[here], term[here]

        sizes = np.diff(ends)
        shares = np.bincount(term, minlength=len(ids)) * sizes
        common = np.argsort(-shares, kind="stable")[:MOST_COMMON]
        common = common[shares[common] > COMMON_SHARE * len(names) * n]
        column = np.full(len(ids), -1)
        column[common] = np.arange(len(common))
        whole = np.zeros((n, len(common)))
        for i, t in enumerate(common):
            whole[doc[ends[t] : ends[t + 1]], i] = added[ends[t] : ends[t + 1]]
        short = whole.astype(np.float32)
        wrong = 2 * (len(common) + 8) * HALF_UNIT
        docs_of, added_of = np.split(doc, ends[1:-1]), np.split(added, ends[1:-1])
        longest = int(np.bincount(of_query, np.where(column[term] < 0, sizes[term], 0), 1).max())
        held, plus = np.empty(longest, np.int64), np.empty(longest)  # new room for each query would cost as much as the sums
        cuts, found = np.searchsorted(of_query, np.arange(len(names) + 1)), []
        for low in range(0, len(names), PASS_QUERIES):
            high = min(low + PASS_QUERIES, len(names))
            near, own = np.zeros((high - low, len(common)), np.float32), slice(cuts[low], cuts[high])
            wanted = column[term[own]]
            near[of_query[own][wanted >= 0] - low, wanted[wanted >= 0]] = 1
            near = near @ short.T
            for query, sums in enumerate(near, low):
                terms = term[cuts[query] : cuts[query + 1]]
                wanted = column[terms]
                rest, rare = np.zeros(n), terms[wanted < 0]
                if len(rare):
                    size, rare = sizes[rare].sum(), rare.tolist()
                    np.concatenate([docs_of[t] for t in rare], out=held[:size])
                    np.concatenate([added_of[t] for t in rare], out=plus[:size])
                    rest = np.bincount(held[:size], plus[:size], n)
                    sums += rest
                reach = float(_reach(sums[None], k)[0])
                row = np.flatnonzero(sums >= reach * (1 - wrong) - SLACK) if reach > 0 else np.flatnonzero(sums > 0)
                row = row[sums[row] > 0]
                score = np.round(rest[row] + whole[np.ix_(row, wanted[wanted >= 0])].sum(axis=1), DECIMALS)
                order = np.argsort(-score, kind="stable")[:k]
                order = order[score[order] > 0]
                found.append((np.full(len(order), query), row[order], score[order]))
        return _hit_lists(names, keys, found, schema)

    schema = _list_schema(schema)
    terms = weighed.select("term", "idf").distinct().withColumn("id", F.monotonically_increasing_id())
    terms = stored(terms, "terms-asked")
    n_postings = index.terms.join(terms, "term", "left_semi").agg(F.sum("df").alias("n")).first()["n"] or 0
    asked = weighed.join(terms.select("term", "id"), "term").groupBy(QUERY).agg(F.collect_set("id").alias("ids"))
    rows = index.postings.select(BUCKET, "block", "term", "pks", "tfs", "dls").join(terms, "term").drop("term")
    slices = max(2 * _slices(weighed, tasks), -(-n_docs // SLICE_ROWS), -(-n_postings // SLICE_POSTINGS))
    return _met(rows, [BUCKET, "block"], asked, slices, n_queries, compare, schema)


def block_bounds(weighed: DataFrame, index: Index, average: float) -> DataFrame:
    """(query_id, bucket, block, bound, place): the most that a document of a block can score, best blocks first.

    Read are the terms' bounds per block, not the postings.
    """
    bounds = index.postings.select(BUCKET, "block", "term", "max_tf", "min_dl")
    gain = _gain(F.col("idf"), F.col("max_tf"), F.col("min_dl"), average)
    blocks = bounds.join(weighed, "term").groupBy(QUERY, BUCKET, "block").agg(F.sum(gain).alias("bound"))
    order = Window.partitionBy(QUERY).orderBy(F.desc("bound"), BUCKET, "block")
    return blocks.withColumn("place", F.row_number().over(order))


def blocks_left(bounds: DataFrame, first: DataFrame, k: int) -> DataFrame:
    """The blocks not yet searched whose bound reaches the ``k``-th score found."""
    kth = first.filter(F.col("rank") == k).select(QUERY, F.col("score").alias("kth"))
    can = F.col("bound") + SLACK >= F.coalesce("kth", F.lit(0.0))
    return bounds.filter(F.col("place") > SEED_BLOCKS).join(kth, QUERY, "left").filter(can)


def weighed_terms(queries: DataFrame, index: Index) -> tuple[DataFrame, float]:
    """(query_id, term, idf) of each query's different terms that the index has, and the mean length."""
    asked = queries.select(QUERY, F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    totals = index.totals.first()  # the one row of the statistics
    average = totals["sum_dl"] / totals["n"] if totals["sum_dl"] else 1.0
    df = F.col("df").cast("double")
    idf = F.log(1 + (F.lit(float(totals["n"])) - df + 0.5) / (df + 0.5))
    weighed = index.terms.join(asked, "term").select(QUERY, "term", idf.alias("idf"))
    return stored(weighed, "asked-terms"), average


def search_keyword(queries: DataFrame, index: Index, k: int = 10, tasks: int | None = None) -> DataFrame:
    """(query_id, pk, score, rank) of the ``k`` rows with the highest BM25 score, exactly.

    ``queries`` holds query_id and text. A query counts each of its terms once; a row without any of them is no
    hit. A block's bound is the sum of what its terms can add. A query's blocks of the highest bounds are
    summed first; of the others only those are read whose bound reaches the ``k``-th score found there, and of
    these only the lists of asked terms. Sums exist for documents of these blocks alone. Of more than ``MOST_PAIRS``
    pairs of asked term and block none is written out: slices of the index then meet parts of the queries.
    """
    weighed, average = weighed_terms(queries, index)
    n_docs = index.totals.first()["n"]
    if weighed.count() * -(-n_docs // BLOCK_DOCS) > MOST_PAIRS:
        weighed = weighed.filter(F.col(QUERY).isNotNull())
        n_queries = weighed.select(QUERY).distinct().count()
        return _best_of_lists(_block_slices(weighed, n_queries, index, n_docs, average, k, tasks, _hit_schema(queries, index)), k)
    bounds = stored(block_bounds(weighed, index, average), "block-bounds")
    seeds = bounds.filter(F.col("place") <= SEED_BLOCKS).select(QUERY, BUCKET, "block")
    schema, n_queries = _hit_schema(queries, index), weighed.select(QUERY).distinct().count()
    first = stored(_best_hits(_block_hits(seeds, weighed, n_queries, index, average, k, schema), k), "first-hits")
    left = stored(blocks_left(bounds, first, k).select(QUERY, BUCKET, "block"), "blocks-left")
    rest = _block_hits(left, weighed, n_queries, index, average, k, schema)
    return _best_hits(first.select(schema.names).unionByName(rest), k)


def fuse(hits_a: DataFrame, hits_b: DataFrame, k: int) -> DataFrame:
    """Reciprocal rank fusion of two rankings."""
    part = F.lit(1.0) / (F.lit(FUSION_CONSTANT) + F.col("rank"))
    both = hits_a.select(QUERY, PK, part.alias("part")).unionByName(
        hits_b.select(QUERY, PK, part.alias("part"))
    )
    fused = both.groupBy(QUERY, PK).agg(F.round(F.sum("part"), DECIMALS).alias("score"))
    return top_k(fused, [QUERY], [F.col("score").desc(), F.col(PK).asc()], k)


def search_hybrid(
    queries: DataFrame, index: Index, k: int = 10, depth: int = FUSION_DEPTH, tasks: int | None = None
) -> DataFrame:
    """Vector and keyword search fused over the best ``depth`` of each. ``queries`` holds query_id, text, embedding."""
    depth = max(k, depth)
    return fuse(search_vector(queries, index, depth, tasks), search_keyword(queries, index, depth, tasks), k)


def embed_queries(
    queries: DataFrame, model: ModelFactory, request_size: int = EMBEDDING_REQUEST_LIMIT, tasks: int | None = None
) -> DataFrame:
    """Questions with a vector from the model that embedded the rows; written, so each is sent once."""
    dealt = queries.repartition(_slices(queries, tasks))
    return stored(dealt.withColumn(EMBEDDING, embed(F.col("text"), model, request_size)), "question-vectors")


def with_columns(hits: DataFrame, index: Index, columns: list[str]) -> DataFrame:
    """Hits with the caller's choice of index columns. A row may be a hit of very many queries."""
    payload = index.docs.select(PK, *[c for c in columns if c != PK])
    joined = spread_join(stored(hits, "hits"), payload, [PK], [F.col(QUERY)])
    return joined.select(QUERY, PK, "rank", "score", *[c for c in columns if c != PK])
