"""Joins and rankings that hold when one key owns a large part of all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.config import work_folder

SPREAD, SLICES = "_spread", "_slices"
HOT_ROWS = 1_000_000
MOST_HOT_KEYS = 100_000


def spread_join(
    rows: DataFrame,
    facts: DataFrame,
    on: list[str],
    spread: list[Column],
    how: str = "inner",
    hot_rows: int | None = None,
) -> DataFrame:
    """Join many ``rows`` per key with one ``facts`` row per key, also where one key is very frequent.

    A key with more than ``hot_rows`` rows, a million by default, is hot. Its rows are cut by a hash of ``spread`` into
    slices of about that size, its facts are copied to these slices, and the join is on key and
    slice. Other keys are one slice. Only the keys are read to find the hot ones. A key also has to
    own more than the ``MOST_HOT_KEYS``-th part of all rows to be hot, so there are fewer hot keys
    than that and as many copies at most, however large the data: the list is safe to broadcast.
    """
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    least = F.greatest(F.lit(hot_rows or HOT_ROWS), F.ceil(total / F.lit(MOST_HOT_KEYS)))
    sizes = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"), F.max(least).alias("_least"))
    hot = F.broadcast(
        sizes.filter(F.col("_n") > F.col("_least")).select(
            *on, F.ceil(F.col("_n") / F.col("_least")).alias(SLICES)
        )
    )
    slices = F.coalesce(F.col(SLICES), F.lit(1).cast("long"))
    cut = rows.join(hot, on, "left").withColumn(SPREAD, F.pmod(F.xxhash64(*spread), slices))
    copied = facts.join(hot, on, "left").withColumn(
        SPREAD, F.explode(F.sequence(F.lit(0).cast("long"), slices - 1))
    )
    return cut.drop(SLICES).join(copied.drop(SLICES), [*on, SPREAD], how).drop(SPREAD)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read back, where it would be computed more than once."""
    folder = work_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def hash_slices(*columns: Column, slices: int = 1024) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(slices))


def order_slices(order: Column, width: int = 1024) -> Column:
    """Slices of at most ``width`` rows where ``order`` is a whole number unique in its key."""
    return F.coalesce(F.call_function("div", order.cast("long"), F.lit(width)), F.lit(0).cast("long"))


def top_k(
    df: DataFrame, by: list[str], order: list[Column], k: int, slice_of: Column | None = None
) -> DataFrame:
    """The first ``k`` rows per key, with their ``rank``.

    With ``slice_of`` the rows of a key are ranked per slice first, so the final ranking of a key
    sees at most ``k`` rows per slice.
    """
    if slice_of is not None:
        inner = Window.partitionBy(*by, SPREAD).orderBy(*order)
        df = (
            df.withColumn(SPREAD, slice_of)
            .withColumn("rank", F.row_number().over(inner))
            .filter(F.col("rank") <= k)
            .drop(SPREAD, "rank")
        )
    window = Window.partitionBy(*by).orderBy(*order)
    ranked = df.withColumn("rank", F.row_number().over(window).cast("long"))
    return ranked.filter(F.col("rank") <= k)


def use_all_cores(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """Deal rows to ``tasks`` tasks, the cluster's default parallelism if not given, before work that is heavy per row.

    For sources of few files; what is read in many splits anyway needs none of this.
    """
    return df.repartition(tasks or df.sparkSession.sparkContext.defaultParallelism)


def arrow_runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """The runs of rows with equal first ``n_keys`` whole-number columns, also across batches."""
    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy() for i in range(n_keys)])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        for start, end in zip([0, *cuts], [*cuts, batch.num_rows]):
            new = tuple(keys[:, start])
            if held and new != key:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            key = new
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
