"""What changed between two states of a keyed table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions.text import content_key

INSERT, UPDATE, DELETE = "insert", "update", "delete"


def content_hash(df: DataFrame, key: list[str]) -> Column:
    """A hash of all columns but the key. A null differs from an empty text."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in key]
    return F.sha2(F.to_json(F.struct(*rest)), 256)


def change_rows(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """The keys whose row was inserted, updated or deleted; unchanged keys are left out.

    Only keys and hashes are shuffled. Keys must be unique in each state.
    """
    old = before.select(*key, content_hash(before, key).alias("old_hash"))
    new = after.select(*key, content_hash(after, key).alias("new_hash"))
    return change_kinds(old, new, key)


def change_kinds(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The same from (key, old_hash) and (key, new_hash)."""
    kind = (
        F.when(F.col("old_hash").isNull(), INSERT)
        .when(F.col("new_hash").isNull(), DELETE)
        .when(F.col("old_hash") != F.col("new_hash"), UPDATE)
    )
    return (
        old.join(new, key, "full_outer")
        .withColumn("change", kind)
        .filter(F.col("change").isNotNull())
        .select(*key, "change")
    )


def with_content_key(df: DataFrame, columns: list[str], name: str = "id") -> DataFrame:
    return df.withColumn(name, content_key(*[F.col(c) for c in columns]))
