"""Tables as batch source, as stream and as sink."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnwise.config import is_folder, path_exists, remove_folder


def _fresh(table: str) -> str:
    return f"{table}__fresh"


def recover_table(spark: SparkSession, table: str) -> None:
    """Finish a replacement that was stopped after the old table was dropped: the new one is complete by then."""
    if not spark.catalog.tableExists(table) and spark.catalog.tableExists(_fresh(table)):
        spark.sql(f"ALTER TABLE {_fresh(table)} RENAME TO {table}")


def scan(spark: SparkSession, table: str) -> DataFrame:
    """A table by name, or a parquet folder or file by path."""
    if "/" in table:
        return spark.read.parquet(table)
    recover_table(spark, table)
    return spark.table(table)


def preview(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """A look at ``n`` rows; which ones is open unless an order is given."""
    return (df.orderBy(*order) if order else df).limit(n)


def row_count(df: DataFrame, name: str = "n_rows") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def stream_table(
    spark: SparkSession,
    table: str,
    schema: T.StructType | None = None,
    files: str | None = None,
    files_per_trigger: int | None = None,
) -> DataFrame:
    """The rows appended to a table, as a stream. Paths need a schema; ``files`` is a name filter.

    If ``files`` is the name of a folder in the path, as a table of many files has one, that folder is read.
    ``files_per_trigger`` bounds a batch, so that a backlog is worked off in several.
    """
    reader = spark.readStream
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if "/" not in table:
        recover_table(spark, table)
        return reader.table(table)
    reader = reader.schema(schema)
    if files and is_folder(spark, f"{table}/{files}"):
        return reader.parquet(f"{table}/{files}")
    return (reader.option("pathGlobFilter", files) if files else reader).parquet(table)


def replace_table(df: DataFrame, table: str, folder: str | None = None) -> None:
    """Overwrite contents and schema of a table. ``df`` may read the table itself.

    With ``folder`` data go to a new place below it, and the files of the replaced table are removed. If the columns
    stay the same the table is pointed to its new place, in a single step. Otherwise, and without
    ``folder``, where a table keeps its place as streams that read it need, the new contents are complete in a second
    table before the old one is dropped and the second takes its name. The built-in catalog has no single step
    for that; if the job is stopped in between, the next use of the table (``scan``, ``stream_table``,
    ``create_table`` or this function) gives the second table its name.
    """
    spark = df.sparkSession
    recover_table(spark, table)
    place = f"{folder}/{uuid.uuid4().hex}" if folder is not None else None
    writer = df.write.format("parquet")
    if place is not None:
        writer = writer.option("path", place)
    if not spark.catalog.tableExists(table):
        writer.saveAsTable(table)
        return
    old = _location(spark, table)
    if place is not None and _columns(spark.table(table)) == _columns(df):
        df.write.parquet(place)
        spark.sql(f"ALTER TABLE {table} SET LOCATION '{place}'")
        spark.catalog.refreshTable(table)
    else:
        spark.sql(f"DROP TABLE IF EXISTS {_fresh(table)}")
        writer.saveAsTable(_fresh(table))
        spark.sql(f"DROP TABLE {table}")
        spark.sql(f"ALTER TABLE {_fresh(table)} RENAME TO {table}")
    if folder is not None:
        remove_folder(spark, old)


def _columns(df: DataFrame) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in df.schema.fields]


def _location(spark: SparkSession, table: str) -> str:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").filter("col_name = 'Location'").collect()
    return rows[0]["data_type"]


def create_table(spark: SparkSession, table: str, schema: T.StructType) -> None:
    """Create an empty table unless it exists."""
    recover_table(spark, table)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet")


def append_batch(df: DataFrame, folder: str, batch: int) -> None:
    """Append one numbered batch to a folder. Writing a number again replaces that batch.

    Batches may bring columns that earlier ones lack.
    """
    df.write.mode("overwrite").parquet(f"{folder}/batch={batch}")


def read_batches(spark: SparkSession, folder: str, schema: T.StructType | None = None) -> DataFrame:
    """All batches of a folder; the columns of all batches, null where a batch lacks one."""
    if schema is not None and not path_exists(spark, folder):
        return spark.createDataFrame([], schema)
    reader = spark.read.option("mergeSchema", "true")
    return (reader.schema(schema) if schema is not None else reader).parquet(folder)
