"""Column helpers for nested data and text templates."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(*parts: str) -> str:
    return ".".join(f"`{p}`" for p in parts)


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Turn nested structs into columns named by their path; arrays stay whole."""

    def leaves(schema: T.StructType, path: tuple[str, ...]):
        for field in schema.fields:
            here = (*path, field.name)
            if isinstance(field.dataType, T.StructType):
                yield from leaves(field.dataType, here)
            else:
                yield F.col(quoted(*here)).alias(sep.join(here))

    return df.select(*leaves(df.schema, ()))


def append_frames(*frames: DataFrame) -> DataFrame:
    """Rows of all frames below each other; a column absent from a frame is null there."""
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result


def first_or_null(array: Column) -> Column:
    return F.get(array, F.lit(0))


def last_or_null(array: Column) -> Column:
    return F.when(F.size(array) > 0, F.element_at(array, -1))


def all_but_last(array: Column) -> Column:
    return F.slice(array, F.lit(1), F.greatest(F.size(array) - 1, F.lit(0)))


def fill_template(template: str, **values: Column) -> Column:
    """``template.format(**values)`` over columns. Filled-in text is never searched for placeholders."""
    pieces: list[Column] = []
    for literal, field, _, _ in Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if field is not None:
            pieces.append(F.coalesce(values[field].cast("string"), F.lit("")))
    return F.concat(*pieces) if pieces else F.lit("")


def json_schema_of(sample: str) -> Column:
    """DDL of a JSON sample text, for a schema that is not known yet."""
    return F.schema_of_json(F.lit(sample))
