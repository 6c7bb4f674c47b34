"""Small tables with every odd row, and DuckDB over a pandas table."""

from __future__ import annotations

import duckdb
import pandas as pd

LONG = "lorem ipsum dolor sit amet consectetur " * 30_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, place int, words string"
ODD = [
    (1, None, None, None, None, None, None, None, None),
    (2, "", "en", "a", 0, 0.5, "k", 1, "w"),
    (3, " \t\n\x0b\x0c\r ", "en", "a", 7, 0.5, "k", 1, "w"),
    (None, "a text without an id", "en", "b", 20, 0.5, "k", 1, "w"),
    (None, None, None, None, None, None, None, None, None),
    (4, "one", "de", "b", 3, 0.5, "k", 1, "w"),
    (5, "the same row twice and once more", "en", "b", 32, 0.5, "k", 1, "w"),
    (5, "the same row twice and once more", "en", "b", 32, 0.5, "k", 1, "w"),
    (6, "ÄÖÜ ß é 漢字 😀 \x00 \x7f", "de", "b", 17, 0.5, "k", 1, "w"),
    (7, "1234 5678 ... --- !!!", None, "b", 21, 0.5, "k", 1, "w"),
    (8, LONG, "en", "a", len(LONG), 0.5, "k", 1, "w"),
]


def odd_docs(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def docs_of(spark, texts):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def sql_rows(sql: str, **tables) -> list[tuple]:
    connection = duckdb.connect()
    for name, (columns, rows) in tables.items():
        connection.register(name, pd.DataFrame(rows, columns=columns))
    return connection.execute(sql).fetchall()


def ordered(rows) -> list[tuple]:
    return sorted((tuple(r) for r in rows), key=repr)
