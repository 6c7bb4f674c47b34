"""Every registered query beside its SQL, on the smallest test data."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check_queries import connect, differences, type_differences

FOLDER = "/root/testdata/sf0.001"
CONNECTION = connect(FOLDER)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_matches_its_sql(spark, name):
    result = queries()[name](spark, FOLDER)
    found = result.toPandas()
    assert len(found) > 0
    if name in oracle_sql():
        cursor = CONNECTION.execute(oracle_sql()[name])
        sql_types = {d[0]: str(d[1]) for d in cursor.description}
        spark_types = {f.name: f.dataType.simpleString() for f in result.schema.fields}
        assert type_differences(spark_types, sql_types) == ""
        assert differences(found, cursor.fetchdf()) is None


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0
