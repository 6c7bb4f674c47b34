from __future__ import annotations

import os
import sys
import tempfile

import pytest

TESTS = os.path.dirname(os.path.abspath(__file__))
REPOSITORY = os.path.dirname(TESTS)
sys.path.insert(0, REPOSITORY)
# Python workers import the stand-in models that the test modules define.
os.environ["PYTHONPATH"] = os.pathsep.join([REPOSITORY, TESTS, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from turnwise.config import build_session

    warehouse = tempfile.mkdtemp(prefix="turnwise-warehouse-")
    session = build_session(
        "tests", "8", **{"spark.sql.warehouse.dir": warehouse, "spark.sql.shuffle.partitions": "4"}
    )
    yield session
    session.stop()


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)
