from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from quirewise.model import table_schema  # noqa: E402
from quirewise.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, memory="8g", app="tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def table(spark):
    """Build a small table: by schema name, or by DDL."""

    def make(schema: str, *rows):
        structure = table_schema(schema) if " " not in schema else schema
        return spark.createDataFrame(list(rows), structure)

    return make


@pytest.fixture(scope="session")
def value(spark):
    """Evaluate one expression, with named string or number inputs as columns."""

    def evaluate(column, **inputs):
        names = list(inputs) or ["_none"]
        row = tuple(inputs.values()) or (0,)
        return spark.createDataFrame([row], names).select(column.alias("v")).first()["v"]

    return evaluate


def rows(df, *columns):
    """Sorted tuples of the chosen columns."""
    chosen = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in chosen.collect()), key=lambda r: tuple((v is None, str(type(v)), v) if not isinstance(v, (list, dict)) else (False, "", str(v)) for v in r))
