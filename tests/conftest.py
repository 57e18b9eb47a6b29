from __future__ import annotations

import math
import sys
from datetime import date, datetime
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from memberlens.session import local_session  # noqa: E402

AS_OF = date(2025, 7, 1)
LOAD_TIME = datetime(2025, 7, 1, 1, 59)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(
        "4",
        shuffle_partitions=4,
        memory="4g",
        **{"spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """A DataFrame from a DDL schema and rows."""

    def build(schema: str, *rows):
        return spark.createDataFrame(list(rows), schema)

    return build


def plain(value):
    return None if isinstance(value, float) and math.isnan(value) else value


def rows_of(df, *columns: str) -> list[tuple]:
    """Rows as sorted tuples, NULLs last."""
    picked = df.select(*columns) if columns else df
    found = [tuple(plain(v) for v in row) for row in picked.collect()]
    return sorted(found, key=lambda row: [(v is None, str(v)) for v in row])


def duck_rows(relation, columns: list[str]) -> list[tuple]:
    place = [relation.columns.index(c) for c in columns]
    found = [tuple(plain(row[i]) for i in place) for row in relation.fetchall()]
    return sorted(found, key=lambda row: [(v is None, str(v)) for v in row])
