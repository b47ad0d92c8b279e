from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from panelcycle.schema import LONG_COLUMNS, OBSERVATION_SCHEMA  # noqa: E402
from panelcycle.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4, app="tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not Path(SF).exists():
        pytest.skip("test tables are not there")
    return SF


@pytest.fixture(scope="session")
def panel_of(spark):
    """Panel from (entity, indicator, date, value[, source]) tuples."""

    def build(rows):
        full = []
        for row in rows:
            entity, indicator, date, value, *source = row
            full.append((entity, indicator, day(date), float(value), source[0] if source else "SRC", "SID", None))
        return spark.createDataFrame(full, OBSERVATION_SCHEMA)

    return build


def day(value) -> dt.date:
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(value)


def months(start: str, n: int) -> list[dt.date]:
    first = dt.date.fromisoformat(start)
    return [dt.date(first.year + (first.month - 1 + i) // 12, (first.month - 1 + i) % 12 + 1, 1) for i in range(n)]


__all__ = ["LONG_COLUMNS", "day", "months"]
