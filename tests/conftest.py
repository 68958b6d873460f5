import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from cohortloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", **{
        "spark.master": "local[8]", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def day(text):
    """Date from yyyy-mm-dd, or None."""
    return None if text is None else dt.date.fromisoformat(text)


def plus(n, base="2021-01-01"):
    return day(base) + dt.timedelta(days=n)


def rows(df, *columns):
    """Rows as a sorted list of tuples; None sorts first."""
    out = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
    return sorted(out, key=lambda r: [(v is not None, v) for v in r])
