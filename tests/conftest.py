import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tickloom.session import research_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = research_session("tests", "8", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "8g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rows(df, *order):
    """Collected rows as tuples with doubles rounded, in a fixed order."""
    def tidy(v):
        return round(v, 8) + 0.0 if isinstance(v, float) else v

    out = [tuple(tidy(v) for v in r) for r in df.collect()]
    return sorted(out, key=str)
