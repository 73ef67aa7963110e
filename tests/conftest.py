import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tsspark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "tests", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """Rows as a DataFrame; a column called date is given as text."""
    from pyspark.sql import functions as F

    def build(rows, schema):
        names = [c.split()[0] for c in schema.split(", ")]
        as_text = ", ".join(c.replace(" date", " string") if c.endswith(" date") else c for c in schema.split(", "))
        df = spark.createDataFrame(rows, as_text)
        return df.withColumns({n: F.col(n).cast("date") for n, c in zip(names, schema.split(", "), strict=True) if c.endswith(" date")})

    return build


@pytest.fixture
def days():
    """Consecutive days as text, from a first one."""
    from datetime import date, timedelta

    def build(first, n):
        start = date.fromisoformat(first)
        return [(start + timedelta(days=i)).isoformat() for i in range(n)]

    return build
