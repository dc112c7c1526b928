import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from faultline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("faultline-tests", "8")
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """rows(df, *columns) -> list of tuples."""

    def get(df, *columns):
        return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]

    return get
