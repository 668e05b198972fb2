import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from marktrace.session import DEFAULT_SLICE_ROWS, build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", 4)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def sliced(spark):
    """Force hot-key slices at test size."""

    def set_rows(n):
        spark.conf.set("marktrace.sliceRows", str(n))

    yield set_rows
    spark.conf.set("marktrace.sliceRows", str(DEFAULT_SLICE_ROWS))
