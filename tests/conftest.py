import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cutline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("*", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rows(df, *cols):
    """Rows as sorted tuples, NULL first."""
    picked = df.select(*cols) if cols else df
    out = [tuple(r) for r in picked.collect()]
    return sorted(out, key=lambda t: [(v is not None, v if v is not None else 0) for v in t])
