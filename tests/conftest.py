import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tabrecon.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[*]", shuffle_partitions=8, app="tabrecon-tests")
    yield s
    s.stop()


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="tabrecon-test-")


def rows(df, *cols):
    """Sorted list of tuples of the given columns (all columns when none given)."""
    cols = cols or tuple(df.columns)
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=_sort_key)


def _sort_key(t):
    out = []
    for v in t:
        if v is None:
            out.append((1, ""))
        elif isinstance(v, (int, float)) and not isinstance(v, bool):
            out.append((0, f"{v + 1e15:040.10f}"))
        else:
            out.append((0, str(v)))
    return tuple(out)
