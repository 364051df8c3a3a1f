import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from oracle import session
    return session()


@pytest.fixture()
def rows():
    """Rows of a frame as plain tuples, sorted."""
    def get(df, *columns):
        return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    return get
