import pytest

from glossa.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(4, 4)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


def rows(df, *order):
    """Rows as tuples, sorted by the named columns or by all of them."""
    got = [tuple(r) for r in df.collect()]
    keys = [df.columns.index(c) for c in order] if order else range(len(df.columns))
    return sorted(got, key=lambda r: tuple((r[i] is None, r[i]) for i in keys))
