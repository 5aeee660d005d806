import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from tallyweave.session import build_session

    session = build_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="2", spark__driver__memory="4g", spark__ui__showConsoleProgress="false"
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


def rows(df, *keys):
    """Rows as dictionaries, keyed by one column or a tuple of columns."""
    out = {}
    for row in df.collect():
        key = row[keys[0]] if len(keys) == 1 else tuple(row[k] for k in keys)
        out[key] = row.asDict(recursive=True)
    return out
