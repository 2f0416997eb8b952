import pytest

from cohortia.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        4,
        {
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rows(df, *order):
    """Rows as tuples, sorted by the given columns (all when left out)."""
    found = [tuple(r) for r in df.collect()]
    if order:
        places = [df.columns.index(c) for c in order]
        return sorted(found, key=lambda r: [(r[i] is None, r[i]) for i in places])
    return sorted(found, key=lambda r: [(v is None, str(v)) for v in r])


def records(df):
    return [r.asDict() for r in df.collect()]
