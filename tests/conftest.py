import pytest

from tests.compare import session


@pytest.fixture(scope="session")
def spark():
    return session()


@pytest.fixture
def rows(spark):
    """Make a DataFrame from a schema string and tuples."""

    def make(schema, *values):
        return spark.createDataFrame(list(values), schema)

    return make


def keyed(df, *keys):
    """Collected rows by key, each as a dict of its other columns."""
    found = {}
    for row in df.collect():
        values = row.asDict()
        key = tuple(values.pop(k) for k in keys)
        assert key not in found, f"two rows for {key}"
        found[key if len(keys) > 1 else key[0]] = values
    return found
