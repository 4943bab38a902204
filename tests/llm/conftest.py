import pytest

SCHEMA = "doc_id long, text string, source string, key string, unit string, tokens string, row string, toxic string"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes documents from (id, text) or (id, text, source); the other columns have names that operators might use."""

    def make(rows, schema=SCHEMA):
        return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "s", "k", "u", "t", "r", "x") for r in rows], schema)

    return make
