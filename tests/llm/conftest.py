import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or longer tuples."""

    def make(rows, extra=""):
        full = [(*r, *[None, None, None][len(r) - 2 :])[:5] if len(r) < 5 else r for r in rows]
        return spark.createDataFrame(full, SCHEMA + extra)

    return make
