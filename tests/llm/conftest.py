import pytest
from llm_helpers import EDGE

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, uid string, key string, sig string, row string, _h string, kept string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with extra columns whose names the operators use themselves."""

    def make(rows):
        full = [(i, t, "en", s, None if t is None else len(t), "x", "x", "x", "x", "x", "x", "x") for i, t, s in rows]
        return spark.createDataFrame(full, DOCS).repartition(3)

    return make


@pytest.fixture(scope="session")
def edge_docs(make_docs):
    return make_docs(EDGE)


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])
