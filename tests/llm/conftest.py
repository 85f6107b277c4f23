import pytest

from scribemend.llm.common import ship_package


@pytest.fixture(scope="session")
def llm(spark):
    ship_package(spark)
    return spark


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(llm):
    """Makes a documents table of (doc_id, text) or (doc_id, text, source) rows, with columns of clashing names."""
    def make(rows):
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", None, 1, "x", 2) for r in rows]
        return llm.createDataFrame(full, DOCS + ", kept int, text_sha256 string, size int")
    return make
