import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (id, text) or (id, text, source) rows."""

    def docs(rows):
        return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s0", len(r[1] or "")) for r in rows], DOCS)

    return docs


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


def words(n, start=0):
    return [f"w{(start + i) * 7919 % 100003}" for i in range(n)]
