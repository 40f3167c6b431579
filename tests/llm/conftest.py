import pytest

DOCS_DDL = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) pairs or longer tuples, with the columns of the table."""
    def make(rows, ddl=DOCS_DDL):
        width = len(ddl.split(","))
        return spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], ddl)
    return make
