import os

import duckdb
import pytest


@pytest.fixture(scope="session")
def sf() -> str:
    return os.environ.get("LLM_TEST_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def docs(sf):
    """doc_id and text of all documents, ordered."""
    return duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet' order by doc_id").fetchall()


@pytest.fixture(scope="session")
def make(spark):
    """A documents table of (doc_id, text) pairs with extra columns of clashing names."""

    def build(rows):
        return spark.createDataFrame(
            [(i, t, "en", "s", None if t is None else len(t), "kept", 7) for i, t in rows],
            "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words int",
        )

    return build


#: Null, empty, blank, tied and repeated rows and one long text.
ODD = [
    (None, "a null id with a few words"), (1, None), (2, ""), (3, " \n\t\r "), (4, "one"), (4, "two words"), (5, "same row"),
    (5, "same row"), (6, "é̂ ñ ß   x\x00y \U0001f600"), (7, "la la la " * 30_000), (8, "x" * 200_000),
]
