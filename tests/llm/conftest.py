from pathlib import Path

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Builder of documents with a column that clashes with names used inside the operators."""
    from quarterdeck.llm.common import ship_code
    ship_code(spark)

    def build(rows):
        rows = [(i, t, lang, "src0", len(t or "")) for i, t, lang in ((*r, None)[:3] for r in rows)]
        return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS size", "'x' AS hash", "2 AS n", "3 AS id")
    return build


@pytest.fixture(scope="session")
def given():
    return str(Path("/root/testdata/sf0.001"))
