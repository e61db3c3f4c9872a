import pytest

from lakeimpact.llm.common import prepare


@pytest.fixture(autouse=True)
def prepared(spark):
    prepare(spark)


@pytest.fixture
def documents(spark):
    """Documents with an extra column whose name clashes with results."""

    def make(rows):
        full = [(i, t, lang, src, "x", 7) for i, t, lang, src in rows]
        return spark.createDataFrame(
            full, "doc_id bigint, text string, lang string, source string, kept string, score int"
        )

    return make
