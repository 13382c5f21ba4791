import pytest

pytest.importorskip("moundworks.llm.queries")


@pytest.fixture
def docs(spark):
    def make(rows, more=""):
        return spark.createDataFrame(rows, "doc_id long, text string" + more)

    return make
