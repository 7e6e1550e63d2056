import pytest
from pyspark.sql import Row


def documents(spark, texts, **more):
    """Rows of a documents table, with extra columns whose names clash with the operators' own."""
    rows = [Row(doc_id=i, text=t, lang="en", source="s", n_chars=len(t or ""), id=9, key=8, n=7, row_key="k", kept="?", word="w", words="w")
            for i, t in texts]
    schema = ("doc_id long, text string, lang string, source string, n_chars long, id int, key int, n int, row_key string,"
              " kept string, word string, words string")
    return spark.createDataFrame(rows, schema)


@pytest.fixture
def docs(spark):
    return lambda texts: documents(spark, texts)


@pytest.fixture(scope="session")
def real(spark, sf_dir):
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels", "benchmark", "pages")}
