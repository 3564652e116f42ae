import pytest


def pytest_configure(config):
    pass


@pytest.fixture(scope="session")
def small(spark, tmp_path_factory):
    """A folder with a few documents of every odd kind, and a benchmark."""
    from tests.llm.cases import BENCHMARK, DOCUMENTS, EMBEDDINGS, PAGES

    folder = tmp_path_factory.mktemp("small")
    docs = spark.createDataFrame(DOCUMENTS, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame(BENCHMARK, "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    spark.createDataFrame(EMBEDDINGS, "vec_id long, embedding array<float>, label int").write.parquet(str(folder / "embeddings.parquet"))
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(str(folder / "pages.parquet"))
    return str(folder)
