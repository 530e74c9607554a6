import pytest

#: Texts that every operator must take: null, empty, blank, very short, ties, repeats, other scripts, one very long word.
ODD = [None, "", " \n\t ", "x", "same text here", "same text here", "Ünï ñandú 日本語 テスト 😀", "a" * 5000, "one two three\none two three\n\nfour"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd texts, ids that repeat or are null, and extra columns whose names clash with results."""
    rows = [(i, t, "en", "s", 1, 7, "k", 0.5) for i, t in enumerate(ODD)] + [(4, "same text here", None, None, None, None, None, None), (None, "no id at all", "de", "s", 1, 2, "z", 0.1)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words bigint, node string, score double"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
