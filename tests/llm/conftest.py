import pytest

ODD = "doc_id long, text string, lang string, source string, n_chars long, _text string, _k string, _lost long, _removed string, word string, pos long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, ties and
    repeated rows, and columns whose names operators like to use."""
    long_text = " ".join(f"w{i % 977}x" for i in range(120_000))
    texts = [(1, "one two three four five six\nseven"), (1, "one two three four five six\nseven"), (2, None), (3, ""), (4, " \n\t "), (None, None),
             (None, "one two three four five six\nseven"), (5, long_text), (6, long_text), (7, "a"), (7, "b"), (8, "a\na\na"), (9, "ſ K é x\r\ny & <|im_end|> 'tis")]
    return spark.createDataFrame([(i, t, None, "s", None, "x", "y", 1, None, "w", 2) for i, t in texts], ODD)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], ODD)


@pytest.fixture(scope="session")
def texts(spark):
    """Documents of a list of texts, numbered from 0."""
    return lambda *ts: spark.createDataFrame(list(enumerate(ts)), "doc_id long, text string")
