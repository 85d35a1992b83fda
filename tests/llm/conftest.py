import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, start int, row string, base string, excess int, r string"


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text[, lang, source]) rows, with extra columns whose names clash."""

    def make(rows):
        full = [(r[0], r[1], *(r[2:] or ("en", "s")), None if r[1] is None else len(r[1]), "f", 1, "w", "b", 2, "q") for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, "Ünïcode wörds 日本 \U0001f600 end"), (7, "same text here. And more of it.\nSecond line"),
    (8, "same text here. And more of it.\nSecond line"), (8, "same text here. And more of it.\nSecond line"), (9, "x" * 5000), (None, "no id at all"), (10, "null lang", None, None), (11, "long " * 3000),
]


@pytest.fixture(scope="session")
def odd(frame):
    return frame(ODD)


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")
