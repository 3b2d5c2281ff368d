import pytest

TINY = "/root/testdata/sf0.001"
SMALL = "/root/testdata/sf0.01"

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Nulls, empty texts, white space alone, ties, repeated rows, odd characters.
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "s", 0),
    (3, "   \n\t  ", "en", "s", 7),
    (4, "one two  three\n\n four\t five", "en", "s", 27),
    (4, "one two  three\n\n four\t five", "en", "s", 27),
    (5, "onetwothree four five", "en", None, 21),
    (None, "no id here", "en", "s", 10),
    (None, None, None, None, None),
    (6, "Ünïcödé 漢字かな交じり文    \x1c\x85 🎉🎉 á ١٢٣ don't we'll", "xx", "s", 40),
    (7, "a" * 5000, "en", "s", 5000),
    (8, "ab" * 3000 + " " * 700 + "\n" * 30 + "!?" * 400, "en", "s", 9000),
    (9, "<|endoftext|> x <|endoftext|>", "en", "s", 29),
    (10, "漢" * 3000, "zh", "s", 3000),
    (11, "   leading   and   trailing   ", "en", "s", 30),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, DOC_SCHEMA).selectExpr("*", "1 as kept", "'x' as ids", "2 as length", "'t' as task")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")
