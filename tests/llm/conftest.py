import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, tokens string, path string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns whose names operators use themselves."""
    long = " ".join(f"w{i % 5000} zürich{i}" for i in range(30_000))
    rows = [
        (1, "The cat sat on the mat and then it went away home", "en", "s", 10, "x", "y", "z"),
        (1, "The cat sat on the mat and then it went away home", "en", "s", 10, "x", "y", "z"),
        (2, None, None, None, None, None, None, None),
        (3, "", "en", "s", 0, "x", None, "z"),
        (4, " \n\t ", "en", "s", 4, "x", "y", "z"),
        (5, long, "en", "s", None, "x", "y", "z"),
        (6, long + " tail", "en", "s", None, "x", "y", "z"),
        (None, "no id here at all, none", "en", "s", 5, "x", "y", "z"),
        (7, "one two", "de", "s", 7, "x", "y", "z"),
        (8, "ONE two", "de", "s", 7, "x", "y", "z"),
        (9, "é́ \u0000 ☃ 𝄞 <|endoftext|> \x1c!\u0085", "fr", "t", 7, "x", "y", "z"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def tokenizer():
    from assayframe.llm import _tokens

    return _tokens.default_path()
