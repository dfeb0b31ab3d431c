import pytest
import public_tokenizers

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, length int, h string, fp long, row string"


@pytest.fixture(scope="session")
def bpe_path():
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def word_path():
    return public_tokenizers.path("word_bpe_49k.json")


def _row(i, text, lang="en"):
    return (i, text, lang, "s", 0, 7, "x", 1, "z")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, columns whose names the operators use inside."""
    long = "word " * 30_000 + "end"
    rows = [
        _row(1, "The quick brown fox jumps over the lazy dog."), _row(2, "The quick  brown\tfox jumps\nover the lazy dog."), _row(3, None), _row(4, ""), _row(5, " \t\n"),
        _row(6, long), _row(6, long), _row(7, "tie a b c"), _row(8, "tie a b c"), _row(9, "short", None), _row(None, "no id at all"), _row(10, "ab" * 40_000),
        _row(11, "<|endoftext|> é İ 日本 ﬁ \u0085 x y 😀 mail a.b@example.com now +1 (555) 010-4477"), (None, None, None, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def some(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
