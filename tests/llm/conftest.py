import pytest

from chunkloom.llm import queries


@pytest.fixture(scope="session")
def tokenizer():
    pytest.importorskip("public_tokenizers")
    return queries.tokenizer_path("byte_bpe_50k.json")


#: Nulls in every column, empty and blank texts, repeated rows and ids, ties, other scripts, and one very long text.
ODD = [
    (1, "the quick brown fox jumps over the lazy dog and runs away. " * 3, "en", "a", 1),
    (1, "the quick brown fox jumps over the lazy dog and runs away. " * 3, "en", "a", 1),
    (2, None, None, None, None),
    (3, "", "en", "b", 0),
    (4, " \n\t ", "de", None, 4),
    (None, "no id here, but some words", "en", "b", 5),
    (5, "le chat noir dort sur le tapis rouge près de la fenêtre", "fr", "c", 6),
    (5, "another text under the same id 5", "en", "c", 7),
    (6, "日本語のテキスト 🙂 <|endoftext|> éè", None, "c", 8),
    (7, "word " * 60_000, "en", "a", 9),
    (8, "x", "en", "a", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def odd(spark):
    """ODD with further columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, SCHEMA)
    clashing = ["size", "n", "word", "uid", "rep", "spans", "bucket", "late", "shard", "score", "lang_pred", "content", "first", "id", "kept"]
    return df.withColumns({c: F.lit("clash") for c in clashing})


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")
