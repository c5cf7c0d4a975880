import pytest


@pytest.fixture(scope="session")
def word_bpe():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


AWKWARD = [
    # id, text, an extra column whose name operators might use themselves
    (1, "one two three four five six seven", "a"),
    (2, "one two three four five six seven", "b"),
    (2, "one two three four five six seven", "b"),
    (3, None, "c"),
    (4, "", None),
    (None, "", "d"),
    (None, "lonely null id", None),
    (5, "É straße xİ don't 42nd!! <|endoftext|> 日本語", "e"),
    (6, "word " * 30_000, "f"),
]


@pytest.fixture
def awkward(spark):
    """Nulls, empty and long texts, copies, repeated rows, an extra column with a clashing name."""
    return spark.createDataFrame(AWKWARD, "doc_id long, text string, kept string").repartition(3)
