import pytest
from pyspark.sql import functions as F

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{k % 977} other{k % 31}" for k in range(60_000))
TEXTS = [
    None,
    "",
    " \n\t ",
    "one",
    "The quick brown fox, the lazy dog and the end of it.",
    "The quick brown fox, the lazy dog and the end of it.",
    "The  quick brown fox,\nthe lazy dog and the end of it.",
    "the quick brown fox, THE lazy dog and the end of it.",
    "a b c d e f g h " * 12,
    "same line here\nsame line here\n\nother line\nsame line here",
    "x" * 70_000,
    " " * 5_000,
    "é日本\U0001F600 " * 300,
    "see <|endoftext|> and #*$%&|<> here",
    LONG,
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Awkward documents: NULL, empty, very long, equal and repeated rows, clashing columns."""
    rows = [(k, t, "en" if k % 2 else None, None, k) for k, t in enumerate(TEXTS)]
    rows += [rows[4], (None, "no id at all in this row", None, None, None)]
    df = spark.createDataFrame(rows, COLUMNS)
    clashing = "id key size digest kept shard bin cell n_words root node text_hash length items url".split()
    return df.select("*", *[F.lit("clash").alias(c) for c in clashing])


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)
