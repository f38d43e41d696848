import pytest

from corpus_helpers import prose

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def odd_rows():
    """Null columns, empty, blank and very long texts, copies, near copies, repeated rows and ties."""
    base, passage = prose(1, 120), prose(2, 60)
    near = base.replace(base.split(" ")[60], "changed", 1)
    return [
        (0, base, "en", "a", 1), (1, base, "en", "a", 1), (2, near, "en", "b", 1), (3, None, "en", "a", None), (4, "", None, None, 0),
        (5, " \t\n ", "fr", "b", 4), (6, "one", "fr", "b", 3), (7, "One", None, "c", 3), (8, "one two three", "fr", None, 13),
        (9, f"{prose(3, 40)} {passage} {prose(4, 40)}", "fr", "c", 1), (10, f"{prose(5, 50)} {passage} {prose(6, 30)}", "fr", "c", 1),
        (11, prose(7, 30_000), "en", "a", 1), (12, "x" * 3000, "en", "b", 3000), (13, "é日本" * 300, "en", "b", 900),
        (14, "repeated row", "en", "a", 1), (14, "repeated row", "en", "a", 1), (15, "same id", "en", "a", 1), (15, "other text", "en", "a", 1),
        (None, "no id", "en", "a", 1), (None, None, None, None, None), (16, "<|endoftext|> a  b ć  d 's 12", "en", "a", 1),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """The same rows with columns of names that the operators use themselves."""
    from pyspark.sql import functions as F

    names = ["size", "key", "row", "id", "body", "copies", "_d", "_s", "_row", "taken", "family", "gram", "anchor", "piece", "score", "rank", "count", "order"]
    return odd.withColumns({n: F.lit(n) for n in names})
