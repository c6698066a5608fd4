import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with every awkward case: nulls, empty texts, repeats, ties, long texts, foreign names."""
    base = "The quick brown fox jumps over the lazy dog while seven wizards quietly mix potions in a cold dark room near the old river bank"
    rows = [
        (1, base, "a"), (2, base, "a"), (3, base + " today", "b"), (4, None, None), (5, "", "b"), (6, " \n\t ", "a"), (7, "one two", "a"), (7, "one two", "a"), (8, "é ü 你好 😀 " * 40, "c"),
        (9, "x" * 5000, "c"), (10, ("alpha beta gamma delta " * 400).strip(), "d"), (11, base.upper(), None), (12, "line one here\nline one here\nline two", "b"), (None, base, "a"), (13, "AKIA" + "Z" * 20 + " password = hunter22 token: abc", "a"),
        (14, "mail me at joe.doe@mail.example.com or +1 (212) 555-0100 from 10.0.0.1, 4111 1111 1111 1111", "b"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")
