import pytest


@pytest.fixture()
def rows(spark):
    """A table of (doc_id, text) with an extra column of a clashing name."""

    def make(pairs, extra="ids"):
        return spark.createDataFrame([(i, t, "x") for i, t in pairs], f"doc_id bigint, text string, {extra} string")

    return make


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "é ü ß \U0001f600 " * 20), (6, "a b c " * 5000), (7, "word"), (7, "word"), (None, "no id"), (8, "<|endoftext|> and \x00 bytes"), (9, "x" * 300000)]
