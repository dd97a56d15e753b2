import string

import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows and a clashing column."""
    long = " ".join(f"w{i % 97}x{i % 89}" for i in range(30_000))
    same = "one two three four five six seven eight nine ten\neleven twelve thirteen fourteen fifteen\nsixteen seventeen eighteen nineteen twenty"
    rows = [
        (1, same), (2, same), (2, same), (3, None), (4, ""), (5, "  \n\t "), (6, long), (7, long + " tail"), (None, same), (None, None), (8, "short"), (9, "short"),
        (10, same.upper()), (11, "é" * 60 + "漢字" * 30), (12, string.printable * 3),
    ]
    return spark.createDataFrame([(d, t, 7) for d, t in rows], "doc_id long, text string, score int")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, score int")
