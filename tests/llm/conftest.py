import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names operators might use."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(9000))
    rows = [
        (1, "alpha beta gamma " * 12), (2, "alpha beta gamma " * 12), (2, "alpha beta gamma " * 12), (3, None), (4, ""), (5, " \n\t "), (6, "one"),
        (7, long), (8, long + " tail"), (None, "no id at all here"), (9, "schön für Öl Größe " * 10), (10, "x" * 5000),
    ]
    schema = "doc_id long, text string, id long, row long, n long, spans_ string, bucket string, word string"
    return spark.createDataFrame([(*r, 1, 2, 3, "s", "b", "w") for r in rows], schema)
