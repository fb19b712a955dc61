import os

import pytest

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns whose names clash with results."""
    passage = " ".join(f"word{i}" for i in range(60))
    rows = [
        (1, "the quick brown fox"), (2, None), (None, "null id with a few words " + passage), (3, ""), (4, "  \n\t "), (5, passage), (5, passage),
        (6, "lead in " + passage + " and out"), (7, "a " * 5000), (8, "x" * 50000), (9, passage.upper()), (10, "   été 한국어 \x1c sep"),
        (11, " ".join(f"long{i % 700}" for i in range(20000))), (12, "one\ntwo\none\n\n two \none"), (13, "one\ntwo\none\n\n two \none"),
    ]
    data = [(i, t, "en", f"src{(i or 0) % 3}", 0, "x", 1, "y") for i, t in rows]
    return spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint, spans string, kept int, h string")
