import random

import pytest

LONG = " ".join(f"w{i % 977}" for i in range(30_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, id string, shard int, score double"


def edge_rows():
    """Nulls in any column, empty, blank and very long texts, copies, repeated rows, odd characters; extra columns with names that operators use."""
    rng = random.Random(5)
    words = ["the", "of", "and", "tion", "Ing", "er", "é", "日本", "x.", "y,"]
    prose = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(24)]
    texts = [None, "", "   ", "\n\t ", LONG, LONG, "one", "two words", prose[0], prose[0] + " ", prose[0].replace(" ", "\n"), prose[1], "\x1c odd \x00   ퟿", *prose[2:]]
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"s{i % 3}", None, 3, None, None, None) for i, t in enumerate(texts)]
    rows += [(None, prose[3], None, None, None, None, "a", 1, 0.5), (None, None, None, None, None, None, None, None, None), (None, prose[3], None, None, None, None, "a", 1, 0.5)]
    return rows + [rows[8], rows[8], rows[6]]


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
