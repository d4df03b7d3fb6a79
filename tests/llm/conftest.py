import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [  # nulls, blanks, copies, a repeated row, a repeated id, a very long text
    (1, None, "en", "a", 0), (2, "", None, "a", 0), (3, " \n\t ", "en", None, 4), (4, "one two", "en", "a", 7),
    (5, "one two", "en", "b", 7), (6, "ONE\ttwo", "de", "b", 7), (7, "one two three", "en", "a", 13),
    (7, "one two three", "en", "a", 13), (8, "say it again say it again say it again say it again", "en", "b", 52),
    (8, "mail me@example.com or +1 (555) 010-9999 now", "en", "b", 44), (None, "a null id has a text as well", "en", "a", 28),
    (9, "é中😀 ß x İstanbul ١٢٣ ﬀ", "de", "c", 21), (10, "word " * 60_000 + "end", "en", "a", 300_003),
    (11, " ".join(f"w{i}" for i in range(400)), "en", "a", 0), (12, " ".join(f"w{i}" for i in range(3, 400)), "en", "a", 0),
    (13, "4111 1111 1111 1111 and 10.0.0.1, token = \"abcdef0123456789abcd\" http://a.b/c?d=e.", "en", "a", 0),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows with columns whose names operators use for themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, DOC)
    return df.withColumns({c: F.lit(c) for c in ("quality", "spans", "_d", "_h", "_digest", "n_words", "score", "_rate", "_host",
                                                "length", "part", "rank", "ids", "block", "t")})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOC)
