"""Small document tables with the odd cases that every operator must define."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "ter", "van", "sol", "pre", "qui") for b in ("na", "ri", "to", "den", "mo", "sta", "lev", "os")]


def sentence(rnd: random.Random, n: int) -> str:
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def odd_rows():
    """Nulls, empty and white texts, repeated rows."""
    return [(None, "some text without an id", "en", None, 5), (900, None, None, None, None), (901, "", "en", "a", 0), (902, " \t\n ", "en", "a", 4), (903, "one", "en", "a", 3), (903, "one", "en", "a", 3)]


def documents(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)
