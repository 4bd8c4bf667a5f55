"""Small document tables with every awkward case."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, tokens string, key string, position string, score string, `a.b` string, __drop string, __id string, __text string"
WORDS = ["".join(random.Random(i).choices("abcdefghijklmnop", k=3 + i % 6)) for i in range(3000)]


def prose(n: int, seed: int) -> str:
    return " ".join(random.Random(seed).choices(WORDS, k=n))


def row(doc_id, text, lang="en", source="s0"):
    return (doc_id, text, lang, source, None if text is None else len(text), *["x"] * 9)


def awkward():
    """Nulls in every column, empty and white texts, a very long one, ties, repeated rows and ids."""
    long = prose(60_000, 1)
    return [
        row(1, prose(80, 2)), row(2, None), row(3, ""), row(4, " \n\t "), row(5, long), row(6, long), row(None, prose(80, 2)), row(None, None, None, None),
        row(7, prose(70, 3), None, None), row(7, prose(70, 3), None, None), row(8, "word"), row(9, "word"), row(10, "!!! ???", "fr", "s1"),
        (11, prose(60, 4), "de", "s1", None, *[None] * 9), row(12, "été ÉTÉ  漢字 🚀"), row(5, prose(90, 5)),
    ]


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows(df):
    return [tuple(r) for r in df.collect()]
