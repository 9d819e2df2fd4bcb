"""Small tables with the awkward rows that every operator must take."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, n_words string"


def prose(seed: int, n: int) -> str:
    """``n`` invented words; different seeds share almost no 5-word run."""
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghiklmnoprstuvw") for _ in range(r.randint(2, 7))) for _ in range(n))


def documents(spark, rows):
    """``rows`` are (doc_id, text); further columns have names that operators use themselves, and nulls."""
    return spark.createDataFrame([(i, t, None, "s", None, None, None) for i, t in rows], DOCS)


def awkward():
    return [
        (1, prose(1, 60)), (1, prose(1, 60)),  # a repeated row
        (2, None), (3, ""), (4, " \t\n\x0b\x0c\r "), (None, prose(2, 40)), (None, None),
        (5, "one two"), (6, "x" * 5000), (7, " ".join(["again"] * 300)), (8, "é ß ñ ﬁ İ Ω 中文     \x1c ٣ ½"),
        (9, "<|endoftext|> [INST] </s> \\ \\<|turn|>"), (10, prose(3, 30_000)),
    ]
