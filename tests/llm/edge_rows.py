"""Small tables with every awkward kind of row."""

import random

SCHEMA = "doc_id long, text string"
WORDS = "the of and a to in is was for on that with as by at from it an be this which or are".split()


def prose(seed: int, words: int, lines: int = 1) -> str:
    pick = random.Random(seed)
    body = [f"{pick.choice(WORDS)}{pick.choice(WORDS)}{pick.randint(0, 99)}" for _ in range(words)]
    step = max(1, words // lines)
    return "\n".join(" ".join(body[i : i + step]) for i in range(0, words, step))


def awkward() -> list[tuple]:
    base = prose(1, 120, 6)
    return [
        (1, None), (2, ""), (3, "  \t \n "), (4, "one"), (5, "two words"), (6, base), (7, base),
        (8, prose(2, 30_000, 300)), (9, "x" * 60_000), (10, "é😀 日本語 ß\u0000\u0085 İ"),
        (11, prose(3, 80)), (11, prose(3, 80)), (None, base), (None, None), (12, "\n\n\n"),
        (13, base.upper()), (14, "a" * 39 + "\n" + "b" * 40), (-5, prose(4, 60)),
    ]


def table(spark, rows=None):
    rows = awkward() if rows is None else rows
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df, *names):
    """The table with extra columns named like an operator's outputs."""
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("own").alias(n) for n in names])
