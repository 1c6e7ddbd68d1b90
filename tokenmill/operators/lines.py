"""Corpus rows to one-line documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.functions.text import clean_line, has_text
from tokenmill.operators.order import first_rows


def corpus_lines(
    df: DataFrame, key: str, text_field: str = "text", max_rows: int | None = None
) -> DataFrame:
    """(key, line) for every row with text. ``max_rows`` keeps the first rows in key order.

    A text of whitespace alone becomes a blank line and still counts.
    """
    keep = has_text(F.col(text_field))
    kept = df.where(keep) if max_rows is None else first_rows(df, [key], max_rows, keep)
    return kept.select(key, clean_line(F.col(text_field)).alias("line"))
