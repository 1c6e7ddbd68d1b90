"""String expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points that Unicode-aware stripping removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Remove Unicode whitespace from both ends (plain ``trim`` removes spaces only)."""
    return F.btrim(text, F.lit(WHITESPACE))


def clean_line(text: Column) -> Column:
    """One document as one line: line feeds become spaces, ends are stripped.

    ``replace`` looks for bytes; ``translate`` looks up every character and takes ten times as long.
    """
    return strip(F.replace(text, F.lit("\n"), F.lit(" ")))


def line_ends(line: Column) -> Column:
    """A carriage return ends a line too, as it does once the line is read back from a file."""
    return F.replace(line, F.lit("\r"), F.lit("\n"))


def as_text(value: Column) -> Column:
    """Any scalar as stripped text."""
    return strip(value.cast("string"))


def has_text(text: Column) -> Column:
    """Neither null nor empty; whitespace alone counts as text."""
    return text.isNotNull() & (text != "")
