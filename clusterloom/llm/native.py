"""Column expressions over whole texts that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the characters that part words, as the inside of a character class.
SPACES = r" \t\n\x0b\f\r"


def words(text: Column) -> Column:
    """Array of the maximal runs of characters outside SPACES."""
    return F.array_remove(F.split(text, f"[{SPACES}]+"), "")


def spaced(text: Column) -> Column:
    """text with a space for each of the other characters that part words, but \\n."""
    odd = [text.contains(c) for c in "\t\x0b\f\r"]
    return F.when(odd[0] | odd[1] | odd[2] | odd[3], F.regexp_replace(text, r"[\t\x0b\f\r]", " ")).otherwise(text)


def has_word(text: Column) -> Column:
    return text.rlike(f"[^{SPACES}]")


def count_of(text: Column, characters: str) -> Column:
    """How many characters of text are among the given ones, which mean themselves in a character class."""
    return F.regexp_count(text, F.lit(f"[{characters}]"))
