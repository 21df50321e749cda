"""Words: normalising, cutting, hashing, owning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that end a word, and those among them that byte-level cutting looks for.
SPACE = r"[ \t\n\x0B\f\r]"
DELIMITERS = b"\t\n "


def unify(word: Column) -> Column:
    """Lower case; punctuation stays."""
    return F.lower(word)


def tokenise(text: Column) -> Column:
    """The words of a text, without empty ones. Null text has none."""
    return F.array_remove(F.split(F.coalesce(unify(text), F.lit("")), SPACE), "")


def byte_count(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def word_hash(word: Column, suffix: str = "") -> Column:
    """32 bits of a digest that other engines compute alike."""
    return F.conv(F.substring(F.md5(F.concat(word, F.lit(suffix))), 1, 8), 16, 10).cast("long")


def owner(word: Column, owners: int) -> Column:
    return (word_hash(unify(word)) % owners).cast("int")


def unit_random(word: Column, seed: int) -> Column:
    """A number in [0, 1) that a word keeps under a seed."""
    return word_hash(word, f"#{seed}") / F.lit(float(2**32))


def first_delimiter(data: Column) -> Column:
    """0-based place of the first tab, line feed or space in a text, -1 if there is none."""
    return (F.regexp_instr(data, F.lit(r"[\t\n ]")) - 1).cast("int")


def last_delimiter(data: Column) -> Column:
    """0-based place of the last one, or the length if there is none."""
    gap = F.regexp_instr(F.reverse(data), F.lit(r"[\t\n ]"))
    return (F.length(data) - gap).cast("int")
