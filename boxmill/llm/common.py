"""Shared pieces of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import broadcast_below, cut, cut_alone, dropped, shared_dir

#: Fixed patterns of the result contracts: a word, and one or more separators.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class WordHash(dict):
    """64-bit hashes of words, kept for the words seen of late."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, also where body is a nested lambda."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def words(c: Column, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def text_key(c: Column) -> list[Column]:
    """Two independent 64-bit hashes: rows with the same pair have the same text."""
    return [F.xxhash64(c), F.xxhash64(F.lit(1), c)]


def others(df: DataFrame, to: str) -> list[str]:
    """The columns of df that a new column `to` does not replace; names are the same in any case."""
    return [c for c in df.columns if c.lower() != to.lower()]


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores added until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


__all__ = ["LOWER", "SPACE", "UPPER", "WORD", "WordHash", "ascii_lower", "broadcast_below", "cut", "cut_alone", "dropped", "free_name", "let", "others", "shared_dir", "text_key", "text_or_empty", "words"]
