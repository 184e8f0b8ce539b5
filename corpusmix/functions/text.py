"""Columns computed from a text."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: What str.isspace() holds for white space.
BLANKS = (*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def doc_id(text: str | Column = "text") -> Column:
    """The first 12 hex digits of the text's md5: equal texts share an id. Null for null."""
    return F.substring(F.md5(F.encode(text, "UTF-8")), 1, 12)


def words(text: str | Column = "text") -> Column:
    """Parts of a text between runs of white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def tokens_by_words(text: str | Column = "text") -> Column:
    """1.3 tokens a word, rounded down, at least 1; null texts count as empty."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.greatest(F.lit(1).cast("long"), F.floor(F.size(words(t)) * F.lit(1.3)).cast("long"))


def tokens_by_chars(chars: Column, floor: bool = True) -> Column:
    """A token for four characters, with a floor of 1 or without."""
    n = F.floor(F.coalesce(chars, F.lit(0)) / 4).cast("long")
    return F.greatest(F.lit(1).cast("long"), n) if floor else n


def _top_share(least: int):
    """The share of the most frequent character other than white space, 0 for fewer than `least` of those; counting characters
    has no built-in that doesn't explode them. A text's code points are counted as one array."""
    blanks = np.array(BLANKS)

    @F.pandas_udf(DoubleType())
    def top(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> float:
            if not t:
                return 0.0
            codes = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            if codes.max() < 1 << 14:  # counters up to the highest code point
                n = np.bincount(codes, minlength=1 << 14)
                n[blanks] = 0
            else:
                n = np.unique(codes[~np.isin(codes, blanks)], return_counts=True)[1]
            total = int(n.sum())
            return float(n.max()) / total if total >= max(1, least) else 0.0

        return texts.map(one)

    return top


def repetitive(text: str = "text", share: float = 0.3, least: int = 1000) -> Column:
    """Whether one character makes up more than share of at least `least` characters other than white space.

    Shorter texts, decided without Python, and null ones aren't repetitive.
    """
    long = F.coalesce(F.length(text), F.lit(0)) >= least
    return F.coalesce(F.when(long, _top_share(least)(F.when(long, F.col(text))) > share).otherwise(F.lit(False)), F.lit(False))


def hygiene(text: str = "text", max_chars: int = 1_000_000, share: float = 0.3) -> Column:
    """The first reason to drop a text: 'empty', 'too_long' or 'repetition'; 'kept' if there is none."""
    t = F.col(text)
    return F.when(t.isNull() | (t == ""), "empty").when(F.length(t) > max_chars, "too_long").when(repetitive(text, share), "repetition").otherwise("kept")


def printable_share(text: str = "text") -> Column:
    """The share of visible ASCII characters and blanks; null for empty and null texts."""
    n = F.length(text)
    return F.when(n > 0, F.length(F.regexp_replace(F.col(text), "[^ -~]", "")) / n)
