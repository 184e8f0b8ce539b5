"""Reproducible uniforms that depend on a key and a seed only, never on the partitioning."""

from __future__ import annotations

from collections.abc import Sequence
from math import sin

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_52 = 4503599627370496.0
TWO_32 = 4294967296.0
_MASK = 0xFFFFFFFF
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
#: Constant, word and rotation of MD5's steps, as far as the first word of a digest takes.
_STEPS = [(int(abs(sin(i + 1)) * 2**32), (i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16, _TURNS[i // 16][i % 4]) for i in range(61)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def uniform(seed: int | str, *keys: str | Column) -> Column:
    """A uniform in [0, 1) from the first 13 hex digits of md5('seed:key:...')."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    text = F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(TWO_52)


def uniform_sql(seed: int | str, *keys: str) -> str:
    """The same number as DuckDB SQL."""
    parts = ", ".join([f"'{seed}'", *[f"cast({k} as varchar)" for k in keys]])
    return f"(concat('0x', substr(md5(concat_ws(':', {parts})), 1, 13))::bigint::double / 4503599627370496)"


def tail_words(tails: Sequence[bytes], head: int) -> tuple[int, np.ndarray]:
    """What first_words takes for ends of texts, all of one length, behind heads of `head` bytes."""
    t = len(tails[0])
    if head + t > 55:
        raise ValueError("head and tail have more than 55 bytes")
    front, end = bytes(head % 4), b"\x80" + bytes(-(head % 4 + t + 1) % 4)
    return t, np.frombuffer(b"".join([front + x + end for x in tails]), "<u4").reshape(len(tails), -1).T.copy()


def first_words(heads: Sequence[bytes], tails: tuple[int, np.ndarray]) -> np.ndarray:
    """The first 32 bits of the md5 of each head (a row) with each tail (a column), as uint32: the upper 32 of uniform's 52 bits.

    heads are of one length, tails come from tail_words. All pairs are hashed step by step at once;
    some 16,000 a call stay in the cache.
    """
    h, (t, rest) = len(heads[0]), tails
    shape, first = (len(heads), rest.shape[1]), h // 4  # the word in which tails begin
    own = np.frombuffer(b"".join(x + bytes(-h % 4) for x in heads), "<u4").reshape(shape[0], -1)
    words: list = [0] * 14 + [(h + t) * 8, 0]
    for i in range(own.shape[1]):
        words[i] = own[:, i : i + 1]
    for i, x in enumerate(rest):
        words[first + i] = words[first + i] | x if i == 0 and h % 4 else x[None]
    a, b, c, d = (np.full((shape[0], 1), x, np.uint32) for x in _START)
    free = [np.empty(shape, np.uint32) for _ in range(4)]
    f, g = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i, (constant, w, turn) in enumerate(_STEPS):
        if i < first:  # the same for all tails
            x = a + (d ^ (b & (c ^ d))) + (words[w] + np.uint32(constant))
            a, b, c, d = d, b + (x << np.uint32(turn) | x >> np.uint32(32 - turn)), b, c
            continue
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        np.add(f, np.uint32((words[w] + constant) & _MASK) if isinstance(words[w], int) else words[w] + np.uint32(constant), out=f)
        np.left_shift(f, np.uint32(turn), out=g)
        np.right_shift(f, np.uint32(32 - turn), out=f)
        np.bitwise_or(f, g, out=f)
        new = a if i - first >= 4 else free.pop()
        np.add(f, b, out=new)
        a, b, c, d = d, new, b, c
    return (b + np.uint32(_START[0])).byteswap()
