"""Vectorised word hashing over many texts at once (numpy inside tasks; Spark deals out the texts).

A word's hash is a polynomial over table-mixed bytes modulo 2^64, taken from one running sum, then finalised; a sequence
of words is hashed the same way over its word hashes. Equal words have equal hashes in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U = np.uint64
CHUNK_BYTES = 500_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (shift-multiply) on uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate(([U(1)], np.cumprod(np.full(max(0, n - 1), base, U)))) if n else np.zeros(0, U)


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse, self.up, self.down = base, pow(base, -1, 1 << 64), np.zeros(0, U), np.zeros(0, U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up, self.down = powers(self.base, size), powers(self.inverse, size)
        return self.up[:n], self.down[:n]

    def ranges(self, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of values[start:end] for each pair of bounds; it doesn't depend on where the range lies."""
        up, down = self.upto(len(values) + 1)
        with np.errstate(over="ignore"):
            total = np.concatenate(([U(0)], np.cumsum(values * up[:-1])))
            return mix((total[end] - total[start]) * down[start] + (end - start).astype(U))


BYTES, SEQUENCE = Powers(0x9E3779B97F4A7C15), Powers(0xD6E8FEB86659FD93)
BYTE_TABLE = mix(np.arange(1, 257, dtype=U) * U(0x2545F4914F6CDD1D))

#: Words are runs of anything but ASCII white space, unchanged.
ANY = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])
SAME = np.arange(256, dtype=np.uint8)
#: Words are runs of ASCII letters, digits, apostrophes and all non-ASCII characters.
LETTERS = np.array([b >= 128 or b == 39 or chr(b).isalnum() for b in range(256)])
#: ASCII capitals become small letters.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


class Words:
    """The words of some texts: byte bounds and hashes of all, and for each text its range of words."""

    def __init__(self, texts: list[bytes], inside: np.ndarray = ANY, fold: np.ndarray = SAME) -> None:
        self.data = b" ".join(texts)
        raw = np.frombuffer(self.data, np.uint8)
        is_word = inside[raw]
        edge = np.diff(np.concatenate(([0], is_word.view(np.int8), [0])))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.hash = BYTES.ranges(BYTE_TABLE[fold[raw]], self.start, self.end)
        at = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts]))).astype(np.int64)
        self.at = at[:-1]
        #: bounds[i]:bounds[i + 1] are the words of text i
        self.bounds = np.searchsorted(self.start, at)
        self.counts = np.diff(self.bounds)
        self.text = np.repeat(np.arange(len(texts)), self.counts)

    def sequences(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every run of ``size`` words that stays in its text."""
        n = len(self.hash)
        first = np.flatnonzero(np.arange(n) + size <= self.bounds[self.text + 1]) if n else np.zeros(0, np.int64)
        return first, SEQUENCE.ranges(self.hash, first, first + size)


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts of about ``limit`` bytes together, with the index of the first; a longer text comes alone."""
    begin = size = 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > limit:
            yield begin, texts[begin:i]
            begin, size = i, 0
        size += len(t)
    if texts:
        yield begin, texts[begin:]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    if len(x) < width:
        return x[:0]
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def packed(rows: DataFrame) -> DataFrame:
    """rows with their texts compressed, before a shuffle."""

    @F.pandas_udf("binary")
    def pack(texts: pd.Series) -> pd.Series:
        z = zstandard.ZstdCompressor(level=6)
        return pd.Series([z.compress(t.encode()) for t in texts])

    return rows.withColumn("text", pack("text"))
