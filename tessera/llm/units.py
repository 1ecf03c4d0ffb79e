"""Texts as rows of units (words or segments) that are encoded once each: shared by the two tokenizers.

A piece of an Arrow batch is cut into units, equal ones are found by Arrow, only units that a worker hasn't met lately go to
the encoder, and the ids of whole texts are gathered by index.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

KEPT, LONG, PIECE = 64_000_000, 64, 8_000_000


class Memory:
    """The ids of units by ``encode``, which takes different units and gives all ids and how many each unit has.

    Units are remembered as one Arrow array until they and their ids take ``kept`` bytes; those of more than ``LONG`` bytes
    are encoded each time, so that texts without white space can't fill it."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], kept: int = KEPT) -> None:
        self.encode, self.kept = encode, kept
        self.forget()

    def forget(self) -> None:
        self.units, self.ids, self.counts = pa.array([], pa.string()), np.zeros(0, "<u4"), np.zeros(0, np.int64)

    def __call__(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, how many each kind of unit has, and the kinds of ``units``, which differ from one another."""
        kind = pc.index_in(units, value_set=self.units).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(kind < 0)
        short = pc.binary_length(units).to_numpy(zero_copy_only=False)[new] <= LONG
        new = np.concatenate((new[short], new[~short]))
        fresh = units.take(pa.array(new))
        ids, counts = self.encode(fresh.to_pylist())
        kind[new] = len(self.units) + np.arange(len(new))
        all_ids, all_counts = np.concatenate((self.ids, ids)), np.concatenate((self.counts, counts))
        kept = int(short.sum())
        self.units = pa.concat_arrays([self.units, fresh[:kept]])
        self.counts = all_counts[: len(self.units)]
        self.ids = all_ids[: len(self.ids) + int(counts[:kept].sum())].copy()
        if self.units.nbytes + self.ids.nbytes + self.counts.nbytes > self.kept:
            self.forget()
        return all_ids, all_counts, kind


def laid_out(ids: np.ndarray, counts: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a row of units, where unit i is of kind[i] and ``counts`` says how many of ``ids`` each kind has in turn; and
    where each unit's end."""
    n = counts[kind]
    ends = np.cumsum(n)
    return ids[np.repeat((np.cumsum(counts) - counts)[kind] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)], ends


def pieces_of(texts: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive texts of about ``limit`` bytes together; a longer text comes alone."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = done = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield at, end
        at, done = end, int(ends[end - 1])
