"""Document fingerprints from closed syncmers.

A k-mer of code points is an anchor when the least hash among its inner s-mers lies at one of its two edges. The choice
looks at nothing outside the k-mer, so an edit disturbs only the anchors that it touches. A fingerprint holds all of a text's
anchors in order of position, each as eight hex digits of the position and eight of its hash: one anchor in some 3.5 code
points, however long the text.

The likeness of two fingerprints is positional: anchors are matched by hash (the nth occurrence with the nth), the longest
chain of matches that rises in both texts counts, and its length over the number of different anchors of both is the likeness:
1 for equal fingerprints, 0 for disjoint ones.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import shuffle_partitions, text_of
from tessera.llm.words import Powers, U, mix, sliding_min

K, S = 12, 6
LEAST = 1  # 1 / LEAST of a text's anchors stays at least: all of them
CHUNK_CHARS = 500_000
PARTS = 4  # runs of documents a shuffle partition
POINTS = Powers(0xA24BAED4963EE407)


def anchors(texts: list[str], k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, 32-bit hash) of all closed syncmers."""
    lengths = np.array([len(t) for t in texts], np.int64)
    points = mix(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U) + U(1))
    n = len(points)
    if n < k:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint32),)
    at = np.arange(n - s + 1)
    inner = POINTS.ranges(points, at, at + s)
    width = k - s + 1
    least = sliding_min(inner, width)
    edge = np.flatnonzero((inner[: len(least)] == least) | (inner[width - 1 :] == least))
    ends = np.cumsum(lengths)
    text = np.searchsorted(ends, edge, "right")
    inside = edge + k <= ends[text]
    edge, text = edge[inside], text[inside]
    return text, edge - (ends - lengths)[text], (POINTS.ranges(points, edge, edge + k) >> U(32)).astype(np.uint32)


class Fingerprint(NamedTuple):
    """Positions and hashes of a text's anchors in order."""

    positions: np.ndarray
    hashes: np.ndarray

    def written(self) -> str:
        return np.stack([self.positions.astype(np.uint32), self.hashes], 1).astype(">u4").tobytes().hex()


def fingerprints_of(texts: list[str], k: int = K, s: int = S) -> list[Fingerprint]:
    """A text without anchors has the hash of the whole text instead, an empty text none."""
    out: list[Fingerprint] = []
    begin = total = 0
    for i in range(len(texts) + 1):
        if i == len(texts) or total + len(texts[i]) > CHUNK_CHARS and i > begin:
            part = texts[begin:i]
            text, at, h = anchors(part, k, s)
            bounds = np.searchsorted(text, np.arange(len(part) + 1)).tolist()
            for t, a, b in zip(part, bounds, bounds[1:]):
                if a == b and t:
                    out.append(Fingerprint(np.zeros(1, np.int64), np.array([xxhash.xxh32_intdigest(t.encode())], np.uint32)))
                else:
                    out.append(Fingerprint(at[a:b], h[a:b]))
            begin, total = i, 0
        if i < len(texts):
            total += len(texts[i])
    return out


def numbered(hashes: np.ndarray) -> np.ndarray:
    """Each hash with the number of its earlier occurrences."""
    order = np.argsort(hashes, kind="stable")
    row, at = hashes[order], np.arange(len(hashes))
    first = np.maximum.accumulate(np.where(np.concatenate(([True], row[1:] != row[:-1])), at, 0)) if len(row) else at
    out = np.empty(len(hashes), U)
    out[order] = row.astype(U) << U(32) | (at - first).astype(U)
    return out


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    x, y = a.hashes, b.hashes
    total, n = len(x) + len(y), min(len(x), len(y))
    if not total:
        return 1.0
    differ = np.flatnonzero(x[:n] != y[:n])
    same = int(differ[0]) if len(differ) else n  # a common beginning belongs to a longest chain
    _, p, q = np.intersect1d(numbered(x[same:]), numbered(y[same:]), assume_unique=True, return_indices=True)
    tails: list[int] = []  # the least last place of a rising chain of each length
    for i in q[np.argsort(p)].tolist():
        if not tails or i > tails[-1]:
            tails.append(i)
        else:
            tails[bisect_left(tails, i)] = i
    chain = same + len(tails)
    return chain / (total - chain)


ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compared(ids: list, texts: list[str], after: str) -> pd.DataFrame:
    """One row for each text, compared with the one that follows it (after the last comes after); its last third gives way to
    the beginning of that text."""
    edited = []
    for t, nxt in zip(texts, [*texts[1:], after], strict=True):
        third = len(t) // 3
        edited.append(t[: len(t) - third] + nxt[:third])
    own, changed = fingerprints_of([*texts, after]), fingerprints_of(edited)
    return pd.DataFrame({
        "doc_id": pd.array(ids, "Int64"), "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
        "fingerprint": [x.written() for x in own[:-1]], "edited_fingerprint": [x.written() for x in changed],
        "near_edited": [likeness(x, y) for x, y in zip(own, changed)], "near_next": [likeness(x, y) for x, y in zip(own, own[1:])],
    })


def dealt(rows: DataFrame, firsts: list[tuple]) -> DataFrame:
    """rows (no_id, down, tie, text), texts compressed, by the part that each falls into: parts begin at firsts, in order. The
    first row of a part stands at the end of the part before as well, as the one after it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z = zstandard.ZstdCompressor(level=6)
        for batch in batches:
            keys = list(zip(batch["no_id"].tolist(), batch["down"].tolist(), batch["tie"].tolist(), strict=True))
            part = np.array([bisect_right(firsts, k) - 1 for k in keys], np.int32)
            head = np.array([k == firsts[p] for k, p in zip(keys, part.tolist(), strict=True)], bool)
            out = batch.assign(text=[z.compress(t.encode()) for t in batch["text"]], part=part, after=False)
            yield out
            yield out[head].assign(part=(part[head] - 1) % len(firsts), after=True)

    return rows.mapInPandas(run, "no_id boolean, down long, tie long, text binary, part int, after boolean")


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row for each row of docs, null texts as empty, compared with its edited text and with the next document.

    Documents follow one another by descending doc_id (nulls last; repeated ids by the text's hash), after the last comes the first.
    Their keys are ranged first, which gives the bounds of PARTS parts a shuffle partition; then every row goes to its part once,
    and there each text waits for its successor. An empty table gives no rows; other columns are ignored.
    """
    n = shuffle_partitions(docs.sparkSession)
    order = ["no_id", "down", "tie"]
    rows = docs.select(F.col("doc_id").isNull().alias("no_id"), F.bitwise_not(F.coalesce(F.col("doc_id").cast("long"), F.lit(0))).alias("down"), F.xxhash64(text_of()).alias("tie"), text_of().alias("text"))
    ranged = rows.select(*order).repartitionByRange(PARTS * n, *order).withColumn("part", F.spark_partition_id())
    firsts = sorted(tuple(r[0]) for r in ranged.groupBy("part").agg(F.min(F.struct(*order)).alias("first")).select("first").collect())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z = zstandard.ZstdDecompressor()
        ids, texts, size = [], [], 0
        for batch in batches:
            for no_id, down, packed, after in zip(batch["no_id"].tolist(), batch["down"].tolist(), batch["text"], batch["after"].tolist(), strict=True):
                if after and not ids:
                    continue  # equal rows begin the next part
                text = z.decompress(packed).decode()
                if after or size >= CHUNK_CHARS:
                    yield compared(ids, texts, text)
                    ids, texts, size = [], [], 0
                if not after:
                    ids.append(None if no_id else ~down)
                    texts.append(text)
                    size += len(text)

    return dealt(rows, firsts).repartition(n, "part").sortWithinPartitions("part", "after", *order).mapInPandas(run, ROW)
