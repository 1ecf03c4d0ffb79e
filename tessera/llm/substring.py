"""Removal of long repeated passages: seed on winnowed anchors, extend to whole windows, keep what is covered.

Seed: every run of ``SEED_WORDS`` words is hashed and winnowed, so that each window of ``WINDOW`` words holds at least one
anchor and equal windows hold equal anchors. Anchors that occur once in the corpus can't lie in a repeated window and go.
Extend: around each remaining anchor the windows that contain it, up to its text's ends, are gathered in blocks of
consecutive windows that end where a window's own hash says so, hence alike in all copies. Equal blocks are repeated as a
whole and only one of them goes on with its words; its windows and those of blocks that occur once are then counted one by
one. Blocks and windows are told apart by 128 bits: among n different windows two share them with probability
n^2 / 2^129. The union of repeated windows is the union of the maximal repeats of at least ``WINDOW`` words. A passage with
thousands of copies costs a row a copy for each block, never one a pair, and its windows are counted once.

Texts travel compressed: each is packed once, before the shuffle that brings its anchors or windows to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import keyed, stored
from tessera.llm.words import SEQUENCE, U, Powers, Words, chunks, packed, sliding_min

WINDOW = 35
SEED_WORDS = 12
CHECK = Powers(0xC2B2AE3D27D4EB4F)
KEY = ["kd", "tk"]
PLACE = U((1 << 28) - 1)
BLOCK = 64
CHUNK = 500_000


def anchors_of(words: Words, seed: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the winnowed runs: of each ``window - seed + 1`` runs in a row, a least one."""
    n = len(words.hash)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, U)
    first = np.arange(n - seed + 1)
    hashes = SEQUENCE.ranges(words.hash, first, first + seed)
    # the low bits hold the position: the minimum tells where it lies, and of equal runs the leftmost wins, so that two equal
    # windows that overlap (a passage with a short period) still have an anchor each
    marked = (hashes & ~PLACE) | first.astype(U)
    width = window - seed + 1
    least = sliding_min(marked, width)
    least = least[np.arange(len(least)) + window <= words.bounds[words.text[: len(least)] + 1]]
    at = np.unique((least & PLACE).astype(np.int64))
    return at, hashes[at]


def anchors(rows: DataFrame, seed: int = SEED_WORDS, window: int = WINDOW) -> DataFrame:
    """(kd, tk, pos, hash) of every anchor."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t.encode() for t in batch["text"]]
            kd, tk = batch["kd"].to_numpy(), batch["tk"].to_numpy()
            for begin, part in chunks(texts, CHUNK):
                w = Words(part)
                at, h = anchors_of(w, seed, window)
                text = w.text[at]
                yield pd.DataFrame({"kd": kd[begin + text], "tk": tk[begin + text], "pos": at - w.bounds[text], "hash": h.view(np.int64)})

    return rows.select("kd", "tk", "text").mapInPandas(run, "kd long, tk long, pos int, hash long")


def repeated_windows(docs: DataFrame, seed: int = SEED_WORDS, window: int = WINDOW) -> DataFrame:
    """(kd, tk, begins, lengths): for each text that has any, its runs of consecutive repeated windows, by the first window
    and how many."""
    rows = keyed(docs)
    found = stored(anchors(rows, seed, window), "anchors")
    # written first: a join of two plain tables lets Spark split a hash that a third of all anchors share
    again = stored(found.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash"), "seeds")
    seeds = found.join(again, "hash").groupBy(*KEY).agg(F.collect_set("pos").alias("seeds"))

    def extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            texts = [z.decompress(t) for t in batch["text"]]
            kd, tk, seeds = batch["kd"].to_numpy(), batch["tk"].to_numpy(), batch["seeds"].tolist()
            for begin, part in chunks(texts, CHUNK):
                w = Words(part)
                at = np.concatenate([np.asarray(s, np.int64) + w.bounds[i] for i, s in enumerate(seeds[begin : begin + len(part)])])
                mark = np.zeros(len(w.hash) + 2, np.int64)  # windows that hold a seed begin window - seed words before it or later
                text = w.text[at]
                np.add.at(mark, np.maximum(at - (window - seed), w.bounds[text]), 1)
                np.add.at(mark, at + 1, -1)
                first = np.flatnonzero(np.cumsum(mark)[: len(w.hash)] > 0)
                first = first[first + window <= w.bounds[w.text[first] + 1]]
                text = w.text[first]
                h = SEQUENCE.ranges(w.hash, first, first + window)
                # a block ends where the windows aren't consecutive, and at windows whose own hash says so
                starts = np.ones(len(first), bool)
                starts[1:] = (np.diff(first) != 1) | (np.diff(text) != 0) | (h[1:] % U(BLOCK) == 0)
                lo = np.flatnonzero(starts)
                hi = np.append(lo[1:], len(first)) if len(lo) else lo
                yield pd.DataFrame({
                    "kd": kd[begin + text[lo]], "tk": tk[begin + text[lo]], "pos": first[lo] - w.bounds[text[lo]], "n": hi - lo,
                    "b": SEQUENCE.ranges(h, lo, hi).view(np.int64), "c": CHECK.ranges(CHECK.ranges(w.hash, first, first + window), lo, hi).view(np.int64),
                    "words": [w.data[x:y] for x, y in zip(w.start[first[lo]].tolist(), w.end[first[hi - 1] + window - 1].tolist(), strict=True)],
                })

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for begin, part in chunks(batch["words"].tolist(), CHUNK):
                w = Words(part)
                first = np.flatnonzero(np.arange(len(w.hash)) + window <= w.bounds[w.text + 1])
                row = begin + w.text[first]
                some = {c: batch[c].to_numpy()[row] for c in ("known", "kd", "tk")}
                yield pd.DataFrame({
                    **some, "pos": batch["pos"].to_numpy()[row] + first - w.bounds[w.text[first]],
                    "h": SEQUENCE.ranges(w.hash, first, first + window).view(np.int64), "g": CHECK.ranges(w.hash, first, first + window).view(np.int64),
                })

    blocks = packed(rows.select(*KEY, "text")).join(seeds, KEY).mapInPandas(extend, "kd long, tk long, pos int, n int, b long, c long, words binary")
    blocks = stored(blocks, "blocks")
    different = blocks.groupBy("b", "c").agg(F.count("*").alias("times"), F.first("words").alias("words"), F.min(F.struct("kd", "tk", "pos")).alias("one"))
    # written first, as the repeated windows below: Spark can split what a join of two plain tables gathers on one key
    different = stored(different.select("b", "c", (F.col("times") > 1).alias("known"), "one.*", "words"), "different")
    single = different.select("known", "kd", "tk", "pos", "words").mapInPandas(windows, "known boolean, kd long, tk long, pos int, h long, g long")
    # a window is repeated if its block is, or if it lies in two different blocks
    repeated = stored(single.groupBy("h", "g").agg(F.count("*").alias("n"), F.bool_or("known").alias("known")).filter("n > 1 or known").select("h", "g"), "repeated")
    alone = single.filter("not known").join(repeated, ["h", "g"]).select("kd", "tk", "pos", F.lit(1).alias("n"))
    whole = blocks.select("kd", "tk", "pos", "n", "b", "c").join(different.filter("known").select("b", "c"), ["b", "c"]).select("kd", "tk", "pos", "n")
    runs = whole.unionByName(alone).groupBy(*KEY).agg(F.collect_set(F.struct("pos", "n")).alias("runs"))
    return runs.select(*KEY, F.transform("runs", lambda r: r["pos"]).alias("begins"), F.transform("runs", lambda r: r["n"]).alias("lengths"))


def without_repeats(docs: DataFrame, seed: int = SEED_WORDS, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, removed) for every row of docs: ``kept`` is the text that stays, its words joined
    by one space, ``removed`` the covered word ranges as [start, end) pairs, flattened.

    Null and empty texts have no words. Repeated rows count as separate places, so all windows of such texts repeat.
    Texts of fewer than ``window`` words lose nothing. Other columns are ignored.
    """
    windows = repeated_windows(docs, seed, window)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for doc_id, text, starts, lengths in zip(batch["doc_id"], batch["text"], batch["begins"], batch["lengths"], strict=True):
                parts, spans = z.decompress(text).split(), []
                n = len(parts)
                if starts is not None and len(starts):
                    s = np.asarray(starts, np.int64)
                    order = np.argsort(s, kind="stable")
                    s, e = s[order], np.maximum.accumulate((s + np.asarray(lengths, np.int64))[order] - 1 + window)
                    apart = np.flatnonzero(s[1:] > e[:-1]) + 1
                    lo, hi = s[np.concatenate(([0], apart))], e[np.concatenate((apart - 1, [len(s) - 1]))]
                    spans = np.stack([lo, hi], 1).ravel().tolist()
                    for a, b in zip(lo[::-1].tolist(), hi[::-1].tolist(), strict=True):
                        del parts[a:b]
                out.append((None if pd.isna(doc_id) else int(doc_id), n, n - len(parts), b" ".join(parts).decode(), spans))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept", "removed"]).astype({"doc_id": "Int64"})

    rows = packed(keyed(docs)).join(windows, KEY, "left").select("doc_id", "text", "begins", "lengths")
    return rows.mapInPandas(cut, "doc_id long, n_words long, n_removed long, kept string, removed array<long>")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i, len(w) AS n FROM d),
v AS (SELECT r, i, n, word, CASE WHEN i + 34 <= n THEN string_agg(word, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) END AS run FROM x),
t AS (SELECT md5(run) AS h FROM v WHERE run IS NOT NULL GROUP BY ALL HAVING count(*) > 1),
m AS (SELECT v.r, v.i, v.word, t.h IS NOT NULL AS again FROM v LEFT JOIN t ON md5(v.run) = t.h),
c AS (SELECT r, i, word, max(again) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM m),
k AS (SELECT r, count_if(gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM c GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""
