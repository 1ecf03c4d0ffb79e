"""SimHash near-duplicates: 64-bit fingerprints compared as vertical bit planes.

Fingerprints within ``RADIUS`` bits of each other link. Two such fingerprints agree on at least two of five bit blocks
(three differing bits spoil three blocks at most), so every pair meets in one of the ten tables keyed by two blocks.
Inside a table's bucket the comparison is bit-sliced: lane i holds the pair (i, i + j), one machine-wide integer holds one
bit plane of all lanes, carry-save counters add the 64 difference planes, and a block of lanes is abandoned once every lane
exceeds the radius. Only a spanning forest of the links leaves a bucket.

Exact copies collapse into one fingerprint before any comparison. A bucket above ``CHUNK`` fingerprints is cut again: pairs within
the radius agree on two of five blocks of the bits that are left, too, so that ten smaller tables stand for the bucket. What is
above ``CHUNK`` even then is split into chunk pairs that are compared in separate tasks. No task holds an unbounded bucket and no
pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import keyed, one_of_each, stored

RADIUS = 3
SHINGLE = 3
SEED = 42
CHUNK = 256
LANES = 2048


def majority(hashes: np.ndarray) -> np.uint64:
    """The bits set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0]


def simhash(text: str, size: int = SHINGLE) -> int:
    """Unsigned fingerprint of one text; 0 for a text without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        hashes = np.array([digest(joined, SEED)], dtype=np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[: -size] + 1)).tolist()
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)], dtype=np.uint64)
    return int(majority(hashes))


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, kd, tk, fp): fp is the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash(t, size) for t in texts], dtype=np.uint64).view(np.int64))

    return keyed(docs).select("doc_id", "kd", "tk", fp("text").alias("fp"))


class Forest:
    """Union by smallest position, kept flat enough for vectorised filtering."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, left: np.ndarray, right: np.ndarray) -> None:
        self.flatten()
        differ = self.up[left] != self.up[right]
        for a, b in zip(left[differ].tolist(), right[differ].tolist(), strict=True):
            x, y = self.root(a), self.root(b)
            if x != y:
                self.up[max(x, y)] = min(x, y)

    def flatten(self) -> None:
        while not np.array_equal(self.up[self.up], self.up):
            self.up = self.up[self.up]


def as_plane(bits: np.ndarray) -> int:
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def close_pairs(fps: np.ndarray, run: np.ndarray, side: np.ndarray, radius: int = RADIUS) -> Forest:
    """Spanning forest over positions of one block: equal ``run`` (sorted) and within ``radius`` bits. A pair counts only
    when one of its members has another ``side``, or when side is -1."""
    n, forest = len(fps), Forest(len(fps))
    planes = [as_plane((fps >> np.uint64(b)) & np.uint64(1) == 1) for b in range(64)]
    for j in range(1, n):
        same = run[:-j] == run[j:]
        if not same.any():
            break
        pair = same & ((side[:-j] != side[j:]) | (side[:-j] < 0))
        if not pair.any():
            continue
        lanes = as_plane(pair)
        counters, over = [0] * radius.bit_length(), 0
        for plane in planes:
            carry = plane ^ (plane >> j)
            for k, counter in enumerate(counters):
                counters[k], carry = counter ^ carry, counter & carry
            over |= carry
            if radius + 1 != 1 << radius.bit_length():
                over |= _above(counters, radius)
            if over & lanes == lanes:
                break
        hits = lanes & ~over
        if hits:
            at = np.flatnonzero(np.unpackbits(np.frombuffer(hits.to_bytes((n + 7) // 8, "little"), np.uint8), bitorder="little"))
            forest.join(at, at + j)
    forest.flatten()
    return forest


def _above(counters: list[int], radius: int) -> int:
    """Lanes whose counter exceeds a radius that isn't one below a power of two."""
    equal, above = -1, 0
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            above |= equal & counters[k]
            equal &= ~counters[k]
    return above


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows arrive sorted by bucket; buckets are compared in blocks of about LANES rows, and one may span batches."""

    def compared(rows: pd.DataFrame, run: np.ndarray) -> pd.DataFrame:
        fps = rows["fp"].to_numpy(np.int64)
        root = close_pairs(fps.view(np.uint64), run, rows["side"].to_numpy(np.int64)).up
        linked = root != np.arange(len(fps))
        return pd.DataFrame({"src": fps[linked], "dst": fps[root[linked]]})

    rest: pd.DataFrame | None = None
    keys = GROUP
    for rows in batches:
        rows = rows if rest is None else pd.concat([rest, rows], ignore_index=True)
        k = rows[keys].to_numpy(np.int64)
        run = np.concatenate(([0], np.cumsum((k[1:] != k[:-1]).any(1)))) if len(k) else np.zeros(0, int)
        begins = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1]))) if len(k) else np.zeros(0, int)
        at = 0
        for nxt in begins[1:]:
            if nxt - at >= LANES or nxt == begins[-1]:
                yield compared(rows.iloc[at:nxt], run[at:nxt])
                at = nxt
        rest = rows.iloc[at:].reset_index(drop=True)
    if rest is not None and len(rest):
        yield compared(rest, np.concatenate(([0], np.cumsum((rest[keys].to_numpy(np.int64)[1:] != rest[keys].to_numpy(np.int64)[:-1]).any(1)))))


GROUP = ["t", "key", "t2", "key2", "a", "b"]


def pair_masks(bits: list[int]) -> list[int]:
    """Masks of each two of five blocks of the given bit positions."""
    sizes = [len(bits) // 5 + (i < len(bits) % 5) for i in range(5)]
    at = [sum(sizes[:i]) for i in range(6)]
    blocks = [sum(1 << b for b in bits[at[i] : at[i + 1]]) for i in range(5)]
    return [blocks[i] | blocks[j] for i, j in combinations(range(5), 2)]


def links(fps: DataFrame) -> DataFrame:
    """fps: distinct ``fp``. Returns (src, dst) pairs within RADIUS bits that connect all that such pairs connect."""
    signed = lambda x: F.lit(x - (1 << 64) if x >> 63 else x)
    masks = pair_masks(list(range(64)))
    finer = [pair_masks([b for b in range(64) if not m >> b & 1]) for m in masks]
    first = F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(signed(m)).alias("key"), F.array(*map(signed, finer[t])).alias("finer")) for t, m in enumerate(masks)))
    rows = fps.select("fp", F.explode(first).alias("x")).select("fp", "x.t", "x.key", "x.finer")
    size = lambda rows, keys: rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    rows = rows.join(size(rows, ["t", "key"]), ["t", "key"])
    again = F.when(F.col("n") > CHUNK, F.transform("finer", lambda m, i: F.struct(i.alias("t2"), F.col("fp").bitwiseAND(m).alias("key2"))))
    whole = F.array(F.struct(F.lit(-1).alias("t2"), F.lit(0).cast("long").alias("key2")))
    rows = stored(rows.select("t", "key", "fp", F.explode(F.coalesce(again, whole)).alias("x")).select("t", "key", "fp", "x.t2", "x.key2"), "simhash-tables")
    keys = ["t", "key", "t2", "key2"]
    rows = rows.join(size(rows, keys).withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int")).drop("n"), keys).withColumn("c", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select(*keys, "fp", F.least("c", "o").alias("a"), F.greatest("c", "o").alias("b"), F.when(F.col("chunks") == 1, -1).otherwise(F.col("c")).alias("side"))
    # inside a chunk every pair counts: the group (c, c) holds that chunk alone
    rows = rows.withColumn("side", F.when(F.col("a") == F.col("b"), -1).otherwise(F.col("side")))
    return rows.repartition(*GROUP).sortWithinPartitions(*GROUP, "fp").mapInPandas(_links, "src long, dst long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (src, dst): label is the smallest node reachable. Each round takes the least
    label among neighbours and then follows it once more, so the number of rounds grows with the logarithm of a path."""
    both = stored(edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "edges")
    labels = stored(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.col("node")).alias("label")), "labels")
    while True:
        heard = both.join(labels.withColumnsRenamed({"node": "src", "label": "l"}), "src").groupBy(F.col("dst").alias("node")).agg(F.min("l").alias("l"))
        near = labels.join(heard, "node").select("node", F.col("label").alias("old"), F.least("label", "l").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        new = stored(near.join(jump, "mid").select("node", F.least("mid", "far").alias("label"), (F.least("mid", "far") != F.col("old")).alias("moved")), "labels")
        labels = new.select("node", "label")
        if not new.filter("moved").limit(1).count():
            return labels


def classed(own: DataFrame) -> DataFrame:
    """(fp, label) of every fingerprint of own (fp): label is the least one reachable."""
    fps = stored(own.select("fp").distinct(), "simhash-distinct")
    label = components(links(fps)).withColumnRenamed("node", "fp")
    return fps.join(label, "fp", "left").withColumn("label", F.coalesce("label", "fp"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    Null or empty texts have fingerprint zero and link like any other; repeated rows are returned as often as they occur;
    a component whose ids are all null has a null component_id; other columns are ignored.
    """
    own = stored(fingerprints(docs).select("doc_id", "fp"), "simhash")
    fps = own.groupBy("fp").agg(F.min("doc_id").alias("least")).join(classed(own), "fp")
    least = fps.groupBy("label").agg(F.min("least").alias("component_id"))
    by_fp = fps.select("fp", "label").join(least, "label").select("fp", "component_id")
    return own.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one row of each component, the one of the smallest doc_id (rows without one come last, rows that share one by
    their text's hash)."""
    own = stored(fingerprints(docs), "simhash")
    return one_of_each(docs, own.join(classed(own), "fp").select("kd", "tk", "label"))
