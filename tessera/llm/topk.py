"""Exact top-k inner products with KD-trees.

Space is cut first: a KD-tree over a bounded sample of vectors gives cells by median splits, one for each ``SHARD`` rows and at
most ``CELLS``; every vector falls into one, and every cell has the tight box of all its vectors. A cell is dealt by hash into shards of about
``SHARD`` rows. Each shard builds one KD-tree: median splits by position (so that equal vectors split too) along the widest
side, with a tight bounding box in every node. A query descends best first: boxes wait on a heap by the largest inner
product that any point of the box could have, and the search ends when that is below the kth best score. The kth best score
propagates: a first pass asks one shard of the query's own cell; then the query goes to the cells whose box could beat its
kth score, and to no others.

The queries of a shard come in blocks of about ``BLOCK_BYTES``; a task holds one shard and one block, however many there are.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._common import stored

SCALE = 1024
SHARD, LEAF, BLOCK_BYTES = 2048, 64, 16_000_000
#: At most so many cells, for each of which the sample has ``PER_CELL`` vectors.
CELLS, PER_CELL = 4096, 16


class Tree:
    def __init__(self, ids: np.ndarray, points: np.ndarray) -> None:
        self.ids, self.points = ids.copy(), points.copy()
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.range: list[tuple[int, int]] = []
        self.kids: list[tuple[int, int] | None] = []
        self._grow(0, len(ids))
        self.box = np.stack([np.array(self.low), np.array(self.high)])

    def _grow(self, a: int, b: int) -> int:
        node = len(self.range)
        low, high = self.points[a:b].min(0), self.points[a:b].max(0)
        self.low.append(low)
        self.high.append(high)
        self.range.append((a, b))
        self.kids.append(None)
        if b - a > LEAF and (high > low).any():
            side, middle = int((high - low).argmax()), (b - a) // 2
            order = np.argpartition(self.points[a:b, side], middle)
            self.points[a:b], self.ids[a:b] = self.points[a:b][order], self.ids[a:b][order]
            self.kids[node] = (self._grow(a, a + middle), self._grow(a + middle, b))
        return node

    def best(self, query: np.ndarray, own: int, k: int, floor: float) -> list[tuple[float, int]]:
        """The k best (score, id), ties to the smaller id, without the query's own id; scores below ``floor`` may be left out."""
        # one look at all boxes: the largest product a point of each could have
        bound = (np.maximum(query * self.box[0], query * self.box[1])).sum(1)
        found: list[tuple[float, int]] = []  # a heap with the worst first: (score, -id)
        open_ = [(-bound[0], 0)]
        while open_:
            b, node = heapq.heappop(open_)
            if -b < floor:
                break
            if self.kids[node]:
                for kid in self.kids[node]:
                    if bound[kid] >= floor:
                        heapq.heappush(open_, (-bound[kid], kid))
                continue
            a, z = self.range[node]
            scores = self.points[a:z] @ query
            for i in np.flatnonzero(scores >= floor).tolist():
                if (x := int(self.ids[a + i])) != own:
                    entry = (float(scores[i]), -x)
                    if len(found) < k:
                        heapq.heappush(found, entry)
                    elif entry > found[0]:
                        heapq.heapreplace(found, entry)
            if len(found) == k:
                floor = max(floor, found[0][0])
        return [(s, -i) for s, i in found]


class Cells:
    """Median splits of a sample down to ``count`` cells; vectors of another length than the sample's all have cell 0."""

    def __init__(self, sample: np.ndarray, count: int) -> None:
        self.width = sample.shape[1] if sample.ndim == 2 else 0
        self.cells = 0
        self.root = self._grow(sample, count) if len(sample) else self._leaf()

    def _leaf(self) -> int:
        self.cells += 1
        return self.cells - 1

    def _grow(self, points: np.ndarray, count: int):
        if count < 2 or len(points) < 2 or not points.shape[1]:
            return self._leaf()
        side = int((points.max(0) - points.min(0)).argmax())
        at = float(np.median(points[:, side]))
        left = points[:, side] < at
        if not left.any():
            return self._leaf()
        return (side, at, self._grow(points[left], count // 2), self._grow(points[~left], count - count // 2))

    def of(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int32)
        todo = [(self.root, np.arange(len(points)))] if points.shape[1] == self.width else []
        while todo:
            node, rows = todo.pop()
            if not isinstance(node, tuple):
                out[rows] = node
                continue
            left = points[rows, node[0]] < node[1]
            todo += [(node[2], rows[left]), (node[3], rows[~left])]
        return out


def in_widths(vectors: list) -> list[np.ndarray]:
    """Row numbers by length of vector."""
    width = np.array([len(v) for v in vectors])
    return [np.flatnonzero(width == w) for w in np.unique(width)]


ANSWER = "query_id long, row long, vec_id long, score long"


def _ask(k: int):
    def run(key, shard: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(shard) and len(queries):
            tree = Tree(shard["vec_id"].to_numpy(np.int64), np.stack(shard["v"].to_numpy()).astype(np.float64))
            for row, q, v, floor in zip(queries["row"].tolist(), queries["vec_id"].tolist(), queries["v"], queries["floor"].tolist(), strict=True):
                out += [(q, row, i, int(s)) for s, i in tree.best(np.asarray(v, np.float64), q, k, floor)]
        return pd.DataFrame(out, columns=["query_id", "row", "vec_id", "score"])

    return run


def best_of(rows: DataFrame, k: int, by: str = "query_id") -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.col("score").desc(), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


PLACE = ["width", "cell", "salt"]


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each id of a query row its k best rows of other ids by inner product of the
    components floor(1024 * x), ties to the smaller vec_id.

    Vectors that are null or hold null or non-finite components take no part, nor do rows without an id. Only vectors of one
    length are compared; those without components score 0. Every other row counts, also those that share an id; of an id with several query rows the best over
    all of them are given. Scores are exact while they stay below 2^53. Other columns are ignored.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    sound = F.col(vector).isNotNull() & F.forall(vector, lambda x: F.coalesce(finite(x), F.lit(False)))
    rows = vectors.select("vec_id", F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("double")).alias("v"), is_query.alias("asks"), sound.alias("sound")).filter("sound and vec_id is not null")
    rows = stored(rows.select("vec_id", "v", F.coalesce("asks", F.lit(False)).alias("asks"), F.size("v").alias("width"), F.monotonically_increasing_id().alias("row")), "vectors")
    n = rows.agg(F.count("*").alias("n"), F.mode("width").alias("width")).first()
    if not n.n:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score"))
    count = min(CELLS, max(1, n.n // SHARD))
    sample = rows.filter(F.col("width") == n.width).orderBy(F.xxhash64("row")).limit(count * PER_CELL).select("v").collect()
    cells = rows.sparkSession.sparkContext.broadcast(Cells(np.array([r.v for r in sample]), count))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in in_widths(batch["v"].tolist()):
                some = batch.iloc[at]
                yield some.assign(cell=cells.value.of(np.stack(some["v"].to_numpy())))

    placed = rows.mapInPandas(place, "vec_id long, v array<double>, asks boolean, width int, row long, cell int")
    placed = stored(placed, "cells")
    box = F.posexplode("v").alias("i", "x")
    sizes = placed.groupBy("width", "cell").agg(F.count("*").alias("n"))
    boxes = placed.select("width", "cell", box).groupBy("width", "cell", "i").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    side = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("i", c))), lambda x: x[c]).alias(c)
    # vectors without components have an empty box
    none = F.array().cast("array<double>")
    boxes = sizes.join(boxes.groupBy("width", "cell").agg(side("low"), side("high")), ["width", "cell"], "left").withColumns({c: F.coalesce(c, none) for c in ("low", "high")})
    # one row for each of at most CELLS cells, and one for each other length
    boxes = stored(boxes.select("width", "cell", "low", "high", F.ceil(F.col("n") / SHARD).cast("int").alias("salts")), "boxes")
    placed = placed.join(boxes.select("width", "cell", "salts"), ["width", "cell"]).withColumn("salt", F.pmod(F.xxhash64("row"), F.col("salts")).cast("int")).drop("salts")
    shards = placed.select(*PLACE, "vec_id", "v")
    asks = placed.filter("asks").select(*PLACE, "row", "vec_id", "v")

    def meet(queries: DataFrame) -> DataFrame:
        """queries stand at the shards that they ask."""
        blocks = F.ceil(F.count("*") * F.first("width") * 8 / BLOCK_BYTES).cast("int")
        asked = stored(queries, "topk-asked")
        per = stored(asked.groupBy(*PLACE).agg(F.greatest(blocks, F.lit(1)).alias("blocks")), "topk-blocks")
        asked = asked.join(per, PLACE).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")).drop("blocks")
        copies = shards.join(per.withColumnRenamed("blocks", "of"), PLACE).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("of") - 1))).drop("of")
        return copies.groupBy(*PLACE, "block").cogroup(asked.groupBy(*PLACE, "block")).applyInPandas(_ask(k), ANSWER)

    first = stored(meet(asks.withColumn("floor", F.lit(float("-inf")))), "topk-home")
    kth = first.groupBy("row").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("floor"))
    waiting = asks.withColumnsRenamed({"cell": "home", "salt": "own"}).join(kth, "row", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    lists = boxes.orderBy("width", "cell").collect()
    known = rows.sparkSession.sparkContext.broadcast({w: ([r.cell for r in lists if r.width == w], np.array([r.low for r in lists if r.width == w]), np.array([r.high for r in lists if r.width == w])) for w in {r.width for r in lists}})

    def onward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in in_widths(batch["v"].tolist()):
                some = batch.iloc[at].reset_index(drop=True)
                names, low, high = known.value[int(some["width"].iloc[0])]
                v, floor = np.stack(some["v"].to_numpy()), some["floor"].to_numpy()
                for c, name in enumerate(names):
                    may = np.flatnonzero(np.maximum(v * low[c], v * high[c]).sum(1) >= floor)
                    yield some.iloc[may].assign(cell=np.int32(name))

    kinds = "row long, width int, home int, own int, vec_id long, v array<double>, floor double, cell int"
    rest = waiting.select("row", "width", "home", "own", "vec_id", "v", "floor").mapInPandas(onward, kinds)
    rest = rest.join(F.broadcast(boxes.select("width", "cell", "salts")), ["width", "cell"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    rest = rest.filter("cell <> home or salt <> own").select(*PLACE, "row", "vec_id", "v", "floor")
    return best_of(first.unionByName(meet(rest)).drop("row"), k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
