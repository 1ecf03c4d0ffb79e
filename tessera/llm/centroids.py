"""Centroid clustering of integer vectors, filtered by n-simplex projection.

A few pivots span a simplex whose vertices have coordinates of a triangular form. A vector's distances to the pivots are computed
once and turned into the coordinates of its apex above that simplex: as many numbers as pivots, the last one its height. The
Euclidean distance of two apexes is a lower bound of the distance of their vectors, and that to the apex mirrored below the base an
upper bound. Each round compares the centroids' apexes with the cached one, and only centroids whose lower bound doesn't exceed the
least upper bound meet the whole vector, in exact integers.

The gap of the bounds is four times the product of the two heights, so pivots should span a plane near which later centroids lie:
they are the centroids at the start and those that the same rounds give on ``SAMPLE`` vectors. Any pivots give the same result.

A round is one pass: tasks assign their vectors and return one partial sum a centroid, Spark adds these, and the driver gets the
sums of at most ``k`` centroids. Vectors stay in a written table with their apexes, so that a lost executor repeats a part of one
pass only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import stored

#: Vectors, chosen by a hash of their ids, from which pivots come; bounds what the driver holds and nothing else.
SAMPLE = 8192
#: Share of the squared magnitudes by which bounds may be off through rounding.
SLACK = 1e-7
ROWS = 4096


class Simplex:
    """Vertices of pivots in triangular form, one coordinate more from each to the next."""

    def __init__(self, candidates: np.ndarray, count: int) -> None:
        """Takes the candidate that stands highest above the simplex so far, until none is clearly off its plane."""
        self.pivots = candidates[:1]
        self.base = np.zeros((len(self.pivots), max(0, len(self.pivots) - 1)))
        while 0 < len(self.pivots) < count:
            apexes = self.apexes(candidates)
            top = int(apexes[:, -1].argmax())
            if apexes[top, -1] <= 0.05 * np.sqrt(1 + (apexes**2).sum(1).max()):
                break
            self.pivots = np.concatenate([self.pivots, candidates[top : top + 1]])
            self.base = np.concatenate([np.pad(self.base, ((0, 0), (0, 1))), apexes[top : top + 1]])

    def apexes(self, points: np.ndarray) -> np.ndarray:
        """Coordinates above the base from the distances to its vertices; the last is not negative."""
        d = np.stack([((points - p) ** 2).sum(1) for p in self.pivots], 1).astype(np.float64)
        out = np.zeros((len(points), len(self.pivots)))
        for i in range(1, len(self.pivots)):
            known = self.base[i]
            out[:, i - 1] = ((known**2).sum() + d[:, 0] - d[:, i] - 2 * out[:, : i - 1] @ known[: i - 1]) / (2 * known[i - 1])
        out[:, -1] = np.sqrt(np.maximum(0, d[:, 0] - (out[:, :-1] ** 2).sum(1)))
        return out


def pilot(sample: np.ndarray, centroids: np.ndarray, rounds: int) -> np.ndarray:
    """The rounds on a sample in the driver."""
    for _ in range(rounds):
        number = ((centroids**2).sum(1) - 2 * sample @ centroids.T).argmin(1)
        own = [sample[number == c] for c in range(len(centroids))]
        centroids = np.array([x.sum(0) // len(x) if len(x) else old for x, old in zip(own, centroids, strict=True)])
    return centroids


def nearest(points: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, tops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number, squared distance) of each point's nearest centroid, ties to the smaller number; how many were compared exactly."""
    flat = ((apexes[:, None, :-1] - tops[None, :, :-1]) ** 2).sum(2)
    low, high = flat + (apexes[:, None, -1] - tops[None, :, -1]) ** 2, flat + (apexes[:, None, -1] + tops[None, :, -1]) ** 2
    slack = 1 + SLACK * ((apexes**2).sum(1) + (tops**2).sum(1).max())
    may = low <= (high.min(1) + slack)[:, None]
    at, c = np.nonzero(may)
    exact = np.full(may.shape, np.iinfo(np.int64).max)
    exact[at, c] = ((points[at] - centroids[c]) ** 2).sum(1)
    number = exact.argmin(1)
    return number, exact[np.arange(len(points)), number], may.sum(1)


def matrix(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def kept(vectors: DataFrame, vector: str, size: int, scale: int) -> DataFrame:
    finite = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    sound = (F.size(vector) == size) & F.forall(vector, finite)
    return vectors.select("vec_id", F.when(sound, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))).alias("v")).filter("v is not null")


def firsts(rows: DataFrame, salt: str, n: int) -> np.ndarray:
    """The vectors of the n rows with the smallest hashes of their ids, rows of one id by their components."""
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    got = rows.filter("vec_id is not null").orderBy(key, "v").limit(n).select("v").collect()
    return np.array([r.v for r in got], np.int64)


def clustered(vectors: DataFrame, k: int = 16, rounds: int = 3, vector: str = "embedding", size: int = 64, scale: int = 64, salt: str = "1") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, compared) for every vector of ``size`` components, none
    of them null or non-finite, as integers floor(scale * x). Other rows are left out.

    Centroids start as the k vectors with the smallest hashes of ``salt:vec_id`` (all, if fewer; of rows that share an id each
    counts, by components). Rows without an id are clustered but start no centroid; where no row has an id, cluster and all that
    follows is null. Equal distances go to the smaller number, and a centroid without vectors stays. ``compared`` says how many
    centroids were compared exactly. Distances are exact while components stay below 2^28 in magnitude.
    """
    rows = kept(vectors, vector, size, scale)
    centroids = firsts(rows, salt, k)
    if not len(centroids):
        none = {"cluster": "int", "distance": "long", "cluster_inertia": "long", "inertia": "long", "centroid_sha256": "string", "compared": "int"}
        return rows.select("vec_id", *(F.lit(None).cast(kind).alias(c) for c, kind in none.items()))
    simplex = Simplex(np.concatenate([centroids, pilot(firsts(rows, "pivot", SAMPLE), centroids, rounds)]), 2 * k)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in (batch.slice(at, ROWS) for at in range(0, batch.num_rows, ROWS)):
                apexes = simplex.apexes(matrix(some["v"], some.num_rows))
                width = np.arange(some.num_rows + 1, dtype=np.int32) * apexes.shape[1]
                yield pa.RecordBatch.from_arrays([some["vec_id"], some["v"], pa.ListArray.from_arrays(pa.array(width), pa.array(apexes.ravel()))], ["vec_id", "v", "apex"])

    ids = vectors.schema["vec_id"].dataType.simpleString()
    rows = stored(rows.mapInArrow(project, f"vec_id {ids}, v array<bigint>, apex array<double>"), "apexes")

    def of(some: pa.RecordBatch, centroids: np.ndarray, tops: np.ndarray):
        points = matrix(some["v"], some.num_rows)
        return points, *nearest(points, matrix(some["apex"], some.num_rows), centroids, tops)

    def sums(centroids: np.ndarray, tops: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
            for batch in batches:
                for some in (batch.slice(at, ROWS) for at in range(0, batch.num_rows, ROWS)):
                    points, number, _, _ = of(some, centroids, tops)
                    count += np.bincount(number, minlength=len(centroids))
                    np.add.at(total, number, points)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(count), dtype=np.int32)), pa.array(count), pa.array(total.tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

        return run

    for _ in range(rounds):
        partial = rows.select("v", "apex").mapInArrow(sums(centroids, simplex.apexes(centroids)), "cluster int, n long, total array<bigint>").filter("n > 0")
        # at most k times size rows, each the sum of one partial row a task
        added = partial.select("cluster", "n", F.posexplode("total").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
        centroids = centroids.copy()
        for r in added.collect():
            centroids[r.cluster, r.i] = int(r.x) // r.n
    tops = simplex.apexes(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in (batch.slice(at, ROWS) for at in range(0, batch.num_rows, ROWS)):
                _, number, distance, compared = of(some, centroids, tops)
                yield pa.RecordBatch.from_arrays([some["vec_id"], pa.array(number.astype(np.int32)), pa.array(distance), pa.array(compared.astype(np.int32))], ["vec_id", "cluster", "distance", "compared"])

    out = stored(rows.mapInArrow(assign, f"vec_id {ids}, cluster int, distance long, compared int"), "assigned")
    inertia = {r.cluster: r.total for r in out.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    named = {c: hashlib.sha256(",".join(map(str, v.tolist())).encode()).hexdigest() for c, v in enumerate(centroids)}
    of_cluster = lambda values, kind: F.element_at(F.create_map(*(F.lit(x).cast(t) for c, v in values.items() for x, t in ((c, "int"), (v, kind)))), F.col("cluster")) if values else F.lit(None).cast(kind)
    columns: list[Column | str] = ["vec_id", "cluster", "distance", of_cluster(inertia, "long").alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"), of_cluster(named, "string").alias("centroid_sha256"), "compared"]
    return out.select(*columns)


def _oracle(rounds: int) -> str:
    near = "SELECT r, min(row(list_sum(list_transform(list_zip(v.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), c)) AS x FROM v, c{0} c GROUP BY r"
    mean = """SELECT c.c, coalesce(any_value(m.v), any_value(c.v)) AS v FROM c{0} c LEFT JOIN
 (SELECT c, list(x ORDER BY i) AS v FROM (SELECT c, i, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS x
  FROM (SELECT a.x[2] AS c, unnest(v.v) AS x, generate_subscripts(v.v, 1) AS i FROM a{0} a JOIN v USING (r)) GROUP BY c, i) GROUP BY c) m ON m.c = c.c GROUP BY c.c"""
    steps = "".join(f",\na{i} AS ({near.format(i)}),\nc{i + 1} AS ({mean.format(i)})" for i in range(rounds))
    return f"""WITH v AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v FROM v WHERE vec_id IS NOT NULL ORDER BY c LIMIT 16){steps},
z AS ({near.format(rounds)}),
t AS (SELECT vec_id, CAST(z.x[2] AS INT) AS cluster, CAST(z.x[1] AS BIGINT) AS distance FROM z JOIN v USING (r))
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
 sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM t JOIN c{rounds} c ON c.c = t.cluster"""


ORACLE = _oracle(3)
