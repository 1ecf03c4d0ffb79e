"""Points in integer microdegrees: radius joins by grid cells, nearest neighbours, clusters and georeferencing."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.geo import LAT, LNG, metres
from tessera.operators.records import checkpointed, mutual_best


#: ids of one place that a row holds at most
HELD = 1000


def located(df: DataFrame) -> DataFrame:
    return df.filter("lat is not null and lng is not null")


def met(a: DataFrame, b: DataFrame, radius: int, spread: str = "a", keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of rows of a (alat, alng) and b (blat, blng) of equal ``keys`` that are at most ``radius`` metres apart, and those
    metres. Distances are rounded, so two cells span the radius and half a metre: partners lie in the 25 cells around, over which
    the side ``spread``, the smaller one, is spread. Cells are dealt by number, as few rows may make many pairs."""
    h, w = int((radius + 0.5) / LAT / 2) + 1, int((radius + 0.5) / LNG / 2) + 1
    step = F.array(*map(F.lit, range(-2, 3)))

    def celled(df: DataFrame, side: str) -> DataFrame:
        cy, cx = (F.floor(F.col(side + c) / F.lit(size)).cast("long") for c, size in (("lat", h), ("lng", w)))
        df = df.withColumns({"cy": cy, "cx": cx})
        if side != spread:
            return df
        df = df.withColumn("i", F.explode(step)).withColumn("j", F.explode(step)).withColumns({"cy": F.col("cy") + F.col("i"), "cx": F.col("cx") + F.col("j")}).drop("i", "j")
        return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "cy", "cx")

    pairs = celled(a, "a").join(celled(b, "b"), [*keys, "cy", "cx"]).drop("cy", "cx")
    return pairs.withColumn("metres", metres(F.col("alat"), F.col("alng"), F.col("blat"), F.col("blng"))).filter(F.col("metres") <= radius)


def rings(radius: int) -> list[int]:
    """Radii up to the given one, each eight times the one before."""
    out = [radius]
    while out[0] > 8:
        out.insert(0, out[0] // 8)
    return out


def within_radius(a: DataFrame, b: DataFrame, radius: int) -> DataFrame:
    """Pairs (a, b) of points (id, lat, lng) at most ``radius`` metres apart. Different places meet, with the ids of each, and
    only what comes out names all pairs of ids. The smaller side is a."""

    def places(df: DataFrame, side: str) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy("lat", "lng").orderBy("id"))
        rows = located(df).select("id", "lat", "lng", F.floor((nth - 1) / HELD).alias("part"))
        return rows.groupBy(F.col("lat").alias(f"{side}lat"), F.col("lng").alias(f"{side}lng"), "part").agg(F.collect_list(F.struct("id")).alias(f"{side}s")).drop("part")

    pairs = met(places(a, "a"), places(b, "b"), radius).select(F.explode("as").alias("a"), "bs", "metres")
    return pairs.select("a", F.explode("bs").alias("b"), "metres").select("a.id", "b.id", "metres").toDF("a", "b", "metres")


def nearest(places: DataFrame, b: DataFrame, radius: int, k: int, last: bool = False) -> DataFrame:
    """(alat, alng, b, metres, rank): the k nearest points of b (id, lat, lng) within the radius of each of the different places
    (alat, alng), the smaller id (or the larger, if ``last``) first of equals. Of the points in one place no more than the first k
    take part. What has k within a smaller radius needs no larger one, so most are done before there are many candidates."""
    order = F.col("b").desc() if last else F.col("b")
    first = F.row_number().over(Window.partitionBy("blat", "blng").orderBy(order))
    b = checkpointed(located(b).select(F.col("id").alias("b"), F.col("lat").alias("blat"), F.col("lng").alias("blng")).withColumn("nth", first).filter(F.col("nth") <= k).drop("nth"))
    left, n_b, out = checkpointed(places), b.count(), None
    for r in rings(radius):
        rank = F.row_number().over(Window.partitionBy("alat", "alng").orderBy("metres", order))
        found = met(left, b, r, "a" if left.count() <= n_b else "b").select("alat", "alng", "b", "metres", rank.alias("rank")).filter(F.col("rank") <= k)
        found = checkpointed(found)
        if r < radius:
            done = found.filter(F.col("rank") == k).select("alat", "alng")
            found, left = found.join(done, ["alat", "alng"], "left_semi"), checkpointed(left.join(done, ["alat", "alng"], "left_anti"))
        out = found if out is None else out.unionByName(found)
        if not left.limit(1).count():
            break
    return out


def _at(df: DataFrame) -> DataFrame:
    return located(df).select(F.col("lat").alias("alat"), F.col("lng").alias("alng")).distinct()


def knn_within(a: DataFrame, b: DataFrame, radius: int, k: int) -> DataFrame:
    """The k nearest points b within the radius of every point a, with metres and rank; the smaller b first of equals."""
    near = nearest(_at(a), b, radius, k)
    return a.select(F.col("id").alias("a"), F.col("lat").alias("alat"), F.col("lng").alias("alng")).join(near, ["alat", "alng"]).select("a", "b", "metres", "rank")


def nearest_seed(points: DataFrame, seeds: DataFrame, radius: int) -> DataFrame:
    """The nearest seed within the radius, the last of equals, for every point; null where there is none."""
    near = nearest(_at(points), seeds, radius, 1, last=True)
    rows = points.select("id", F.col("lat").alias("alat"), F.col("lng").alias("alng"))
    return rows.join(near, ["alat", "alng"], "left").select("id", F.col("b").alias("seed"), "metres")


def paired(a: DataFrame, b: DataFrame, radius: int) -> DataFrame:
    """One-to-one matching (a, b, cost) of points at most ``radius`` metres apart, the nearest first, ties by a and b: what
    ``mutual_best`` makes of all such pairs. The pairs within a smaller radius come first, whatever lies further; what they use up
    meets nothing in a larger one."""
    out = None
    for r in rings(radius):
        taken = mutual_best(within_radius(a, b, r).withColumnRenamed("metres", "cost"))
        out = taken if out is None else out.unionByName(taken)
        if r < radius:
            a = checkpointed(a.join(taken.select(F.col("a").alias("id")), "id", "left_anti"))
            b = checkpointed(b.join(taken.select(F.col("b").alias("id")), "id", "left_anti"))
            if not a.limit(1).count() or not b.limit(1).count():
                break
    return out


def distance_matrix(points: DataFrame, hubs: DataFrame, minutes) -> DataFrame:
    """Walking minutes from every point to every hub; hubs are a fixed short list."""
    h = hubs.select(F.col("id").alias("hub"), F.col("lat").alias("hlat"), F.col("lng").alias("hlng"))
    return points.join(F.broadcast(h), F.lit(True)).select("id", "hub", minutes(metres(F.col("lat"), F.col("lng"), F.col("hlat"), F.col("hlng"))).alias("minutes"))


def inside(box: tuple[int, int, int, int]) -> Column:
    return F.col("lat").between(box[0], box[1]) & F.col("lng").between(box[2], box[3])


def map_layers(layers: dict[str, DataFrame], box: tuple[int, int, int, int], calendar: DataFrame, width: int = 1000) -> DataFrame:
    """(layer, id, px, py, days) of what lies inside the box, projected to whole map units from the north-west corner; days are
    those on which it is open: its own (days), or those of its program (calendar: program, first, last), or none where it has
    neither. Layers have id, lat, lng and may have program or days."""
    rows = None
    for layer, df in layers.items():
        days, program = (F.col("days") if "days" in df.columns else F.lit(None).cast("array<bigint>")), (F.col("program") if "program" in df.columns else F.lit(None).cast("string"))
        one = df.filter(inside(box)).select(F.lit(layer).alias("layer"), F.col("id").cast("string").alias("id"), F.floor((F.col("lng") - box[2]) * width / (box[3] - box[2])).cast("long").alias("px"), F.floor((box[1] - F.col("lat")) * width / (box[3] - box[2])).cast("long").alias("py"), days.alias("own"), program.alias("program"))
        rows = one if rows is None else rows.unionByName(one)
    runs = calendar.select("program", F.sequence("first", "last").cast("array<bigint>").alias("run"))
    return rows.join(runs, "program", "left").select("layer", "id", "px", "py", F.coalesce("own", "run", F.array().cast("array<bigint>")).alias("days"))


def off_map_split(df: DataFrame, box: tuple) -> DataFrame:
    """How many rows lie on the map, outside it, or have no coordinates."""
    side = F.when(F.col("lat").isNull() | F.col("lng").isNull(), "none").when(inside(box), "on").otherwise("outside")
    return df.groupBy(side.alias("side")).agg(F.count("*").alias("n"))


def region_check(df: DataFrame, region: tuple, box: tuple) -> DataFrame:
    """Outside the region is an error, outside the map a warning, half a coordinate pair an error."""
    level = F.when(F.col("lat").isNull() != F.col("lng").isNull(), "half").when(F.col("lat").isNull(), None).when(~inside(region), "error").when(~inside(box), "warning")
    return df.select("id", level.alias("level")).filter("level is not null")


def cluster_points(df: DataFrame, radius: int) -> DataFrame:
    """Greedy clusters of each view's points (view, id, x, y, importance), in pixels: (view, seed, n, x, y), x and y the mean of the
    members. In order of importance, then id, a point that lies less than the radius from seeds before it joins one of them: of
    those in the leftmost of the three columns of cells (a radius wide) around it that has any, the nearest; else it is a seed.

    Of points in one place only the first can be a seed. All that no undecided earlier one is near become seeds together, what they
    reach is decided, and so on: so the seeds are those of one point at a time, and no task holds a view. There are as many rounds
    as the longest chain of ever less important neighbours has links, of which every second is a seed: few where importance is
    spread, at most the number of different places. Then every point meets the seeds of its nine cells, of which there are a dozen
    at most, as seeds lie a radius apart."""
    rows = checkpointed(df.select("view", "id", "x", "y", F.struct((-F.col("importance")).alias("rank"), "id").alias("o")))
    cell = lambda c: F.floor(F.col(c) / F.lit(radius)).cast("long")
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    # i: how many columns of cells the partner lies to the right
    spread = lambda p: p.withColumn("c", around).withColumns({"i": F.col("c.i"), "cx": cell("x") + F.col("c.i"), "cy": cell("y") + F.col("c.j")}).drop("c")
    apart = (F.col("x") - F.col("sx")) * (F.col("x") - F.col("sx")) + (F.col("y") - F.col("sy")) * (F.col("y") - F.col("sy"))
    met = lambda points, seeds: spread(points).join(seeds.withColumns({"cx": cell("sx"), "cy": cell("sy")}), ["view", "cx", "cy"]).withColumn("d", apart).filter((F.col("s") < F.col("o")) & (F.col("d") < radius * radius))
    spots = checkpointed(rows.groupBy("view", "x", "y").agg(F.min("o").alias("o")))
    edges = checkpointed(met(spots, spots.select("view", F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("o").alias("s"))).select("view", F.col("s").alias("a"), F.col("o").alias("b")))
    point = lambda df, c: df.select("view", F.col(c).alias("p"))

    open_, live, seeds = point(spots, "o"), edges, None
    while True:
        fresh = checkpointed(open_.join(point(live, "b").distinct(), ["view", "p"], "left_anti"))
        seeds = fresh if seeds is None else seeds.unionByName(fresh)
        reached = live.join(fresh.withColumnRenamed("p", "a"), ["view", "a"])
        gone = checkpointed(fresh.unionByName(point(reached, "b")).distinct())
        open_ = checkpointed(open_.join(gone, ["view", "p"], "left_anti"))
        if not open_.limit(1).count():
            break
        live = checkpointed(live.join(gone.withColumnRenamed("p", "a"), ["view", "a"], "left_anti").join(gone.withColumnRenamed("p", "b"), ["view", "b"], "left_anti"))
    places = spots.join(seeds.withColumnRenamed("p", "o"), ["view", "o"]).select("view", F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("o").alias("s"))
    first = met(rows, checkpointed(places)).groupBy("view", "o").agg(F.min(F.struct("i", "d", "s")).alias("best"))
    own = rows.join(first, ["view", "o"], "left").withColumn("seed", F.coalesce("best.s.id", "id"))
    return own.groupBy("view", "seed").agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"))


def extent_fit(df: DataFrame, group: str, size: tuple[int, int], pad: int = 40, least: tuple[int, int] = (200, 150)) -> DataFrame:
    """(group, x0, y0, w, h): the part of a map of the given size that shows all of a group's points (x, y) inside it, padded, at
    least so large, four to three, not larger than the map and moved inside it. Points beyond the map don't count."""
    e = df.filter(F.col("x").between(0, size[0]) & F.col("y").between(0, size[1])).groupBy(group).agg(F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("c"), F.max("y").alias("d"))
    e = e.select(group, ((F.col("a") + F.col("b")) / 2).alias("mx"), ((F.col("c") + F.col("d")) / 2).alias("my"), F.greatest(F.col("b") - F.col("a") + 2 * pad, F.lit(least[0])).cast("double").alias("w"), F.greatest(F.col("d") - F.col("c") + 2 * pad, F.lit(least[1])).cast("double").alias("h"))
    wide = F.col("w") / F.col("h") > 4 / 3
    e = e.withColumns({"w": F.least(F.when(wide, F.col("w")).otherwise(F.col("h") * 4 / 3), F.lit(float(size[0]))), "h": F.least(F.when(wide, F.col("w") * 3 / 4).otherwise(F.col("h")), F.lit(float(size[1])))})
    start = lambda middle, side, whole: F.least(F.greatest(F.lit(0.0), F.col(middle) - F.col(side) / 2), F.lit(float(whole)) - F.col(side))
    return e.select(group, start("mx", "w", size[0]).alias("x0"), start("my", "h", size[1]).alias("y0"), "w", "h")


def _weights(alpha: float, s: float, px: Column, py: Column) -> Column:
    d = (F.col("cx") - px) * (F.col("cx") - px) + (F.col("cy") - py) * (F.col("cy") - py)
    return 1.0 / F.pow(d + F.lit(s * s), F.lit(alpha))


def _affine(keys: list[str], rows: DataFrame) -> DataFrame:
    """Weighted least squares of (u, v) on (1, x, y) around each pin, solved by Cramer's rule; rows hold w, dx, dy, u, v."""
    s = lambda c: F.sum(F.col("w") * c)
    x, y, u, v = F.col("dx"), F.col("dy"), F.col("u"), F.col("v")
    one = F.lit(1.0)
    sums = rows.groupBy(*keys).agg(s(one).alias("s0"), s(x).alias("sx"), s(y).alias("sy"), s(x * x).alias("sxx"), s(x * y).alias("sxy"), s(y * y).alias("syy"), s(u).alias("su"), s(u * x).alias("sux"), s(u * y).alias("suy"), s(v).alias("sv"), s(v * x).alias("svx"), s(v * y).alias("svy"))
    det = F.expr("s0 * (sxx * syy - sxy * sxy) - sx * (sx * syy - sxy * sy) + sy * (sx * sxy - sxx * sy)")
    # the pin is the origin, so only the constant terms are needed
    at = lambda k: F.expr(f"s{k} * (sxx * syy - sxy * sxy) - sx * (s{k}x * syy - sxy * s{k}y) + sy * (s{k}x * sxy - sxx * s{k}y)") / det
    return sums.select(*keys, at("u").alias("u"), at("v").alias("v"))


def georeference_pins(pins: DataFrame, controls: DataFrame, alpha: float = 1.5, s: float = 20.0) -> DataFrame:
    """Moving least squares: each pin (map, pin, x, y) gets (u, v) from an affine fit of its map's controls (map, cx, cy, u,
    v), weighted by 1 / (d^2 + s^2)^alpha. A map has some dozens of surveyed points."""
    met = pins.join(controls, "map").withColumn("w", _weights(alpha, s, F.col("x"), F.col("y"))).withColumn("dx", F.col("cx") - F.col("x")).withColumn("dy", F.col("cy") - F.col("y"))
    return _affine(["map", "pin"], met)


def georef_cv(controls: DataFrame, grid: list[tuple[float, float]]) -> DataFrame:
    """Leave-one-out residuals of each map for every (alpha, s) of the grid: mean and 90th percentile, in thousandths of a unit."""
    c = controls.select("map", "c", "cx", "cy", "u", "v")
    left = c.select("map", F.col("c").alias("pin"), F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("u").alias("tu"), F.col("v").alias("tv"))
    tries = F.explode(F.array(*(F.struct(F.lit(float(a)).alias("alpha"), F.lit(float(s)).alias("s")) for a, s in grid)))
    met = left.join(c, "map").filter("pin <> c").withColumn("g", tries).withColumn("alpha", F.col("g.alpha")).withColumn("s", F.col("g.s"))
    d = (F.col("cx") - F.col("x")) * (F.col("cx") - F.col("x")) + (F.col("cy") - F.col("y")) * (F.col("cy") - F.col("y"))
    met = met.withColumn("w", 1.0 / F.pow(d + F.col("s") * F.col("s"), F.col("alpha"))).withColumn("dx", F.col("cx") - F.col("x")).withColumn("dy", F.col("cy") - F.col("y"))
    fit = _affine(["map", "alpha", "s", "pin"], met).join(left.select("map", "pin", "tu", "tv"), ["map", "pin"])
    r = F.sqrt((F.col("u") - F.col("tu")) * (F.col("u") - F.col("tu")) + (F.col("v") - F.col("tv")) * (F.col("v") - F.col("tv")))
    return fit.groupBy("map", "alpha", "s").agg(F.floor(F.avg(r) * 1000 + 0.5).cast("long").alias("mean_milli"), F.floor(F.percentile(r, F.lit(0.9)) * 1000 + 0.5).cast("long").alias("p90_milli"))


def local_error(places: DataFrame, residuals: DataFrame, keys: list[str], s: float, alpha: float, near: float = 0.01) -> DataFrame:
    """(keys, local): the root mean square of the residuals (map, cx, cy, r) around each place (map, x, y and keys), weighted by
    1 / (d^2 + s^2)^alpha; a residual that lies where ``own`` says (at most ``near`` away) is left out. A map has some dozens."""
    dx, dy = F.col("cx") - F.col("x"), F.col("cy") - F.col("y")
    met = places.join(residuals.select("map", "cx", "cy", "r"), "map").filter(~F.col("own") | (F.abs(dx) >= near) | (F.abs(dy) >= near))
    met = met.withColumn("w", 1.0 / F.pow(dx * dx + dy * dy + F.lit(s * s), F.lit(alpha)))
    return met.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("r") * F.col("r")) / F.sum("w")).alias("local"))


def uncertainty_factors(residuals: DataFrame, s: float = 40.0, alpha: float = 2.0, share: float = 0.9, otherwise: float = 2.0) -> DataFrame:
    """(map, factor, n) for every map of residuals (map, c, cx, cy, r, counts): by what local errors must be multiplied to cover
    ``share`` of the residuals that count, each judged by the others around it. ``otherwise`` where none counts."""
    places = residuals.filter("counts").select("map", "c", "r", F.col("cx").alias("x"), F.col("cy").alias("y"), F.lit(True).alias("own"))
    local = local_error(places.drop("r"), residuals, ["map", "c"], s, alpha).join(places.select("map", "c", "r"), ["map", "c"])
    ratios = local.groupBy("map").agg(F.percentile(F.col("r") / F.greatest("local", F.lit(1.0)), F.lit(share)).alias("factor"), F.count("*").alias("n"))
    return residuals.select("map").distinct().join(ratios, "map", "left").select("map", F.coalesce("factor", F.lit(otherwise)).alias("factor"), F.coalesce("n", F.lit(0)).alias("n"))


def position_uncertainty(pins: DataFrame, residuals: DataFrame, s: float = 40.0, alpha: float = 2.0, share: float = 0.9, floor: int = 15, step: int = 5) -> DataFrame:
    """(map, pin, approx_m) of pins (map, pin, x, y): the local error times its map's factor, at least ``floor``, in steps of
    ``step``. So about ``share`` of what is placed like the residuals that count lies within approx_m."""
    local = local_error(pins.withColumn("own", F.lit(False)), residuals, ["map", "pin"], s, alpha).join(uncertainty_factors(residuals, s, alpha, share), "map")
    return local.select("map", "pin", (F.ceil(F.greatest(F.lit(float(floor)), F.col("local") * F.col("factor")) / step - 1e-9) * step).cast("long").alias("approx_m"))


def hood_assignment(df: DataFrame, table: DataFrame, seeds: DataFrame, radius: int, region: tuple) -> DataFrame:
    """Hood by name table, else by the nearest reference point; outside the region there is none. A name that the table has
    more than once counts once, with its least hood. Hoods are looked up for places, then points for places."""
    near = nearest(_at(df), seeds, radius, 1, last=True)
    hoods = near.join(seeds.select(F.col("id").alias("b"), F.col("hood").alias("seed_hood")), "b").select(F.col("alat").alias("lat"), F.col("alng").alias("lng"), "seed_hood")
    named = table.groupBy("name").agg(F.min("table_hood").alias("table_hood"))
    rows = df.select("id", "name", "lat", "lng").join(hoods, ["lat", "lng"], "left").join(named, "name", "left")
    return rows.select("id", F.when(inside(region), F.coalesce("table_hood", "seed_hood")).alias("hood"))


def geofence_override(df: DataFrame, pattern: str, point: tuple[int, int], radius: int, hood: str) -> DataFrame:
    hit = F.col("name").rlike(pattern) & (metres(F.col("lat"), F.col("lng"), F.lit(point[0]), F.lit(point[1])) <= radius)
    return df.select("id", F.when(hit, hood).otherwise(F.col("hood")).alias("hood"), hit.alias("moved"))


def geocode_gate(hits: DataFrame, region: tuple, least_rank: int = 28) -> DataFrame:
    reason = F.when(F.col("place_rank") < least_rank, "coarse").when(~inside(region), "outside").otherwise("ok")
    return hits.select("id", reason.alias("reason"))


def reach_limit(df: DataFrame, center: tuple[int, int], with_hood: Column, least: int = 3000, more: int = 2000) -> DataFrame:
    """Rows within the reach of those that have a hood, which is at least ``least`` metres, and ``more`` beyond."""
    rows = df.withColumn("metres", metres(F.col("lat"), F.col("lng"), F.lit(center[0]), F.lit(center[1])))
    reach = rows.filter(with_hood).agg((F.greatest(F.max("metres"), F.lit(least)) + more).alias("reach"))
    return rows.join(F.broadcast(reach), F.col("metres") <= F.col("reach")).select("id", "metres", "reach")
