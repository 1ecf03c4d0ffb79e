"""Mixing sources to target weights along a curriculum whose weights change over the course of training.

Each source has a weight schedule, piecewise linear over training time 0 to 1. Its integral is the source's weight: the
sources share ``SHARE`` of all words by weight, none more than ``REPEAT`` times what it has, and what is above goes to the
others. The integral up to t is the share of a source's words that training has asked for by then; its inverse gives every
document, at its cumulative offset in a fixed random order of its source, a training position. Sorting by position by range
lays out the mix.

Only DataFrame functions are used. Each source is cut into ``BUCKETS`` buckets of a hash of doc_id and text, so that cumulative
sums run over buckets first and then inside each, and no task holds a whole source. One row a source meets in one task,
where the targets are shared out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._common import shuffle_partitions, stored, text_of

SHARE, REPEAT = 1.5, 2.0
#: (weight at 0, at 1/2, at 1) of the first, second and third source by name, repeating; the integrals are 3, 1 and 2.
SCHEDULES = ((4.0, 3.0, 2.0), (0.5, 1.0, 1.5), (1.5, 2.5, 1.5))
BUCKETS = 1024
WORD = r"[^\x20\x09-\x0D]+"


def integral(schedule: tuple[float, float, float]) -> float:
    a, b, c = schedule
    return (a + 2 * b + c) / 4


def position(share: Column, kind: Column, schedules=SCHEDULES) -> Column:
    """The time at which a source of this schedule has been asked for this share of its words: the inverse of the
    integral, a root of one quadratic for each half."""
    out = F.lit(None).cast("double")
    for k, (a, b, c) in enumerate(schedules):
        asked = share * F.lit(integral(schedules[k]))
        half = (a + b) / 4
        first = 2.0 * asked / (F.lit(a) + F.sqrt(F.lit(a * a) + F.lit(4.0 * (b - a)) * asked))
        later = asked - F.lit(half)
        second = F.lit(0.5) + 2.0 * later / (F.lit(b) + F.sqrt(F.lit(b * b) + F.lit(4.0 * (c - b)) * later))
        out = F.when(kind == k, F.when(asked <= half, first).otherwise(second)).otherwise(out)
    return out


def targets(sources: DataFrame, share: float = SHARE, repeat: float = REPEAT, schedules=SCHEDULES) -> DataFrame:
    """sources (source, size): adds kind (which schedule) and target. Sources are filled to their limit in the order in
    which a rising level reaches it; the first that stays below sets the level for itself and the rest."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sources.withColumn("kind", ((F.row_number().over(by_name) - 1) % len(schedules)).cast("int"))
    weight = F.lit(None).cast("double")
    for k, s in enumerate(schedules):
        weight = F.when(F.col("kind") == k, F.lit(integral(s))).otherwise(weight)
    rows = rows.withColumn("weight", weight).withColumn("limit", F.col("size") * F.lit(repeat))
    rising = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = rising.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    zero = F.lit(0.0)
    level = (F.lit(share) * F.sum("size").over(whole) - F.coalesce(F.sum("limit").over(before), zero)) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), zero))
    rows = rows.withColumn("level", level).withColumn("below", F.col("level") <= F.col("limit") / F.col("weight"))
    rows = rows.withColumn("common", F.min_by("level", F.when(F.col("below"), F.col("limit") / F.col("weight"))).over(whole))
    return rows.select("source", "size", "kind", F.when(F.col("size") == 0, zero).otherwise(F.least("limit", F.coalesce(F.col("weight") * F.col("common"), F.col("limit")))).alias("target"))


def digest() -> Column:
    """Names a row by doc_id and text and gives it its place in the random order of its source."""
    return F.md5(F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text_of().cast("binary"))).cast("binary"))


def mixed(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, source, size, source_size, target, taken, copies, first_position, second_position) for every row.

    A source of target T and size S gives each document floor(T / S) times; the words that then remain come from the
    documents at the start of the source's random order while they fit, and from the one document beyond whose size is
    nearest to what is left. Null texts have size 0 and give nothing; a null source is a source of its own, last by name;
    of repeated rows each counts. Documents are never cut.
    """
    lot = F.conv(F.substring("digest", 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    rows = stored(docs.select("doc_id", "source", F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"), digest().alias("digest")), "sizes")
    rows = rows.withColumn("bucket", F.floor(lot * BUCKETS).cast("int"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))

    # one cell for each bucket of each source; what holds for a source reaches its rows through its cells, so that no join
    # gathers a source in one task
    over = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = stored(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "cells")
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    goal = targets(cells.groupBy("source").agg(F.sum("words").alias("size"))).withColumnsRenamed({"size": "source_size", "source": "g"})
    goal = goal.withColumn("full", full).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    cells = cells.withColumn("base", F.coalesce(F.sum("words").over(over), F.lit(0))).join(goal, same("source", "g")).withColumnsRenamed({"source": "s", "bucket": "b"}).drop("g", "words")

    inside = Window.partitionBy("source", "bucket").orderBy("digest", F.col("doc_id").asc_nulls_last(), "size")
    rows = rows.withColumn("ahead", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).withColumn("nth", F.row_number().over(inside))
    rows = rows.join(cells, same("source", "s") & (F.col("bucket") == F.col("b"))).drop("s", "b").withColumn("ahead", F.col("ahead") + F.col("base")).drop("base")
    rows = stored(rows.withColumn("fits", F.col("ahead") + F.col("size") <= F.col("rest")), "offsets")

    filled = rows.groupBy("source", "rest").agg(F.coalesce(F.sum(F.when(F.col("fits"), F.col("size"))), F.lit(0)).alias("used")).select(F.col("source").alias("s"), "used", (F.col("rest") - F.col("used")).alias("gap"))
    per_cell = stored(rows.select("source", "bucket").distinct().withColumnsRenamed({"source": "cs", "bucket": "cb"}).join(filled, same("cs", "s")).drop("s"), "gaps")
    beyond = rows.filter(~F.col("fits") & (F.col("size") > 0)).join(per_cell, same("source", "cs") & (F.col("bucket") == F.col("cb")))
    off = F.abs(F.col("size") - F.col("gap"))
    nearest = beyond.filter(off < F.col("gap")).groupBy("source").agg(F.min(F.struct(off.alias("off"), "digest", F.col("bucket"), F.col("nth"), F.col("size"))).alias("x"))
    nearest = nearest.select(F.col("source").alias("n"), F.col("x.bucket").alias("b"), F.col("x.nth").alias("at"), F.col("x.size").alias("more"))
    last = per_cell.drop("gap").join(nearest, same("cs", "n"), "left").drop("n").withColumn("more", F.coalesce("more", F.lit(0)))

    rows = rows.join(last, same("source", "cs") & (F.col("bucket") == F.col("cb"))).drop("cs", "cb")
    chosen = F.coalesce((F.col("bucket") == F.col("b")) & (F.col("nth") == F.col("at")), F.lit(False))
    copies = F.when(F.col("size") == 0, 0).otherwise(F.col("full") + (F.col("fits") | chosen).cast("int"))
    total = F.col("full") * F.col("source_size") + F.col("used") + F.col("more")
    # the document that fills the gap comes last in the final pass, after all that fit
    offset = lambda n: (F.lit(n) * F.col("source_size") + F.when(F.lit(n) < F.col("full"), F.col("ahead")).when(F.col("fits"), F.col("ahead")).otherwise(F.col("used"))) / total
    at = lambda n: F.when(F.col("copies") > n, F.floor(position(offset(n), F.col("kind")) * F.lit(1e9)).cast("long"))
    return rows.withColumn("copies", copies).select(
        "doc_id", "digest", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", at(0).alias("first_position"), at(1).alias("second_position"),
    )


def in_order(plan: DataFrame) -> DataFrame:
    """plan's rows by their first place in training, those that aren't taken last."""
    order = [F.col("first_position").asc_nulls_last(), F.col("doc_id")]
    return plan.repartitionByRange(shuffle_partitions(plan.sparkSession), *order).sortWithinPartitions(*order)


def laid_out(docs: DataFrame) -> DataFrame:
    """docs in training order, each row as often as the mix takes it; rows that share doc_id and text get the places of the
    first of them each. Rows without a doc_id are mixed like others."""
    plan = mixed(docs).groupBy("digest").agg(F.min("first_position").alias("p1"), F.min("second_position").alias("p2"))
    places = F.explode(F.filter(F.array("p1", "p2"), lambda p: p.isNotNull())).alias("place")
    # all own columns travel in one, so that no name of theirs can clash
    rows = docs.select(F.struct(*docs.columns).alias("row"), digest().alias("digest")).join(plan.select("digest", places), "digest")
    rows = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), "place", "digest").sortWithinPartitions("place", "digest")
    return rows.select("row.*")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  md5(coalesce(CAST(doc_id AS VARCHAR), '') || ' ' || md5(coalesce(text, ''))) AS digest FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS size FROM d GROUP BY source),
k AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) AS kind FROM s),
w AS (SELECT *, CASE kind WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, size * 2.0::DOUBLE AS lim FROM k),
v AS (SELECT *, (1.5::DOUBLE * sum(size) OVER () - coalesce(sum(lim) OVER r, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER r, 0)) AS level
      FROM w WINDOW r AS (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT min_by(level, lim / weight) AS common FROM v WHERE level <= lim / weight),
t AS (SELECT source, kind, size AS source_size, CASE WHEN size = 0 THEN 0.0::DOUBLE ELSE least(lim, coalesce(weight * common, lim)) END AS target FROM v, c),
f AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS INT) ELSE 0 END AS passes FROM t),
o AS (SELECT d.*, f.source_size, f.target, f.kind, f.passes, f.target - f.passes * f.source_size AS rest,
             CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY digest, doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS BIGINT) AS ahead
      FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source),
u AS (SELECT *, ahead + size <= rest AS fits FROM o),
g AS (SELECT source, rest, CAST(coalesce(sum(size) FILTER (WHERE fits), 0) AS BIGINT) AS used FROM u GROUP BY source, rest),
b AS (SELECT u.source, u.digest, u.size, row_number() OVER (PARTITION BY u.source ORDER BY abs(u.size - (g.rest - g.used)), u.digest) AS rn
      FROM u JOIN g ON u.source IS NOT DISTINCT FROM g.source WHERE NOT fits AND u.size > 0 AND abs(u.size - (g.rest - g.used)) < g.rest - g.used),
x AS (SELECT u.*, g.used, coalesce(b.size, 0) AS more, CASE WHEN u.size = 0 THEN 0 ELSE passes + CAST(fits OR coalesce(b.digest = u.digest, false) AS INT) END AS copies
      FROM u JOIN g ON u.source IS NOT DISTINCT FROM g.source LEFT JOIN (SELECT * FROM b WHERE rn = 1) b ON u.source IS NOT DISTINCT FROM b.source),
a AS (SELECT *, CASE kind WHEN 0 THEN 4.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 1.5::DOUBLE END AS at_0, CASE kind WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.5::DOUBLE END AS at_1,
             CASE kind WHEN 0 THEN 2.0::DOUBLE ELSE 1.5::DOUBLE END AS at_2, CASE kind WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS whole,
             passes * source_size + used + max(more) OVER (PARTITION BY source) AS total FROM x),
p AS (SELECT *, ((nth * source_size + CASE WHEN nth < passes OR fits THEN ahead ELSE used END) / total::DOUBLE) * whole AS asked, (at_0 + at_1) / 4 AS half
      FROM a, (SELECT unnest([0, 1]) AS nth) WHERE copies > nth),
y AS (SELECT doc_id, digest, source, size, nth, CAST(floor(1e9::DOUBLE * CASE WHEN asked <= half THEN 2.0::DOUBLE * asked / (at_0 + sqrt(at_0 * at_0 + 4.0::DOUBLE * (at_1 - at_0) * asked))
             ELSE 0.5::DOUBLE + 2.0::DOUBLE * (asked - half) / (at_1 + sqrt(at_1 * at_1 + 4.0::DOUBLE * (at_2 - at_1) * (asked - half))) END) AS BIGINT) AS place FROM p),
z AS (SELECT digest, source, min(place) FILTER (WHERE nth = 0) AS first_position, min(place) FILTER (WHERE nth = 1) AS second_position FROM y GROUP BY ALL)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, first_position, second_position
FROM x LEFT JOIN z ON x.digest = z.digest AND x.source IS NOT DISTINCT FROM z.source
"""
