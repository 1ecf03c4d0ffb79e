"""Audit of how filters interact, by folds over all orders of them.

Whether a document fails each filter is a mask of one bit a filter, and a part of the corpus is counted by mask: at most 32 cells
(with the numbers of good and of toxic documents beside). No document meets the orders. Each cell folds across the array of all
120 orders, which travels as one constant: ``transform`` goes through the orders, ``aggregate`` through the filters of one, and
gives 600 structs weighted by the cell's counts. The cells of a part merge by elementwise sums, and the Shapley share of a filter
is a sum over the merged structs.

Only hashes of texts are shuffled, and only to find the smallest doc_id of each text; what meets it again is keyed by text hash
and doc_id together, so that a text which a third of all rows share makes no hot key.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import stored, text_of

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
BITS = {f: 1 << i for i, f in enumerate(FILTERS)}
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def failures(text: Column) -> list[Column]:
    """Whether a text fails filters A to D."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n, chars = F.size(words).cast("long"), F.length(text).cast("long")
    capitals = chars - F.length(F.translate(text, CAPITALS, ""))
    return [n < 100, F.lit(100) * F.size(F.array_distinct(words)) < F.lit(80) * n, F.lit(100) * capitals > F.lit(10) * chars, text.rlike("[#$%&*|]")]


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by language and by the filters that they fail, A the lowest bit.

    A null text is empty. Rows without a doc_id can't be later than another, nor earlier. A document is good (toxic) if any label
    of its doc_id says so; labels without doc_id and labels of no document don't count. Repeated rows count as often as they occur.
    Null and empty lang are one part.
    """
    bits = sum((F.when(fails, BITS[f]).otherwise(0) for f, fails in zip("ABCD", failures(F.col("text")), strict=True)), F.lit(0))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text_of().alias("text"))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), bits.cast("int").alias("bits"))
    # copies of a row are one from here on; what follows reads these narrow rows three times, and the texts once
    rows = stored(rows.groupBy("doc_id", "part", "digest", "bits").agg(F.count("*").alias("n")), "filter-rows")
    named, nameless = rows.filter("doc_id is not null"), rows.filter("doc_id is null")
    first = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    named = named.join(first, ["doc_id", "digest"], "left").join(known, "doc_id", "left")
    named = named.select("part", (F.col("bits") + F.when(F.col("first"), 0).otherwise(BITS["E"])).alias("mask"), "n", F.when(F.col("good"), F.col("n")).otherwise(0).alias("good"), F.when(F.col("toxic"), F.col("n")).otherwise(0).alias("toxic"))
    none = F.lit(0).cast("long")
    both = named.unionByName(nameless.select("part", F.col("bits").alias("mask"), "n", none.alias("good"), none.alias("toxic")))
    return both.groupBy("part", "mask").agg(*(F.sum(c).cast("long").alias(c) for c in ("n", "good", "toxic")))


def folded() -> Column:
    """Of a cell: for each order and step, in this order, the cell's documents in each measure."""
    none = F.lit(0).cast("long")

    def step(state: Column, bit: Column) -> Column:
        fails, here = F.col("mask").bitwiseAND(bit) != 0, state["alive"]
        gone = fails & here
        count = lambda holds, of="n": F.when(holds, F.col(of)).otherwise(none)
        made = [
            count(here & ~fails), count(gone), count(fails & ~here), count(F.col("mask") == bit), count(gone, "good"), count(gone, "toxic"),
        ]
        return F.struct((here & ~fails).alias("alive"), F.concat(state["steps"], F.array(F.struct(*(c.alias(m) for c, m in zip(made, MEASURES, strict=True))))).alias("steps"))

    kind = "array<struct<" + ",".join(f"{m}:bigint" for m in MEASURES) + ">>"
    start = F.struct(F.lit(True).alias("alive"), F.array().cast(kind).alias("steps"))
    orders = F.lit([[BITS[f] for f in order] for order in ORDERS])
    return F.flatten(F.transform(orders, lambda order: F.aggregate(order, start, step, lambda state: state["steps"])))


def merged(cell: str) -> Column:
    """Aggregate: elementwise sums of the folded cells of a part, at most 32."""
    add = lambda a, b: F.struct(*((a[m] + b[m]).alias(m) for m in MEASURES))
    all_of = F.collect_list(cell)
    return F.aggregate(F.slice(all_of, 2, F.size(all_of)), all_of[0], lambda total, x: F.zip_with(total, x, add))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): one row for each
    language, order of the five filters and step. The rules of ``cells`` hold; without documents there are no rows."""
    parts = cells(docs, labels).withColumn("cell", folded()).groupBy("part").agg(merged("cell").alias("steps"))
    letters = F.lit([f for order in ORDERS for f in order])
    # what each filter removes over all orders, by letter
    share = lambda f: F.aggregate(F.zip_with("steps", letters, lambda x, y: F.when(y == f, x["removed"]).otherwise(0)), F.lit(0).cast("long"), lambda total, x: total + x)
    shares = parts.withColumn("shares", F.create_map(*(x for f in FILTERS for x in (F.lit(f), share(f)))))
    rows = shares.select("part", "shares", F.posexplode("steps").alias("at", "x"))
    order = F.element_at(F.lit(ORDERS), (F.floor(F.col("at") / 5) + 1).cast("int"))
    rows = rows.select("part", order.alias("filter_order"), (F.col("at") % 5 + 1).cast("int").alias("step"), "x", "shares")
    rows = rows.withColumn("filter", F.substr("filter_order", "step", F.lit(1)))
    return rows.select("part", "filter_order", "step", "filter", *(F.col(f"x.{m}").alias(m) for m in MEASURES), F.element_at("shares", F.col("filter")).alias("shapley"))


ORACLE = r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
m AS (SELECT text, min(doc_id) AS first FROM w GROUP BY text),
l AS (SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
 {'A': len(words) < 100, 'B': 100 * len(list_distinct(words)) < 80 * len(words), 'C': 100 * length(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 10 * length(w.text),
  'D': regexp_matches(w.text, '[#$%&*|]'), 'E': coalesce(w.doc_id > first, false)} AS f FROM w JOIN m ON w.text = m.text LEFT JOIN l ON w.doc_id = l.doc_id),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT o, unnest([1, 2, 3, 4, 5]) AS step FROM o),
c AS (SELECT part, good, toxic, f, count(*) AS n FROM d GROUP BY ALL),
r AS (SELECT part, o, step, substr(o, step, 1) AS filter, good, toxic, n, f.A::INT + f.B::INT + f.C::INT + f.D::INT + f.E::INT AS fails,
 CASE substr(o, step, 1) WHEN 'A' THEN f.A WHEN 'B' THEN f.B WHEN 'C' THEN f.C WHEN 'D' THEN f.D ELSE f.E END AS here,
 instr(substr(o, 1, step - 1), 'A') > 0 AND f.A OR instr(substr(o, 1, step - 1), 'B') > 0 AND f.B OR instr(substr(o, 1, step - 1), 'C') > 0 AND f.C
 OR instr(substr(o, 1, step - 1), 'D') > 0 AND f.D OR instr(substr(o, 1, step - 1), 'E') > 0 AND f.E AS gone FROM c, s),
t AS (SELECT part, o AS filter_order, step, filter, CAST(coalesce(sum(n) FILTER (WHERE NOT gone AND NOT here), 0) AS BIGINT) AS kept,
 CAST(coalesce(sum(n) FILTER (WHERE NOT gone AND here), 0) AS BIGINT) AS removed, CAST(coalesce(sum(n) FILTER (WHERE gone AND here), 0) AS BIGINT) AS redundant,
 CAST(coalesce(sum(n) FILTER (WHERE here AND fails = 1), 0) AS BIGINT) AS unique_fails, CAST(coalesce(sum(n) FILTER (WHERE NOT gone AND here AND good), 0) AS BIGINT) AS good_lost,
 CAST(coalesce(sum(n) FILTER (WHERE NOT gone AND here AND toxic), 0) AS BIGINT) AS toxic_lost FROM r GROUP BY ALL)
SELECT *, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM t
"""
