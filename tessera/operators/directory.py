"""Directories: facets, matrices, roll-ups, rankings and set operations over tables of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import fold
from tessera.operators.records import numbered


def state_column(state: dict, text: str = "name") -> Column:
    """A typed filter state as one predicate: a list is any of (scalars or arrays), True is truthy, "q" is every term of a
    text, anything else equality; None is no filter."""
    out = F.lit(True)
    for key, value in state.items():
        if value is None:
            continue
        if key == "q":
            for term in value.lower().split():
                out = out & F.contains(F.lower(text), F.lit(term))
        elif isinstance(value, list):
            out = out & F.col(key).isin(*value)
        elif value is True:
            out = out & F.coalesce(F.col(key).cast("boolean"), F.lit(False))
        else:
            out = out & (F.col(key) == F.lit(value))
    return out


def filter_by_state(items: DataFrame, state: dict) -> DataFrame:
    return items.filter(state_column(state))


def facet_counts(items: DataFrame, facets: list[str], state: dict[str, list], text: str | None = None) -> DataFrame:
    """For each value of each facet, how many items pass all other facets and the text: one pass over the items. An item
    that fails two facets counts nowhere, one that fails a single facet counts in that facet alone."""
    fails = {f: ~F.col(f).isin(*state[f]) if state.get(f) else F.lit(False) for f in facets}
    n = sum((c.cast("int") for c in fails.values()), F.lit(0))
    rows = items.filter(state_column({"q": text})) if text else items
    each = F.array(*(F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value"), (n - fails[f].cast("int")).alias("others")) for f in facets))
    return rows.select(F.explode(each).alias("x")).filter("x.others = 0").groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


def batch_filter_queries(items: DataFrame, states: DataFrame) -> DataFrame:
    """Counts of many saved states (qid, q_brand, q_type, q_term; null: no filter) in one pass over the items. Different names
    meet different terms once; every count is then spread over the states that it can serve, each filter set or not, and
    states find theirs by equal keys. A state that nothing passes has no row."""
    counts = items.groupBy("brand", "type", "name").agg(F.count("*").alias("c"))
    terms = states.select("q_term").filter("q_term is not null").distinct()
    held = items.select("name").distinct().join(terms, F.contains("name", "q_term")).groupBy("name").agg(F.collect_set("q_term").alias("held"))
    rows = counts.join(held, "name", "left")
    either = lambda c: F.explode(F.array(F.col(c), F.lit(None)))
    spread = rows.select("c", "type", "held", either("brand").alias("q_brand")).select("c", "q_brand", "held", either("type").alias("q_type"))
    spread = spread.select("c", "q_brand", "q_type", F.explode(F.concat(F.coalesce("held", F.array().cast("array<string>")), F.array(F.lit(None).cast("string")))).alias("q_term"))
    sums = spread.groupBy("q_brand", "q_type", "q_term").agg(F.sum("c").alias("n")).toDF("b", "t", "m", "n")
    same = F.col("b").eqNullSafe(F.col("q_brand")) & F.col("t").eqNullSafe(F.col("q_type")) & F.col("m").eqNullSafe(F.col("q_term"))
    return states.join(sums, same).select("qid", "n")


def validate_filter_state(pairs: DataFrame, allowed: DataFrame) -> DataFrame:
    """pairs (qid, key, value): what the allowed table knows stays, in canonical order; the rest is counted."""
    known = pairs.join(allowed.select("key", "value").distinct().withColumn("ok", F.lit(True)), ["key", "value"], "left")
    word = F.when(F.col("ok"), F.concat_ws("=", "key", "value"))
    return known.groupBy("qid").agg(F.array_join(F.array_sort(F.collect_set(word)), "&").alias("canonical"), F.count_if(F.col("ok").isNull()).alias("n_dropped"))


def group_rollup(df: DataFrame, groups: DataFrame) -> DataFrame:
    """Sessions per group of kinds: distinct timed titles, and ongoing ones."""
    timed = ~F.col("og") & ~F.col("tu") & ~F.col("ad")
    return df.filter("not cancelled").join(groups, "kind").groupBy("grp").agg(F.countDistinct(F.when(timed, F.col("title"))).alias("n_timed"), F.countDistinct(F.when(F.col("og"), F.col("title"))).alias("n_ongoing"))


# Beginnings of a cost text that mean free, what follows the first word "free" where it doesn't, and how a price
# and a price of nothing look.
FREE_STARTS = ("free to the public", "free admission", "this is a free event", "entry is free")
FREE_UNLESS = r"^free\s+(?:(?:to|for)\s+(?:biennial\s+)?pass|with|add-on)"
PRICE, NOTHING = r"\$\s?[0-9]", "$0.00"


def free_class(text: Column) -> Column:
    """'yes' where a text about cost begins with free, but not free with something, as an add-on or for pass holders; 'no' where
    it names a price and nowhere the word free; else 'unknown'."""
    t = F.lower(F.trim(text))
    begins = F.coalesce(*(F.when(F.startswith(t, F.lit(x)), True) for x in FREE_STARTS), F.lit(False)) | (t.rlike(r"^free\b") & ~t.rlike(FREE_UNLESS))
    return F.when(begins, "yes").when(t.rlike(PRICE) & ~F.contains(t, F.lit("free")) & ~F.contains(t, F.lit(NOTHING)), "no").otherwise("unknown")


def count_matrix(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Distinct titles by row and column with a total; a title in several columns counts once in each and once in the total."""
    cells = [F.countDistinct(F.when(F.col(column) == v, F.col("title"))).alias(f"c_{v}") for v in values]
    return df.groupBy(row).agg(*cells, F.countDistinct("title").alias("total"))


def unknown_audit(tables: dict[str, tuple[DataFrame, dict[str, Column]]]) -> DataFrame:
    """(counter, n) of what is not known, counters above zero only: of each table one pass for all of its counters. A counter tells
    of rows for which its condition holds; null counts as not."""
    out = None
    for df, rules in tables.values():
        one = df.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in rules.items())).unpivot([], list(rules), "counter", "n")
        out = one if out is None else out.unionByName(one)
    return out.filter("n > 0")


def hood_rollup(parts: dict[str, DataFrame], weights: dict[str, int], hoods: DataFrame) -> DataFrame:
    """(hood, n_ of each part, weight, place) for each of hoods (hood, name, summary): how many rows of each part lie in it; the
    weighted sum orders them, those with a summary first, equal ones by name."""
    rows = None
    for kind, df in parts.items():
        one = df.groupBy("hood").agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind))
        rows = one if rows is None else rows.unionByName(one)
    n = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).cast("long").alias(f"n_{k}")
    counted = hoods.join(rows, "hood", "left").groupBy("hood", "name", "summary").agg(*map(n, parts))
    counted = counted.withColumn("weight", sum((F.col(f"n_{k}") * w for k, w in weights.items()), F.lit(0)).cast("long"))
    order = Window.orderBy(F.col("summary").isNull(), F.col("weight").desc(), "name")  # one row a hood
    return counted.withColumn("place", F.row_number().over(order)).drop("name", "summary")


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= n)


def role_sections(people: DataFrame, roles: int = 3, most: int = 8) -> DataFrame:
    """people (person, role, score): the most frequent roles in order, each person in the first section with room: a person
    cut from one section may stand in the next. Sections are few, so each is one more plan step, not a loop over rows."""
    top = people.groupBy("role").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "role").limit(roles)
    ranked = top.select("role", F.row_number().over(Window.orderBy(F.col("n").desc(), "role")).alias("section"))
    left, out = people.join(F.broadcast(ranked), "role"), None
    for k in range(1, roles + 1):
        one = left.filter(F.col("section") == k).orderBy(F.col("score").desc(), "person").limit(most).select("section", "role", "person")
        out = one if out is None else out.unionByName(one)
        left = left.join(one.select("person").distinct(), "person", "left_anti")
    return out


def grouping_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts for each of several columns from one scan."""
    each = F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns))
    return df.select(F.explode(each).alias("x")).groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


def modal_label(df: DataFrame, key: Column, label: str, order: str) -> DataFrame:
    """The most frequent spelling of each key, the first seen among equals."""
    counts = df.groupBy(key.alias("key"), F.col(label).alias("label")).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.groupBy("key").agg(F.max_by("label", F.struct("n", -F.col("first"))).alias("label"), F.sum("n").alias("n"))


def tier_walls(df: DataFrame) -> DataFrame:
    """df (org, program, tier, tier_rank, ord): tiers in rank order; tiers without a rank follow by first appearance; an
    organization stands once in a tier."""
    tiers = df.groupBy("program", "tier").agg(F.min("tier_rank").alias("r"), F.min("ord").alias("first"))
    tiers = tiers.withColumn("wall", F.row_number().over(Window.partitionBy("program").orderBy(F.col("r").asc_nulls_last(), "first")))
    orgs = df.groupBy("program", "tier", "org").agg(F.min("ord").alias("ord"))
    place = F.row_number().over(Window.partitionBy("program", "tier").orderBy("ord"))
    return orgs.join(tiers.select("program", "tier", "wall"), ["program", "tier"]).select("program", "wall", "tier", "org", place.alias("place"))


def listed_pivot(df: DataFrame, row: str, column: str, number: str) -> DataFrame:
    return df.groupBy(row, column).agg(F.count("*").alias("n"), F.array_join(F.transform(F.slice(F.array_sort(F.collect_set(number)), 1, 5), lambda x: x.cast("string")), ",").alias("first_numbers"))


def zone_rank(df: DataFrame, group: str, zone: str, number: str) -> DataFrame:
    """Zones rank by their least number."""
    zones = df.groupBy(group, zone).agg(F.min(number).alias("least"), F.count("*").alias("n"))
    return zones.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy("least", zone)))


def host_of(url: Column) -> Column:
    """The host without www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#:]+)", 1)), r"^www\.", "")


def source_hosts(df: DataFrame, group: str, url: str) -> DataFrame:
    return df.groupBy(group, host_of(F.col(url)).alias("host")).agg(F.count("*").alias("n"), F.min(url).alias("example"))


def derived_membership(own: DataFrame, implied: DataFrame) -> DataFrame:
    """(person, program) of record and as sessions imply them: the union, and how many of each were missing from the other."""
    a = own.distinct().withColumn("own", F.lit(1))
    b = implied.distinct().withColumn("implied", F.lit(1))
    both = a.join(b, ["person", "program"], "full")
    return both.groupBy("person").agg(F.array_join(F.array_sort(F.collect_set("program")), ",").alias("programs"), F.count_if(F.col("own").isNull()).alias("n_added"), F.count_if(F.col("implied").isNull()).alias("n_unseen"))


def venue_activity(df: DataFrame) -> DataFrame:
    """Programs and sessions of each venue, with its running number among venues in order of first appearance."""
    per = df.groupBy("venue").agg(F.array_join(F.array_sort(F.collect_set("program")), ",").alias("programs"), F.count("*").alias("n"), F.min("id").alias("first"))
    return numbered(per, [F.col("first")], "stall").drop("first")


def featured_per_day(df: DataFrame, day: Column) -> DataFrame:
    rows = df.filter("featured and not og and not cancelled")
    return rows.groupBy(day.alias("day")).agg(F.min(F.struct("s", "id")).alias("x")).select("day", F.col("x.id").alias("id"), F.col("x.s").alias("s"))


def topics(df: DataFrame, group: str, topic: str, item: str) -> DataFrame:
    return df.groupBy(group, topic).agg(F.count("*").alias("n"), F.min(item).alias("first_item"), F.max(item).alias("last_item"))


def news_sections(df: DataFrame, since: int, n: int = 5) -> DataFrame:
    """Per program: how many are current and how many background, and the ids of the latest."""
    latest = top_per_group(df, ["program"], [F.col("s").desc(), F.col("id")], n).groupBy("program").agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("latest"))
    return df.groupBy("program").agg(F.count_if(F.col("s") >= since).alias("n_current"), F.count_if(F.col("s") < since).alias("n_background")).join(latest, "program")


def az_index(df: DataFrame, name: Column, key: str) -> DataFrame:
    """Letters (# for anything else) with the first record of each, leading symbols skipped and accents folded."""
    folded = fold(F.regexp_replace(name, r"^[^\p{L}\p{N}]+", ""))
    letter = F.upper(F.substring(folded, 1, 1))
    rows = df.select(F.when(letter.rlike("^[A-Z]$"), letter).otherwise("#").alias("letter"), folded.alias("fold"), F.col(key).alias("id"))
    return rows.groupBy("letter").agg(F.count("*").alias("n"), F.min(F.struct("fold", "id")).alias("x")).select("letter", "n", F.col("x.id").alias("first_id"))


def stay_order(stays: DataFrame) -> DataFrame:
    """Room blocks first, then by distance; a missing distance counts as 10^9."""
    return numbered(stays, [F.col("block").desc(), F.coalesce("metres", F.lit(10**9)), F.col("name")], "place")


def union_with_precedence(old: DataFrame, new: DataFrame) -> DataFrame:
    """By key: an old row wins over a new one, the first of equals; programs of all are united, a missing image is filled."""
    rows = old.withColumn("_p", F.lit(0)).unionByName(new.withColumn("_p", F.lit(1)))
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(F.col("_p"), F.col("ord"), F.col(c))))[c]
    return rows.groupBy("key").agg(first("title").alias("title"), first("image").alias("image"), F.array_join(F.array_sort(F.collect_set("program")), ",").alias("programs"), F.count("*").alias("n"))


def new_minus_existing(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new that no old row matches on any of the keys; null keys match nothing."""
    for k in keys:
        new = new.join(old.select(k).filter(F.col(k).isNotNull()).distinct(), k, "left_anti")
    return new


def symmetric_recon(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    both = a.select(key).distinct().withColumn("a", F.lit(1)).join(b.select(key).distinct().withColumn("b", F.lit(1)), key, "full")
    where = F.when(F.col("a").isNull(), "only_b").when(F.col("b").isNull(), "only_a").otherwise("both")
    return both.groupBy(where.alias("side")).agg(F.count("*").alias("n"))


def stale_entries(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """(id, url, version) against a manifest: new, changed, same or orphan."""
    both = rows.select("id", F.col("url").alias("u"), F.col("version").alias("v"), F.lit(1).alias("r")).join(manifest.select("id", "url", "version", F.lit(1).alias("m")), "id", "full")
    state = F.when(F.col("m").isNull(), "new").when(F.col("r").isNull(), "orphan").when((F.col("u") != F.col("url")) | (F.col("v") != F.col("version")), "changed").otherwise("same")
    return both.select("id", state.alias("state"))


def off_view_summary(views: DataFrame, items: DataFrame) -> DataFrame:
    """For each viewport (view, lat0, lat1, lng0, lng1) how many items lie beyond it in each of eight directions, and the
    hood most of them are in. Items are first counted by cell and hood; viewports are few."""
    cells = items.groupBy("lat", "lng", "hood").agg(F.count("*").alias("c"))
    v = F.when(F.col("lat") > F.col("lat1"), "N").when(F.col("lat") < F.col("lat0"), "S").otherwise("")
    h = F.when(F.col("lng") > F.col("lng1"), "E").when(F.col("lng") < F.col("lng0"), "W").otherwise("")
    outside = (F.col("lat") > F.col("lat1")) | (F.col("lat") < F.col("lat0")) | (F.col("lng") > F.col("lng1")) | (F.col("lng") < F.col("lng0"))
    rows = cells.join(views, outside).withColumn("direction", F.concat(v, h)).groupBy("view", "direction", "hood").agg(F.sum("c").alias("c"))
    return rows.groupBy("view", "direction").agg(F.sum("c").alias("n"), F.min_by("hood", F.struct(-F.col("c"), F.col("hood"))).alias("hood"))


