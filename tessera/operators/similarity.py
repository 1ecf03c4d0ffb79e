"""Similarity of short texts: sets of trigrams, shared words and credited names, met by keys that few texts share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import fold
from tessera.operators.records import checkpointed, numbered

#: A trigram in more than this share of the texts of a side (and in more than COMMON_LEAST) is common.
COMMON, COMMON_LEAST = 0.05, 100
# Fixed list: words that don't tell one title from another.
STOPWORDS = ("the", "a", "an", "of", "and", "by", "mural", "projection", "lighting", "show", "experience", "installation")


def spelled(c: Column) -> Column:
    """Folded, with "and" for & and i for !."""
    return F.replace(F.replace(fold(F.coalesce(c, F.lit(""))), F.lit("&"), F.lit(" and ")), F.lit("!"), F.lit("i"))


def squashed(c: Column) -> Column:
    return F.regexp_replace(spelled(c), "[^a-z0-9]", "")


def grams(c: Column, size: int = 3) -> Column:
    """The different runs of ``size`` characters; none of a shorter text."""
    n = F.length(c) - (size - 1)
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(c, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def padded(c: Column) -> Column:
    """Trigrams with two spaces before and one behind."""
    return grams(F.concat(F.lit("  "), c, F.lit(" ")))


def jaccard(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), shared / (F.size(a) + F.size(b) - shared)).otherwise(F.lit(0.0))


def near_sets(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """Distinct pairs (a, b) of left and right (id, grams), among which are all with a Jaccard index of ``least`` or more.

    Grams are ordered from the rarest on. Two such sets share a gram among the first n - ceil(least * n) + 1 of each, and what is
    left behind the first shared one must suffice for the overlap (positional filter). Common grams make no key by themselves: sets
    that share nothing rarer share two grams among the first n - ceil(least * n) + 2, so that they meet on pairs of common ones.
    Sets of one or two grams, of which there are few different ones, meet on single grams always."""
    each = lambda df, side: df.select(F.lit(side).alias("side"), "id", F.size("grams").alias("n"), F.explode("grams").alias("g"))
    rows = checkpointed(each(left, "a").unionByName(each(right, "b")))
    sizes = {r.side: r.n for r in left.agg(F.count("*").alias("n")).select(F.lit("a").alias("side"), "n").unionByName(right.agg(F.count("*").alias("n")).select(F.lit("b").alias("side"), "n")).collect()}
    held = rows.groupBy("g").agg(F.count("*").alias("f"), *(F.count_if(F.col("side") == s).alias(f"f_{s}") for s in "ab"))
    common = F.lit(False)
    for s in "ab":
        common = common | (F.col(f"f_{s}") > max(COMMON_LEAST, COMMON * sizes.get(s, 0)))
    order = Window.partitionBy("side", "id").orderBy("common", "f", "g")
    prefix = F.col("n") - F.ceil(F.lit(least) * F.col("n")) + 1
    ranked = rows.join(held.select("g", "f", common.alias("common")), "g").withColumn("k", F.row_number().over(order)).filter(F.col("k") <= prefix + 1)
    ranked = checkpointed(ranked.select("side", "id", "n", "g", "k", "common", (F.col("k") <= prefix).alias("first")))
    single = ranked.filter("first and (not common or n <= 2)").select("side", "id", "n", "g", "k")
    side = lambda df, s: df.filter(F.col("side") == s).select(F.col("id").alias(s), F.col("n").alias(f"n{s}"), F.col("k").alias(f"k{s}"), "g")
    fits = f"na >= nb * {least} and nb >= na * {least}"
    enough = f"1 + least(na - ka, nb - kb) >= ceil({least / (1 + least)} * (na + nb) - 1e-9)"
    met = side(single, "a").join(side(single, "b"), "g").filter(f"{fits} and {enough}").select("a", "b")
    both = ranked.filter("common").groupBy("side", "id", "n").agg(F.array_sort(F.collect_list(F.struct("k", "g"))).alias("x"))
    pairs = F.flatten(F.transform("x", lambda p: F.transform(F.filter("x", lambda q: q["k"] > p["k"]), lambda q: F.struct(F.concat(p["g"], q["g"]).alias("g"), p["k"].alias("k")))))
    double = both.select("side", "id", "n", F.explode(pairs).alias("y")).select("side", "id", "n", "y.g", "y.k")
    # the two grams and what is left behind the first one
    return met.unionByName(side(double, "a").join(side(double, "b"), "g").filter(f"{fits} and {enough}").select("a", "b")).distinct()


def near_texts(df: DataFrame, least: float = 0.5) -> DataFrame:
    """Pairs (a, b) of different texts (id, text) by the Jaccard index of their padded trigrams, in thousandths. Equal texts are
    one, under the least id."""
    rows = checkpointed(df.groupBy(F.lower("text").alias("text")).agg(F.min("id").alias("id")).select("id", padded(F.col("text")).alias("grams")))
    met = near_sets(rows, rows, least).filter("a < b")
    both = met.join(rows.toDF("a", "ga"), "a").join(rows.toDF("b", "gb"), "b")
    score = jaccard(F.col("ga"), F.col("gb"))
    return both.select("a", "b", F.floor(score * 1000).cast("long").alias("permille")).filter(score >= least)


def words(c: Column) -> Column:
    """The different words of a title that tell it from others."""
    return F.array_distinct(F.filter(F.split(spelled(c), "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(*STOPWORDS)))


def overlap(a: Column, b: Column) -> Column:
    """Shared words over the shorter title's, if two or more are shared."""
    shared = F.size(F.array_intersect(a, b))
    return F.when(shared >= 2, shared / F.least(F.size(a), F.size(b))).otherwise(F.lit(0.0))


def pieces(credit: Column) -> Column:
    return F.split(credit, ",| X | and ")


def named(names: DataFrame, credits: DataFrame, alike: float) -> DataFrame:
    """(name, credit) of all different names (name) and credits (credit) of which one holds the other,
    or of which the name is like the credit or one of its pieces.

    What is like each other meets by ``near_sets``. Of what may be held, the rarest trigram is looked up among all trigrams of
    what may hold it; texts of one or two characters are looked up whole."""
    n = checkpointed(names.select("name", squashed(F.col("name")).alias("text")).filter(F.length("text") >= 3))
    c = checkpointed(credits.select("credit", squashed(F.col("credit")).alias("text")).filter("text <> ''"))
    parts = c.select("credit", F.explode(F.array_union(F.array("credit"), pieces(F.col("credit")))).alias("piece")).withColumn("text", squashed(F.col("piece")))
    unique = lambda df: df.select("text").distinct().select(F.col("text").alias("id"), padded(F.col("text")).alias("grams"))
    alike_texts = near_sets(unique(n), unique(parts), alike)
    met = alike_texts.join(n.select("name", F.col("text").alias("a")), "a").join(parts.select("credit", F.col("text").alias("b")), "b").select("name", "credit")

    def holds(inner: DataFrame, outer: DataFrame) -> DataFrame:
        """(inner, outer): different texts of which one may hold the other."""
        inner, outer = inner.select(F.col("text").alias("inner")).distinct(), outer.select(F.col("text").alias("outer")).distinct()
        size = F.least(F.length("inner"), F.lit(3))
        own = inner.select("inner", F.explode(F.when(size == 3, grams(F.col("inner"))).otherwise(F.array("inner"))).alias("g"))
        all_of = checkpointed(outer.select("outer", F.explode(F.concat(grams(F.col("outer")), grams(F.col("outer"), 2), grams(F.col("outer"), 1))).alias("g")))
        rare = own.join(all_of.groupBy("g").agg(F.count("*").alias("f")), "g").groupBy("inner").agg(F.min(F.struct("f", "g")).alias("x"))
        counted = own.groupBy("inner").agg(F.count("*").alias("m")).join(own.join(all_of.select("g").distinct(), "g", "left_semi").groupBy("inner").agg(F.count("*").alias("have")), "inner").filter("m = have")
        return rare.join(counted, "inner").select("inner", F.col("x.g").alias("g")).join(all_of, "g").filter(F.contains("outer", F.col("inner"))).select("inner", "outer")

    names_in = holds(n, c).join(n.select("name", F.col("text").alias("inner")), "inner").join(c.select("credit", F.col("text").alias("outer")), "outer")
    credits_in = holds(c, n).join(c.select("credit", F.col("text").alias("inner")), "inner").join(n.select("name", F.col("text").alias("outer")), "outer")
    met = met.unionByName(names_in.select("name", "credit")).unionByName(credits_in.select("name", "credit")).distinct()
    # spelled out once for each name and credit, not for each pair
    own = checkpointed(n.select("name", F.col("text").alias("nt"), padded(F.col("text")).alias("ng")))
    parts_of = checkpointed(c.select("credit", F.col("text").alias("ct"), F.transform(F.array_union(F.array("credit"), pieces(F.col("credit"))), lambda p: padded(squashed(p))).alias("cg")))
    like = F.exists("cg", lambda g: jaccard(F.col("ng"), g) >= alike)
    return met.join(own, "name").join(parts_of, "credit").filter(F.contains("ct", F.col("nt")) | F.contains("nt", F.col("ct")) | like).select("name", "credit")


def text_scores(entries: DataFrame, works: DataFrame, least: float = 0.9, alike: float = 0.6) -> DataFrame:
    """(a, b, title, credit) of entries (id, title, credit, medium) and works (id, title, names, medium) of one medium whose two
    scores add up to ``least`` or more, in thousandths.

    title: the larger of the Jaccard index of trigrams and the share of common words; an entry that is called "Mural" is compared
    as a mural by its credit. credit: the share of a work's names (of three letters or more) that the credit holds. One of the two
    must reach half of ``least``, so that pairs meet by near trigrams, by two common words, or by a name.

    Different titles are scored once, and so are different credits with different lists of names; entries and works meet on the
    numbers of what scores, so that pairs are made at the end and never dealt or stored."""
    called = F.when(F.trim(spelled(F.col("title"))) == "mural", F.concat(F.lit("mural by "), F.coalesce("credit", F.lit("")))).otherwise(F.coalesce("title", F.lit("")))
    plain_mural = F.trim(spelled(F.col("title"))) == "mural"
    x = checkpointed(entries.select("id", "medium", F.coalesce("credit", F.lit("")).alias("credit"), squashed(called).alias("text"), F.when(plain_mural, F.array().cast("array<string>")).otherwise(words(F.col("title"))).alias("words")))
    some = F.filter(F.coalesce("names", F.array().cast("array<string>")), lambda n: n.isNotNull() & (F.length(squashed(n)) >= 3))
    y = checkpointed(works.select("id", "medium", some.alias("names"), squashed(F.coalesce("title", F.lit(""))).alias("text"), words(F.col("title")).alias("words")))

    def forms(rows: DataFrame, name: str, *columns: str) -> DataFrame:
        """The different values of columns, each with a whole number."""
        found = numbered(rows.select(*columns).distinct(), [F.col(c) for c in columns], "nth")
        return checkpointed(found.select(*columns, F.col("nth").cast("int").alias(name)))

    tx, ty, cx, ny = forms(x, "t", "text", "words"), forms(y, "u", "text", "words"), forms(x, "c", "credit"), forms(y, "n", "names")
    # by credit and title, of which there are many kinds, so that no few tasks make all pairs
    x = x.join(tx, ["text", "words"]).join(cx, "credit").select("id", "medium", "t", "c")
    x = checkpointed(x.repartition(int(x.sparkSession.conf.get("spark.sql.shuffle.partitions")), "t", "c"))
    y = checkpointed(y.join(ty, ["text", "words"]).join(ny, "names").select("id", "medium", "u", "n"))

    each = ny.select("n", F.size("names").alias("of"), F.explode("names").alias("name"))
    fits = each.join(named(each.select("name").distinct(), cx.select("credit"), alike), "name").groupBy("n", "of", "credit").agg(F.count("*").alias("held"))
    credits = checkpointed(fits.join(cx, "credit").select("c", "n", (F.col("held") / F.col("of")).alias("credit")))

    unique = lambda df: df.select("text").distinct().select(F.col("text").alias("id"), padded(F.col("text")).alias("grams"))
    near = near_sets(unique(tx), unique(ty), least / 2).join(tx.select(F.col("text").alias("a"), "t"), "a").join(ty.select(F.col("text").alias("b"), "u"), "b").select("t", "u")
    two = F.flatten(F.transform("words", lambda p: F.transform(F.filter("words", lambda q: q > p), lambda q: F.concat_ws(" ", p, q))))
    keyed = lambda df, s: df.select(s, F.explode(two).alias("key"))
    near = near.unionByName(keyed(tx, "t").join(keyed(ty, "u"), "key").select("t", "u"))
    # and what stands beside credits that count, by way of the names that a title meets
    beside = x.select("medium", "t", "c").distinct().join(credits.filter(F.col("credit") >= least / 2 - 1e-9), "c").select("medium", "t", "n").distinct()
    near = near.unionByName(beside.join(y.select("medium", "u", "n").distinct(), ["medium", "n"]).select("t", "u")).distinct()
    left = tx.select("t", padded(F.col("text")).alias("x_grams"), F.col("words").alias("x_words"))
    right = ty.select("u", padded(F.col("text")).alias("y_grams"), F.col("words").alias("y_words"))
    score = F.greatest(jaccard(F.col("x_grams"), F.col("y_grams")), overlap(F.col("x_words"), F.col("y_words")))
    titles = checkpointed(near.join(left, "t").join(right, "u").select("t", "u", score.alias("title")))

    # what a credit alone doesn't reach needs a title of at least so much; all else comes by its credit
    most = credits.filter(F.col("credit") < least - 1e-9).agg(F.max("credit")).first()[0] or 0.0
    needed = min(least / 2, least - most) - 1e-9
    a, b = x.withColumnRenamed("id", "a"), y.withColumnRenamed("id", "b")
    by_title = a.join(titles.filter(F.col("title") >= needed), "t").join(b, ["medium", "u"]).join(credits, ["c", "n"], "left").withColumn("credit", F.coalesce("credit", F.lit(0.0)))
    by_title = by_title.filter(F.col("title") + F.col("credit") >= least - 1e-9)
    by_credit = a.join(credits.filter(F.col("credit") >= least - 1e-9), "c").join(b, ["medium", "n"]).join(titles.filter(F.col("title") < needed), ["t", "u"])
    whole = lambda c: F.floor(F.col(c) * 1000 + 1e-6).cast("long").alias(c)
    return by_title.select("a", "b", whole("title"), whole("credit")).unionByName(by_credit.select("a", "b", whole("title"), whole("credit")))
