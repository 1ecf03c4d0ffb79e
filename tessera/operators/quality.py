"""Data quality: one pass of compiled rules, keys, codes, and the audit of a collection of pages."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.links import attribute, tags


@dataclass(frozen=True)
class Rule:
    """A row breaks the rule where ``broken`` holds; null counts as not broken."""

    path: str
    message: str
    broken: Column
    level: str = "error"


@dataclass(frozen=True)
class Each:
    """Rules for every element of an array, reported under ``path[i]``."""

    path: str
    rules: Callable[[Column], list[tuple[str, Column, str]]]


def validate(df: DataFrame, key: str, rules: list[Rule | Each]) -> DataFrame:
    """(id, path, message, level) for every broken rule of every row, from one scan however many rules there are."""
    problem = lambda path, message, level: F.struct(path.alias("path"), F.lit(message).alias("message"), F.lit(level).alias("level"))
    single = [F.when(F.coalesce(r.broken, F.lit(False)), problem(F.lit(r.path), r.message, r.level)) for r in rules if isinstance(r, Rule)]
    kind = "array<struct<path:string,message:string,level:string>>"
    found = F.array(*single).cast(kind)

    def elements(r: Each) -> Column:
        of = lambda x, i: F.array(*(F.when(F.coalesce(broken, F.lit(False)), problem(F.concat(F.lit(f"{r.path}["), i.cast("string"), F.lit("]")), message, level)) for message, broken, level in r.rules(x)))
        return F.coalesce(F.flatten(F.transform(F.col(r.path), of)), F.array()).cast(kind)

    for r in rules:
        if isinstance(r, Each):
            found = F.concat(found, elements(r))
    return df.select(F.col(key).alias("id"), F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select("id", "x.path", "x.message", "x.level")


def typed(x: Column, kind: str, values: tuple[str, ...] = ()) -> list[tuple[str, Column, str]]:
    """What a value as text must be: an id, a date, a time, a number, an integer, one of some values, or a secure address."""
    forms = {"id": r"^[a-z0-9]+(-[a-z0-9]+)*$", "date": r"^\d{4}-\d{2}-\d{2}$", "time": r"^([01]\d|2[0-3]):[0-5]\d$", "int": r"^-?\d+$", "num": r"^-?\d+(\.\d+)?$"}
    if kind == "enum":
        return [("not one of the values", ~x.isin(*values), "error")]
    if kind == "url":
        return [("insecure link", x.rlike("(?i)^http:"), "error"), ("not an address", ~x.rlike("(?i)^http:") & ~x.rlike(r"^https://[^\s/]+"), "error")]
    return [(f"not {'an' if kind in ('id', 'int') else 'a'} {kind}", ~x.rlike(forms[kind]), "error")]


def typed_rules(path: str, kind: str, values: tuple[str, ...] = (), required: bool = False) -> list[Rule]:
    """The same for a column; nested ones by their path."""
    rules = [Rule(path, message, broken, level) for message, broken, level in typed(F.col(path), kind, values)]
    return [*rules, Rule(path, "missing", F.col(path).isNull())] if required else rules


def text_rules(path: str, longest: int = 5000) -> list[Rule]:
    """What holds for any text: no outer white space, no markup, no placeholder, not too long."""
    c = F.col(path)
    return [
        Rule(path, "white space around", c.rlike(r"^\s|\s$")), Rule(path, "holds markup", c.rlike(r"<[a-zA-Z/][^>]*>")),
        Rule(path, "placeholder", F.lower(c).rlike(r"^(tbd|tba|todo|lorem ipsum|n/a)\b")), Rule(path, "too long", F.length(c) > longest, "warning"),
    ]


def unknown_keys(json: DataFrame, column: str, known: list[str]) -> DataFrame:
    """Keys of JSON objects that no schema declares, with how many rows have them."""
    keys = F.coalesce(F.json_object_keys(column), F.array().cast("array<string>"))
    return json.select(F.explode(F.array_except(keys, F.array(*map(F.lit, known)))).alias("unknown_key")).groupBy("unknown_key").agg(F.count("*").alias("n"))


def coerced(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Values that don't fit their type become null; n_coerced says how many of the row did."""
    cast = {c: F.expr(f"try_cast({c} AS {t})") for c, t in types.items()}
    lost = sum(((F.col(c).isNotNull() & v.isNull()).cast("int") for c, v in cast.items()), F.lit(0))
    return df.withColumn("n_coerced", lost).withColumns(cast)


def duplicate_keys(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """Keys that occur more than once, in one table or in several."""
    rows = None
    for name, df in tables.items():
        one = df.select(F.col(key).cast("string").alias("id"), F.lit(name).alias("tbl"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("tbl")), ",").alias("tables")).filter("n > 1")


def warning_rollup(found: DataFrame, show: int = 3) -> DataFrame:
    """Messages with their number and the first rows that have them."""
    return found.groupBy("level", "message").agg(F.count("*").alias("n"), F.array_join(F.transform(F.slice(F.array_sort(F.collect_set("id")), 1, show), lambda x: x.cast("string")), ",").alias("first_ids"))


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a of a string's ASCII characters."""
    points = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), F.ascii)
    return F.aggregate(points, F.lit(2166136261).cast("long"), lambda h, b: (h.bitwiseXOR(b.cast("long")) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF)))


def short_code(c: Column, length: int = 5) -> Column:
    """The last digits, base 36, of the hash."""
    return F.lpad(F.lower(F.conv((fnv1a(c) % F.lit(36**length)).cast("string"), 10, 36)), length, "0")


def coded(df: DataFrame, key: str) -> DataFrame:
    """(id, code, n) for each different key: n keys share the code."""
    codes = df.select(F.col(key).alias("id")).distinct().withColumn("code", short_code(F.col("id").cast("string")))
    shared = codes.groupBy("code").agg(F.count("*").alias("n"))
    return codes.join(shared, "code").select("id", "code", "n")


def decode_plans(plans: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """plans (plan, codes joined by dots): known items, once each, and the number of unknown codes."""
    codes = items.select(short_code(F.col(key).cast("string")).alias("code"), F.col(key).alias("item")).groupBy("code").agg(F.min("item").alias("item"))
    each = plans.select("plan", F.explode(F.array_distinct(F.filter(F.split("codes", r"\."), lambda c: c != ""))).alias("code"))
    return each.join(codes, "code", "left").groupBy("plan").agg(F.countDistinct("item").alias("n_items"), F.count_if(F.col("item").isNull()).alias("n_unknown"))


# Pages: (page_id, url, html)


def links_of(pages: DataFrame) -> DataFrame:
    """(page_id, href, ord) of every link."""
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'<a [^>]*href="([^"]*)"'), F.lit(1))).alias("ord", "href"))


def path_of(url: Column) -> Column:
    """The path without query, fragment and trailing slash."""
    path = F.regexp_replace(F.regexp_replace(url, r"^[a-zA-Z]+://[^/?#]*", ""), r"[?#].*$", "")
    return F.regexp_replace(path, r"(.)/$", "$1")


def broken_paths(pages: DataFrame) -> DataFrame:
    """Internal links that lead to no page, with how many pages have each."""
    known = pages.select(path_of(F.col("url")).alias("path")).distinct()
    inner = links_of(pages).filter(F.startswith("href", F.lit("/"))).select("page_id", path_of(F.col("href")).alias("path"))
    return inner.join(known, "path", "left_anti").groupBy("path").agg(F.countDistinct("page_id").alias("n_pages"), F.min("page_id").alias("first_page"))


def link_graph(pages: DataFrame) -> DataFrame:
    """Out-links of each page by kind."""
    kind = lambda k, c: F.count_if(c).alias(k)
    h = F.col("href")
    out = links_of(pages).groupBy("page_id").agg(F.count("*").alias("n_out"), kind("n_internal", h.startswith("/")), kind("n_external", h.rlike("^https?://")), F.countDistinct("href").alias("n_targets"))
    return pages.select("page_id").join(out, "page_id", "left").na.fill(0)


def in_degree(pages: DataFrame) -> DataFrame:
    return links_of(pages).groupBy("href").agg(F.countDistinct("page_id").alias("n_in"))


def head(element: Column) -> Column:
    """The opening tag of an element."""
    return F.regexp_extract(element, r"^(<[^>]*>)", 1)


def page_rules(pages: DataFrame) -> DataFrame:
    """Rules of a page's markup, broken ones only."""
    n = lambda p: F.regexp_count("html", F.lit(p))
    ids = F.regexp_extract_all("html", F.lit(r' id="([^"]*)"'), F.lit(1))
    images, blank = tags(F.col("html"), "img"), lambda c: F.coalesce(c, F.lit("")) == ""
    # outward links with what they say, as their opening tag and their content
    outward = F.filter(F.regexp_extract_all("html", F.lit(r"(?is)(<a\b[^>]*>.*?</a>)"), F.lit(1)), lambda t: F.coalesce(attribute(head(t), "href"), F.lit("")).rlike("(?i)^https:"))
    own_tab = lambda t: F.coalesce((attribute(head(t), "target") == "_blank") & attribute(head(t), "rel").rlike(r"\bnoopener\b"), F.lit(False))
    rules = [
        Rule("h1", "not exactly one h1", n(r"<h1[\s>]") != 1), Rule("title", "no title", n(r"<title>[^<]") == 0), Rule("description", "no description", n(r'<meta name="description"') == 0, "warning"), Rule("canonical", "no canonical address", n(r'<link rel="canonical" href="https://[^"]+">') == 0),
        Rule("id", "an id twice", F.size(F.array_distinct(ids)) < F.size(ids)), Rule("img", "image without alt", F.exists(images, lambda t: attribute(t, "alt").isNull())), Rule("img", "image without width and height", F.exists(images, lambda t: blank(attribute(t, "width")) | blank(attribute(t, "height")))),
        Rule("a", "plain http link", n(r'href="http://') > 0, "warning"), Rule("a", "empty link", n(r'href="#?"') > 0), Rule("a", "outward link without its own tab", F.exists(outward, lambda t: ~own_tab(t))), Rule("a", "outward link that does not say so", F.exists(outward, lambda t: ~F.contains(t, F.lit("(opens in a new tab)")))),
    ]
    return validate(pages, "page_id", rules)


def coverage(pages: DataFrame, listing: DataFrame) -> DataFrame:
    """Pages that a listing (url) lacks, and entries of it that are no page."""
    both = pages.select("url", F.lit(1).alias("p")).distinct().join(listing.select("url", F.lit(1).alias("l")).distinct(), "url", "full")
    return both.filter("p is null or l is null").select("url", F.when(F.col("l").isNull(), "not listed").otherwise("no page").alias("state"))


def over_budget(pages: DataFrame, budgets: DataFrame) -> DataFrame:
    """Rows of each class whose bytes exceed the class's budget."""
    rows = pages.withColumn("bytes", F.octet_length("html").cast("long")).join(budgets, "cls")
    return rows.groupBy("cls").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.count_if(F.col("bytes") > F.col("budget")).alias("n_over"), F.max("bytes").alias("largest"))


def digest(df: DataFrame) -> DataFrame:
    """One row that is the same for the same rows in any order."""
    h = F.xxhash64(*sorted(df.columns))
    return df.select(h.alias("h")).agg(F.count("*").alias("n"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("x"), F.coalesce(F.sum(F.pmod("h", F.lit(1_000_003))), F.lit(0)).alias("s"))


def same_twice(first: DataFrame, second: DataFrame) -> DataFrame:
    a, b = digest(first), digest(second)
    return a.join(b.toDF("n2", "x2", "s2"), F.lit(True)).select("n", ((F.col("n") == F.col("n2")) & (F.col("x") == F.col("x2")) & (F.col("s") == F.col("s2"))).alias("same"))
