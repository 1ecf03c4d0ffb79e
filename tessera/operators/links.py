"""Links of a site: resolved from where they stand, and checked against its pages, their anchors and the queries they take.

A site is a table of pages (path, html); paths have no leading slash. All checks meet by equal keys, on what different links have
in common: a target that every page links to is looked up once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.records import checkpointed

#: What is wrong with a link, in the order in which it is told; only the first is.
KINDS = ("nowhere", "insecure", "scheme", "outside", "climbs", "broken", "no query", "unknown key", "bad value", "no anchor")


def markup(html: Column) -> Column:
    """Without comments and the content of scripts."""
    return F.regexp_replace(F.regexp_replace(html, r"(?is)(<script\b[^>]*>).*?(</script>)", "$1$2"), r"(?s)<!--.*?-->", "")


def attribute(tag: Column, name: str) -> Column:
    """A tag's attribute in double, single or no quotes, with the common entities decoded; null where it has none."""
    value = F.lit(None).cast("string")
    for pattern in (rf'(?i)\s{name}\s*=\s*"([^"]*)"', rf"(?i)\s{name}\s*=\s*'([^']*)'", rf"(?i)\s{name}\s*=\s*([^\s\"'>]+)"):
        value = F.coalesce(value, F.when(tag.rlike(pattern), F.regexp_extract(tag, pattern, 1)))
    for entity, char in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        value = F.replace(value, F.lit(entity), F.lit(char))
    return value


def tags(html: Column, names: str) -> Column:
    """The opening tags of the given names (a pattern), a quoted > included."""
    return F.regexp_extract_all(html, F.lit(rf"""(?i)(<(?:{names})\b(?:[^>"']|"[^"]*"|'[^']*')*>)"""), F.lit(1))


#: Where addresses stand: tags, attribute, and whether an https address is let alone unseen.
PLACES = (("a", "href", False), ("link", "href", True), ("img|script|source|iframe", "src", False), ("form", "action", False))


def addresses(html: Column) -> Column:
    """array<string>: all addresses of a page, those of srcset one by one."""
    of = lambda names, name: F.filter(F.transform(tags(html, names), lambda t: attribute(t, name)), lambda x: x.isNotNull())
    out = []
    for names, name, quiet in PLACES:
        found = of(names, name)
        out.append(F.filter(found, lambda x: ~x.startswith("https:")) if quiet else found)
    sets = F.flatten(F.transform(tags(html, "img|source"), lambda t: F.split(F.coalesce(attribute(t, "srcset"), F.lit("")), ",")))
    out.append(F.filter(F.transform(sets, lambda x: F.regexp_extract(x, r"^\s*(\S+)", 1)), lambda x: x != ""))
    return F.concat(*out)


def resolved(base: Column, path: Column, prefix: str) -> Column:
    """The page that a relative or absolute path names from where it stands: "." and ".." are taken out, what still leads upward
    keeps its dots, a folder is its index.html."""
    whole = F.when(path == "", base).when(F.startswith(path, F.lit("/")), F.substring(path, len(prefix) + 1, 1 << 20)).otherwise(F.concat(F.regexp_replace(base, r"[^/]*$", ""), path))
    last = lambda a: F.element_at(a, -1)
    step = lambda a, s: F.when((s == "") | (s == "."), a).when((s == "..") & (F.size(a) > 0) & (F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit("")) != ".."), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s)))
    clean = F.array_join(F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), step), "/")
    folder = (clean == "") | whole.rlike(r"(?:^|/)\.{0,2}$")
    return F.when(folder & F.when(clean.rlike(r"(?:^|/)\.\.$"), False).otherwise(True), F.when(clean == "", "index.html").otherwise(F.concat(clean, F.lit("/index.html")))).otherwise(clean)


def decoded(value: Column, form: bool = True) -> Column:
    """Percent signs decoded, and in a form's values plus signs; what isn't well formed stays."""
    return F.coalesce(F.try_url_decode(value if form else F.replace(value, F.lit("+"), F.lit("%2B"))), value)


def parsed(pages: DataFrame, prefix: str) -> DataFrame:
    """(path, ord, href, problem, target, fragment, query) of every address; problem is what its spelling alone tells."""
    rows = pages.select("path", F.posexplode(addresses(markup(F.col("html")))).alias("ord", "href"))
    h = F.col("href")
    bare = F.regexp_extract(h, r"^([^?#]*)", 1)
    known = h.rlike(r"(?i)^(?:https:|mailto:|tel:)") | h.rlike(r"^http://(?:localhost|127\.0\.0\.1)")
    outside = F.startswith(bare, F.lit("/")) & ~F.startswith(bare, F.lit(prefix))
    target = resolved(F.col("path"), bare, prefix)
    spelled = F.when(h == "#", "nowhere").when(h.rlike("(?i)^http:"), "insecure").when(h.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), "scheme").when(outside, "outside").when(F.startswith(target, F.lit("..")), "climbs")
    return rows.filter(~known).select(
        "path", "ord", "href", spelled.alias("problem"), F.when(spelled.isNull(), target).alias("target"), F.when(h.rlike("#."), F.regexp_extract(h, r"#(.*)$", 1)).alias("fragment"), F.when(h.rlike(r"^[^#]*\?"), F.regexp_extract(h, r"^[^?#]*\?([^#]*)", 1)).alias("query")
    )


def anchors(pages: DataFrame) -> DataFrame:
    """(path, anchor): the ids of all tags."""
    return pages.select("path", F.explode(F.array_distinct(F.transform(F.regexp_extract_all(markup(F.col("html")), F.lit(r"""(<[a-zA-Z](?:[^>"']|"[^"]*"|'[^']*')*\sid=(?:[^>"']|"[^"]*"|'[^']*')*>)"""), F.lit(1)), lambda t: attribute(t, "id")))).alias("anchor"))


def link_problems(pages: DataFrame, params: DataFrame, values: DataFrame, prefix: str = "/", files: DataFrame | None = None) -> DataFrame:
    """(path, ord, href, kind, detail) of every link that is wrong.

    params (path, key, rule): the queries that a page takes; rule "any" lets all values pass, "one" those in values (path, key,
    value), "list" several of them with commas between. files (path): what is there besides pages. A page is a path that ends in
    .html; only pages have queries and anchors to be wrong about."""
    links = checkpointed(parsed(pages, prefix))
    there = pages.select("path") if files is None else pages.select("path").unionByName(files.select("path"))
    inner = links.filter("problem is null")
    missing = checkpointed(inner.select("target").distinct().join(there.select(F.col("path").alias("target")).distinct(), "target", "left_anti"))
    page = F.endswith("target", F.lit(".html"))

    asked = inner.filter(F.col("query").isNotNull() & page).select("path", "ord", "target", "query")
    pairs = F.filter(F.split("query", "&"), lambda p: p != "")
    pair = lambda p: F.struct(decoded(F.substring_index(p, "=", 1)).alias("key"), decoded(F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "^[^=]*=", "")).otherwise("")).alias("value"))
    each = checkpointed(asked.select("path", "ord", "target", F.explode_outer(F.transform(pairs, pair)).alias("x")).select("path", "ord", "target", "x.key", "x.value"))
    rules = params.select(F.col("path").alias("target"), "key", "rule").distinct()
    deaf = each.select("target").distinct().join(rules.select("target").distinct(), "target", "left_anti").select("target", F.lit("no query").alias("kind"))
    different = each.filter("key is not null").select("target", "key", "value").distinct()
    ruled = different.join(rules, ["target", "key"], "left")
    unknown = ruled.filter("rule is null").join(deaf.select("target"), "target", "left_anti").select("target", "key", "value")
    words = F.when(F.col("rule") == "list", F.split("value", ",", -1)).otherwise(F.array("value"))
    bad = ruled.filter("rule in ('one', 'list')").select("target", "key", "value", F.explode(words).alias("word"))
    allowed = values.select(F.col("path").alias("target"), "key", F.col("value").alias("word")).distinct()
    bad = bad.join(allowed, ["target", "key", "word"], "left_anti").select("target", "key", "value").distinct()
    wrong = unknown.withColumn("kind", F.lit("unknown key")).unionByName(bad.withColumn("kind", F.lit("bad value")))

    held = inner.filter(F.col("fragment").isNotNull() & page).withColumn("anchor", decoded(F.col("fragment"), False))
    lost = held.select("target", "anchor").distinct().join(anchors(pages).withColumnRenamed("path", "target"), ["target", "anchor"], "left_anti")
    at = ["path", "ord"]
    told = [
        links.filter("problem is not null").select(*at, F.col("problem").alias("kind"), F.lit("").alias("detail")),
        inner.join(missing, "target").select(*at, F.lit("broken").alias("kind"), F.col("target").alias("detail")),
        each.join(checkpointed(deaf), "target").select(*at, "kind", F.col("target").alias("detail")),
        each.join(checkpointed(wrong), ["target", "key", "value"]).select(*at, "kind", F.concat_ws("=", "key", F.when(F.col("kind") == "bad value", F.col("value"))).alias("detail")),
        held.join(checkpointed(lost), ["target", "anchor"]).select(*at, F.lit("no anchor").alias("kind"), F.col("anchor").alias("detail")),
    ]
    every = told[0]
    for more in told[1:]:
        every = every.unionByName(more)
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    first = every.groupBy(*at).agg(F.min(F.struct(rank.alias("rank"), "kind", "detail")).alias("x")).select(*at, "x.kind", "x.detail")
    return first.join(links.select(*at, "href"), at).select(*at, "href", "kind", "detail")
