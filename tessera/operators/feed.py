"""Feed items: canonical addresses, allowlists, tags, and the refresh that joins them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.records import checkpointed

# Query parameters that only track where a reader came from, by name and by the start of the name.
TRACKING, TRACKING_STARTS = ("fbclid", "gclid", "ocid", "cmpid"), ("utm_", "mc_")
# Titles that are no stories, as patterns; a placeholder, markup or entities, a listing.
NO_STORY = (r"(?i)\b(?:tba|tbd|tbc|lorem ipsum)\b", r"</?[a-zA-Z][^>]*>|&(?:[a-zA-Z][a-zA-Z0-9]{1,31}|#[0-9]{1,7}|#x[0-9a-fA-F]{1,6});", r"(?i)^(?:events? calendar)\b|\bthings to do this weekend\b")


def host_of(url: Column) -> Column:
    """The host in small letters, without www; empty where there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1)), r"^www\.", "")


def form(value: Column) -> Column:
    """A value of a query string, decoded and encoded again, so that equal values are spelled alike."""
    plain = F.coalesce(F.try_url_decode(value), value)
    return F.replace(F.replace(F.url_encode(plain), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_url(url: Column) -> Column:
    """What addresses are compared by: host without www, path without trailing slashes, query without tracking parameters; no
    scheme and no fragment."""
    u = F.trim(url)
    path = F.regexp_replace(F.regexp_extract(u, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1), r"/+$", "")
    name = lambda p: F.substring_index(p, "=", 1)
    tracks = lambda p: name(p).isin(*TRACKING) | F.startswith(p, F.lit(TRACKING_STARTS[0])) | F.startswith(p, F.lit(TRACKING_STARTS[1]))
    pairs = F.filter(F.split(F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: (p != "") & ~tracks(p))
    kept = F.array_join(F.transform(pairs, lambda p: F.concat(form(name(p)), F.lit("="), form(F.substring(p, F.length(name(p)) + 2, F.length(p))))), "&")
    return F.concat(host_of(u), F.when(path == "", "/").otherwise(path), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def title_key(title: Column) -> Column:
    """Titles that differ in case, punctuation and spaces share a key."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9 ]", " "), r"\s+", " "))


def is_story(title: Column) -> Column:
    """Neither empty nor a placeholder, markup or a listing."""
    return F.coalesce((F.trim(title) != "") & ~title.rlike("|".join(f"(?:{p})" if not p.startswith("(?i)") else f"(?i:{p[4:]})" for p in NO_STORY)), F.lit(False))


@dataclass(frozen=True)
class Source:
    """A source that may be fed from: any needle in its name, or any domain that its host is or ends in."""

    label: str
    needles: tuple[str, ...] = ()
    domains: tuple[str, ...] = ()


def source_label(name: Column, url: Column, sources: list[Source]) -> Column:
    """The label of the first source that the name or the address of an item's source fits, null if none does. The list is a
    setting of some dozen entries and becomes one expression; a table of any length goes to ``allowlisted``."""
    low, host = F.lower(F.coalesce(name, F.lit(""))), host_of(F.coalesce(url, F.lit("")))
    any_of = lambda checks: F.coalesce(*(F.when(c, True) for c in checks), F.lit(False))
    fits = lambda x: any_of([F.contains(low, F.lit(n)) for n in x.needles] + [(host == d) | F.endswith(host, F.lit(f".{d}")) for d in x.domains])
    return F.coalesce(*(F.when(fits(x), x.label) for x in sources))


def allowlisted(items: DataFrame, rules: DataFrame, host: str) -> DataFrame:
    """Items whose host is, or ends in, a rule's domain (ord, domain, label), with the label of the first such rule. Each
    different host is spread over its own endings, so that rules are met by equal domains."""
    parts = F.split(host, r"\.")
    endings = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    hosts = items.select(host).distinct().withColumn("domain", F.explode(endings))
    hit = hosts.join(rules, "domain").groupBy(host).agg(F.min_by("label", "ord").alias("label"))
    return items.join(hit, host)


@dataclass(frozen=True)
class Tag:
    """A tag holds where a title has any of the words in any case, none of the ``never`` patterns in any case, and, if there is
    one, the ``cased`` pattern as it is written."""

    name: str
    words: tuple[str, ...]
    never: tuple[str, ...] = field(default=())
    cased: str | None = None


def tags(title: Column, rules: list[Tag]) -> Column:
    """The names of a title's tags, sorted."""
    low = F.lower(title)
    any_of = lambda checks: F.coalesce(*(F.when(c, True) for c in checks), F.lit(False))
    holds = lambda t: any_of([F.contains(low, F.lit(w)) for w in t.words]) & ~any_of([title.rlike(f"(?i){p}") for p in t.never]) & (title.rlike(t.cased) if t.cased else F.lit(True))
    return F.filter(F.array(*(F.when(holds(t), t.name) for t in sorted(rules, key=lambda t: t.name))), lambda x: x.isNotNull())


def taken_by_query(items: DataFrame, per_query: int) -> DataFrame:
    """items (query, ord, title_key): those that a reader takes who goes through one query after another, each in order, and
    leaves a query after ``per_query`` titles that were new.

    Every round finds the first item of each title and where that makes a query reach its cap; what lies behind falls out, and
    may make later queries reach theirs sooner. A cap only moves forward, and that of the n-th query stands after n rounds; the
    driver sees one row for each query that reaches it (queries are a setting)."""
    cuts: dict = {}
    items = checkpointed(items)
    kind = items.schema["query"].dataType
    while True:
        left = items
        if cuts:
            at = F.coalesce(*(F.when(F.col("query") == F.lit(q).cast(kind), F.lit(o)) for q, o in cuts.items()))
            left = items.filter(at.isNull() | (F.col("ord") <= at))
        first = left.groupBy("title_key").agg(F.min(F.struct("query", "ord")).alias("x")).select("x.*")
        nth = F.row_number().over(Window.partitionBy("query").orderBy("ord"))
        full = first.withColumn("nth", nth).filter(F.col("nth") == per_query).select("query", "ord")
        new = {r.query: r.ord for r in full.collect()}
        if all(cuts.get(q) == o for q, o in new.items()):
            return left
        cuts |= new


def feed_refresh(items: DataFrame, existing: DataFrame, now: int, days: int = 120, per_query: int = 25, per_run: int = 60) -> DataFrame:
    """items (id, query, ord, url, title, label, tags, t) of the answers to some queries, existing (url, title): what is new.

    Stories not older than ``days`` with a label and a tag count, unless their title is known already. Equal titles are one, the
    first by query and order, with the tags of all; a query gives at most ``per_query`` new ones, the run ``per_run``, newest
    first. What then leads to a known or repeated address, or not to https, goes."""
    rows = items.withColumn("title_key", title_key(F.col("title"))).filter(is_story(F.col("title")) & F.col("label").isNotNull() & (F.size("tags") > 0) & (F.col("t") >= now - days * 86400))
    rows = rows.join(existing.select(title_key(F.col("title")).alias("title_key")).distinct(), "title_key", "left_anti")
    rows = taken_by_query(rows.select("title_key", "query", "ord", "id", "url", "label", "tags", "t"), per_query)
    one = rows.groupBy("title_key").agg(F.min(F.struct("query", "ord", "id", "url", "label", "t")).alias("x"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"))
    newest = one.select("title_key", "x.*", F.array_join("tags", ",").alias("tags")).orderBy(F.col("t").desc(), "query", "ord").limit(per_run)
    newest = newest.filter(F.startswith("url", F.lit("https://"))).withColumn("key", canonical_url(F.col("url")))
    newest = newest.join(existing.select(canonical_url(F.col("url")).alias("key")).distinct(), "key", "left_anti")
    once = Window.partitionBy("key").orderBy(F.col("t").desc(), "query", "ord")
    return newest.withColumn("rn", F.row_number().over(once)).filter("rn = 1").select("title_key", "id", "label", "key", "t", "tags")


def current_feed(items: DataFrame, now: int, days: int = 120, per_label: int = 25) -> DataFrame:
    """items (id, url, title, label, tags, t): what a feed shows that is never read twice: of equal titles not older than ``days``
    the newest one with the tags of all, the newest ``per_label`` of each label."""
    rows = items.withColumns({"title_key": title_key(F.col("title")), "key": canonical_url(F.col("url"))}).filter(is_story(F.col("title")) & F.col("label").isNotNull() & (F.size("tags") > 0) & (F.col("t") >= now - days * 86400))
    first = F.min(F.struct((-F.col("t")).alias("age"), "id", "label", "key")).alias("x")
    one = rows.groupBy("title_key").agg(first, F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"))
    one = one.select("title_key", "x.id", "x.label", "x.key", (-F.col("x.age")).alias("t"), F.array_join("tags", ",").alias("tags"))
    return newest_of(one, per_label)


def newest_of(rows: DataFrame, per_label: int) -> DataFrame:
    w = Window.partitionBy("label").orderBy(F.col("t").desc(), "id")
    return rows.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= per_label).drop("nth")


def plan_state(toggles: DataFrame) -> DataFrame:
    """toggles (user_id, item, action, seq): what each user has starred after all of them. ``clear`` empties a plan; ``replace``
    does, and its rows (one an item, of one seq) fill it again; ``add`` stars items like ``star``; ``drop`` takes one out. Of a
    seq's own rows the emptying comes first; seq is otherwise the order, and rows of an item that share it are equal."""
    rows = toggles.select("user_id", "item", (F.col("action") != "drop").alias("on"), (F.col("action") == "clear").alias("clears"), F.col("seq"), F.when(F.col("action").isin("clear", "replace"), F.col("seq")).alias("reset"))
    resets = rows.groupBy("user_id").agg(F.max("reset").alias("last"))
    kept = rows.filter("not clears").drop("clears").join(resets, "user_id").filter(F.col("last").isNull() | (F.col("seq") > F.col("last")) | (F.col("reset") == F.col("last")))
    return kept.groupBy("user_id", "item").agg(F.max_by("on", "seq").alias("on")).filter("on").select("user_id", "item")


def status_changes(instances: DataFrame, ticks: DataFrame, since: int | None = None) -> DataFrame:
    """Statuses of instances (id, s, e) at ticks (tick), where they differ from the tick before; the first tick is compared
    with ``since``, the last one that was seen earlier, or stands for it. An instance changes near its start and its end
    only: each of these moments is shown at the first tick from then on, the last of several. Ticks needn't be even: a
    moment meets the ticks of its hour, or else the first of the next hour that has any."""
    hours = ticks.distinct().withColumn("hour", F.floor(F.col("tick") / 3600)).groupBy("hour").agg(F.array_sort(F.collect_list("tick")).alias("ticks"))
    before = Window.orderBy("hour")  # one row an hour of the batch
    hours = hours.select("ticks", F.col("hour").alias("until"), F.lag("hour").over(before).alias("prev"))
    start = F.floor(F.lit(since) / 3600) if since is not None else F.col("until")
    hours = hours.select("ticks", F.explode(F.sequence(F.coalesce(F.col("prev") + 1, start), "until")).alias("hour"))
    span = ticks.agg(F.min("tick").alias("t0"), F.max("tick").alias("t1")).first()
    if span.t0 is None:
        return instances.select(F.lit(0).cast("long").alias("tick"), "id", F.lit("").alias("status")).limit(0)
    low = span.t0 if since is None else since
    moments = instances.select("id", F.explode(F.array(*(F.struct(m.alias("m"), F.lit(k).alias("k")) for k, m in enumerate((F.col("s") - 1800, F.col("s"), F.col("e")))))).alias("x")).select("id", "x.m", "x.k")
    moments = moments.filter((F.col("m") > low) & (F.col("m") <= span.t1)).withColumn("hour", F.floor(F.col("m") / 3600))
    own = moments.join(hours, "hour").withColumn("at", F.get(F.filter("ticks", lambda t: t >= F.col("m")), F.lit(0)))
    late = own.filter("at is null").select("id", "m", "k", (F.col("hour") + 1).alias("hour")).join(hours, "hour").select("id", "m", "k", F.get("ticks", F.lit(0)).alias("at"))
    at = own.filter("at is not null").select("id", "m", "k", "at").unionByName(late)
    seen = at.groupBy("id", F.col("at").alias("tick")).agg(F.max(F.struct("m", "k")).alias("x"))
    return seen.select("tick", "id", F.element_at(F.array(*map(F.lit, ("soon", "live", "past"))), F.col("x.k") + 1).alias("status"))
