"""Merging records of many sources, resolving references, and reporting every decision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.geo import metres
from tessera.functions.text import fold
from tessera.operators import nested
from tessera.sources.shared import scratch


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage of a loop by a table in the shared folder."""
    to = scratch(df.sparkSession, "loop")
    df.write.parquet(to)
    return df.sparkSession.read.schema(df.schema).parquet(to)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with the running number of each row in order, without a task that holds them all: rows are dealt out by range and
    numbered in their part, and the sizes of the parts say where each begins."""
    dealt = checkpointed(df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    begins = dealt.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy("_part").orderBy(*order)
    return dealt.join(begins, "_part").withColumn(name, F.col("_ahead") + F.row_number().over(inside)).drop("_part", "_ahead")


def name_key(c: Column) -> Column:
    """Names that differ in case, punctuation, a leading article or a legal suffix share a key."""
    words = F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))
    return F.regexp_replace(F.regexp_replace(words, r"^the ", ""), r" (?:inc|llc|ltd|co)$", "")


def first_by(c: str, order: str) -> Column:
    """The first non-null value in source order."""
    return F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order)))


def merge_first_non_null(df: DataFrame, key: str, order: str, scalars: list[str], lists: list[str]) -> DataFrame:
    """One row a key: scalars are the first non-null by order, lists the union of all."""
    return df.groupBy(key).agg(*(first_by(c, order).alias(c) for c in scalars), *(F.array_join(F.array_sort(F.collect_set(c)), ",").alias(c) for c in lists), F.count("*").alias("n"))


def remap_ids(df: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """table (drop, keep): ids that were found to be the same; the rest stay."""
    t = table.select(F.col("drop").alias("_d"), F.col("keep").alias("_k"))
    return df.join(t, F.col(column) == F.col("_d"), "left").withColumn(column, F.coalesce("_k", column)).drop("_d", "_k")


def merge_people(df: DataFrame) -> DataFrame:
    """df (id, name, program, bio, ord): rows of one id and one normalised name merge; a further name under the same id keeps
    its rows apart as id-program."""
    rows = df.withColumn("key", name_key(F.col("name")))
    lead = rows.groupBy("id").agg(F.min_by("key", "ord").alias("lead"))
    rows = rows.join(lead, "id").withColumn("id", F.when(F.col("key") == F.col("lead"), F.col("id").cast("string")).otherwise(F.concat_ws("-", "id", "program")))
    return merge_first_non_null(rows, "id", "ord", ["name", "bio"], ["program"])


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, group): the least id that equal keys connect. edges (id, key); each round every key tells its ids the least
    group it has seen, until nothing moves."""
    labels = checkpointed(nodes.select("id", F.col("id").alias("group")))
    edges = checkpointed(edges.distinct())
    while True:
        keys = edges.join(labels, "id").groupBy("key").agg(F.min("group").alias("g"))
        told = edges.join(keys, "key").groupBy("id").agg(F.min("g").alias("g"))
        new = checkpointed(labels.join(told, "id", "left").select("id", F.least("group", F.coalesce("g", "group")).alias("group"), (F.coalesce("g", "group") < F.col("group")).alias("moved")))
        labels = new.select("id", "group")
        if not new.filter("moved").limit(1).count():
            return labels


# How the words of an address are shortened.
SHORT = {
    "first": "1st", "second": "2nd", "third": "3rd", "fourth": "4th", "fifth": "5th", "sixth": "6th", "seventh": "7th", "eighth": "8th", "ninth": "9th", "tenth": "10th",
    "street": "st", "avenue": "ave", "east": "e", "west": "w", "north": "n", "south": "s", "boulevard": "blvd", "drive": "dr", "road": "rd", "place": "pl",
}


def plain_key(c: Column) -> Column:
    """Folded letters and digits, & as "and", one space for all else."""
    return F.trim(F.regexp_replace(F.replace(fold(c), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))


def loose_key(c: Column) -> Column:
    """Names that differ in accents, case, punctuation, brackets or a leading article share it."""
    return F.regexp_replace(plain_key(F.regexp_replace(F.coalesce(c, F.lit("")), r"\([^)]*\)", " ")), "^the ", "")


def tight_key(c: Column) -> Column:
    return F.replace(loose_key(c), F.lit(" "), F.lit(""))


def address_key(c: Column) -> Column:
    """House number and street in short words; null without a number."""
    words = F.split(plain_key(F.regexp_extract(F.coalesce(c, F.lit("")), "^([^,]*)", 1)), " ")
    short = F.create_map(*(F.lit(x) for pair in SHORT.items() for x in pair))
    key = F.array_join(F.transform(words, lambda w: F.coalesce(F.element_at(short, w), w)), " ")
    return F.when(key.rlike("^[0-9]"), key)


def merge_orgs(rows: DataFrame, same: DataFrame | None = None) -> DataFrame:
    """One row for each organisation of rows (slice, ord, id, name, logo, url, roles: array of program, relationship, tier).

    Names that differ in their loose parts or a legal ending are one, and so are keys that ``same`` (key, is) calls the same. name,
    logo and url are the first there are, roles all different ones in the order of their first row. The id is the first row's; where
    an earlier organisation has it, the slice is added."""
    rows = rows.withColumn("key", tight_key(F.regexp_replace("name", r"(?i)\b(?:inc|llc|co)\.?$", "")))
    if same is not None:
        rows = rows.join(same.select("key", F.col("is").alias("_is")), "key", "left").withColumn("key", F.coalesce("_is", "key")).drop("_is")
    rows = checkpointed(rows)
    each = rows.select("key", "ord", F.posexplode("roles").alias("pos", "r")).select("key", "ord", "pos", "r.program", "r.relationship", "r.tier")
    different = each.groupBy("key", "program", "relationship", "tier").agg(F.min(F.struct("ord", "pos")).alias("at"))
    role = F.struct("at", F.struct("program", "relationship", "tier").alias("role"))
    roles = different.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(role)), lambda x: x["role"]).alias("roles"))
    one = rows.groupBy("key").agg(F.min("ord").alias("lead"), *(first_by(c, "ord").alias(c) for c in ("name", "logo", "url")), F.min_by("id", "ord").alias("id"), F.min_by("slice", "ord").alias("slice"), F.count_distinct("slice").alias("n_slices"))
    nth = F.row_number().over(Window.partitionBy("id").orderBy("lead"))
    ids = F.when(nth == 1, F.col("id").cast("string")).otherwise(F.concat_ws("-", "id", "slice"))
    none = F.array().cast(rows.schema["roles"].dataType)
    return one.withColumn("org", ids).join(roles, "key", "left").select("key", F.col("org").alias("id"), "name", "logo", "url", F.coalesce("roles", none).alias("roles"), "n_slices")


def stay_keys(rows: DataFrame) -> DataFrame:
    """(id, key) of rows (row, stay, name, address): the stay's own id, its address with the leading word of its name (one house may
    hold two of them), and its name without spaces."""
    brand = F.regexp_extract(loose_key(F.col("name")), "^([^ ]*)", 1)
    place = F.when(address_key(F.col("address")).isNotNull(), F.concat(F.lit("a:"), address_key(F.col("address")), F.lit("|"), brand))
    keys = F.array(F.concat(F.lit("id:"), F.col("stay").cast("string")), place, F.when(tight_key(F.col("name")) != "", F.concat(F.lit("n:"), tight_key(F.col("name")))))
    return rows.select(F.col("row").alias("id"), F.explode(F.filter(keys, lambda k: k.isNotNull())).alias("key"))


def merge_stays(rows: DataFrame, scalars: list[str]) -> DataFrame:
    """rows (row, slice, stay, name, address and scalars) that keys connect are one stay: (group, stay, n, slices and the first
    value of each scalar by row). Connected in the usual sense: what two rows share with a third makes them one."""
    groups = components(stay_keys(rows), rows.select(F.col("row").alias("id"))).select(F.col("id").alias("row"), "group")
    both = rows.join(groups, "row")
    return both.groupBy("group").agg(F.min_by("stay", "row").alias("stay"), F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(F.col("slice").cast("string"))), "+").alias("slices"), *(first_by(c, "row").alias(c) for c in scalars))


def alias_join(df: DataFrame, text: str, names: DataFrame, aliases: DataFrame) -> DataFrame:
    """Free text to an id: names come before aliases, a later alias replaces an earlier one; unknown texts have none."""
    rows = names.select(name_key(F.col("name")).alias("key"), "id", F.lit(0).alias("p"), F.lit(0).cast("long").alias("o")).unionByName(aliases.select(name_key(F.col("alias")).alias("key"), "id", F.lit(1).alias("p"), (-F.col("ord")).cast("long").alias("o")))
    table = rows.groupBy("key").agg(F.min_by("id", F.struct("p", "o", "id")).alias("found"))
    return df.withColumn("key", name_key(F.col(text))).join(table, "key", "left").drop("key")


def dangling_refs(references: DataFrame, targets: DataFrame) -> DataFrame:
    """references (id, path, kind, ref) without a row (kind, id) among the targets. Different references are looked up once each,
    so that one which a third of all rows make is no hot key there, and a plain join brings the rows back."""
    references = checkpointed(references)
    lost = references.select("kind", "ref").distinct().join(targets.select("kind", F.col("id").cast("string").alias("ref")).distinct(), ["kind", "ref"], "left_anti")
    return references.join(checkpointed(lost), ["kind", "ref"]).select("id", "path", "kind", "ref")


def referenced_only(df: DataFrame, references: DataFrame, key: str) -> DataFrame:
    return df.join(references.select(key).distinct(), key, "left_semi")


def enrich_fill(df: DataFrame, side: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Fills what is missing, and only that; says how many fields each row got."""
    s = side.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_{c}") for c in columns))
    rows = df.join(s, F.col(key) == F.col("_k"), "left")
    got = sum(((F.col(c).isNull() & F.col(f"_{c}").isNotNull()).cast("int") for c in columns), F.lit(0))
    return rows.withColumn("n_filled", got).withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).drop("_k", *(f"_{c}" for c in columns))


def plan_join(plans: DataFrame, items: DataFrame) -> DataFrame:
    """Items known and unknown in each plan."""
    return plans.join(items.select("id", F.lit(1).alias("known")).distinct(), "id", "left").groupBy("user_id").agg(F.count("known").alias("n_known"), F.count_if(F.col("known").isNull()).alias("n_unknown"))


def recon_fields(a: DataFrame, b: DataFrame, key: list[str], field: str) -> DataFrame:
    """Both directions of a comparison by key: missing here, missing there, or differing."""
    x, y = a.select(*key, F.col(field).alias("x"), F.lit(1).alias("in_a")), b.select(*key, F.col(field).alias("y"), F.lit(1).alias("in_b"))
    state = F.when(F.col("in_a").isNull(), "missing_a").when(F.col("in_b").isNull(), "missing_b").when(F.col("x").eqNullSafe(F.col("y")), "same").otherwise("differs")
    return x.join(y, key, "full").withColumn("state", state).select(*key, "state")


def window_check(df: DataFrame, programs: DataFrame, slack: int = 1) -> DataFrame:
    """Rows whose day lies outside their program's days."""
    return df.join(programs, "program").filter((F.col("day") < F.col("a") - slack) | (F.col("day") > F.col("b") + slack))


def mutual_best(pairs: DataFrame) -> DataFrame:
    """One-to-one matching of pairs (a, b, cost), least cost first, ties by a and b: pairs that are the best of both their
    sides are taken together, what they use up goes, and so on; that gives what taking one pair at a time would."""
    left, out = checkpointed(pairs), None
    while True:
        order = F.struct("cost", "a", "b")
        best_a, best_b = left.groupBy("a").agg(F.min(order).alias("x")), left.groupBy("b").agg(F.min(order).alias("y"))
        taken = checkpointed(best_a.join(best_b, F.col("x") == F.col("y")).select("x.a", "x.b", "x.cost"))
        if not taken.limit(1).count():
            return out if out is not None else taken
        out = taken if out is None else out.unionByName(taken)
        left = checkpointed(left.join(taken.select("a"), "a", "left_anti").join(taken.select("b"), "b", "left_anti"))


def match_tiers(entries: DataFrame, works: DataFrame, radius: int = 200, least: int = 100, far: int = 9999) -> DataFrame:
    """One-to-one matches (a, b, tier, metres) of entries (id, title, credits, category, zone, lat, lng, reach) with works (id,
    title, credits, category, zone, lat, lng), strongest evidence first, the nearer first within a tier:
    0 title and credit, 1 credit (same category, within ``radius``), 2 title (same category and zone, within ``radius``),
    3 location (same category and zone, the work names nobody, within the entry's reach or ``least`` metres).

    A title matches if both are equal or share a word; a credit if both name somebody. Points without coordinates count as
    near and ``far`` away. Candidates meet on equal keys only: a shared name, word, category and zone, and cells of a grid where
    both have a place.

    The tiers are matched one after the other, and in a tier what has places before what lacks one, as that is the order of the
    evidence: what is used up meets nothing in a later one. Where a place is missing all pairs are equally far, so that the first
    entries of each key win: a work gets one of as many as there are works of its category (and zone), as those before it have each
    got another one of these."""
    from tessera.operators.geo import met, rings

    words = lambda c: F.array_distinct(F.filter(F.split(fold(F.col(c)), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 2))
    names = lambda c: F.array_distinct(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda n: fold(F.trim(n))))
    side = lambda rows, s, *more: checkpointed(rows.select(F.col("id").alias(s), words("title").alias("words"), names("credits").alias("names"), "category", "zone", F.col("lat").alias(f"{s}lat"), F.col("lng").alias(f"{s}lng"), *more))
    x, y, out = side(entries, "a", F.greatest("reach", F.lit(least)).alias("reach")), side(works, "b"), []
    on_map = lambda rows, s: rows.filter(f"{s}lat is not null and {s}lng is not null")
    lost = lambda rows, s: rows.filter(f"{s}lat is null or {s}lng is null")
    apart = F.coalesce(metres(F.col("alat"), F.col("alng"), F.col("blat"), F.col("blng")), F.lit(far)).alias("metres")

    def matched(tier: int, pairs: DataFrame) -> None:
        """Takes the best of the pairs (a, b, metres) out of x and y."""
        nonlocal x, y
        taken = mutual_best(pairs.select("a", "b", F.struct(F.lit(tier).alias("tier"), F.col("metres").cast("long").alias("metres")).alias("cost")))
        out.append(taken)
        x, y = checkpointed(x.join(taken.select("a"), "a", "left_anti")), checkpointed(y.join(taken.select("b"), "b", "left_anti"))

    keyed = lambda rows, s, *key: rows.select(s, f"{s}lat", f"{s}lng", *key)
    of = lambda rows, s: keyed(rows.withColumn("name", F.explode("names")).withColumn("word", F.explode("words")), s, "name", "word")
    matched(0, of(x, "a").join(of(y, "b"), ["name", "word"]).select("a", "b", apart))

    for tier, what, more in ((1, "names", ["category"]), (2, "words", ["category", "zone"])):
        key = ["key", *more]
        of = lambda rows, s: keyed(rows.withColumn("key", F.explode(what)), s, *key)  # noqa: B023, E731
        near = lambda: met(of(on_map(x, "a"), "a"), of(on_map(y, "b"), "b"), radius, "b", tuple(key)).select("a", "b", "metres")  # noqa: B023, E731

        def unplaced(first: bool) -> DataFrame:
            """Pairs of which one has no place, of entries that come first in their key, if those can win alone."""
            n, nth = y.groupBy(*more).agg(F.count("*").alias("n")), F.row_number().over(Window.partitionBy(*key).orderBy("a"))  # noqa: B023
            some = lambda rows: of(rows, "a").withColumn("nth", nth).join(n, more).filter((F.col("nth") <= F.col("n")) | F.lit(not first)).drop("nth", "n")  # noqa: B023, E731
            return some(x).join(of(lost(y, "b"), "b"), key).select("a", "b", apart).unionByName(some(lost(x, "a")).join(of(on_map(y, "b"), "b"), key).select("a", "b", apart))  # noqa: B023

        if radius < far:
            matched(tier, near())
            matched(tier, unplaced(True))
        else:
            matched(tier, near().unionByName(unplaced(False)))

    before, most = 0, on_map(x, "a").agg(F.max("reach")).first()[0]
    for r in rings(int(most)) if most is not None else []:
        nobody = on_map(y.filter("size(names) = 0"), "b")
        if not nobody.limit(1).count():
            break
        reaching = on_map(x, "a").filter(F.col("reach") > before).select("a", "alat", "alng", "category", "zone", "reach")
        pairs = met(reaching, keyed(nobody, "b", "category", "zone"), r, "b", ("category", "zone"))
        matched(3, pairs.filter(F.col("metres") <= F.col("reach")).select("a", "b", "metres"))
        before = r
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found.select("a", "b", "cost.tier", "cost.metres")


def merged_with_log(rows: DataFrame, fields: list[str], drops: dict[str, Column], region: tuple[int, int, int, int], order: str = "ord") -> tuple[DataFrame, DataFrame]:
    """(records, log) of rows (id, slice, order, lat, lng and fields) of many slices, both from one stored pass.

    Rows that fit a reason of ``drops`` (the first one) go, the others of an id are one record: each field its first value by
    order, and the first full pair of coordinates, unless it lies outside the region. The log (decision, id, source, detail) has a
    row for every input that isn't a record's first (drop, with the reason; merge, with the order of the first), for every field
    that comes from a later row (fill) or from none (gap), for coordinates taken away (geo), and one for each slice read (input,
    with its number of rows)."""
    wrong = F.coalesce(*(F.when(c, reason) for reason, c in drops.items())) if drops else F.lit(None).cast("string")
    rows = checkpointed(rows.withColumn("_wrong", wrong))
    kept = rows.filter("_wrong is null")
    at = lambda c: F.min(F.when(c, F.col(order)))
    placed = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    point = F.min_by(F.struct("lat", "lng"), F.when(placed, F.col(order)))
    per = kept.groupBy("id").agg(F.count("*").alias("n"), F.min(order).alias("lead"), *(first_by(f, order).alias(f) for f in fields), *(at(F.col(f).isNotNull()).alias(f"_{f}") for f in fields), F.when(at(placed).isNotNull(), point).alias("point"))
    inside = F.col("point.lat").between(region[0], region[1]) & F.col("point.lng").between(region[2], region[3])
    per = checkpointed(per.withColumn("inside", inside))
    records = per.select("id", "n", *fields, *(F.when(F.col("inside"), F.col(f"point.{c}")).alias(c) for c in ("lat", "lng")))
    entry = lambda df, decision, source, detail: df.select(F.lit(decision).alias("decision"), F.col("id").cast("string").alias("id"), source.cast("string").alias("source"), detail.cast("string").alias("detail"))
    none = F.lit(None)
    told = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"_{f}").alias("source")) for f in fields))).alias("x")
    each = per.select("id", "lead", told).select("id", "lead", "x.*")
    log = entry(rows.filter("_wrong is not null"), "drop", F.col(order), F.col("_wrong"))
    for more in (
        entry(kept.join(per.select("id", "lead"), "id").filter(F.col(order) != F.col("lead")), "merge", F.col(order), F.col("lead")),
        entry(each.filter("source <> lead"), "fill", F.col("source"), F.col("field")), entry(each.filter("source is null"), "gap", none, F.col("field")),
        entry(per.filter("not inside"), "geo", none, F.concat_ws(", ", "point.lat", "point.lng")), entry(rows.groupBy(F.col("slice").alias("id")).agg(F.count("*").alias("n")), "input", none, F.col("n")),
    ):
        log = log.unionByName(more)
    return records, log


def balance(log: DataFrame, records: DataFrame) -> DataFrame:
    """(n_read, n_dropped, n_merged, n_records, adds_up): what was read is what was dropped, merged or is a record."""
    n = lambda d: F.count_if(F.col("decision") == d)
    sums = log.agg(F.coalesce(F.sum(F.when(F.col("decision") == "input", F.col("detail").cast("long"))), F.lit(0)).alias("n_read"), n("drop").alias("n_dropped"), n("merge").alias("n_merged"))
    return sums.join(records.agg(F.count("*").alias("n_records")), F.lit(True)).withColumn("adds_up", F.expr("n_read = n_dropped + n_merged + n_records"))


def role_inference(credits: DataFrame, rules: DataFrame) -> DataFrame:
    """credits (person, event, ord, label, curated, kind, roles): one role for each person and event. The first credit line
    with a label decides: the role of the first rule (ord, needle, role) whose needle it holds, else the person's first role
    or artist. Without one: curator for who curated the event, a person's only role, the first role that the kind of event
    prefers, the first role, artist. Labels are matched once each, whatever the number of credits."""
    labels = credits.filter("label is not null").select("label").distinct()
    hit = labels.join(rules, F.contains(F.lower("label"), F.col("needle"))).groupBy("label").agg(F.min_by(F.col("role"), F.col("ord")).alias("found"))
    per = credits.groupBy("person", "event").agg(F.min_by("label", F.when(F.col("label").isNotNull(), F.col("ord"))).alias("label"), F.bool_or("curated").alias("curated"), F.first("kind").alias("kind"), F.min_by("roles", "ord").alias("roles"))
    first = F.coalesce(F.get("roles", F.lit(0)), F.lit("artist"))
    listed = lambda *x: F.array(*map(F.lit, x))
    wanted = F.when(F.col("kind").isin("exhibition", "installation"), listed("artist", "curator")).when(F.col("kind").isin("keynote", "talk", "panel", "fireside", "screening"), listed("speaker", "moderator", "curator", "artist")).otherwise(listed("performer", "speaker", "artist"))
    by_kind = F.get(F.filter(wanted, lambda r: F.array_contains("roles", r)), F.lit(0))
    role = F.when(F.col("label").isNotNull(), F.coalesce("found", first)).when(F.col("curated"), "curator").when(F.size("roles") == 1, first).otherwise(F.coalesce(by_kind, first))
    return per.join(hit, "label", "left").select("person", "event", role.alias("role"))


def page_policy(people: DataFrame, bridge: DataFrame) -> DataFrame:
    """kept: with a bio, a photo, a page already or a key role on a session of the week; others become text credits."""
    key = bridge.groupBy("person").agg(F.bool_or("key_role").alias("key_role"))
    return people.join(key, "person", "left").select("person", (F.coalesce("bio", F.lit(False)) | F.coalesce("photo", F.lit(False)) | F.coalesce("already", F.lit(False)) | F.coalesce("key_role", F.lit(False))).alias("kept"))


# Entities by name and what they stand for.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ndash": "–", "mdash": "—", "rsquo": "’", "lsquo": "‘", "rdquo": "”", "ldquo": "“", "hellip": "…", "eacute": "é", "egrave": "è", "aacute": "á", "oacute": "ó",
    "uacute": "ú", "iacute": "í", "ntilde": "ñ", "uuml": "ü", "ouml": "ö", "auml": "ä", "ccedil": "ç", "reg": "®", "copy": "©", "trade": "™", "bull": "•", "middot": "·", "deg": "°",
}


def decode_entities(c: Column) -> Column:
    """Entities by name and by number become characters, each once; unknown names and impossible numbers stay."""
    names = F.create_map(*(F.lit(x) for pair in ENTITIES.items() for x in pair))

    def char(e: Column) -> Column:
        body = F.substring(e, 2, F.length(e) - 2)
        hexed = F.when(body.rlike("^#[xX]"), F.substring(body, 3, 6)).when(F.startswith(body, F.lit("#")), F.conv(F.substring(body, 2, 7), 10, 16))
        point = F.conv(hexed, 16, 10).cast("long")
        sound = (point > 0) & (point < 0x110000) & ~point.between(0xD800, 0xDFFF)
        spelled = F.decode(F.unhex(F.lpad(hexed, 8, "0")), "UTF-32")
        return F.coalesce(F.when(sound, spelled), F.element_at(names, body), F.element_at(names, F.lower(body)), e)

    # the text between entities and the entities themselves, in turn
    found = F.regexp_extract_all(c, F.lit(r"(&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,31});)"), F.lit(1))
    between = F.split(c, r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,31});", -1)
    return F.when(F.size(found) == 0, c).otherwise(F.array_join(F.zip_with(between, found, lambda t, e: F.concat(t, F.coalesce(char(e), F.lit("")))), ""))


def text_clean(c: Column) -> Column:
    """Verbatim text in normal form: line ends and spaces of one kind, no zero-width characters, entities decoded, <br> a line
    end, other tags gone, one space between words, no space around lines, at most one empty line; null where nothing is left."""
    out = F.regexp_replace(F.translate(F.regexp_replace(c, r"\r\n?", "\n"), "\u00a0", " "), "[\u200b\u200c\u200d\u2060\ufeff]", "")
    out = F.regexp_replace(F.regexp_replace(decode_entities(out), r"(?i)<br\s*/?>", "\n"), r"</?[a-zA-Z][^>]*>", "")
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r" ?\n ?", "\n"), r"\n{3,}", "\n\n")
    return F.nullif(F.regexp_replace(out, r"^\s+|\s+$", ""), F.lit(""))


def scrubbed(c: Column, marker: str) -> Column:
    """Without what points at the inside of a work: brackets and sentences that match ``marker``; null where nothing is left."""
    out = F.regexp_replace(c, rf"(?i)\s*\([^()]*(?:{marker})[^()]*\)", "")
    sentences = lambda p: F.split(F.regexp_replace(p, r"([.!?])\s+", "$1\u0001"), "\u0001")
    kept = lambda p: F.array_join(F.filter(sentences(p), lambda x: ~x.rlike(f"(?i){marker}")), " ")
    parts = F.filter(F.transform(F.split(out, "\n\n"), kept), lambda p: p != "")
    touched = F.regexp_replace(F.array_join(parts, "\n\n"), r"^\s+|\s+$", "")
    return F.when(c.rlike(f"(?i){marker}"), F.nullif(touched, F.lit(""))).otherwise(c)


def cleaning(marker: str | None = None) -> Callable[[Column], Column]:
    """What a cleaning job does to each text."""
    return (lambda c: scrubbed(text_clean(c), marker)) if marker else text_clean


def cleaned(df: DataFrame, key: str, marker: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(df with every text of every column, nested ones included, in normal form and without marked sentences; the log of it: one
    row (id, path, before, after) for each changed text). Both come from one stored pass over df."""
    kept = checkpointed(df)
    return nested.rewritten(kept, cleaning(marker), (key,)), nested.changed_cells(kept, cleaning(marker), key)


def unique_ids(df: DataFrame, base: str, order: str) -> DataFrame:
    """The first of equal slugs stays, the others get -2, -3 in order."""
    nth = F.row_number().over(Window.partitionBy(base).orderBy(order))
    return df.withColumn("unique_id", F.when(nth == 1, F.col(base)).otherwise(F.concat_ws("-", base, nth)))


def changelog(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row for each changed field of each record: added and removed records change all fields."""
    a = old.select(key, F.lit(1).alias("in_old"), *(F.col(f).cast("string").alias(f"o_{f}") for f in fields))
    b = new.select(key, F.lit(1).alias("in_new"), *(F.col(f).cast("string").alias(f"n_{f}") for f in fields))
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"o_{f}").alias("old"), F.col(f"n_{f}").alias("new")) for f in fields))
    state = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").otherwise("changed")
    return a.join(b, key, "full").select(key, state.alias("state"), F.explode(each).alias("x")).filter(~F.col("x.old").eqNullSafe(F.col("x.new"))).select(key, "state", "x.field", "x.old", "x.new")


def facts_union(explicit: DataFrame, derived: DataFrame) -> DataFrame:
    """Facts of record and derived ones; of the same (program, key, url) one stays, the explicit one first; quoted ones all stay."""
    rows = explicit.withColumn("src", F.lit(0)).unionByName(derived.withColumn("src", F.lit(1)))
    w = Window.partitionBy("program", "key", "url").orderBy("src", "ord")
    loose = rows.filter("not quoted").withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
    return loose.unionByName(rows.filter("quoted"))
