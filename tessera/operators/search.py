"""Search over entries of several kinds: a normalised index, term scores, ranked and grouped hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import fold

# Fixed scores: a term at the start of a title, at the start of a word, anywhere; in the second line, in the keywords;
# the whole phrase as the title, at its start, anywhere; a kind that is preferred; an entry that is on, begins within SOON
# seconds, is over.
PREFIX, WORD, INSIDE, SUBLINE, KEYWORD, WHOLE, START, PHRASE, PREFERRED = 40, 30, 20, 8, 4, 100, 60, 30, 3
ON, COMING, OVER, SOON = 25, 15, -5, 3 * 3600
LIMIT = 200


def build_search_index(parts: list[DataFrame], kinds: list[str]) -> DataFrame:
    """Entries (kind, id, title, subline, keywords, ord and, if they have times, st and en) of known kinds, the first of each
    kind:id, with folded columns and the title's words."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    w = Window.partitionBy("kind", "id").orderBy("ord")
    rows = rows.filter(F.col("kind").isin(*kinds)).withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
    return rows.withColumns({"ft": fold(F.col("title")), "fs": fold(F.col("subline")), "fk": fold(F.col("keywords"))}).withColumn("fw", F.concat(F.lit(" "), F.regexp_replace("ft", r"[^\p{L}\p{N}']+", " ")))


def rank_search(index: DataFrame, queries: DataFrame, preferred: list[str], limit: int = LIMIT, now: int | None = None) -> DataFrame:
    """(qid, kind, id, score, rank, exact): entries that hold every term of a query, in the title, the second line or the
    keywords; exact: the query is the title. What scores below 0 is no hit. With ``now``, entries with times (st, en) score for
    being on, near or over.

    No query meets all entries: postings of up to three letters (key, kind, id), and nothing else, are met by the first letters of
    a query's two longest terms; what holds both is fetched once."""
    bare = lambda t: F.regexp_replace(t, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    q = queries.withColumn("phrase", F.trim(fold(F.col("query")))).withColumn("terms", F.filter(F.transform(F.split("phrase", r"[\s,]+"), bare), lambda t: t != "")).filter("size(terms) > 0")
    by_length = F.array_sort(F.transform(F.array_distinct("terms"), lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    q = q.withColumn("keys", F.array_distinct(F.transform(F.slice(by_length, 1, 2), lambda x: F.substring(x["t"], 1, 3))))
    asked = q.select("qid", F.size("keys").alias("of"), F.explode("keys").alias("g"))
    text = F.concat_ws(" ", "ft", "fs", "fk")
    of_size = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - (n - 1))), lambda i: F.substring(text, i, F.lit(n)))
    posted = index.select("kind", "id", F.explode(F.array_distinct(F.concat(of_size(1), of_size(2), of_size(3)))).alias("g"))
    met = posted.join(asked, "g").groupBy("qid", "kind", "id").agg(F.count("*").alias("n"), F.first("of").alias("of")).filter("n = of").select("qid", "kind", "id")
    times = ["st", "en"] if now is not None and {"st", "en"} <= set(index.columns) else []
    rows = met.join(index.select("kind", "id", "title", "ft", "fs", "fk", "fw", *times), ["kind", "id"]).join(q.select("qid", "phrase", "terms"), "qid")
    has = lambda c, t: F.contains(F.col(c), t)
    title = lambda t: F.when(F.startswith(F.col("ft"), t), PREFIX).when(has("fw", F.concat(F.lit(" "), t)), WORD).when(has("ft", t), INSIDE).otherwise(0)
    term = lambda t: title(t) + F.when(has("fs", t), SUBLINE).otherwise(0) + F.when(has("fk", t), KEYWORD).otherwise(0)
    long = F.length("phrase") > 1
    phrase = F.when(~long, 0).when(F.col("ft") == F.col("phrase"), WHOLE).when(F.startswith(F.col("ft"), F.col("phrase")), START).when(has("ft", F.col("phrase")), PHRASE).otherwise(0)
    total = F.aggregate("scores", F.lit(0), lambda a, x: a + x) + phrase + F.when(F.col("kind").isin(*preferred), PREFERRED).otherwise(0)
    if times:
        total = total + F.when((F.col("st") <= now) & (F.col("en") > now), ON).when((F.col("st") > now) & (F.col("st") - now < SOON), COMING).when(F.col("en") < now, OVER).otherwise(0)
    hits = rows.withColumn("scores", F.transform("terms", term)).filter(F.forall("scores", lambda x: x > 0)).withColumns({"score": total, "exact": long & (F.col("ft") == F.col("phrase"))}).filter("score >= 0")
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), "title", "kind", "id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select("qid", "kind", "id", "score", "rank", "exact")


def group_search(hits: DataFrame, order: list[str]) -> DataFrame:
    """Groups of each query's hits in fixed order; if the best hit's title is the query, its group leads."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("kind")).cast("int")
    groups = hits.groupBy("qid", "kind").agg(F.count("*").alias("n"), F.bool_or((F.col("rank") == 1) & F.col("exact")).alias("leads"), F.min(place).alias("p"))
    w = Window.partitionBy("qid").orderBy(F.col("leads").desc(), "p")
    return groups.select("qid", "kind", "n", F.row_number().over(w).alias("place"))


def match_spans(text: Column, query: Column) -> Column:
    """array<struct<start, end>>: where a text shows the terms of a query (of two letters or more), in code points of the text as
    it is, the end exclusive; in order, what overlaps made one.

    Terms are found in the folded text. Folding may drop a character or make several of it, so every folded character remembers
    which one it came from; a match covers all characters that it came from, and the marks behind the last of them."""
    bare = lambda t: F.regexp_replace(t, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    terms = F.filter(F.array_distinct(F.transform(F.split(F.trim(fold(query)), r"[\s,]+"), bare)), lambda t: F.length(t) > 1)
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    folded = F.transform(chars, fold)
    owner = F.flatten(F.transform(folded, lambda c, i: F.array_repeat(i, F.length(c))))
    whole = F.array_join(folded, "")
    starts = lambda t: F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(whole) - F.length(t))), lambda i: F.substring(whole, i + 1, F.length(t)) == t)
    # of one term, a match that begins inside the last one taken is none
    apart = lambda t: F.aggregate(starts(t), F.array().cast("array<int>"), lambda a, i: F.when((F.size(a) == 0) | (i >= F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(-1)) + F.length(t)), F.concat(a, F.array(i))).otherwise(a))
    after = lambda i: F.coalesce(F.get(owner, i), F.size(chars))
    spans = F.flatten(F.transform(terms, lambda t: F.transform(apart(t), lambda i: F.struct(F.get(owner, i).alias("start"), F.greatest(after(i + F.length(t)), F.get(owner, i + F.length(t) - 1) + 1).alias("end")))))
    kind = "array<struct<start:int,end:int>>"
    last = lambda a: F.try_element_at(a, F.lit(-1))
    joined = lambda a, x: F.when((F.size(a) > 0) & (x["start"] < F.coalesce(last(a)["end"], F.lit(-1))), F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(last(a)["start"].alias("start"), F.greatest(last(a)["end"], x["end"]).alias("end"))))).otherwise(F.concat(a, F.array(x)))
    return F.coalesce(F.aggregate(F.array_sort(spans).cast(kind), F.array().cast(kind), lambda a, x: joined(a, x).cast(kind)), F.array().cast(kind))


def marked_hits(hits: DataFrame, index: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, kind, id, title, spans) of hits: where each title shows its query."""
    rows = hits.join(index.select("kind", "id", "title"), ["kind", "id"]).join(queries.select("qid", "query"), "qid")
    return rows.select("qid", "kind", "id", "title", match_spans(F.col("title"), F.col("query")).alias("spans"))
