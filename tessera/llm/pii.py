"""Personal data: generators propose overlapping spans, boosted trees score them, calibrated thresholds choose.

Base spans (e-mail addresses, IPv4 addresses, payment cards, telephone numbers that pass their checks) always stay. Looser
generators propose more: numbers without a country code, card-like groups, spelled-out addresses, IPv6, and every match of
a base pattern whatever its checks. Format and context features of every proposal are small integers that leave out what
makes a base span (the plus sign, the check digit), so all proposals of the corpus sum up to one table of feature vectors
with counts, which is all that training needs.

Labels don't come from the base patterns alone: a proposal is positive if a base span of its kind overlaps it or if its own
check holds (check digit, number of groups, an address's ending), negative if its check fails, and unlabelled where there
is no check (a telephone number without a country code); unlabelled ones are scored but not learnt from. Trees boosted on
the counts become one column expression. For each kind the threshold is the lowest score from which ``PRECISION`` of the
labelled proposals of the documents left out of training are positive, one more failure granted. What scores above it and
overlaps no base span is added.

Everything that touches rows is a DataFrame function; patterns are possessive or bounded, so that long texts take linear time.
"""

from __future__ import annotations

import math
import operator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import stored, text_of

KINDS = ("email", "ip", "card", "phone")
PRECISION, ROUNDS, RATE, LEFT_OUT = 0.95, 12, 0.4, 4
PIECE = 256
GROUP = 64
CONTEXT = 24

# The contract's patterns. A match begins at the start of a run of its first class or where the last match ended, and takes
# whole runs: the matches are the same, without retries inside a run.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]{2,63}+(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]{2,63}+){1,4}",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20.\xA0-]?[0-9]{4}){2,3}[0-9]{0,3}(?![0-9])",
    "phone": r"(?<![0-9+])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])",
}
CUE = r"(?i)(mail|contact|tel|phone|call|fono|ruf|mobil|card|karte|carte|tarjeta|visa|account|konto|address|host|server|\bip\b)"
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def luhn(digits: Column) -> Column:
    """Whether the check sum of a string of digits is right, from the last digit on."""
    backwards = F.transform(F.split(F.reverse(digits), ""), lambda c, i: c.cast("int") * (1 + i % 2))
    return F.aggregate(F.filter(backwards, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return m.rlike(rf"^{PART}\.{PART}\.{PART}\.{PART}$")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _known(kind: str, m: Column) -> Column:
    """1 if a proposal's own check holds, 0 if it fails, -1 if there is none."""
    if kind == "email":
        return F.when(m.rlike(r"@[^@]*\.[A-Za-z]{2,24}$") | m.rlike(r"(?:\.|dot[)\]])\x20?[A-Za-z]{2,24}$"), 1).otherwise(0)
    if kind == "ip":
        groups = F.size(F.split(m, ":"))
        return F.when(valid(kind, m) | (groups == 8), 1).otherwise(0)
    if kind == "card":
        return valid(kind, m).cast("int")
    return F.when(~valid(kind, m), 0).when(m.startswith("+"), 1).otherwise(-1)


def _guard(kind: str, text: Column) -> Column:
    if kind == "email":
        return text.contains("@") | text.contains("(at)") | text.contains("[at]")
    return text.rlike("[0-9]|:[0-9A-Fa-f]") if kind == "ip" else text.rlike("[0-9]")


def located(rows: DataFrame, name: str, kind: str, pattern: str, text: str) -> DataFrame:
    """Adds ``name``: an array of (kind, s, e, m), the pattern's matches with their places in code points. A match begins
    where all that was split off and matched before it ends; these lengths are summed over pieces of PIECE matches first,
    so that a text with very many matches takes little more than linear time."""
    on = _guard(kind, F.col(text))
    none = F.array().cast("array<string>")
    rows = rows.withColumn("_m", F.when(on, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).otherwise(none))
    rows = rows.withColumn("_p", F.when(F.size("_m") > 0, F.transform(F.split(F.col(text), pattern, -1), F.length)).otherwise(F.array().cast("array<int>")))
    rows = rows.withColumn("_l", F.zip_with("_m", "_p", lambda m, p: F.coalesce(F.length(m), F.lit(0)) + p))
    add = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    numbers = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("_b", F.transform(numbers(F.ceil(F.size("_m") / PIECE).cast("int")), lambda b: add(F.slice(F.col("_l"), b * PIECE + 1, PIECE))))
    rows = rows.withColumn("_c", F.transform(numbers(F.size("_b")), lambda b: add(F.slice(F.col("_b"), F.lit(1), b))))

    def span(m: Column, i: Column) -> Column:
        piece = F.floor(i / PIECE).cast("int")
        start = F.get(F.col("_c"), piece) + add(F.slice(F.col("_l"), piece * PIECE + 1, i % PIECE)) + F.get(F.col("_p"), i)
        return F.struct(F.lit(KINDS.index(kind)).alias("kind"), start.alias("s"), (start + F.length(m)).alias("e"), m.alias("m"))

    return rows.withColumn(name, F.transform("_m", span)).drop("_m", "_p", "_l", "_b", "_c")


def _touched(x: Column, also) -> Column:
    """Whether a base span for which ``also`` holds overlaps x."""
    meets = lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"])
    return F.exists("groups", lambda g: meets(g) & F.exists(g["spans"], lambda b: meets(b) & also(b)))


FEATURES = ("kind", "digits", "separators", "lead", "bounded", "cue", "letters", "varied", "tail")


def _features(x: Column, text: Column) -> Column:
    """The proposal as (s, e, kind, and the other features as small integers)."""
    m = x["m"]
    count = lambda p: F.length(F.regexp_replace(m, p, ""))
    steps = lambda v, *at: sum(((v >= a).cast("int") for a in at), F.lit(0))
    before = F.when(x["s"] > 0, F.substring(text, F.greatest(F.lit(1), x["s"] + 1 - CONTEXT), F.least(x["s"], F.lit(CONTEXT)))).otherwise("")
    after = F.substring(text, x["e"] + 1, F.lit(1))
    digits = F.regexp_replace(m, "[^0-9]", "")
    return F.struct(
        x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"), steps(F.length(digits), 8, 12, 16, 20).alias("digits"), steps(count("[+A-Za-z0-9]"), 1, 3, 7).alias("separators"),
        m.contains("(").cast("int").alias("lead"),
        (before.rlike(r"(^|\s)$").cast("int") + after.rlike(r"^($|[\s.,;!?])").cast("int")).alias("bounded"), before.rlike(CUE).cast("int").alias("cue"),
        steps(count("[^A-Za-z]"), 1, 7).alias("letters"), (F.size(F.array_distinct(F.split(digits, ""))) > 3).cast("int").alias("varied"),
        m.rlike(r"[A-Za-z]{2,24}$").cast("int").alias("tail"), x["known"].alias("known"),
    )


def proposed(docs: DataFrame, text: str = "_text") -> DataFrame:
    """docs (with a text column that has no nulls) with ``base``, an array of (s, kind, e), ``groups`` of it, and ``more``, an
    array of the proposals with their features, ``hit``, whether a base span of their kind overlaps them, and ``known``."""
    rows = docs
    for kind in KINDS:
        for p, pattern in (("b", BASE[kind]), ("g", LOOSE[kind])):
            rows = located(rows, f"_{p}_{kind}", kind, pattern, text)
            rows = rows.withColumn(f"_{p}_{kind}", F.transform(f"_{p}_{kind}", lambda x: x.withField("known", _known(kind, x["m"])).withField("valid", valid(kind, x["m"]))))  # noqa: B023
    every = lambda p: F.concat(*(F.col(f"_{p}_{k}") for k in KINDS))
    base = F.filter(every("b"), lambda x: x["valid"])
    rows = rows.withColumn("base", F.array_sort(F.transform(base, lambda x: F.struct(x["s"].alias("s"), x["kind"].alias("kind"), x["e"].alias("e")))))
    # base spans in groups with their bounds, so that a proposal looks into the groups around it only
    groups = F.transform(F.when(F.size("base") > 0, F.sequence(F.lit(0), F.floor((F.size("base") - 1) / GROUP).cast("int"))).otherwise(F.array().cast("array<int>")), lambda c: F.slice("base", c * GROUP + 1, GROUP))
    rows = rows.withColumn("groups", F.transform(groups, lambda g: F.struct(F.get(g, F.lit(0))["s"].alias("s"), F.array_max(F.transform(g, lambda b: b["e"])).alias("e"), g.alias("spans"))))
    rows = rows.withColumn("_all", F.concat(every("g"), every("b"))).drop(*(f"_{p}_{k}" for p in "bg" for k in KINDS))
    hit = lambda x: _touched(x, lambda b: b["kind"] == x["kind"])
    rows = rows.withColumn("more", F.transform(F.transform("_all", lambda x: _features(x, F.col(text))), lambda x: x.withField("hit", hit(x))))
    return rows.drop("_all")


Tree = tuple  # (feature, threshold, left, right), or a leaf's value


@dataclass
class Boosted:
    """For each kind its trees, the score before them and the score from which proposals pass."""

    trees: list[list[Tree]]
    starts: list[float]
    thresholds: list[float]

    def score(self, x: dict[str, int]) -> float:
        def walk(t):
            while isinstance(t, tuple):
                t = t[2] if x[t[0]] <= t[1] else t[3]
            return t

        # plain additions in the column's order (sum() would round otherwise), so that a score equals its threshold there too
        return reduce(operator.add, map(walk, self.trees[x["kind"]]), self.starts[x["kind"]])

    def passes(self, x: Column) -> Column:
        def walk(t) -> Column:
            return F.when(x[t[0]] <= t[1], walk(t[2])).otherwise(walk(t[3])) if isinstance(t, tuple) else F.lit(float(t))

        out = F.lit(False)
        for k, t in enumerate(self.thresholds):
            if math.isfinite(t):
                out = F.when(x["kind"] == k, sum(map(walk, self.trees[k]), F.lit(self.starts[k])) >= F.lit(t)).otherwise(out)
        return out


def _trees(table: list[dict], rounds: int, rate: float) -> tuple[list[Tree], float]:
    """Newton boosting of depth-3 trees on counts."""
    total = [sum(r[c] for r in table) for c in ("pos", "neg")]
    start = math.log((total[0] + 1) / (total[1] + 1))
    margin, trees = [start] * len(table), []

    def leaf(rows: list[int], g: list[float], h: list[float]) -> tuple[float, float]:
        a, b = sum(g[i] for i in rows), sum(h[i] for i in rows)
        return a / (b + 1.0), a * a / (b + 1.0)

    def split(rows: list[int], g: list[float], h: list[float], depth: int) -> Tree | float:
        value, gain = leaf(rows, g, h)
        best = None
        for f in FEATURES[1:] if depth else ():
            for t in sorted({table[i][f] for i in rows})[:-1]:
                left, right = [i for i in rows if table[i][f] <= t], [i for i in rows if table[i][f] > t]
                better = leaf(left, g, h)[1] + leaf(right, g, h)[1] - gain
                if better > 1e-6 and (best is None or better > best[0]):
                    best = (better, f, t, left, right)
        if best is None:
            return rate * value
        return (best[1], best[2], split(best[3], g, h, depth - 1), split(best[4], g, h, depth - 1))

    def walk(t, x: dict) -> float:
        while isinstance(t, tuple):
            t = t[2] if x[t[0]] <= t[1] else t[3]
        return t

    for _ in range(rounds if min(total) else 0):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        g = [r["pos"] * (1 - q) - r["neg"] * q for r, q in zip(table, p, strict=True)]
        h = [(r["pos"] + r["neg"]) * q * (1 - q) for r, q in zip(table, p, strict=True)]
        trees.append(split(list(range(len(table))), g, h, 3))
        margin = [m + walk(trees[-1], r) for m, r in zip(margin, table, strict=True)]
    return trees, start


def boost(table: list[dict], rounds: int = ROUNDS, rate: float = RATE) -> Boosted:
    """table: feature vectors with pos and neg (training counts), cpos and cneg (those left out). Each kind has its own trees
    and threshold; a kind without left-out successes enough adds nothing."""
    out = Boosted([], [], [])
    for k in range(len(KINDS)):
        own = [r for r in table if r["kind"] == k]
        trees, start = _trees(own, rounds, rate)
        out.trees.append(trees)
        out.starts.append(start)
        rows = sorted(((out.score(r), r["cpos"], r["cneg"]) for r in own), reverse=True)
        t, hits, seen = math.inf, 0, 0
        for i, (s, a, b) in enumerate(rows):
            hits, seen = hits + a, seen + a + b
            if (i + 1 == len(rows) or rows[i + 1][0] < s) and seen and hits >= PRECISION * (seen + 1):
                t = s
        out.thresholds.append(t)
    return out


def fit(rows: DataFrame) -> Boosted:
    """rows: (doc_id, more). One row of counts for each feature vector reaches the driver: 4 * 5 * 4 * 2 * 3 * 2 * 3 * 2 * 2
    of them at most, however many documents there are."""
    each = rows.select((F.pmod(F.xxhash64("doc_id"), F.lit(LEFT_OUT)) == 0).alias("out"), F.explode("more").alias("x")).filter("x.hit or x.known >= 0")
    each = each.select("out", *(F.col(f"x.{f}").alias(f) for f in FEATURES), F.expr("x.hit or x.known = 1").alias("hit"))
    counted = lambda out, hit: F.count_if((F.col("out") == out) & (F.col("hit") == hit))
    table = each.groupBy(*FEATURES).agg(counted(False, True).alias("pos"), counted(False, False).alias("neg"), counted(True, True).alias("cpos"), counted(True, False).alias("cneg"))
    return boost(sorted((r.asDict() for r in table.collect()), key=lambda r: [r[f] for f in FEATURES]))


def _furthest(rows: DataFrame, spans: str) -> DataFrame:
    """Adds ``_e``: for each span the furthest end of those before it, 0 for the first, by running maxima over pieces."""
    most = lambda a: F.coalesce(F.array_max(a), F.lit(0))
    rows = rows.withColumn("_f", F.transform(spans, lambda x: x["e"]))
    pieces = F.when(F.size("_f") > 0, F.sequence(F.lit(0), F.floor((F.size("_f") - 1) / PIECE).cast("int"))).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("_g", F.transform(pieces, lambda b: F.array_max(F.slice("_f", b * PIECE + 1, PIECE))))

    def before(x: Column, i: Column) -> Column:
        piece = F.floor(i / PIECE).cast("int")
        ahead = F.when((piece > 0) & (F.size("_g") > 0), most(F.slice("_g", F.lit(1), piece))).otherwise(0)
        return F.greatest(ahead, most(F.slice("_f", piece * PIECE + 1, i % PIECE)))

    return rows.withColumn("_e", F.transform("_f", before)).drop("_f", "_g")


def chosen(rows: DataFrame, trees: Boosted) -> DataFrame:
    """Adds ``spans``, base spans and the proposals that pass, but for those that overlap a base span or a passing proposal
    that begins earlier (or there, of an earlier kind)."""
    clear = lambda x: trees.passes(x) & ~x["hit"] & ~_touched(x, lambda b: F.lit(True))
    rows = rows.withColumn("_x", F.array_sort(F.transform(F.filter("more", clear), lambda x: F.struct(x["s"].alias("s"), x["kind"].alias("kind"), x["e"].alias("e")))))
    rows = _furthest(rows, "_x")
    apart = F.filter("_x", lambda x, i: x["s"] >= F.get("_e", i))
    return rows.withColumn("spans", F.array_sort(F.concat(F.col("base"), apart))).drop("_x", "_e")


def _written(spans: str) -> Column:
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x["kind"]), x["s"], x["e"])), ",")


def found(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans) for every row: arrays of (s, kind, e), by start and then by kind. Null texts are empty;
    repeated rows have the same spans each; other columns are ignored."""
    rows = stored(proposed(docs.select("doc_id", text_of().alias("_text"))).drop("_text"), "pii")
    return chosen(rows, fit(rows)).select("doc_id", "base", "spans")


def report(docs: DataFrame) -> DataFrame:
    n = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found(docs).select("doc_id", *(n(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)), F.sha2(_written("base"), 256).alias("base_sha256"), _written("spans").alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """docs with each span of their text replaced by its kind in angle brackets; overlapping spans give one mark, the
    first one's. All rows and columns stay, null texts too."""
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    # the rows' own columns travel in one, so that no name of theirs can clash
    rows = proposed(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", text_of().alias("_text")))
    trees = fit(stored(rows.select("doc_id", "more"), "pii-train"))
    # what a span leaves: the text from the furthest end before it to its own start
    rows = _furthest(chosen(rows, trees), "spans")
    mark = lambda x, i: F.when(x["s"] >= F.get(F.col("_e"), i), F.concat(F.substring(F.col("_text"), F.get(F.col("_e"), i) + 1, x["s"] - F.get(F.col("_e"), i)), F.lit("<"), name(x["kind"]), F.lit(">"))).otherwise("")
    rest = F.array_max(F.transform("spans", lambda x: x["e"]))
    text = F.when(F.size("spans") == 0, F.col("row.text")).otherwise(F.concat(F.array_join(F.transform("spans", mark), ""), F.substring(F.col("_text"), rest + 1, F.length("_text"))))
    return rows.select(F.col("row").withField("text", text).alias("row")).select("row.*")
