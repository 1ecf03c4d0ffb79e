from itertools import permutations

from pyspark.sql import functions as F

from tessera.llm import filteraudit, queries
from tests import oracle

SF = "/root/testdata/sf0.01"


def test_query_against_sql(spark):
    oracle.same(queries.op12_filter_interaction_audit(spark, SF), queries.ORACLE["op12_filter_interaction_audit"], SF)


def plain(docs, labels):
    """(part, order, step) to measures, document by document."""
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    held = {"quality": {i for i, q, _ in labels if q == 1 and i is not None}, "toxic": {i for i, _, t in labels if t == 1 and i is not None}}
    out, shares = {}, {}
    for order in map("".join, permutations("ABCDE")):
        for i, text, lang in docs:
            text, part = text or "", lang or ""
            words = "".join(" " if c in "\t\n\v\f\r" else c for c in text).split(" ")
            words = [w for w in words if w]
            fails = {
                "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
                "D": any(c in "#$%&*|" for c in text), "E": i is not None and i > first[text],
            }
            gone = False
            for step, f in enumerate(order):
                x = out.setdefault((part, order, step + 1, f), [0] * 6)
                here = fails[f] and not gone
                x[0] += not fails[f] and not gone
                x[1] += here
                x[2] += fails[f] and gone
                x[3] += fails[f] and sum(fails.values()) == 1
                x[4] += here and i in held["quality"]
                x[5] += here and i in held["toxic"]
                shares[part, f] = shares.get((part, f), 0) + here
                gone = gone or here
    return sorted((*k, *v, shares[k[0], k[3]]) for k, v in out.items())


def test_edge_rows(spark):
    long = " ".join(f"w{i}" for i in range(150))
    docs = [
        (1, long, "en"), (2, long, "en"), (2, long, "en"), (3, long, "de"), (None, long, "en"), (0, None, "en"), (5, "", "en"), (6, "x " * 30000, "en"), (7, "ABC $\x0b d", None),
        (8, "\u00a0" + long, ""), (9, None, None), (None, None, "fr"), (10, long.upper(), "de"), (11, long + " #", "de"), (None, "", "fr"), (-4, "ABC $\x0b d", "de"),
    ]
    labels = [(1, 1, 0), (2, 0, None), (2, 1, 1), (6, None, 1), (None, 1, 1), (99, 1, 1), (10, 1, 1), (11, 0, 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("part", F.lit("z")).withColumn("n", F.lit(1)).withColumn("first", F.lit(True))
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit(1)).withColumn("digest", F.lit("d"))
    got = sorted(tuple(r) for r in filteraudit.audit(df, known).collect())
    assert got == plain(docs, labels)
    assert len(got) == 600 * 4 and {r[0] for r in got} == {"", "de", "en", "fr"}
    assert filteraudit.audit(df.limit(0), known).count() == 0
    assert sorted(tuple(r)[:4] + tuple(r)[4:8] for r in filteraudit.audit(df, known.limit(0)).collect()) == [r[:8] for r in plain(docs, [])]
