"""Walks over nested schemas: references with their places, cleaned texts with their log."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import nested, records

SHOW = T.StructType([
    T.StructField("id", T.StringType()), nested.refers("venue", T.StringType(), "venue"), nested.refers("people", T.ArrayType(T.StringType()), "person"), nested.refers("roles", T.MapType(T.StringType(), T.ArrayType(T.StringType())), "word", "person"),
    T.StructField("by", T.ArrayType(T.StructType([nested.refers("org", T.StringType(), "org"), T.StructField("note", T.StringType()), nested.refers("deep", T.ArrayType(T.ArrayType(T.StringType())), "deep")]))),
])


def test_every_reference_with_its_place(spark):
    rows = [("a", "v1", ["p1", None, "p2"], {"p3": ["w1"], "p4": None}, [("o1", "x", [["d1"], [], ["d2", "d3"]]), None, ("o2", None, None)]), ("b", None, None, None, None), ("c", None, [], {}, [])]
    df = spark.createDataFrame(rows, SHOW)
    got = sorted(map(tuple, nested.references(df, "id").collect()))
    assert got == sorted([
        ("a", "venue", "venue", "v1"), ("a", "people[0]", "person", "p1"), ("a", "people[2]", "person", "p2"), ("a", "roles{p3}", "person", "p3"), ("a", "roles{p4}", "person", "p4"), ("a", "roles{p3}[0]", "word", "w1"),
        ("a", "by[0].org", "org", "o1"), ("a", "by[2].org", "org", "o2"), ("a", "by[0].deep[0][0]", "deep", "d1"), ("a", "by[0].deep[2][0]", "deep", "d2"), ("a", "by[0].deep[2][1]", "deep", "d3"),
    ])
    targets = spark.createDataFrame([("venue", "v1"), ("person", "p1"), ("person", "p3"), ("org", "p2"), ("org", "o1"), ("word", "w1")], "kind string, id string")
    lost = sorted((r.path, r.ref) for r in records.dangling_refs(nested.references(df, "id"), targets).collect())
    assert lost == [("by[0].deep[0][0]", "d1"), ("by[0].deep[2][0]", "d2"), ("by[0].deep[2][1]", "d3"), ("by[2].org", "o2"), ("people[2]", "p2"), ("roles{p4}", "p4")]
    assert nested.references(df.limit(0), "id").count() == 0


def test_one_scan_however_many_fields_refer(spark):
    df = spark.createDataFrame([("a", "v1", ["p"], {"q": ["w"]}, None)], SHOW)
    plan = nested.references(df, "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1


@pytest.mark.parametrize(("text", "want"), [
    ("a&nbsp;b &amp;amp; &#233;&#xE9;&Eacute; &unknown; &#0; &#1114112;", "a b &amp; ééé &unknown; &#0; &#1114112;"), ("one<br>two<BR/> three</p><p>four", "one\ntwo\nthreefour"), (" a \t b \r\n\r\n\r\n\r\n c ", "a b\n\nc"), ("​ ﻿", None), (None, None), ("&#x1F600;!", "😀!"), ("1 < 2 > 0", "1 < 2 > 0"),
])
def test_normal_form_of_a_text(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(records.text_clean(F.col("t"))).first()[0] == want


@pytest.mark.parametrize(("text", "want"), [
    ("Fine. See notes.json for more. Also fine!", "Fine. Also fine!"), ("A (from x.json) b.", "A b."), ("One.\n\nAll of it is in a.json.\n\nTwo.", "One.\n\nTwo."), ("x.json", None), ("Untouched.  Really", "Untouched.  Really"),
])
def test_marked_sentences_go(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(records.scrubbed(F.col("t"), r"\.json\b")).first()[0] == want


def test_cleaning_rewrites_every_text_and_logs_each_change(spark):
    rows = [Row(id=" k ", title=" a  b ", tags=["x", " y", None], names={"n ": " v "}, parts=[Row(t="<b>c</b>", n=1), None]), Row(id="m", title=None, tags=None, names=None, parts=None)]
    df = spark.createDataFrame(rows, "id string, title string, tags array<string>, names map<string,string>, parts array<struct<t:string,n:int>>")
    data, log = records.cleaned(df, "id")
    first = data.filter("id = ' k '").first()
    assert (first.title, first.tags, first.names, first.parts) == ("a b", ["x", "y", None], {"n ": "v"}, [Row(t="c", n=1), None])
    assert data.schema == df.schema and data.count() == 2
    assert sorted((r.path, r.before, r.after) for r in log.collect()) == [("names{n }", " v ", "v"), ("parts[0].t", "<b>c</b>", "c"), ("tags[1]", " y", "y"), ("title", " a  b ", "a b")]
