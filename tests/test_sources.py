"""Files that are missing, empty or broken; exports that join to what they came from; publishing that fails."""

import os

import pytest
from pyspark.sql import types as T

from tessera.operators import links, quality
from tessera.sources import entities
from tessera.sources.shared import scratch

PERSON = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.LongType())])


def folder(files):
    import tempfile

    root = tempfile.mkdtemp(prefix="spark-")
    for name, text in files.items():
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        with open(f"{root}/{name}", "w") as out:
            out.write(text)
    return root


def test_a_folder_with_files_missing_empty_and_broken(spark):
    root = folder({"s1/people.json": '[{"id": "a", "n": 1}, 7, {"id": "b", "n": "x"}, null, {"id": "c", "more": 2}]', "s2/people.json": " [ ]\n", "s3/people.json": '[{"id": "d"}', "s5/people.json": '{"id": "e"}', "s6/people.json": "", "s1/works.json": "[]"})
    kinds = [entities.Kind("people", PERSON, "*/people.json", r"/([^/]+)/people\.json$", True), entities.Kind("works", PERSON, "*/works.json", r"/([^/]+)/works\.json$")]
    slices = spark.createDataFrame([(f"s{i}",) for i in range(1, 7)], "slice string")
    found, problems = entities.load_slices(spark, root, kinds, slices)
    assert sorted((r.slice, r.pos, r.id, r.n) for r in found["people"].collect()) == [("s1", 0, "a", 1), ("s1", 2, "b", None), ("s1", 4, "c", None)]
    assert found["works"].count() == 0
    got = sorted((r.kind, r.slice, r.pos if r.pos is not None else -1, r.level, r.message) for r in problems.collect())
    assert got == sorted([
        ("people", "s1", 1, "error", "must be an object"), ("people", "s1", 2, "error", "holds a value of the wrong type"), ("people", "s1", 3, "error", "must be an object"), ("people", "s2", -1, "error", "is empty"), ("people", "s3", -1, "error", "invalid JSON"),
        ("people", "s4", -1, "error", "is missing"), ("people", "s5", -1, "error", "must be an array"), ("people", "s6", -1, "error", "is missing"), ("works", "s1", -1, "warning", "is empty"), *(("works", f"s{i}", -1, "warning", "is missing") for i in range(2, 7)),
    ])


def test_entities_tell_what_is_missing_empty_broken_or_doubled(spark):
    root = folder({"people/a.json": '{"id": "a", "n": 1}\n{"id": "b"\n', "people/b.json": '{"id": "a", "n": 2}\n{"id": "c", "n": "x"}\n', "works/a.json": "", "notes/a.json": '{"id": "z"}\n'})
    tables, problems = entities.load_entities(spark, root, dict.fromkeys(("people", "works", "venues", "notes", "facts"), PERSON), ("people", "works", "venues"))
    assert sorted((r.id, r.n) for r in tables["people"].collect()) == [("a", 1), ("a", 2)]
    assert [tables[k].count() for k in ("works", "venues", "notes", "facts")] == [0, 0, 1, 0]
    assert sorted((r.kind, r.id or "", r.message) for r in problems.collect()) == [
        ("people", "a", "key twice"), ("people", '{"id": "b"', "is no such object"), ("people", '{"id": "c", "n": "x"}', "is no such object"), ("venues", "", "is missing"), ("works", "", "is empty"),
    ]


def test_a_kind_without_any_file_is_missing_once(spark):
    kinds = [entities.Kind("people", PERSON, "people.json", r"/(people)\.json$", True), entities.Kind("works", PERSON, "works.json", r"/(works)\.json$")]
    found, problems = entities.load_slices(spark, folder({"works.json": '[{"id": "w", "n": 2}]'}), kinds)
    assert [tuple(r) for r in problems.collect()] == [("people", "", None, "error", "is missing")]
    assert found["people"].count() == 0 and [tuple(r) for r in found["works"].collect()] == [("works", 0, "w", 2)]


def test_both_outputs_joined_give_the_input(spark):
    schema = "id long, program string, venue int, day long, s long, e long, eu boolean, ad boolean, og boolean, description string"
    rows = [(3, 'p "q"', 9, 10, 1, 2, False, False, False, "text\n3"), (3, 'p "q"', 9, 11, 3, 4, True, False, True, "text\n3"), (1, None, 5, 10, 1, 2, False, True, False, None)]
    narrow, wide = entities.export_instances(spark.createDataFrame(rows, schema), spark.createDataFrame([(9, "Hall"), (4, "x")], "id int, name string"), scratch(spark, "export"))
    assert sorted((r.n, r.json) for r in narrow.collect()) == [(1, '{"id":1,"p":null,"v":null,"vn":null,"i":[[10,1,2,4]]}'), (2, '{"id":3,"p":"p \\"q\\"","v":1,"vn":"Hall","i":[[10,1,2,0],[11,3,4,9]]}')]
    assert [tuple(r) for r in wide.collect()] == [(2, "text\n3")]


def test_publishing_that_cannot_move_leaves_the_old_output(spark, monkeypatch):
    root = scratch(spark, "published")
    clean = spark.createDataFrame([], "level string")
    assert entities.publish_if_clean(spark.range(3), clean, f"{root}/out") and entities.publish_if_clean(spark.range(5), clean, f"{root}/out")
    assert spark.read.parquet(f"{root}/out").count() == 5
    local = root.removeprefix("file:")
    assert sorted(x for x in os.listdir(local) if not x.startswith(".")) == ["out"]
    assert not entities.publish_if_clean(spark.range(9), spark.createDataFrame([("error",)], "level string"), f"{root}/out")
    assert spark.read.parquet(f"{root}/out").count() == 5
    # a target below a plain file can't be moved to
    with open(f"{local}/plain", "w") as out:
        out.write("x")
    with pytest.raises(Exception):
        entities.publish_if_clean(spark.range(2), clean, f"{root}/plain/out")
    assert spark.read.parquet(f"{root}/out").count() == 5


LINKS = [
    ("#", "nowhere", ""), ("#top", None, None), ("#gone", "no anchor", "gone"), ("HTTP://x.org/", "insecure", ""), ("http://localhost:8000/", None, None), ("javascript:void(0)", "scheme", ""), ("mailto:a@b.c", None, None), ("/other/x.html", "outside", ""), ("/s/", None, None),
    ("/s/a/b.html", None, None), ("../../../x.html", "climbs", ""), ("c.html", "broken", "a/c.html"), ("../a/./b.html#top", None, None), ("..", None, None), ("b.html?p=1,2", None, None), ("b.html?p=1,9", "bad value", "p=1,9"), ("b.html?z=1&p=9", "unknown key", "z"), ("../index.html?p=1", "no query", "index.html"),
    ("b.html?free=anything%20at+all", None, None), ("b.html?p=", "bad value", "p="), ("data.json?x=1#y", None, None), ("b.html#caf%C3%A9", None, None), ("b.html?", None, None),
]


def test_each_link_is_judged_by_its_first_mistake(spark):
    body = "".join(f'<a class="l" href="{h}">x</a>' for h, _, _ in LINKS)
    pages = spark.createDataFrame([("index.html", "<p id=top></p>"), ("a/b.html", f"<!-- <a href='#'> --><script>'<a href=\"#\">'</script><h1 id='top'></h1><i id=\"café\"></i>{body}<img src='no.png' srcset='../no2.png 2x, /s/index.html'><link href='https://x'>")], "path string, html string")
    params = spark.createDataFrame([("a/b.html", "p", "list"), ("a/b.html", "free", "any")], "path string, key string, rule string")
    values = spark.createDataFrame([("a/b.html", "p", "1"), ("a/b.html", "p", "2")], "path string, key string, value string")
    got = {r.href: (r.kind, r.detail) for r in links.link_problems(pages, params, values, "/s/", spark.createDataFrame([("a/data.json",)], "path string")).collect()}
    assert got == {h: (k, d) for h, k, d in LINKS if k} | {"no.png": ("broken", "a/no.png"), "../no2.png": ("broken", "no2.png")}


def test_broken_paths(spark):
    pages = spark.createDataFrame([(1, "http://a/x", '<a href="/x/">y</a><a href="/z?q">z</a>')], "page_id long, url string, html string")
    assert [tuple(r) for r in quality.broken_paths(pages).collect()] == [("/z", 1, 1)]
