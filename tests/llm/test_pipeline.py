from collections import Counter

import public_tokenizers
import sentencepiece

import corpus_pipeline
from tessera.llm import mixing, pieces
from tessera.llm._common import stored
from tests.llm.test_jaccard import stays
from tests.llm.test_pii import listed

SF = "/root/testdata/sf0.001"


def test_each_stage_on_its_own_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, columns = docs.collect(), docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, SF), name)
        if name != "sentencepiece":
            assert out.columns == columns and out.dtypes == docs.dtypes
        seen.append((name, docs, out))
        docs = out
    rows = {name: (a.collect(), b.collect()) for name, a, b in seen}

    old, new = rows["toxicity"]
    assert len(old) == len(before) and 0.7 * len(old) < len(new) <= len(old) and set(new) <= set(old)
    old, new = rows["simhash_near_dedup"]
    assert sorted(r.doc_id for r in new) == stays([(r.doc_id, r.text) for r in old])
    old, new = rows["pii"]
    text = {r.doc_id: r for r in new}
    assert len(new) == len(old)
    for r in old:
        if listed(r.text):
            assert not listed(text[r.doc_id].text) and text[r.doc_id].n_chars == len(text[r.doc_id].text)
        elif not any(c.isdigit() or c == "@" for c in r.text):
            assert text[r.doc_id].text == r.text
    old, new = rows["mixing_sources"]
    copies = {r.doc_id: r.copies for r in mixing.mixed(seen[3][1]).collect()}
    assert len(copies) == len(old)
    assert Counter(r.doc_id for r in new) == {i: c for i, c in copies.items() if c}
    old, new = rows["sentencepiece"]
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
    assert sorted((r.doc_id, r.ids) for r in new) == sorted((r.doc_id, sp.encode(r.text) + [2]) for r in old)


def test_run_and_empty_table(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), name)
        assert docs.count() == 0
