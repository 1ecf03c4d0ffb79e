import hashlib
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.dataset as ds
import sentencepiece
from tokenizers import Tokenizer

from tessera.llm import pieces, queries, tokenfiles

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "  two  spaces ", "a\nb\tc", "ﬁ ½ é Ａ", "▁x y", "<s> </s>", "日本語" * 40, "a\x00b", "x" * 5000, "don't \n stop  \n\nnow", "   mixed space ", "1 22 333 !!?", "word " * 20000]


def documents():
    return ds.dataset(f"{SF}/documents.parquet").to_table(columns=["doc_id", "text"]).to_pylist()


def test_pieces_query_against_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
    want = []
    for r in documents():
        ids = sp.encode(r["text"] or "") + [sp.eos_id()]
        want.append((r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, queries.op10_sentencepiece(spark, SF).collect())) == sorted(want)


def test_agenda_equals_library():
    own = pieces.Coder(public_tokenizers.path(pieces.MODEL))
    sp = own.vocabulary.library
    texts = ODD + [r["text"] for r in documents()[:40]]
    flat, ends = own.encode(pa.array(texts))
    assert [x.tolist() for x in np.split(flat, ends)[:-1]] == [[*sp.encode(t), sp.eos_id()] for t in texts]
    assert own.decode(flat, ends) == [sp.decode(sp.encode(t)) for t in texts]
    assert own.differed == 0
    for s in ("▁" + w for w in "internationalization unbelievable éè 日本 x\u0000".split()):
        assert own.vocabulary.on_a_heap(s) == own.vocabulary.agenda([s])[0].tolist() == sp.encode(s[1:])


def test_wavelet_matrix():
    rng = np.random.default_rng(0)
    for n in (1, 7, 512, 3000):
        ids = (rng.zipf(1.3, n) % 50257).astype(np.uint32)
        s = tokenfiles.Shard(tokenfiles.pack(ids))
        assert (s.ids() == ids).all() and [s.access(i) for i in range(min(n, 50))] == ids[:50].tolist()
        for t in {int(ids[0]), int(ids[-1]), 50000, 70000}:
            at = np.flatnonzero(ids == t).tolist()
            assert s.count(t) == len(at) and s.rank(t, n // 2) == sum(i < n // 2 for i in at)
            assert [s.select(t, k) for k in range(min(9, len(at)))] == at[:9] and s.select(t, len(at)) == -1
    assert tokenfiles.Shard(tokenfiles.pack(np.zeros(0, np.uint32))).ids().tolist() == []


def plain(rows):
    t, start, out = Tokenizer.from_file(public_tokenizers.path(tokenfiles.TOKENIZER)), 0, []
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_query_against_library(spark):
    want = plain(sorted((r["doc_id"], r["text"]) for r in documents()))
    assert sorted(map(tuple, queries.op8_token_files(spark, SF).collect())) == want


def test_edge_rows(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100, None), (101, "same"), (101, "same"), (None, "no id")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, part int, ids string")
    assert sorted(tokenfiles.round_trip(docs).collect(), key=lambda r: r.start) == plain(rows)
    assert tokenfiles.round_trip(docs.limit(0)).count() == 0
    assert pieces.encoded(docs).count() == len(rows) and pieces.encoded(docs.limit(0)).count() == 0
    by_id = {r.doc_id: r for r in pieces.encoded(docs).collect()}
    assert by_id[100].ids == [2] and by_id[0].ids == [2]
    back = {r.doc_id: r.text for r in pieces.decoded(pieces.encoded(docs)).collect()}
    assert back[3] == ODD[3]


def test_surplus_spaces_do_not_hide_odd_white_space():
    texts = ["a \u00a0 \u00a0 b\tc\td", "a  b\tc", "plain words\nof two lines", "\nlead x", " lead", "end\n", "a\n\nb", "x\u0085y z", "a\x1cb c", "\u3000a b"]
    t = Tokenizer.from_file(public_tokenizers.path(tokenfiles.TOKENIZER))
    got = tokenfiles.encoder(public_tokenizers.path(tokenfiles.TOKENIZER))(pa.array(texts))
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_texts_without_blanks_do_not_fill_the_memory():
    rng = np.random.default_rng(1)
    texts = pa.array(["".join(rng.choice(list("abcdefghij"), 20_000)) + " " + "".join(rng.choice(list("abcdefghij"), 20_000)) for _ in range(20)])
    t = Tokenizer.from_file(public_tokenizers.path(tokenfiles.TOKENIZER))
    own = tokenfiles.Encoder(public_tokenizers.path(tokenfiles.TOKENIZER))
    assert [np.frombuffer(g, "<u4").tolist() for g in own(texts)] == [t.encode(x.as_py(), add_special_tokens=False).ids for x in texts]
    assert len(own.memory.units) == 0
    coder = pieces.Coder(public_tokenizers.path(pieces.MODEL))
    flat, ends = coder.encode(texts)
    assert [x.tolist()[:-1] for x in np.split(flat, ends)[:-1]] == [coder.vocabulary.library.encode(x.as_py()) for x in texts]
    assert len(coder.memory.units) == 0


def test_a_full_memory_is_emptied_and_ids_stay_right():
    own = tokenfiles.Encoder(public_tokenizers.path(tokenfiles.TOKENIZER))
    own.memory.kept = 2000
    t = own.library
    for r in documents()[:60]:
        assert np.frombuffer(own(pa.array([r["text"]]))[0], "<u4").tolist() == t.encode(r["text"], add_special_tokens=False).ids


def test_an_encoding_worker_holds_little_of_a_large_batch():
    """8 MB of texts and 400,000 different words: neither arrays of all their words nor a memory of all segments."""
    own = pieces.Coder(public_tokenizers.path(pieces.MODEL))
    rng = np.random.default_rng(5)
    words = [f"w{x:x}" for x in rng.integers(0, 2**24, 400_000).tolist()]
    texts = [" ".join(words[(200 * k) % 400_000 :][:200]) for k in range(2000)] + ["the cat sat on the mat of a man " * 80] * 1600
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    tracemalloc.start()
    got = [(len(b), len(b.column("ids").flatten())) for b in pieces.laid_in_pieces(own, batch)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    kept = own.memory.units.nbytes + own.memory.ids.nbytes + own.memory.counts.nbytes
    assert sum(n for n, _ in got) == len(texts) and sum(n for _, n in got) > 2_000_000
    assert peak < 180_000_000 and kept <= 16_000_000, (peak, kept)
