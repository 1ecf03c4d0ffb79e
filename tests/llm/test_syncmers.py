import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow.dataset as ds
import xxhash

from tessera.llm import queries, syncmers

SF = "/root/testdata/sf0.001"


def plain_anchors(text, k, s):
    """Straight from the definition, on the same inner hashes."""
    def h(x):
        p = syncmers.mix(np.frombuffer(x.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1))
        return int(syncmers.POINTS.ranges(p, np.array([0]), np.array([len(p)]))[0])
    out = []
    for i in range(len(text) - k + 1):
        inner = [h(text[j : j + s]) for j in range(i, i + k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append((i, h(text[i : i + k]) >> 32))
    return out


def test_closed_syncmers_by_definition():
    texts = ["the quick brown fox jumps over the lazy dog and runs away again", "", "éa" * 30, "short", "x" * 40]
    text, pos, h = syncmers.anchors(texts)
    for i, t in enumerate(texts):
        assert [(int(p), int(x)) for j, p, x in zip(text, pos, h, strict=True) if j == i] == plain_anchors(t, syncmers.K, syncmers.S)


def edited(texts):
    return [t[: len(t) - len(t) // 3] + texts[(i + 1) % len(texts)][: len(t) // 3] for i, t in enumerate(texts)]


def plain_fingerprint(text):
    """Anchors by definition, those whose hash the text's share holds; a text without anchors has the hash of the whole."""
    found = plain_anchors(text, syncmers.K, syncmers.S)
    part = 1
    while part < syncmers.LEAST and len(text) > syncmers.FULL * part:
        part *= 2
    if not found and text:
        return [(0, xxhash.xxh32_intdigest(text.encode()))], 2**32
    return [(p, h) for p, h in found if h < 2**32 // part], 2**32 // part


def plain_likeness(a, b):
    """The longest common subsequence of numbered anchors by its table."""
    below = min(a[1], b[1])

    def numbered(x):
        seen = Counter()
        out = []
        for _, h in x[0]:
            if h < below or x[1] == below:
                out.append((h, seen[h]))
                seen[h] += 1
        return out

    x, y = numbered(a), numbered(b)
    if not x and not y:
        return float([h for _, h in a[0]] == [h for _, h in b[0]])
    row = [0] * (len(y) + 1)
    for p in x:
        new = [0]
        for j, q in enumerate(y):
            new.append(row[j] + 1 if p == q else max(new[j], row[j + 1]))
        row = new
    return row[-1] / (len(x) + len(y) - row[-1])


def test_query_against_brute_force(spark):
    t = ds.dataset(f"{SF}/documents.parquet").to_table(columns=["doc_id", "text"]).to_pylist()
    t.sort(key=lambda r: -r["doc_id"])
    texts = [r["text"] or "" for r in t]
    got = {r.doc_id: r for r in queries.op5_document_fingerprints(spark, SF).collect()}
    assert len(got) == len(t)
    after = edited(texts)
    hex_of = lambda f: "".join(f"{p:08x}{h:08x}" for p, h in f[0])
    for i, r in enumerate(t):
        g = got[r["doc_id"]]
        assert (g.n_chars, g.edited_sha256) == (len(texts[i]), hashlib.sha256(after[i].encode()).hexdigest())
        if len(texts[i]) < 1500 and i < 60:
            own, changed, follower = plain_fingerprint(texts[i]), plain_fingerprint(after[i]), plain_fingerprint(texts[(i + 1) % len(t)][:40_000])
            assert (g.fingerprint, g.edited_fingerprint) == (hex_of(own), hex_of(changed))
            assert g.near_edited == plain_likeness(own, changed)
            if len(texts[(i + 1) % len(t)]) < 3000:
                assert g.near_next == plain_likeness(own, follower)
    some = [g for g in got.values() if g.n_chars > 24]
    assert np.mean([g.near_edited > 0 for g in some]) > 0.98 and np.median([g.near_edited for g in some]) > 0.35
    assert np.median([g.near_next for g in some]) < 0.05


def test_a_passage_shows_in_long_texts_and_edits_in_short_ones():
    rng = random.Random(4)
    made = lambda n: "".join(rng.choice("abcdefghijklmnopqrst  ") for _ in range(n))
    found = 0
    for _ in range(100):
        passage = made(600)
        a, b = (made(rng.randrange(5000)) + passage + made(6000) for _ in "ab")
        x, y = syncmers.fingerprints_of([a, b])
        found += syncmers.likeness(x, y) > 0
    assert found >= 98
    short = [made(n) for n in range(24, 60) for _ in range(10)]
    changed = [t[: len(t) - len(t) // 3] + made(len(t) // 3) for t in short]
    alike = [syncmers.likeness(x, y) for x, y in zip(syncmers.fingerprints_of(short), syncmers.fingerprints_of(changed), strict=True)]
    assert np.mean([x > 0 for x in alike]) > 0.9


def test_edge_rows(spark):
    rows = [(3, None), (2, ""), (1, "a"), (9, "same text " * 20), (8, "same text " * 20), (7, "y" * 200_000), (None, "null id text, long enough for an anchor"), (9, "same text " * 20)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, part int, edge string")
    got = syncmers.fingerprints(docs).collect()
    assert len(got) == len(rows)
    assert len({r.fingerprint for r in got if r.doc_id in (8, 9)}) == 1
    assert [r.fingerprint for r in got if r.doc_id in (2, 3)] == ["", ""]
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert syncmers.fingerprints(docs.limit(0)).count() == 0
    alone = syncmers.fingerprints(docs.filter("doc_id = 1")).collect()
    assert [(r.doc_id, r.near_next) for r in alone] == [(1, 1.0)]


def test_long_texts_keep_every_anchor():
    """Also above 5,120 code points; a changed word shows wherever it stands."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(800)]
    text, other = " ".join(words), " ".join([*words[:400], "another", *words[401:]])
    own, changed = syncmers.fingerprints_of([text, other])
    assert list(zip(own.positions.tolist(), own.hashes.tolist(), strict=True)) == plain_anchors(text, syncmers.K, syncmers.S)
    assert len(own.hashes) > len(text) / 5
    assert syncmers.likeness(own, changed) < 1
    a, b = ([(int(p), int(h)) for p, h in zip(*f)] for f in (own, changed))
    assert syncmers.likeness(own, changed) == plain_likeness((a, 2**32), (b, 2**32))


def test_every_row_meets_its_successor_across_parts(spark, monkeypatch):
    """More parts than rows in some, ids beyond 2^53 beside rows without one."""
    monkeypatch.setattr(syncmers, "PARTS", 8)
    rng = random.Random(6)
    made = lambda: "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(0, 90)))
    ids = [2**62 + 1, 2**62, -(2**63), *rng.sample(range(10**6), 120)]
    rows = [(i, made()) for i in ids] + [(None, "the last of all, without an id")]
    got = {r.doc_id: r for r in syncmers.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0)))
    assert set(got) == {i for i, _ in rows}
    for (i, t), e in zip(rows, edited([t for _, t in rows]), strict=True):
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
