"""Languages of a document by mixture inference.

Every language has a table of n-gram likelihoods: the n-grams of a word are the last up to four bytes at each of its letters and at
its end, in lower case, none across words. They are hashed to ``SLOTS`` cells, so that the tables have a fixed size however much
text they come from, and are counted over all learnable documents: tasks return one partial count for each language and cell, and
Spark adds these.

A document is a mixture of languages: each of its words was drawn from one of them, with the document's proportions.
Expectation-maximisation finds the proportions; the set of languages starts as the best single one and takes another, the one with
the largest share in what the set explains worse, as long as the log-likelihood of the best mixture rises by more than ``PENALTY``
for each doubling of the document's words. The language with the largest share of the chosen set is the prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import stored, text_of
from tessera.llm.words import LETTERS, U, Words, chunks

BITS = 18
SLOTS = 1 << BITS
#: Added to each cell, so that no n-gram is impossible.
FLOOR = 0.02
#: Log-likelihood (natural) that a further language must bring, for each doubling of the words.
PENALTY = 4.0
STEPS, ENOUGH = 25, 1e-3
UNKNOWN = "und"
#: Words of letters alone, digits and apostrophes are no letters here; all of UTF-8 beyond ASCII is.
ALPHA = LETTERS & np.array([b >= 128 or chr(b).isalpha() for b in range(256)])


def held_out() -> Column:
    """Null for rows without a doc_id; nothing is learnt from them, either."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def cells(data: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell of each n-gram of the words, bounds of each word in them); a word of n bytes has n + 1."""
    raw = np.frombuffer(b"   " + data + b" ", np.uint8).astype(np.uint32)
    size = end - start + 1
    bounds = np.concatenate(([0], np.cumsum(size)))
    inside = np.arange(bounds[-1]) - np.repeat(bounds[:-1], size)
    at = np.repeat(start, size) + inside + 3
    last = inside + 1 == np.repeat(size, size)
    gram = np.where(last, 32, raw[at]).astype(np.uint32)
    for back in (1, 2, 3):
        # a word's first byte has a space before it and nothing else
        before = np.where(inside >= back, raw[at - back], np.where(inside == back - 1, 32, 0)).astype(np.uint32)
        gram |= before << np.uint32(8 * back)
    with np.errstate(over="ignore"):
        return ((gram.astype(U) * U(0x9E3779B97F4A7C15)) >> U(64 - BITS)).astype(np.int64), bounds


def words_of(texts: list[bytes]) -> tuple[Words, np.ndarray, np.ndarray]:
    """The words of some texts in lower case, the first place of each different one, and which of these each word is."""
    words = Words(texts, ALPHA)
    _, first, which = np.unique(words.hash, return_index=True, return_inverse=True)
    return words, first, which


@dataclass
class Model:
    langs: list[str]
    logs: np.ndarray  # cell by language

    def proportions(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: words, share of each language in its chosen set (0 outside), and shares drawn to even by few words."""
        n, shares = np.zeros(len(texts)), np.zeros((len(texts), len(self.langs)))
        for begin, some in chunks(texts) if self.langs else ():
            words, first, which = words_of(some)
            if not len(words.hash):
                continue
            at, bounds = cells(words.data, words.start[first], words.end[first])
            logs = np.add.reduceat(self.logs[at], bounds[:-1], axis=0)
            # a document meets each of its different words once, with the number of times it occurs
            pairs, times = np.unique(words.text * len(first) + which, return_counts=True)
            shares[begin : begin + len(some)] = mixtures(logs[pairs % len(first)].astype(np.float64), pairs // len(first), times.astype(np.float64), len(some))
            n[begin : begin + len(some)] = words.counts
        even = (n[:, None] * shares + 0.5) / (n + len(self.langs) / 2)[:, None]
        return n, shares, even


def mixtures(logs: np.ndarray, doc: np.ndarray, times: np.ndarray, docs: int) -> np.ndarray:
    """Proportions in the set of languages chosen for each document. logs: of each word (rows, ascending by document) under each
    language; a document without words has only zeros."""
    k = logs.shape[1]
    top = logs.max(1)
    likely = np.exp(logs - top[:, None])
    n = np.bincount(doc, times, docs)
    single = np.stack([np.bincount(doc, times * logs[:, c], docs) for c in range(k)], 1)
    best = single.argmax(1)
    chosen = np.zeros((docs, k), bool)
    chosen[np.arange(docs), best] = n > 0
    shares, level = chosen.astype(np.float64), single[np.arange(docs), best] - np.bincount(doc, times * top, docs)
    penalty = PENALTY * np.log2(1 + n)
    open_ = np.flatnonzero(n > 0)
    while k > 1 and len(open_):
        mine = np.isin(doc, open_)
        part, own, count = likely[mine], doc[mine], times[mine]
        # what each language would take of the words that the set explains worse
        mixed = np.maximum((part * shares[own]).sum(1), 1e-300)
        gain = np.stack([np.bincount(own, count * np.log1p(np.minimum(part[:, c] / mixed, 1e12) * 0.1), docs) for c in range(k)], 1)
        gain[chosen] = -1
        new = gain.argmax(1)
        trial = chosen.copy()
        trial[open_, new[open_]] = True
        found, reached = maximised(part, own, count, trial, docs)
        better = open_[(reached - level)[open_] > penalty[open_]]
        chosen[better], shares[better], level[better] = trial[better], found[better], reached[better]
        open_ = better[chosen[better].sum(1) < k]
    return shares


def maximised(likely: np.ndarray, doc: np.ndarray, times: np.ndarray, allowed: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the allowed languages by expectation-maximisation, and the log-likelihood reached."""
    shares = allowed / np.maximum(1, allowed.sum(1))[:, None]
    n = np.maximum(1, np.bincount(doc, times, docs))
    level, moving = np.full(docs, -np.inf), np.bincount(doc, minlength=docs) > 0
    for _ in range(STEPS):
        joint = likely * shares[doc]
        total = np.maximum(joint.sum(1), 1e-300)
        reached = np.bincount(doc, times * np.log(total), docs)
        # each document stops by itself, so that its result doesn't depend on those beside it
        still = moving & (reached - level >= ENOUGH)
        level, moving = np.where(moving, reached, level), still
        if not moving.any():
            break
        weight = times / total
        taken = np.stack([np.bincount(doc, weight * joint[:, c], docs) for c in range(likely.shape[1])], 1) / n[:, None]
        shares = np.where(moving[:, None], taken, shares)
        if (stay := moving[doc]).mean() < 0.7:
            likely, doc, times = likely[stay], doc[stay], times[stay]
    return shares, level


def lowered(texts: pd.Series) -> list[bytes]:
    return [t.lower().encode() for t in texts]


def counts(docs: DataFrame) -> DataFrame:
    """(lang, cell, n) over all documents that may be learnt from."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, texts in batch.groupby("lang", sort=False)["text"]:
                have = total.setdefault(lang, np.zeros(SLOTS, np.int64))
                for _, some in chunks(lowered(texts)):
                    words, first, which = words_of(some)
                    if len(first):
                        at, bounds = cells(words.data, words.start[first], words.end[first])
                        have += np.bincount(at, np.repeat(np.bincount(which), np.diff(bounds)), SLOTS).astype(np.int64)
        for lang, have in total.items():
            at = np.flatnonzero(have)
            yield pd.DataFrame({"lang": lang, "cell": at.astype(np.int32), "n": have[at]})

    known = docs.filter(~held_out() & F.col("lang").isNotNull()).select("lang", text_of().alias("text"))
    return known.mapInPandas(run, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame) -> Model:
    """Learns every lang value that isn't null, from documents that aren't held out. The driver gets at most ``SLOTS`` counts a
    language; languages of which no document holds a letter are learnt as such, with no n-gram of their own."""
    found = stored(counts(docs), "language-counts").toPandas()
    named = docs.filter(~held_out() & F.col("lang").isNotNull()).select("lang").distinct().collect()
    langs = sorted(r.lang for r in named)
    number = {x: i for i, x in enumerate(langs)}
    table = np.zeros((SLOTS, len(langs)))
    table[found["cell"].to_numpy(np.int64), found["lang"].map(number).to_numpy(np.int64)] = found["n"]
    seen = max(1, int((table.sum(1) > 0).sum()))
    return Model(langs, np.log((table + FLOOR) / (table.sum(0) + FLOOR * seen)).astype(np.float32))


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """docs' doc_id and text's findings: (doc_id, held_out, lang_pred, score, shares), one row for each row of docs.

    ``lang_pred`` is ``und`` with a score of 0 if the text is null or has no letter (Unicode category L), or if no language could
    be learnt. ``score`` is the share of the predicted language, drawn to even shares where the text has few words. ``shares`` maps
    each language of the chosen set to its share of the words. Equal shares go to the first language by name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        langs = np.array([*shared.value.langs, UNKNOWN], object)
        for batch in batches:
            n, shares, even = shared.value.proportions(lowered(batch["text"]))
            sure = batch["lettered"].to_numpy(bool) & (n > 0) & (len(langs) > 1)
            best, score = np.full(len(batch), len(langs) - 1), np.zeros(len(batch))
            if sure.any():
                best[sure] = shares[sure].argmax(1)
                score[sure] = even[sure, best[sure]]
            sets = [{langs[c]: float(s[c]) for c in np.flatnonzero(s)} if ok else {} for s, ok in zip(shares, sure, strict=True)]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "lang_pred": langs[best], "score": score, "shares": sets})

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    ids = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), lettered.alias("lettered"), text_of().alias("text"))
    return rows.mapInPandas(run, f"doc_id {ids}, held_out boolean, lang_pred string, score double, shares map<string,double>")


def languages(docs: DataFrame) -> DataFrame:
    return identified(docs, fit(docs))
