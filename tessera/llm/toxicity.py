"""Toxicity from class-conditional Kneser-Ney word models.

Two bigram models, one of toxic and one of ordinary labelled documents, are absolutely discounted and
interpolated with their unigrams; what the unigrams' discounts free goes to continuation counts (how many different words
precede a word) that both classes share, with one place for words never seen. All three levels sum to one. So an
expression too rare for its class leans on what all training documents say about its words. Counts are different texts, not
tokens: a text that repeats an expression counts once, and so do copies of a text. Discounts come from the counts of counts, one each for expressions seen once, twice and more often.

A document is scored by the difference of its two log-likelihoods for each of its different bigrams, over the whole text,
and by the unigrams' difference over its most toxic word and its ``TOP`` most toxic words, each counted once: a long text
may be toxic in a few words. A logistic curve fitted on training documents outside the counts turns these means into a
score from 0 to 1.

The classifier is fitted on at most ``MAX_DOCS`` labelled documents of each class, chosen by a hash of their ids; that bounds
the models, which are broadcast whole. Scoring covers all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import stored, text_of
from tessera.llm.words import LETTERS, LOWER, SEQUENCE, Words, chunks

MAX_DOCS = {0: 4000, 1: 4000}
DISCOUNT, LEAST = 0.75, 0.05
TOP = 3
FOLDS = 5


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


@dataclass
class Model:
    """Log-likelihood differences (toxic minus ordinary) by hash (signed, ascending): of words, of bigrams that occurred, of
    backing off from a word, and of a word never seen."""

    uni: np.ndarray
    uni_llr: np.ndarray
    bi: np.ndarray
    bi_llr: np.ndarray
    back: np.ndarray
    back_llr: np.ndarray
    unknown: float = 0.0

    @staticmethod
    def find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
        """values at the wanted keys."""
        if not len(keys):
            return np.full(len(wanted), default)
        wanted = wanted.view(np.int64)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at].astype(np.float64), default)

    def features(self, texts: list[bytes]) -> np.ndarray:
        """For each text: number of different bigrams, their mean difference, the largest difference of a word, the mean of
        the TOP largest (missing ones as 0)."""
        out = np.zeros((len(texts), 4))
        for begin, part in chunks(texts):
            w = Words(part, LETTERS, LOWER)
            if not len(w.hash):
                continue
            # each different word and pair is looked up once, in ascending order
            word, of = np.unique(w.hash, return_inverse=True)
            single = self.find(self.uni, self.uni_llr, word, self.unknown)
            back = self.find(self.back, self.back_llr, word, 0.0)
            first, pair = w.sequences(2)
            pair, which = np.unique(pair, return_inverse=True)
            seen = self.find(self.bi, self.bi_llr, pair, np.nan)
            # a bigram counts once in a text, as in the counts; so does the first word, which has none before it
            some = np.flatnonzero(w.counts)
            rows, opening = begin + some, w.bounds[:-1][some]
            total, n = np.bincount(w.text[opening], single[of[opening]], len(part)), w.counts.clip(max=1)
            if len(first):
                once = np.unique(w.text[first] * len(pair) + which, return_index=True)[1]
                at, text = first[once], w.text[first[once]]
                found = seen[which[once]]
                each = np.where(np.isnan(found), back[of[at]] + single[of[at + 1]], found)
                total, n = total + np.bincount(text, each, len(part)), n + np.bincount(text, minlength=len(part))
            out[rows, 0] = n[some]
            out[rows, 1] = total[some] / n[some]
            # the most toxic words of each text, each counted once
            distinct = np.unique(w.text * len(word) + of)
            text, value = distinct // len(word), single[distinct % len(word)]
            starts = np.searchsorted(text, some)
            place = np.repeat(np.arange(len(some)), np.diff(starts, append=len(text)))
            for k in range(TOP):
                most = np.maximum.reduceat(value, starts)
                if k == 0:
                    out[rows, 2] = most
                out[rows, 3] += np.where(np.isfinite(most), most, 0) / TOP
                hit = np.flatnonzero(value == most[place])
                value[hit[np.append(True, np.diff(place[hit]) != 0)]] = -np.inf
        return out


def grams(sample: DataFrame) -> DataFrame:
    """(v, w, n0, n1, k0, k1) over a sample (toxic, fold, text): documents of each class with word w after word v; v is null
    for the word alone. k0 and k1 leave out the fold that is set aside for the curve."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            toxic, fold = batch["toxic"].to_numpy(), batch["fold"].to_numpy()
            for begin, part in chunks([t.encode() for t in batch["text"]]):
                w = Words(part, LETTERS, LOWER)
                first, _ = w.sequences(2)
                one = pd.DataFrame({"text": w.text, "w": w.hash.view(np.int64)}).drop_duplicates()
                two = pd.DataFrame({"text": w.text[first], "v": w.hash[first].view(np.int64), "w": w.hash[first + 1].view(np.int64)}).drop_duplicates()
                rows = pd.concat([one.assign(v=0, pair=False), two.assign(pair=True)])
                at = begin + rows["text"].to_numpy()
                yield pd.DataFrame({"pair": rows["pair"].astype(bool), "v": rows["v"].astype("int64"), "w": rows["w"], "toxic": toxic[at], "fold": fold[at]})

    counted = lambda c: F.count_if(c).cast("int")
    kept = F.col("fold") != 0
    return sample.select("toxic", "fold", "text").mapInPandas(run, "pair boolean, v long, w long, toxic int, fold int").groupBy("pair", "v", "w").agg(
        counted(F.col("toxic") == 0).alias("n0"), counted(F.col("toxic") == 1).alias("n1"), counted((F.col("toxic") == 0) & kept).alias("k0"), counted((F.col("toxic") == 1) & kept).alias("k1"),
    )


def discounts(rows: DataFrame, c: str) -> tuple[float, float, float]:
    """What counts of one, two and more give up, from how many expressions of the class have each of the counts 1 to 4."""
    n = rows.agg(*(F.count_if(F.col(c) == k).alias(f"n{k}") for k in range(1, 5))).first()
    if not n.n1 or not n.n2:
        return (DISCOUNT,) * 3
    y = n.n1 / (n.n1 + 2 * n.n2)
    out = [k - (k + 1) * y * n[f"n{k + 1}"] / n[f"n{k}"] if n[f"n{k}"] else DISCOUNT for k in (1, 2, 3)]
    return tuple(min(max(d, LEAST), k - LEAST) for k, d in enumerate(out, 1))


def lost_of(d: tuple[float, float, float], c: str) -> Column:
    return F.when(F.col(c) == 0, 0.0).when(F.col(c) == 1, d[0]).when(F.col(c) == 2, d[1]).otherwise(d[2])


def lost(d: tuple[float, float, float], n: np.ndarray) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(n, 3)]


def model(counts: DataFrame, a: str, b: str) -> Model:
    """The differences from ordinary counts ``a`` and toxic counts ``b``. Words and what follows them are gathered first (the
    sample bounds them) and shared with the tasks that hold the bigrams, which are never shuffled again."""
    classes = (a, b)
    seen = counts.filter(F.col(a) + F.col(b) > 0)
    words, pairs = seen.filter(~F.col("pair")).select("w", a, b), seen.filter("pair").select("v", "w", a, b)
    du, dp = ([discounts(rows, c) for c in classes] for rows in (words, pairs))

    def gathered(rows: DataFrame, key: str) -> dict[str, np.ndarray]:
        t = rows.toArrow()
        out = {c: t[c].to_numpy() for c in t.column_names}
        del t
        order = np.argsort(out[key], kind="stable").astype(np.int32)
        for c in out:  # one column at a time, to hold no more than one copy
            out[c] = out[c][order]
        return out

    shared = pairs.groupBy("w").agg(F.count("*").alias("before"))
    uni = gathered(words.join(shared, "w", "left").select("w", *classes, F.coalesce("before", F.lit(0)).alias("before")), "w")
    begins = gathered(pairs.groupBy("v").agg(*(F.sum(c).alias(f"t{i}") for i, c in enumerate(classes)), *(F.sum(lost_of(dp[i], c)).alias(f"f{i}") for i, c in enumerate(classes))), "v")
    places = uni["before"].sum() + len(uni["w"]) + 1
    single, unknown = [], []
    for c, d in zip(classes, du, strict=True):
        total, given = max(1, uni[c].sum()), lost(d, uni[c])
        single.append((uni[c] - given) / total + given.sum() / total * (uni["before"] + 1) / places)
        unknown.append(given.sum() / total / places)
    totals = [begins[f"t{i}"] for i in (0, 1)]
    rest = [np.where(t > 0, begins[f"f{i}"] / np.maximum(1, t), 1.0) for i, t in enumerate(totals)]
    known = counts.sparkSession.sparkContext.broadcast((uni["w"], single, begins["v"], totals, rest))

    def conditional(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            word, p, start, t, r = known.value
            v, w = x["v"].to_numpy(), x["w"].to_numpy()
            of, at = np.searchsorted(start, v), np.searchsorted(word, w)
            own = []
            for i, c in enumerate(classes):
                n = x[c].to_numpy()
                own.append(np.where(t[i][of] > 0, (n - lost(dp[i], n)) / np.maximum(1, t[i][of]), 0.0) + r[i][of] * p[i][at])
            both, at = np.stack([v, w], 1).ravel().view(np.uint64), np.arange(len(x)) * 2
            yield pd.DataFrame({"key": SEQUENCE.ranges(both, at, at + 2).view(np.int64), "llr": np.log(own[1] / own[0]).astype(np.float32)})

    bi = gathered(pairs.mapInPandas(conditional, "key long, llr float"), "key")
    ratio = float(np.log(unknown[1] / unknown[0])) if min(unknown) > 0 else 0.0
    known.destroy()
    return Model(uni["w"], np.log(single[1] / single[0]), bi["key"], bi["llr"], begins["v"], np.log(rest[1] / rest[0]), ratio)


def curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton steps: (centre, scale, coefficients with the intercept first)."""
    centre, scale = x.mean(0), np.maximum(x.std(0), 0.1)
    z = np.column_stack([np.ones(len(x)), (x - centre) / scale])
    beta = np.zeros(z.shape[1])
    ridge = np.diag([1e-6] + [0.05] * x.shape[1]) * max(1.0, weight.sum() / len(weight))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (weight * (y - p)) - ridge @ beta)
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return centre, scale, beta


def shaped(f: np.ndarray) -> np.ndarray:
    return f[:, 1:]


class Scorer:
    def __init__(self, model: Model | None, fit: tuple | None, constant: float) -> None:
        self.model, self.fit, self.constant = model, fit, constant

    def __call__(self, texts: list[str]) -> np.ndarray:
        if self.model is None:
            return np.full(len(texts), self.constant)
        centre, scale, beta = self.fit
        out = np.empty(len(texts))
        for at in range(0, len(texts), 500):  # not all texts of a batch as bytes at once
            z = (shaped(self.model.features([t.encode() for t in texts[at : at + 500]])) - centre) / scale
            out[at : at + 500] = 1 / (1 + np.exp(-np.clip(beta[0] + z @ beta[1:], -30, 30)))
        return out


def fit(docs: DataFrame, labels: DataFrame, max_docs: dict[int, int] = MAX_DOCS) -> Scorer:
    """Learns from labelled rows that aren't held out. Of a document labelled more than once the higher label counts;
    null labels don't. Without toxic examples every score is 0, without ordinary ones 1."""
    known = labels.filter("toxic is not null and doc_id is not null").filter(~held_out()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.withColumn("order", F.xxhash64("doc_id"))
    chosen = [known.filter(F.col("toxic") == c).orderBy("order", "doc_id").limit(max_docs[c]) for c in (0, 1)]
    picked = chosen[0].unionByName(chosen[1]).select("doc_id", "toxic", F.pmod("order", F.lit(FOLDS)).cast("int").alias("fold"))
    # as many rows of a few bytes as max_docs allows
    sample = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(picked), "doc_id")
    # equal texts are one, toxic if any of them is
    sample = stored(sample.groupBy("text").agg(F.max("toxic").alias("toxic"), F.min("fold").alias("fold"), F.min("doc_id").alias("doc_id")), "toxic-sample")
    size = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not size.get(0) or not size.get(1):
        return Scorer(None, None, 0.0 if not size.get(1) else 1.0)
    counts = stored(grams(sample.repartition("doc_id")), "toxic-grams")
    trial = docs.sparkSession.sparkContext.broadcast(model(counts, "k0", "k1"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(trial.value.features([t.encode() for t in batch["text"]]), columns=["n", "mean", "word", "top"]).assign(toxic=batch["toxic"])

    aside = sample.filter("fold = 0").select("text", "toxic").mapInPandas(run, "n double, mean double, word double, top double, toxic int").toPandas()
    trial.destroy()
    all_of = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    y = aside["toxic"].to_numpy(np.float64)
    if not 0 < y.sum() < len(y):
        return Scorer(model(counts, "n0", "n1"), (np.zeros(3), np.ones(3), np.array([-4.0, 0.0, 0.5, 1.0])), 0.0)
    weight = np.where(y == 1, all_of[1] / size[1], all_of[0] / size[0])
    weight = weight / weight.mean()
    return Scorer(model(counts, "n0", "n1"), curve(shaped(aside[["n", "mean", "word", "top"]].to_numpy()), y, weight), 0.0)


def scored(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """docs with ``score``; only the text enters it, null as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value(texts.to_list()))

    return docs.withColumn("score", score(text_of()))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs; a null doc_id isn't held out."""
    out = scored(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows predicted toxic, with their own columns."""
    name = "score"
    while name in docs.columns:
        name += "_"
    clean = scored(docs.withColumnRenamed("score", name), fit(docs, labels)).filter("score < 0.5").drop("score")
    return clean.withColumnRenamed(name, "score").select(docs.columns)
