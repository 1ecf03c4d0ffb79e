"""Cross-entropy difference: how much better a target model predicts a document than a background model does.

Both are interpolated Witten-Bell models of order ``ORDER`` over one vocabulary of symbols: one for white space, the most
frequent characters of the corpus (ASCII capitals folded), and ``HASHED`` symbols that all other characters share by code
point, so that texts in rarer scripts keep their wording. The vocabulary bounds the number of n-grams (SYMBOLS ** ORDER),
which bounds what a task counts, what reaches the driver and what is broadcast, whatever the size of the corpus; counts
cover every character of every document. Each task sends the n-grams of its part once, so what is gathered grows with the
number of parts.

The models are matched: the background's counts, of all documents, are brought to the size of the target's, and its numbers
of different n-grams to what a draw of that size is expected to hold, so that both are smoothed alike. No document is
scored by a model that has seen it: documents fall into two folds by a hash of their text (copies into one), and each fold
is scored by the models of the other.

A document's score is the mean over its symbols of the loss under the target model less the loss under the background
model, in nats: lower is closer to the target.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import stored, text_of
from tessera.llm.words import packed

ORDER, SYMBOLS, HASHED = 4, 50, 8
SPACE, FOLDS = 0, 2
PART, ROWS = 1_000_000, 1000


def vocabulary(texts: DataFrame, size: int = SYMBOLS) -> np.ndarray:
    """The symbol of each code point: counted in the tasks, summed by Spark; ties go to the smaller code point."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(0x110000, np.int64)
        for batch in batches:
            for t in batch["text"]:
                points = np.frombuffer(t.encode("utf-32-le"), np.uint32)
                counts = np.bincount(points)
                total[: len(counts)] += counts
        some = np.flatnonzero(total)
        yield pd.DataFrame({"point": some, "n": total[some]})

    folded = F.when(F.col("point").between(65, 90), F.col("point") + 32).otherwise(F.col("point"))
    white = F.col("point").between(9, 13) | (F.col("point") == 32)
    top = texts.select("text").mapInPandas(run, "point int, n long").filter(~white).groupBy(folded.alias("point")).agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "point").limit(size - 1 - HASHED).collect()
    table = (1 + np.arange(0x110000) % HASHED).astype(np.uint8)
    table[[*range(9, 14), 32]] = SPACE
    for i, r in enumerate(top):
        table[r.point] = i + 1 + HASHED
    table[65:91] = table[97:123]
    return table


def grams(texts: list[str], table: np.ndarray, order: int = ORDER, size: int = SYMBOLS) -> tuple[np.ndarray, np.ndarray]:
    """(code, text) of the order-gram that ends at each symbol; a text is preceded by order - 1 spaces."""
    pad = " " * (order - 1)
    lengths = np.array([len(t) for t in texts])
    symbols = table[np.frombuffer((pad + pad.join(texts)).encode("utf-32-le"), np.uint32)].astype(np.int64)
    code = np.zeros(max(0, len(symbols) - order + 1), np.int64)
    for k in range(order):
        code = code * size + symbols[k : len(symbols) - order + 1 + k]
    begin = np.concatenate(([0], np.cumsum(lengths + order - 1)))[:-1]
    text = np.repeat(np.arange(len(texts)), lengths)
    at = np.arange(len(text)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(begin, lengths)
    return code[at], text


def parts(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= PART or i == len(texts) - 1:
            yield begin, texts[begin : i + 1]
            begin, size = i + 1, 0


def counts(rows: DataFrame, table: np.ndarray) -> DataFrame:
    """(code, and t and b of every fold: target and background) from (text, target, fold): summed in each task before the
    shuffle. Texts come compressed."""
    shared = rows.sparkSession.sparkContext.broadcast(table)
    kinds = [f"{what}{k}" for k in range(FOLDS) for what in "tb"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z = zstandard.ZstdDecompressor()
        total = np.zeros((2 * FOLDS, SYMBOLS**ORDER), np.int32)
        for batch in ((b.iloc[at : at + ROWS] for b in batches for at in range(0, len(b), ROWS))):
            target, fold = batch["target"].to_numpy(bool), batch["fold"].to_numpy()
            for begin, part in parts([z.decompress(t).decode() for t in batch["text"]]):
                code, text = grams(part, shared.value)
                for k in range(FOLDS):
                    own = fold[begin + text] == k
                    np.add.at(total[2 * k + 1], code[own], 1)
                    np.add.at(total[2 * k], code[own & target[begin + text]], 1)
        some = np.flatnonzero(total[1::2].any(0))
        for at in range(0, len(some), 200_000):
            code = some[at : at + 200_000]
            yield pd.DataFrame({"code": code.astype(np.int32)} | {c: total[k, code].astype(np.int64) for k, c in enumerate(kinds)})

    schema = ", ".join(["code int", *(f"{c} long" for c in kinds)])
    return rows.mapInPandas(run, schema).groupBy("code").agg(*(F.sum(c).alias(c) for c in kinds))


def log_model(dense: np.ndarray, rate: float = 1.0, size: int = SYMBOLS) -> np.ndarray:
    """Log-probability of the last symbol of every n-gram, from counts of all n-grams, of which the share ``rate`` is drawn:
    each order mixes its frequencies with the order below by the number of different symbols that its context has had
    (Witten-Bell), the lowest with 1 / size. Of an n-gram with count c a draw holds rate * c, and at least one with
    probability 1 - (1 - rate)^c."""
    p = np.full(size, 1.0 / size)
    levels = [dense.reshape(-1, size)]
    while levels[-1].shape[0] > 1:
        levels.append(levels[-1].reshape(size, -1, size).sum(0))
    for c in reversed(levels):
        total, kinds = rate * c.sum(1, keepdims=True), (1 - (1 - rate) ** c).sum(1, keepdims=True)
        below = np.tile(p.reshape(-1, size), (c.shape[0] // max(1, p.size // size), 1)) if c.shape[0] > 1 else p.reshape(1, size)
        some = total + kinds > 0
        p = np.where(some, (rate * c + kinds * below) / np.where(some, total + kinds, 1), below)
    return np.log(p).ravel()


def difference(model: pd.DataFrame, fold: int) -> np.ndarray:
    """Loss under the target less loss under the background by code (SYMBOLS ** ORDER floats), from the other folds; zero if
    they hold no target."""
    dense = {}
    for what in "tb":
        dense[what] = np.zeros(SYMBOLS**ORDER)
        dense[what][model["code"].to_numpy()] = sum(model[f"{what}{k}"].to_numpy() for k in range(FOLDS) if k != fold)
    t, b = dense["t"].sum(), dense["b"].sum()
    if not t:
        return np.zeros(SYMBOLS**ORDER, np.float32)
    return (log_model(dense["b"], t / b) - log_model(dense["t"])).astype(np.float32)


def scored(docs: DataFrame, target: DataFrame) -> DataFrame:
    """(doc_id, n_symbols, score) for every row of docs: the background is all of docs, the target the rows whose doc_id is
    in ``target``. Null texts are empty and score 0, as does a document whose other fold holds no target. Rows without a
    doc_id are background; each of repeated rows counts; other columns are ignored."""
    # written, so that the join below stands on two plain exchanges and Spark can split an id that many rows share, or none
    named = stored(target.filter("doc_id is not null").select(F.col("doc_id").alias("t_id")).distinct(), "lm-target")
    rows = docs.select("doc_id", text_of().alias("text"), F.pmod(F.xxhash64(text_of()), F.lit(FOLDS)).cast("int").alias("fold"))
    table = vocabulary(rows)
    # one shuffle of the compressed texts at every size: the target grows with the corpus
    marked = packed(rows).join(named.hint("merge"), F.col("doc_id") == F.col("t_id"), "left").select("text", F.col("t_id").isNotNull().alias("target"), "fold")
    # at most SYMBOLS ** ORDER rows of 36 bytes; most n-grams never occur
    model = stored(counts(marked, table), "lm-grams").toPandas()
    shared = docs.sparkSession.sparkContext.broadcast((table, [difference(model, k) for k in range(FOLDS)]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, loss = shared.value
        for batch in batches:
            fold = batch["fold"].to_numpy()
            for begin, part in parts(batch["text"].tolist()):
                code, text = grams(part, table)
                n = np.bincount(text, minlength=len(part))
                each = np.where(fold[begin + text] == 0, loss[0][code], loss[1][code])
                total = np.bincount(text, each, len(part))
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[begin : begin + len(part)].astype("Int64").to_numpy(), "n_symbols": n, "score": total / np.maximum(1, n)})

    return rows.mapInPandas(run, "doc_id long, n_symbols long, score double")


def target_of(labels: DataFrame) -> DataFrame:
    """The documents that labels call good."""
    return labels.filter("quality = 1").select("doc_id")
