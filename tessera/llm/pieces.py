"""SentencePiece merge-type vocabularies: encoding by a score-ordered agenda of adjacent symbol pairs, and decoding.

A text becomes symbols, one a character; the agenda always merges the adjacent pair whose piece has the best score, the
leftmost of equals, until no pair makes a piece; characters outside the vocabulary fall back to bytes. No piece of the
vocabulary has a space mark after another character (this is checked when the model is loaded), so no merge crosses the
start of a space-marked segment and each different segment is encoded once. Short segments run the
agenda side by side, one merge a round each; long ones run it on a heap. Every batch's segments are compared with
the sentencepiece library, whose ids hold where the two differ.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import text_of
from tessera.llm.units import Memory, laid_out, pieces_of

MODEL = "piece_bpe_32k.model"
MARK = "▁"
SEGMENT = re.compile(f"{MARK}+[^{MARK}]*")
SHORT, ROW = 48, 200
#: bytes of texts that are encoded at a time and of segments that are remembered: what a worker holds follows from these
PIECE, KEPT = 2_000_000, 16_000_000
#: texts whose segments aren't simply their words
ODD = f"^ |  | $|^$|{MARK}"
NONE = np.int32(2**31 - 1)


class Vocabulary:
    def __init__(self, path: str) -> None:
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.pieces = {sp.id_to_piece(i): i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        if any(MARK in p.lstrip(MARK) for p in self.pieces) or not sp.is_byte(sp.piece_to_id("<0x00>")):
            raise ValueError("the vocabulary isn't split at spaces, or has no byte pieces")
        self.end = sp.eos_id()
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.chars = {c: self.pieces.get(c, -1) for p in self.pieces for c in p}
        if -1 in self.chars.values():
            raise ValueError("a piece holds a character that isn't a piece")
        self.by_point = np.full(max(map(ord, self.chars)) + 1, -1, np.int64)
        for c, i in self.chars.items():
            self.by_point[ord(c)] = i
        scores = sorted({sp.get_score(i) for i in self.pieces.values()}, reverse=True)
        rank = {s: k for k, s in enumerate(scores)}
        self.merge = {}
        for p, i in self.pieces.items():
            for k in range(1, len(p)):
                if p[:k] in self.pieces and p[k:] in self.pieces:
                    self.merge[self.pieces[p[:k]], self.pieces[p[k:]]] = (rank[sp.get_score(i)], i)
        keys = np.array([a * size + b for a, b in self.merge], np.int64)
        order = np.argsort(keys)
        self.size, self.keys = size, keys[order]
        both = np.array(list(self.merge.values()), np.int32)[order]
        self.ranks, self.made = both[:, 0], both[:, 1]

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, piece) of pairs of symbols; rank NONE where they make no piece. Negative symbols make none."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = (self.keys[at] == key) & (a >= 0) & (b >= 0)
        return np.where(found, self.ranks[at], NONE), self.made[at]

    def side_by_side(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The agenda of many short segments: in each round every segment merges its best pair. Returns all symbols in a row
        and how many each segment has; characters outside the vocabulary are below -2."""
        counts = np.array([len(s) for s in segments])
        points = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)
        known = np.minimum(points, len(self.by_point) - 1)
        flat = np.where((points < len(self.by_point)) & (self.by_point[known] >= 0), self.by_point[known], -3 - points.astype(np.int64))
        begin = np.cumsum(counts) - counts
        order = np.argsort(counts, kind="stable")
        ends: list[np.ndarray] = []
        left = np.zeros(len(segments), np.int64)
        for at in range(0, len(order), 16384):
            block = order[at : at + 16384]
            width = max(2, int(counts[block[-1]]))
            column = np.arange(width)
            inside = column < counts[block][:, None]
            symbols = np.full((len(block), width), -2, np.int64)  # -2: no symbol
            symbols[inside] = flat[(begin[block][:, None] + column)[inside]]
            rows = np.arange(len(block))
            state, rank = symbols.copy(), self.pairs(symbols[:, :-1], symbols[:, 1:])[0]
            while len(rows):
                j = rank.argmin(1)
                going = rank[np.arange(len(rows)), j] != NONE
                if not going.all():
                    symbols[rows[~going]] = state[~going]
                    rows, state, rank, j = rows[going], state[going], rank[going], j[going]
                    if not len(rows):
                        break
                each = np.arange(len(rows))
                made = self.pairs(state[each, j], state[each, j + 1])[1]
                moved = column[:-1] > j[:, None]  # what lies right of the pair moves up by one
                state[:, :-1] = np.where(moved, state[:, 1:], state[:, :-1])
                state[:, -1] = -2
                state[each, j] = made
                rank[:, :-1] = np.where(moved[:, :-1], rank[:, 1:], rank[:, :-1])
                rank[:, -1] = NONE
                for k in (j - 1, j):
                    ok = np.flatnonzero((k >= 0) & (k < width - 1))
                    rank[ok, k[ok]] = self.pairs(state[ok, k[ok]], state[ok, k[ok] + 1])[0]
            there = symbols != -2
            left[block] = there.sum(1)
            ends.append(symbols[there])
        # back into the segments' own order
        done = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        place = np.empty(len(segments), np.int64)
        place[order] = np.cumsum(left[order]) - left[order]
        own = np.cumsum(left) - left
        return done[np.repeat(place - own, left) + np.arange(len(done))], left

    def on_a_heap(self, segment: str) -> list[int]:
        """The agenda of one segment: pairs wait on a heap and are skipped if a merge has since changed a side."""
        symbols = [s if (s := self.chars.get(c, -1)) >= 0 else -3 - ord(c) for c in segment]
        before, after = list(range(-1, len(symbols) - 1)), [*range(1, len(symbols)), -1]
        agenda = [(*m, i, symbols[i], symbols[i + 1]) for i in range(len(symbols) - 1) if (m := self.merge.get((symbols[i], symbols[i + 1])))]
        agenda = [(rank, i, piece, a, b) for rank, piece, i, a, b in agenda]
        heapq.heapify(agenda)
        while agenda:
            _, i, piece, a, b = heapq.heappop(agenda)
            j = after[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:
                continue
            symbols[i], symbols[j], after[i] = piece, None, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (m := self.merge.get((symbols[x], symbols[y]))):
                    heapq.heappush(agenda, (m[0], x, m[1], symbols[x], symbols[y]))
        return self.written([s for s in symbols if s is not None])

    def written(self, symbols: list[int]) -> list[int]:
        if min(symbols, default=0) >= 0:
            return symbols
        return [i for s in symbols for i in ((s,) if s >= 0 else (self.bytes[b] for b in chr(-3 - s).encode()))]

    def agenda(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the segments, and how many each has."""
        short = np.array([len(s) <= SHORT for s in segments], bool)
        flat, n = self.side_by_side([s for s in segments if len(s) <= SHORT])
        ends = np.cumsum(n)
        odd = np.unique(np.repeat(np.arange(len(n)), n)[flat < 0]).tolist()
        # segments with characters outside the vocabulary and long ones are written one by one, behind the others
        where = np.flatnonzero(short)
        apart = {int(where[k]): np.array(self.written(flat[ends[k] - n[k] : ends[k]].tolist())) for k in odd}
        apart |= {i: np.array(self.on_a_heap(segments[i]), np.int64) for i in np.flatnonzero(~short).tolist()}
        begin, counts = np.zeros(len(segments), np.int64), np.zeros(len(segments), np.int64)
        begin[where], counts[where] = ends - n, n
        at = len(flat)
        for i, ids in apart.items():
            begin[i], counts[i] = at, len(ids)
            at += len(ids)
        every = np.concatenate([flat, *apart.values()]).astype(np.int64)
        ends = np.cumsum(counts)
        return every[np.repeat(begin - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)].astype("<u4"), counts


class Coder:
    """Encodes and decodes texts; segments are remembered between batches."""

    def __init__(self, path: str) -> None:
        self.vocabulary = Vocabulary(path)
        self.memory = Memory(self.learn, KEPT)
        self.differed = 0

    def learn(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """new: segments without their first mark. The library checks them ROW in a row, as one text; only where that text's
        ids differ, and for segments of marks alone, are they checked one by one, and its ids hold."""
        ids, counts = self.vocabulary.agenda([MARK + s for s in new])
        library = self.vocabulary.library
        rows = [i for i, s in enumerate(new) if s and s[-1] != MARK]
        alone = [i for i, s in enumerate(new) if not s or s[-1] == MARK]
        rows = [rows[at : at + ROW] for at in range(0, len(rows), ROW)]
        ends = np.cumsum(counts)
        begins = ends - counts
        for row, theirs in zip(rows, library.encode([" ".join(new[i] for i in row) for row in rows], num_threads=1), strict=True):
            n = counts[row]
            own = ids[np.repeat(begins[row] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            if not np.array_equal(own, theirs):
                alone += row
        changed = {}
        for i in alone:
            # the library gives no mark to an empty text, only to an empty first segment
            if new[i] and not np.array_equal(theirs := np.array(library.encode(new[i]), "<u4"), ids[begins[i] : ends[i]]):
                changed[i] = theirs
                self.differed += 1
        if changed:
            each = [changed.get(i, ids[begins[i] : ends[i]]) for i in range(len(new))]
            ids, counts = np.concatenate(each), np.array([len(x) for x in each])
        return ids, counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each text's with an end id, and where each text's end."""
        odd = pc.match_substring_regex(texts, pattern=ODD).to_numpy(zero_copy_only=False)
        parts = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        others = [[s[1:] for s in SEGMENT.findall(MARK + t.replace(" ", MARK))] if t else [] for t in texts.filter(pa.array(odd)).to_pylist()]
        n = np.empty(len(texts), np.int64)
        n[~odd], n[odd] = np.diff(parts.offsets.to_numpy()), [len(x) for x in others]
        begin = np.empty(len(texts), np.int64)
        begin[~odd], begin[odd] = parts.offsets.to_numpy()[:-1], len(parts.values) + np.cumsum(n[odd]) - n[odd]
        words = pa.concat_arrays([parts.values, pa.array(list(chain.from_iterable(others)), pa.string())]).dictionary_encode()
        ids, counts, of = self.memory(words.dictionary)
        bounds = np.cumsum(n)
        order = np.repeat(begin - (bounds - n), n) + np.arange(bounds[-1] if len(bounds) else 0)
        flat, ends = laid_out(ids, counts, of[words.indices.to_numpy()[order]])
        ends = np.concatenate(([0], ends))[bounds]
        return np.insert(flat, ends, self.vocabulary.end), ends + np.arange(1, len(texts) + 1)

    def decode(self, flat: np.ndarray, ends: np.ndarray) -> list[str]:
        """The text of each row of ids, by the library."""
        begins = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        return [self.vocabulary.library.decode(flat[a:b].tolist()) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]


_CODERS: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    """One for each Python worker."""
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]


def laid_in_pieces(own: Coder, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """(doc_id, ids, decoded) of a batch of (doc_id, text), some PIECE of texts at a time."""
    texts = batch.column("text")
    for begin, end in pieces_of(texts, PIECE):
        flat, ends = own.encode(texts[begin:end])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(flat.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id")[begin:end], lists, pa.array(own.decode(flat, ends), pa.string())], ["doc_id", "ids", "decoded"])


def encoded(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded) for every row: the ids with an end id and the text that they decode to. Null texts are empty
    and have the end id alone; other columns are ignored. ``model`` is the file's place on every machine."""
    path = model or public_tokenizers.path(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in batches:
            yield from laid_in_pieces(own, batch)
        # a worker outlives its task: what Arrow has freed goes back
        pa.default_memory_pool().release_unused()

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def decoded(rows: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    path = model or public_tokenizers.path(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = coder(path).vocabulary.library
        for batch in batches:
            texts = [library.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long"), F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(run, "doc_id long, text string")


def digests(rows: DataFrame) -> DataFrame:
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
