"""Token files: one wavelet matrix per shard, in ascending order of doc_id.

Documents are dealt out once by range of doc_id, tokenized in order and packed into shards of about ``SHARD`` ids, whole
documents each. A shard is one row of a Parquet table whose ``payload`` is the compressed file of that shard: for each
bit of the ids, from the highest, the bits of all ids in the order left by the bits above (zeros first, each group in its
old order), packed and compressed one plane at a time, with the running number of ones at every ``BLOCK`` bits beside it.
Access, rank (how often an id occurs before a place) and select (where it occurs for the nth time) go through the planes
without decoding the shard.

The payload: 4 bytes ``WMX1``, then little-endian: number of ids (8 bytes), number of planes (4), for each plane its number
of zeros (8), the length of its compressed bits (8) and of its compressed directory (8); then these byte strings in order.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._common import shuffle_partitions, text_of
from tessera.sources.shared import shared_dir
from tessera.llm.units import Memory, laid_out, pieces_of

TOKENIZER = "byte_bpe_50k.json"
END = 0
SHARD, BLOCK = 1 << 20, 512
ROW = 200
#: white space beside white space or at the end, by every rule that calls a character white
WHITE = "\\t-\\r \\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
ODD = f"[{WHITE}][{WHITE}]|[{WHITE}]$"
MAGIC = b"WMX1"


def pack(ids: np.ndarray) -> bytes:
    planes = max(1, int(ids.max(initial=0)).bit_length())
    z, head, body, now = zstandard.ZstdCompressor(level=1), [], [], ids.astype(np.uint16 if planes <= 16 else np.uint32)
    for bit in reversed(range(planes)):
        ones = (now & now.dtype.type(1 << bit)) != 0
        bits = np.packbits(ones, bitorder="little")
        full = np.concatenate((bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8))).view(np.uint64)
        directory = np.concatenate(([0], np.cumsum(np.bitwise_count(full).reshape(-1, BLOCK // 64).sum(1)))).astype("<u4")
        a, b = z.compress(bits.tobytes()), z.compress(directory.tobytes())
        head.append(struct.pack("<QQQ", len(now) - int(directory[-1]), len(a), len(b)))
        body += [a, b]
        now = np.concatenate((now[~ones], now[ones]))
    return b"".join([MAGIC, struct.pack("<QI", len(ids), planes), *head, *body])


class Shard:
    """Reads one payload; planes are decompressed as they are needed."""

    def __init__(self, payload: bytes) -> None:
        if payload[:4] != MAGIC:
            raise ValueError("not a token file")
        self.n, self.planes = struct.unpack_from("<QI", payload, 4)
        self.zeros, self.parts, at = [], [], 16 + 24 * self.planes
        for k in range(self.planes):
            zeros, a, b = struct.unpack_from("<QQQ", payload, 16 + 24 * k)
            self.zeros.append(zeros)
            self.parts.append((payload[at : at + a], payload[at + a : at + a + b]))
            at += a + b
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def plane(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self.open:
            z = zstandard.ZstdDecompressor()
            self.open[k] = np.frombuffer(z.decompress(self.parts[k][0]), np.uint8), np.frombuffer(z.decompress(self.parts[k][1]), "<u4")
        return self.open[k]

    def bit(self, k: int, i: int) -> int:
        return int(self.plane(k)[0][i >> 3] >> (i & 7) & 1)

    def ones(self, k: int, i: int) -> int:
        """Ones among the first i bits of plane k."""
        bits, directory = self.plane(k)
        block = i // BLOCK
        begin = block * BLOCK // 8
        whole = int(np.bitwise_count(bits[begin : i >> 3]).sum())
        rest = (int(bits[i >> 3]) & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else 0
        return int(directory[block]) + whole + rest

    def access(self, i: int) -> int:
        value = 0
        for k in range(self.planes):
            b, r = self.bit(k, i), self.ones(k, i)
            value, i = value << 1 | b, self.zeros[k] + r if b else i - r
        return value

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """Where the token's occurrences begin after the last plane, and how many lie before place i."""
        low, high = 0, i
        for k in range(self.planes):
            a, b = self.ones(k, low), self.ones(k, high)
            low, high = (self.zeros[k] + a, self.zeros[k] + b) if token >> (self.planes - 1 - k) & 1 else (low - a, high - b)
        return low, high - low

    def rank(self, token: int, i: int) -> int:
        return 0 if token >> self.planes else self._range(token, i)[1]

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, nth: int) -> int:
        """Place of the nth occurrence, from 0; -1 beyond the last."""
        if token >> self.planes:
            return -1
        low, count = self._range(token, self.n)
        if not 0 <= nth < count:
            return -1
        i = low + nth
        for k in reversed(range(self.planes)):
            one = token >> (self.planes - 1 - k) & 1
            i = self._place(k, i - self.zeros[k] if one else i, one)
        return i

    def _place(self, k: int, nth: int, one: int) -> int:
        low, high = 0, self.n
        while low < high:  # the least i with more than nth such bits before i + 1
            middle = (low + high) // 2
            r = self.ones(k, middle + 1)
            low, high = (low, middle) if (r if one else middle + 1 - r) > nth else (middle + 1, high)
        return low

    def ids(self) -> np.ndarray:
        """All ids, from the lowest plane up."""
        kind = np.uint16 if self.planes <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for k in reversed(range(self.planes)):
            ones = np.unpackbits(self.plane(k)[0], count=self.n, bitorder="little").view(bool)
            up = np.empty(self.n, kind)
            up[~ones], up[ones] = now[: self.zeros[k]], now[self.zeros[k] :] | kind(1 << (self.planes - 1 - k))
            now = up
        return now


class Encoder:
    """The tokenizers library on each different unit once, where a unit is a word with the space or line end that leads it.

    A byte-level pattern never continues over a space or a line end that stands alone between characters that aren't white
    space, so a text that is cut there has the ids of its units in a row. Texts with two white-space characters in a row, or
    one at their end, are encoded whole."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        #: which tokens begin with a space or a line end, each of which this byte-level vocabulary writes as one letter
        names = self.library.get_vocab()
        self.opens = np.zeros(max(names.values()) + 1, bool)
        self.opens[[i for t, i in names.items() if t[0] in "\u0120\u010a"]] = True
        self.memory = Memory(self.units)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for at in range(0, len(texts), 2000):
            out += [np.array(e.ids, "<u4") for e in self.library.encode_batch_fast(texts[at : at + 2000], add_special_tokens=False)]
        return out

    def units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units that a space or line end leads, and how many each has: encoded ROW in a row, which the library
        does faster, and cut where a token begins with either."""
        rows = [units[at : at + ROW] for at in range(0, len(units), ROW)]
        ids, counts = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for row, found in zip(rows, self._library(["".join(row) for row in rows]), strict=True):
            at = np.flatnonzero(self.opens[found])
            if len(at) == len(row):
                ids.append(found)
                counts.append(np.diff(at, append=len(found)))
            else:
                each = self._library(row)
                ids += each
                counts.append(np.array([len(x) for x in each]))
        return np.concatenate(ids), np.concatenate(counts)

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        odd = pc.match_substring_regex(texts, pattern=ODD).to_numpy(zero_copy_only=False)
        # every unit but a text's first follows a cut: a space leads it unless it brings a line end
        parts = pc.split_pattern(pc.replace_substring(texts.filter(pa.array(~odd)), "\n", " \n"), " ")
        bounds, words = parts.offsets.to_numpy(), parts.values
        begins = np.zeros(len(words), bool)
        begins[bounds[:-1]] = True
        first, later = (words.filter(pa.array(x)).dictionary_encode() for x in (begins, ~begins))
        units = later.dictionary
        ids, counts, of = self.memory(pc.if_else(pc.starts_with(units, "\n"), units, pc.binary_join_element_wise(" ", units, "")))
        opening = self._library(first.dictionary.to_pylist())
        kind = np.empty(len(words), np.int64)
        kind[begins], kind[~begins] = first.indices.to_numpy() + len(counts), of[later.indices.to_numpy()]
        flat, ends = laid_out(np.concatenate([ids, *opening]), np.concatenate((counts, np.array([len(x) for x in opening], np.int64))), kind)
        ends = np.concatenate(([0], ends))[bounds]
        plain = (flat[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
        whole = iter(self._library(texts.filter(pa.array(odd)).to_pylist()))
        return [next(whole).tobytes() if x else next(plain) for x in odd.tolist()]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker, on one thread."""
    if path not in _ENCODERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


FILE = "part int, shard int, doc_ids array<long>, counts array<long>, n long, payload binary"


def write(docs: DataFrame, to: str, tokenizer: str | None = None) -> None:
    """Writes the token files of docs to a folder. Null texts are empty (their end id alone); null ids come last; rows that
    share an id follow one another by a hash of the text; other columns are ignored."""
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie")]
    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, shard = encoder(path), TaskContext.get().partitionId(), 0
        doc_ids: list = []
        counts: list[int] = []
        waiting: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal doc_ids, counts, waiting, size, shard
            out = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int32()), "doc_ids": pa.array([doc_ids], pa.list_(pa.int64())), "counts": pa.array([counts], pa.list_(pa.int64())), "n": pa.array([size], pa.int64()), "payload": pa.array([pack(np.frombuffer(b"".join(waiting), "<u4"))], pa.binary())})
            doc_ids, counts, waiting, size, shard = [], [], [], 0, shard + 1
            return out

        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for begin, end in pieces_of(texts):
                for doc_id, tokens in zip(ids[begin:end], own(texts[begin:end]), strict=True):
                    n = len(tokens) // 4 + 1
                    if waiting and size + n > SHARD:
                        yield flush()
                    doc_ids.append(doc_id)
                    counts.append(n)
                    waiting += [tokens, END.to_bytes(4, "little")]
                    size += n
        if waiting:
            yield flush()

    rows.mapInArrow(run, FILE).write.option("compression", "none").parquet(to)


def read(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    parts = files.groupBy("part").agg(F.sum("n").alias("all"))
    # a window over the parts, of which there are as many as shuffle partitions
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("part", "shard", "n").withColumn("ahead", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(bases, "part").select("part", "shard", (F.col("ahead") + F.col("base")).alias("start"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, shard, doc_ids, counts, payload in zip(*(batch[c] for c in ("part", "shard", "doc_ids", "counts", "payload")), strict=True):
                ids, bounds = Shard(payload).ids().astype("<u4"), np.concatenate(([0], np.cumsum(counts)))
                yield pd.DataFrame({"part": part, "shard": shard, "doc_id": pd.array([None if pd.isna(i) else int(i) for i in doc_ids], "Int64"), "within": bounds[:-1], "n_tokens": counts, "ids_crc32": [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]})

    rows = files.select("part", "shard", "doc_ids", "counts", "payload").mapInPandas(run, "part int, shard int, doc_id long, within long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["part", "shard"]).select("doc_id", (F.col("start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame) -> DataFrame:
    """Writes docs' token files to the shared folder and reads them back."""
    import uuid

    to = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write(docs, to)
    return read(docs.sparkSession.read.schema(FILE).parquet(to))
