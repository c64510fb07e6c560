"""Token ids as wavelet matrices: one compressed, queryable file per shard.

A shard holds the ids of consecutive documents in ascending doc_id order. Its
file is a wavelet matrix: one bit plane per bit of an id, most significant
first, each plane stably sorted by the planes above it. Planes are cut into
blocks of 2**16 bits that are compressed one by one and found by an index with
the number of ones before each block, so a token, a count of a token up to a
place (rank), and the place of its k-th occurrence (select) are answered by
inflating one block per plane. An inflated block has the number of ones before
every 512 of its bits, so rank looks at 512 bits at most; all occurrences of a
token are selected together, plane by plane.

Scale: documents are range-partitioned by (doc_id, text hash) and streamed; a
task closes a file whenever it holds ``shard_tokens``, so memory is one shard.
Files are renamed into place under names that a repeated task gives again. The
manifest has one row per file; where each file starts among all ids is a
running sum over it, in two levels, so no window sees more than the files of
one partition or one row per partition.

Defined cases: a null text is empty and yields the end id alone; a null doc_id
sorts first; rows repeating a doc_id follow each other in order of their
text's hash; an empty table writes no file; doc_id is a whole number (a file
holds 64-bit ids): number rows of other ids first.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from poolgauge.llm.bpe import codec, spans, vocabulary_path
from poolgauge.llm.common import cut, fresh_folder, text_key
from poolgauge.llm.files import read_whole, write_whole
from poolgauge.shipping import ship_code

END_ID = 0
SHARD_TOKENS = 1 << 22
BLOCK_BITS, RANK_BITS = 1 << 16, 512
READ_TASKS = 20_000
_MAGIC = b"WVMX0001"


def build(tokens: np.ndarray, doc_ids: list[int | None], ends: np.ndarray, level: int = 1) -> bytes:
    """The file of one shard. ``ends``: for each document, the tokens up to its end."""
    squeeze = zstandard.ZstdCompressor(level=level).compress
    bits = max(1, int(tokens.max()).bit_length()) if len(tokens) else 1
    now = tokens.astype(np.uint16 if bits <= 16 else np.uint32)
    out, at, planes = [_MAGIC], len(_MAGIC), []

    def put(data: bytes) -> list[int]:
        nonlocal at
        out.append(packed := squeeze(data))
        at += len(packed)
        return [at - len(packed), len(packed)]

    for shift in range(bits - 1, -1, -1):
        one = (now & now.dtype.type(1 << shift)) != 0
        blocks, before, total = [], [], 0
        for a in range(0, len(one), BLOCK_BITS):
            part = one[a : a + BLOCK_BITS]
            before.append(total)
            total += int(np.count_nonzero(part))
            blocks.append(put(np.packbits(part, bitorder="little").tobytes()))
        planes.append({"blocks": blocks, "before": before, "zeros": len(one) - total})
        now = np.concatenate((now[np.flatnonzero(~one)], now[np.flatnonzero(one)]))
    known = np.array([x is not None for x in doc_ids], dtype=bool)
    index = {"n": len(tokens), "bits": bits, "planes": planes, "docs": len(doc_ids), "ids": put(np.array([x or 0 for x in doc_ids], "<i8").tobytes()), "known": put(known.tobytes()), "ends": put(np.asarray(ends, "<i8").tobytes())}
    tail = squeeze(json.dumps(index, separators=(",", ":")).encode())
    return b"".join([*out, tail, len(tail).to_bytes(8, "little"), _MAGIC])


class WaveletFile:
    """Reads one shard's file; blocks are inflated when asked for."""

    def __init__(self, data: bytes):
        if data[:8] != _MAGIC or data[-8:] != _MAGIC:
            raise ValueError("not a whole wavelet file")
        self.data = memoryview(data)
        size = int.from_bytes(data[-16:-8], "little")
        self.index = json.loads(self._inflate(len(data) - 16 - size, size))
        self.n, self.bits, self.planes = self.index["n"], self.index["bits"], self.index["planes"]
        self.ends = np.frombuffer(self._inflate(*self.index["ends"]), "<i8")
        known = np.frombuffer(self._inflate(*self.index["known"]), bool)
        self.doc_ids = [int(x) if k else None for x, k in zip(np.frombuffer(self._inflate(*self.index["ids"]), "<i8"), known, strict=True)]
        self._block = lru_cache(256)(self._ranked)
        self._before = lru_cache(64)(lambda plane: np.array(self.planes[plane]["before"], dtype=np.int64))

    def _inflate(self, at: int, size: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self.data[at : at + size])

    def _bits_of(self, plane: int, block: int) -> np.ndarray:
        width = min(BLOCK_BITS, self.n - block * BLOCK_BITS)
        return np.unpackbits(np.frombuffer(self._inflate(*self.planes[plane]["blocks"][block]), np.uint8), count=width, bitorder="little")

    def _ranked(self, plane: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        """The bits of a block, and the ones before every RANK_BITS of them."""
        bits = self._bits_of(plane, block)
        ones = np.add.reduceat(bits, np.arange(0, len(bits), RANK_BITS), dtype=np.int64)
        return bits, np.concatenate(([0], np.cumsum(ones)))

    def _ones(self, plane: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        if i >= self.n:
            return self.n - self.planes[plane]["zeros"]
        block, rest = divmod(i, BLOCK_BITS)
        bits, ranks = self._block(plane, block)
        group = rest // RANK_BITS
        return self.planes[plane]["before"][block] + int(ranks[group]) + int(np.count_nonzero(bits[group * RANK_BITS : rest]))

    def access(self, i: int) -> int:
        """The token at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for p in range(self.bits):
            one = int(self._block(p, i // BLOCK_BITS)[0][i % BLOCK_BITS])
            value = value << 1 | one
            i = self.planes[p]["zeros"] + self._ones(p, i) if one else i - self._ones(p, i)
        return value

    def _range(self, token: int, i: int) -> tuple[int, int]:
        a, b = 0, i
        for p in range(self.bits):
            if token >> (self.bits - 1 - p) & 1:
                z = self.planes[p]["zeros"]
                a, b = z + self._ones(p, a), z + self._ones(p, b)
            else:
                a, b = a - self._ones(p, a), b - self._ones(p, b)
        return a, b

    def rank(self, token: int, i: int) -> int:
        """How often the token occurs before place i."""
        if not 0 <= token < 1 << self.bits:
            return 0
        a, b = self._range(token, min(i, self.n))
        return b - a

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _select_bits(self, plane: int, one: int, k: np.ndarray) -> np.ndarray:
        """The places of the k-th (from 0, ascending) ones or zeros of a plane."""
        before = self._before(plane)
        if not one:
            before = np.arange(len(before)) * BLOCK_BITS - before
        block = np.searchsorted(before, k, side="right") - 1
        out = np.empty_like(k)
        for b in np.unique(block).tolist():
            mine = slice(*np.searchsorted(block, (b, b + 1)).tolist())
            out[mine] = b * BLOCK_BITS + np.flatnonzero(self._block(plane, b)[0] == one)[k[mine] - before[b]]
        return out

    def _places(self, token: int, k: np.ndarray) -> np.ndarray:
        """The places of a token's k-th occurrences, ascending."""
        i = self._range(token, self.n)[0] + k
        for p in range(self.bits - 1, -1, -1):
            one = token >> (self.bits - 1 - p) & 1
            i = self._select_bits(p, one, i - self.planes[p]["zeros"] if one else i)
        return i

    def select(self, token: int, k: int) -> int:
        """The place of the token's k-th occurrence, from 0; IndexError if there are fewer."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        return int(self._places(token, np.array([k], dtype=np.int64))[0])

    def occurrences(self, token: int) -> np.ndarray:
        """All places of a token, ascending."""
        return self._places(token, np.arange(self.count(token), dtype=np.int64)) if self.count(token) else np.zeros(0, dtype=np.int64)

    def tokens(self) -> np.ndarray:
        """All tokens, by merging the planes from the last to the first."""
        now = np.zeros(self.n, dtype=np.uint32 if self.bits > 16 else np.uint16)
        for p in range(self.bits - 1, -1, -1):
            # whole planes pass once: the store of single blocks is for lookups
            one = np.concatenate([self._bits_of(p, k) for k in range(len(self.planes[p]["blocks"]))]).astype(bool) if self.n else np.zeros(0, bool)
            z, up = self.planes[p]["zeros"], np.empty_like(now)
            up[np.flatnonzero(~one)] = now[:z]
            up[np.flatnonzero(one)] = now[z:] | now.dtype.type(1 << (self.bits - 1 - p))
            now = up
        return now


def write(docs: DataFrame, folder: str, path: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the shards of ``docs`` (doc_id, text); the checkpointed manifest: part, seq, path, n_docs, n_tokens, start."""
    ship_code(docs.sparkSession)
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, seq = codec(path), TaskContext.get().partitionId(), 0
        ids, ends, tokens, n = [], [], [], 0
        done: list[dict] = []

        def close() -> None:
            nonlocal seq, n, ids, ends, tokens
            uri = f"{folder}/shard-{part:06d}-{seq:05d}.wvm"
            write_whole(uri, build(np.concatenate(tokens), ids, np.array(ends)))
            done.append({"part": part, "seq": seq, "path": uri, "n_docs": len(ids), "n_tokens": n})
            seq, n, ids, ends, tokens = seq + 1, 0, [], [], []

        for batch in batches:
            doc_ids = iter(batch.column(0).to_pylist())
            for texts in spans(batch.column(1)):
                found, stops = own.encode_column(texts)
                found = np.insert(found, stops, END_ID)
                stops = stops + np.arange(1, len(stops) + 1)
                for doc_id, a, b in zip(islice(doc_ids, len(stops)), [0, *stops[:-1].tolist()], stops.tolist(), strict=True):
                    tokens.append(found[a:b])
                    n += b - a
                    ids.append(doc_id)
                    ends.append(n)
                    if n >= shard_tokens:
                        close()
        if ids:
            close()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key(F.col("text")).alias("th"))
    dealt = rows.repartitionByRange("doc_id", "th").sortWithinPartitions("doc_id", "th").select("doc_id", "text")
    files = cut(dealt.mapInArrow(run, "part int, seq int, path string, n_docs long, n_tokens long"))
    before = lambda *by: Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("own"))
    parts = parts.select("part", F.coalesce(F.sum("own").over(before("part")), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cut(files.withColumn("inside", inside).join(parts, "part").withColumn("start", F.col("base") + F.col("inside")).drop("inside", "base"))


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files of a manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = WaveletFile(read_whole(uri))
                flat = shard.tokens().astype("<u4")
                starts = np.concatenate(([0], shard.ends[:-1]))
                crc = [zlib.crc32(flat[a:b].data) for a, b in zip(starts.tolist(), shard.ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, pa.int64()), pa.array(base + starts), pa.array(shard.ends - starts), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    ship_code(manifest.sparkSession)
    dealt = manifest.select("path", "start").repartition(max(1, min(manifest.count(), READ_TASKS)))
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def occurrences(manifest: DataFrame, token: int) -> DataFrame:
    """doc_id, place (in the document) and global place of every occurrence of a token, by select on each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = WaveletFile(read_whole(uri))
                at = shard.occurrences(token)
                doc = np.searchsorted(shard.ends, at, side="right")
                starts = np.concatenate(([0], shard.ends[:-1]))
                yield pa.RecordBatch.from_arrays([pa.array([shard.doc_ids[d] for d in doc], pa.int64()), pa.array(at - starts[doc]), pa.array(at + base)], names=["doc_id", "place", "at"])

    ship_code(manifest.sparkSession)
    return manifest.select("path", "start").mapInArrow(run, "doc_id long, place long, at long")


def digest(spark: SparkSession, docs: DataFrame, path: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write all documents' ids to a fresh shared folder and describe what the files hold."""
    return read(write(docs, fresh_folder(spark, "wavelet"), path, shard_tokens))
