"""Byte-level BPE encoding and decoding with content-defined chunk reuse.

A rolling hash of the last 16 bytes marks places in a text where a chunk may
end, so texts that share a passage share its chunks wherever it stands. Each
worker process encodes a chunk once and keeps it in a bounded store; documents
are put together from chunks. A join is *exact* if it lies where the
tokenizer's own pattern always ends a piece (a printable ASCII or alphanumeric
character before, a space or line feed after: no alternative of the pattern
spans it, and neither does a special token). At any other join the text from
the last exact place before it to the first exact place after it is encoded
again and replaces the tokens of both chunks there; the repair widens until
both its ends agree with exact places or with the ends of the text. So the ids
are those of the tokenizers library for the whole text.

Scale: one pass, no shuffle; memory is a batch, the bounded stores and the
tokenizer. Reuse across tasks is left aside on purpose: to send every chunk of
every text through a shuffle and its ids back would cost more than encoding.

Which tokenizers: what ends a piece follows from the byte-level pattern of the
vocabulary, so :func:`require_known` reads normalizer, pre-tokenizer, model and
added tokens from the file and refuses any other kind. A text stretch that
holds an added token goes to the library as it is.

Defined cases: a null text is empty and has no ids; an unpaired surrogate
cannot occur in Spark strings; rows repeating a doc_id are each encoded.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolgauge.shipping import ship_code

VOCABULARY = "byte_bpe_50k.json"
#: A chunk ends about once in 2**CHUNK_BITS bytes.
CHUNK_BITS = 9
#: Bytes that each generation of a worker process's store of pieces may hold (chunks: half).
STORE_BYTES = 64 << 20
#: What an entry of a store takes beside its text and ids.
ENTRY_BYTES = 150
#: Bytes of text that are encoded together as a column.
COLUMN_BYTES = 4 << 20
#: Pieces that go to the library as one text.
JOINT_PIECES = 64

#: Where a piece surely ends: see exact_at.
_EXACT = re.compile(r"[!-~][ \n]|[^\W_][ \n]")

_GEAR = np.random.default_rng(20_240_607).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def cut_points(data: bytes, bits: int = CHUNK_BITS) -> np.ndarray:
    """Byte offsets after which a chunk ends, by a gear hash of the 16 bytes before; UTF-8 characters stay whole."""
    if len(data) < 32:
        return np.zeros(0, dtype=np.int64)
    raw = np.frombuffer(data, np.uint8)
    h = _GEAR[raw]
    for step in (1, 2, 4, 8):
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    at = np.flatnonzero((h[:-1] >> np.uint32(32 - bits)) == 0) + 1
    while len(at) and (inside := (raw[at] & 0xC0) == 0x80).any():
        at = at + inside
        at = at[at < len(raw)]
    return np.unique(at)


def exact_at(text: str, at: int) -> bool:
    """Whether the tokenizer surely starts a new piece at ``at``."""
    return at == 0 or at == len(text) or (text[at] in " \n" and ("!" <= text[at - 1] <= "~" or text[at - 1].isalnum()))


def _exact_after(text: str, at: int) -> int:
    m = _EXACT.search(text, at - 1)
    return m.start() + 1 if m else len(text)


def _exact_before(text: str, at: int) -> int:
    reach = 64
    while True:
        low, found = max(0, at - reach), 0
        for m in _EXACT.finditer(text, low, at):
            found = m.start() + 1
        if found or low == 0:
            return found
        reach *= 8


def chunks(text: str, bits: int = CHUNK_BITS) -> list[str]:
    """``text`` cut at content-defined places, moved on to an exact place if the next 64 characters hold one."""
    data = text.encode("utf-8")
    points = cut_points(data, bits)
    if not len(points):
        return [text] if text else []
    if len(data) != len(text):  # bytes to characters
        heads = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
        points = heads[points - 1]
    out, last = [], 0
    for p in points.tolist():
        if p <= last:
            continue
        if (m := _EXACT.search(text, p - 1, p + 64)) is not None:
            p = m.start() + 1
        if last < p < len(text):
            out.append(text[last:p])
            last = p
    out.append(text[last:])
    return out


def require_known(spec: dict) -> list[str]:
    """The added tokens of a tokenizer's description; ValueError unless its pieces end where this module says."""
    pre, model, decoder = spec.get("pre_tokenizer") or {}, spec.get("model") or {}, spec.get("decoder") or {}
    known = {
        "normalizer": spec.get("normalizer") is None,
        "pre_tokenizer": pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space"),
        "model": model.get("type", "BPE") == "BPE" and not model.get("dropout") and not model.get("byte_fallback") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix"),
        "decoder": decoder.get("type") == "ByteLevel",
    }
    added = spec.get("added_tokens") or []
    # white space within one, or swallowed around it, would move the places where pieces end
    known["added_tokens"] = all(t["content"] and not re.search(r"\s", t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in added)
    if wrong := sorted(k for k, good in known.items() if not good):
        raise ValueError(f"chunks cannot be joined exactly for this tokenizer: {', '.join(wrong)}")
    return [t["content"] for t in added]


class Store:
    """Ids by text in two generations: when the young one is full it becomes the old one, and the old one goes."""

    def __init__(self, most: int):
        self.most, self.held = most, 0
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def put(self, key: str, ids: bytes) -> None:
        self.young[key] = ids
        self.held += len(key) + len(ids) + ENTRY_BYTES

    def put_all(self, keys: list[str], ids, size: int) -> None:
        """As put, for keys and ids of ``size`` bytes together."""
        self.young.update(zip(keys, ids, strict=True))
        self.held += size + ENTRY_BYTES * len(keys)

    def missing(self, keys: set[str]) -> set[str]:
        """The keys in neither generation; all others are in the young one afterwards."""
        if self.held > self.most:
            self.young, self.old, self.held = {}, self.young, 0
        absent = keys.difference(self.young)
        for k in [k for k in absent if k in self.old]:
            self.put(k, self.old[k])
            absent.discard(k)
        return absent


def _pieces(text: str) -> list[str]:
    """The text cut where the tokenizer surely starts a new piece: before a space, line feed, full stop or comma."""
    if not _regular(text):
        return [p for p in _BREAK.split(text) if p]
    for mark in " \n.,":
        text = text.replace(mark, "\0" + mark)
    parts = text.split("\0")
    return parts if parts[0] else parts[1:]


class Codec:
    """Encoder and decoder of one worker process."""

    def __init__(self, path: str, bits: int = CHUNK_BITS, store_bytes: int = STORE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = require_known(json.loads(self.tokenizer.to_str()))
        self.bits = bits
        self.chunks, self.pieces = Store(store_bytes // 2), Store(store_bytes)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.bytes_of = [self._bytes(i) for i in range(size)]
        self.sizes = np.array([len(x) for x in self.bytes_of], dtype=np.int64)

    def _bytes(self, i: int) -> bytes:
        """As the library: a token with any character outside the byte alphabet stands for itself as a whole."""
        token = self.tokenizer.id_to_token(i)
        if token is None:
            return b""
        return b"".join(map(_BYTE_OF.__getitem__, token)) if all(c in _BYTE_OF for c in token) else token.encode()

    def _has_added(self, text: str) -> bool:
        return any(t in text for t in self.added)

    def _has_added_bytes(self, data: bytes) -> bool:
        return any(t.encode() in data for t in self.added)

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: set[str]) -> None:
        """Encode pieces; those that may stand behind each other exactly go to the library as one text."""
        lone = [k for k in pieces if k[0] not in " \n" or not _CLOSED.match(k[-1])]
        joint = list(pieces.difference(lone))
        for k, ids in zip(lone, self._library(lone), strict=True):
            self.pieces.put(k, ids)
        groups = [joint[at : at + JOINT_PIECES] for at in range(0, len(joint), JOINT_PIECES)]
        for part, found in zip(groups, self._library(["".join(g) for g in groups]), strict=True):
            ends = np.cumsum(self.sizes[np.frombuffer(found, "<u4")])
            want = np.cumsum([len(k) if k.isascii() else len(k.encode()) for k in part])
            at = np.searchsorted(ends, want)
            if (ends[at] != want).any():
                raise AssertionError("a token reaches over an exact place")
            stops = ((at + 1) * 4).tolist()
            self.pieces.put_all(part, map(found.__getitem__, map(slice, [0, *stops[:-1]], stops)), len(found) + int(want[-1]))

    def _encode_chunks(self, new: list[str]) -> None:
        """Put chunks into the store. Their pieces, each beginning with the space at an exact place, are learned together."""
        special = [c for c in new if self._has_added(c)]
        for c, ids in zip(special, self._library(special), strict=True):
            self.chunks.put(c, ids)
        held = set(special)
        split = [(c, _pieces(c)) for c in new if c not in held]
        if missing := self.pieces.missing(set(chain.from_iterable(keys for _, keys in split))):
            self._learn(missing)
        ids_of = self.pieces.young.__getitem__
        for c, keys in split:
            self.chunks.put(c, b"".join(map(ids_of, keys)))

    def _stored(self, chunk: str) -> bytes:
        if chunk not in self.chunks.young and self.chunks.missing({chunk}):
            self._encode_chunks([chunk])
        return self.chunks.young[chunk]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts; new chunks of all of them are encoded together, which spares calls of the library."""
        parts = [chunks(t, self.bits) if t else [] for t in texts]
        if new := self.chunks.missing(set(chain.from_iterable(parts))):
            self._encode_chunks(list(new))
        return [self._joined(t, p) if t else b"" for t, p in zip(texts, parts, strict=True)]

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def encode_by_piece(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts from the store of pieces alone, where chunks need not be kept."""
        ids, ends = self.encode_column(pa.array(texts, pa.string()))
        return [x.tobytes() for x in np.split(ids, ends[:-1])] if texts else []

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a column's whole texts, end to end, and where each text's end.

        Pieces are found and told apart in the column's own bytes, so Python
        sees each different piece once, however often it stands there.
        """
        texts = texts.fill_null("")
        wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        bounds = np.frombuffer(texts.buffers()[1], wide)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, wide)
        lo, hi = int(bounds[0]), int(bounds[-1])
        if lo == hi:
            return np.zeros(0, "<u4"), np.zeros(len(texts), np.int64)
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[lo:hi]
        bounds = bounds - lo

        first = np.zeros(len(raw) + 1, bool)
        first[_breaks(raw)] = True
        first[bounds] = True
        at = np.flatnonzero(first).astype(wide)
        pieces = pa.Array.from_buffers(texts.type, len(at) - 1, [None, pa.py_buffer(at), data.slice(lo, hi - lo)]).dictionary_encode()
        keys, which = pieces.dictionary.to_numpy(zero_copy_only=False).tolist(), pieces.indices.to_numpy()
        if missing := self.pieces.missing(set(keys)):
            self._learn(missing)
        found = list(map(self.pieces.young.__getitem__, keys))
        pool = np.frombuffer(b"".join(found), "<u4")
        # there are no more ids than bytes, so places among them fit the column's offsets
        sizes = np.fromiter(map(len, found), wide, len(found)) // 4
        each = sizes[which]
        ends = np.zeros(len(each) + 1, wide)
        np.cumsum(each, out=ends[1:])
        place = np.repeat((np.cumsum(sizes, dtype=wide) - sizes)[which] - ends[:-1], each)
        place += np.arange(len(place), dtype=wide)
        ids = pool[place]
        return self._with_added(texts, raw, bounds, ids, ends[np.searchsorted(at, bounds[1:])].astype(np.int64))

    def _with_added(self, texts: pa.Array, raw: np.ndarray, bounds: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same with texts that hold an added token encoded by the library."""
        whole = raw.tobytes()
        if not self._has_added_bytes(whole):
            return ids, ends
        held = np.array([self._has_added_bytes(whole[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)])
        each = np.split(ids, ends[:-1])
        for i, found in zip(np.flatnonzero(held).tolist(), self._library(texts.filter(pa.array(held)).to_pylist()), strict=True):
            each[i] = np.frombuffer(found, "<u4")
        return np.concatenate(each), np.cumsum([len(x) for x in each])

    def _joined(self, text: str, parts: list[str]) -> bytes:
        ends = list(accumulate(map(len, parts)))
        repairs: list[list[int]] = []
        for p in ends[:-1]:
            if not exact_at(text, p):
                a, b = _exact_before(text, p), _exact_after(text, p)
                if repairs and a <= repairs[-1][1]:
                    repairs[-1][1] = max(repairs[-1][1], b)
                else:
                    repairs.append([a, b])
        if not repairs:
            return b"".join(map(self._stored, parts))
        return b"".join(self._repaired(text, parts, ends, repairs))

    def _repaired(self, text: str, parts: list[str], ends: list[int], repairs: list[list[int]]) -> Iterator[bytes]:
        """Chunks' ids outside the stretches to repair, and those stretches encoded again."""
        w = at = 0
        for part, end in zip(parts, ends, strict=True):
            start = end - len(part)
            while at < end:
                if w < len(repairs) and repairs[w][0] == at:
                    yield self._stored(text[at : repairs[w][1]])
                    at = repairs[w][1]
                    w += 1
                else:
                    stop = min(end, repairs[w][0]) if w < len(repairs) else end
                    yield self._part(part, at - start, stop - start)
                    at = stop

    def _part(self, chunk: str, a: int, b: int) -> bytes:
        """The chunk's ids from character a to b, both exact places; encoded anew if its tokens don't agree with them."""
        found = self._stored(chunk)
        if (a, b) == (0, len(chunk)):
            return found
        ids = np.frombuffer(found, "<u4")
        ends = np.concatenate(([0], np.cumsum(self.sizes[ids])))
        lo, hi = len(chunk[:a].encode()), len(chunk[:b].encode())
        i, j = np.searchsorted(ends, (lo, hi))
        return ids[i:j].tobytes() if (ends[i], ends[j]) == (lo, hi) else self._library([chunk[a:b]])[0]

    def decode(self, ids: bytes) -> str:
        """As the library's decode(ids, skip_special_tokens=False)."""
        table = self.bytes_of
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def _byte_alphabet() -> dict[str, bytes]:
    """The byte that each character of a byte-level token stands for: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): bytes([b]) for b in plain} | {chr(256 + i): bytes([b]) for i, b in enumerate(rest)}


_BYTE_OF = _byte_alphabet()
_CLOSED = re.compile(r"[!-~\w]")
#: A full stop or comma after a letter or digit starts a piece, as neither joins in a run with it.
_BREAK = re.compile(r"(?<=[!-~\w])(?=[ \n])|(?<=[^\W_])(?=[.,])")
#: What keeps a text from being cut at every space, line feed, full stop and comma.
_LOOSE = re.compile(r"[\W_][ \n.,](?<![!-/:-@\[-`{-~][ \n])|^[.,]|\0")
#: Kinds of ASCII bytes: space or line feed, full stop or comma, letter or digit, other printable ones, the rest.
_KIND = bytes(ord("s" if c in b" \n" else "d" if c in b".," else "a" if chr(c).isalnum() and c < 128 else "p" if 33 <= c <= 126 else "c") for c in range(256))


def _regular(text: str) -> bool:
    """Whether every space, line feed, full stop and comma of the text starts a piece."""
    if not text.isascii():
        return _LOOSE.search(text) is None
    kinds = text.encode().translate(_KIND)
    return not (b"ss" in kinds or b"pd" in kinds or b"dd" in kinds or b"sd" in kinds or b"c" in kinds or kinds[:1] == b"d")


#: For each character below U+10000: whether a space or line feed, or a full stop or comma, starts a piece after it (see _BREAK).
_OPENS = np.array([[_CLOSED.match(chr(c)) is not None for c in range(1 << 16)], [chr(c).isalnum() for c in range(1 << 16)]])
_MARKS = np.isin(np.arange(256), list(b" \n.,"))


def _breaks(raw: np.ndarray) -> np.ndarray:
    """Byte offsets where _BREAK cuts UTF-8 text; after a character beyond U+FFFF it is not cut."""
    at = np.flatnonzero(_MARKS[raw[1:]]) + 1
    before = raw[at - 1].astype(np.int32)
    long = np.flatnonzero(before >= 0x80)
    # the character before, from its last bytes: 110xxxxx 10xxxxxx or 1110xxxx 10xxxxxx 10xxxxxx
    last, second, third = (raw[np.maximum(at[long] - k, 0)].astype(np.int32) for k in (1, 2, 3))
    two, three = second >= 0xC0, (second < 0xC0) & (third >= 0xE0)
    before[long] = np.where(two, (second & 0x1F) << 6, np.where(three, (third & 0x0F) << 12 | (second & 0x3F) << 6, 0)) | last & 0x3F
    opens = _OPENS[np.isin(raw[at], (0x2E, 0x2C)).astype(np.intp), before]
    opens[long] &= two | three
    return at[opens]


_codecs: dict[tuple, Codec] = {}


def codec(path: str, bits: int = CHUNK_BITS) -> Codec:
    """The worker process's codec for a vocabulary."""
    if (path, bits) not in _codecs:
        _codecs[path, bits] = Codec(path, bits)
    return _codecs[path, bits]


def encoded(own: Codec, texts: pa.Array, size: int = 256) -> Iterator[bytes]:
    """The ids of a batch's texts, a few hundred of them encoded together."""
    for at in range(0, len(texts), size):
        yield from own.encode_all(texts.slice(at, size).to_pylist())


def spans(texts: pa.Array, most: int = COLUMN_BYTES) -> Iterator[pa.Array]:
    """A batch's texts in runs of about ``most`` bytes, or of one text that is longer."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, (int(ends[a - 1]) if a else 0) + most, side="right")))
        yield texts.slice(a, b - a)
        a = b


def digest(docs: DataFrame, path: str | None = None, bits: int = CHUNK_BITS) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of ids and of the decoded text of every row."""
    ship_code(docs.sparkSession)
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, bits)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for ids in encoded(own, batch.column(1)):
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(own.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str | None = None, bits: int = CHUNK_BITS) -> DataFrame:
    """doc_id and ids (array of int) of every row."""
    ship_code(docs.sparkSession)
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, bits)
        for batch in batches:
            each = [np.frombuffer(ids, "<u4").astype(np.int32) for ids in encoded(own, batch.column(1))]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in each]))).astype(np.int32)
            flat = np.concatenate(each) if each else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows of :func:`encode`."""
    ship_code(encoded.sparkSession)
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts = [own.decode(np.array(x.as_py() or [], dtype="<u4").tobytes()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def reuse(docs: DataFrame, bits: int = CHUNK_BITS) -> DataFrame:
    """One row: chunks and their characters over all texts, distinct ones, and chunks that a worker process had to encode anew.

    The distinct ones are what a table of chunks shared by all tasks would
    have to encode; the last column tells what the stores of single tasks do.
    """
    ship_code(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Store(STORE_BYTES // 2)
        for batch in batches:
            keys, sizes, new = [], [], []
            for text in batch.column(0).to_pylist():
                for c in chunks(text or "", bits):
                    absent = bool(seen.missing({c}))
                    if absent:
                        seen.put(c, b"")
                    keys.append(hashlib.blake2b(c.encode(), digest_size=16).digest())
                    sizes.append(len(c))
                    new.append(absent)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(new, pa.bool_())], names=["k", "size", "new"])

    found = docs.select("text").mapInArrow(run, "k binary, size long, new boolean").groupBy("k").agg(F.count("*").alias("n"), F.max("size").alias("size"), F.count_if("new").alias("new"))
    return found.agg(F.sum("n").alias("chunks"), F.sum(F.col("n") * F.col("size")).alias("characters"), F.count("*").alias("distinct_chunks"), F.sum("size").alias("distinct_characters"), F.sum("new").alias("encoded_chunks"), F.sum(F.col("new") * F.col("size")).alias("encoded_characters"))
