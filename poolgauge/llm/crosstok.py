"""Alignment of two tokenizers over a corpus, scored by id-striped dense count matrices.

A text with a space before it is encoded by a byte-level BPE (A) and by a
piece model (B). Places where tokens of both end cut them into groups; every
pair of an A and a B token whose byte ranges overlap is a link. How many
documents hold a pair of ids linked says which B id goes best with an A id.

* *Words.* Both tokenizers end a token at some places whatever stands around
  (before a space or line feed behind a printable or alphanumeric character;
  before a full stop or comma behind an ASCII letter or digit). That follows
  from A's pattern, and :class:`Sides` verifies that no piece of B spans such a
  place. Between two of them lies a word; a worker process encodes and aligns a
  word once and keeps its ids, groups and links in a bounded store. Ends of
  tokens cut a word into intervals, and every interval is one link.
* *Counting.* Documents go in parts of about :data:`PART_CHARS`. A part yields,
  for each group of A ids, its distinct pairs with the number of documents
  that hold them, and which document holds which pair how often, as packed
  arrays. Tasks add up the pair counts of what they read before anything is
  shuffled. The sums meet in stripes of :data:`STRIPE_IDS` A ids: a task adds a
  stripe into one dense block (``np.add.at``), whose row maxima are the best
  counts of its A ids.
* *Scoring.* The arrays of the parts are dealt by (group of A ids, salt); each
  such key gets the stripes of its group first, then streams its arrays. So
  links meet counts without a join that would copy counts to every row, a hot
  A id is split by salt, and a task holds one group's counts and one array.

Scale: three shuffles. Pair counts are pre-aggregated, and their number is
bounded by the two vocabularies; links are packed to a few bytes each; the last
shuffle has a row per document, group and part. Memory of a task is a part, a
dense block (:data:`STRIPE_IDS` times the size of B, 8 bytes each), or a
group's distinct pairs. The table of parts is written to the shared folder, so
nothing is encoded twice when an executor is lost.

Defined cases: a null or empty text, and one whose joined A or B bytes differ
from space and text (a U+2581 in it), has no tokens: zeros and an empty
string. Strings of special tokens inside texts are plain text. Rows repeating a
doc_id, a null doc_id among them, are documents of their own. Ties of the
highest count are all best. Other columns are not read; an empty table gives no
rows. A very long text is a part of its own and must fit a task's memory.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolgauge.llm.bpe import Codec, _regular, vocabulary_path
from poolgauge.llm.common import fresh_folder
from poolgauge.shipping import ship_code

A_NAME, B_NAME = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: A part ends with the document that takes it beyond so many characters or documents.
PART_CHARS, PART_DOCS = 2_000_000, 4_096
STRIPE_IDS = 256
#: Groups of stripes by which links are dealt, and parts whose links of a group go to one key.
GROUPS, PARTS_PER_KEY = 16, 32
#: Parts whose pair counts meet in one block of a stripe before all do.
PARTS_PER_SUM = 4_096
#: Bytes that a worker process's store of words may hold; it starts anew beyond.
STORE_BYTES = 120 << 20
#: Distinct pairs that a task sums up before it sends them on.
HELD_PAIRS = 4_000_000
READ_TASKS = 20_000

_CUT = re.compile(r"(?<=[!-~\w])(?=[ \n])|(?<=[A-Za-z0-9])(?=[.,])")


def words(text: str) -> list[str]:
    """``text`` cut where tokens of both kinds surely end."""
    if text.isascii() and _regular(text):
        for mark in " \n.,":
            text = text.replace(mark, "\0" + mark)
        parts = text.split("\0")
        return parts if parts[0] else parts[1:]
    return [w for w in _CUT.split(text) if w]


class Sides:
    """Both tokenizers of a worker process: ids and lengths in bytes of the tokens of words."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece

        self.a = Codec(a_path)
        self.a.tokenizer.encode_special_tokens, self.a.added = True, []
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if over := [p for p in pieces if re.search(r"[^▁]▁|[A-Za-z0-9][.,]|\n", p)]:
            raise ValueError(f"pieces reach over places where words are cut: {over[:3]}")
        self.size_a, self.size_b = len(self.a.sizes), len(pieces)
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.sizes_b = np.array([len(x) for x in self.bytes_b], dtype=np.int64)

    def of_a(self, texts: list[str]) -> list[np.ndarray]:
        self.a.pieces.young, self.a.pieces.held = {}, 0
        self.a._learn(set(texts))
        return [np.frombuffer(self.a.pieces.young[t], "<u4") for t in texts]

    def of_b(self, texts: list[str]) -> list[list[int]]:
        """A line feed before a word keeps it from the added space; it is the second token then, as no piece holds one."""
        return [ids[2:] for ids in self.b.encode(["\n" + t for t in texts], num_threads=1)]


class _Grown:
    """An array that grows by doubling."""

    def __init__(self, kind):
        self.data, self.n = np.zeros(1024, kind), 0

    def extend(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.data):
            self.data = np.concatenate((self.data[: self.n], np.zeros(self.n + 2 * len(more), self.data.dtype)))
        self.data[self.n : self.n + len(more)] = more
        self.n += len(more)


class Words:
    """Aligned words of a worker process: numbers of tokens, groups as text, links as codes a * size_b + b."""

    def __init__(self, sides: Sides, most: int = STORE_BYTES):
        self.sides, self.most = sides, most
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.groups: list[str] = []
        self.n_a, self.n_b, self.n_groups, self.good = _Grown(np.int32), _Grown(np.int32), _Grown(np.int32), _Grown(bool)
        self.first, self.n_links, self.codes = _Grown(np.int64), _Grown(np.int32), _Grown(np.int64)
        self.held = 0

    def places(self, flat: list[str]) -> np.ndarray:
        if self.held > self.most:
            self.clear()
        if new := list(set(flat).difference(self.place)):
            for at in range(0, len(new), 20_000):
                self._learn(new[at : at + 20_000])
        return np.fromiter(map(self.place.__getitem__, flat), np.int64, len(flat))

    def _learn(self, new: list[str]) -> None:
        own = self.sides
        of_a, of_b = own.of_a(new), own.of_b(new)
        n_a, n_b = (np.array([len(x) for x in side], np.int64) for side in (of_a, of_b))
        a, b = np.concatenate(of_a).astype(np.int64), np.fromiter(chain.from_iterable(of_b), np.int64, int(n_b.sum()))
        raw = [w.encode() for w in new]
        good = np.fromiter((b"".join(map(own.bytes_b.__getitem__, ids)) == w for ids, w in zip(of_b, raw, strict=True)), bool, len(new))
        # a word whose bytes B changes takes no part: its tokens go, so that ends of both sides agree
        b = b[np.repeat(good, n_b)]
        a = a[np.repeat(good, n_a)]
        n_a, n_b = n_a * good, n_b * good
        a_ends, b_ends = np.cumsum(own.a.sizes[a]), np.cumsum(own.sizes_b[b])
        ends = np.union1d(a_ends, b_ends)
        at_a, at_b = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
        both = np.intersect1d(a_ends, b_ends, assume_unique=True)
        word_ends = np.cumsum(np.array([len(w) for w in raw], np.int64) * good)
        count = lambda x: np.diff(np.searchsorted(x, word_ends, side="right"), prepend=0)
        n_links, n_groups = count(ends), count(both)
        # groups as text: tokens of both sides up to each common end
        cut_a, cut_b = (np.searchsorted(x, both, side="right").tolist() for x in (a_ends, b_ends))
        name_a, name_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        texts, i, j = [], 0, 0
        for x, y in zip(cut_a, cut_b, strict=True):
            texts.append(f"{name_a[i]}|{name_b[j]}" if x - i == 1 == y - j else ",".join(name_a[i:x]) + "|" + ",".join(name_b[j:y]))
            i, j = x, y
        at = 0
        base = len(self.groups)
        for k, n in enumerate(n_groups.tolist()):
            self.groups.append(texts[at] if n == 1 else ";".join(texts[at : at + n]))
            at += n
            self.place[new[k]] = base + k
        self.first.extend(self.codes.n + np.cumsum(n_links) - n_links)
        self.codes.extend(a[at_a] * own.size_b + b[at_b])
        for to, x in ((self.n_a, n_a), (self.n_b, n_b), (self.n_groups, n_groups), (self.n_links, n_links), (self.good, good)):
            to.extend(x)
        self.held += sum(map(len, raw)) + sum(map(len, texts)) + 8 * len(ends) + 260 * len(new)


_words: dict[tuple, Words] = {}


def _own_words(a_path: str, b_path: str) -> Words:
    if (a_path, b_path) not in _words:
        _words[a_path, b_path] = Words(Sides(a_path, b_path))
    return _words[a_path, b_path]


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``values``; runs may be empty."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def _small(x: np.ndarray) -> bytes:
    """As unsigned integers of the least width that holds them."""
    most = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32).tobytes()


def _wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


class Part:
    """The aligned texts of one part."""

    def __init__(self, own: Words, texts: list[str | None], keep_groups: bool):
        split = [words(" " + t) if t else [] for t in texts]
        flat = own.places(list(chain.from_iterable(split)))
        sizes = np.array([len(x) for x in split], np.int64)
        doc = np.repeat(np.arange(len(texts)), sizes)
        whole = np.ones(len(texts), bool)
        whole[doc[~own.good.data[flat]]] = False
        flat, doc = flat[whole[doc]], doc[whole[doc]]
        sizes = np.bincount(doc, minlength=len(texts))
        self.n_a, self.n_b, self.n_groups, self.n_links = (_sums(x.data[flat], sizes) for x in (own.n_a, own.n_b, own.n_groups, own.n_links))
        ends = np.cumsum(sizes)
        texts_of = (";".join(map(own.groups.__getitem__, flat[e - n : e].tolist())) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True))
        self.sha, self.groups = [], []
        for text in texts_of:
            self.sha.append(hashlib.sha256(text.encode()).hexdigest() if text else "")
            if keep_groups:
                self.groups.append(text)
        self._pairs(own, flat, doc, len(texts))

    def _pairs(self, own: Words, flat: np.ndarray, doc: np.ndarray, n_docs: int) -> None:
        """Which document holds which pair how often: entries ordered by group, document and pair."""
        key, times = np.unique(doc * len(own.groups) + flat, return_counts=True)
        doc, word = np.divmod(key, max(1, len(own.groups)))
        n = own.n_links.data[word].astype(np.int64)
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - own.first.data[word], n)
        doc, times = np.repeat(doc, n), np.repeat(times, n)
        codes, place = np.unique(own.codes.data[at], return_inverse=True)
        group = group_of(codes // own.sides.size_b, own.sides.size_a)
        order = np.argsort(group, kind="stable")
        self.codes, group = codes[order], group[order]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        place = back[place]
        entry = (group[place] * n_docs + doc) * max(1, len(codes)) + place
        order = np.argsort(entry, kind="stable")
        entry, first = np.unique(entry[order], return_index=True)
        self.times = np.add.reduceat(times[order], first) if len(first) else times
        rest, self.place = np.divmod(entry, max(1, len(codes)))
        self.group_of_entry, self.doc = np.divmod(rest, n_docs)
        self.docs = np.bincount(self.place, minlength=len(codes))
        self.starts = np.searchsorted(group, np.arange(GROUPS + 1))
        self.n_docs = n_docs

    def packed(self) -> Iterator[dict]:
        """One row per group of A ids that has links."""
        ends = np.searchsorted(self.group_of_entry, np.arange(GROUPS + 1))
        for g in range(GROUPS):
            a, b, lo, hi = ends[g], ends[g + 1], self.starts[g], self.starts[g + 1]
            if lo < hi:
                yield {
                    "grp": g,
                    "codes": self.codes[lo:hi].astype("<i8").tobytes(),
                    "docs": _small(self.docs[lo:hi]),
                    "per_doc": np.bincount(self.doc[a:b], minlength=self.n_docs).astype("<u4").tobytes(),
                    "place": _small(self.place[a:b] - lo),
                    "times": _small(self.times[a:b]),
                }


def n_stripes(size_a: int) -> int:
    return -(-size_a // STRIPE_IDS)


def group_of(a: np.ndarray, size_a: int) -> np.ndarray:
    """Ids are dealt to stripes and stripes to groups in turn, so that frequent low ids are spread."""
    return a % n_stripes(size_a) % GROUPS


def _arrow(rows: list[dict], names: list[str], like: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({n: [r.get(n) for r in rows] for n in names}, schema=like)


def aligned(docs: DataFrame, folder: str, a_path: str | None = None, b_path: str | None = None, keep_groups: bool = False) -> DataFrame:
    """Write and reread the table of parts: rows with ``at`` describe a document, rows with ``grp`` hold packed pairs."""
    spark = docs.sparkSession
    ship_code(spark)
    a_path, b_path = a_path or vocabulary_path(A_NAME), b_path or vocabulary_path(B_NAME)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"part long, at int, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, grp int, codes binary, docs binary, per_doc binary, place binary, times binary"
    packed = pa.schema([("grp", pa.int32()), *[(c, pa.binary()) for c in ("codes", "docs", "per_doc", "place", "times")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = _own_words(a_path, b_path), TaskContext.get().partitionId() << 32
        for batch in batches:
            held: list[str | None] = []
            size = since = 0
            for k in range(batch.num_rows):
                held.append(batch.column(1)[k].as_py())
                size += len(held[-1] or "")
                if size > PART_CHARS or len(held) == PART_DOCS or k == batch.num_rows - 1:
                    yield from rows_of(Part(own, held, keep_groups), batch.column(0).slice(since, len(held)), part)
                    held, size, since, part = [], 0, k + 1, part + 1

    def rows_of(p: Part, ids: pa.Array, part: int) -> Iterator[pa.RecordBatch]:
        n = len(ids)
        none = {c: pa.nulls(n, packed.field(c).type) for c in packed.names}
        text = pa.array(p.groups, pa.string()) if keep_groups else pa.nulls(n, pa.string())
        own = {"part": pa.array(np.full(n, part)), "at": pa.array(np.arange(n, dtype=np.int32)), "doc_id": ids}
        own |= {c: pa.array(getattr(p, c), pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")}
        own |= {"groups_sha256": pa.array(p.sha, pa.string()), "groups": text, **none}
        docs_of = pa.RecordBatch.from_pydict(own)
        yield docs_of
        for row in p.packed():  # one array in Arrow at a time
            data = _arrow([row], packed.names, packed)
            yield pa.RecordBatch.from_arrays([data.column(f.name) if f.name in packed.names else pa.array([part]) if f.name == "part" else pa.nulls(1, f.type) for f in docs_of.schema], schema=docs_of.schema)

    docs.select("doc_id", "text").mapInArrow(run, schema).write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(schema).parquet(folder)


class _Pairs:
    """Sums of documents by pair that a task holds; sent on as rows of a stripe each when there are too many."""

    def __init__(self, most: int = HELD_PAIRS):
        self.most, self.codes, self.docs, self.loose = most, np.zeros(0, np.int64), np.zeros(0, np.int64), []
        self.n = 0

    def add(self, codes: np.ndarray, docs: np.ndarray) -> None:
        self.loose.append((codes, docs))
        self.n += len(codes)

    def merge(self) -> None:
        codes = np.concatenate([self.codes, *[c for c, _ in self.loose]])
        docs = np.concatenate([self.docs, *[d for _, d in self.loose]])
        self.codes, place = np.unique(codes, return_inverse=True)
        self.docs = np.zeros(len(self.codes), np.int64)
        np.add.at(self.docs, place, docs)
        self.loose, self.n = [], 0

    def rows(self, size_a: int, size_b: int) -> Iterator[pa.RecordBatch]:
        self.merge()
        stripe = self.codes // size_b % n_stripes(size_a)
        order = np.argsort(stripe, kind="stable")
        for s, mine in zip(*_runs(stripe[order], order), strict=True):
            yield pa.RecordBatch.from_pydict({"stripe": pa.array([s], pa.int32()), "codes": [self.codes[mine].astype("<i8").tobytes()], "docs": [self.docs[mine].astype("<i8").tobytes()]})
        self.codes = self.docs = np.zeros(0, np.int64)


def _runs(keys: np.ndarray, values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    if not len(keys):
        return [], []
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first].tolist(), np.split(values, first[1:])


def counted(parts: DataFrame, size_a: int, size_b: int) -> DataFrame:
    """One row per stripe: stripe, grp and, ordered by pair, codes, docs (documents that hold it) and best (of its A id)."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Pairs()
        for batch in batches:
            for codes, docs in zip(batch.column(0), batch.column(1), strict=True):
                codes = np.frombuffer(codes.as_py(), "<i8")
                held.add(codes, _wide(docs.as_py(), len(codes)))
                if held.n > held.most:
                    held.merge()
                    if len(held.codes) > held.most:
                        yield from held.rows(size_a, size_b)
        yield from held.rows(size_a, size_b)

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come ordered by key: one dense block at a time, of which only the rows of ids that occur are touched."""
        now, key, seen = None, None, []

        def close() -> Iterator[pa.RecordBatch]:
            if now is None:
                return
            stripe, codes = key[0], np.unique(np.concatenate(seen))
            row, col = codes // size_b // n_stripes(size_a), codes % size_b
            docs, most = now[row, col], np.zeros(STRIPE_IDS, np.int64)
            used = np.unique(row)
            most[used] = [now[r].max() for r in used]
            yield pa.RecordBatch.from_pydict({"stripe": pa.array([stripe], pa.int32()), "salt": pa.array([key[1]], pa.int32()), "codes": [codes.astype("<i8").tobytes()], "docs": [docs.astype("<i8").tobytes()], "best": [(docs == most[row]).tobytes()]})

        for batch in batches:
            for stripe, salt, codes, docs in zip(*batch.columns, strict=True):
                if (k := (stripe.as_py(), salt.as_py())) != key:
                    yield from close()
                    now, key, seen = np.zeros((STRIPE_IDS, size_b), np.int64), k, []
                codes = np.frombuffer(codes.as_py(), "<i8")
                np.add.at(now, (codes // size_b // n_stripes(size_a), codes % size_b), np.frombuffer(docs.as_py(), "<i8"))
                seen = [np.union1d(seen[0], codes)] if seen else [codes]
        yield from close()

    salts = max(1, parts.where("grp = 0").count() // PARTS_PER_SUM)
    sums = parts.where(F.col("grp").isNotNull()).select("codes", "docs").mapInArrow(add_up, "stripe int, codes binary, docs binary")
    sums = sums.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    # sums of many tasks meet in two steps, so that no stripe waits for all of them in one task
    for key in (["stripe", "salt"], ["stripe"]) if salts > 1 else (["stripe"],):
        dealt = sums.withColumn("salt", F.col("salt") if "salt" in key else F.lit(0)).select("stripe", "salt", "codes", "docs").repartition(*key).sortWithinPartitions(*key)
        sums = dealt.mapInArrow(block, "stripe int, salt int, codes binary, docs binary, best binary")
    return sums.withColumn("grp", F.col("stripe") % GROUPS).drop("salt")


def scored(parts: DataFrame, counts: DataFrame) -> DataFrame:
    """part, at, n_best and count_sum of the links of each document in each group of A ids."""
    links = parts.where(F.col("grp").isNotNull())
    salts = max(1, -(-links.where("grp = 0").count() // PARTS_PER_KEY))
    schema = "part long, at int, n_best long, count_sum long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, stripes, codes, docs, best = None, [], None, None, None
        for batch in batches:
            for k, is_link, part, *data in zip(*batch.columns, strict=True):
                k = k.as_py()
                if k != key:
                    key, stripes, codes = k, [], None
                c, d, good, per_doc, place, times = (x.as_py() for x in data)
                if not is_link.as_py():
                    stripes.append((c, d, good))
                    continue
                if codes is None:
                    codes, docs, best = (np.concatenate([np.frombuffer(s[i], t) for s in stripes]) for i, t in enumerate(("<i8", "<i8", bool)))
                    order = np.argsort(codes)
                    codes, docs, best, stripes = codes[order], docs[order], best[order], []
                at = np.searchsorted(codes, np.frombuffer(c, "<i8"))
                per_doc = np.frombuffer(per_doc, "<u4").astype(np.int64)
                n = int(per_doc.sum())
                at, times = at[_wide(place, n)], _wide(times, n)
                mine = np.flatnonzero(per_doc).astype(np.int32)
                yield pa.RecordBatch.from_pydict({"part": np.full(len(mine), part.as_py()), "at": mine, "n_best": _sums(times * best[at], per_doc)[mine], "count_sum": _sums(times * docs[at], per_doc)[mine]})

    none = F.lit(None).cast("binary")
    salted = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    key = lambda salt: (F.col("grp") * salts + salt).cast("long").alias("key")
    first = salted.select(key(F.col("salt")), F.lit(False).alias("is_link"), F.lit(None).cast("long").alias("part"), "codes", "docs", "best", none.alias("per_doc"), none.alias("place"), none.alias("times"))
    then = links.select(key(F.pmod(F.xxhash64("part"), F.lit(salts))), F.lit(True).alias("is_link"), "part", "codes", none.alias("docs"), none.alias("best"), "per_doc", "place", "times")
    dealt = first.unionByName(then).repartition(min(READ_TASKS, GROUPS * salts), "key").sortWithinPartitions("key", "is_link", "part")
    return dealt.mapInArrow(run, schema)


def _sizes(a_path: str | None, b_path: str | None) -> tuple[int, int]:
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(a_path or vocabulary_path(A_NAME)).get_vocab_size(with_added_tokens=True)
    return a, sentencepiece.SentencePieceProcessor(model_file=b_path or vocabulary_path(B_NAME)).get_piece_size()


def best_pairs(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """a, b, docs and best (whether the count is the A id's highest) of every linked pair of ids."""
    size_a, size_b = _sizes(a_path, b_path)
    counts = counted(aligned(docs, fresh_folder(docs.sparkSession, "alignment"), a_path, b_path), size_a, size_b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, d, good in zip(*batch.columns, strict=True):
                a, b = np.divmod(np.frombuffer(c.as_py(), "<i8"), size_b)
                yield pa.RecordBatch.from_pydict({"a": a, "b": b, "docs": np.frombuffer(d.as_py(), "<i8"), "best": np.frombuffer(good.as_py(), bool)})

    return counts.select("codes", "docs", "best").mapInArrow(run, "a long, b long, docs long, best boolean")


def digest(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, keep_groups: bool = False) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (and groups, if kept)."""
    size_a, size_b = _sizes(a_path, b_path)
    parts = aligned(docs, fresh_folder(docs.sparkSession, "alignment"), a_path, b_path, keep_groups)
    numbers = ["n_a", "n_b", "n_groups", "n_links"]
    texts = ["groups_sha256", *["groups"] * keep_groups]
    own = parts.where(F.col("at").isNotNull()).select("part", "at", "doc_id", *numbers, *texts)
    scores = scored(parts, counted(parts, size_a, size_b))
    both = own.unionByName(scores, allowMissingColumns=True).groupBy("part", "at")
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_best", "count_sum")]
    out = both.agg(*[F.max(c).alias(c) for c in ("doc_id", *numbers, *texts)], *sums)
    return out.select("doc_id", *numbers, "n_best", "count_sum", *texts)
