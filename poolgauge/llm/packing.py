"""Packing documents into training sequences by cutting-stock column generation.

A document's ids (with an end id) are cut into pieces of :data:`SEQUENCE`
tokens and one shorter rest; pieces are cut no further but for a few at the
end. Which lengths share a sequence is a cutting-stock problem on the
*histogram* of piece lengths:

* a pattern says how many pieces of each length fill a sequence exactly;
* a linear program takes patterns, fractions allowed, so that as few tokens as
  can be are in no pattern; :func:`relaxed` solves it by revised simplex, and an
  unbounded knapsack over exact lengths (dynamic programming) prices the next
  pattern. It ends at the optimum, when less than :data:`GAP` of all tokens are
  left, or after :data:`MOST_PATTERNS` patterns a length, which only costs cuts;
* patterns are taken as often as their rounded value says, fractions by size
  while pieces last. The pieces that no pattern takes are laid end to end and
  cut where a sequence is full; the last one is cut at powers of two. So no
  sequence is padded, and only pieces in no pattern can be cut again.

Pieces are ranked within their length; a pattern owns a range of ranks of each
length it holds and the pieces in no pattern are the last ranks, so length and
rank alone give sequence and offset.

Scale: one pass encodes and writes pieces with their ids; ranks are counted
within a task and moved up by a running sum over (length, task), so a length
that a third of all pieces share is never gathered. The histogram (at most
:data:`SEQUENCE` rows) is all that the driver sees, and the plan sent to tasks has at most twice as
many patterns as there are lengths. Ids are read again only for pieces that are
cut again, from the files of the tasks that hold them; which pieces these are
is broadcast if the plan says that they are at most :data:`SENT_CUTS`.

Defined cases: a null text is empty and yields the end id alone; rows repeating
a doc_id, or without one, are each packed; ties of rank follow the order in
which tasks read rows; other columns are not read; an empty table gives no
rows. A very long text is many pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from poolgauge.llm.bpe import codec, spans, vocabulary_path
from poolgauge.llm.common import cut, fresh_folder
from poolgauge.shipping import ship_code

SEQUENCE = 1024
END_ID = 0
#: The linear program ends when this share of all tokens is in no pattern, or after so many patterns for each length.
GAP, MOST_PATTERNS = 1e-3, 3
#: Cut pieces (length, rank and part each) that are broadcast; more are joined by a shuffle.
SENT_CUTS = 200_000
_LEAST = 1e-9


@dataclass
class Plan:
    """Where ranks of each length go.

    ``ranges``: by length, rank ``lo + i`` (below ``hi``) lies in sequence
    ``first + i // each`` at ``offset + i % each * length``. ``rest``: by
    length, the first rank in no pattern, and the place of that piece among
    all that are laid end to end from sequence ``rest_first`` on.
    """

    whole: int = SEQUENCE
    ranges: dict[int, np.ndarray] = field(default_factory=dict)
    rest: dict[int, tuple[int, int]] = field(default_factory=dict)
    rest_first: int = 0
    rest_tokens: int = 0

    @property
    def ends(self) -> np.ndarray:
        """Where sequences end after the last whole one: at powers of two."""
        tail = self.rest_tokens % self.whole
        sizes = [1 << b for b in range(self.whole.bit_length(), -1, -1) if tail >> b & 1]
        return self.rest_tokens - tail + np.cumsum(np.array([0, *sizes], np.int64))

    @property
    def sequences(self) -> int:
        return self.rest_first + self.rest_tokens // self.whole + len(self.ends) - 1

    def most_cuts(self) -> int:
        return self.sequences - self.rest_first

    def _spot(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of places among the pieces laid end to end."""
        tail = np.searchsorted(self.ends, place, side="right") - 1
        in_tail = place >= self.ends[0]
        number = np.where(in_tail, self.ends[0] // self.whole + tail, place // self.whole)
        offset = np.where(in_tail, place - self.ends[np.maximum(tail, 0)], place % self.whole)
        return self.rest_first + number, offset

    def spots(self, size: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces of one length; sequence -1 of those that are cut again."""
        sequence, offset = np.full(len(rank), -1), np.zeros(len(rank), np.int64)
        if size in self.ranges:
            own = self.ranges[size]
            at = np.searchsorted(own[:, 0], rank, side="right") - 1
            mine = np.flatnonzero(rank < own[at, 1])
            i, own = rank[mine] - own[at[mine], 0], own[at[mine]]
            sequence[mine], offset[mine] = own[:, 3] + i // own[:, 2], own[:, 4] + i % own[:, 2] * size
        if size in self.rest:
            used, place = self.rest[size]
            mine = np.flatnonzero(rank >= used)
            place = place + (rank[mine] - used) * size
            (first, at), (last, _) = self._spot(place), self._spot(place + size - 1)
            sequence[mine], offset[mine] = np.where(first == last, first, -1), at
        return sequence, offset

    def fragments(self, size: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start in the piece, length, sequence, offset) of what a piece in no pattern is cut into."""
        used, place = self.rest[size]
        place += (rank - used) * size
        stops = [*range(self.whole * (place // self.whole + 1), min(place + size, int(self.ends[0]) + 1), self.whole), *self.ends.tolist()]
        stops = sorted({x for x in stops if place < x < place + size} | {place, place + size})
        number, offset = self._spot(np.array(stops[:-1]))
        return [(a - place, b - a, n, o) for a, b, n, o in zip(stops[:-1], stops[1:], number.tolist(), offset.tolist(), strict=True)]


def priced(worth: np.ndarray, whole: int) -> tuple[np.ndarray, np.ndarray]:
    """For each total, the most that pieces of exactly that total are worth, and the longest last piece that gets it."""
    most, last = np.full(whole + 1, -np.inf), np.zeros(whole + 1, np.int64)
    most[whole] = 0.0  # kept from the right: the total c stands at whole - c
    worth = worth[::-1]
    for c in range(1, whole + 1):
        got = most[: whole - c : -1] + worth[whole - c : whole]
        k = int(got.argmax())
        most[whole - c], last[c] = got[k], c - k
    return most[::-1], last


def relaxed(lengths: np.ndarray, demand: np.ndarray, whole: int = SEQUENCE, gap: float = GAP) -> tuple[list[dict[int, int] | None], np.ndarray]:
    """Patterns ({place in ``lengths``: pieces}; None: a piece in no pattern) and their fractional numbers."""
    m = len(lengths)
    place = np.full(whole + 1, -1)
    place[lengths] = np.arange(m)
    # equal demands make ties that simplex goes round in: a little is added to each
    x = demand * (1 + 1e-5 * np.random.default_rng(m).random(m))
    patterns: list[dict[int, int] | None] = [None] * m
    cost, inverse = lengths / whole, np.eye(m)
    enough = gap * float(demand @ lengths) / whole
    for _ in range(MOST_PATTERNS * m + 50):
        if float(cost @ x) <= enough:
            break
        worth = np.full(whole + 1, -np.inf)
        worth[lengths] = cost @ inverse
        value, last = priced(worth, whole)
        if not value[whole] > 1e-7:
            break
        new: dict[int, int] = {}
        rest = whole
        while rest:
            new[int(place[last[rest]])] = new.get(int(place[last[rest]]), 0) + 1
            rest -= int(last[rest])
        way = inverse[:, list(new)] @ np.array(list(new.values()), float)
        able = np.flatnonzero(way > _LEAST)
        ratio = x[able] / way[able]
        out = able[np.lexsort((-way[able], ratio))[0]]
        step = max(0.0, x[out] / way[out])
        x = np.maximum(x - step * way, 0.0)
        x[out] = step
        pivot = inverse[out] / way[out]
        touched = np.flatnonzero(np.abs(way) > 1e-14)
        inverse[touched] -= np.outer(way[touched], pivot)
        inverse[out] = pivot
        patterns[out], cost[out] = new, 0.0
    return patterns, x


def planned(histogram: dict[int, int], whole: int = SEQUENCE, gap: float = GAP) -> Plan:
    """The packing of all pieces of a histogram {length: pieces}; lengths are 1 to ``whole``."""
    left = {n: c for n, c in histogram.items() if c}
    plan = Plan(whole)
    if not left:
        return plan
    lengths = np.array(sorted(left), np.int64)
    rest = np.array([left[n] for n in lengths.tolist()], np.int64)
    patterns, x = relaxed(lengths, rest.astype(float), whole, gap)
    used, ranges = np.zeros(len(lengths), np.int64), {}

    def take(p: dict[int, int], n: int) -> None:
        n = min([n, *(int(rest[i]) // k for i, k in p.items())])
        offset = 0
        for i, k in p.items() if n else ():
            size, lo = int(lengths[i]), int(used[i])
            ranges.setdefault(size, []).append((lo, lo + n * k, k, plan.rest_first, offset))
            used[i] += n * k
            rest[i] -= n * k
            offset += k * size
        plan.rest_first += n

    rounded = np.floor(x + 1e-6).astype(np.int64)
    for p, n in zip(patterns, rounded.tolist(), strict=True):
        if p:
            take(p, n)
    for j in np.argsort(rounded - x, kind="stable").tolist():
        if patterns[j]:
            take(patterns[j], 1)
    plan.ranges = {n: np.array(r, np.int64) for n, r in ranges.items()}
    for i in np.argsort(-lengths, kind="stable").tolist():
        if rest[i]:
            plan.rest[int(lengths[i])] = int(used[i]), plan.rest_tokens
            plan.rest_tokens += int(rest[i] * lengths[i])
    return plan


def pieces(docs: DataFrame, folder: str, path: str | None = None, whole: int = SEQUENCE) -> DataFrame:
    """Write and reread all pieces: part, doc_id, start, length, ids_crc32, doc_tokens, rank (in part and length), ids (packed, see :func:`unpacked`)."""
    spark = docs.sparkSession
    ship_code(spark)
    path = path or vocabulary_path()
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"part int, doc_id {kind}, start long, length int, ids_crc32 long, doc_tokens long, rank long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, seen = codec(path), TaskContext.get().partitionId(), np.zeros(whole + 1, np.int64)
        narrow = "<u2" if len(own.sizes) <= 1 << 16 else "<u4"
        for batch in batches:
            at = 0
            for texts in spans(batch.column(1)):
                found, ends = own.encode_column(texts)
                found = np.insert(found, ends, END_ID)
                less, ends = found.astype(narrow), ends + np.arange(1, len(ends) + 1)
                row, start, size, crc, total, ids = [], [], [], [], [], []
                for k, (lo, hi) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
                    for a in range(lo, hi, whole):
                        b = min(a + whole, hi)
                        row.append(at + k)
                        start.append(a - lo)
                        size.append(b - a)
                        crc.append(zlib.crc32(found[a:b].data))
                        total.append(hi - lo)
                        ids.append(less[a:b].tobytes())
                at += len(texts)
                sizes = np.array(size, np.int32)
                yield pa.RecordBatch.from_pydict({"part": np.full(len(row), part, np.int32), "doc_id": batch.column(0).take(pa.array(row, pa.int64())), "start": pa.array(start, pa.int64()), "length": sizes, "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": pa.array(total, pa.int64()), "rank": _ranked(sizes, seen), "ids": pa.array(ids, pa.binary())})

    docs.select("doc_id", "text").mapInArrow(run, schema).write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(schema).parquet(folder)


def _ranked(sizes: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Ranks of pieces among those of their length, counted on in ``seen``."""
    order = np.argsort(sizes, kind="stable")
    sorted_sizes = sizes[order]
    rank = np.empty(len(sizes), np.int64)
    rank[order] = np.arange(len(sizes)) - np.searchsorted(sorted_sizes, sorted_sizes) + seen[sorted_sizes]
    np.add.at(seen, sizes, 1)
    return rank


def unpacked(ids: bytes, length: int) -> np.ndarray:
    return np.frombuffer(ids, f"<u{len(ids) // length}").astype("<u4")


def pack(docs: DataFrame, path: str | None = None, whole: int = SEQUENCE, gap: float = GAP, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, packed)."""
    spark = docs.sparkSession
    found = pieces(docs, fresh_folder(spark, "pieces"), path, whole)
    counts = found.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = cut(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))))
    plan = planned({r["length"]: r["n"] for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}, whole, gap)

    kind = docs.schema["doc_id"].dataType.simpleString()
    ids = ["ids"] * with_ids
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *ids]
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, {'ids binary, ' * with_ids}sequence_id long, offset long"

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = (np.asarray(batch.column(c).to_numpy(), np.int64) for c in ("length", "rank"))
            sequence, offset = np.full(len(size), -1), np.zeros(len(size), np.int64)
            for n, mine in zip(*_runs(size), strict=True):
                sequence[mine], offset[mine] = plan.spots(n, rank[mine])
            own = {c: batch.column(c).cast(pa.int64()) if c == "length" else batch.column(c) for c in columns}
            yield pa.RecordBatch.from_pydict({**own, "sequence_id": sequence, "offset": offset}).take(pa.array(np.flatnonzero(sequence >= 0)))

    def broken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """part, length, rank and all_rank of pieces that are cut again."""
        for batch in batches:
            part, size, base, number = (np.asarray(c.to_numpy(), np.int64) for c in batch.columns)
            for p, n, b, k in zip(part.tolist(), size.tolist(), base.tolist(), number.tolist(), strict=True):
                if n in plan.rest and b + k > plan.rest[n][0]:
                    rank = np.arange(max(b, plan.rest[n][0]), b + k)
                    rank = rank[plan.spots(n, rank)[0] < 0]
                    yield pa.RecordBatch.from_pydict({"part": np.full(len(rank), p, np.int32), "length": np.full(len(rank), n, np.int32), "rank": rank - b, "all_rank": rank})

    def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, *row in zip(*batch.columns, strict=True):
                start, size, total, data, rank = (x.as_py() for x in row)
                flat, width = unpacked(data, size), len(data) // size
                at, n, sequence, offset = map(list, zip(*plan.fragments(size, rank), strict=True))
                runs = [flat[a : a + k] for a, k in zip(at, n, strict=True)]
                out = {"doc_id": pa.array([doc_id.as_py()] * len(n), doc_id.type), "start": [start + a for a in at], "length": n, "ids_crc32": [zlib.crc32(r.tobytes()) for r in runs], "doc_tokens": [total] * len(n)}
                if with_ids:
                    out["ids"] = [r.astype(f"<u{width}").tobytes() for r in runs]
                yield pa.RecordBatch.from_pydict({**out, "sequence_id": sequence, "offset": offset})

    ranked = found.select("part", "rank", *columns).join(bases.select("part", "length", "base"), ["part", "length"])
    uncut = ranked.select(*columns, (F.col("base") + F.col("rank")).alias("rank")).mapInArrow(assign, schema)
    if not plan.rest_tokens:
        return uncut
    at = cut(bases.select("part", "length", "base", "n").mapInArrow(broken, "part int, length int, rank long, all_rank long"))
    first = at.agg(F.min("part")).first()[0]
    if first is None:
        return uncut
    keys = F.broadcast(at) if plan.most_cuts() <= SENT_CUTS else at
    again = found.where(F.col("part") >= first).join(keys, ["part", "length", "rank"])
    return uncut.unionByName(again.select("doc_id", "start", "length", "doc_tokens", "ids", "all_rank").mapInArrow(fragments, schema))


def _runs(keys: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """The different keys and where each stands."""
    if not len(keys):
        return [], []
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.diff(keys[order], prepend=keys.min() - 1))
    return keys[order][first].tolist(), np.split(order, first[1:])


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens and ids (packed) of whole sequences, from ``pack(..., with_ids=True)``; a sequence is bounded, and so is its group."""
    piece = F.struct("offset", "ids")
    rows = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(piece)).alias("own"))
    return rows.select("sequence_id", "n_tokens", F.aggregate("own", F.lit(b""), lambda all_ids, x: F.concat(all_ids, x["ids"])).alias("ids"))
