"""SimHash near-dedup by meet-in-the-middle ball hashing.

Fingerprints within ``radius`` 4 of each other share a variant that is within
2 of both. So every distinct fingerprint emits all its variants within half
the radius (1 + 64 + 2016 of them) and fingerprints that share a variant are
linked: no pair is missed, and as two fingerprints that share a variant differ
in at most 4 bits, a collision of full variants verifies itself.

How that stays small:

* texts become fingerprints where they are read; only (doc_id, fingerprint)
  is kept, and equal fingerprints are one node from then on;
* the shuffle is on the leading ``prefix_bits`` of the variants: a row is sent
  once per prefix within 2 bits of the fingerprint's own (79 rows of 16 bytes
  for 12 bits instead of 2081 variants), and the task that owns a prefix
  writes out the variants below it, sorts them and unites neighbours;
* a task reads its prefixes in order and holds ``most_rows`` of one at most: a
  prefix with more rows (a crowd of near copies with distinct fingerprints) is
  passed on, as it is read, to a further round on longer prefixes, up to whole
  variants, which at most 2081 distinct fingerprints share;
* a task never forms pairs: it unites the members of a variant in a
  union-find and emits one edge per fingerprint to its group's root, so a
  group of n near copies costs n edges;
* edges meet in :mod:`components`, which is distributed; a component's
  smallest doc_id is sent back to its members in ``SALTS`` parts.

Defined cases: words are runs without ASCII white space after lower-casing
A-Z; under ``shingle`` words the whole sequence is one shingle; no words or a
null text give fingerprint zero, linked like any other; rows repeating a
doc_id are each fingerprinted; a null doc_id takes part and never is a
component_id unless its component has no other (then null).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolgauge.llm.common import cut, text_key
from poolgauge.llm.components import components
from poolgauge.shipping import ship_code

SHINGLE = 4
RADIUS = 4
SEED = 42
PREFIX_BITS = 12
#: Rows of one key that a task joins; a key with more goes on to a round on longer keys.
MOST_ROWS = 1 << 18
#: Rows of whole keys, and variants of theirs, that a task holds at once (24 bytes each).
CHUNK_ROWS, CHUNK_VARIANTS = 1 << 19, 1 << 21
#: Parts that the members of one component are dealt out to.
SALTS = 32


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the shingles of one whole text, in order; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    ends = [*np.flatnonzero(np.frombuffer(joined, np.uint8) == 32).tolist(), len(joined)]
    starts = [0, *(x + 1 for x in ends[:-shingle])]
    of = xxhash.xxh64_intdigest
    return np.array([of(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :], strict=True)], dtype=np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of one whole text."""
    hashes = shingle_hashes(text, shingle)
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, th (a hash of the text) and fp (the fingerprint as a signed long) of every row."""
    ship_code(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(2)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp)], names=["doc_id", "th", "fp"])

    rows = docs.select("doc_id", text_key(F.col("text")).alias("th"), "text")
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, th long, fp long")


def flips(bits: int, most: int) -> list[np.ndarray]:
    """``flips[k]``: all masks of exactly k of the lowest ``bits`` bits, k up to ``most``."""
    one = np.uint64(1) << np.arange(bits, dtype=np.uint64)
    out = [np.zeros(1, dtype=np.uint64), one]
    for k in range(2, most + 1):
        top = np.repeat(out[-1], bits)
        mask = top | np.tile(one, len(out[-1]))
        out.append(np.unique(mask[np.bitwise_count(mask) == k]))
    return out[: most + 1]


Rows = tuple[np.ndarray, ...]


class Forest:
    """Union-find over the fingerprints of the keys that a task holds at once."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        top = x
        while (y := self.up.get(top, top)) != top:
            top = y
        while (y := self.up.get(x, x)) != top:
            self.up[x], x = top, y
        return top

    def unite(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.up.setdefault(min(a, b), min(a, b))

    def edges(self) -> np.ndarray:
        """(fingerprint, its group's root) of all that are linked and no root."""
        pairs = np.array([(x, self.root(x)) for x in self.up], dtype=np.uint64).reshape(-1, 2)
        return pairs[pairs[:, 0] != pairs[:, 1]]


@dataclass(frozen=True)
class Ball:
    """What may differ: ``bits`` bits after ``fixed`` leading ones, within ``radius`` of them."""

    radius: int = RADIUS
    fixed: int = 0
    bits: int = 64

    @property
    def half(self) -> int:
        return self.radius // 2

    def lengthen(self, rows: Rows, done: int, more: int) -> Rows:
        """Lengthen variants' prefixes of ``done`` bits by ``more``, in every way that half the radius allows.

        ``rows``: keys, which hold the prefix in their leading bits and zeros
        below, fingerprints and what they stand for.
        """
        keys, fps, nodes = rows
        shift = np.uint64(64 - done - more)
        own = (fps >> shift) & np.uint64((1 << more) - 1)
        free = max(0, min(done + more, self.fixed + self.bits) - max(done, self.fixed))
        lowest = np.uint64(max(0, done + more - self.fixed - self.bits))
        spent = np.bitwise_count((keys ^ fps) >> np.uint64(64 - done)) if done else np.zeros(len(keys), np.uint8)
        parts = []
        for k, masks in enumerate(flips(free, self.half)):
            may = spent + k <= self.half
            if may.any() and len(masks):
                key = keys[may, None] | ((own[may, None] ^ (masks << lowest)) << shift)
                parts.append((key.ravel(), np.repeat(fps[may], len(masks)), np.repeat(nodes[may], len(masks))))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else tuple(x[:0] for x in rows)

    def shared(self, rows: Rows, done: int) -> Iterator[Rows]:
        """Rows (variant, fingerprint, node) of variants that several rows share, sorted by variant, in bounded parts of whole variants.

        Rows that share none of a variant's prefix never meet.
        """
        end = min(64, self.fixed + self.bits)
        if len(rows[0]) < 2:
            return
        order = np.argsort(rows[0], kind="stable")
        rows = tuple(x[order] for x in rows)
        first = np.concatenate(([True], rows[0][1:] != rows[0][:-1]))
        group = np.cumsum(first) - 1
        many = np.bincount(group)[group] > 1  # a prefix that only one row reached links nothing
        rows = tuple(x[many] for x in rows)
        if done >= end:
            if len(rows[0]):
                yield rows
            return
        keys = rows[0]
        bounds = [*np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))), len(keys)] if len(keys) else [0]
        step = min(8, end - done)
        take = max(1, CHUNK_VARIANTS // sum(len(x) for x in flips(step, self.half)))
        at = 0
        while at < len(bounds) - 1:
            stop = max(at + 1, int(np.searchsorted(bounds, bounds[at] + take, side="right")) - 1)
            yield from self.shared(self.lengthen(tuple(x[bounds[at] : bounds[stop]] for x in rows), done, step), done + step)
            at = stop


def united(parts: Iterator[Rows]) -> Iterator[np.ndarray]:
    """Edges to the roots of groups that share variants: all of a group lies within the radius of each step, so the search itself verifies it."""
    forest = Forest()
    for keys, fps, _ in parts:
        same = (keys[1:] == keys[:-1]) & (fps[1:] != fps[:-1])
        for a, b in np.unique(np.stack((fps[:-1][same], fps[1:][same]), axis=1), axis=0).tolist():
            forest.unite(a, b)
    yield forest.edges()


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x, dtype=np.uint64).view(np.int64))


def _rows(batch: pa.RecordBatch) -> Rows:
    return tuple(batch.column(k).to_numpy().view(np.uint64) for k in range(3))


def _batches(rows: Rows, edge: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp, node), or edges in place of key and fp, in batches of bounded size."""
    for at in range(0, len(rows[0]), 1 << 18):
        part = [_signed(c[at : at + (1 << 18)]) for c in rows]
        yield pa.RecordBatch.from_arrays([*part, pa.array(np.full(len(part[0]), edge))], names=["key", "fp", "node", "edge"])


class Keys:
    """Rows of a task in the order of their keys, given in memory of a chunk: (False, rows of whole keys) and, of keys of over ``most`` rows, (True, rows)."""

    def __init__(self, most: int):
        self.most = most
        self.ended: list[Rows] = []
        self.open: list[Rows] = []  # the last key, which may go on
        self.last: np.uint64 | None = None
        self.crowded = False

    @staticmethod
    def _size(parts: list[Rows]) -> int:
        return sum(len(p[0]) for p in parts)

    def add(self, rows: Rows) -> Iterator[tuple[bool, Rows]]:
        keys = rows[0]
        part = lambda a, b: tuple(x[a:b] for x in rows)
        changes = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        goes_on = int(changes[0] if len(changes) else len(keys)) if keys[0] == self.last else 0
        last = max(goes_on, int(changes[-1]) if len(changes) else 0)
        if goes_on:
            if self.crowded:
                yield True, part(0, goes_on)
            else:
                self.open.append(part(0, goes_on))
        if last < len(keys):
            self.ended += [*self.open, part(goes_on, last)]
            self.open, self.last, self.crowded = [part(last, len(keys))], keys[-1], False
        if self._size(self.open) > self.most:
            for p in self.open:
                yield True, p
            self.open, self.crowded = [], True
        if self._size(self.ended) >= CHUNK_ROWS:
            yield from self._whole()

    def _whole(self) -> Iterator[tuple[bool, Rows]]:
        if self._size(self.ended):
            yield False, tuple(np.concatenate(x) for x in zip(*self.ended, strict=True))
        self.ended = []

    def rest(self) -> Iterator[tuple[bool, Rows]]:
        self.ended += self.open
        self.open = []
        yield from self._whole()


def links(nodes: DataFrame, ball: Ball = Ball(), prefix_bits: int = PREFIX_BITS, most_rows: int = MOST_ROWS, joined: Callable[[Iterator[Rows]], Iterator[np.ndarray]] = united) -> DataFrame:
    """Edges (a, b) among ``nodes`` (fp, node) that ``joined`` makes of the rows sharing a variant; checkpointed.

    With :func:`united` the edges connect distinct fingerprints exactly as a
    distance within the radius does. Keys of more than ``most_rows`` rows are
    not joined: their rows go on with ``prefix_bits`` further bits in another
    round, to other tasks, up to whole variants.
    """
    ship_code(nodes.sparkSession)
    if ball.radius % 2:
        raise ValueError("the radius is even: both sides meet half-way")
    end = min(64, ball.fixed + ball.bits)

    def lengthened(done: int, more: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    yield from _batches(ball.lengthen(_rows(batch.slice(at, 4096)), done, more))

        return run

    def meet(done: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = Keys(most_rows if done < end else 1 << 62)

            def handled(given: Iterator[tuple[bool, Rows]]) -> Iterator[pa.RecordBatch]:
                for crowded, rows in given:
                    if crowded:
                        yield from _batches(rows)
                    else:
                        for edges in joined(ball.shared(rows, done)):
                            yield from _batches((edges[:, 0], edges[:, 1], edges[:, 0]), edge=True)

            for batch in batches:
                if batch.num_rows:
                    yield from handled(held.add(_rows(batch)))
            yield from handled(held.rest())

        return run

    schema = "key long, fp long, node long, edge boolean"
    begin = nodes.select(F.lit(0).cast("long").alias("key"), "fp", "node", F.lit(False).alias("edge"))
    sent, done, found = begin.mapInArrow(lengthened(0, prefix_bits), schema), prefix_bits, []
    while True:
        met = cut(sent.select("key", "fp", "node").repartition("key").sortWithinPartitions("key").mapInArrow(meet(done), schema))
        found.append(met.where("edge").select(F.col("key").alias("a"), F.col("fp").alias("b")))
        more = min(prefix_bits, end - done)
        if more <= 0 or met.where("NOT edge").isEmpty():
            return reduce(DataFrame.unionAll, found)
        sent, done = met.where("NOT edge").mapInArrow(lengthened(done, more), schema), done + more


def classes(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, th, fp and component_id (the smallest doc_id reachable) of every row of ``docs``."""
    rows = cut(fingerprints(docs, shingle))
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    linked = components(links(nodes.select("fp", F.col("fp").alias("node")), Ball(radius))).withColumnRenamed("node", "fp")
    met = cut(nodes.join(linked, "fp", "left"))
    rooted = met.where(F.col("root").isNotNull())
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    # a component may hold a third of all fingerprints: its one row goes to every part of them
    salt = F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")
    every = least.select("root", "component_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    of = rooted.withColumn("salt", salt).join(every, ["root", "salt"]).select("fp", "component_id")
    lone = met.where(F.col("root").isNull()).select("fp", F.col("first").alias("component_id"))
    return rows.join(cut(of.unionByName(lone)), "fp")


def digest(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    hexed: Column = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return classes(docs, shingle, radius).select("doc_id", hexed.alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of ``docs`` per component: the one with the smallest doc_id (then the smallest text hash).

    Without a doc_id a component keeps its row of the smallest text hash.
    """
    found = classes(docs, shingle, radius)
    # components without any doc_id have no component_id; their fingerprints tell them apart
    lone = F.when(F.col("component_id").isNull(), F.col("fp")).alias("lone")
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("doc_id"), F.col("th").alias("th"))
    stay = found.groupBy("component_id", lone).agg(F.min(order).alias("s"))
    stay = cut(stay.select(F.col("s.doc_id").alias("stay_id"), F.col("s.th").alias("stay_th")))
    return only_rows(docs, stay)


def only_rows(docs: DataFrame, stay: DataFrame) -> DataFrame:
    """One row of ``docs`` for each (stay_id, stay_th); of rows alike in both the one with the smallest hash of all its columns.

    Texts are shuffled once: join and grouping are on the same plain keys.
    """
    keys = lambda d, th: [F.coalesce(F.xxhash64(d), F.lit(0)).alias("k_id"), d.isNull().alias("k_none"), th.alias("k_th")]
    names = ["k_id", "k_none", "k_th"]
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64("*").alias("rh"), *keys(F.col("doc_id"), text_key(F.col("text"))))
    kept = rows.join(stay.select(*keys(F.col("stay_id"), F.col("stay_th"))), names, "left_semi")
    return kept.groupBy(*names).agg(F.min_by("row", "rh").alias("row")).select("row.*")
