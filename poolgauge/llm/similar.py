"""Near copies by SimHash balls under many seeds, verified by exact shingle similarity: the near-dedup stage of the pipeline.

Two texts are near copies if the Jaccard similarity of their sets of
five-word shingles is at least 4/5; groups are the components of that relation
and keep one row each. One 64-bit fingerprint differs in about ten bits at that
similarity, out of reach of a ball of radius 4. So a text has ``SEEDS``
independently seeded SimHash fingerprints of ``PRINT_BITS`` bits, and the
meet-in-the-middle search of :mod:`simhash` runs over all of them at once
(the seed's number leads the fingerprint and may not differ): texts are
candidates if they come within ``RADIUS`` bits under any seed. At a similarity
of 0.8 a bit differs with a chance of 0.152, one seed finds the pair with 0.116
and all 48 with 0.997; at 0.85 with 0.9999.

Colliding pairs are verified three times, each time with less of them left:

* a fingerprint carries ``CHECK_BITS`` further bits that are not searched: a
  pair that differs in more than ``MOST_CHECK`` of them is no candidate;
* all 1536 bits of both nodes may differ in at most ``MOST_BITS`` (a pair at
  0.8 fails that with a chance below 1 in 10,000), and their sizes must allow
  the similarity;
* what is left is compared by whole shingle sets.

Two unrelated texts become candidates with a chance of about 2 in 10**7, so
their number stays below that of the texts up to some ten millions; beyond,
``PRINT_BITS`` and ``SEEDS`` have to grow with its logarithm.

How that stays small:

* texts with equal shingle sets are one node from the start; only a node's id,
  its fingerprints and its first row's (doc_id, th) are kept;
* a task pairs up to ``ALL_PAIRS`` rows of a variant with each other. In a
  larger group the node of the smallest id leads and is paired with all that
  pass its check; those that do not choose a leader among themselves, and so
  on until none is left;
* of each seed's pairs a task sends on all of a component of up to
  ``ALL_PAIRS`` nodes. A larger one is a crowd, of which it sends the minimum
  spanning tree by the bits that pairs differ in: less than one pair a node;
* each node's nearest candidate is compared first, and afterwards only pairs
  that this has not brought into one component: about one comparison of sets
  for each near copy;
* what a tree left out lies within a crowd (components of all crowds' trees).
  Crowds that are one component of similar texts by now are done; the sets of
  the others are compared by :mod:`crowds`, in blocks, without loss. So no pair
  is lost to leaders or trees.

Defined cases: words and shingles are those of :mod:`simhash`; texts without
words are alike; rows repeating a doc_id each take part; a null doc_id comes
after all others.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolgauge.llm.common import cut, text_key
from poolgauge.llm.components import components
from poolgauge.llm.crowds import BLOCK_NODES, BLOCK_SHINGLES, crowd_links
from poolgauge.llm.simhash import MOST_ROWS, SALTS, SEED, Ball, Forest, Rows, links, only_rows, shingle_hashes
from poolgauge.shipping import ship_code

SHINGLE = 5
#: Two fingerprints of 32 bits to a word of 64; a fingerprint as searched has the seed's number, its bits, and bits of the word's other half.
SEEDS, SEED_BITS, PRINT_BITS, CHECK_BITS, RADIUS = 48, 6, 32, 26, 2
WORDS = SEEDS // 2
NEAR = Ball(RADIUS, fixed=SEED_BITS, bits=PRINT_BITS)
#: Of the check bits: 0.152 of 26 at a similarity of 0.8, and 2.2 standard deviations more; unrelated texts pass with 0.04.
MOST_CHECK = 8
#: Of the bits of all seeds: 0.152 of 1536 at a similarity of 0.8, and four standard deviations more.
MOST_BITS = 289
#: Rows of one variant that are all paired within the task, and nodes of a component whose pairs are all sent on; larger ones are crowds.
ALL_PAIRS = 8

_RNG = np.random.default_rng(SEED)
_FLIP, _ODD, _MIX = (_RNG.integers(0, 1 << 64, (WORDS, 1), dtype=np.uint64) | np.uint64(1) for _ in range(3))
_LANES = np.uint64(0x0101010101010101)
#: Shingles whose bits a lane of a byte counts.
_AT_ONCE = 240


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of one whole text."""
    return np.unique(shingle_hashes(text, shingle))


def prints_of(shingles: np.ndarray) -> np.ndarray:
    """The fingerprints of all seeds: a bit is 1 if set in over half of the shingles' hashes under that seed."""
    ones = np.zeros((WORDS, 8, 8), dtype=np.int64)
    for at in range(0, len(shingles), _AT_ONCE):
        x = (shingles[at : at + _AT_ONCE] ^ _FLIP) * _ODD
        x ^= x >> np.uint64(32)
        x *= _MIX
        x ^= x >> np.uint64(29)
        for k in range(8):
            # a byte of the sum counts bit k of the same byte of all hashes
            ones[:, :, k] += ((x >> np.uint64(k)) & _LANES).sum(axis=1).view(np.uint8).reshape(WORDS, 8)
    return np.packbits(2 * ones.reshape(WORDS, 64) > len(shingles), axis=1, bitorder="little").view("<u8").ravel()


def _id_type(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def nodes_of(docs: DataFrame, shingle: int) -> DataFrame:
    """node (a hash of the shingle set), its size, prints, and first: order, doc_id and th of its first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, prints = [], [], []
            for t in batch.column(2):
                found = shingle_set(t.as_py(), shingle)
                ids.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
                sizes.append(len(found))
                prints.append(prints_of(found).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(prints, pa.list_(pa.int64()))], names=["doc_id", "th", "node", "size", "prints"])

    rows = docs.select("doc_id", text_key(F.col("text")).alias("th"), "text").mapInArrow(run, f"doc_id {_id_type(docs)}, th long, node long, size int, prints array<long>")
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "th")
    return rows.groupBy("node").agg(F.min(order).alias("first"), F.first("size").alias("size"), F.first("prints").alias("prints"))


def sets_of(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """node and its shingle set, from the text of its first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(t.as_py(), shingle).view(np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    first = nodes.select("node", F.col("first.doc_id").alias("first_id"), F.col("first.th").alias("first_th"))
    rows = docs.select("doc_id", text_key(F.col("text")).alias("th"), "text")
    met = rows.join(first, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("th") == F.col("first_th")))
    return met.groupBy("node").agg(F.first("text").alias("text")).mapInArrow(run, "node long, shingles array<long>")


def sparse(pairs: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Of pairs (seed, a, b): all of a seed's components of up to ``ALL_PAIRS`` nodes, as (less, greater); of larger ones, crowds, the minimum spanning tree by ``apart``, as (greater, less)."""
    forest = Forest()
    order = np.lexsort((pairs[:, 2], pairs[:, 1], apart))
    pairs = pairs[order]
    pairs = pairs[np.sort(np.unique(pairs, axis=0, return_index=True)[1])]
    ends, tree = [], np.zeros(len(pairs), dtype=bool)
    for k, (seed, a, b) in enumerate(pairs.tolist()):
        a, b = a << SEED_BITS | seed, b << SEED_BITS | seed
        ends.append(a)
        if forest.root(a) != forest.root(b):
            forest.unite(a, b)
            tree[k] = True
    roots = [forest.root(a) for a in ends]
    edges = Counter(r for r, t in zip(roots, tree.tolist(), strict=True) if t)
    crowd = np.array([edges[r] >= ALL_PAIRS for r in roots], dtype=bool)
    nodes = np.sort(pairs[:, 1:].view(np.int64), axis=1)
    return np.concatenate((nodes[~crowd], nodes[crowd & tree][:, ::-1])).view(np.uint64)


def candidates(parts: Iterator[Rows]) -> Iterator[np.ndarray]:
    """Pairs of nodes from rows that share a variant and pass the check bits, of each part thinned by :func:`sparse`."""
    check, whole = (np.uint64((1 << n) - 1) for n in (CHECK_BITS, CHECK_BITS + PRINT_BITS))
    for keys, fps, nodes in parts:
        # by variant and node: the first row of a large group leads it
        order = np.lexsort((nodes, keys))
        keys, fps, nodes = keys[order], fps[order], nodes[order]
        found, apart = [], []

        def weigh(i: np.ndarray, j: np.ndarray, fps=fps, nodes=nodes, found=found, apart=apart) -> np.ndarray:
            differ = fps[i] ^ fps[j]
            good = np.bitwise_count(differ & check) <= MOST_CHECK
            met = good & (nodes[i] != nodes[j])
            a, b = nodes[i[met]], nodes[j[met]]
            found.append(np.stack((fps[i[met]] >> np.uint64(64 - SEED_BITS), np.minimum(a, b), np.maximum(a, b)), axis=1))
            apart.append(np.bitwise_count(differ[met] & whole))
            return good

        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sizes = np.diff(np.concatenate((starts, [len(keys)])))
        small = np.repeat(sizes <= ALL_PAIRS, sizes)
        for d in range(1, min(ALL_PAIRS, len(keys))):
            i = np.flatnonzero(small[:-d] & (keys[d:] == keys[:-d]))
            weigh(i, i + d)
        left = np.flatnonzero(~small)
        while len(left):
            first = np.concatenate(([True], keys[left][1:] != keys[left][:-1]))
            leads = left[np.flatnonzero(first)][np.cumsum(first) - 1]
            near = weigh(leads, left)
            # leaders of one variant are tied: what follows different ones is of one crowd
            tied, led = left[~near], leads[~near]
            a, b = nodes[led], nodes[tied]
            found.append(np.stack((fps[led] >> np.uint64(64 - SEED_BITS), np.minimum(a, b), np.maximum(a, b)), axis=1)[a != b])
            apart.append(np.full(np.count_nonzero(a != b), 64, dtype=np.uint8))
            left = tied
        yield sparse(np.concatenate(found), np.concatenate(apart)) if found else np.zeros((0, 2), np.uint64)


def bits_apart(a: Column, b: Column) -> Column:
    """In how many bits of all seeds two arrays of prints differ."""
    of = [F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))) for k in range(WORDS)]
    return sum(of[1:], of[0])


def dealt_bits(prints: int) -> int:
    """Leading bits of a variant, the seed's among them, by which keys of evenly spread fingerprints have at most half of MOST_ROWS rows."""
    k = 3
    while prints * (1 + k) > SEEDS * 2**k * MOST_ROWS // 2 and k < PRINT_BITS:
        k += 1
    return SEED_BITS + k


def close_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b, crowd): pairs of nodes within the radius under some seed; of crowds the forests only. a is the smaller node."""
    word = F.col("word")
    part = lambda bits, at, n: F.shiftrightunsigned(bits, at).bitwiseAND(F.lit((1 << n) - 1))
    seeded = lambda seed, own, other: F.shiftleft(seed.cast("long"), 64 - SEED_BITS).bitwiseOR(F.shiftleft(own, CHECK_BITS)).bitwiseOR(other)
    both = F.array(seeded(2 * F.col("k"), part(word, 0, 32), part(word, 32, CHECK_BITS)), seeded(2 * F.col("k") + 1, part(word, 32, 32), part(word, 0, CHECK_BITS)))
    prints = nodes.select("node", F.posexplode("prints").alias("k", "word")).select("node", F.explode(both).alias("fp"))
    met = links(prints, NEAR, dealt_bits(nodes.count() * SEEDS), joined=candidates)
    return cut(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("a") > F.col("b")).alias("crowd")).groupBy("a", "b").agg(F.max("crowd").alias("crowd")))


def plausible_pairs(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(a, b, apart): those of ``found`` that may be similar by all bits and sizes."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("size").alias(f"n{x}"), F.col("prints").alias(f"p{x}"))
    met = found.select("a", "b").join(side("a"), "a").join(side("b"), "b").where(5 * F.least("na", "nb") >= 4 * F.greatest("na", "nb"))
    return cut(met.select("a", "b", bits_apart(F.col("pa"), F.col("pb")).alias("apart")).where(F.col("apart") <= MOST_BITS))


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a similarity of at least 4/5."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}"))
    both = F.size(F.array_intersect("sa", "sb"))
    # both / (a + b - both) >= 4/5
    return cut(pairs.join(side("a"), "a").join(side("b"), "b").where(9 * both >= 4 * (F.size("sa") + F.size("sb"))).select("a", "b"))


def open_members(crowds: DataFrame, roots: DataFrame, nodes: DataFrame) -> DataFrame:
    """crowd, node, root, and the crowd's number of blocks, of the nodes of crowds that are not one component yet."""
    # a crowd may hold a third of all nodes: its one row goes to every part of them
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")
    placed = cut(crowds.select("node", F.col("root").alias("crowd")).join(roots, "node", "left").join(nodes.select("node", "size"), "node").select("crowd", "node", F.coalesce("root", "node").alias("root"), "size", salt.alias("salt")))
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_NODES), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int")
    still = placed.groupBy("crowd").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), blocks.alias("blocks")).where("lo != hi")
    every = still.select("crowd", "blocks", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return cut(placed.join(every, ["crowd", "salt"]).select("crowd", "node", "root", "blocks"))


def groups(nodes: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """node and root of every node that is similar to another: components of the similar pairs."""
    found = close_pairs(nodes)
    pairs = plausible_pairs(nodes, found)
    crowds = components(found.where("crowd"))
    either = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), "apart").unionAll(pairs.select("b", "a", "apart"))
    compared = either.select(F.col("x").alias("node")).unionAll(crowds.select("node")).distinct()
    sets = cut(sets_of(docs, nodes.join(compared, "node", "left_semi"), shingle))
    nearest = either.groupBy("x").agg(F.min_by("y", F.struct("apart", "y")).alias("y"))
    first = cut(nearest.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    good = similar(first, sets)
    roots = components(good)
    at = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}"))
    apart = pairs.select("a", "b").join(first, ["a", "b"], "left_anti").join(at("a"), "a", "left").join(at("b"), "b", "left")
    rest = cut(apart.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b"))
    more = similar(rest, sets)
    if not more.isEmpty():
        good = good.unionAll(more)
        roots = components(good)
    members = open_members(crowds, roots, nodes)
    if members.isEmpty():
        return roots
    left = cut(crowd_links(members, sets))
    return roots if left.isEmpty() else components(good.unionAll(left))


def keep_first(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row of ``docs`` per group of near copies: the one with the smallest doc_id (then the smallest text hash)."""
    ship_code(docs.sparkSession)
    nodes = cut(nodes_of(docs, shingle))
    placed = nodes.join(groups(nodes, docs, shingle), "node", "left").withColumn("root", F.coalesce("root", "node"))
    stay = placed.groupBy("root").agg(F.min("first").alias("s"))
    return only_rows(docs, cut(stay.select(F.col("s.doc_id").alias("stay_id"), F.col("s.th").alias("stay_th"))))
