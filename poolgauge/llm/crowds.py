"""The exact way for crowds of the near-dedup stage: links between all sets of one crowd, compared in blocks.

Texts made from one template may all be candidates of each other by noisy
fingerprints and hardly any of them similar. For them the ball search sends
spanning forests only (:mod:`similar`); this module finds the links that a
forest leaves out, without fingerprints and without loss. Their shingles are
the template's, less a few in other places of each text, so no order of them
tells similar ones early; every two sets of a crowd have to be compared.

* a crowd's nodes are dealt out to blocks of about ``BLOCK_NODES`` nodes and
  ``BLOCK_SHINGLES`` shingles by a hash, and every two blocks are one group of
  bounded size, on any executor. A node is sent once per block of its crowd;
* how many shingles two sets share is counted for a whole pair of blocks:
  those that many hold by matrix products of zeros and ones, those that few
  hold by adding up their holders;
* only links between different components are returned, and of those of one
  pair of blocks a spanning forest; links are exact, so nothing is lost.

The work is the square of a crowd that is not one component (some 0.1
microseconds a pair), of no other group; what is returned is linear in nodes.

Defined cases: an empty set is in no crowd (one node holds all texts without
words); ties cannot occur; a very long text makes its block larger by itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolgauge.llm.simhash import Forest

BLOCK_NODES, BLOCK_SHINGLES = 1_000, 250_000
#: A shingle with more pairs of holders is counted by matrix product.
HEAVY = 20_000
#: Columns of one product, and pairs of holders counted at once.
COLUMNS, AT_ONCE = 1_024, 1 << 21


def shared_counts(rows_x: np.ndarray, tokens_x: np.ndarray, nx: int, rows_y: np.ndarray, tokens_y: np.ndarray, ny: int) -> np.ndarray:
    """How many tokens each set of x shares with each of y; tokens are numbers from 0, each once a set."""
    top = 1 + max(tokens_x.max(initial=-1), tokens_y.max(initial=-1))
    in_x, in_y = np.bincount(tokens_x, minlength=top), np.bincount(tokens_y, minlength=top)
    shared = np.zeros(nx * ny, dtype=np.int32)
    heavy = np.flatnonzero(in_x * in_y > HEAVY)
    for at in range(0, len(heavy), COLUMNS):
        column = np.full(top, -1)
        part = heavy[at : at + COLUMNS]
        column[part] = np.arange(len(part))
        sides = []
        for rows, tokens, n in ((rows_x, tokens_x, nx), (rows_y, tokens_y, ny)):
            of = column[tokens]
            side = np.zeros((n, len(part)), dtype=np.float32)
            side[rows[of >= 0], of[of >= 0]] = 1
            sides.append(side)
        shared += (sides[0] @ sides[1].T).astype(np.int32).ravel()
    by_token = np.argsort(tokens_y, kind="stable")
    starts = np.concatenate(([0], np.cumsum(in_y)))
    few = (in_y[tokens_x] > 0) & (in_x[tokens_x] * in_y[tokens_x] <= HEAVY)
    rows, tokens = rows_x[few], tokens_x[few]
    ends = np.cumsum(in_y[tokens])
    at = 0
    while at < len(tokens):
        done = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + AT_ONCE, side="right")))
        n = in_y[tokens[at:stop]]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        holders = rows_y[by_token[np.repeat(starts[tokens[at:stop]], n) + inner]]
        shared += np.bincount(np.repeat(rows[at:stop], n) * ny + holders, minlength=nx * ny).astype(np.int32)
        at = stop
    return shared.reshape(nx, ny)


def block_links(group: pa.Table) -> pa.Table:
    """(a, b): a spanning forest of the links between different roots of the two blocks i and j, or within one block."""
    group = group.combine_chunks()
    i, j = group["i"][0].as_py(), group["j"][0].as_py()
    block, node, root = (group[c].to_numpy() for c in ("block", "node", "root"))
    lists = group["shingles"].chunk(0)
    sizes = np.diff(lists.offsets.to_numpy())
    tokens = np.unique(lists.flatten().to_numpy(), return_inverse=True)[1]
    sides = []
    for b in (i, j):
        mine = block == b
        new = np.cumsum(mine) - 1
        rows = np.repeat(np.arange(len(node)), sizes)
        held = mine[rows]
        sides.append((new[rows[held]], tokens[held], int(mine.sum()), np.flatnonzero(mine)))
    x, y = sides
    linked = 9 * shared_counts(*x[:3], *y[:3]).astype(np.int64) >= 4 * (sizes[x[3]][:, None].astype(np.int64) + sizes[y[3]][None, :])
    linked &= root[x[3]][:, None] != root[y[3]][None, :]
    at = np.argwhere(linked)
    a, b = x[3][at[:, 0]], y[3][at[:, 1]]
    forest, kept = Forest(), []
    first = np.unique(np.stack((root[a], root[b]), axis=1), axis=0, return_index=True)[1]
    for k in first.tolist():
        p, q = int(root[a[k]]), int(root[b[k]])
        if forest.root(p) != forest.root(q):
            forest.unite(p, q)
            kept.append(k)
    a, b = node[a[kept]], node[b[kept]]
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def crowd_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links that connect the ``members`` (crowd, node, root, blocks) of different roots as all links within their crowd do."""
    block = F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int")
    sent = members.join(sets, "node").select("crowd", "node", "root", "shingles", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pairs = sent.select("crowd", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "root", "shingles")
    return pairs.groupBy("crowd", "i", "j").applyInArrow(block_links, "a long, b long")
