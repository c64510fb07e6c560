"""Benchmark decontamination with a generalised suffix automaton.

The normalised test items of one block are folded into a generalised suffix
automaton over words. Training words stream through it and the length of the
longest suffix that occurs in an item is tracked: whenever it reaches
``window`` words, those words are hit; an item shorter than the window counts
when it occurs whole. Runs of words that no item contains are skipped without
touching the automaton, because no match can span them.

Scale: documents are never shuffled to be matched; items are made distinct and
an item longer than a block is cut into overlapping pieces; each block of them
is broadcast, and a block is bounded by ``block_words`` (an aggregate sizes the
blocks before anything is collected). A larger benchmark takes more blocks,
each of which scans the documents; their sparse hits are merged by document.

Defined cases: words are runs of 0-9, a-z and non-ASCII after lower-casing
A-Z; a null or wordless text has none; an item without words never occurs;
items that repeat a text each count; a null item_id is matched for hits but is
no item of the list; rows repeating a doc_id are each judged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolgauge.llm.common import cut, text_key
from poolgauge.shipping import ship_code

WINDOW = 10
#: A broadcast automaton holds at most about so many item words (some hundred bytes each).
BLOCK_WORDS = 200_000
#: A cleaned document that had more than this share of its words hit is dropped whole.
MAX_COVERAGE = 0.5

_FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class ItemAutomaton:
    """Generalised suffix automaton of item word sequences, with what each state tells about items."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        own: list[set] = [set()]
        whole: list[list[tuple[int, int | None]]] = [[]]
        coded = [(item, [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words]) for item, words in items if words]
        self.shortest = min([window, *(len(c) for _, c in coded)], default=window)
        for item, code in coded:
            last = 0
            for c in code:
                last = self._extend(last, c, own, whole)
                own[last].add(item)
        for item, code in coded:
            if len(code) < window:
                state = 0
                for c in code:
                    state = self.next[state][c]
                whole[state].append((len(code), item))
        by_len = sorted(range(1, len(self.len)), key=self.len.__getitem__)
        for v in reversed(by_len):
            if self.len[self.link[v]] >= window:
                own[self.link[v]] |= own[v]
        #: for each state, the ancestor that holds the suffix of ``window`` words, or -1
        self.at_window = [-1] * len(self.len)
        #: for each state, the nearest one from it upwards where a short item ends, or 0
        self.short = [0] * len(self.len)
        for v in by_len:
            if self.len[v] >= window:
                up = self.link[v]
                self.at_window[v] = self.at_window[up] if self.len[up] >= window else v
            self.short[v] = v if whole[v] else self.short[self.link[v]]
        self.items = {v: tuple(sorted(x for x in own[v] if x is not None)) for v in set(self.at_window) if v >= 0}
        self.whole = {v: w for v, w in enumerate(whole) if w}

    def _state(self, length: int, own: list, whole: list) -> int:
        self.next.append({})
        self.link.append(0)
        self.len.append(length)
        own.append(set())
        whole.append([])
        return len(self.len) - 1

    def _split(self, p: int, q: int, c: int, own: list, whole: list) -> int:
        clone = self._state(self.len[p] + 1, own, whole)
        self.next[clone] = dict(self.next[q])
        self.link[clone] = self.link[q]
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int, own: list, whole: list) -> int:
        if (q := self.next[last].get(c)) is not None:
            return q if self.len[q] == self.len[last] + 1 else self._split(last, q, c, own, whole)
        new, p = self._state(self.len[last] + 1, own, whole), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._split(p, q, c, own, whole)
        return new

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged hit spans [start, end) in words, and the items that occur."""
        get = self.vocab.get
        code = np.array([get(w, 0) for w in words], dtype=np.int32)
        edge = np.flatnonzero(np.diff(np.concatenate(([0], code > 0, [0])).astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        for k in np.flatnonzero(ends - starts >= self.shortest):
            self._stream(code[starts[k] : ends[k]].tolist(), int(starts[k]), spans, found)
        return merged(spans), found

    def _stream(self, code: list[int], base: int, spans: list, found: set) -> None:
        nxt, link, length, window = self.next, self.link, self.len, self.window
        state = n = 0
        for i, c in enumerate(code, base + 1):
            while state and c not in nxt[state]:
                state = link[state]
                n = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                n += 1
            if n >= window:
                v = self.at_window[state]
                spans.append((i - window, i))
                found.update(self.items[v])
            v = self.short[state]
            while v:
                for size, item in self.whole[v]:
                    if size <= n:
                        spans.append((i - size, i))
                        if item is not None:
                            found.add(item)
                v = self.short[link[v]]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def pieces(benchmark: DataFrame, window: int, block_words: int) -> DataFrame:
    """item_id, piece, octets: each distinct item once; one longer than a block in pieces that overlap by a window less one word.

    Every window of an item lies in a piece, and a longer match is the union
    of windows, so pieces hit what the item does.
    """
    kind = benchmark.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0), batch.column(1), strict=True):
                words = words_of(text.as_py())
                step = max(1, block_words)
                for at in range(0, max(1, len(words) - window + 1), step):
                    part = b" ".join(words[at : at + step + window - 1])
                    yield pa.RecordBatch.from_arrays([pa.array([item.as_py()], batch.schema.field(0).type), pa.array([part], pa.binary()), pa.array([len(part)], pa.int64())], names=["item_id", "piece", "octets"])

    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull()).distinct()
    return items.mapInArrow(run, f"item_id {kind}, piece binary, octets long")


def n_blocks(parts: DataFrame, block_words: int) -> int:
    # octets bound the words: a word and its separator take at least two
    total = parts.agg(F.coalesce(F.sum(F.col("octets") + 1), F.lit(0)).alias("n")).first()["n"] // 2
    return max(1, -(-total // block_words))


def item_blocks(benchmark: DataFrame, window: int, block_words: int) -> tuple[int, Iterator[ItemAutomaton]]:
    """How many blocks there are, and their automata: each bounded block of items is collected and released in turn."""
    parts = cut(pieces(benchmark, window, block_words))
    blocks = n_blocks(parts, block_words)
    spread = F.pmod(F.xxhash64("item_id", "piece"), F.lit(blocks))

    def each() -> Iterator[ItemAutomaton]:
        for b in range(blocks):
            rows = (parts.where(spread == b) if blocks > 1 else parts).collect()
            # in a fixed order: the automaton's states depend on it, what it tells does not
            items = sorted(((r["item_id"], bytes(r["piece"])) for r in rows), key=lambda x: (x[0] is None, str(x[0]), x[1]))
            yield ItemAutomaton([(item, piece.split()) for item, piece in items], window)

    return blocks, each()


_HITS = "struct<start:int,end:int>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, th, n_words, spans (merged hit word ranges) and items of every row of ``docs``."""
    spark = docs.sparkSession
    ship_code(spark)
    rows = docs.select("doc_id", text_key(F.col("text")).alias("th"), "text")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, th long, n_words long, spans array<{_HITS}>, items array<long>"

    def scan(automaton: ItemAutomaton, only_hit: bool) -> DataFrame:
        shared = spark.sparkContext.broadcast(automaton)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find = shared.value
            for batch in batches:
                n, spans, items = [], [], []
                for text in batch.column(2):
                    words = words_of(text.as_py())
                    a, b = find.match(words) if find.vocab else ([], set())
                    n.append(len(words))
                    spans.append([{"start": x, "end": y} for x, y in a])
                    items.append(sorted(b))
                out = pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.int64()))],
                    names=["doc_id", "th", "n_words", "spans", "items"],
                )
                yield out.filter(pa.array([bool(x) for x in spans], pa.bool_())) if only_hit else out

        return rows.mapInArrow(run, schema)

    blocks, automata = item_blocks(benchmark, window, block_words)
    every = scan(next(automata), only_hit=False)
    if blocks == 1:
        return every
    every = cut(every)
    more = [cut(scan(a, only_hit=True)) for a in automata]
    sparse = every.where(F.size("spans") > 0)
    for x in more:
        sparse = sparse.unionByName(x)
    by_doc = sparse.groupBy(F.col("doc_id").alias("hit_id"), F.col("th").alias("hit_th")).agg(F.flatten(F.collect_set("spans")).alias("all_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("all_items"))

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"start": a, "end": b} for a, b in merged([(x["start"], x["end"]) for x in row.as_py()])] for row in batch.column(2)]
            columns = list(batch.columns)
            columns[2] = pa.array(spans, _SPANS)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    by_doc = by_doc.mapInArrow(unite, by_doc.schema)
    met = every.join(by_doc, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("th") == F.col("hit_th")), "left")
    return met.select("doc_id", "th", "n_words", F.coalesce("all_spans", "spans").alias("spans"), F.coalesce("all_items", "items").alias("items"))


def digest(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return hits(docs, benchmark, window, block_words).select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def _word_starts(text: str) -> list[tuple[int, int]]:
    """Code-point spans of the words of ``text``."""
    return [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    at, out, cursor = _word_starts(text), [], 0
    for a, b in spans:
        out.append(text[cursor : at[a][0]])
        cursor = at[b - 1][1]
    out.append(text[cursor:])
    return "".join(out)


def remove_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with hit spans cut from ``text``; rows hit over more than ``max_coverage`` of their words go.

    Columns stay as they are; clean rows pass untouched. Coverage is judged and
    spans are cut once, on the text as it came, so the number of blocks changes
    nothing: one block is matched where it is cut, with more of them the rows
    meet their spans merged over all blocks.
    """
    ship_code(docs.sparkSession)
    where = docs.columns.index("text")

    def cut_out(text: str, n_words: int, spans: list[tuple[int, int]]) -> tuple[bool, str]:
        keep = sum(b - a for a, b in spans) <= max_coverage * n_words
        return keep, without_spans(text, spans) if keep else text

    def cleaned(batch: pa.RecordBatch, found: Iterator[tuple[int, list[tuple[int, int]]]]) -> pa.RecordBatch:
        keep, texts = [], []
        for value, (n_words, spans) in zip(batch.column(where), found, strict=True):
            stays, text = cut_out(value.as_py(), n_words, spans) if spans else (True, value.as_py())
            keep.append(stays)
            texts.append(text)
        columns = list(batch.columns)
        columns[where] = pa.array(texts, batch.schema.field(where).type)
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(keep, pa.bool_()))

    blocks, automata = item_blocks(benchmark, window, block_words)
    if blocks == 1:
        shared = docs.sparkSession.sparkContext.broadcast(next(automata))

        def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find = shared.value

            def of(text: str | None) -> tuple[int, list[tuple[int, int]]]:
                words = words_of(text)
                return len(words), find.match(words)[0] if find.vocab else []

            for batch in batches:
                yield cleaned(batch, (of(value.as_py()) for value in batch.column(where)))

        return docs.mapInArrow(match, docs.schema)

    del automata

    def cut_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, spans = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            rows = pa.RecordBatch.from_arrays(batch.columns[:-2], schema=pa.schema(list(batch.schema)[:-2]))
            yield cleaned(rows, ((n, [(x["start"], x["end"]) for x in s or []]) for n, s in zip(n_words, spans, strict=True)))

    # one row for rows that repeat doc_id and text: their spans are alike
    hit = hits(docs, benchmark, window, block_words).where(F.size("spans") > 0).dropDuplicates(["doc_id", "th"])
    hit = cut(hit.select(F.col("doc_id").alias("hit_id"), F.col("th").alias("hit_th"), F.col("n_words").alias("hit_words"), F.col("spans").alias("hit_spans")))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("row_id"), text_key(F.col("text")).alias("row_th"))
    met = rows.join(hit, F.col("row_id").eqNullSafe(F.col("hit_id")) & (F.col("row_th") == F.col("hit_th")), "left")
    return met.select("row.*", "hit_words", "hit_spans").mapInArrow(cut_spans, docs.schema)
