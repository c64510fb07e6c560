"""Conversation repair, cross-tokenizer alignment and packing against plain versions."""

import collections
import random
import zlib

import brute
import numpy as np
import pytest
from oracle_compare import DATA
from test_contracts import listed, rows_of

from poolgauge.llm import bpe, crosstok, packing, repair, wavelet
from poolgauge.llm.queries import QUERIES

REPAIR = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
ALIGN = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("sf", ["data", "edge"])
def test_repair(spark, edge, sf):
    sf = DATA if sf == "data" else edge
    want = brute.repaired(rows_of(spark, sf, "conversations", "conv_id", "turn", "role", "text"))
    assert listed(QUERIES["op11_conversation_repair"](spark, sf), *REPAIR) == sorted(want, key=str)


@pytest.mark.parametrize("block_rows", [1, 3, repair.BLOCK_ROWS])
def test_repair_in_blocks(spark, block_rows):
    """Ties, nulls, repeats and odd roles; a conversation of many blocks is repaired as one."""
    rng = random.Random(3)
    roles, texts = ["user", "assistant", "system", None, "tool", "", "u"], ["hi.", "hi", "", None, "ok!", "what?", "x y. ", "\n"]
    rows = [(rng.choice([1, 2, None]), rng.choice([None, *range(40)]), rng.choices(roles, [5, 5, 2, 1, 1, 1, 1])[0], rng.choice(texts)) for _ in range(150)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert listed(repair.digest(df, block_rows), *REPAIR) == sorted(brute.repaired(rows), key=str)


def test_repair_of_a_crowded_conversation(spark):
    """A third of all rows in one conversation, another third one repeated row: neither is gathered, and the audit is whole."""
    n = 20_000
    crowd = spark.range(n).selectExpr("7 AS conv_id", "id AS turn", "CASE WHEN id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role", "concat('word ', id, '.') AS text")
    alike = spark.range(n).selectExpr("8 AS conv_id", "5 AS turn", "'user' AS role", "'again.' AS text")
    found = {r["conv_id"]: r for r in repair.digest(crowd.union(alike), 1_000).collect()}
    left = [t for t in range(n) if zlib.crc32(f"7:{t}".encode()) % 20]
    assert len(found[7]["audit"].replace("I", "")) == len(left) + sum(zlib.crc32(f"7:{t}".encode()) % 20 == 3 for t in left)
    times = {0: 0, 3: 2}.get(zlib.crc32(b"8:5") % 20, 1) * n
    assert found[8]["duplicate"] == times - 1 and found[8]["audit"].count("D") >= times - 1


@pytest.mark.parametrize("sf", ["data", "edge"])
def test_alignment(spark, edge, sf):
    sf = DATA if sf == "data" else edge
    want = brute.aligned(rows_of(spark, sf, "documents", "doc_id", "text"))
    assert listed(QUERIES["op12_cross_tokenizer"](spark, sf), *ALIGN) == sorted(want, key=str)


def test_alignment_of_odd_texts(spark):
    texts = ["a  b ", "\nx", "x\n\n.y", "²., ½.", "▁x", "foo▁bar", "<s><|endoftext|> </s>", "\0a", "　x é", "É.É,", "it's 'll  ...  ,a.b,c 1,2.3\t\r\n end ", "😀.,😀 ", "a\xa0 b", " ", "..", "._.,a_.b", "日本語。 テスト", "x" * 5_000]
    rows = list(enumerate(texts * 2))
    got = crosstok.digest(spark.createDataFrame(rows, "doc_id long, text string"))
    assert listed(got, *ALIGN) == sorted(brute.aligned(rows), key=str)


def test_alignment_over_parts_and_salts(spark, monkeypatch):
    for name, value in (("PART_DOCS", 3), ("PARTS_PER_KEY", 2), ("PARTS_PER_SUM", 2), ("HELD_PAIRS", 50)):
        monkeypatch.setattr(crosstok, name, value)
    rows = rows_of(spark, DATA, "documents", "doc_id", "text")[:60]
    got = crosstok.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert listed(got, *ALIGN) == sorted(brute.aligned(rows), key=str)
    best = crosstok.best_pairs(spark.createDataFrame(rows, "doc_id long, text string"))
    tops = {r["a"]: r["docs"] for r in best.where("best").collect()}
    assert all(tops[r["a"]] >= r["docs"] for r in best.collect())


def held(found, ids):
    """Pieces hold every id once, and sequences are gapless; the padding of all."""
    of_doc, of_sequence, padding = collections.defaultdict(list), collections.defaultdict(list), 0
    for r in found:
        of_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        of_doc[r["doc_id"]].append(r)
    for doc_id, wanted in ids.items():
        rows = sorted(of_doc[doc_id], key=lambda r: r["start"])
        whole = sum(map(len, wanted))
        assert sum(r["length"] for r in rows) == whole
        if len(wanted) == 1:
            at = 0
            for r in rows:
                assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, whole, zlib.crc32(wanted[0][at : at + r["length"]].tobytes()))
                at += r["length"]
    assert sorted(of_sequence) == list(range(len(of_sequence)))
    for parts in of_sequence.values():
        size = 0
        for offset, length in sorted(parts):
            assert offset == size
            size += length
        assert size <= packing.SEQUENCE
        padding += 0 if size & (size - 1) == 0 else packing.SEQUENCE - size
    return padding


@pytest.mark.parametrize("sf", ["data", "edge"])
def test_packing(spark, edge, sf):
    sf = DATA if sf == "data" else edge
    tok, ids = brute.tokenizer(), collections.defaultdict(list)
    for d, text in rows_of(spark, sf, "documents", "doc_id", "text"):
        ids[d].append(np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], "<u4"))
    assert held(QUERIES["op13_packing"](spark, sf).collect(), ids) == 0


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame(rows_of(spark, DATA, "documents", "doc_id", "text"), "doc_id long, text string")
    rows = packing.sequences(packing.pack(docs, with_ids=True)).collect()
    assert all(len(packing.unpacked(r["ids"], r["n_tokens"])) == r["n_tokens"] <= packing.SEQUENCE for r in rows)
    assert sum(r["n_tokens"] for r in rows) == sum(n for _, _, n, _ in brute.token_file([(d, t or "") for d, t in rows_of(spark, DATA, "documents", "doc_id", "text")]))


@pytest.mark.parametrize("histogram", [{}, {5: 3}, {1024: 7, 1: 1}, {600: 100}, {3: 5, 700: 2}, dict(collections.Counter(random.Random(1).choices(range(1, 1025), k=3_000)))])
def test_plans_place_every_piece_without_padding(histogram):
    plan = packing.planned(histogram)
    spans = collections.defaultdict(list)
    for size, n in histogram.items():
        for rank, (sequence, offset) in enumerate(zip(*(x.tolist() for x in plan.spots(size, np.arange(n))), strict=True)):
            for _, length, s, o in [(0, size, sequence, offset)] if sequence >= 0 else plan.fragments(size, rank):
                spans[s].append((o, length))
    assert sorted(spans) == list(range(plan.sequences))
    for parts in spans.values():
        total = 0
        for offset, length in sorted(parts):
            assert offset == total
            total += length
        assert total == packing.SEQUENCE or total & (total - 1) == 0


def test_batches_of_several_columns(spark):
    """A batch longer than what is encoded at once, nulls and empty texts at its seams: rows keep their ids in packing and files."""
    rng = random.Random(12)
    words = [f"{rng.choice('abc')}{rng.randrange(500)}é"[: rng.randrange(1, 6)] for _ in range(300)]
    texts = [None, "", *[" ".join(rng.choices(words, k=n)) for n in (900_000, 3, 1_200_000, 500_000)], None, "", "<|endoftext|> end", "last"]
    assert len("".join(t or "" for t in texts)) > 2 * bpe.COLUMN_BYTES
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    ids = [np.array([*e.ids, 0], "<u4") for e in brute.tokenizer().encode_batch([t or "" for t in texts], add_special_tokens=False)]
    parts: dict = collections.defaultdict(list)
    for r in packing.pack(df).collect():
        assert r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
        parts[r["doc_id"]].append((r["start"], r["length"]))
    for i, own in enumerate(ids):
        assert [a for a, _ in sorted(parts[i])] == [0, *np.cumsum([n for _, n in sorted(parts[i])]).tolist()[:-1]] and sum(n for _, n in parts[i]) == len(own)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in wavelet.digest(spark, df).collect()}
    assert got == {i: (sum(map(len, ids[:i])), len(own), zlib.crc32(own.tobytes())) for i, own in enumerate(ids)}
