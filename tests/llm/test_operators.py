"""General interfaces of the operators: pseudonyms, token lookup, segments, blocks, chunk joins."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from poolgauge.llm import bpe, decontam, pii, simhash, similar, warc, wavelet
from poolgauge.llm.common import fresh_folder
from poolgauge.llm.components import components

KEY = "test key"


def pseudonymised(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r["text"] for r in pii.protect(df, KEY).orderBy("doc_id").collect()]


def test_pseudonyms_follow_the_network(spark):
    import hashlib

    key = hashlib.sha256(KEY.encode()).hexdigest()
    ssn, token, card = "123-45-6789", "0123456789abcdef" * 2, "4111 1111 1111 1111"
    got = pseudonymised(spark, [ssn, f"x {token}.", card, None, "", "clean text", f"{ssn} again"])
    assert got[0] == brute.ssn(ssn, key) != ssn
    assert got[1] == f"x {brute.permuted(token, key, 'token', ('0123456789abcdef',))}."
    body = brute.permuted(card.replace(" ", "")[:-1], key, "card", ("0123456789",))
    assert got[2].replace(" ", "")[:-1] == body
    assert [i for i, c in enumerate(got[2]) if c == " "] == [4, 9, 14]
    assert got[3:6] == [None, "", "clean text"]
    assert got[6] == f"{got[0]} again"


def test_pseudonyms_keep_formats(spark):
    texts = ["4111111111111111", "4111111111111112", "2024-02-29", "2024-02-31", "31.12.1999", "02/28/2001", "10.0.0.1", "10.0.0.300", "mail to Jo.Doe7@mail.example.org now", "+1 (415) 555-0100"]
    got = pseudonymised(spark, texts)
    digits = [int(c) for c in reversed(got[0])]
    assert sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0 and got[0] != texts[0]
    assert (got[1], got[3], got[7]) == (texts[1], texts[3], texts[7])
    from datetime import datetime

    for i, layout in ((2, "%Y-%m-%d"), (4, "%d.%m.%Y"), (5, "%m/%d/%Y")):
        datetime.strptime(got[i], layout)
    assert all(int(x) < 256 for x in got[6].split("."))
    assert got[8].startswith("mail to ") and got[8].endswith("@mail.example.org now")
    assert [c if not c.isdigit() else "0" for c in got[9]] == [c if not c.isdigit() else "0" for c in texts[9]]


def test_numbers_that_cannot_be_issued_stay(spark):
    texts = ["000-12-3456", "666-12-3456", "912-34-5678", "123-00-4567", "123-45-0000", "001-01-0001", "899-99-9999", "665-01-0001", "667-01-0001"]
    got = pseudonymised(spark, texts)
    assert got[:5] == texts[:5]
    assert all(a != b and brute.issued(b) for a, b in zip(texts[5:], got[5:], strict=True)) and len(set(got)) == len(got)


def test_dates_stay_apart(spark):
    from datetime import date, timedelta

    days = [(date(1999, 1, 1) + timedelta(days=i)).isoformat() for i in range(500)]
    assert len(set(pseudonymised(spark, days))) == len(days)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "b ", " ", "\n", "it's", "é", "😀", ".", ", ", "  ", "\t", " ", "<|endoftext|>", "123", "word", "_", "\x00"]), max_size=60).map("".join))
def test_chunk_joins_are_exact(text):
    own = bpe.codec(bpe.vocabulary_path(), bits=2)
    tok = brute.tokenizer()
    ids = np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert own.encode(text) == ids
    assert own.encode_by_piece([text]) == [ids]
    assert own.decode(ids) == tok.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)


def test_columns_look_up_each_piece_once():
    """What a column's encoding asks of Python follows its different pieces, not all of them."""

    class Counted(dict):
        asked = 0

        def __getitem__(self, key):
            self.asked += 1
            return super().__getitem__(key)

    own = bpe.Codec(bpe.vocabulary_path())
    text = "one two three four, five. " * 20
    ids = own.encode_by_piece([text])
    own.pieces.young = Counted(own.pieces.young)
    assert own.encode_by_piece([text, None, text] * 20) == [*ids, b"", *ids] * 20
    assert 0 < own.pieces.young.asked <= 20


@pytest.mark.parametrize("kind", ["string", "large_string"])
def test_columns_equal_the_library(kind):
    """Any part of a column, with nulls, added tokens and characters of one to four bytes before every mark."""
    rng, own, tok = random.Random(6), bpe.Codec(bpe.vocabulary_path()), brute.tokenizer()
    signs = [*"aZ7é日。ß²½_!' \n.,\t\r\0\xa0\u3000\u0301ا😀𝒜", "'s", "<|endoftext|>", "<|", "|>"]
    for _ in range(100):
        texts = [None if rng.random() < 0.1 else "".join(rng.choices(signs, k=rng.randrange(30))) for _ in range(rng.randrange(20))]
        column = pa.array(texts, pa.string()).cast(kind).slice(min(len(texts), rng.randrange(4)))
        ids, ends = own.encode_column(column)
        want = [tok.encode(t or "", add_special_tokens=False).ids for t in column.to_pylist()]
        assert ends.tolist() == np.cumsum([len(x) for x in want]).tolist() and ids.tolist() == [i for x in want for i in x]


def test_spans_hold_a_columns_texts_in_order():
    texts = pa.array(["ab", None, "", "c" * 9, "d", None, "ef", "g"]).slice(1)
    for most in (1, 3, 100):
        runs = list(bpe.spans(texts, most))
        assert [t for r in runs for t in r.to_pylist()] == texts.to_pylist()
        assert all(len(r) == 1 or sum(len(t or "") for t in r.to_pylist()) <= most for r in runs)
    assert list(bpe.spans(texts.slice(0, 0), 3)) == []


def test_encode_decode_round_trip(spark):
    df = spark.createDataFrame([(1, "some text. with 😀"), (2, None), (3, "")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(df)).collect()} == {1: "some text. with 😀", 2: "", 3: ""}


def test_wavelet_matrix():
    rng = np.random.default_rng(3)
    tokens = rng.integers(0, 300, 150_000).astype(np.uint32)
    shard = wavelet.WaveletFile(wavelet.build(tokens, [1, None], np.array([70_000, 150_000])))
    assert (shard.tokens() == tokens).all() and shard.doc_ids == [1, None]
    for i in (0, 1, 65_535, 65_536, 149_999):
        assert shard.access(i) == tokens[i]
    for t in (0, 7, 299):
        places = np.flatnonzero(tokens == t)
        assert shard.count(t) == len(places) and shard.rank(t, 65_537) == (places < 65_537).sum()
        assert [shard.select(t, k) for k in (0, len(places) // 2, len(places) - 1)] == [places[0], places[len(places) // 2], places[-1]]
    assert shard.count(100_000) == 0
    with pytest.raises(IndexError):
        shard.select(7, 10**6)


def test_all_occurrences_at_once():
    rng = np.random.default_rng(4)
    tokens = rng.choice(np.array([0, 1, 2, 3, 50_000, 70_000], dtype=np.uint32), 200_000, p=[0.5, 0.3, 0.1, 0.05, 0.04, 0.01])
    shard = wavelet.WaveletFile(wavelet.build(tokens, [1], np.array([200_000])))
    for t in (0, 1, 2, 3, 50_000, 70_000, 4, 10**6):
        assert shard.occurrences(t).tolist() == np.flatnonzero(tokens == t).tolist()
    assert [shard.rank(0, i) for i in (511, 512, 513, 66_047, 199_999)] == [int((tokens[:i] == 0).sum()) for i in (511, 512, 513, 66_047, 199_999)]


def test_occurrences(spark):
    df = spark.createDataFrame([(i, "the cat and the dog " * i) for i in range(6)], "doc_id long, text string")
    manifest = wavelet.write(df, fresh_folder(spark, "t"), shard_tokens=20)
    tok = brute.tokenizer()
    flat = [x for i in range(6) for x in [*tok.encode("the cat and the dog " * i, add_special_tokens=False).ids, 0]]
    want = flat[1] if len(flat) > 1 else 0
    assert sorted(r["at"] for r in wavelet.occurrences(manifest, want).collect()) == [i for i, x in enumerate(flat) if x == want]


def test_archives_give_the_pages_back(spark):
    html = {1: "a" * 5000, 2: "", 3: "é\r\n0\r\n\r\n" * 700, 4: "WARC/1.1\r\n\r\n"}
    df = spark.createDataFrame([(k, "u", v) for k, v in html.items()], "page_id long, url string, html string")
    folder = fresh_folder(spark, "w")
    warc.write(df, folder, segment_bytes=300, archive_bytes=400)
    assert {r["page_id"]: r["html"] for r in warc.read(spark, folder, html=True).collect()} == html


def test_copies_of_a_long_page_stay_apart(spark):
    df = spark.createDataFrame([(None, "u", "z" * 900)] * 5 + [(7, "u", "y" * 900)] * 4, "page_id long, url string, html string")
    folder = fresh_folder(spark, "w")
    warc.write(df, folder, segment_bytes=300, archive_bytes=10_000)
    assert sorted((r["page_id"] or 0, r["html"][0], len(r["html"])) for r in warc.read(spark, folder, html=True).collect()) == [(0, "z", 900)] * 5 + [(7, "y", 900)] * 4


def test_missing_segments_are_noticed():
    parts = [{"number": 1, "total": None, "fields": "", "block": b"x"}, {"number": 3, "total": 2, "fields": None, "block": b"y"}]
    with pytest.raises(ValueError, match="missing"):
        warc.reassembled(parts)
    with pytest.raises(ValueError, match="add up"):
        warc.reassembled([parts[0], parts[1] | {"number": 2, "total": 3}])


def test_item_blocks_agree(spark):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("abcdef") for _ in range(n))
    items = [(i, text(rng.choice([2, 9, 10, 14]) if i else 0)) for i in range(30)]
    docs = [(i, text(120)) for i in range(40)] + [(1, None), (None, items[3][1])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one, many = (sorted(map(str, decontam.digest(d, b, block_words=w).collect())) for w in (10**6, 40))
    assert one == many
    n_hit = sorted((str(x), len(brute.hit_words(t, items)[1]), len(brute.hit_words(t, items)[2])) for x, t in docs)
    assert sorted((str(r["doc_id"]), r["n_hit"], r["n_items"]) for r in decontam.digest(d, b).collect()) == n_hit


def same_groups(got, signed, prints, radius=4):
    """Whether nodes' roots group the signed fingerprints as comparing all pairs does."""
    order = sorted(prints)
    want = dict(zip(order, brute.components(order, order, radius), strict=True))
    by_root: dict = {}
    for x in signed:
        by_root.setdefault(got.get(x, x), set()).add(x % (1 << 64))
    by_want: dict = {}
    for p, c in want.items():
        by_want.setdefault(c, set()).add(p)
    return sorted(map(sorted, by_root.values())) == sorted(map(sorted, by_want.values()))


@pytest.mark.parametrize("most_rows", [1 << 18, 40])
def test_links_are_whole(spark, most_rows):
    """Also where crowded keys go on to further rounds."""
    rng = random.Random(11)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    prints = {s ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(7))) for s in seeds for _ in range(25)} | {0, 15, 255, 2**64 - 1}
    signed = {p - (1 << 64) if p >> 63 else p for p in prints}
    edges = simhash.links(spark.createDataFrame([(x, x) for x in signed], "fp long, node long"), most_rows=most_rows)
    assert same_groups({r["node"]: r["root"] for r in components(edges).collect()}, signed, prints)


def test_links_of_seeded_prints(spark):
    """The leading bits of a ball that fixes them never differ; the bits below it are ignored as they are all zero."""
    rng = random.Random(12)
    centres = [rng.getrandbits(32) for _ in range(8)]
    prints = {seed << 58 | (c ^ sum(1 << b for b in rng.sample(range(32), rng.randrange(4)))) << 26 for seed in (0, 1, 47) for c in centres for _ in range(8)}
    signed = {p - (1 << 64) if p >> 63 else p for p in prints}
    edges = simhash.links(spark.createDataFrame([(x, x) for x in signed], "fp long, node long"), similar.NEAR, similar.dealt_bits(len(prints)), most_rows=20)
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    by_seed = [{x for x in prints if x >> 58 == seed} for seed in (0, 1, 47)]
    assert all(same_groups(got, {p - (1 << 64) if p >> 63 else p for p in part}, part, 2) for part in by_seed)


@pytest.mark.parametrize("most", [1, 3, 1000])
def test_keys_end_and_begin_anywhere_in_a_batch(most):
    rng = random.Random(most)
    for _ in range(200):
        keys = np.sort(np.array([rng.randrange(6) for _ in range(rng.randrange(1, 40))], dtype=np.uint64))
        fps, rows, given = np.arange(len(keys), dtype=np.uint64), simhash.Keys(most), []
        at = 0
        while at < len(keys):
            stop = at + rng.randrange(1, 9)
            given += rows.add((keys[at:stop], fps[at:stop], fps[at:stop]))
            at = stop
        given += rows.rest()
        assert sorted(x for _, part in given for x in part[1].tolist()) == fps.tolist()
        whole = [set(part[0].tolist()) for crowded, part in given if not crowded]
        passed = {k for crowded, part in given if crowded for k in part[0].tolist()}
        # a key is joined in one piece or passed on as a whole
        assert sum(map(len, whole)) == len(set().union(*whole)) and not passed & set().union(*whole)


def test_a_crowd_of_prints_takes_linear_time():
    """200,000 distinct fingerprints within four bits of one: no key is held beyond its bound, and twice the rows take about twice the time."""
    import time

    rng = np.random.default_rng(5)
    seconds = []
    for n in (100_000, 200_000):
        flipped = np.uint64(1) << rng.integers(0, 64, (4, 2 * n), dtype=np.uint64)
        fps = np.unique(np.bitwise_xor.reduce(flipped, axis=0) ^ np.uint64(0x1234_5678_9ABC_DEF0))[:n]
        keys, fps, _ = simhash.Ball().lengthen((np.zeros(len(fps), np.uint64), fps, fps), 0, 12)
        order = np.argsort(keys, kind="stable")
        began, rows, passed = time.perf_counter(), simhash.Keys(1 << 14), 0
        for at in range(0, len(order), 10_000):
            part = order[at : at + 10_000]
            for crowded, given in rows.add((keys[part], fps[part], fps[part])):
                passed += len(given[0])
                assert crowded or len(given[0]) <= simhash.CHUNK_ROWS + (1 << 14) + 10_000
        passed += sum(len(given[0]) for _, given in rows.rest())
        seconds.append(time.perf_counter() - began)
        assert passed == len(order)
    assert seconds[1] < 4 * seconds[0] + 0.5


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (201, 200)], "a long, b long")
    assert {r["node"]: r["root"] for r in components(edges).collect()} == {**{i: 0 for i in range(41)}, 200: 200, 201: 200}


def _jaccard(a, b, n=5):
    x, y = ({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} for w in (a, b))
    return len(x & y) / len(x | y)


def test_near_copies_of_80_percent_are_linked(spark):
    rng = random.Random(3)
    docs, pairs = [], 0
    for k in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        twin = list(words)
        for at in (20, 60, 100, 150):  # 20 of 196 shingles change
            twin[at] = "other"
        assert 0.8 <= _jaccard(words, twin) < 0.83
        far = list(words)
        for at in (20, 60, 100, 130, 150, 180):
            far[at] = "farther"
        assert _jaccard(words, far) < 0.8
        docs += [(3 * k, " ".join(words)), (3 * k + 1, " ".join(twin)), (3 * k + 2, " ".join(far))]
        pairs += 1
    got = {r["doc_id"] for r in similar.keep_first(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {x for x, _ in docs if x % 3 != 1}


def test_groups_of_near_copies_are_whole(spark):
    """Chains, stars and exact copies against all pairs."""
    rng = random.Random(8)
    docs = []
    for _ in range(6):
        words = [f"w{rng.randrange(10**6)}" for _ in range(150)]
        for _ in range(12):
            docs.append((len(docs), " ".join(words)))
            words = [f"w{rng.randrange(10**6)}" if rng.random() < 0.02 else w for w in words]
        docs.append((len(docs), docs[-1][1].upper()))
    docs += [(900, None), (901, " "), (None, "alone with no id at all"), (None, docs[0][1])]
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    words = [brute.lower(t or "").split() for _, t in docs]
    for i in range(len(docs)):
        for j in range(i):
            if words[i] and words[j] and _jaccard(words[i], words[j]) >= 0.8 or words[i] == words[j]:
                up[root(i)] = root(j)
    want: dict = {}
    for i, (d, _) in enumerate(docs):
        want.setdefault(root(i), []).append(d)
    want = sorted(str(min((x for x in g if x is not None), default=None)) for g in want.values())
    got = similar.keep_first(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(str(r["doc_id"]) for r in got.collect()) == want


def test_leaks_go_alike_in_one_block_and_many(spark):
    rng = random.Random(6)
    fresh = iter(range(10**6))
    clean = lambda n: " ".join(f"c{next(fresh)}" for _ in range(n))
    passage = clean(15).split()
    items = [(i, clean(30)) for i in range(20)] + [(50, " ".join(passage[:10])), (51, " ".join(passage[5:])), (52, clean(10)), (53, "")]
    split = items[22][1].split()
    docs = [
        (1, f"{items[0][1]} {clean(40)} {items[1][1]} {items[2][1]}"),  # 90 of 130 words
        (2, f"{clean(20)} {' '.join(passage)} {clean(20)}"),
        (3, f"{clean(20)} {' '.join(split[:5])} {items[3][1]} {' '.join(split[5:])} {clean(60)}"),
        (None, f"{items[4][1]} {clean(70)}"),
        (5, None),
        (6, clean(12)),
    ] + [(7, f"{clean(50)} {rng.choice(items)[1]} tail")] * 3
    docs += [(10 + i, f"{items[i][1]} {clean(40)} {items[i + 1][1]}") for i in range(19)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one, many = (sorted(map(str, decontam.remove_leaks(d, b, block_words=w).collect())) for w in (10**6, 40))
    assert one == many
    want = [(x, brute.cleaned(t or "", items) if t is not None else None) for x, t in docs]
    assert sorted(map(str, decontam.remove_leaks(d, b, block_words=40).collect())) == sorted(str(r) for r in spark.createDataFrame([w for w in want if w[1] is not ...], "doc_id long, text string").collect())


def test_cards_beside_other_numbers(spark):
    card, spaced = "4111111111111111", "4111 1111 1111 1111"
    got = pseudonymised(spark, [card, f"{card} 12/27", f"{spaced} 123", f"{card} 12 times", f"12 {card}", f"{spaced}-9", f"{card} {card}", "4111111111111112 12", f"7 {spaced} 4"])
    new = got[0]
    parted = " ".join(new[i : i + 4] for i in range(0, 16, 4))
    assert new != card
    assert got[1:] == [f"{new} 12/27", f"{parted} 123", f"{new} 12 times", f"12 {new}", f"{parted}-9", f"{new} {new}", "4111111111111112 12", f"7 {parted} 4"]


def test_other_tokenizers_are_refused():
    import json

    spec = json.loads(brute.tokenizer().to_str())
    assert bpe.require_known(spec) == ["<|endoftext|>"]
    pre, token = spec["pre_tokenizer"], spec["added_tokens"][0]
    for other in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": pre | {"add_prefix_space": True}}, {"model": spec["model"] | {"dropout": 0.1}}, {"added_tokens": [token | {"content": "a b"}]}, {"added_tokens": [token | {"lstrip": True}]}, {"decoder": None}):
        with pytest.raises(ValueError, match="|".join(other)):
            bpe.require_known(spec | other)


def test_reuse_counts_chunks(spark):
    rng = random.Random(9)
    passage = " ".join(f"w{rng.randrange(10**6)}" for _ in range(3000))
    df = spark.createDataFrame([(i, f"start {i} {passage} end {i}") for i in range(8)], "doc_id long, text string").coalesce(1)
    r = bpe.reuse(df).first()
    assert r["characters"] == sum(len(f"start {i} {passage} end {i}") for i in range(8))
    assert r["distinct_chunks"] == r["encoded_chunks"] < r["chunks"] / 4


@pytest.mark.parametrize("block_turns", [1, 2, 3])
def test_snapshots_collapse_over_blocks(spark, block_turns):
    """Prefixes that end within, at and beyond a block; numbers with gaps; other texts at any place."""
    from poolgauge.llm import chat

    rng = random.Random(block_turns)
    said = {i: f"t{i}" for i in range(9)}
    logs = {}
    for c in range(40):
        n = rng.randrange(1, 9)
        logs[c] = [(2 * i, said[i] if rng.random() < 0.97 else f"other{c}") for i in range(n)]
    rows = [(c, i, "user", t) for c, turns in logs.items() for i, t in turns]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"), block_turns).collect()
    unique: dict = {}
    for c in sorted(logs):
        unique.setdefault(tuple(logs[c]), c)
    want = {c: turns for turns, c in unique.items() if not any(len(o) > len(turns) and o[: len(turns)] == turns for o in unique)}
    whole: dict = {}
    for r in sorted(got, key=lambda r: r["part"]):
        whole[r["conv_id"]] = whole.get(r["conv_id"], "") + r["text"]
        assert r["n_turns"] == len(logs[r["conv_id"]])
    assert whole == {c: "".join(f"{chat.OPEN}user\n{t}{chat.CLOSE}\n" for _, t in turns) for c, turns in want.items()}


def test_gradients_are_those_of_the_loss():
    from poolgauge.llm import langid

    rng = np.random.default_rng(1)
    net = langid.train([(b"abc def", "a"), (b"xyz uvw", "b"), (b"123", "c")], epochs=1)
    for name in ("embedding", "out", "out_bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    net.filters, net.biases = [f.astype(np.float64) for f in net.filters], [b.astype(np.float64) for b in net.biases]
    x = rng.integers(1, langid.N_CLASSES, (5, langid.WINDOW)).astype(np.uint8)
    y = np.array([0, 1, 2, 1, 0])
    loss = lambda: -np.mean([brute.log_probabilities(net, row)[k] for row, k in zip(x, y, strict=True)])
    params = [net.embedding, *net.filters, *net.biases, net.out, net.out_bias]
    for p, g in zip(params, langid._gradients(net, x, y), strict=True):
        flat = np.flatnonzero(np.abs(g) > 1e-4)[:3]
        for at in flat.tolist():
            at = np.unravel_index(at, p.shape)
            kept, step = p[at], 1e-6
            p[at] = kept + step
            up = loss()
            p[at] = kept - step
            slope, p[at] = (up - loss()) / (2 * step), kept
            assert abs(slope - g[at]) < 1e-3 * max(1, abs(slope))


def test_sample_is_bounded_and_has_every_language(spark):
    from poolgauge.llm import langid

    rows = [(i, "the same text again and again", "aa") for i in range(500)] + [(1000 + i, f"text number {i} of this language", "bb") for i in range(400)] + [(2000 + k, f"one text of language {k}", f"l{k:03d}") for k in range(80)]
    got = langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=20, sample_texts=100, least_texts=5)
    import zlib

    learnable = {lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 != 2}
    count = {lang: sum(x == lang for _, x in got) for lang in learnable}
    assert count["aa"] == 1 and count["bb"] == 5 and all(n == 1 for lang, n in count.items() if lang[0] == "l") and len(count) > 50


def test_giant_and_repeated_items(spark):
    rng = random.Random(15)
    words = [f"g{rng.randrange(10**6)}" for _ in range(500)]
    items = [(1, " ".join(words))] * 3 + [(2, "short item")]
    docs = [(1, "before " + " ".join(words[95:140]) + " after"), (2, " ".join(words)), (3, "a short item here"), (4, "nothing of it")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one, many = (sorted(map(str, decontam.digest(d, b, block_words=w).collect())) for w in (10**6, 50))
    assert one == many
    assert {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in decontam.digest(d, b, block_words=50).collect()} == {1: (45, 1), 2: (500, 1), 3: (2, 1), 4: (0, 0)}
