"""The eleven queries against SQL or brute force, on generated tables, edge cases and empty tables."""

import brute
import corpus_pipeline
import pytest
from oracle_compare import DATA, differing

from poolgauge.llm import oracle
from poolgauge.llm.common import table
from poolgauge.llm.queries import QUERIES

ALL = {**QUERIES, "pipeline": corpus_pipeline.run}


def listed(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def rows_of(spark, sf, name, *columns):
    return [tuple(r) for r in table(spark, sf, name).select(*columns).collect()]


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_equals_its_sql(spark, duck, name):
    assert differing(spark, duck, QUERIES[name], oracle.SQL[name]) == []


@pytest.mark.parametrize("name", ["op1_chat_format", "op9_quality", "op10_decontaminate"])
def test_equals_its_sql_on_edge_cases(spark, edge_duck, edge, name):
    assert differing(spark, edge_duck, QUERIES[name], oracle.SQL[name], edge) == []


@pytest.mark.parametrize("name", sorted(ALL))
def test_empty_tables(spark, empty, name):
    assert ALL[name](spark, empty).collect() == []


@pytest.mark.parametrize("sf", ["data", "edge"])
def test_line_dedup(spark, edge, sf):
    sf = DATA if sf == "data" else edge
    import hashlib

    want = [(d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()) for d, lines, kept in brute.line_dedup(rows_of(spark, sf, "documents", "doc_id", "text"))]
    assert listed(QUERIES["op8_line_dedup"](spark, sf), "doc_id", "n_lines", "n_dropped", "kept_sha256") == sorted(want, key=str)


@pytest.mark.parametrize("sf", ["data", "edge"])
def test_simhash(spark, edge, sf):
    sf = DATA if sf == "data" else edge
    rows = rows_of(spark, sf, "documents", "doc_id", "text")
    prints = [brute.simhash(t) for _, t in rows]
    want = [(d, f"{p:016x}", c) for (d, _), p, c in zip(rows, prints, brute.components(prints, [d for d, _ in rows]), strict=True)]
    assert listed(QUERIES["op5_simhash"](spark, sf), "doc_id", "fingerprint", "component_id") == sorted(want, key=str)


@pytest.mark.parametrize("sf", ["data", "edge"])
def test_bpe(spark, edge, sf):
    sf = DATA if sf == "data" else edge
    want = brute.bpe(rows_of(spark, sf, "documents", "doc_id", "text"))
    assert listed(QUERIES["op6_bpe"](spark, sf), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=str)


def test_token_files(spark):
    want = brute.token_file(rows_of(spark, DATA, "documents", "doc_id", "text"))
    assert listed(QUERIES["op3_wavelet"](spark, DATA), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=str)


def test_token_files_on_edge_cases(spark, edge):
    rows = rows_of(spark, edge, "documents", "doc_id", "text")
    found = sorted(QUERIES["op3_wavelet"](spark, edge).collect(), key=lambda r: r["start"])
    assert [r["start"] for r in found] == [sum(r["n_tokens"] for r in found[:i]) for i in range(len(found))]
    want = brute.token_file([(d if d is not None else -1, t or "") for d, t in rows])
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found) == sorted((d, n, c) for d, _, n, c in want)


@pytest.mark.parametrize("sf", ["data", "edge"])
def test_warc(spark, edge, sf):
    sf = DATA if sf == "data" else edge
    want = brute.pages(rows_of(spark, sf, "pages", "page_id", "html"))
    assert listed(QUERIES["op7_warc"](spark, sf), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want, key=str)


def test_language_id(spark):
    found = QUERIES["op2_language_id"](spark, DATA).join(table(spark, DATA, "documents").select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in found if r["held_out"] and r["lang"] is not None and r["lang_pred"] != "und"]
    assert len(found) == table(spark, DATA, "documents").count()
    assert all(0 <= r["score"] <= 1 for r in found)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.9 * len(held)


def test_language_id_on_edge_cases(spark, edge):
    found = {r["doc_id"]: r for r in QUERIES["op2_language_id"](spark, edge).collect() if r["doc_id"] not in (None, 3)}
    assert all(found[i]["lang_pred"] == "und" for i in (0, 1, 2, 15))
    assert found[8]["lang_pred"] == "de"


def test_language_id_equals_plain_convolutions(spark):
    """Every row of the query against the network's layers written out, on the same trained network."""
    from poolgauge.llm import langid

    docs = table(spark, DATA, "documents")
    net = langid.train(langid.sample(docs))
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()[:60]
    got = {r["doc_id"]: r for r in langid.predict(docs, net).collect()}
    for r in rows:
        lang, score = brute.language(net, r["text"])
        assert got[r["doc_id"]]["lang_pred"] == lang
        assert abs(got[r["doc_id"]]["score"] - score) < 1e-3


@pytest.mark.parametrize("sf", ["data", "edge"])
def test_pseudonyms(spark, edge, sf):
    """The whole query: gaps between the values it reports are as they were, values are those of plain code."""
    from poolgauge.llm import pii
    from poolgauge.llm.queries import PII_KEY

    sf = DATA if sf == "data" else edge
    want = [(d, *brute.pseudonymised(t, PII_KEY, pii)) for d, t in rows_of(spark, sf, "documents", "doc_id", "text")]
    assert listed(QUERIES["op4_pii"](spark, sf), "doc_id", "text", *[f"n_{k}" for k in pii.KINDS]) == sorted(want, key=str)


def test_pipeline(spark, duck, edge, edge_duck):
    for sf, con in ((DATA, duck), (edge, edge_duck)):
        good = {(r[0], r[1]) for r in con.execute(f"SELECT doc_id, n_words FROM ({oracle.OP9}) WHERE kept").fetchall()}
        import re

        docs = [(d, t) for d, t in rows_of(spark, sf, "documents", "doc_id", "text") if (d, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) in good]
        docs = [(d, "\n".join(kept)) for d, _, kept in brute.line_dedup(docs)]
        # the stage links five-word shingle sets at a similarity of 0.8; op5's four bits bind its own query only
        least = brute.near_copies([t for _, t in docs], [d for d, _ in docs])
        docs = [x for x, c in zip(docs, least, strict=True) if c == x[0]]
        items = rows_of(spark, sf, "benchmark", "item_id", "text")
        docs = [(d, t) for d, t in ((d, brute.cleaned(t, items)) for d, t in docs) if t is not ...]
        assert listed(corpus_pipeline.run(spark, sf), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(brute.bpe(docs), key=str)


def test_stages_keep_the_columns(spark, edge):
    docs = table(spark, edge, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, edge).columns == docs.columns


def test_very_long_text(spark, tmp_path):
    """200,000 words in one text; every part of the work stays linear."""
    text = "\n".join(f"line {i} " + " ".join(f"w{i}x{k}" for k in range(18)) for i in range(10_000)) + "\nthe end of it all"
    spark.createDataFrame([(1, text, "de"), (2, "the end of it all", None)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "the end of it all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    first = lambda name: next(r for r in ALL[name](spark, str(tmp_path)).collect() if r["doc_id"] == 1)
    assert (first("op9_quality")["n_words"], first("op9_quality")["n_repeat_words"]) == (200_005, 0)
    assert first("op10_decontaminate")["n_hit"] == 5
    assert (first("op8_line_dedup")["n_lines"], first("op8_line_dedup")["n_dropped"]) == (10_001, 0)
    assert first("op6_bpe")["n_tokens"] > 200_000


def test_quality_cutoffs_are_reached(spark, tmp_path):
    """300 good and 60 bad labels a language: the ladder finds cutoffs, keeps all but few good texts, and equals its SQL; 200 are too few."""
    import random

    import duckdb

    from poolgauge.llm import quality

    rng = random.Random(5)
    words = [f"word{i}" for i in range(400)]
    docs, labels = [], []
    for lang, goods in (("en", 300), ("de", 300), ("fr", 200)):
        for i in range(goods + 60):
            bad = i >= goods
            text = [rng.choice(words) for _ in range(60)]
            text += ["#$" * rng.randint(5, 20)] if bad and i % 2 else ["SHOUTED " + "LOUD" * rng.randint(5, 20)] if bad else ["#"] * (rng.random() < 0.1)
            docs.append((len(docs), " ".join(text), lang))
            labels.append((len(labels), 0 if bad else 1))
    spark.createDataFrame(docs, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert differing(spark, con, QUERIES["op9_quality"], oracle.OP9, str(tmp_path)) == []
    measured = quality.scored(table(spark, str(tmp_path), "documents"), "doc_id")
    assert {r["stratum"] for r in quality.cutoffs(measured, table(spark, str(tmp_path), "labels")).collect()} == {"en", "de"}
    lost: dict = {}
    for r in QUERIES["op9_quality"](spark, str(tmp_path)).collect():
        key = (docs[r["doc_id"]][2], labels[r["doc_id"]][1])
        lost[key] = lost.get(key, 0) + (not r["kept"])
    assert lost["en", 0] > 30 and lost["de", 0] > 30 and lost["en", 1] <= 6 and lost["de", 1] <= 6 and not lost["fr", 0] and not lost["fr", 1]
