import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).parent))

TABLES = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long, row string, th long, drop string, m string, fp long, doc string",
    "labels": "doc_id long, quality int, toxic int",
    "pages": "page_id long, url string, html string, digest string, payload string",
    "benchmark": "item_id long, text string, extra string",
    "conversations": "conv_id long, turn int, role string, text string, n string, block string",
}
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"
LONG = "\n".join(f"{WORDS} number {i} of a text that goes on" for i in range(150))
ITEM = "which planet of the inner system has the longest day of all they asked"
TEXTS = [None, "", " ", "\n\n", "short", WORDS, WORDS, WORDS + " x", LONG, "A shared line of text\nown one here\n  a SHARED line of text ", "a shared line of text\n\nsomething else", "Ünïcödé ÉÉ çà 😀 <|endoftext|> it's  two spaces\t\tend ", "before " + ITEM.upper() + " after " + WORDS, ITEM, "tiny item", "12345 !!! ---"]
ROWS = {
    "documents": [(i, t, "de" if i % 3 else None, "s", len(t or ""), "r", i, "d", "m", i, "x") for i, t in enumerate(TEXTS)] + [(3, "repeated row of words", "de", None, None, *[None] * 6)] * 2 + [(None, WORDS, None, None, None, *[None] * 6), (None, None, None, None, None, *[None] * 6)],
    "labels": [(0, 1, 0), (5, 1, None), (6, 0, 1), (6, 1, 1), (None, 1, 0), (8, None, None)],
    "pages": [(2, "http://a b", "<p>x</p>", "d", "p"), (1, None, "<p>x</p>", None, None), (1, None, "<p>x</p>", None, None), (3, "u", None, None, None), (4, "u", "", None, None), (5, "u", "é" * 50_000, None, None), (5, "u", "é" * 50_000, None, None), (None, "u", "<p>x</p>", None, None), (None, None, "alone", None, None)],
    "benchmark": [(1, ITEM, "e"), (2, "Tiny ITEM", None), (3, None, None), (4, "", None), (None, "kappa lambda", None), (5, ITEM, None)],
    "conversations": [(1, 0, "user", "hi", "n", "b"), (2, 0, "user", "hi", None, None), (2, 1, "assistant", "yes <|im_end|>", None, None), (3, 0, "user", "hi", None, None), (3, 1, "assistant", "yes <|im_end|>", None, None), (4, 0, None, "hi", None, None), (4, 0, None, "hi", None, None), (5, 1, "user", None, None, None), (5, None, "user", "z", None, None), (None, 0, "user", "lost", None, None), (None, 0, "user", "lost", None, None), (None, 0, "user", "hi", None, None), (None, 3, None, None, None, None)] + [(6, i, "user", f"t{i}", None, None) for i in range(600)] + [(7, i, "user", f"t{i}", None, None) for i in range(599)],
}


def _written(spark, folder, rows):
    for name, schema in TABLES.items():
        spark.createDataFrame(rows.get(name, []), schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def edge(spark, tmp_path_factory):
    """Tables with nulls, empty and long texts, ties, repeated rows and columns of clashing names."""
    return _written(spark, tmp_path_factory.mktemp("edge"), ROWS)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    return _written(spark, tmp_path_factory.mktemp("empty"), {})


@pytest.fixture(scope="session")
def edge_duck(edge):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{edge}/{t}.parquet/*.parquet'")
    return con
