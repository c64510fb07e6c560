"""Line dedup across documents (DataFrame functions only).

Lines are exploded, normalised and hashed; a hash found in at least
``min_docs`` distinct documents loses its lines everywhere but in the
document with the smallest doc_id that holds it; documents are reassembled by
line position.

Scale: only (hash, doc_id, position) rows, checkpointed because two jobs read
them, are shuffled by hash, and they are pre-aggregated on the map side. The table of repeated hashes is checkpointed,
so the join that finds the lines to drop is a plain two-sided join whose hot
keys (a licence line in a third of all documents) adaptive execution splits.
Texts are shuffled once, by document, to meet their own dropped positions.

Defined cases: a null or empty text is one empty line; a line's key is the
line without ASCII white space at its ends, A-Z lower-cased; keys shorter than
``min_chars`` code points never drop. Rows that repeat a doc_id are one
document for counting and are each reassembled. All rows without a doc_id
count as one document, which comes after all others. Keys are compared by 128
bits of hash. Empty tables give empty results; other columns pass unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolgauge.llm.common import ASCII_SPACE, ascii_lower, cut, packed, text_key

MIN_CHARS = 10
MIN_DOCS = 2


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    lines = docs.select("doc_id", text_key(F.col("text")).alias("th"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    bare = F.btrim("line", F.lit(ASCII_SPACE))
    key = ascii_lower(bare)
    return lines.where(F.length(bare) >= min_chars).select("doc_id", "th", "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2"))


def repeated_keys(occurrences: DataFrame, min_docs: int) -> DataFrame:
    """(h1, h2, first): hashes in at least ``min_docs`` documents and the smallest of those doc_ids."""
    by = occurrences.groupBy("h1", "h2")
    first, orphan = F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull().cast("int"))
    if min_docs == 2:  # two different ids, or an id and none: no distinct count is needed
        found = by.agg(first, F.max("doc_id").alias("last"), orphan.alias("orphan"))
        n = F.when(F.col("first").isNull(), 0).when(F.col("first") < F.col("last"), 2).otherwise(1) + F.col("orphan")
        return found.where(n >= 2).select("h1", "h2", "first")
    found = occurrences.groupBy("h1", "h2", "doc_id").count().groupBy("h1", "h2").agg(first, F.count("*").alias("n"))
    return found.where(F.col("n") >= min_docs).select("h1", "h2", "first")


def _reassembled(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """Struct ``row``, and ``lines`` and the ascending ``kept`` positions of each row."""
    occurrences = cut(_occurrences(docs, min_chars))
    repeated = cut(repeated_keys(occurrences, min_docs))
    dropped = (
        occurrences.join(repeated, ["h1", "h2"])
        .where(~F.col("doc_id").eqNullSafe(F.col("first")))
        .groupBy(F.col("doc_id").alias("drop_id"), F.col("th").alias("drop_th"))
        .agg(F.collect_set("pos").alias("drop"))
    )
    rows = packed(docs, doc_id=F.col("doc_id"), th=text_key(F.col("text")), lines=_lines(F.col("text")))
    met = rows.join(dropped, F.col("doc_id").eqNullSafe(F.col("drop_id")) & (F.col("th") == F.col("drop_th")), "left")
    every = F.sequence(F.lit(0), F.size("lines") - 1)
    return met.select("row", "doc_id", "lines", F.when(F.col("drop").isNull(), every).otherwise(F.array_except(every, F.col("drop"))).alias("kept"), F.col("drop").isNull().alias("whole"))


def _joined() -> Column:
    lines, kept = F.col("lines"), F.col("kept")
    return F.when(F.col("whole"), F.array_join(lines, "\n")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))


def digest(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the kept text of every row."""
    rows = _reassembled(docs.select("doc_id", "text"), min_chars, min_docs)
    n = F.size("lines").cast("long")
    return rows.select("doc_id", n.alias("n_lines"), (n - F.size("kept")).cast("long").alias("n_dropped"), F.sha2(_joined(), 256).alias("kept_sha256"))


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with repeated lines gone from ``text``; a null text stays null, no row is lost."""
    rows = _reassembled(docs, min_chars, min_docs)
    text = F.when(F.col("row.text").isNull() | F.col("whole"), F.col("row.text")).otherwise(_joined())
    return rows.select(*[(text.alias(c) if c == "text" else F.col("row")[c].alias(c)) for c in docs.columns])
