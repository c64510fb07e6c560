"""Pages by cursor: where a page ends, the next begins, at the same cost however deep it lies.

An offset of n makes Spark bring n rows to one place to throw them away. A
cursor instead is the sort key of the last row shown: the next page is a
filter (rows behind that key) and the first rows of what is left, of which a
task keeps no more than a page. The filter is made of plain comparisons: where
the keys are stored columns it reaches the scan, and in files sorted by the key
whole row groups are skipped.

Sort keys may be null and may tie. Nulls come last in both directions. Rows
with equal keys are told apart by a hash of all their columns; rows equal in
everything are interchangeable, and the cursor counts how many of them were
shown. So pages are disjoint and together whole, if the rows stay as they are.

A cursor is a text, the same for equal rows. It holds sort keys as they are:
where a key is shown masked only, a service has to keep its cursors to itself.
"""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class CursorError(ValueError):
    """A text is not a cursor of this order."""


class Key(NamedTuple):
    """A sort key; nulls last in both directions."""

    column: Column
    descending: bool = False

    def order(self, name: str) -> Column:
        return F.col(name).desc_nulls_last() if self.descending else F.col(name).asc_nulls_last()


def _names(keys: list[Key]) -> list[str]:
    return [f"_key{i}" for i in range(len(keys))]


def _keyed(rows: DataFrame, keys: list[Key]) -> tuple[DataFrame, list[Key]]:
    """Rows with their sort keys beside them, the hash of all columns last."""
    keys = [*keys, Key(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]))]
    return rows.select("*", *[k.column.alias(n) for k, n in zip(keys, _names(keys), strict=True)]), keys


def _behind(name: str, value: Column, null: bool, descending: bool) -> Column:
    """Strictly behind a value in one key's order."""
    if null:
        return F.lit(False)
    key = F.col(name)
    return (key < value if descending else key > value) | key.isNull()


def parsed(cursor: str, types: list[str]) -> tuple[list[Column], list[bool], int]:
    """The key of a cursor as literals, which of them are null, and how many of its rows were shown."""
    try:
        given = json.loads(cursor)
        values, shown = given["keys"], given["shown"]
    except (TypeError, KeyError, ValueError) as e:
        raise CursorError("not a cursor") from e
    if not isinstance(values, list) or len(values) != len(types) or not all(v is None or isinstance(v, str) for v in values) or isinstance(shown, bool) or not isinstance(shown, int) or shown < 1:
        raise CursorError("not a cursor of this order")
    return [F.lit(v).try_cast(t) for v, t in zip(values, types, strict=True)], [v is None for v in values], shown


def page(rows: DataFrame, keys: list[Key], limit: int, after: str | None = None) -> DataFrame:
    """The first ``limit`` rows behind a cursor in the order of ``keys``, each with its own ``cursor``.

    The page goes on behind the cursor of its last row; a page with fewer rows
    than its limit is the last. Without a cursor it is the first page.
    """
    keyed, keys = _keyed(rows, keys)
    names = _names(keys)
    same, skipped = F.lit(False), 0
    if after is not None:
        values, nulls, skipped = parsed(after, [keyed.schema[n].dataType.simpleString() for n in names])
        same, later = F.lit(True), F.lit(False)
        for n, k, value, null in zip(names, keys, values, nulls, strict=True):
            later = later | (same & _behind(n, value, null, k.descending))
            same = same & (F.col(n).isNull() if null else F.col(n).eqNullSafe(value))
        keyed = keyed.where(later | same)
    order = [k.order(n) for k, n in zip(keys, names, strict=True)]
    # equal rows are first: those that were shown are skipped, and are as many as there are copies of one row
    found = keyed.orderBy(*order).offset(skipped).limit(limit)
    nth = F.row_number().over(Window.partitionBy(*names).orderBy(F.lit(0)))
    shown = nth + F.when(same, F.lit(skipped)).otherwise(F.lit(0))
    numbered = found.withColumn("_shown", shown.cast("int"))
    # keys as an array of texts, so that nulls keep their places
    cursor = F.to_json(F.struct(F.array(*[F.col(n).cast("string") for n in names]).alias("keys"), F.col("_shown").alias("shown")))
    return numbered.withColumn("cursor", cursor).orderBy(*order, "_shown").drop(*names, "_shown")


def last_cursor(shown: DataFrame, limit: int) -> str | None:
    """The cursor to go on from, or None behind the last page. Collects one page."""
    found = shown.select("cursor").collect()  # at most limit rows
    return found[-1]["cursor"] if len(found) == limit else None
