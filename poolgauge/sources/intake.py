"""Archive members stored as partitions, and stored partitions read back, column by column in the tasks.

A foundation has about a hundred columns, most of them empty. A row of them is
about a kilobyte in the JVM, and is copied there by every operator; in Arrow
an empty column costs next to nothing. So tasks here get runs of members or of
partition folders, convert them a block of lines or a row group at a time,
and hand on to Spark what has to be counted: a row's values as one text, which
of them are null, and the fields that may break a rule. Spark hashes, counts
and compares.
"""

from __future__ import annotations

import hashlib
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from poolgauge.functions.layout import FIELD_NAMES, LINEAGE, WIDTHS
from poolgauge.operators.masking import TOKENS
from poolgauge.shipping import ship_code
from poolgauge.sources import archive
from poolgauge.storage import joined, located, names, write_whole

#: What stands between a row's values in its text, and how many columns' nulls one number tells.
BETWEEN, ESCAPE, MARKS = "\x1f", "\x1e", 62
#: Columns of a partition's file, and in the order in which rows are hashed.
STORED = tuple(c for c in (*LINEAGE, *FIELD_NAMES) if c != "deal_id")
HASHED = tuple(sorted(STORED))
SCHEMA = pa.schema([(c, pa.int16() if c == "source_field_count" else pa.string()) for c in STORED])
#: Fields that rules of rows look at.
RULED = ("period", "reference_pool_number", "loan_identifier", "current_actual_upb", "current_loan_delinquency_status")
_PLAIN_STATUS = pa.array([f"{n:02}" for n in range(100)] + ["RA", "XX"])
#: The one file of a partition.
FILE = "part-00000.zstd.parquet"


def values_and_nulls(columns: list[str]) -> list[Column]:
    """A row's values in one text, and numbers that tell which are null.

    A row with a value that holds :data:`BETWEEN` has more of it than values to
    part: its values are escaped, and a bit tells.
    """
    null = [F.when(F.isnull(c), F.lit(1 << (k % MARKS))).otherwise(F.lit(0)).cast("long") for k, c in enumerate(columns)]
    marks = []
    for k in range(0, len(null), MARKS):
        mark = null[k]
        for n in null[k + 1 : k + MARKS]:
            mark = mark.bitwiseOR(n)
        marks.append(mark)
    values = [F.col(c).cast("string") for c in columns]
    text, there = F.concat_ws(BETWEEN, F.lit(""), *values), F.lit(0)
    for c in columns:
        there = there + F.isnotnull(c).cast("int")
    loose = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(BETWEEN), F.lit(""))) != there
    escaped = [F.replace(F.replace(v, F.lit(ESCAPE), F.lit(ESCAPE * 2)), F.lit(BETWEEN), F.lit(ESCAPE + "u")) for v in values]
    marks[0] = F.when(loose, marks[0].bitwiseOR(F.lit(1 << MARKS))).otherwise(marks[0])
    return [F.when(loose, F.concat_ws(BETWEEN, F.lit(""), *escaped)).otherwise(text), *marks]


def _values_and_nulls(columns: list[pa.Array]) -> list[pa.Array]:
    """:func:`values_and_nulls` of Arrow columns."""
    n, marks, kept = len(columns[0]), [], []
    there = np.zeros(n, np.int64)
    for k, column in enumerate(columns):
        if k % MARKS == 0:
            marks.append(np.zeros(n, np.int64))
        if column.null_count == n:
            marks[-1] |= 1 << (k % MARKS)
            continue
        there += 1
        if column.null_count:
            null = pc.is_null(column).to_numpy(zero_copy_only=False).astype(np.int64)
            marks[-1] |= null << (k % MARKS)
            there -= null
        kept.append(column.cast(pa.string()))
    if not kept:
        return [pa.repeat(pa.scalar(""), n), *map(pa.array, marks)]
    # an empty first value, as rows of nothing but nulls are left out of a join
    text = pc.binary_join_element_wise("", *kept, BETWEEN, null_handling="skip")
    loose = pc.count_substring(text, BETWEEN).to_numpy(zero_copy_only=False) != there
    if loose.any():
        escaped = [pc.replace_substring(pc.replace_substring(c, ESCAPE, ESCAPE * 2), BETWEEN, ESCAPE + "u") for c in kept]
        text = pc.if_else(pa.array(loose), pc.binary_join_element_wise("", *escaped, BETWEEN, null_handling="skip"), text)
        marks[0][loose] |= 1 << MARKS
    return [text, *map(pa.array, marks)]


_MARKED = [f"nulls_{k}" for k in range(-(-len(HASHED) // MARKS))]
#: What tasks hand on of a row: the number of its partition, what is hashed, and what the rules look at.
OFFERED = "part int, width_accepted boolean, member_period string, " + ", ".join(f"{c} string" for c in RULED) + ", ordered boolean, text string, " + ", ".join(f"{c} long" for c in _MARKED)
BACK = "part int, source_member string, source_field_count short, text string, " + ", ".join(f"{c} long" for c in _MARKED)


def _batch(columns: list[pa.Array], schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])


def _suspects(fields: dict[str, pa.Array], accepted: bool, period: str) -> pa.Array:
    """Rows that may break one of :func:`archive.row_rules`; all others surely keep them."""
    blank = lambda c: pc.fill_null(pc.equal(pc.utf8_trim(fields[c], " "), ""), True)
    found = pc.or_(blank("reference_pool_number"), blank("loan_identifier"))
    found = pc.or_(found, pc.fill_null(pc.not_equal(fields["period"], period), True))
    found = pc.or_(found, pc.fill_null(pc.match_substring(fields["current_actual_upb"], "-"), False))
    return pc.or_(pc.or_(found, pc.invert(pc.is_in(fields["current_loan_delinquency_status"], _PLAIN_STATUS))), pa.scalar(not accepted))


class _File:
    """A partition's Parquet file, written beside in the task and moved to its place when whole: a task that runs again replaces it."""

    def __enter__(self) -> _File:
        self.beside = tempfile.NamedTemporaryFile(suffix=".parquet")
        self.made = pq.ParquetWriter(self.beside.name, SCHEMA, compression="zstd")
        self.held, self.rows = [], 0
        return self

    def write(self, batch: pa.RecordBatch) -> None:
        self.held.append(batch)
        self.rows += batch.num_rows
        if self.rows >= archive.ROW_GROUP_ROWS:
            self.flush()

    def flush(self) -> None:
        if self.rows:
            self.made.write_table(pa.Table.from_batches(self.held, SCHEMA), row_group_size=archive.ROW_GROUP_ROWS)
        self.held, self.rows = [], 0

    def move(self, uri: str) -> None:
        self.flush()
        self.made.close()
        with open(self.beside.name, "rb") as whole:
            write_whole(uri, whole)

    def __exit__(self, *error) -> None:
        if self.made.is_open:
            self.made.close()
        self.beside.close()


def _store(part: int, uri: str, member: str, period: str, target: str) -> Iterator[pa.RecordBatch]:
    """Store a member whose loans are in order, in a stream; of one that is not, rows are only handed on."""
    ordered, last = True, None
    with archive._open(uri) as raw, zipfile.ZipFile(raw) as z, z.open(member) as lines, _File() as made:
        for widths, columns in archive.tabled(lines):
            n, fields = len(widths), dict(zip(FIELD_NAMES, columns))
            fields |= {"source_member": pa.repeat(pa.scalar(member), n), "source_field_count": widths.cast(pa.int16())}
            loans = fields["loan_identifier"]
            if ordered:
                # strictly, so that no loan of an ordered member is there twice
                ordered = not loans.null_count and pc.all(pc.less(loans[:-1], loans[1:]), min_count=0).as_py() and (last is None or n == 0 or last < loans[0].as_py().encode())
                last = loans[-1].as_py().encode() if ordered and n else last
            if ordered:
                made.write(pa.RecordBatch.from_arrays([fields[c] for c in STORED], schema=SCHEMA))
            accepted = pc.is_in(widths, pa.array(WIDTHS, pa.int32()))
            all_accepted = pc.all(accepted, min_count=0).as_py()
            suspect = _suspects(fields, all_accepted, period)
            shown = [pc.if_else(suspect, fields[c], pa.scalar(None, pa.string())) for c in RULED] if pc.any(suspect).as_py() else [pa.nulls(n, pa.string())] * len(RULED)
            told = pa.repeat(pa.scalar(period), n) if pc.any(suspect).as_py() else pa.nulls(n, pa.string())
            told = pc.if_else(suspect, told, pa.scalar(None, pa.string()))
            yield _batch([pa.repeat(pa.scalar(part, pa.int32()), n), accepted, told, *shown, pa.repeat(pa.scalar(bool(ordered)), n), *_values_and_nulls([fields[c] for c in HASHED])], OFFERED)
        if ordered and last is not None:
            made.move(joined(target, FILE))


def _over(spark: SparkSession, parts: list[tuple], schema: str, out: str, run: Callable) -> DataFrame:
    """Work listed by a driver, dealt to tasks: rows of a list of folders or members."""
    ship_code(spark)
    tasks = max(1, min(len(parts), max(archive.PARTITIONS, archive._shuffles(spark))))
    listed = spark.createDataFrame(parts, schema).repartition(tasks)

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                yield from run(*row)

    return listed.mapInArrow(each, out)


def store(spark: SparkSession, members: list[tuple[str, str, str, str]], root: str) -> DataFrame:
    """Store members (archive, member, deal, period) below a root; rows of :data:`OFFERED`, whose reading does it.

    ``part`` is a member's place in the list. A member whose loans are not in
    order is not stored: its rows have ``ordered`` false at last.
    """
    parts = [(k, uri, m, p, joined(root, *folder(d, p))) for k, (uri, m, d, p) in enumerate(members)]
    return _over(spark, parts, "part int, uri string, member string, period string, target string", OFFERED, _store)


def folder(deal: str, period: str) -> tuple[str, str]:
    return f"deal_id={deal}", f"reporting_period={period}"


def _back(part: int, uri: str) -> Iterator[pa.RecordBatch]:
    system, path = located(uri)
    for name in names(uri):
        if name.startswith((".", "_")):
            continue
        with system.open_input_file(joined(path, name)) as raw:
            file = pq.ParquetFile(raw)
            have = set(file.schema_arrow.names)
            for batch in file.iter_batches(1 << 14, columns=[c for c in HASHED if c in have], use_threads=False):
                n = batch.num_rows
                column = lambda c: batch.column(c).cast(SCHEMA.field(c).type) if c in have else pa.nulls(n, SCHEMA.field(c).type)  # noqa: B023, E731
                yield _batch([pa.repeat(pa.scalar(part, pa.int32()), n), column("source_member"), column("source_field_count"), *_values_and_nulls([column(c) for c in HASHED])], BACK)


def back(spark: SparkSession, folders: list[str]) -> DataFrame:
    """Rows of :data:`BACK` of stored partitions, by their place in the list."""
    return _over(spark, list(enumerate(folders)), "part int, uri string", BACK, _back)


def row_hash(columns: list[str], seed: str) -> Column:
    """A hash of a row's values that tells nulls, empty values and columns apart."""
    return F.xxhash64(F.lit(seed), *values_and_nulls(columns))


def text_hash(seed: str) -> Column:
    """:func:`row_hash` of a row whose text and nulls a task made."""
    return F.xxhash64(F.lit(seed), "text", *_MARKED)


#: Rows of a partition that a task masks and sorts in its memory, about half a gigabyte; Spark's writer does it with larger ones.
MASKED_ROWS = 1 << 20


def _tokens(column: pa.Array, key: str, prefix: str, digits: int) -> pa.Array:
    """:func:`poolgauge.functions.columns.token` of each different value."""
    coded, keyed = column.dictionary_encode(), hashlib.sha256(f"{key}:".encode())

    def of(value: str) -> str | None:
        if not value:
            return None
        own = keyed.copy()
        own.update(value.encode())
        return prefix + own.hexdigest()[:digits]

    return pa.array([of(v) for v in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)


def masked(spark: SparkSession, folders: list[tuple[str, str]], key: str, most: int = MASKED_ROWS) -> DataFrame:
    """Write stored partitions (folder, target) masked and in the order of their tokens: part and records, null for those of more than ``most`` rows, which are not written."""

    def run(part: int, uri: str, target: str) -> Iterator[pa.RecordBatch]:
        system, path = located(uri)
        found = [joined(path, n) for n in names(uri) if not n.startswith((".", "_"))]
        records = sum(pq.read_metadata(f, filesystem=system).num_rows for f in found)
        if records and records <= most:
            read = [pq.ParquetFile(f, filesystem=system).read(use_threads=False) for f in found]
            whole = pa.concat_tables([t.select([c for c in STORED if c in t.column_names and t.column(c).null_count < len(t)]) for t in read], promote_options="default")
            for name, (prefix, digits) in TOKENS.items():
                if name in whole.column_names:
                    whole = whole.set_column(whole.column_names.index(name), name, _tokens(whole.column(name).combine_chunks(), key, prefix, digits))
            order = pc.sort_indices(whole, [("loan_identifier", "ascending")], null_placement="at_start") if "loan_identifier" in whole.column_names else None
            with _File() as made:
                for at in range(0, records, archive.ROW_GROUP_ROWS):
                    some = whole.slice(at, archive.ROW_GROUP_ROWS) if order is None else whole.take(order.slice(at, archive.ROW_GROUP_ROWS))
                    column = lambda c: some.column(c).combine_chunks().cast(SCHEMA.field(c).type) if c in some.column_names else pa.nulls(len(some), SCHEMA.field(c).type)  # noqa: B023, E731
                    made.write(pa.RecordBatch.from_arrays([column(c) for c in STORED], schema=SCHEMA))
                made.move(joined(target, FILE))
        yield _batch([pa.array([part], pa.int32()), pa.array([records if records <= most else None], pa.int64())], "part int, records long")

    return _over(spark, [(k, *f) for k, f in enumerate(folders)], "part int, uri string, target string", "part int, records long", run)
