"""Disclosure archives: ZIP files of headerless, ragged, pipe-delimited members.

``disclosure_zip`` is a Python data source over one archive or a folder of
them. An input partition is a run of members of about ``partition_bytes``,
read as a stream in the executor that owns it; a ZIP cannot be split within a
member, so parallelism ends at the number of members (deals times months). The
path is read by tasks with pyarrow's file systems, so it is a path or URI that
every executor reaches. Its schema is :data:`LINE_SCHEMA`, a list of fields per
line, or :data:`INTAKE_SCHEMA`, a column for each of the layout's fields, which
Arrow's CSV reader makes at an eighth of the cost, with their lineage.

``write_archives`` goes the other way: archives of a foundation, one per deal
and year, each written by one task, members streamed into it in order.
"""

from __future__ import annotations

import codecs
import csv
import io
import json
import re
import tempfile
import zipfile
from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pcsv
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

from poolgauge.functions.layout import FIELD_NAMES, LINEAGE, WIDTHS
from poolgauge.operators.control import GateError, gate
from poolgauge.shipping import ship_code
from poolgauge.storage import cut, joined, located, names, write_whole

#: Member names: two digits of year, series, number; underscore; as-of date; suffix.
MEMBER = r"^(\d{2})([A-Z]+\d+)_(\d{8})_lld\.txt$"
LINE_SCHEMA = "member string, line_no long, width int, fields array<string>"
INTAKE_SCHEMA = "deal_id string, source_member string, source_field_count short, " + ", ".join(f"{n} string" for n in FIELD_NAMES) + ", width_accepted boolean, member_period string"


def _open(uri: str):
    system, path = located(uri)
    return system.open_input_file(path)


def archives(path: str) -> list[str]:
    """The archives that a path names: itself, or those right below it."""
    return [path] if path.endswith(".zip") else [joined(path, n) for n in names(path) if n.endswith(".zip")]


def directory(path: str) -> list[tuple[str, str, int, int]]:
    """(archive, member, crc32, bytes) of all members; only the directories are read."""
    out = []
    for uri in archives(path):
        with _open(uri) as raw, zipfile.ZipFile(raw) as z:
            out += [(uri, i.filename, i.CRC, i.file_size) for i in z.infolist() if not i.is_dir()]
    return out


#: Bytes of members that one task reads; a larger member has a task of its own. Small deliveries are dealt to so many tasks.
PARTITION_BYTES, PARTITIONS = 32 << 20, 64


#: Bytes of a member that are split into lines and fields at once.
BLOCK_BYTES = 1 << 20


def _split(text: bytes) -> pa.ListArray:
    """Fields of whole lines without quotes, carriage returns or blank lines; empty ones are null."""
    rows = pc.split_pattern(pa.array([text.decode("utf-8").removesuffix("\n")]), "\n").flatten()
    fields = pc.split_pattern(rows, "|")
    values = fields.flatten()
    return pa.ListArray.from_arrays(fields.offsets, pc.replace_with_mask(values, pc.equal(values, ""), pa.scalar(None, pa.string())))


def _blocks(member: BinaryIO, block: int) -> Iterator[bytes | pa.ListArray]:
    """A member in order: blocks of whole lines that a split at line ends and bars reads, and fields of all other lines.

    A block with a quote, a carriage return or a blank line goes through
    ``csv.reader``, with as much of the next as its last field runs on into.
    """
    carry, pending = b"", deque()

    def whole_lines() -> bytes:
        nonlocal carry
        held = [carry]
        while part := member.read(block):
            end = part.rfind(b"\n") + 1
            if end:
                carry = part[end:]
                return b"".join([*held, part[:end]])
            held.append(part)
        carry = b""
        return b"".join(held)

    def lines_on() -> Iterator[str]:
        while pending or (more := whole_lines()):
            if not pending:
                pending.extend(io.StringIO(more.decode("utf-8"), newline=""))
            yield pending.popleft()

    rows = csv.reader(lines_on(), delimiter="|")
    while text := whole_lines():
        if not any(c in text for c in (b'"', b"\r", b"\n\n")) and not text.startswith(b"\n"):
            yield text
            continue
        pending.extend(io.StringIO(text.decode("utf-8"), newline=""))
        found = []
        while pending:
            found.append([v if v != "" else None for v in next(rows)])
            if len(found) == 1 << 13:
                yield pa.array(found, pa.list_(pa.string()))
                found = []
        yield pa.array(found, pa.list_(pa.string()))


def parsed(member: BinaryIO, block: int = BLOCK_BYTES) -> Iterator[pa.ListArray]:
    """Fields of a member's lines as ``csv.reader`` has them, in order; most blocks are split by Arrow."""
    for part in _blocks(member, block):
        yield _split(part) if isinstance(part, bytes) else part


def _spread(fields: pa.ListArray) -> tuple[pa.Array, list[pa.Array]]:
    """Widths of lines, and their fields by position, nulls where a line is shorter."""
    widths, starts, values = pc.list_value_length(fields), fields.offsets[:-1], fields.values
    return widths, [values.take(pc.if_else(pc.greater(widths, i), pc.add(starts, i), None)) for i in range(len(FIELD_NAMES))]


def _columns(text: bytes) -> tuple[pa.Array, list[pa.Array]]:
    """:func:`_spread` of a block that :func:`_split` reads; one whose lines are all of one width is read by Arrow's CSV reader."""
    width = text.split(b"\n", 1)[0].count(b"|") + 1
    named = [str(i) for i in range(width)]
    try:
        if text.startswith(codecs.BOM_UTF8):  # a field's text here, which the CSV reader would drop
            return _spread(_split(text))
        found = pcsv.read_csv(
            pa.BufferReader(text),
            pcsv.ReadOptions(use_threads=False, block_size=len(text) + 1, column_names=named),
            pcsv.ParseOptions(delimiter="|", quote_char=False),
            pcsv.ConvertOptions(column_types=dict.fromkeys(named, pa.string()), include_columns=named[: len(FIELD_NAMES)], strings_can_be_null=True, null_values=[""]),
        )
    except pa.ArrowInvalid:  # lines of several widths, or no UTF-8, of which the other tells
        return _spread(_split(text))
    columns = [c.combine_chunks() for c in found.columns]
    return pa.repeat(pa.scalar(width, pa.int32()), len(found)), columns + [pa.nulls(len(found), pa.string())] * (len(FIELD_NAMES) - len(columns))


def tabled(member: BinaryIO, block: int = BLOCK_BYTES) -> Iterator[tuple[pa.Array, list[pa.Array]]]:
    """What :func:`parsed` gives as widths and a column for each field of the layout."""
    for part in _blocks(member, block):
        yield _columns(part) if isinstance(part, bytes) else _spread(part)


class _Members(InputPartition):
    def __init__(self, members: list[tuple[str, str]]):
        self.members = members


class _Reader(DataSourceReader):
    def __init__(self, options, by_column: bool = False):
        self.path, self.by_column = options["path"], by_column
        #: members to read, by name: deal and period
        self.only = {m: keys for m, *keys in json.loads(options.get("members", "[]"))}
        self.most = options.get("partition_bytes")

    def partitions(self) -> list[InputPartition]:
        out, held, size = [], [], 0
        members = [m for m in directory(self.path) if not self.only or m[1] in self.only]
        most = int(self.most or min(PARTITION_BYTES, sum(m[3] for m in members) // PARTITIONS))
        for uri, name, _, n in members:
            if held and size + n > most:
                out.append(_Members(held))
                held, size = [], 0
            held.append((uri, name))
            size += n
        return [*out, _Members(held)]

    def read(self, partition: _Members) -> Iterator[pa.RecordBatch]:
        for uri, name in partition.members:
            with _open(uri) as raw, zipfile.ZipFile(raw) as z, z.open(name) as member:
                yield from self._intake(name, member) if self.by_column else self._lines(name, member)

    def _lines(self, name: str, member: BinaryIO) -> Iterator[pa.RecordBatch]:
        before = 0
        for fields in parsed(member):
            n = len(fields)
            columns = [pa.repeat(pa.scalar(name), n), pa.array(np.arange(before + 1, before + n + 1)), pc.list_value_length(fields), fields]
            yield pa.RecordBatch.from_arrays(columns, names=["member", "line_no", "width", "fields"])
            before += n

    def _intake(self, name: str, member: BinaryIO) -> Iterator[pa.RecordBatch]:
        deal, period = (pa.scalar(v, pa.string()) for v in self.only.get(name, (None, None)))
        for widths, fields in tabled(member):
            n = len(widths)
            columns = [pa.repeat(deal, n), pa.repeat(pa.scalar(name), n), widths.cast(pa.int16()), *fields, pc.is_in(widths, pa.array(WIDTHS, pa.int32())), pa.repeat(period, n)]
            yield pa.RecordBatch.from_arrays(columns, names=[*LINEAGE, *FIELD_NAMES, "width_accepted", "member_period"])


class DisclosureZip(DataSource):
    """``spark.read.format("disclosure_zip").load(path)``; option ``members``: a JSON list of what to read, each a name, its deal and its period."""

    @classmethod
    def name(cls) -> str:
        return "disclosure_zip"

    def schema(self) -> str:
        return LINE_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, by_column="fields" not in schema.names)


def lines(spark: SparkSession, path: str, members: list[tuple[str, ...]] | None = None, schema: str = LINE_SCHEMA) -> DataFrame:
    """Lines of an archive's members: member, line_no, width and fields; with :data:`INTAKE_SCHEMA` foundation rows of members (name, deal, period)."""
    ship_code(spark)
    spark.dataSource.register(DisclosureZip)
    reader = spark.read.format("disclosure_zip").schema(schema)
    return (reader.option("members", json.dumps(members)) if members else reader).load(path)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """The archive's directory: member, crc32, bytes, deal_id and reporting_period (null for names of another form).

    Only the directory is read, on the driver: a few hundred bytes per member.
    """
    members = spark.createDataFrame([row[1:] for row in directory(path)], "member string, crc32 long, bytes long")
    base = F.regexp_replace("member", r"^.*/", "")
    year, series, as_of = (F.regexp_extract(base, MEMBER, k) for k in (1, 2, 3))
    standard = base.rlike(MEMBER)
    return members.select("*", F.when(standard, F.concat(F.lit("20"), year, F.lit("-"), series)).alias("deal_id"), F.when(standard, F.left(as_of, F.lit(6))).alias("reporting_period"))


def classified(members: DataFrame) -> DataFrame:
    """Members with ``rejection``: null for accepted ones. Several claims on one deal and period are all rejected."""
    claims = F.count("*").over(Window.partitionBy("deal_id", "reporting_period"))
    reason = F.when(F.col("deal_id").isNull(), "non-standard name").when(claims > 1, "duplicate or revised")
    return members.withColumn("rejection", reason)


def padded(rows: DataFrame) -> DataFrame:
    """Fields by name, padded with nulls on the right; ``accepted`` tells whether the width is one of the layout's."""
    fields = F.col("fields")
    named = [F.get(fields, F.lit(i)).alias(n) for i, n in enumerate(FIELD_NAMES)]
    return rows.select(*[c for c in rows.columns if c != "fields"], F.col("width").isin(*WIDTHS).alias("accepted"), *named)


def foundation(spark: SparkSession, path: str, deals: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(foundation rows of the accepted members, classified inventory); ``deals`` limits both to some deals."""
    members = classified(inventory(spark, path))
    if deals is not None:
        members = members.where(F.col("deal_id").isin(deals))
    good = accepted(members)
    return (lines(spark, path, good, INTAKE_SCHEMA) if good else spark.createDataFrame([], INTAKE_SCHEMA)), members


def accepted(members: DataFrame) -> list[tuple[str, str, str]]:
    """Name, deal and period of the classified inventory's accepted members."""
    return [tuple(r) for r in members.where(F.col("rejection").isNull()).select("member", "deal_id", "reporting_period").collect()]


def _blank(name: str) -> Column:
    return F.coalesce(F.trim(F.col(name)), F.lit("")) == ""


def row_rules(rows: DataFrame) -> dict[str, Column]:
    """What no row may be, by the name of its count; those of the member only where rows still tell of it."""
    status = F.coalesce(F.trim("current_loan_delinquency_status"), F.lit(""))
    own = {"wrong_width": ~F.col("width_accepted"), "wrong_period": ~F.col("period").eqNullSafe(F.col("member_period"))} if {"width_accepted", "member_period"} <= set(rows.columns) else {}
    if not own:
        return {}
    return own | {
        "blank_identifiers": _blank("reference_pool_number") | _blank("loan_identifier"),
        "negative_upb": F.coalesce(F.regexp_replace("current_actual_upb", ",", "").try_cast("decimal(20,2)") < 0, F.lit(False)),
        "invalid_status": ~status.isin("", "RA", "XX") & status.try_cast("int").isNull(),
    }


def member_gates(rows: DataFrame) -> DataFrame:
    """Per member: records, widths, and rows that break intake's rules."""
    shared = rows.groupBy("source_member", "reference_pool_number", "loan_identifier").agg(F.count("*").alias("n")).groupBy("source_member").agg(F.count_if(F.col("n") > 1).alias("duplicate_loans"))
    found = rows.groupBy("source_member").agg(F.count("*").alias("records"), F.count_distinct("source_field_count").alias("widths"), *[F.count_if(c).alias(n) for n, c in row_rules(rows).items()])
    return found.join(shared, "source_member")


BROKEN = ("wrong_width", "wrong_period", "blank_identifiers", "duplicate_loans", "negative_upb", "invalid_status")


def check_members(gates: DataFrame) -> dict:
    """All members keep all rules, or the build fails."""
    total = gates.agg(F.sum("records").alias("records"), F.count_if(F.col("widths") > 1).alias("mixed_widths"), *[F.sum(c).alias(c) for c in BROKEN])
    return gate("members", total, lambda r: not r["mixed_widths"] and not any(r[c] for c in BROKEN))


def sound_members(rows: DataFrame, gates: DataFrame) -> DataFrame:
    """Rows of members that keep all rules: intake rejects a member whole, and goes on."""
    bad = gates.where(" OR ".join([f"{c} > 0" for c in BROKEN] + ["widths > 1"])).select("source_member")
    return rows.join(bad, "source_member", "left_anti")


def official_mismatches(totals: DataFrame, official: DataFrame) -> DataFrame:
    """Members whose records differ from the official total given for their deal and period."""
    keys = ["deal_id", "reporting_period"]
    return totals.join(official.withColumnRenamed("records", "official_records"), keys).where(F.col("records") != F.col("official_records"))


def official_totals(spark: SparkSession, path: str) -> DataFrame:
    """deal_id, reporting_period and records of a JSON manifest: a list of them, or an object with such a list as ``files``."""
    entry = "deal_id string, reporting_period string, records long"
    text = spark.read.text(path, wholetext=True)
    as_list, as_object = F.from_json("value", f"array<struct<{entry}>>"), F.from_json("value", f"struct<files:array<struct<{entry}>>>")["files"]
    both = text.select(F.when(F.ltrim("value").startswith("["), as_list).otherwise(as_object).alias("files"))
    return both.select(F.explode("files").alias("f")).select("f.*")


def write_archives(foundation: DataFrame, folder: str, whole: bool = False) -> DataFrame:
    """Write foundation rows as disclosure archives, one ZIP per deal and year; checkpointed: archive, members, records.

    A line has ``source_field_count`` fields. Deals are named as members are:
    the year's two digits and the series. Lines are joined without a look at
    their fields first; tasks count what they are given, and archives with a
    line that needs quotes, or of another width, are written in a second run.
    ``whole``: each task has all rows of its archives, by archive, member and
    loan, as the lens can deal them, and lines need no shuffle.
    """
    width = F.col("source_field_count").cast("int")
    made = _write(foundation, plain_line(width), F.when(width.between(min(WIDTHS), len(FIELD_NAMES)), width - 1), folder, whole)
    if whole and (split := made.groupBy("archive").agg(F.count("*").alias("n")).where("n > 1").first()):
        raise GateError(f"rows of archive {split['archive']} are not in one task")
    if not (odd := [r["archive"] for r in made.where("records < 0").collect()]):  # a row per archive
        return made
    again = _write(foundation, F.concat(line(width), F.lit("\n")), F.lit(-1), folder, whole, odd)
    return made.where("records >= 0").unionByName(again)


def _write(foundation: DataFrame, text: Column, bars: Column, folder: str, whole: bool, only: list[str] | None = None) -> DataFrame:
    """Archives of lines (each with its end), or of some archives only. Those whose lines have other bars than told (-1: any), a quote or an end of line within are not written: their records are -1."""
    ship_code(foundation.sparkSession)
    deal = F.regexp_replace("deal_id", _CENTURY, "$1")
    archive, member = F.concat(deal, F.lit("_"), F.left("period", F.lit(4))), F.concat(deal, F.lit("_"), "period", F.lit("01_lld.txt"))
    rows = foundation if only is None else foundation.where(archive.isin(only))
    # names are made by the tasks, once for all rows of a member
    texts = [F.col("deal_id"), F.col("period"), text.alias("line"), bars.alias("bars")]
    if whole:
        dealt = rows.select(*texts)
    else:
        keyed = rows.select(*texts, "loan_identifier", archive.alias("archive"), member.alias("member"))
        dealt = keyed.repartition(_shuffles(foundation.sparkSession), "archive").sortWithinPartitions("archive", "member", "loan_identifier").select("deal_id", "period", "line", "bars")

    def plain(batch: pa.RecordBatch, data: bytes) -> bool:
        told = batch.column(3)
        return told.null_count == 0 and data.count(b"|") == pc.sum(told).as_py() and data.count(b"\n") == batch.num_rows and b'"' not in data and b"\r" not in data

    def named(deal: str | None, period: str | None) -> tuple[str, str]:
        if deal is None or period is None:
            raise GateError("a row without a deal or a period belongs to no member")
        deal = re.sub(_CENTURY, r"\1", deal)
        return f"{deal}_{period[:4]}", f"{deal}_{period}01_lld.txt"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, odd, open_name, member, beside, z, text = [], set(), None, None, None, None, None

        def end_member() -> None:
            if text is not None:
                text.close()

        def end_archive() -> None:
            end_member()
            if z is not None:
                z.close()
                if open_name not in odd:
                    with open(beside.name, "rb") as made:
                        write_whole(joined(folder, f"{open_name}.zip"), made)
                beside.close()

        for batch in batches:
            if not batch.num_rows:
                continue
            offsets, data = _buffers(batch.column(2))
            ends = sorted({e for k in (0, 1) for e in pc.run_end_encode(batch.column(k)).run_ends.to_pylist()})
            runs = [(first, end, *named(batch.column(0)[first].as_py(), batch.column(1)[first].as_py())) for first, end in zip([0, *ends], ends)]
            if only is None and not plain(batch, bytes(data[offsets[0] : offsets[-1]])):
                odd |= {archive for _, _, archive, _ in runs}
            for first, end, archive, name in runs:
                if archive != open_name:
                    end_archive()
                    if any(archive == d[0] for d in done):
                        raise GateError(f"rows of archive {archive} are not together")
                    beside = tempfile.NamedTemporaryFile(suffix=".zip")  # a task's own working file, sent to the folder when whole
                    z, text, open_name, member = zipfile.ZipFile(beside.name, "w", zipfile.ZIP_DEFLATED, compresslevel=1), None, archive, None
                    done.append([archive, 0, 0])
                if archive in odd:
                    continue
                if name != member:
                    end_member()
                    text, member = z.open(name, "w", force_zip64=True), name
                    done[-1][1] += 1
                text.write(data[offsets[first] : offsets[end]])
                done[-1][2] += end - first
        end_archive()
        if done:
            done = [[a, m, -1 if a in odd else n] for a, m, n in done]
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["archive", "members", "records"])

    with compiled(foundation.sparkSession):
        return cut(dealt.mapInArrow(run, "archive string, members long, records long"))


def line(width: Column) -> Column:
    """The first ``width`` fields of a row as a line of a member, without its end, quoted where a field needs it."""
    quoted = lambda v: F.when(v.rlike(_SPECIAL), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)
    text = lambda fields: F.array_join(F.slice(fields, F.lit(1), F.coalesce(width, F.lit(len(FIELD_NAMES)))), "|", "")
    plain = F.array(*FIELD_NAMES)
    return F.when(F.concat_ws("", *FIELD_NAMES).rlike(_SPECIAL), text(F.transform(plain, quoted))).otherwise(text(plain))


def plain_line(width: Column) -> Column:
    """:func:`line` and its end, of a row of the layout's widths whose fields need no quotes: joined at once, without an array of them."""
    fields = [F.coalesce(F.col(c), F.lit("")) for c in FIELD_NAMES]
    least = min(WIDTHS)
    later = [F.when(width > k, F.concat(F.lit("|"), fields[k])).otherwise("") for k in range(least, len(FIELD_NAMES))]
    return F.concat_ws("|", *fields[: least - 1], F.concat(fields[least - 1], *later, F.lit("\n")))


#: How a deal's name begins, of which members' names keep the year's last digits.
_CENTURY = r"^20(\d{2})-"
#: What a field is quoted for.
_SPECIAL = '[|"\r\n]'


def _buffers(texts: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Where each text begins and ends in the bytes of all of them, and these bytes."""
    wide = texts.cast(pa.large_string())
    _, offsets, data = wide.buffers()
    return np.frombuffer(offsets, np.int64)[wide.offset : wide.offset + len(wide) + 1], memoryview(data if data is not None else b"")


def _shuffles(spark: SparkSession) -> int:
    """Tasks of a shuffle by folder or archive; named, because adaptive execution would merge them to as many as there are cores."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_lines(spark: SparkSession, path: str, width: int) -> DataFrame:
    """An unpacked member of one known width by Spark's own reader: a line that is not of that width fails the read."""
    if width not in WIDTHS:
        raise GateError(f"no layout has {width} fields")
    schema = ", ".join(f"{n} string" for n in FIELD_NAMES[:width])
    return spark.read.schema(schema).option("sep", "|").option("mode", "FAILFAST").csv(path)


#: Positions of a line that a control total needs: period, pool, status and balance.
CONTROL_POSITIONS = {"period": 1, "reference_pool_number": 2, "current_loan_delinquency_status": 37, "current_actual_upb": 40}


def control_fields(spark: SparkSession, path: str, least: int = 40) -> DataFrame:
    """The four control fields of a loan-level text file of any width; ``short`` tells lines of under ``least`` fields."""
    parts = F.split("value", r"\|", -1)
    named = [F.nullif(F.get(parts, F.lit(k - 1)), F.lit("")).alias(n) for n, k in CONTROL_POSITIONS.items()]
    return spark.read.text(path).select((F.size(parts) < least).alias("short"), *named)


#: Bytes of a generated method above which the JVM interprets it for good.
COMPILED_BYTES = "8000"


@contextmanager
def compiled(spark: SparkSession) -> Iterator[None]:
    """Run jobs over all columns of the foundation: methods too long for the JVM's compiler are split by operator and column."""
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, COMPILED_BYTES)
    try:
        yield
    finally:
        spark.conf.set(name, before)


ROW_GROUP_ROWS = 100_000


def write(rows: DataFrame, root: str, mode: str = "errorifexists", whole_members: bool = False) -> None:
    """Parquet by deal and period, sorted by loan: one shuffle by partition, one file for each, row groups of about 100,000 rows.

    ``whole_members``: each task has all rows of its deals and periods, as rows
    read from archives have, which need no shuffle.
    """
    stored = rows.select(*LINEAGE, *FIELD_NAMES).withColumn("reporting_period", F.col("period"))
    dealt = stored if whole_members else stored.repartition(_shuffles(rows.sparkSession), "deal_id", "reporting_period")
    dealt.sortWithinPartitions("deal_id", "reporting_period", "loan_identifier").write.mode(mode).option("compression", "zstd").option("parquet.block.row.count.limit", ROW_GROUP_ROWS).partitionBy("deal_id", "reporting_period").parquet(root)


def stored_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("deal_id", F.col("period").alias("reporting_period")).agg(F.count("*").alias("records"))


def scan_facts(df: DataFrame) -> dict:
    """Run a query and read from its executed plan what its scans of files read: files, bytes, partitions and rows."""
    df.collect()
    found = {"scans": 0, "files": 0, "bytes": 0, "partitions": 0, "rows": 0}
    names = {"files": "numFiles", "bytes": "filesSize", "partitions": "numPartitions", "rows": "numOutputRows"}

    def walk(node) -> None:
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        if kind == "FileSourceScanExec":
            found["scans"] += 1
            for n, metric in names.items():
                value = node.metrics().get(metric)
                found[n] += value.get().value() if value.isDefined() else 0
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return found


def check_pruned(facts: dict, most_files: int) -> dict:
    """A filter on keys left at most so many files to read."""
    if not facts["scans"] or facts["files"] > most_files:
        raise GateError(f"pruning: {facts}, at most {most_files} files are expected")
    return facts


def files_read(rows: DataFrame) -> DataFrame:
    """One row: how many files the rows come from, and the rows. Shows what partition pruning left to read."""
    return rows.select(F.input_file_name().alias("f")).agg(F.count_distinct("f").alias("files"), F.count("*").alias("records"))


def column_scan(rows: DataFrame, name: str) -> DataFrame:
    """One row: the characters of one column over the whole history; a probe of a scan that reads one column."""
    return rows.agg(F.count("*").alias("records"), F.sum(F.length(name)).alias("characters"))


def read(spark: SparkSession, root: str) -> DataFrame:
    """The foundation; filters on deal_id and period (as reporting_period) prune folders."""
    from poolgauge.functions.layout import FOUNDATION_SCHEMA
    from pyspark.sql import types as T

    schema = T.StructType([*FOUNDATION_SCHEMA.fields, T.StructField("reporting_period", T.StringType())])
    return spark.read.schema(schema).parquet(root)


def refuse_overlap(stored: DataFrame, offered: DataFrame) -> None:
    """Stored partitions are never written again."""
    stored = stored.select("deal_id", "reporting_period").distinct()
    if not offered.join(stored, ["deal_id", "reporting_period"], "left_semi").isEmpty():
        raise GateError("the archive revises a stored partition")
