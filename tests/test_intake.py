"""Members stored by the tasks that read them: the same partitions, digests and refusals as by Spark's writer."""

import codecs
import io

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from conftest import DATA
from test_archive import line, make

from poolgauge import storage
from poolgauge.functions.layout import FIELD_NAMES
from poolgauge.operators import control, masking
from poolgauge.plans import release
from poolgauge.sources import archive, intake, lens
from poolgauge.sources.foundation import FACTS, KEYS, Foundation, partition_facts


@pytest.mark.parametrize("block", [7, 64, 1 << 20])
def test_columns_are_the_fields_by_position(block):
    """Lines of one width, of several, wider than the layout, quoted, and begun by a byte order mark."""
    wide = "|".join(str(i) for i in range(95))
    for text in ["a|b|\n||\n", "a|b\nc\n|d|e\n", f"{wide}\n{wide}\n", 'a|"x|y"\nb|c\n', "é||ß\nx|\x00|z", "one\n\ntwo\n"]:
        for data in (text.encode(), codecs.BOM_UTF8 + text.encode()):
            rows = [row for f in archive.parsed(io.BytesIO(data), block) for row in f.to_pylist()]
            got = [(w, row) for widths, columns in archive.tabled(io.BytesIO(data), block) for w, *row in zip(widths.to_pylist(), *[c.to_pylist() for c in columns])]
            assert got == [(len(r), (r + [None] * len(FIELD_NAMES))[: len(FIELD_NAMES)]) for r in rows]


def test_an_archive_is_stored_as_rows_of_it_are(spark, tmp_path):
    """Members in order, one out of order, one with a loan in two pools and one that is empty; all three widths."""
    members = {f"22HQA1_2023{m:02}01_lld.txt": [line(w, f"2023{m:02}", f"L{i:03}", upb=f"{i}.5") for i in range(30)] for m, w in ((1, 89), (2, 90), (3, 93))}
    members["22HQA1_20230401_lld.txt"] = [line(89, "202304", f"L{i:03}") for i in (2, 1, 3)]
    members["22HQA1_20230501_lld.txt"] = [line(89, "202305", "L1", pool=p) for p in ("P1", "P2")]
    zipped = make(tmp_path / "a.zip", members)
    one, other = Foundation(spark, str(tmp_path / "one")), Foundation(spark, str(tmp_path / "other"))
    rows, inventory = archive.foundation(spark, zipped)
    assert one.append(rows, inventory)["records"] == other.append_archive(zipped)["records"] == 95
    noted = lambda f: sorted(map(tuple, f.manifest().drop("appended").collect()))
    assert noted(one) == noted(other) and len(noted(one)) == 5
    a, b = one.read(), other.read()
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    # tasks and Spark agree on the digests of the same rows
    facts = lambda rows: sorted(map(tuple, rows.select(*KEYS, *FACTS).collect()))
    assert facts(partition_facts(b)) == facts(other.manifest())
    assert b.select(*KEYS, F.input_file_name().alias("f")).distinct().count() == 5
    other.verify()
    with pytest.raises(control.GateError, match="not written again"):
        other.append_archive(zipped)


@pytest.mark.parametrize("bad", [[line(88, "202307")], [line(89, "202308")], [line(89, "202307", loan=" ")], [line(89, "202307")] * 2, [line(89, "202307"), line(90, "202307", "L2")], [line(89, "202307", upb="-1")], [line(89, "202307", status="Z")], [line(89, "202307", pool="")]])
def test_broken_members_are_not_stored(spark, tmp_path, bad):
    made = Foundation(spark, str(tmp_path / "f"))
    with pytest.raises(control.GateError, match="members"):
        made.append_archive(make(tmp_path / "a.zip", {"22HQA1_20230701_lld.txt": bad, "22DNA2_20230701_lld.txt": [line(89, "202307")]}))
    assert made.manifest().count() == 0 and not [n for n in storage.names(made.root) if n.startswith("_staged-")]


def test_lines_that_need_quotes_are_written_in_a_second_run(spark, tmp_path):
    """One archive of plain lines, one with a quote, one with a width that no layout has: each with all its rows, as csv reads them."""
    rows = [("2022-HQA1", "202301", 89, "a"), ("2022-HQA1", "202302", 93, None), ("2022-HQA2", "202301", 89, 'b|"c'), ("2022-HQA2", "202401", 90, "d"), ("2022-HQA3", "202301", 7, "e"), ("2022-HQA3", "202301", None, "f")]
    df = spark.createDataFrame([(*r, "P1", f"L{i}") for i, r in enumerate(rows)], "deal_id string, period string, source_field_count short, seller_name string, reference_pool_number string, loan_identifier string")
    df = df.select("*", *[F.lit("end" if n == FIELD_NAMES[-1] else None).cast("string").alias(n) for n in FIELD_NAMES if n not in df.columns])
    made = archive.write_archives(df, str(tmp_path / "z")).collect()
    assert sorted(map(tuple, made)) == [("22HQA1_2023", 2, 2), ("22HQA2_2023", 1, 1), ("22HQA2_2024", 1, 1), ("22HQA3_2023", 1, 2)]
    assert len(storage.names(str(tmp_path / "z"))) == 4
    got = sorted((r.member, r.width, r.fields[2], r.fields[4], r.fields[-1]) for r in archive.lines(spark, str(tmp_path / "z")).collect())
    want = [(f"22{d[5:]}_{p}01_lld.txt", w or 93, f"L{i}", v, None if w == 89 or w == 90 else "end") for i, (d, p, w, v) in enumerate(rows)]
    assert got == sorted((m, w, loan, v, None if w == 7 else e) for m, w, loan, v, e in want)


@pytest.mark.parametrize("most", [2, 100])
def test_stored_partitions_are_masked_as_rows_are(spark, tmp_path, most):
    """Tasks and Spark give the same tokens in the same order, also where a partition is left to Spark's writer; empty values have none."""
    rows = spark.createDataFrame([("2022-HQA1", p, f"L{i}" if i else "", f"{i % 2}00" if i != 3 else None) for p, n in (("202301", 5), ("202302", 2)) for i in range(n)], "deal_id string, period string, loan_identifier string, postal_code_3_digit string")
    rows = rows.select("*", F.lit("m").alias("source_member"), F.lit(89).cast("short").alias("source_field_count"), *[F.lit(None).cast("string").alias(n) for n in FIELD_NAMES if n not in rows.columns])
    made, key = Foundation(spark, str(tmp_path / "f")), "5a" * 32
    made.append(rows)
    done = release.publish_stored(spark, made, str(tmp_path / "p"), key, most)
    assert sorted(map(tuple, done.collect())) == [("2022-HQA1", "202301", 5), ("2022-HQA1", "202302", 2)]
    want, got = masking.masked(made.read(), key), archive.read(spark, str(tmp_path / "p" / "data"))
    assert want.exceptAll(got).isEmpty() and got.exceptAll(want).isEmpty()
    one = [r.loan_identifier for r in spark.read.parquet(str(tmp_path / "p" / "data" / "deal_id=2022-HQA1" / "reporting_period=202301")).collect()]
    assert one == sorted(one, key=lambda v: (v is not None, v)) and one[0] is None and len(set(one)) == 5
    with pytest.raises(control.GateError, match="already"):
        release.publish_stored(spark, made, str(tmp_path / "p"), key)
    with pytest.raises(control.GateError, match="at least"):
        release.publish_stored(spark, made, str(tmp_path / "q"), "00")


def test_a_deal_s_year_is_in_one_task_by_month_and_loan(spark):
    """Rows dealt by year are those dealt by order, in the order that archives hold them."""
    orders = spark.read.parquet(f"{DATA}/orders.parquet").limit(300)
    rows, plain = lens.monthly(orders, by_year=True), lens.monthly(orders)
    assert rows.exceptAll(plain).isEmpty() and plain.exceptAll(rows).isEmpty()
    listed = rows.select(F.spark_partition_id().alias("t"), "deal_id", "period", "loan_identifier").collect()
    tasks = {}
    for r in listed:
        tasks.setdefault((r.deal_id, r.period[:4]), set()).add(r.t)
    assert all(len(t) == 1 for t in tasks.values()) and len({min(t) for t in tasks.values()}) == len(tasks)
    assert [r[1:] for r in listed] == [r[1:] for r in sorted(listed)]


def test_archives_that_are_not_whole_in_a_task_are_refused(spark, tmp_path):
    rows = spark.createDataFrame([("2022-HQA1", f"20230{m}", f"L{m}") for m in range(1, 5)], "deal_id string, period string, loan_identifier string").repartition(4, "period")
    rows = rows.select("*", F.lit(89).cast("short").alias("source_field_count"), *[F.lit(None).cast("string").alias(n) for n in FIELD_NAMES if n not in rows.columns])
    with pytest.raises(control.GateError, match="not in one task"):
        archive.write_archives(rows, str(tmp_path / "z"), whole=True)


def test_texts_of_tasks_and_of_spark_are_the_same(spark):
    """Nulls, empty values, numbers, and values that hold what parts them; different rows have different texts."""
    rows = [("a", "b", 1), ("a\x1fb", None, 1), (None, "a\x1fb", 1), ("a", "b\x1f", None), ("a\x1f", "b", None), ("a\x1eub", "", 2), ("", "a\x1eub", 2), ("a\x1fb", "", 2), ("", "", None), (None, None, None), ("", None, None), ("é\x1f\x1f", "\x1e", 3)]
    df = spark.createDataFrame(rows, "x string, y string, n short")
    want = [tuple(r) for r in df.select(*intake.values_and_nulls(["x", "y", "n"])).collect()]
    columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int16()))]
    assert list(zip(*[c.to_pylist() for c in intake._values_and_nulls(columns)])) == want
    assert len(set(want)) == len(rows)
