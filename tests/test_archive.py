import csv
import io
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from poolgauge.functions.layout import FIELD_NAMES
from poolgauge.operators import baseline, control
from poolgauge.plans.tables import Store
from poolgauge.sources import archive
from poolgauge.sources.foundation import KEYS, Foundation
from poolgauge.streaming import landing


def line(width, period, loan="L1", upb="100", status="00", pool="P1"):
    values = {"period": period, "reference_pool_number": pool, "loan_identifier": loan, "current_actual_upb": upb, "current_loan_delinquency_status": status, "distressed_principal_balance_flag": "N", "seller_name": '"a|b"'}
    named = [values.get(n, "") for n in FIELD_NAMES[:width]]
    return "|".join(named + ["x"] * (width - len(named)))


def make(path, members):
    with zipfile.ZipFile(path, "w") as z:
        for name, rows in members.items():
            z.writestr(name, "\n".join(rows) + "\n")
    return str(path)


def test_widths_and_padding(spark, tmp_path):
    zipped = make(tmp_path / "a.zip", {"22HQA1_20230701_lld.txt": [line(89, "202307")], "22HQA1_20240901_lld.txt": [line(90, "202409")], "22HQA1_20260701_lld.txt": [line(93, "202607")], "notes.txt": ["x"]})
    rows, members = archive.foundation(spark, zipped)
    assert {r.member: r.rejection for r in members.collect()}["notes.txt"] == "non-standard name"
    got = {r.source_field_count: r for r in rows.collect()}
    assert set(got) == {89, 90, 93} and got[89].deal_id == "2022-HQA1" and got[89].seller_name == "a|b"
    assert got[89].distressed_principal_balance_flag == "N" and got[89][FIELD_NAMES[89]] is None
    assert archive.check_members(archive.member_gates(rows))["records"] == 3
    archive.write(rows, str(tmp_path / "f"))
    back = archive.read(spark, str(tmp_path / "f"))
    assert back.where("deal_id = '2022-HQA1' AND reporting_period = '202409'").count() == 1
    assert "PartitionFilters: [isnotnull(deal_id" in back.where("deal_id = 'x'")._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(control.GateError):
        archive.refuse_overlap(back, back.select("deal_id", "reporting_period"))


@pytest.mark.parametrize("rows", [[line(88, "202307")], [line(89, "202308")], [line(89, "202307", loan=" ")], [line(89, "202307")] * 2, [line(89, "202307"), line(90, "202307", "L2")], [line(89, "202307", upb="-1")], [line(89, "202307", status="Z")]])
def test_broken_members_fail_or_are_left_out(spark, tmp_path, rows):
    zipped = make(tmp_path / "a.zip", {"22HQA1_20230701_lld.txt": rows, "22DNA2_20230701_lld.txt": [line(89, "202307")]})
    found, _ = archive.foundation(spark, zipped)
    gates = archive.member_gates(found)
    with pytest.raises(control.GateError):
        archive.check_members(gates)
    assert [r.deal_id for r in archive.sound_members(found, gates).collect()] == ["2022-DNA2"]


def test_revised_members_are_all_refused(spark, tmp_path):
    zipped = make(tmp_path / "a.zip", {"22HQA1_20230701_lld.txt": ["a"], "22HQA1_20230715_lld.txt": ["b"], "22DNA2_20230701_lld.txt": [line(89, "202307")]})
    rows, members = archive.foundation(spark, zipped)
    assert [r.rejection for r in members.where("deal_id = '2022-HQA1'").collect()] == ["duplicate or revised"] * 2
    assert rows.count() == 1
    assert control.duplicate_candidates(members).count() == 2


def test_official_totals(spark):
    a = spark.createDataFrame([("D", "1", 5), ("D", "2", 6)], "deal_id string, reporting_period string, records long")
    b = spark.createDataFrame([("D", "1", 5), ("D", "2", 7)], a.schema)
    assert [r.reporting_period for r in archive.official_mismatches(a, b).collect()] == ["2"]


def test_control_totals_drop_commas(spark):
    rows = archive.padded(spark.createDataFrame([("m", 1, 93, [dict(period="202607", reference_pool_number="P", current_actual_upb=u, current_loan_delinquency_status=s).get(n) for n in FIELD_NAMES]) for u, s in (("100", "00"), ("4,000.5", "02"), ("10", "RA"), (None, " "))], archive.LINE_SCHEMA)).selectExpr("'D' AS deal_id", "*")
    r = control.release_aggregate(rows).first()
    assert (float(r.current_upb), float(r.d30_plus_upb), float(r.d60_plus_upb), r.ra_records, r.xx_records) == (4110.5, 4000.5, 4000.5, 1, 1)


def test_baseline(spark, tmp_path):
    rows = baseline.fixture(spark)
    assert baseline.check(rows, 9842250.0)["records"] == 10
    assert {(r.reporting_period, r.deal_id): r.delinquency_rate for r in baseline.rates(rows).collect()}[("2025-02", "DEMO-2024-A")] == 0.01114488
    with pytest.raises(control.GateError):
        baseline.check(rows, 1.0)
    rows.coalesce(1).write.option("header", True).csv(str(tmp_path / "c"))
    assert baseline.read(spark, str(tmp_path / "c")).count() == 10
    rows.withColumnRenamed("tranche", "borrower").coalesce(1).write.option("header", True).csv(str(tmp_path / "d"))
    with pytest.raises(control.GateError):
        baseline.read(spark, str(tmp_path / "d"))


def test_streaming_intake(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    def land(period, n):
        zipped = make(tmp_path / f"{n}.zip", {f"22HQA1_{period}01_lld.txt": [line(89, period, f"L{i}", status="02" if i else "00") for i in range(3)]})
        archive.foundation(spark, zipped)[0].drop("width_accepted", "member_period").write.mode("append").parquet(str(tmp_path / "landing"))
        q = landing.intake(spark, str(tmp_path / "landing"), str(tmp_path / "root"), store, str(tmp_path / "cp"))
        q.awaitTermination()
    land("202307", 1)
    land("202308", 2)
    assert store.load().portfolio.count() == 2
    # a batch that broke off after its rows were stored and runs again finds its own folder
    offered = archive.read(spark, str(tmp_path / "root" / "data")).where("batch = 1").drop("batch")
    archive.write(offered, str(tmp_path / "root" / "data" / "batch=1"), mode="append")
    last = max((tmp_path / "cp" / "commits").glob("[0-9]*"))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    landing.intake(spark, str(tmp_path / "landing"), str(tmp_path / "root"), store, str(tmp_path / "cp")).awaitTermination()
    assert archive.read(spark, str(tmp_path / "root" / "data")).groupBy("batch").count().where("count <> 3").isEmpty()
    assert store.load().portfolio.count() == 2


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 20])
def test_members_are_split_as_csv_reader_splits_them(block):
    """Quotes over lines, blank lines, carriage returns, quotes inside fields and a last line without an end, at all block sizes."""
    parts = ["a|b|", "||", '"x|y"|"a ""q"" b"|z', "", "é|ü|ß", 'm"n|o|p', '"two\nlines|"|c', "d|e\r", "last|one"]
    for text in ["\n".join(parts), "\n".join(parts * 3) + "\n", "\n\na|b\n", "", "a", "\n".join(f"{i}|{i}|" for i in range(50)) + "\n", '"open|field\nto the end']:
        want = [[v or None for v in row] for row in csv.reader(io.StringIO(text, newline=""), delimiter="|")]
        assert [row for fields in archive.parsed(io.BytesIO(text.encode()), block) for row in fields.to_pylist()] == want


def test_archives_come_back_as_they_were(spark, tmp_path):
    """Fields that need quotes, empty ones, and all three widths, over a write and a read; the reader gives Arrow batches."""
    odd = ["plain", 'a|b "c"', "two\nlines", "cr\r", None, '"', " x "]
    rows = spark.createDataFrame([("2022-HQA1", "m", w, p, "P1", f"L{i}", v) for w, p in ((89, "202307"), (90, "202308"), (93, "202409")) for i, v in enumerate(odd)], "deal_id string, source_member string, source_field_count short, period string, reference_pool_number string, loan_identifier string, seller_name string")
    rows = rows.select("*", *[F.lit("end" if n == FIELD_NAMES[-1] else None).cast("string").alias(n) for n in FIELD_NAMES if n not in rows.columns])
    made = archive.write_archives(rows, str(tmp_path / "z")).collect()
    assert sorted((r.archive, r.members, r.records) for r in made) == [("22HQA1_2023", 2, 14), ("22HQA1_2024", 1, 7)]
    back, _ = archive.foundation(spark, str(tmp_path / "z"))
    got = sorted((r.period, r.loan_identifier, r.source_field_count, str(r.seller_name), r[FIELD_NAMES[-1]]) for r in back.collect())
    assert got == sorted((p, f"L{i}", w, str(v), "end" if w == 93 else None) for w, p in ((89, "202307"), (90, "202308"), (93, "202409")) for i, v in enumerate(odd))
    reader = archive._Reader({"path": str(tmp_path / "z")})
    assert all(isinstance(b, pa.RecordBatch) for p in reader.partitions() for b in reader.read(p))


def test_an_append_of_an_archive_is_one_file_a_partition(spark, tmp_path):
    """A task holds whole members, so that storing them needs no shuffle."""
    zipped = make(tmp_path / "a.zip", {f"22HQA1_2023{m:02}01_lld.txt": [line(89, f"2023{m:02}", f"L{i}") for i in range(20)] for m in range(1, 13)})
    rows, members = archive.foundation(spark, zipped)
    made = Foundation(spark, str(tmp_path / "f"))
    assert made.append(rows, members)["records"] == 240
    made.verify()
    assert made.read().select(*KEYS, F.input_file_name().alias("f")).groupBy(*KEYS).agg(F.count_distinct("f").alias("n")).where("n <> 1").isEmpty()
    made.read().where("reporting_period = '202301'").drop("reporting_period").write.parquet(made._at("deal_id=HQA9", "reporting_period=202301"))
    with pytest.raises(control.GateError, match="what the manifest says"):
        made.verify()
