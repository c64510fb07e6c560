"""Appends that break off, manifests, versions that share folders, and what a delta reads."""

import json

import pytest
from pyspark.sql import functions as F

from poolgauge import storage
from poolgauge.operators import control
from poolgauge.operators.typed import typed
from poolgauge.plans import incremental
from poolgauge.plans.tables import NAMES, Store, build
from poolgauge.sources import archive
from poolgauge.sources.foundation import Foundation, partition_facts
from test_panel import foundation  # noqa: F401 (a fixture)




def test_an_append_that_broke_off_is_finished(spark, foundation, tmp_path, monkeypatch):
    """The first of three renames fails; the retry finishes what was verified, and nothing is stored twice."""
    made, rows, done = Foundation(spark, str(tmp_path / "f")), foundation().where("deal_id = 'HQA1'"), []
    real = storage.move

    def fails_once(a, b):
        if "_staged-" in a and len(done) < 1:
            done.append(b)
            real(a, b)
            raise OSError("the machine is gone")
        real(a, b)

    monkeypatch.setattr(storage, "move", fails_once)
    with pytest.raises(OSError):
        made.append(rows)
    assert made.manifest().count() == 0 and storage.names(made._at("_intents"))
    with pytest.raises(control.GateError, match="not written again"):  # the retry finds its partitions stored
        made.append(rows)
    assert made.manifest().count() == 3 and made.read().count() == rows.count()
    assert not storage.names(made._at("_intents")) and not [n for n in storage.names(made.root) if n.startswith("_staged-")]
    made.verify()
    assert made.append(foundation().where("deal_id <> 'HQA1'"))["partitions"] == 3
    made.verify([("HQA1", "202606")])


def test_recovery_removes_what_was_staged_and_puts_orphans_aside(spark, foundation, tmp_path):
    made = Foundation(spark, str(tmp_path / "f"))
    made.append(foundation().where("deal_id = 'HQA1'"))
    archive.write(foundation().where("deal_id = 'HQA1'"), made._at("_staged-broken"))
    storage.move(made._at("_staged-broken", "deal_id=HQA1", "reporting_period=202606"), made._at("deal_id=STRAY", "reporting_period=202606"))
    found = made.recover()
    assert found["staged"] == ["_staged-broken"] and found["orphans"] == ["deal_id=STRAY/reporting_period=202606"]
    assert made.read().where("deal_id = 'STRAY'").isEmpty() and made.recover() == {"finished": [], "staged": [], "orphans": []}
    storage.remove(made._at("deal_id=HQA1", "reporting_period=202606"))
    with pytest.raises(control.GateError, match="gone"):
        made.recover()


def test_digests_count_equal_rows_and_add_up(spark, foundation, tmp_path):
    rows = foundation().where("deal_id = 'HQA1' AND period = '202606'").withColumn("reporting_period", F.col("period"))
    once, twice = partition_facts(rows).first(), partition_facts(rows.union(rows)).first()
    assert (twice.records, twice.digest_a, twice.digest_b) == (2 * once.records, 2 * once.digest_a, 2 * once.digest_b)
    other = partition_facts(rows.withColumn("channel", F.coalesce("channel", F.lit("")))).first()
    moved = partition_facts(rows.withColumn("channel", F.col("classic_fico")).withColumn("classic_fico", F.lit(None).cast("string"))).first()
    assert once.digest_a not in (other.digest_a, moved.digest_a)


def test_broken_members_are_not_appended(spark, tmp_path):
    from test_archive import line, make

    for k, bad in enumerate(([line(88, "202307")], [line(89, "202308")], [line(89, "202307", loan=" ")], [line(89, "202307")] * 2, [line(89, "202307"), line(90, "202307", "L2")], [line(89, "202307", upb="-1")], [line(89, "202307", status="Z")])):
        rows, members = archive.foundation(spark, make(tmp_path / f"{k}.zip", {"22HQA1_20230701_lld.txt": bad}))
        made = Foundation(spark, str(tmp_path / f"f{k}"))
        with pytest.raises(control.GateError, match="members"):
            made.append(rows, members)
        assert made.manifest().count() == 0 and not [n for n in storage.names(made.root) if n.startswith("_staged-")]
    rows, members = archive.foundation(spark, make(tmp_path / "good.zip", {"22HQA1_20230701_lld.txt": [line(89, "202307")]}))
    made = Foundation(spark, str(tmp_path / "good"))
    made.append(rows, members)
    r = made.manifest().first()
    assert (r.source_member, r.source_field_count, r.records) == ("22HQA1_20230701_lld.txt", 89, 1) and r.crc32 and r.bytes


def test_a_delta_reads_new_partitions_and_writes_what_they_touch(spark, foundation, tmp_path):
    made, store, whole = Foundation(spark, str(tmp_path / "f")), Store(spark, str(tmp_path / "s")), foundation()
    made.append(whole.where("period < '202608' AND deal_id = 'HQA1'"))
    first = incremental.refresh(spark, store, made)
    made.append(whole.where("period = '202608' AND deal_id = 'HQA1'"))
    done = incremental.refresh(spark, store, made)
    assert (done["kind"], incremental.refresh(spark, store, made)["kind"]) == ("delta", "no-op")
    # one month of one deal, its own and its neighbours' folders
    assert archive.check_pruned(archive.scan_facts(made.read([("HQA1", "202608")])), 1)["files"] == 1
    with pytest.raises(control.GateError, match="pruning"):
        archive.check_pruned(archive.scan_facts(made.read().where("period = '202608'")), 1)
    listed = store.listed(done["version"])
    for name in ("pool_components", "pool", "deal", "layers", "flow"):
        assert "202606" not in listed[name]["from"][done["version"]] and listed[name]["from"].get(first["version"]), name
        assert [n for n in storage.names(store.path(done["version"], name)) if n.startswith("p=")] == ["p=202608"], name
    # a late deal: its months touch each other's lags, and all of it is written
    made.append(whole.where("deal_id <> 'HQA1'"))
    assert incremental.refresh(spark, store, made)["kind"] == "delta"
    full = build(typed(made.read().drop("reporting_period")))
    for n in NAMES:
        a, b = getattr(store.load(), n), getattr(full, n)
        assert a.exceptAll(b.select(a.columns)).isEmpty() and b.exceptAll(a.select(b.columns)).isEmpty(), n


def test_a_revised_manifest_is_refused_without_reading_rows(spark, foundation, tmp_path):
    made, store = Foundation(spark, str(tmp_path / "f")), Store(spark, str(tmp_path / "s"))
    made.append(foundation().where("deal_id = 'HQA1'"))
    version = incremental.refresh(spark, store, made)["version"]
    folder = tmp_path / "f" / "_manifest"
    (note,) = [p for p in folder.iterdir() if p.suffix == ".json" and not p.name.startswith(".")]
    lines = [json.loads(x) for x in note.read_text().splitlines()]
    note.write_text("\n".join(json.dumps({**x, "records": x["records"] + 1}) for x in lines) + "\n")
    with pytest.raises(control.GateError, match="append only"):
        incremental.refresh(spark, store, made)
    with pytest.raises(control.GateError, match="not what the manifest says"):
        made.verify()
    assert store.current() == version


def test_digests_are_the_sums_of_row_hashes(spark, foundation):
    from poolgauge.sources.foundation import KEYS, row_hash

    rows = foundation().withColumn("reporting_period", F.col("period"))
    columns = sorted(c for c in rows.columns if c not in KEYS)
    hashes = [r[0] for r in rows.select(row_hash(columns, "a")).collect()]
    assert min(hashes) < 0 < max(hashes) and sum(hashes) == sum(int(r.digest_a) for r in partition_facts(rows).collect())
