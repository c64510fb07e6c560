import pytest
from test_archive import line, make

from poolgauge.operators import control, masking
from poolgauge.plans import release
from poolgauge.sources import archive


def test_a_masked_publication_is_read_back_and_counted(spark, tmp_path):
    zipped = make(tmp_path / "a.zip", {f"22HQA1_2023{m:02}01_lld.txt": [line(89, f"2023{m:02}", f"L{i}") for i in range(m)] for m in (1, 2)})
    rows = archive.foundation(spark, zipped)[0].drop("width_accepted", "member_period")
    done = release.publish_masked(spark, rows, str(tmp_path / "p"), "00" * 32)
    assert sorted(tuple(r) for r in done.collect()) == [("2022-HQA1", "202301", 1), ("2022-HQA1", "202302", 2)]
    with pytest.raises(control.GateError, match="row counts"):
        masking.check_masking(rows, masking.masked(rows.where("period = '202301'"), "00" * 32))
    with pytest.raises(control.GateError, match="row counts"):
        masking.check_masking(rows.where("period = '202301'"), masking.masked(rows, "00" * 32))
