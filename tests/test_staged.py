"""Stage tables written and read by their headers, with bad lines named."""

import pytest

from tessera.sources import staged

KINDS = {"anchor_id": "string", "start": "bigint", "score": "double", "groupable": "boolean"}


def test_written_and_read_back(spark, tmp_path):
    rows = [("a1", 5, 0.25, True, 7, 0), ("a 2 ", 0, None, False, 1, 2), ("", 9, -1e-9, True, 3, 3), ('"q"\\', 1, 2.0, True, 0, 0)]
    frame = spark.createDataFrame(rows, "anchor_id string, start long, score double, groupable boolean, x_alpha_prime long, y_z_alpha_prime long")
    path = str(tmp_path / "t")
    staged.write_stage(frame.select("y_z_alpha_prime", "score", "start", "anchor_id", "groupable", "x_alpha_prime").repartition(3), path)
    got, bad = staged.read_stage(spark, path, KINDS, nullable=("score",), block=("alpha", "_alpha_prime"))
    key = lambda r: r[0]
    assert sorted(map(tuple, got.collect()), key=key) == sorted([(*r[:4], {"x": r[4], "y_z": r[5]}) for r in rows], key=key) and bad.count() == 0


def test_bad_lines_are_named(spark, tmp_path):
    lines = ["start\tanchor_id\tscore\tgroupable\tmore\tx_n", "1\ta\t.\ttrue\t\t4", "", "-1\tb\t1\ttrue\t\t4", "1\tc\t 1\ttrue\t\t4", "1\td\t1\tTRUE\t\t4", "1\te\t1", "99999999999999999999\tf\t1\ttrue\t\t4", ".\tg\t1\ttrue\t\t4", "1\th\t1\ttrue\t\tx", "1\ti\t1\tfalse"]
    (tmp_path / "t.tsv").write_text("\n".join(lines) + "\n")
    rows, bad = staged.read_stage(spark, str(tmp_path / "t.tsv"), KINDS, nullable=("score",), block=("n", "_n"))
    assert [tuple(r) for r in rows.collect()] == [("a", 1, None, True, {"x": 4})]
    assert {r.line.split("\t")[1]: r.reason for r in bad.collect()} == {
        "b": "invalid integer in start: -1", "c": "invalid number in score:  1", "d": "invalid flag in groupable: TRUE", "e": "missing field: groupable", "f": "invalid integer in start: 99999999999999999999",
        "g": "invalid integer in start: .", "h": "invalid integer in x_n: x", "i": "missing field: x_n",
    }
    assert {r.file for r in bad.collect()} == {"t.tsv"}
    assert staged.read_stage(spark, str(tmp_path / "t.tsv"), {"more": "string"})[0].count() == 7


def test_headers_without_a_column_and_empty_files(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("start\n1\n")
    (tmp_path / "b.tsv").write_text("")
    with pytest.raises(ValueError, match="missing column: anchor_id"):
        staged.read_stage(spark, str(tmp_path / "a.tsv"), KINDS)
    with pytest.raises(ValueError, match="empty table"):
        staged.read_stage(spark, str(tmp_path / "b.tsv"), KINDS)
