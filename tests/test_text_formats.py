"""Records whose headers hold the record mark, and lines that are not BED."""

import gzip

import pytest

from tessera.operators import records, stitching
from tessera.sources import formats


def test_fasta_records_begin_at_line_starts(spark, tmp_path):
    text = ">c1 a>b\nACGT\nac>\n>c2\r\nGG\r\n>c3\n"
    (tmp_path / "s1.fa").write_text(text)
    with gzip.open(tmp_path / "s2.fasta.gz", "wt") as out:
        out.write(text)
    got = {(r.sample, r.sequence_id): (r.seq, r.valid) for r in formats.read_fasta(spark, str(tmp_path)).collect()}
    assert got == {(s, k): v for s in ("s1", "s2") for k, v in {"c1": ("ACGTAC>", False), "c2": ("GG", True), "c3": ("", False)}.items()}


def test_short_bed_lines_are_errors(spark):
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    assert [tuple(r) for r in records.parse_bed(lines("#x", "", "c 1 5 anchor_00000001 0.5", "c 6 9 n")).collect()] == [("c", 1, 5, "anchor_00000001", 0.5), ("c", 6, 9, "n", None)]
    with pytest.raises(Exception, match="under four columns"):
        records.parse_bed(lines("c 1 5")).collect()


def test_cigar_files_and_fasta_become_records(spark, tmp_path):
    (tmp_path / "t.fa").write_text(">t\nACGTA\nCC\n")
    (tmp_path / "q.fa").write_text(">q\nacctac\n")
    cigars = tmp_path / "cigars"
    cigars.mkdir()
    (cigars / "one.txt").write_text("6M1D\n")
    with gzip.open(cigars / "two.cigar.gz", "wt") as out:
        out.write("2=1X\n2=1M1D")
    side = lambda x: formats.read_fasta(spark, str(tmp_path / f"{x}.fa"))
    pairs = side("t").selectExpr("sequence_id as tname", "seq as target").crossJoin(side("q").selectExpr("sequence_id as qname", "seq as query"))
    got = stitching.cigar_records(pairs.crossJoin(formats.read_cigars(spark, str(cigars)))).collect()
    assert [tuple(r)[:12] for r in got] == [("q", 6, 0, 6, "+", "t", 7, 0, 7, 5, 7, 255)] * 2
    assert [r.tags for r in got] == [{"cg:Z": "2=1X3=1D"}] * 2
    assert {r.name for r in formats.read_cigars(spark, str(cigars)).collect()} == {"one", "two"}


def test_cigar_records_of_nulls_copies_and_misfits(spark):
    kinds = "qname string, query string, tname string, target string, cigar string, tags string"
    made = lambda *x: stitching.cigar_records(spark.createDataFrame(list(x), kinds)).collect()
    assert made() == []
    empty, insert, again = made(("a", None, "b", "", None, "own"), ("a", "GG", "b", None, "2I", None), ("a", "GG", "b", None, "2I", None))
    assert (empty.qlen, empty.tlen, empty.block, empty.tags) == (0, 0, 0, {"cg:Z": ""}) and insert == again and (insert.te, insert.block, insert.matches) == (0, 2, 0)
    for cigar in ("3M", "4M1I", "4S"):
        with pytest.raises(Exception, match="doesn't fit"):
            made(("a", "ACGT", "b", "ACGT", cigar, None))
