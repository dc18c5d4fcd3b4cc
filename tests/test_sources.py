"""Readers over small files, and the stream."""

import pytest

from cladewise.sources import readers
from cladewise.streaming import stream_pair_summary


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_barcodes(spark, tmp_path):
    df = readers.barcodes(spark, put(tmp_path, "m.tsv", "cell s1 s2\nc1 0 -1\nc2\t3\t2\n"))
    assert sorted((r.cell, r.site, r.state) for r in df.collect()) == [("c1", "s1", 0), ("c1", "s2", -1), ("c2", "s1", 3), ("c2", "s2", 2)]
    with pytest.raises(Exception, match="another length"):
        readers.barcodes(spark, put(tmp_path, "bad.tsv", "cell s1 s2\nc1 0\n")).collect()


def test_cell_states(spark, tmp_path):
    df = readers.cell_states(spark, put(tmp_path, "c.csv", "# note\nc1, liver \nc2,lung\n"))
    assert sorted(map(tuple, df.collect())) == [("c1", "liver"), ("c2", "lung")]
    with pytest.raises(Exception, match="two columns"):
        readers.cell_states(spark, put(tmp_path, "d.csv", "c1,a,b\n")).collect()


def test_alignments(spark, tmp_path):
    df = readers.fasta(spark, put(tmp_path, "a.fa", ">x first\nACG\nT-\n>y\nacgta\n"))
    assert sorted((r.taxon, r.sequence) for r in df.collect()) == [("x", "ACGT-"), ("y", "ACGTA")]
    assert {r.taxon: r.codes for r in readers.codes(df).collect()} == {"x": [0, 1, 2, 3, -1], "y": [0, 1, 2, 3, 0]}
    df = readers.phylip(spark, put(tmp_path, "a.phy", " 2 4\nx  AC GT\ny  ACCT\n"))
    assert sorted((r.taxon, r.sequence) for r in df.collect()) == [("x", "ACGT"), ("y", "ACCT")]
    df = readers.maf(spark, put(tmp_path, "a.maf", "##maf version=1\na score=1\ns hg.chr1 10 4 + 100 acgt\ns mm.chr2 5 3 - 90 ac-t\n\na score=2\ns hg.chr1 20 2 + 100 gg\n"))
    assert sorted((r.block, r.source, r.sequence) for r in df.collect()) == [(1, "hg.chr1", "ACGT"), (1, "mm.chr2", "AC-T"), (2, "hg.chr1", "GG")]


def test_phylip_in_both_orders(spark, tmp_path):
    want = [("x", "ACGTTA"), ("y", "ACCTGG"), ("z", "AAAAAA")]
    inter = put(tmp_path, "i.phy", "3 6\nx ACG\ny AC C\nz AAA\n\nTTA\nTGG\nA A A\n")
    seq = put(tmp_path, "s.phy", "3 6\nx ACG\nTTA\ny ACC\nTGG\nz AAA\nAAA\n")
    for path in (inter, seq):
        assert sorted((r.taxon, r.sequence) for r in readers.phylip(spark, path).collect()) == want
    with pytest.raises(Exception, match="differ from the head"):
        readers.phylip(spark, put(tmp_path, "b.phy", "2 5\nx ACGT\ny ACGTA\n")).collect()


def test_maf_blocks_join_over_cuts(spark, tmp_path):
    """Small cuts, so that blocks fall into many tasks; blocks not in the order of the reference."""
    blocks, want = [], {"hg": "", "mm": "", "rn": ""}
    for k in range(200):
        at, hg, mm = 10 * k, "ACGT"[k % 4] * 5, "AC-TG" if k % 3 else None
        rows = [f"s hg.chr1 {at} 5 + 9999 {hg.lower()}"] + ([f"s mm.chr2 {k} 4 - 999 {mm}", f"s mm.chr9 {k} 4 - 999 TTTTT"] if mm else []) + (["s rn 0 5 + 99 GGGGG"] if k == 7 else [])
        blocks.append("a score=1\n" + "\n".join(rows) + "\n")
        want["hg"] += hg
        want["mm"] += mm or "-----"
        want["rn"] += "GGGGG" if k == 7 else "-----"
    path = put(tmp_path, "b.maf", "##maf version=1\n\n" + "\n".join(blocks[1::2] + blocks[::2]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        read = readers.maf(spark, path)
        assert read.select("block").distinct().count() == 200 and spark.read.option("lineSep", "\na").text(path).rdd.getNumPartitions() > 5
        order = {r.block: r.start for r in read.where("at = 0").collect()}
        assert [order[b] for b in range(1, 201)] == [10 * k for k in [*range(1, 200, 2), *range(0, 200, 2)]]
        assert {r.taxon: r.sequence for r in readers.alignment(spark, path).collect()} == want
        big = put(tmp_path, "b.fa", "".join(f">t{k} note\r\nAC\r\nG{'T' * (k % 5)}\r\n" for k in range(500)))
        assert {r.taxon: r.sequence for r in readers.alignment(spark, big).collect()} == {f"t{k}": "ACG" + "T" * (k % 5) for k in range(500)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_format_by_content(spark, tmp_path):
    assert readers.alignment(spark, put(tmp_path, "one", "\n 1 3\nx ACG\n")).first().sequence == "ACG"
    for text in ("", "what is this"):
        with pytest.raises(ValueError, match="no known alignment"):
            readers.alignment(spark, put(tmp_path, "odd", text))


def test_distance_matrix_must_be_square(spark, tmp_path):
    for text in ("0 1 2\n1 0 3\n", "0 1\n1 0 3\n", "0 x\nx 0\n"):
        with pytest.raises(Exception, match="no square matrix"):
            readers.distance_matrix(spark, put(tmp_path, "bad.txt", text)).collect()


def test_distance_matrix(spark, tmp_path):
    path = put(tmp_path, "d.txt", "0 1 2\n0 0 3\n0 0 0\n")
    assert sorted((r.i, r.j, r.d) for r in readers.distance_matrix(spark, path).collect()) == [(0, 1, 1.0), (0, 2, 2.0), (1, 2, 3.0)]
    assert {(r.i, r.j) for r in readers.distance_matrix(spark, path, ["a", "b", "c"]).collect()} == {("a", "b"), ("a", "c"), ("b", "c")}


def test_trees_and_stream(spark, tmp_path):
    folder = tmp_path / "trees"
    folder.mkdir()
    (folder / "one.nwk").write_text("(A:1,B:2);\n\n(A:2,B:3);\n")
    assert readers.newick_lines(spark, str(folder)).count() == 2
    with pytest.raises(Exception, match="no tree"):
        readers.newick_lines(spark, put(tmp_path, "bad.nwk", "A,B\n")).collect()
    q = stream_pair_summary(spark, str(folder)).writeStream.outputMode("complete").format("memory").queryName("pairs").start()
    q.processAllAvailable()
    (folder / "two.nwk").write_text("(A:4,(B:1,C:1):1);\n")
    q.processAllAvailable()
    q.stop()
    got = {(r.i, r.j): (r.n, r["mean"]) for r in spark.sql("SELECT * FROM pairs").collect()}
    assert got == {("A", "B"): (3, pytest.approx(14 / 3)), ("A", "C"): (1, 6.0), ("B", "C"): (1, 2.0)}


def test_stored_tables_can_be_cleared(spark):
    from cladewise.sources.shared import clear, stored

    df = stored(spark.range(5))
    assert df.count() == 5
    clear(spark)
    with pytest.raises(Exception, match="not exist|no such|FILE_NOT_EXIST|not found"):
        df.count()
