import pytest
from pyspark.sql import functions as F

from loomery.sources import fasta, markup, tabular


def test_fasta_round_trip(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one first\r\nACGT\r\nAC\n>two\n\n>three\nTTT")
    got = fasta.read(spark, f"{tmp_path}/a.fa")
    assert {tuple(r) for r in got.collect()} == {("one first", "ACGTAC"), ("two", ""), ("three", "TTT")}
    fasta.write(got, f"{tmp_path}/out", "gzip")
    assert {tuple(r) for r in fasta.read(spark, f"{tmp_path}/out").collect()} == {tuple(r) for r in got.collect()}
    assert fasta.read(spark, f"{tmp_path}/a.fa", first_word=True).where("header = 'one'").count() == 1


def test_fasta_lines(spark):
    lines = lambda *x: spark.createDataFrame(list(enumerate(x)), "n int, value string")
    assert fasta.is_single_line(lines(">a", "AC", ">b", "GG")).first().ok
    assert not fasta.is_single_line(lines(">a", "AC", "GG")).first().ok
    assert [r[0] for r in fasta.headers(lines(">a x", "AC", ">b"), 4).collect()] == ["a   ", "b   "]


def test_tables(spark, tmp_path):
    (tmp_path / "h.m8").write_text("q\tt\t98.5\t10\t0\t0\t1\t10\t5\t14\t1e-5\t50\n")
    assert tabular.read_hits(spark, f"{tmp_path}/h.m8").first().pident == 98.5
    (tmp_path / "n.dmp").write_text("1\t|\troot\t|\t\t|\n2\t|\tx y\t|\tz\t|\n")
    assert {tuple(r) for r in tabular.read_piped(spark, f"{tmp_path}/n.dmp", ["id", "name", "cls"]).collect()} == {("1", "root", ""), ("2", "x y", "z")}
    (tmp_path / "s.sam").write_text("@HD\nq1\t0\tt1\trest\tmore\nq2\t4\tt2\tr\n")
    drop = spark.createDataFrame([("t2",)], "target string")
    assert [r.query for r in tabular.read_sam(spark, f"{tmp_path}/s.sam", drop).collect()] == ["q1"]


def test_names(spark):
    df = spark.createDataFrame([("x_1.fastq.gz",), ("x_2.fastq.gz",), ("x.fastq.gz",)], "n string")
    assert [r[0] for r in df.select(tabular.mapped_name(F.col("n"))).collect()] == ["x.pair.1.fq.gz", "x.pair.2.fq.gz", "x.single.fq.gz"]
    with pytest.raises(Exception, match="unexpected file name"):
        spark.createDataFrame([("x.txt",)], "n string").select(tabular.mapped_name(F.col("n"))).collect()


def test_mirror(spark, tmp_path):
    import hashlib

    (tmp_path / "f").write_bytes(b"abc")
    m = spark.createDataFrame([("f", 3, hashlib.md5(b"abc").hexdigest()), ("g", 3, "x"), ("f", 3, "bad")], "name string, bytes bigint, md5 string")
    assert sorted((r.name, r.ok) for r in tabular.mirror_state(spark, f"{tmp_path}/*", m).collect()) == [("f", False), ("f", True), ("g", False)]


def test_gene_report(spark):
    text = (
        "FASTA definition line: c1 len=9\nPredicted genes\n   Gene Strand LeftEnd RightEnd\n   #\n 1 + 3 50 48 1\n 2 - <1 90 90 1\n\nPredicted proteins:\n>gene_1|x\nMK\n\n"
        "Nucleotide sequence of predicted genes:\n>gene_1|GM|48_nt\nACG\nT\n\n>gene_2|GM\nGG\n\nFASTA definition line: c2\nPredicted genes\n   Gene\n   #\n 3 + 5 >70 66 1\n"
    )
    df = spark.createDataFrame([("s-assembled", text), ("t", None)], "sample string, text string")
    got = tabular.gene_reports(df).collect()
    assert [(r.gene, r.contig, r.strand, r.start, r.end, r.complete) for r in got] == [("s_1", "c1", "+", 3, 50, True), ("s_2", "c1", "-", 1, 90, False), ("s_3", "c2", "+", 5, 70, False)]
    assert [(r.gene, r.seq) for r in tabular.gene_sequences(df).collect()] == [("s_1", "ACGT"), ("s_2", "GG")]


def test_markup(spark):
    xml = "<S><A><TAG>x</TAG><VALUE>1</VALUE></A><A><TAG>y</TAG><VALUE>2</VALUE></A><XREF_LINK><DB>D</DB><ID>R1</ID></XREF_LINK></S>"
    df = spark.createDataFrame([(xml,)], "x string")
    assert df.select(markup.tag_values(F.col("x"), "A")).first()[0] == {"x": "1", "y": "2"}
    assert df.select(markup.link_of(F.col("x"), "D"), markup.link_of(F.col("x"), "E")).first() == ("R1", None)
    with pytest.raises(Exception, match="missing study"):
        df.select(markup.required(markup.link_of(F.col("x"), "E"), "study")).collect()


def test_fasta_errors(spark, tmp_path):
    for name, text, fault in (("a", ">one\nAC\n\n>two\nG\n", "empty line"), ("b", "AC\n>one\nG\n", "before the first"), ("c", "\n>one\nG\n", "empty line")):
        (tmp_path / f"{name}.fa").write_text(text)
        with pytest.raises(ValueError, match=fault):
            fasta.read(spark, f"{tmp_path}/{name}.fa", strict=True)
    (tmp_path / "d.fa").write_text(">one\nAC\n>two\nG\n")
    (tmp_path / "e.fa").write_text("")
    assert fasta.read(spark, f"{tmp_path}/[de].fa", strict=True).count() == 2


def test_mirror_packs_small_files(spark, tmp_path, monkeypatch):
    """As many files as suppliers would cost the store several calls for each; a supplier without a name lands empty."""
    from loomery.plans import source_queries

    names = [(k, f"Supplier#{k}" if k % 7 else None) for k in range(300)]
    supplier = spark.createDataFrame(names, "s_suppkey bigint, s_name string").coalesce(2)
    monkeypatch.setattr(source_queries, "table", lambda *_: supplier)
    monkeypatch.setattr("loomery.runtime.shared_dir", lambda *_: f"file://{tmp_path}")
    got = {r.name: r.ok for r in source_queries.mirror_manifest(spark, "").collect()}
    assert got == {f"r{k}{('.single.fq.gz', '.pair.1.fq.gz', '.pair.2.fq.gz')[k % 3]}": k % 5 > 0 for k, _ in names}
    assert 0 < sum(1 for p in tmp_path.rglob("part-*")) < 10
