"""Text and matrix sources, the bundle, sinks, and the command line on small files."""

import gzip
import hashlib
import json
import types

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from countaxis import api, cli
from countaxis.sources import bundle, matrices, panel, sinks, tables


@pytest.fixture
def folder(tmp_path):
    """Four features of which one is no expression, two cells."""
    m = tmp_path / "m"
    m.mkdir()
    with gzip.open(m / "features.tsv.gz", "wt") as f:
        f.write("ENSG2.3\tB\tGene Expression\nAB1\tAB1\tAntibody Capture\nENSG1.1\tA\tGene Expression\nENSG9\tZ\tGene Expression\n")
    (m / "barcodes.tsv").write_text("01\nc2\n")
    (m / "matrix.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n%\n4 2 8\n1 1 20\n1 2 10\n2 1 500\n3 1 30\n3 1 10\n3 2 30\n4 1 60\n4 2 50\n")
    (tmp_path / "cells.csv").write_text("cell_barcode,lineage_barcode\nc2,x\n01,y\n")
    (tmp_path / "genes.tsv").write_text("gene\tchromosome\tstart\tend\nENSG1\t1\t9\t11\nENSG2\tchr1\t20\t20\nENSG7\t2\t5\t7\n")
    (tmp_path / "reference.csv").write_text("gene,fraction\nENSG1.4,0.2\nENSG2,0.1\nENSG9,0\n")
    (tmp_path / "alleles.tsv").write_text("cell\tCHROM\tPOS\tAD\tDP\tGT\tcM\n01\t1\t15\t7\t10\t1|0\t0.5\nc2\tchr1\t15\t2\t8\t1|0\t0.5\nzz\t1\t99\t1\t1\t1|0\t9\n")
    return tmp_path


def test_load_write_read(spark, folder):
    b = bundle.load(spark, str(folder / "m"), str(folder / "cells.csv"), str(folder / "genes.tsv"), str(folder / "reference.csv"), str(folder / "alleles.tsv"))
    bundle.write(b, str(folder / "b"))
    with pytest.raises(Exception, match="exist"):
        bundle.write(b, str(folder / "b"))
    b = bundle.read(spark, str(folder / "b"))
    assert {r.cell: r.library for r in b.cells.collect()} == {"01": 120.0, "c2": 90.0}
    assert {(r.gene, r.cell): r.n for r in b.expression.collect()} == {("ENSG1", "01"): 40, ("ENSG1", "c2"): 30, ("ENSG2", "01"): 20, ("ENSG2", "c2"): 10}
    assert [(r.marker, r.chrom, r.start) for r in b.grid.orderBy("marker").collect()] == [(0, "chr1", 10), (1, "chr1", 15), (2, "chr1", 20)]
    assert {(r.cell, r.h1, r.h2) for r in b.alleles.collect()} == {("01", 7, 3), ("c2", 2, 6)}
    assert {(r.group, r.gene): r.expected for r in b.pseudobulk().collect()} == {("y", "ENSG1"): 24.0, ("x", "ENSG1"): 18.0, ("y", "ENSG2"): 12.0, ("x", "ENSG2"): 9.0}
    labels = spark.createDataFrame([("x", 1)], "barcode string, group int")
    assert {r.group for r in b.pseudobulk(labels).collect()} == {1}
    assert [(r.population_phase, r.het, r.genetic_cm, r.marker) for r in b.loci.collect()] == [(0.99, 1.0, 0.5, 1)]


def test_loading_refuses(spark, folder):
    m, c, g = str(folder / "m"), str(folder / "cells.csv"), str(folder / "genes.tsv")
    frame = lambda rows: spark.createDataFrame(rows, "cell string, barcode string")
    with pytest.raises(ValueError, match="isn't in the matrix"):
        bundle.load(spark, m, frame([("nope", "x")]), g)
    with pytest.raises(ValueError, match="repeated"):
        bundle.load(spark, m, frame([("01", "x"), ("01", "y")]), g)
    with pytest.raises(ValueError, match="more than one"):
        tables.reference(spark, {"a": 0.7, "b": 0.6})
    with pytest.raises(ValueError, match="map"):
        bundle.load(spark, m, c, g, None, spark.createDataFrame([("01", "1", "15", "1", "2")], "cell string, chrom string, position string, h1 string, h2 string"))
    with pytest.raises(ValueError, match="differ"):
        bundle.load(spark, m, c, g, None, spark.createDataFrame([("01", "1", "15", "1", "2", "1"), ("c2", "1", "15", "1", "2", "2")], "cell string, chrom string, position string, h1 string, h2 string, genetic_cm string"))
    with pytest.raises(ValueError, match="ambiguous"):
        tables.genes(spark, spark.createDataFrame([("ENSG1.1", "1", "5"), ("ENSG1.2", "1", "6")], "gene string, chrom string, position string"))
    with pytest.raises(ValueError, match="no shared gene"):
        bundle.load(spark, m, c, g, {"ENSG77": 0.2})


def test_profiles_annotation_and_map(spark, tmp_path):
    assert {r.gene: r.fraction for r in tables.reference(spark, spark.createDataFrame([("a", "3"), ("b", "1")], "gene string, expression string")).collect()} == {"a": 0.75, "b": 0.25}
    (tmp_path / "a.gtf").write_text('#c\n1\ts\tgene\t10\t21\t.\t+\t.\tgene_id "ENSG5.2"; x "y";\n1\ts\texon\t10\t21\t.\t+\t.\tgene_id "ENSG6";\n')
    assert [tuple(r) for r in tables.genes(spark, str(tmp_path / "a.gtf")).collect()] == [("ENSG5", "chr1", 15)]
    maps = tmp_path / "maps"
    (maps / "deep").mkdir(parents=True)
    (maps / "deep" / "one.map").write_text("1 . 0.5 100\n1 . 0.9 300\n")
    (maps / "two.map").write_text("chr2 . 0 5\n1 . 0.5 100\n")
    assert {tuple(r) for r in tables.genetic_map(spark, str(maps)).collect()} == {("chr1", 100, 0.5), ("chr1", 300, 0.9), ("chr2", 5, 0.0)}
    (maps / "two.map").write_text("1 . 0.1 200\n")
    with pytest.raises(ValueError, match="go up"):
        tables.genetic_map(spark, str(maps))


def test_phased_sites_and_pooled_genotypes(spark, tmp_path):
    head = "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tD\n"
    line = lambda *f: "\t".join(f) + "\n"
    p = tmp_path / "p.vcf"
    p.write_text(head + line("1", "10", ".", "A", "C", ".", ".", ".", "GT:GP:PQ", "1|0:0.1,0.8,0.1:20") + line("1", "20", ".", "A", "C", ".", ".", ".", "GT:GQ", "0|1:99") + line("1", "30", ".", "A", "CT", ".", ".", ".", "GT", "0|1") + line("1", "40", ".", "A", "C", ".", ".", ".", "GT", "1|1"))
    got = {r.position: (r.gt, r.het, r.phase) for r in tables.phased_sites(spark, str(p)).collect()}
    assert got == {10: ("1|0", 0.8, pytest.approx(0.99)), 20: ("0|1", 1.0, 0.99)}
    c = tmp_path / "c.vcf"
    c.write_text("".join(line("chr2", str(i), ".", "A", "G", ".", ".", f"AD={a};DP={d};OTH={o}") for i, (a, d, o) in enumerate([(5, 10, 0), (10, 10, 0), (1, 100, 0), (5, 10, 2)], 1)))
    calls = tables.pooled_genotypes(spark, str(c))
    assert {r.position: r.gt for r in calls.collect()} == {1: "0/1", 2: "1/1"}
    sinks.genotypes(calls, str(tmp_path / "out"))
    text = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert text[0].startswith("##fileformat") and text[-1] == "chr2\t2\t.\tA\tG\t.\tPASS\t.\tGT\t1/1"
    c.write_text(line("2", "1", ".", "A", "G", ".", ".", "AD=5;DP=3"))
    with pytest.raises(ValueError, match="impossible"):
        tables.pooled_genotypes(spark, str(c))
    p.write_text(head)
    with pytest.raises(ValueError, match="no phased"):
        tables.phased_sites(spark, str(p))


def test_allele_folder(spark, tmp_path):
    f = tmp_path / "a"
    f.mkdir()
    (f / "cellSNP.samples.tsv").write_text("c2\nc1\n")
    (f / "cellSNP.base.vcf").write_text("##h\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n1\t10\t.\tA\tC\t.\t.\t.\n1\t20\t.\tG\tT\t.\t.\t.\n1\t30\t.\tG\tT\t.\t.\t.\n")
    mtx = "%%MatrixMarket matrix coordinate integer general\n3 2 {}\n{}\n"
    (f / "cellSNP.tag.AD.mtx").write_text(mtx.format(2, "1 1 3\n2 2 1"))
    (f / "cellSNP.tag.DP.mtx").write_text(mtx.format(4, "1 1 4\n1 2 2\n2 2 3\n3 1 5"))
    phased = tmp_path / "p.vcf"
    phased.write_text("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tD\n1\t10\t.\tA\tC\t.\t.\t.\tGT\t1|0\n1\t20\t.\tG\tT\t.\t.\t.\tGT\t0|1\n1\t30\t.\tG\tA\t.\t.\t.\tGT\t0|1\n")
    cells = spark.createDataFrame([("c1",), ("c2",)], "cell string")
    out = matrices.allele_folder(spark, str(f), str(phased), cells)
    assert {(r.cell, r.position, r.h1, r.h2) for r in out.collect()} == {("c2", 10, 3, 1), ("c1", 10, 0, 2), ("c1", 20, 2, 1)}
    sinks.alleles(out, str(tmp_path / "out"))
    assert tables.delimited(spark, str(tmp_path / "out"), "\t").count() == 3
    with pytest.raises(ValueError, match="selected"):
        matrices.allele_folder(spark, str(f), str(phased), cells.limit(1))
    (f / "cellSNP.tag.AD.mtx").write_text(mtx.format(1, "1 1 9"))
    with pytest.raises(ValueError, match="more alternative"):
        matrices.allele_folder(spark, str(f), str(phased), cells)


def test_annotated_matrix(spark):
    a = types.SimpleNamespace(X=np.array([[1, 0], [2, 5], [4, 4]]), layers={"raw": np.array([[9, 9]] * 3)}, raw=None, obs=pd.DataFrame({"total": [10.0, 20.0, 30.0]}, index=["c3", "c1", "c9"]), var=pd.DataFrame({"id": ["ENSG1.2", "ENSG2.1"]}, index=["A", "B"]))
    cells = spark.createDataFrame([("c1", "x"), ("c3", "y"), ("other", "z")], "cell string, barcode string")
    counts, features, kept = matrices.annotated(spark, a, cells, gene_column="id", library_column="total")
    assert [(r.cell, r.library) for r in kept.orderBy("idx").collect()] == [("c3", 10.0), ("c1", 20.0)] and {r.gene for r in features.collect()} == {"ENSG1", "ENSG2"}
    assert {(r.gene, r.cell): r.n for r in counts.collect()} == {("ENSG1", "c3"): 1, ("ENSG1", "c1"): 2, ("ENSG2", "c1"): 5}
    assert {r.cell: r.library for r in matrices.annotated(spark, a, cells)[2].collect()} == {"c3": 1.0, "c1": 7.0}
    with pytest.raises(ValueError):
        matrices.annotated(spark, a, cells, layer="raw", raw=True)


def test_panel_checks_members(spark, tmp_path):
    (tmp_path / "panel.toml").write_text('schema_version = 1\nunits = "fraction"\n')
    (tmp_path / "profiles.tsv").write_text("profile\tname\na\tA\n")
    (tmp_path / "expression.tsv").write_text("gene\tprofile\tfraction\ng\ta\t0.25\nh\ta\t0.75\n")
    digests = {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in tmp_path.iterdir()}
    write = lambda d: (tmp_path / "dataset.toml").write_text("[files]\n" + "".join(f'"{k}" = "{v}"\n' for k, v in d.items()))
    write(digests)
    rows, profiles, about = panel.read(spark, str(tmp_path))
    assert rows.count() == 2 and profiles.count() == 1 and about["units"] == "fraction"
    for bad in (digests | {"expression.tsv": "0"}, digests | {"../x": "0"}):
        write(bad)
        with pytest.raises(ValueError):
            panel.read(spark, str(tmp_path))


def test_sinks(spark, tmp_path):
    frame = spark.createDataFrame([("a", 1)], "k string, v int")
    sinks.table(frame.limit(0), str(tmp_path / "empty"))
    assert spark.read.option("header", True).csv(str(tmp_path / "empty")).columns == ["k", "v"]
    sinks.small_table(frame, str(tmp_path / "t.csv.gz"))
    with pytest.raises(FileExistsError):
        sinks.small_table(frame, str(tmp_path / "t.csv.gz"))
    sinks.described(tmp_path / "run.json", {"a": 1})
    assert json.loads((tmp_path / "run.json").read_text()) == {"a": 1} and len(list(tmp_path.glob("tmp*"))) == 0
    two = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2)], "k string, v int")
    assert sinks.digest(two) == sinks.digest(two.orderBy(F.desc("k")).repartition(3)) != sinks.digest(frame)


def test_digests_tell_tables_apart(spark):
    of = lambda rows, names="k string, v string": sinks.digest(spark.createDataFrame(rows, names))
    rows = [("a", "bc"), ("ab", "c"), (None, ""), ("", None)]
    assert of(rows) == of(rows[::-1]) and len(of([])) == 32
    other = [of(rows[:1]), of(rows[1:2]), of(rows[2:3]), of(rows[3:]), of(rows), of(rows + rows), of(rows + rows[:1]), of([]), of([], "k string, w string"), of([], "k string, v int")]
    assert len(set(other)) == len(other)
    parts = spark.createDataFrame([("a", [1.5, None], 1e300), ("b", None, float("nan"))], "k string, x array<double>, y double")
    assert sinks.digest(parts) == sinks.digest(parts.repartition(3, "k").select("y", "x", "k"))


def test_fit_folder_tells_each_genes_part(spark, tmp_path):
    from countaxis.operators import mixture

    panel = spark.createDataFrame([(f"g{i}", k, (1 + (i * j) % 5) / 100) for i in range(20) for j, k in enumerate("ab")] + [("rare", "a", 1e-9)], "gene string, profile string, fraction double")
    counts = spark.createDataFrame([(f"g{i}", 50 + i) for i in range(15)] + [("rare", 2), ("own", 5)], "gene string, n long")
    genes = spark.createDataFrame([(f"g{i}", "chr1", i + 1) for i in range(20)] + [("rare", "chr2", 1)], "gene string, chrom string, position long")
    fit = mixture.fit_reference(counts, panel, genes)
    sinks.fit(fit, str(tmp_path / "fit"))
    part = dict(line.split("\t") for line in (tmp_path / "fit" / "genes.tsv").read_text().splitlines()[1:])
    assert part == {f"g{i}": "fitted" if i < 15 else "absent_from_counts" for i in range(20)} | {"rare": "shared", "own": "absent_from_panel"}
    about = json.loads((tmp_path / "fit" / "fit.json").read_text())
    assert about["profile_digest"] == sinks.digest(fit.profile) and about["absent"] == 1 and about["genes"] == 15


def test_command_line(spark, folder, capsys):
    out = str(folder / "made")
    base = ["--matrix", str(folder / "m"), "--cells", str(folder / "cells.csv"), "--genes", str(folder / "genes.tsv")]
    assert cli.main(["prepare", *base, "--reference", str(folder / "reference.csv"), "--alleles", str(folder / "alleles.tsv"), "--out", out]) == 0
    assert cli.main(["signal", out, "--permutations", "3"]) == 0
    assert 0 < json.loads(capsys.readouterr().out.strip().splitlines()[-1])["p_value"] <= 1
    assert cli.main(["signal", str(folder / "m"), "--permutations", "0"]) == 1 and cli.main(["infer"]) == 2
    with pytest.raises(ValueError):
        api.Settings(bootstraps=5)
