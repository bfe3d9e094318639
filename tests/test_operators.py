"""Operators on hand-made frames: golden graphs, invariants, edge cases."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from isoloom.functions import sequence
from isoloom.operators import assembly, evaluation, psi, structure, variants
from isoloom.sources import readers, sinks


def logit(p: float) -> float:
    return math.log(p / (1 - p))


def tracks(spark, strand, **peaks):
    rows = [("l", strand, t, pos, logit(0.99) if pos in at else logit(0.01)) for t, at in peaks.items() for pos in range(0, 160)]
    return spark.createDataFrame(rows, "locus string, strand string, track string, pos long, logit double")


def graph(spark, strand, config, **peaks):
    found = assembly.peaks(tracks(spark, strand, **peaks), config)
    nodes = assembly.exons(found, config)
    links = assembly.edges(nodes, found, config)
    return {(r["start"], r["end"]) for r in nodes.collect()}, {((r["src_start"], r["src_end"]), (r["dst_start"], r["dst_end"])) for r in links.collect()}


CONFIG = assembly.Config(thresholds=dict.fromkeys(("donor", "acceptor", "tss", "polya"), 0.8), min_exon=5, max_intron=100)


def test_peaks(spark):
    rows = [("l", "+", "tss", i, x) for i, x in enumerate([2.2, 1.4, 2.9, 1.1])]
    df = spark.createDataFrame(rows, "locus string, strand string, track string, pos long, logit double")
    got = assembly.peaks(df, assembly.Config(thresholds={"tss": 0.7}, max_starts=2)).collect()
    assert {r["pos"] for r in got} == {0, 2}
    assert assembly.peaks(df, assembly.Config(thresholds={"tss": 0.99})).count() == 0


# Peaks, and the graphs and chains that must come of them.


def test_graph_plus(spark):
    nodes, links = graph(spark, "+", CONFIG, donor=[20, 40], acceptor=[10, 30], tss=[5], polya=[50])
    assert nodes == {(10, 20), (10, 40), (30, 40), (5, 20), (5, 40), (10, 50), (30, 50), (5, 50)}
    assert ((10, 20), (30, 40)) in links and len(links) == 4


def test_graph_minus(spark):
    nodes, links = graph(spark, "-", CONFIG, donor=[10, 30], acceptor=[20, 40], tss=[50], polya=[5])
    assert len(nodes) == 8
    assert {((30, 40), (10, 20)), ((30, 50), (10, 20)), ((30, 50), (5, 20))} <= links
    assert all(a[0] >= b[1] for a, b in links)


def test_paths(spark):
    nodes = spark.createDataFrame([("l", "+", 10, 20, 0.9), ("l", "+", 30, 40, 0.8), ("l", "+", 30, 45, 0.7), ("l", "+", 50, 60, 0.9)], "locus string, strand string, start long, end long, score double")
    e = [((10, 20), (30, 40)), ((10, 20), (30, 45)), ((30, 40), (50, 60)), ((30, 45), (50, 60))]
    score = {(10, 20): 0.9, (30, 40): 0.8, (30, 45): 0.7, (50, 60): 0.9}
    links = spark.createDataFrame([("l", "+", *a, *b, score[a], score[b], 0.0) for a, b in e], "locus string, strand string, src_start long, src_end long, dst_start long, dst_end long, src_score double, dst_score double, score double")
    p = assembly.paths(nodes, links, CONFIG).orderBy("rank").collect()
    assert len(p[0]["exons"]) == 1 and p[0]["score"] == pytest.approx(0.9)
    assert [x["start"] for x in next(r for r in p if len(r["exons"]) > 1)["exons"]][:2] == [10, 30]
    assert len(p) == 5
    assert assembly.paths(nodes, links, assembly.Config(max_paths=1)).count() == 1
    assert assembly.paths(nodes.limit(0), links.limit(0), CONFIG).count() == 0


def test_long_chain_is_found_whole(spark):
    n = 100
    nodes = spark.createDataFrame([("l", "+", 10 * k, 10 * k + 5, 0.9) for k in range(n)], "locus string, strand string, start long, end long, score double")
    links = spark.createDataFrame([("l", "+", 10 * k, 10 * k + 5, 10 * k + 10, 10 * k + 15, 0.9, 0.9, 0.9) for k in range(n - 1)], "locus string, strand string, src_start long, src_end long, dst_start long, dst_end long, src_score double, dst_score double, score double")
    found = assembly.paths(nodes, links, assembly.Config(max_paths=1000, beam=2))
    assert max(len(r["exons"]) for r in found.collect()) == n


def peaked(spark, strand, length, **peaks):
    rows = [("l", strand, t, pos, dict(at).get(pos, -10.0)) for t, at in peaks.items() for pos in range(length)]
    return spark.createDataFrame(rows, "locus string, strand string, track string, pos long, logit double")


def chain(row):
    return [(e["start"], e["end"]) for e in row["exons"]]


def test_minus_strand_isoform_runs_down(spark):
    t = peaked(spark, "-", 200, donor=[(150, 5.0)], acceptor=[(120, 5.0)], tss=[(170, 5.0)], polya=[(100, 5.0)])
    best = assembly.decode(t, assembly.Config(min_exon=10, beam=2, w_tss=0.0, w_pa=0.0, w_orf=0.0, w_len=0.0)).where("iso_rank = 1").first()
    assert chain(best) == [(150, 170), (100, 120)]


def test_minus_strand_orf(spark):
    coding = "A" * 50 + "TTA" + "A" * 18 + "CAT" + "A" * 27  # read backwards: ATG ... TAA
    rows = [("coding", coding, [(40, 80)]), ("none", "CGT" * 50, [(60, 100), (10, 50)])]
    df = spark.createDataFrame(rows, "id string, seq string, exons array<struct<start:bigint,end:bigint>>")
    cdna = df.select("id", sequence.spliced_cdna(F.col("exons"), F.col("seq"), F.lit("-")).alias("cdna"), F.lit(None).cast("long").alias("last_junction"))
    got = {r["id"]: r["s_orf"] for r in assembly.orf_from_sequence(cdna, ["id"], 5).collect()}
    assert got["coding"] > 0.5 and got["none"] == 0


def test_true_chain_ranks_first(spark):
    t = peaked(spark, "+", 600, donor=[(200, 5.0), (400, 2.0)], acceptor=[(300, 5.0), (100, 2.0)], tss=[(50, 5.0)], polya=[(500, 5.0)])
    best = assembly.decode(t, assembly.Config(w_orf=0.0)).where("iso_rank = 1").first()
    assert chain(best) == [(50, 200), (300, 500)]


def test_hinge_equals_all_pairs(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(4), round(rng.uniform(-2, 2), 1), rng.randrange(2)) for _ in range(300)] + [(9, 1.0, 1), (None, 1.0, 1)]
    pairs = [max(0.0, 1.0 - (p - n)) for a, p, x in rows for b, n, y in rows if a == b and a is not None and x == 1 and y == 0]
    df = spark.createDataFrame(rows, "locus int, score double, label int")
    assert evaluation.hinge(df).first()[0] == pytest.approx(sum(pairs) / len(pairs))
    assert evaluation.hinge(df.limit(0)).first()[0] == 0.0


def test_fasta_in_chunks(spark, tmp_path):
    rng = random.Random(8)
    contigs = {f"chr{k}": "".join(rng.choices("ACGTN", k=n)) for k, n in enumerate((0, 1, 59, 60, 61, 2500, 7, 900))}
    text = "".join(f">{name} x\n" + "".join(seq[k : k + 60].lower() + "\n" for k in range(0, len(seq), 60)) for name, seq in contigs.items())
    (tmp_path / "a.fa").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (before, "300", "700"):  # one block of the file, or many
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = readers.read_fasta_chunks(spark, str(tmp_path / "a.fa"), 100).orderBy("chunk_id").collect()
            got = {}
            for r in rows:
                assert r["chunk_start"] == 100 * r["chunk_id"] == len(got.get(r["chrom"], "")) and len(r["chunk"]) <= 100
                got[r["chrom"]] = got.get(r["chrom"], "") + r["chunk"]
            assert got == {k: v for k, v in contigs.items() if v}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_orf_from_sequence(spark):
    body = "CCC" * 60
    rows = [("strong", "GCCACCATGG" + body[:-1] + "TAA", None), ("weak", "TTTTTTATGT" + body[:-1] + "TAA", None), ("early", "GCCACCATGG" + "CC" + "TAA" + "C" * 400, 300), ("none", "CCCCCC", None), ("empty", "", None)]
    df = spark.createDataFrame(rows, "id string, cdna string, last_junction long")
    got = {r["id"]: r["s_orf"] for r in assembly.orf_from_sequence(df, ["id"], 10, 1000).collect()}
    assert got["strong"] == pytest.approx(1.0) and got["weak"] == pytest.approx(0.8)
    assert got["early"] < 0.3 and got["none"] == 0 and got["empty"] == 0


def junction_rows(spark):
    rows = [("s1", "c", "+", 10, 20, 6), ("s1", "c", "+", 10, 30, 18), ("s2", "c", "+", 10, 20, 1), ("s1", "c", "-", 10, 20, 0)]
    return spark.createDataFrame(rows, "sample_id string, chrom string, strand string, donor long, acceptor long, count long")


def test_psi(spark):
    got = {(r["sample_id"], r["strand"], r["acceptor"]): r["psi_donor"] for r in psi.psi(junction_rows(spark)).collect()}
    assert got["s1", "+", 20] == 0.25 and got["s1", "+", 30] == 0.75 and got["s2", "+", 20] == 1.0
    assert got["s1", "-", 20] is None
    gated = psi.psi(junction_rows(spark), 20).where("sample_id = 's2'").first()
    assert gated["psi_donor"] is None and gated["donor_total"] == 1


def test_gene_ties_and_gaps(spark):
    genes = spark.createDataFrame([("b", "c", "+", 5, 60), ("a", "c", "+", 5, 60), ("z", "c", "+", 0, 15), ("q", "c", "-", 0, 99)], "gene_id string, chrom string, strand string, start long, end long")
    got = {(r["sample_id"], r["strand"], r["acceptor"]): r["gene_id"] for r in psi.with_gene(junction_rows(spark), genes, width=8).collect()}
    assert got["s1", "+", 20] == "a" and got["s1", "-", 20] == "q"
    none = psi.with_gene(junction_rows(spark), genes.limit(0))
    assert none.count() == 4 and none.where("gene_id IS NOT NULL").count() == 0


def test_selection_invariants(spark):
    rows = [("c", 1 + (7 * i) % 90, "A" if i % 3 else "ACGTAC", "T" if i % 3 == 1 else ("AGG" if i % 3 == 2 else "A"), 200) for i in range(60)]
    v = variants.typed(spark.createDataFrame(rows, "chrom string, pos int, ref string, alt string, length long").drop("length"))
    placed = variants.in_windows(v, spark.createDataFrame([("c", 200)], "chrom string, length long"), 100, 50)
    for seed in (1, 2):
        chosen = variants.balanced(placed, 9, seed).collect()
        for start in {r["start"] for r in chosen}:
            here = sorted((r["span_start"], r["span_end"]) for r in chosen if r["start"] == start)
            assert 0 < len(here) <= 9
            assert all(a[1] <= b[0] for a, b in zip(here, here[1:], strict=False))


def test_sites_of_one_exon(spark):
    e = spark.createDataFrame([("t", "c", "-", 10, 20)], "tx string, chrom string, strand string, start long, end long")
    assert {(r["kind"], r["pos"]) for r in structure.sites(e).collect()} == {("tss", 19), ("polya", 10)}
    assert structure.introns(e).count() == 0


def test_evaluation_edges(spark):
    ex = "array<struct<start:bigint,end:bigint>>"
    truth = spark.createDataFrame([(1, "+", [(100, 200), (300, 400)]), (2, "+", [(1, 9)]), (3, "-", [(1, 9), (20, 30)])], f"example long, strand string, exons {ex}")
    pred = spark.createDataFrame([(1, 1, "+", [(100, 202), (300, 400)]), (1, 2, "+", [(100, 200), (300, 400)]), (2, 1, "+", [(1, 9)])], f"example long, rank int, strand string, exons {ex}")
    rows = {r["example"]: r for r in evaluation.evaluate(pred, truth, k=2).collect()}
    assert (rows[1]["chain"], rows[1]["f1"], rows[1]["topk"]) == (0.0, 0.0, 1.0)
    assert (rows[2]["chain"], rows[2]["precision"], rows[2]["topk"]) == (1.0, 1.0, 1.0)
    assert (rows[3]["chain"], rows[3]["f1"], rows[3]["topk"]) == (0.0, 0.0, 0.0)
    assert {r["example"]: r["chain"] for r in evaluation.evaluate(pred, truth, k=2, slop=2).collect()}[1] == 1.0
    assert evaluation.means(evaluation.evaluate(pred, truth.limit(0))).first()["n"] == 0


def test_auroc_of_one_class(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 1)], "score double, label int")
    assert evaluation.auroc(df, "score", "label").first()["auroc"] is None


def test_readers(spark, tmp_path):
    (tmp_path / "g.gct").write_text("#1.2\n2\t2\nName\tDescription\ta\tb\nchr1:1-2:+\tg\t3.9\tx\nchr1_3_4\tg\t5\nbad\tg\t1\t2\t3\t4\nnoid\tg\t1\t1\t\n")
    good, bad = readers.gct_junctions(readers.read_gct(spark, str(tmp_path / "g.gct")))
    assert {(r["donor"], r["sample_id"]): r["count"] for r in good.collect()} == {(1, "a"): 3, (1, "b"): 0, (3, "a"): 5, (3, "b"): 0}
    assert bad.count() == 2
    (tmp_path / "x.gct").write_text("#9\n")
    with pytest.raises(ValueError):
        readers.read_gct(spark, str(tmp_path / "x.gct"))
    (tmp_path / "s.fa").write_text(">chr1 desc\nacg\nTTT\n>other\nAA\n")
    assert {r["chrom"]: r["seq"] for r in readers.read_fasta(spark, str(tmp_path / "s.fa")).collect()} == {"chr1": "ACGTTT", "other": "AA"}
    sinks.write_parquet(spark.range(3), str(tmp_path / "p"))
    with pytest.raises(Exception, match="(?i)already exists"):
        sinks.write_parquet(spark.range(3), str(tmp_path / "p"))
    with pytest.raises(ValueError):
        readers.read_shards(spark, str(tmp_path / "p"), ["nope"])
    with pytest.raises(ValueError):
        readers.read_junctions(spark, [str(tmp_path / "p.xyz")])


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() >= 0 and "gene_id" in df.columns
