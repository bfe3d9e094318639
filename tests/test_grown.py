"""Cases that only larger tables have: loci cut off by a table's end, many overlapping genes, long sequences, large shards."""

from __future__ import annotations

import json
import os
import random
import re
import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from oracle import TABLES, compare
from pyspark.sql import functions as F

from isoloom.functions import ids
from isoloom.operators import assembly, dominance, intervals, variants
from isoloom.plans import fixtures, io_queries, registry
from isoloom.sources import bgzf, readers, sinks
from isoloom.streaming import rewindow

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def cut_off(tmp_path_factory):
    """The smallest tables with a last locus that has donors and acceptors, but neither starts nor ends."""
    import duckdb

    path = tmp_path_factory.mktemp("cut-off")
    duckdb.connect().execute(f"COPY (SELECT * FROM '{SF}/embeddings.parquet' WHERE vec_id < 98) TO '{path}/embeddings.parquet'")
    for t in TABLES:
        if t != "embeddings":
            os.symlink(f"{SF}/{t}.parquet", path / f"{t}.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["g3_path_scores", "w3_softmax_psi", "w4_dominant", "g7_decode", "g7_decode_with_orf", "g8_locus_summary"])
def test_locus_without_starts_and_ends(spark, cut_off, name):
    compare(spark, registry.QUERIES[name], registry.ORACLES[name], cut_off)


def test_overlaps_are_counted_without_pairs(spark):
    """Ranges of a few rows, equal names and places, an empty interval and null keys."""
    rng = random.Random(11)
    rows = [(rng.choice("ab"), str(rng.randrange(150)), s, s + rng.choice([0, 1, 5, 40, 300])) for s in (rng.randrange(200) for _ in range(300))] + [(None, "x", 0, 9), ("a", None, 0, 9)]
    df = spark.createDataFrame(rows, "k string, g string, start long, end long")
    want: dict = {}
    for k, g, s, e in rows[:300]:
        n = sum(k == k2 and g < g2 and s < e2 and s2 < e and s < e and s2 < e2 for k2, g2, s2, e2 in rows[:300])
        want[g] = want.get(g, 0) + n
    for size in (70, 10**6):
        got = {r["g"]: r["n"] for r in dominance.later_overlaps(df, ["k"], "g", range_rows=size).collect()}
        assert got == {g: n for g, n in want.items() if n}


def test_overlaps_of_many_genes(spark):
    """20,000 genes in one place are 200 million pairs."""
    df = spark.range(20_000).selectExpr("'c' AS k", "CAST(id AS string) AS g", "0L AS start", "9L AS end")
    assert dominance.later_overlaps(df, ["k"], "g").agg({"n": "sum"}).first()[0] == 20_000 * 19_999 // 2


def test_orf_of_sequences_shuffles_nothing(spark):
    """A codon is no row that carries its sequence into a shuffle; another alphabet counts by letters."""
    rows = [("a", "é" * 4 + "ATGG" + "CC" + "TAA", None), ("b", None, 3), ("c", "ATGTAA", 3), ("d", "AT", None)]
    df = spark.createDataFrame(rows, "id string, cdna string, last_junction long")
    out = assembly.orf_from_sequence(df, ["id"], 1, 9)
    assert {r["id"]: round(r["s_orf"], 9) for r in out.collect()} == {"a": 0.8, "b": 0.0, "c": 0.8, "d": 0.0}
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_codons_are_cut_in_one_pass(spark):
    """No codon is looked for from the beginning of its sequence."""
    plan = registry.QUERIES["p24_stop_gain"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"subst\w*\(seq", plan)


def test_dedup_state_is_a_row_a_stretch():
    """A thousand variants of ten stretches cost ten reads and ten writes of state, and are known afterwards."""

    class State(dict):
        calls = 0

        def containsKey(self, k):
            self.calls += 1
            return k in self

        def getValue(self, k):
            return self[k]

        def updateValue(self, k, v):
            self.calls += 1
            self[k] = v

    once = rewindow.Once(1000, 100)
    once.seen = State()
    variants = [(p, "A", "C") for p in range(1000)]
    assert once._first(variants, True) == variants and len(once.seen) == 10 and once.seen.calls == 20
    assert once._first([*variants[:5], (5, "A", "T")], True) == [(5, "A", "T")]
    assert json.loads(once.seen[(0,)][0])[-1] == [5, "A", "T"]


def test_small_ranges_are_read_many_at_once(tmp_path):
    """Ranges of a few hundred bytes: few tasks read them, and each line has the block of the range that owns it, also where
    a line begins with a range's first member, is longer than one, or follows an empty member."""
    rng = random.Random(5)
    data = b""
    for _ in range(400):
        text = b"".join(rng.choice([b"x" * rng.randrange(60), b"y" * 60]) + b"\n" for _ in range(rng.randrange(9))) + (b"" if rng.random() < 0.5 else b"z" * rng.randrange(500))
        data += bgzf.compressed(text)
    data += bgzf._END
    (tmp_path / "a.gz").write_bytes(data)
    for split in (50, 300, 2000):
        want = [(at, *x) for at in range(0, len(data), split) for x in bgzf.owned_lines(bgzf.Members(pa.BufferReader(data), at, len(data)), at, min(at + split, len(data)))]
        reader = bgzf.BgzfReader({"path": f"file://{tmp_path}", "split": split})
        parts = reader.partitions()
        assert len(parts) <= 2 * bgzf.TASKS
        rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
        assert [(r["block"], r["value"].encode(), r["at"]) for r in rows] == want
        assert all(b["line"] == (a["line"] + 1 if a["block"] == b["block"] else 0) for a, b in zip(rows, rows[1:], strict=False))


def test_windows_of_one_member_unpack_it_once(tmp_path):
    data = bgzf.compressed(b"ACGT" * 9000) + bgzf._END
    file, kept = pa.BufferReader(data), {}
    n = [bgzf._bases(bgzf.Members(file, 0, len(data), kept), 0, 10 * k, 10 * k + 5) for k in range(50)]
    assert {b for _, b in n} == {bgzf._bases(bgzf.Members(file, 0, len(data)), 0, 0, 5)[1]} and n[1][0] == "GTACG"
    assert len(kept) == 1


@pytest.mark.parametrize("name", ["a5_window_counts", "a9_count_spread", "t2_top_windows", "j5_window_summary"])
def test_window_counts_follow_pieces_of_contigs(spark, name, monkeypatch):
    """Variants are counted in the tasks that make them, a bounded piece of the documents each: none is shuffled."""
    monkeypatch.setattr(fixtures, "PIECE", 1 << 14)
    assert fixtures.pieces(spark, SF) > 4
    query = registry.QUERIES[name]
    plan = query(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and not re.search(r"hashpartitioning\([^)]*(alt|var_type)#", plan)
    compare(spark, query, registry.ORACLES[name], SF)


def test_points_in_many_equal_genes(spark):
    """20,000 genes over 20,000 points are 400 million pairs; names may come twice, empty intervals hold nothing."""
    points = spark.range(20_000).selectExpr("'c' AS k", "id % 100 AS at")
    genes = spark.range(20_000).selectExpr("'c' AS k", "CAST(id % 10000 AS string) AS g", "10L AS start", "IF(id = 3, 10L, 30L) AS end")
    got = dominance.held_points(points, genes, ["k"], "at", "g").groupBy("n", "total").count().collect()
    per = 200 * sum(range(10, 30))
    assert sorted(map(tuple, got)) == [(4000, per, 1), (8000, 2 * per, 9999)]


@pytest.mark.parametrize("name", ["n1_labels", "n1_labels_legacy"])
def test_labels_meet_exons_once(spark, name):
    """Offsets are made once: two windows' worth of sorting by transcript, not six; the SQL's rows."""
    query = registry.QUERIES[name]
    plan = query(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"AS offset#", plan)) == 1
    compare(spark, query, registry.ORACLES[name], SF)


@pytest.mark.parametrize("name", ["u5_slop_matches", "e4_evaluate_set"])
def test_junctions_are_matched_once(spark, name):
    query = registry.QUERIES[name]
    plan = query(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("aggregate(") <= 2
    compare(spark, query, registry.ORACLES[name], SF)


def test_spec_is_matched_once(spark):
    """One regular expression takes a spec apart; anything else is null."""
    texts = ["chr1: 5a > tt", "x.Y_1:0012AC>-", "1:" + "9" * 19 + "A>C", "chr1:5A>", "a\nb\nc\nd", "", None]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select(ids.parse_spec(F.col("t")).alias("s"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count(ids._SPEC[4:12]) == 1
    got = [r["s"] and tuple(r["s"]) for r in out.collect()]
    assert got == [("chr1", 4, 5, "A", "TT", "INDEL"), ("x.Y_1", 11, 12, "AC", "-", "DEL"), ("1", None, None, "A", "C", "SNP"), None, None, None, None]


def test_attributes_are_split_once(spark):
    """Pairs aren't made again for each pair; the last of equal keys wins, nothing and null stay what they were."""
    texts = ['gene_id "g"; n 1; gene_id "h"; bare; t "a b"', "", None]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select(ids.parse_attributes(F.col("t")).alias("m"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("split(t") == 1
    assert [r["m"] for r in out.collect()] == [{"n": "1", "gene_id": "h", "t": "a b"}, {}, None]


@pytest.mark.parametrize(("name", "fold"), [("p19_apply_many", "aggregate("), ("x4_balanced", "exists(")])
def test_folds_run_once(spark, name, fold):
    """A window's fold is run once for its three results, and neighbours are looked for once a step."""
    query = registry.QUERIES[name]
    plan = query(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(fold) == 1
    compare(spark, query, registry.ORACLES[name], SF)


def test_many_shards_are_written_fast(spark, tmp_path):
    """A folder of one small file took some 45 ms; each shard is whole, in order and in one file, and no hidden file stays."""
    path = f"{tmp_path}/out"
    df = spark.range(6000, numPartitions=4).select(F.col("id").alias("start"), (F.col("id") + 50).alias("end"), F.concat(F.lit("t"), "id").alias("name"))
    df.count()
    began = time.time()
    sinks.write_by_bases(df, path, 100, [F.col("start")])
    took = time.time() - began
    assert sorted(os.listdir(path)) == sorted(["_SUCCESS", *(f"shard={k}" for k in range(3000))])
    assert {tuple(os.listdir(f"{path}/shard={k}")) for k in range(3000)} == {("part.parquet",)}
    for k in (0, 1234, 2999):
        assert pq.ParquetFile(f"{path}/shard={k}/part.parquet").read().to_pydict() == {"start": [2 * k, 2 * k + 1], "end": [2 * k + 50, 2 * k + 51], "name": [f"t{2 * k}", f"t{2 * k + 1}"]}
    assert took < 45
    with pytest.raises(FileExistsError):
        sinks.write_by_bases(df, path, 100, [F.col("start")])


def test_many_shards_are_read_by_few_tasks(spark):
    """A task listed each folder, and one read 32 files."""
    sc = spark.sparkContext
    sc.setJobGroup("k1", "k1")
    try:
        compare(spark, io_queries.k1_sharded, registry.ORACLES["k1_sharded"], "/root/testdata/sf0.01")
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup("k1")]
    stages = {k: sc.statusTracker().getStageInfo(k) for j in jobs for k in j.stageIds}
    assert stages and max(s.numTasks for s in stages.values() if s) < 100  # 409 shards


@pytest.mark.parametrize(("budget", "unique", "odd"), [(1, True, None), (700, True, None), (700, False, None), (40_000, True, None), (150_000, False, None), (10**9, True, None), (5_000, True, -3_000), (5_000, True, 10**7)])
def test_shards_that_span_pieces(spark, tmp_path, budget, unique, odd):
    """Shards of a row, of a few, and of several tasks' rows; rows of no bases or no bounds, equal in the order, longer than many
    budgets, or with an end before their start.  Types that Parquet spells in other ways stay."""
    rng = random.Random(budget)
    rows = [(k, rng.randrange(50), rng.choice([0, 0, 1, 30, 200])) for k in range(3000)] + ([(3000, 25, odd)] if odd else [])
    rng.shuffle(rows)
    by, columns = (["g", "id"] if unique else ["g"]), ["id", "at", "day", "price", "tags", "name", "start", "end", "g"]
    df = spark.createDataFrame(rows, "id long, g int, n long").repartition(3).selectExpr(
        "id", "timestamp_micros(id * 1000003) AS at", "date_add(DATE'1960-01-01', CAST(id AS int)) AS day", "CAST(id AS decimal(20, 2)) AS price", "array(id, NULL) AS tags", "IF(id % 5 = 0, NULL, concat('t', id)) AS name",
        "IF(id % 7 = 1 AND n >= 0, NULL, 5L) AS start", "5 + n AS end", "g")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # several ranges of few rows
    try:
        files, _ = sinks.ordered.summed_files(df.withColumn("v", F.lit(1)), [F.col(c) for c in by], "v", unique)
        assert len(files) > 2 and sum(f["total"] for f in files) == len(rows)
        sinks.write_by_bases(df, f"{tmp_path}/out", budget, [F.col(c) for c in by], unique=unique)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    back = sinks.read_by_bases(spark, f"{tmp_path}/out", df.schema)
    got = back.collect()
    key = lambda r: (r["shard"], r["g"], r["id"])
    assert back.columns == [*columns, "shard", "file"] and {r["file"] for r in got} == {"part.parquet"}
    assert sorted((r[:9] for r in got), key=lambda r: r[0]) == sorted((tuple(r) for r in df.collect()), key=lambda r: r[0])
    by_spark = spark.read.parquet(f"{tmp_path}/out").select(*columns, "shard").collect()
    assert sorted((r[:10] for r in got), key=lambda r: r[0]) == sorted((tuple(r) for r in by_spark), key=lambda r: r[0])
    assert all(len(os.listdir(f"{tmp_path}/out/shard={r['shard']}")) == 1 for r in got)
    total, bases = 0, lambda r: 0 if r["start"] is None else r["end"] - r["start"]
    if unique:
        for r in sorted(got, key=key) if odd != -3_000 else sorted(got, key=lambda r: (r["g"], r["id"])):
            assert r["shard"] == total // budget
            total += bases(r)
    else:  # equal rows come in any order, but those of a shard end at its budget
        held: dict = {}
        for r in got:
            held.setdefault(r["shard"], []).append(r)
        assert sorted((r["g"], k) for k, v in held.items() for r in v) == [(g, k) for k in sorted(held) for g in sorted(r["g"] for r in held[k])]
        for k in sorted(held):
            assert k * budget <= total < (k + 1) * budget
            total += sum(map(bases, held[k]))


def test_no_rows_no_shards(spark, tmp_path):
    df = spark.createDataFrame([], "start long, end long")
    sinks.write_by_bases(df, f"{tmp_path}/out", 10, [F.col("start")])
    assert os.listdir(f"{tmp_path}/out") == ["_SUCCESS"] and sinks.read_by_bases(spark, f"{tmp_path}/out", df.schema).count() == 0


def test_stream_partitions_do_not_follow_the_session(spark):
    """Each partition of state costs every batch a task: there are as many as cores, and the session's number comes back."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        out, state = io_queries._run(spark, rewindow.without_duplicates(io_queries._by_name(spark, io_queries._shards(spark, SF)), io_queries.HELD))
        assert spark.conf.get("spark.sql.shuffle.partitions") == "23"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    parts = [p for p in os.listdir(f"{state.removeprefix('file://')}/state/0") if p.isdigit()]
    assert len(parts) == spark.sparkContext.defaultParallelism and not out.isEmpty()


@pytest.mark.parametrize("task_places", [3, 20_000])
def test_windows_of_any_length_fall_into_islands(spark, task_places, monkeypatch):
    """Greedy selection of whole contigs equals a loop, over stretches that variants reach across, and takes few jobs."""
    monkeypatch.setattr(intervals, "STRETCH_BASES", 64)
    rng, rows = random.Random(8), []
    for chrom, places in (("a", 900), ("b", 1), ("c", 40)):
        for at in sorted(rng.sample(range(4000), places)):
            rows += [(chrom, 0, 4000, at, at + n, at + 1, "A" * n, "C", "SNP", f"{chrom}:{at}:{n}") for n in {rng.choice([1, 1, 1, 3, 9, 200 if chrom == "c" else 2]), 1 + at % 2}]
    want, last = [], {}
    for r in sorted(rows, key=lambda r: (r[0], *r[3:])):
        if r[3] >= last.get(r[0], 0):
            want.append((r[0], r[3], r[4]))
            last[r[0]] = r[4]
    df = spark.createDataFrame(rows, "chrom string, start long, end long, span_start long, span_end long, pos long, ref string, alt string, var_type string, spec string")
    got = variants.without_conflicts(df, task_places=task_places)
    assert sorted((r["chrom"], r["span_start"], r["span_end"]) for r in got.collect()) == want
    assert variants.without_conflicts(df.limit(0), task_places=task_places).isEmpty()


def test_long_chain_of_places_takes_few_jobs(spark):
    """Pointers over 600 places took some ten rounds of jobs."""
    df = spark.range(600).select(F.lit("c").alias("chrom"), F.lit(0).cast("long").alias("start"), F.lit(9000).cast("long").alias("end"), (F.col("id") * 10).alias("span_start"), (F.col("id") * 10 + 10 + F.col("id") % 2).alias("span_end"), (F.col("id") * 10 + 1).alias("pos"), F.lit("A").alias("ref"), F.lit("C").alias("alt"), F.lit("SNP").alias("var_type"), F.lit("s").alias("spec"))
    spark.sparkContext.setJobGroup("islands", "")
    try:
        assert variants.without_conflicts(df, task_places=500).count() == 301
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("islands"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 30


def test_mismatches_are_counted_where_chunks_are(spark):
    """Variants over chunk borders and beyond either end, copies, an unknown contig; sequences are joined once."""
    seqs = {"a": "ACGTACGTACGTA", "b": "TTTT"}
    rows = [("a", 1, "ACGT"), ("a", 4, "TACGTA"), ("a", 4, "TACGTA"), ("a", 3, "GTTC"), ("a", 3, "GTTC"), ("a", 12, "TANN"), ("a", 13, "AC"), ("b", 5, "N"), ("b", 40, "NNNNNNN"), ("b", 40, "NNNANNN"), ("b", 0, "NT"), ("z", 1, "A"), ("z", 1, "NNNNNNNN"), ("b", 2, ""), ("b", 1, "TT"), ("b", 2, "G")]
    base = lambda c, k: seqs[c][k] if 0 <= k < len(seqs[c]) else "N"
    known = [r for r in rows if r[0] in seqs]
    wrong = sum("".join(base(c, p - 1 + i) for i in range(len(r))) != r for c, p, r in known)
    contigs = spark.createDataFrame(list(seqs.items()), "chrom string, seq string").withColumn("length", F.length("seq"))
    df = spark.createDataFrame(rows, "chrom string, pos int, ref string").withColumn("var_type", F.lit("SNP"))
    out = variants.reference_mismatches(df, contigs.select("chrom", "length"), readers.sequence_chunks(contigs, 4), 4).collect()
    assert [tuple(r) for r in out] == [("SNP", len(known), wrong)]
    df = variants.reference_mismatches(df, contigs.select("chrom", "length"), readers.sequence_chunks(contigs, 4), 4)
    assert "collect_list" not in df._jdf.queryExecution().toString()
