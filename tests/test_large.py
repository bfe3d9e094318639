"""What must not depend on the size of one key, file, interval or locus."""

from __future__ import annotations

import gzip
import os
import random
import statistics
import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from isoloom.operators import assembly, evaluation, intervals, ordered, variants
from isoloom.sources import bgzf, readers, sinks
from isoloom.sources.shard_stream import stream_by_name
from isoloom.streaming import rewindow

# order


@pytest.mark.parametrize("values", [1, 7, 5000])
def test_ranks_and_running_sums(spark, values):
    rows = [(k * 7919 % values, k % 11, k) for k in range(5000)]
    df = spark.createDataFrame(rows, "x long, v long, id long").repartition(3)
    got = ordered.ranked(df, [F.col("x")]).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 5001))
    assert [r["x"] for r in sorted(got, key=lambda r: r["rank"])] == sorted(x for x, _, _ in rows)
    total = 0
    sums = {r["id"]: r["running"] for r in ordered.running_sum(df, [F.col("x"), F.col("id")], F.col("v")).collect()}
    for _, v, i in sorted(rows, key=lambda r: (r[0], r[2])):
        assert sums[i] == total
        total += v
    assert ordered.ranked(df.limit(0), [F.col("x")]).count() == 0


def test_medians(spark):
    rng = random.Random(3)
    rows = [("hot" if k % 3 else f"g{k % 40}", rng.choice([None, rng.random(), 0.5]), rng.randrange(9) / 8) for k in range(4000)] + [("none", None, None), ("one", 0.25, None)]
    got = {r["g"]: r for r in ordered.medians(spark.createDataFrame(rows, "g string, a double, b double"), "g", ["a", "b"]).collect()}
    for g in {g for g, _, _ in rows} - {"none"}:
        for c, k in (("a", 1), ("b", 2)):
            values = [r[k] for r in rows if r[0] == g and r[k] is not None]
            assert got[g][f"median_{c}"] == (pytest.approx(statistics.median(values)) if values else None)


def test_base_budget(spark, tmp_path):
    rng = random.Random(4)
    rows = [("c", at, at + rng.choice([1, 50, 400, 5000]), at) for at in range(600)] + [("c", 1000, None, 1000)]
    sinks.write_by_bases(spark.createDataFrame(rows, "chrom string, start long, end long, id long"), f"{tmp_path}/out", 1000, [F.col("id")])
    back = spark.read.parquet(f"{tmp_path}/out").orderBy("id").collect()
    assert len(back) == 601 and [r["shard"] for r in back] == sorted(r["shard"] for r in back)
    shards: dict = {}
    for r in back:
        shards.setdefault(r["shard"], []).append((r["end"] or r["start"]) - r["start"])
    assert all(sum(s[:-1]) < 1000 or s[-1] == 0 for s in shards.values()) and len(shards) > 50
    with pytest.raises(ValueError):
        sinks.write_by_bases(spark.range(1).select(F.lit(0).alias("start"), F.lit(1).alias("end")), f"{tmp_path}/x", 0, [F.col("start")])


def test_natural_order(spark):
    names = [*(f"chr{k}" for k in range(1, 23)), "chrX", "chrY", "chrM", "chr10_alt", "7"]
    got = variants.natural_ranks(spark.createDataFrame([(n,) for n in reversed(names)], "chrom string")).orderBy("place").collect()
    bare = lambda n: n.removeprefix("chr")
    assert [r["chrom"] for r in got] == sorted(names, key=lambda n: (len(bare(n)), bare(n), n)) and [r["place"] for r in got] == list(range(1, len(names) + 1))


def test_orphan_predictions(spark):
    exon = "array<struct<start:bigint,end:bigint>>"
    preds = spark.createDataFrame([(1, 1, "+", [(0, 5)]), (9, 1, "+", [(0, 5)])], f"example long, rank int, strand string, exons {exon}")
    truths = spark.createDataFrame([(1, "+", [(0, 5)]), (2, "+", [(0, 5)])], f"example long, strand string, exons {exon}")
    assert {r["example"]: r["chain"] for r in evaluation.evaluate(preds, truths).collect()} == {1: 1.0, 2: 0.0}
    with pytest.raises(Exception, match="no truth for example 9"):
        evaluation.evaluate(preds, truths, strict=True).collect()
    assert evaluation.evaluate(preds.where("example = 1"), truths, strict=True).count() == 2


# intervals


def test_long_intervals_are_listed_twice_at_most(spark):
    long = spark.createDataFrame([(0, 10**8), (5, 10**8 + 5), (0, 1), (4095, 4097), (7, 7)], "start long, end long")
    assert intervals.listed(long, F.col("start"), F.col("end"), 4096).groupBy("start", "end").count().agg(F.max("count"), F.count(F.lit(1))).first()[:] == (2, 4)
    assert intervals.listed(long.limit(1), F.col("start"), F.col("end"), 4096).count() == 1


@pytest.mark.parametrize("how", ["inner", "left"])
def test_points_in_intervals_of_all_lengths(spark, how):
    rng = random.Random(6)
    spans = [(k, rng.choice("ab"), s := rng.randrange(-50, 5000), s + rng.choice([0, 1, 3, 9, 70, 600, 4000])) for k in range(120)]
    points = [(k, rng.choice("abc"), rng.randrange(-60, 9000)) for k in range(200)]
    i = spark.createDataFrame(spans, "iv long, k string, start long, end long")
    p = spark.createDataFrame(points, "pt long, k string, x long")
    got = {(r["pt"], r["iv"]) for r in intervals.point_in_interval(p, i, ["k"], "x", width=4, how=how).collect()}
    want = {(a, b) for a, k, x in points for b, m, s, e in spans if k == m and s <= x < e}
    assert got == want | ({(a, None) for a, *_ in points if not any(a == w for w, _ in want)} if how == "left" else set())


def test_containment_and_overlap_of_all_lengths(spark):
    rng = random.Random(7)
    make = lambda n: [(k, rng.choice("ab"), s := rng.randrange(-50, 3000), s + rng.choice([0, 1, 2, 8, 33, 500, 2500])) for k in range(n)]
    a, b = make(120), make(130)
    x = spark.createDataFrame(a, "a long, k string, s1 long, e1 long")
    y = spark.createDataFrame(b, "b long, k string, s2 long, e2 long")
    got = [(r["a"], r["b"]) for r in intervals.overlapping(x, y, ["k"], "s1", "e1", "s2", "e2", width=4).collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, j) for i, k, s, e in a for j, m, t, f in b if k == m and s < f and t < e and s < e and t < f}
    got = [(r["a"], r["b"]) for r in intervals.contained(x, y, ["k"], "s1", "e1", "s2", "e2", width=4).collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, j) for i, k, s, e in a for j, m, t, f in b if k == m and t <= s and e <= f and t < f and s < f}


# splice graphs


def _graph(spark, rng, depth, loci=2):
    nodes, links = [], []
    for locus in range(loci):
        rows = [(100 * k, 100 * k + rng.randrange(10, 90), round(rng.random(), 3)) for k in range(depth)]
        nodes += [(locus, "+", *r) for r in rows]
        links += [(locus, "+", *rows[i][:2], *rows[j][:2], rows[i][2], rows[j][2], 0.5) for i in range(depth) for j in range(i + 1, min(depth, i + 4)) if j == i + 1 or rng.random() < 0.5]
    n = spark.createDataFrame(nodes, "locus long, strand string, start long, end long, score double")
    return n, spark.createDataFrame(links, "locus long, strand string, src_start long, src_end long, dst_start long, dst_end long, src_score double, dst_score double, score double")


@pytest.mark.parametrize("beam", [1, 3, 16])
def test_beam_in_a_task_equals_beam_by_level(spark, beam):
    nodes, links = _graph(spark, random.Random(beam), 9)
    config = assembly.Config(beam=beam, max_paths=25)
    rows = lambda df: sorted((r["locus"], r["rank"], [tuple(e) for e in r["exons"]], round(r["total"], 9), round(r["score"], 9)) for r in df.collect())
    want = rows(assembly.paths_by_level(nodes, links, config))
    assert rows(assembly.paths(nodes, links, config)) == want and len(want) >= 10
    assert rows(assembly.paths(nodes, links, config, task_edges=links.where("locus = 0").count() - 1)) == want


def test_jobs_do_not_follow_the_depth(spark):
    def jobs(depth):
        nodes, links = _graph(spark, random.Random(1), depth, 1)
        spark.sparkContext.setJobGroup(f"depth {depth}", "paths")
        longest = max(len(r["exons"]) for r in assembly.paths(nodes, links, assembly.Config(beam=2, max_paths=400)).collect())
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return longest, len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"depth {depth}"))

    (short, few), (long, many) = jobs(6), jobs(90)
    assert long > 40 > short and many == few


# block-compressed text


@given(st.lists(st.text(st.characters(codec="utf-8", exclude_characters="\n\r"), max_size=60), max_size=40), st.integers(1, 200), st.integers(1, 400), st.booleans())
@settings(max_examples=150, deadline=None)
def test_ranges_own_each_line_once(lines, member, split, ended):
    text = "\n".join(lines).encode() + (b"\n" if ended and lines else b"")
    data = b"".join(bgzf.compressed(text[k : k + member]) for k in range(0, len(text), member)) + bgzf._END
    assert gzip.decompress(data) == text
    found = []
    for at in range(0, len(data), split):
        part = list(bgzf.owned_lines(bgzf.Members(pa.BufferReader(data), at, len(data)), at, min(at + split, len(data))))
        found += part
    want = text.split(b"\n")
    assert [line for line, _ in found] == (want[:-1] if want[-1] == b"" else want)
    for line, at in found:  # a virtual offset leads back to its line
        members = bgzf.Members(pa.BufferReader(data), at >> 16, len(data))
        assert b"".join(t for _, t in members)[at & 0xFFFF :].startswith(line)


def test_block_compressed_files(spark, tmp_path):
    lines = spark.range(0, 30_000, 1, 3).select(F.concat(F.lit("chr1\tt\texon\t"), F.col("id") + 1, F.lit("\t"), F.col("id") + 9, F.lit('\t.\t+\t.\tgene_id "g"; n "'), F.sha2(F.col("id").cast("string"), 256), F.lit('";')))
    bgzf.write_lines(lines, f"{tmp_path}/gz")
    assert sorted(f for f in os.listdir(f"{tmp_path}/gz")) == [f"part-0000{k}.gz" for k in range(3)]
    back = bgzf.read_lines(spark, f"{tmp_path}/gz", 100_000)
    assert back.rdd.getNumPartitions() > 6 and back.groupBy("file", "block").count().count() > 6
    assert back.count() == 30_000 and back.select("value").exceptAll(lines).isEmpty()
    assert readers.read_gtf(spark, f"{tmp_path}/gz", bgzf=True).agg(F.sum("start"), F.sum("end")).first()[:] == (sum(range(30_000)), sum(range(9, 30_009)))
    bgzf.write_lines(lines.limit(0), f"{tmp_path}/none")
    assert bgzf.read_lines(spark, f"{tmp_path}/none").count() == 0


def test_windows_read_their_bytes_only(spark, tmp_path):
    rng = random.Random(5)
    seq = "".join(rng.choices("acgt", k=600_000))
    text = [">one x", *(seq[k : k + 60] for k in range(0, len(seq), 60)), ">two", "ACGT", "acg"]
    bgzf.write_lines(spark.createDataFrame([(k, t) for k, t in enumerate(text)], "k long, value string").coalesce(1).sortWithinPartitions("k").select("value"), f"{tmp_path}/fa")
    index = bgzf.fasta_index(readers.fasta_lines(readers.text_lines(spark, f"{tmp_path}/fa", bgzf=True, split=20_000)), 1000)
    windows = spark.createDataFrame([("one", -5, 20), ("one", 299_990, 300_050), ("one", 599_990, 600_010), ("two", 2, 9), ("two", 50, 60), ("gone", 0, 5)], "chrom string, start long, end long")
    got = {(r["chrom"], r["start"]): r for r in bgzf.read_windows(windows, index, f"{tmp_path}/fa", 1000).collect()}
    up = seq.upper()
    assert {k: r["seq"] for k, r in got.items()} == {("one", -5): "NNNNN" + up[:20], ("one", 299_990): up[299_990:300_050], ("one", 599_990): up[-10:] + "N" * 10, ("two", 2): "GTACGNN", ("two", 50): "N" * 10}
    size = sum(os.path.getsize(f"{tmp_path}/fa/{f}") for f in os.listdir(f"{tmp_path}/fa"))
    assert size > 150_000 and max(r["bytes_read"] for r in got.values()) < 80_000


# streams


def _batches(spark, path, progress, state, rows=None, schema="x long"):
    seen = []
    stream = stream_by_name(spark, path, schema, progress, rows)
    query = stream.writeStream.option("checkpointLocation", state).trigger(processingTime="0 seconds").foreachBatch(lambda df, n: seen.append(sorted(r["x"] for r in df.collect()))).start()
    query.processAllAvailable()
    query.stop()
    return [b for b in seen if b]


@pytest.mark.parametrize("turned", [False, True])
def test_shards_come_by_name(spark, tmp_path, turned):
    """File times don't matter; a stopped query goes on at the next name."""
    path, state = f"{tmp_path}/in", f"{tmp_path}/state"
    os.makedirs(f"{path}/sub")

    def put(name, values, group=10**6):
        pq.write_table(pa.table({"x": values}), f"{path}/{name}.parquet", row_group_size=group)

    for k in range(4):
        put(f"shard_{k}", [10 * k, 10 * k + 1])
        os.utime(f"{path}/shard_{k}.parquet", (1e9 + (-k if turned else k) * 1000,) * 2)
    assert _batches(spark, path, f"{tmp_path}/progress", state) == [[0, 1], [10, 11], [20, 21], [30, 31]]
    put("shard_9", [90])
    put("shard_4", [40])
    put("sub/late", list(range(500, 520)), 4)
    got = _batches(spark, path, f"{tmp_path}/progress", state, rows=9)
    assert got == [[40], [90], list(range(500, 508)), list(range(508, 516)), list(range(516, 520))]
    assert _batches(spark, path, f"{tmp_path}/progress", state) == []


def test_silent_chromosomes_end(spark, tmp_path):
    """A chromosome whose end never comes is completed by a timer."""
    path = f"{tmp_path}/in"
    os.makedirs(path)
    columns = "chrom start end pos ref alt kind".split()
    rows = [("c", 0, 100, 10, "A", "C", "variant"), ("c", 0, 100, None, "A", "A", "mark"), ("c", 0, 100, 12, "ACG", "A", "variant"), ("c", 0, 100, 13, "A", "T", "variant")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    pq.write_table(pa.table({c: pa.array(v, t) for c, v, t in zip(columns, zip(*rows, strict=True), types, strict=True)}), f"{path}/a.parquet")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = rewindow.rewindowed(stream_by_name(spark, path, rewindow.INPUT, f"{tmp_path}/progress"), 100, 50, idle=1500)
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="1 second").start()
        until = time.time() + 90
        found = []
        while not found and time.time() < until:
            time.sleep(1)
            found = spark.read.schema(rewindow.OUTPUT).parquet(f"{tmp_path}/out").collect() if os.path.exists(f"{tmp_path}/out/_spark_metadata") else []
        query.stop()
    finally:
        spark.conf.set(key, before)
    assert sorted((r["start"], r["pos"], r["late"]) for r in found) == [(0, 10, False), (0, 12, False)]


# greedy selection


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_chain_by_pointers_equals_fold(spark, seed):
    rng = random.Random(seed)
    rows = []
    for key in range(4):
        for s in sorted(rng.sample(range(3000), rng.choice([1, 40, 700]))):
            rows.append((f"k{key}", s, s + rng.choice([0, 1, 2, 9, 150])))
    df = spark.createDataFrame(rows, "k string, start long, end long")
    want = []
    for key in sorted({k for k, *_ in rows}):
        last = None
        for _, s, e in sorted(r for r in rows if r[0] == key):
            if last is None or s >= last:
                want.append((key, s, e))
                last = e
    assert sorted(tuple(r) for r in intervals.greedy_chain(df, ["k"]).collect()) == want
    assert intervals.greedy_chain(df.limit(0), ["k"]).count() == 0


def test_dedup_forgets_what_is_passed(spark, tmp_path):
    """State holds the open blocks only; a variant of a passed block comes flagged."""
    path, state = f"{tmp_path}/in", f"{tmp_path}/state"
    os.makedirs(path)
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    names = "chrom start end pos ref alt kind".split()
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(name, rows):
        pq.write_table(pa.table({c: pa.array(v, t) for c, v, t in zip(names, zip(*rows, strict=True), types, strict=True)}), f"{path}/{name}.parquet")
        stream = rewindow.without_duplicates(stream_by_name(spark, path, rewindow.INPUT, f"{tmp_path}/progress"), 100)
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", state).trigger(processingTime="0 seconds").start()
        query.processAllAvailable()
        query.stop()
        held = spark.read.format("statestore").option("operatorId", 0).option("stateVarName", "seen").load(state).count()
        return sorted((r["pos"], r["alt"], r["late"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()), held

    variant = lambda pos, alt: ("c", pos // 100 * 100, pos // 100 * 100 + 100, pos, "A", alt, "variant")
    mark = lambda start, kind="mark": ("c", start, start + 100, None, "A", "A", kind)
    try:
        first = [(10, "C", False), (20, "C", False), (150, "G", False)]
        assert run("a", [variant(10, "C"), variant(10, "C"), variant(20, "C"), variant(150, "G"), mark(0)]) == (first, 3)
        second = sorted([*first, (250, "T", False)])
        assert run("b", [variant(10, "C"), variant(150, "G"), variant(250, "T"), mark(100)]) == (second, 2)
        third = sorted([*second, (20, "C", True)])
        assert run("c", [variant(20, "C"), mark(200, "end")]) == (third, 0)
    finally:
        spark.conf.set(key, before)
