"""Queries that write derived tables in a file format and read them back, and streaming queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isoloom.functions import ids
from isoloom.operators import variants
from isoloom.plans.fixtures import oracle, positions, view
from isoloom.sources import bgzf, readers, sinks
from isoloom.sources.scratch import scratch_path, stored_bytes, written
from isoloom.sources.shard_stream import stream_by_name
from isoloom.streaming import rewindow

CHUNK, WINDOW = 400, 1000
#: Streamed windows, in seconds of event time.
HOURS, HOP, BASE = 7200, 3600, 7200


def s1_fasta(spark, sf_dir):
    path = scratch_path(spark, "fasta")
    c = view(spark, sf_dir, "fx_contigs")
    c.select(F.concat(F.lit(">chr"), "chrom", F.lit(" doc\n"), F.regexp_replace(F.lower("seq"), "(.{60})", "$1\n"))).write.text(path)
    f = readers.read_fasta(spark, path, only_chr=True)
    return f.select("chrom", "length", F.md5(F.col("seq").cast("binary")).alias("seq_md5"))


def s1_fasta_chunks(spark, sf_dir):
    """The same text read in chunks: no row holds a contig."""
    path = scratch_path(spark, "fasta")
    c = view(spark, sf_dir, "fx_contigs")
    c.select(F.concat(F.lit(">chr"), "chrom", F.lit(" doc\n"), F.regexp_replace(F.lower("seq"), "(.{60})", "$1\n"))).write.text(path)
    f = readers.read_fasta_chunks(spark, path, CHUNK, only_chr=True)
    return f.select("chrom", "chunk_id", F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


#: Compressed bytes of a range here, small so that even small files have several, and bytes of a table (documents, or text) for a
#: block-compressed file that is written from it.
RANGE, FROM_TABLE, FROM_TEXT = 16_384, 8 << 20, 128 << 20


def _fasta_bgzf(spark, sf_dir):
    """Four block-compressed files, or as many as the documents' size asks for, each by a task."""
    path = scratch_path(spark, "fasta-gz")
    c = view(spark, sf_dir, "fx_contigs")
    text = F.concat(F.lit(">chr"), "chrom", F.lit(" doc\n"), F.regexp_replace(F.lower("seq"), "(.{60})", "$1\n"))
    files = max(4, stored_bytes(spark, f"{sf_dir}/documents.parquet") // FROM_TABLE)
    bgzf.write_lines(c.repartition(files, "chrom").select(text), path)
    return path


def s1_bgzf_chunks(spark, sf_dir):
    """Block-compressed FASTA in chunks, files split into ranges."""
    f = readers.read_fasta_chunks(spark, _fasta_bgzf(spark, sf_dir), CHUNK, only_chr=True, bgzf=True, split=RANGE)
    return f.select("chrom", "chunk_id", F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


def s1_bgzf_windows(spark, sf_dir):
    """A window of each contig by the index of the compressed files; none reads more than a few members."""
    path = _fasta_bgzf(spark, sf_dir)
    index = written(bgzf.fasta_index(readers.fasta_lines(readers.text_lines(spark, path, bgzf=True, split=RANGE)), CHUNK), "fasta-index")
    w = index.where("chunk_id = 0").select("chrom", F.explode(F.array(F.lit(-50).cast("long"), F.floor(F.col("length") / 2), F.col("length") - 30)).alias("start")).withColumn("end", F.col("start") + WINDOW)
    s = bgzf.read_windows(w, index, path, CHUNK)
    return s.select("chrom", F.col("start").alias("start_pos"), F.md5(F.col("seq").cast("binary")).alias("seq_md5"), (F.col("bytes_read") < 3 * (1 << 16)).alias("few_bytes"))


def s3_bgzf_vcf(spark, sf_dir):
    """The variants' text block-compressed, read in ranges: the same rows, and several ranges of a file have some."""
    path = scratch_path(spark, "vcf-gz")
    text = _vcf(spark, sf_dir)
    bgzf.write_lines(spark.read.text(text).coalesce(max(2, stored_bytes(spark, text) // FROM_TEXT)), path)
    r = readers.read_vcf(spark, path, bgzf=True, split=RANGE)
    ranges = bgzf.read_lines(spark, path, RANGE).groupBy("file").agg(F.count_distinct("block").alias("n")).agg((F.max("n") > 1).alias("several"))
    return r.groupBy("chrom").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("sum_pos"), F.sum("qual").alias("sum_qual"), F.max("alt").alias("last_alt")).join(F.broadcast(ranges))  # one row


def m1_window_sequences(spark, sf_dir):
    c = view(spark, sf_dir, "fx_contigs").select("chrom", F.col("length").cast("long").alias("length"), "seq")
    w = c.select("chrom", F.explode(F.array(F.lit(-50).cast("long"), (F.col("length") / 2).cast("long"), F.col("length") - 30)).alias("start")).withColumn("end", F.col("start") + WINDOW)
    s = readers.window_sequences(w, c, readers.sequence_chunks(c, CHUNK), CHUNK)
    return positions(s)


def _gtf(spark, sf_dir):
    """GTF text with lines of four, eight and ten fields, without attributes and with a start that is no number, beside the rows."""
    path = scratch_path(spark, "gtf")
    e = view(spark, sf_dir, "fx_exons")
    attrs = F.concat(F.lit('gene_id "'), "gene_id", F.lit('"; transcript_id "'), F.col("tx").cast("string"), F.lit('"; exon_number '), F.col("rank").cast("string"), F.lit(";"))
    fields = lambda start, last: ("chrom", F.lit("t"), F.when(F.col("rank") % 4 == 0, "CDS").otherwise("exon"), start, F.col("end").cast("string"), F.lit("."), "strand", F.lit("."), *last)
    start = (F.col("start") + 1).cast("string")
    tab = lambda *c: F.concat_ws("\t", *c)
    odd = F.explode(F.filter(F.array(
        F.when(F.col("tx") % 11 == 0, tab("chrom", F.lit("t"), F.lit("exon"), F.col("tx").cast("string"))),
        F.when(F.col("tx") % 13 == 0, tab(*fields(start, [attrs, F.lit("extra")]))),
        F.when(F.col("tx") % 17 == 0, tab(*fields(start, []))),
        F.when(F.col("tx") % 19 == 0, tab(*fields(F.concat(F.lit("x"), start), [attrs]))),
        F.when(F.col("tx") % 23 == 0, tab(*fields(start, [F.lit("")]))),
    ), lambda x: x.isNotNull()))
    e.select(tab(*fields(start, [attrs])).alias("value")).union(spark.range(1).select(F.lit("# comment"))).union(e.where("rank = 1").select(odd)).write.text(path)
    return path


def s2_gtf(spark, sf_dir):
    g = readers.read_gtf(spark, _gtf(spark, sf_dir), ("exon",), ("chr1", "chr2"))
    return g.select("chrom", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "strand", F.element_at("attrs", "transcript_id").alias("tx"))


def p2_attributes(spark, sf_dir):
    g = readers.read_gtf(spark, _gtf(spark, sf_dir))
    return g.select(F.element_at("attrs", "gene_id").alias("gene_id"), F.element_at("attrs", "exon_number").alias("exon_number"), F.size("attrs").alias("n")).groupBy("gene_id").agg(F.max("exon_number").alias("last_number"), F.sum("n").alias("n"))


def f7_rejected_lines(spark, sf_dir):
    return readers.rejected(readers.parsed_gtf(spark, _gtf(spark, sf_dir)))


def f7_reject_counts(spark, sf_dir):
    """Each format's accepted and rejected lines, written to two tables in one pass: counts observed there, and read back."""
    gct = _gct(spark, sf_dir)
    parsed = {"gtf": readers.parsed_gtf(spark, _gtf(spark, sf_dir)), "vcf": readers.parsed_vcf(spark, _vcf(spark, sf_dir)), "gct": readers.parsed_gct(spark, gct, *readers.gct_header(spark, gct))}
    out = None
    for name, p in parsed.items():
        path = scratch_path(spark, "parsed")
        seen = sinks.write_accepted_and_rejected(p, path)
        schema = p.schema.add("kind", "string")
        back = sinks.read_rejected(spark, path, schema).select("reason").unionByName(sinks.read_accepted(spark, path, schema).select(F.lit("row").alias("reason")))
        observed = F.create_map(*(F.lit(x) for pair in seen.items() for x in pair))
        rows = back.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("format"), "reason", "n", (F.element_at(observed, F.col("reason")) == F.col("n")).alias("as_observed"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _vcf(spark, sf_dir):
    """VCF text with lines of seven fields and positions that are no numbers beside the rows."""
    path = scratch_path(spark, "vcf")
    v = view(spark, sf_dir, "fx_variants")
    alts = F.when(F.col("pos") % 5 == 0, F.concat("alt", F.lit(","), F.concat("alt", F.lit("T")))).otherwise(F.col("alt"))
    qual = F.when(F.col("pos") % 3 == 0, ".").otherwise((F.col("pos") % 100).cast("string"))
    pos = F.col("pos").cast("string")
    line = F.concat_ws("\t", "chrom", pos, F.lit("."), "ref", alts, qual, F.lit("PASS"), F.lit("DP=1"), F.lit("GT"), F.lit("0/1"))
    odd = F.explode(F.filter(F.array(
        F.when(F.col("pos") % 97 == 0, F.concat_ws("\t", "chrom", pos, F.lit("."), "ref", alts, qual, F.lit("PASS"))),
        F.when(F.col("pos") % 89 == 0, F.concat_ws("\t", "chrom", F.concat(F.lit("q"), pos), F.lit("."), "ref", alts, qual, F.lit("PASS"), F.lit("DP=1"))),
    ), lambda x: x.isNotNull()))
    head = spark.range(1).select(F.explode(F.array(F.lit("##fileformat=VCFv4.2"), F.lit("#CHROM\tPOS"))))
    v.select(line.alias("value")).union(head).union(v.where("pos % 97 = 0 OR pos % 89 = 0").select(odd)).write.text(path)
    return path


def s3_vcf(spark, sf_dir):
    r = readers.read_vcf(spark, _vcf(spark, sf_dir))
    return r.groupBy("chrom").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("sum_pos"), F.sum("qual").alias("sum_qual"), F.count("id").alias("n_ids"), F.max(F.size("samples")).alias("n_samples"), F.max("alt").alias("last_alt"))


def _gct(spark, sf_dir):
    """A matrix of junctions by the three chromosomes as samples, with ragged rows."""
    j = view(spark, sf_dir, "fx_junctions").groupBy("donor", "acceptor", "strand").pivot("chrom", ["A", "N", "R"]).agg(F.sum("count")).na.fill(0)
    path = scratch_path(spark, "gct")
    name = F.concat(F.lit("chr7:"), "donor", F.lit("-"), "acceptor", F.lit(":"), "strand")
    cells = F.when(F.col("donor") % 4 == 1, F.concat_ws("\t", name, F.lit("g"), "A", "N")).when(F.col("donor") % 4 == 2, F.concat(F.concat_ws("\t", name, F.lit("g"), "A", "N", "R"), F.lit("\t"))).otherwise(F.concat_ws("\t", name, F.lit("g"), F.concat("A", F.lit(".7")), "N", "R"))
    top = spark.range(1).select(F.explode(F.array(F.lit("#1.2"), F.lit("9\t3"), F.lit("Name\tDescription\tS-A\tS-N\tS-R"), F.lit("chr7:1-2:+\tg\t1"))).alias("value"))
    top.union(j.select(cells)).write.text(path)
    return path


def s4_gct(spark, sf_dir):
    good, _ = readers.gct_junctions(readers.read_gct(spark, _gct(spark, sf_dir)))
    return good.groupBy("sample_id", "strand").agg(F.count(F.lit(1)).alias("n"), F.sum("count").alias("reads"), F.sum("donor").alias("sum_donor"))


def s5_junction_tables(spark, sf_dir):
    j = view(spark, sf_dir, "fx_junctions")
    base = scratch_path(spark, "tables")
    j.where("chrom = 'A'").write.parquet(f"{base}/a.parquet")
    j.where("chrom = 'N'").write.csv(f"{base}/n.csv", header=True)
    j.where("chrom = 'R'").write.csv(f"{base}/r.tsv", header=True, sep="\t")
    j.drop("strand").write.parquet(f"{base}/bad.parquet")
    r = readers.read_junctions(spark, [f"{base}/{x}" for x in ("a.parquet", "n.csv", "r.tsv", "bad.parquet")])
    return r.groupBy("chrom", "strand").agg(F.count(F.lit(1)).alias("n"), F.sum("count").alias("reads"), F.sum("donor").alias("sum_donor"))


def s6_shards(spark, sf_dir):
    path = scratch_path(spark, "shards")
    sinks.write_sharded(view(spark, sf_dir, "fx_junctions"), path, 5000)
    return readers.read_shards(spark, path, ["donor", "acceptor"]).groupBy("chrom").agg(F.count(F.lit(1)).alias("n"), F.sum("count").alias("reads"))


def s7_sequences(spark, sf_dir):
    path = scratch_path(spark, "jsonl")
    c = view(spark, sf_dir, "fx_contigs")
    seq = F.when(F.col("contig_no") % 4 == 0, F.concat(F.col("seq"), F.lit("X"))).otherwise(F.lower("seq"))
    line = F.when(F.col("contig_no") % 4 == 1, '{"broken": ').otherwise(F.to_json(F.struct(seq.alias("seq"), F.when(F.col("contig_no") % 4 == 2, "-").otherwise("?").alias("strand"), F.col("contig_no").cast("double").alias("label"))))
    c.select(line).write.text(path)
    r = readers.read_sequences(spark, path)
    return r.groupBy("strand").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("labels"), F.sum(F.length("seq")).alias("bases"))


#: Bases of a shard, and the order of the rows that fill them.
BUDGET, ALONG = 20_000, ("chrom", "start", "end", "tx", "rank")


def k1_sharded(spark, sf_dir):
    """Windows of mixed lengths in shards of a base budget: what each shard holds."""
    path = scratch_path(spark, "sharded")
    exons = view(spark, sf_dir, "fx_exons")
    sinks.write_by_bases(exons, path, BUDGET, [F.col(c) for c in ALONG], unique=True)  # a transcript's ranks are
    back = sinks.read_by_bases(spark, path, exons.select("start", "end").schema)
    return back.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("bases"), F.count_distinct("file").alias("n_files"))


def k1_row_shards(spark, sf_dir):
    path = scratch_path(spark, "sharded")
    sinks.write_sharded(view(spark, sf_dir, "fx_junctions"), path, 1953)
    files = spark.read.parquet(path).groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n"))
    return files.agg(F.sum("n").alias("n"), (F.max("n") <= 1953).alias("all_within"))


def k2_by_sample(spark, sf_dir):
    path = scratch_path(spark, "samples")
    j = view(spark, sf_dir, "fx_junctions").withColumn("sample_id", ids.sample_name(F.concat(F.lit("S."), F.col("sample_id").cast("long") % 20)))
    sinks.write_by(j, path, "sample_id")
    return spark.read.parquet(path).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))


def k3_by_chromosome(spark, sf_dir):
    path = scratch_path(spark, "chroms")
    sinks.write_by(view(spark, sf_dir, "fx_junctions"), path, "chrom")
    back = spark.read.parquet(path).withColumn("folder", F.regexp_extract(F.input_file_name(), "chrom=([^/]*)/", 1))
    return back.groupBy("chrom", "folder").agg(F.count(F.lit(1)).alias("n"), F.sum("count").alias("reads"))


def k4_metadata(spark, sf_dir):
    meta = sinks.write_with_metadata(view(spark, sf_dir, "fx_junctions"), scratch_path(spark, "meta"), ["lineitem"])
    return meta.select("rows", F.size("columns").alias("n_columns"), F.get("inputs", 0).alias("input"))


def k5_guarded(spark, sf_dir):
    path = scratch_path(spark, "guarded")
    j = view(spark, sf_dir, "fx_junctions")
    sinks.write_parquet(j, path)
    sinks.write_parquet(j.where("chrom = 'A'"), path, exist_ok=True)
    return spark.read.parquet(path).groupBy("chrom").agg(F.count(F.lit(1)).alias("n"))


def _arrivals(spark, sf_dir, some="true"):
    """Events as variants on a time axis in seconds, with the base window that each belongs to."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where(some)
    pos = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'2023-12-31 00:00:00', ts)") + 1
    k = F.col("event_id") % 3
    ref, alt = F.when(k == 2, "ACG").otherwise("A"), F.when(k == 0, "C").when(k == 1, "AT").otherwise("A")
    v = e.select(F.col("event_type").alias("chrom"), pos.cast("long").alias("pos"), ref.alias("ref"), alt.alias("alt")).where(F.col("chrom").isNotNull() & F.col("pos").isNotNull())
    start = F.floor((F.col("pos") - 1) / F.lit(BASE)).cast("long") * BASE
    return v.select("chrom", start.alias("start"), (start + BASE).alias("end"), "pos", "ref", "alt")


#: Rows of a shard of arrivals, and of the events which ones come late.
SHARD_ROWS, LATE = 200_000, 97


def _shards(spark, sf_dir, late=False):
    """Shards in order of their names: each brings a stretch of base windows, the last one ends all chromosomes.  With
    ``late`` one more follows, of variants in windows that are long complete.  All but that one are written at once."""
    v = _arrivals(spark, sf_dir)
    last, n = v.agg(F.max("start"), F.count(F.lit(1))).first()
    last, n = last or 0, max(4, -(-n // SHARD_ROWS))
    path = scratch_path(spark, "arrivals")
    none = (F.lit(None).cast("long").alias("pos"), F.lit("A").alias("ref"), F.lit("A").alias("alt"))
    marks = v.select("chrom", "start", "end").distinct().select("*", *none, F.lit("mark").alias("kind"))
    ends = v.select("chrom").distinct().select("chrom", F.lit(last).cast("long").alias("start"), F.lit(last + BASE).cast("long").alias("end"), *none, F.lit("end").alias("kind"))
    rows = v.withColumn("kind", F.lit("variant")).unionByName(marks).unionByName(ends)
    rows.repartitionByRange(n, "start").write.parquet(f"{path}/in-order")
    if late:
        _late(spark, sf_dir).withColumn("kind", F.lit("variant")).coalesce(1).write.parquet(f"{path}/late")
    return path


def _late(spark, sf_dir):
    return _arrivals(spark, sf_dir, f"event_id % {LATE} = 0").withColumn("ref", F.lit("A")).withColumn("alt", F.lit("T"))


_PROVIDER, _PARTITIONS = "spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions"


def _run(spark, stream, mode="append"):
    """(result, state folder) of a stream run over all shards present: a Parquet table, or (complete) the last batch's table.

    A batch is a shard of bounded size, and each partition of state costs every batch a task and a commit; so there are as many as
    cores, however many the session has for its tables: partitions and batches that both follow the input are its square."""
    out, state = scratch_path(spark, "streamed"), scratch_path(spark, "state")
    before = {k: spark.conf.get(k) for k in (_PROVIDER, _PARTITIONS)}
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set(_PARTITIONS, spark.sparkContext.defaultParallelism)
    try:
        writer = stream.writeStream.option("checkpointLocation", state).trigger(processingTime="0 seconds")
        if mode == "append":
            query = writer.format("parquet").option("path", out).start()
        else:
            query = writer.outputMode(mode).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(out)).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.parquet(out), state


def _by_name(spark, path, rows=None):
    return stream_by_name(spark, path, rewindow.INPUT, scratch_path(spark, "progress"), rows)


def x5_streamed_windows(spark, sf_dir):
    """Keyed buffers, completion, end of key, late rows and eviction (X5 to X8) over shards in name order (S8)."""
    out, _ = _run(spark, rewindow.rewindowed(_by_name(spark, _shards(spark, sf_dir, late=True)), HOURS, HOP))
    return out.select("chrom", F.col("start").alias("start_pos"), "pos", "ref", "alt", "in_window_idx", "late").distinct()  # a late row may come for two blocks


def x2_batch_windows(spark, sf_dir):
    """The batch twin of x5_streamed_windows."""
    v = variants.typed(_arrivals(spark, sf_dir)).withColumn("idx0", F.lit(0))
    first = variants.rewindowed(v.select("chrom", F.lit(0).cast("long").alias("start"), "end", "pos", "ref", "alt", "var_type", "spec", "span_start", "span_end", "idx0"), HOURS, HOP)
    return first.select("chrom", F.col("start").alias("start_pos"), "pos", "ref", "alt", "in_window_idx", F.lit(False).alias("late"))


def s8_shards_by_name(spark, sf_dir):
    """Each shard's rows by the batch that brought them: shards of range of start, so batches must come in its order."""
    path, out = _shards(spark, sf_dir), scratch_path(spark, "batches")
    stream = _by_name(spark, path, rows=SHARD_ROWS // 4).where("kind = 'variant'")
    query = stream.writeStream.foreachBatch(lambda df, n: df.groupBy().agg(F.lit(n).alias("batch"), F.count(F.lit(1)).alias("n"), F.min("start").alias("low"), F.max("start").alias("high"), F.sum("pos").alias("pos")).write.mode("append").parquet(out)).option("checkpointLocation", scratch_path(spark, "state")).trigger(processingTime="0 seconds").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    batches = spark.read.parquet(out).where("n > 0")
    along = W.orderBy("batch")  # a row a batch
    turned = F.count_if(F.col("low") < F.col("before"))
    return batches.withColumn("before", F.lag("high").over(along)).agg(F.sum("n").alias("n"), F.sum("pos").alias("sum_pos"), turned.alias("n_out_of_order"), (F.count(F.lit(1)) >= 4).alias("several"))


#: Seconds of event time whose variants the dedup holds together.
HELD = 86_400


def x9_stream_dedup(spark, sf_dir):
    """Variants once, and how many of them the state still holds after the chromosomes' ends: none."""
    out, state = _run(spark, rewindow.without_duplicates(_by_name(spark, _shards(spark, sf_dir)), HELD))
    held = spark.read.format("statestore").option("operatorId", 0).option("stateVarName", "seen").load(state)
    left = held.agg(F.count(F.lit(1)).alias("n_held"))
    return out.where("NOT late").groupBy("chrom").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(left))  # one row


def x10_stream_counts(spark, sf_dir):
    return _run(spark, rewindow.type_counts(_by_name(spark, _shards(spark, sf_dir))), "complete")[0]


_QUERIES = (
    s1_fasta, s1_fasta_chunks, s1_bgzf_chunks, s1_bgzf_windows, s3_bgzf_vcf, s2_gtf, s3_vcf, s4_gct, s5_junction_tables, s6_shards, s7_sequences, m1_window_sequences, p2_attributes, f7_rejected_lines, f7_reject_counts, k1_sharded, k1_row_shards, k2_by_sample, k3_by_chromosome, k4_metadata, k5_guarded,
    x5_streamed_windows, x2_batch_windows, s8_shards_by_name, x9_stream_dedup, x10_stream_counts,
)
QUERIES = {f.__name__: f for f in _QUERIES}

_EV = """v AS (SELECT DISTINCT event_type AS chrom, CAST(date_diff('second', TIMESTAMP '2023-12-31 00:00:00', ts) + 1 AS BIGINT) AS pos, CASE event_id % 3 WHEN 2 THEN 'ACG' ELSE 'A' END AS ref, CASE event_id % 3 WHEN 0 THEN 'C' WHEN 1 THEN 'AT' ELSE 'A' END AS alt FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL)"""
_WIN = f"""{_EV}, a AS (SELECT *, pos - 1 AS s, pos - 1 + CASE WHEN length(ref) < length(alt) THEN 1 ELSE length(ref) END AS e FROM v),
w AS (SELECT a.*, k * {HOP} AS start_pos FROM (SELECT *, unnest(range(CAST(greatest(0, ceil((s - {HOURS} + 1) / {HOP})) AS BIGINT), CAST(s // {HOP} + 1 AS BIGINT))) AS k FROM a) a),
x AS (SELECT *, row_number() OVER (PARTITION BY chrom, start_pos ORDER BY s, e, pos, ref, alt) AS r FROM w),
g AS (SELECT chrom, start_pos, pos, ref, alt, r, true AS kept, e AS last FROM x WHERE r = 1 UNION ALL
      SELECT x.chrom, x.start_pos, x.pos, x.ref, x.alt, x.r, x.s >= g.last, CASE WHEN x.s >= g.last THEN x.e ELSE g.last END FROM g JOIN x ON x.chrom = g.chrom AND x.start_pos = g.start_pos AND x.r = g.r + 1)
SELECT chrom, start_pos, pos, ref, alt, pos - start_pos AS in_window_idx, false AS late FROM g WHERE kept"""
_J = ["fx_junctions"]
_LINE = """chrom || chr(9) || 't' || chr(9) || CASE WHEN rank % 4 = 0 THEN 'CDS' ELSE 'exon' END || chr(9) || {start} || chr(9) || end_pos || chr(9) || '.' || chr(9) || strand || chr(9) || '.'"""
_ATTRS = """ || chr(9) || 'gene_id "' || gene_id || '"; transcript_id "' || tx || '"; exon_number ' || rank || ';'"""
_ODD = f"""e AS (SELECT *, {_LINE.format(start="(start_pos + 1)")} AS l, {_LINE.format(start="'x' || (start_pos + 1)")} AS x, 1 AS one FROM fx_exons WHERE rank = 1),
o AS (SELECT chrom || chr(9) || 't' || chr(9) || 'exon' || chr(9) || tx AS line, 'fields' AS reason FROM e WHERE tx % 11 = 0 UNION ALL SELECT l{_ATTRS} || chr(9) || 'extra', 'fields' FROM e WHERE tx % 13 = 0
      UNION ALL SELECT l, 'fields' FROM e WHERE tx % 17 = 0 UNION ALL SELECT x{_ATTRS}, 'number' FROM e WHERE tx % 19 = 0)"""
ORACLES = {
    "s1_fasta": oracle(["fx_contigs"], "SELECT 'chr' || chrom AS chrom, CAST(length AS BIGINT) AS length, md5(seq) AS seq_md5 FROM fx_contigs"),
    "s1_fasta_chunks": oracle(["fx_contigs"], f"c AS (SELECT chrom, seq, unnest(range(0, CAST(ceil(length / {CHUNK}) AS BIGINT))) AS chunk_id FROM fx_contigs) SELECT 'chr' || chrom AS chrom, chunk_id, md5(substr(seq, CAST(chunk_id * {CHUNK} + 1 AS BIGINT), {CHUNK})) AS chunk_md5 FROM c"),
    "s1_bgzf_chunks": oracle(["fx_contigs"], f"c AS (SELECT chrom, seq, unnest(range(0, CAST(ceil(length / {CHUNK}) AS BIGINT))) AS chunk_id FROM fx_contigs) SELECT 'chr' || chrom AS chrom, chunk_id, md5(substr(seq, CAST(chunk_id * {CHUNK} + 1 AS BIGINT), {CHUNK})) AS chunk_md5 FROM c"),
    "s1_bgzf_windows": oracle(
        ["fx_contigs"],
        f"a AS (SELECT DISTINCT chrom, seq, CAST(length AS BIGINT) AS length, CAST(unnest([-50, length // 2, length - 30]) AS BIGINT) AS s FROM fx_contigs WHERE length > 0) SELECT 'chr' || chrom AS chrom, s AS start_pos, md5(repeat('N', greatest(0, least(s + {WINDOW}, 0) - s)) || substr(seq, greatest(s, 0) + 1, greatest(0, least(s + {WINDOW}, length) - greatest(s, 0))) || repeat('N', greatest(0, s + {WINDOW} - greatest(length, s, 0)))) AS seq_md5, true AS few_bytes FROM a",
    ),
    "m1_window_sequences": oracle(
        ["fx_contigs"],
        f"a AS (SELECT DISTINCT chrom, seq, CAST(length AS BIGINT) AS length, CAST(unnest([-50, length // 2, length - 30]) AS BIGINT) AS s FROM fx_contigs) SELECT chrom, s AS start_pos, s + {WINDOW} AS end_pos, repeat('N', greatest(0, least(s + {WINDOW}, 0) - s)) || substr(seq, greatest(s, 0) + 1, greatest(0, least(s + {WINDOW}, length) - greatest(s, 0))) || repeat('N', greatest(0, s + {WINDOW} - greatest(length, s, 0))) AS seq FROM a",
    ),
    "s2_gtf": oracle(["fx_exons"], "SELECT chrom, start_pos, end_pos, strand, tx::STRING AS tx FROM fx_exons WHERE rank % 4 <> 0 AND chrom IN ('chr1', 'chr2') UNION ALL SELECT chrom, start_pos, end_pos, strand, NULL FROM fx_exons WHERE rank = 1 AND tx % 23 = 0 AND chrom IN ('chr1', 'chr2')"),
    "p2_attributes": oracle(["fx_exons"], "SELECT gene_id, max(rank::STRING) AS last_number, CAST(3 * count(*) AS BIGINT) AS n FROM fx_exons GROUP BY 1 UNION ALL SELECT NULL, NULL, CAST(0 AS BIGINT) FROM fx_exons WHERE rank = 1 AND tx % 23 = 0 HAVING count(*) > 0"),
    "f7_rejected_lines": oracle(["fx_exons"], f"{_ODD} SELECT line, reason FROM o"),
    "f7_reject_counts": oracle(
        ["fx_exons", "fx_variants", "fx_junctions"],
        f"""{_ODD}, a AS (SELECT 'gtf' AS format, reason FROM o UNION ALL SELECT 'gtf', 'row' FROM fx_exons UNION ALL SELECT 'gtf', 'row' FROM fx_exons WHERE rank = 1 AND tx % 23 = 0
UNION ALL SELECT 'vcf', 'row' FROM fx_variants UNION ALL SELECT 'vcf', 'fields' FROM fx_variants WHERE pos % 97 = 0 UNION ALL SELECT 'vcf', 'number' FROM fx_variants WHERE pos % 89 = 0
UNION ALL SELECT 'gct', 'row' FROM (SELECT DISTINCT donor, acceptor, strand FROM fx_junctions) j UNION ALL SELECT 'gct', 'samples')
SELECT format, reason, count(*) AS n, true AS as_observed FROM a GROUP BY 1, 2""",
    ),
    "s3_vcf": oracle(
        ["fx_variants"],
        "v AS (SELECT chrom, pos, CASE WHEN pos % 3 <> 0 THEN (pos % 100)::DOUBLE END AS q, alt FROM fx_variants UNION ALL SELECT chrom, pos, CASE WHEN pos % 3 <> 0 THEN (pos % 100)::DOUBLE END, alt || 'T' FROM fx_variants WHERE pos % 5 = 0) SELECT chrom, count(*) AS n, CAST(sum(pos) AS BIGINT) AS sum_pos, sum(q) AS sum_qual, CAST(0 AS BIGINT) AS n_ids, CAST(2 AS INTEGER) AS n_samples, max(alt) AS last_alt FROM v GROUP BY 1",
    ),
    "s3_bgzf_vcf": oracle(
        ["fx_variants"],
        "v AS (SELECT chrom, pos, CASE WHEN pos % 3 <> 0 THEN (pos % 100)::DOUBLE END AS q, alt FROM fx_variants UNION ALL SELECT chrom, pos, CASE WHEN pos % 3 <> 0 THEN (pos % 100)::DOUBLE END, alt || 'T' FROM fx_variants WHERE pos % 5 = 0) SELECT chrom, count(*) AS n, CAST(sum(pos) AS BIGINT) AS sum_pos, sum(q) AS sum_qual, max(alt) AS last_alt, true AS several FROM v GROUP BY 1",
    ),
    "s4_gct": oracle(
        _J,
        "j AS (SELECT DISTINCT donor, acceptor, strand FROM fx_junctions), c AS (SELECT j.*, chrom, coalesce((SELECT sum(count) FROM fx_junctions f WHERE f.donor = j.donor AND f.acceptor = j.acceptor AND f.strand = j.strand AND f.chrom = s.chrom), 0) AS n FROM j, (VALUES ('A'), ('N'), ('R')) s(chrom)) SELECT 'S-' || chrom AS sample_id, strand, count(*) AS n, CAST(sum(CASE WHEN donor % 4 = 1 AND chrom = 'R' THEN 0 ELSE n END) AS BIGINT) AS reads, CAST(sum(donor) AS BIGINT) AS sum_donor FROM c GROUP BY 1, 2",
    ),
    "s5_junction_tables": oracle(_J, "SELECT chrom, strand, count(*) AS n, CAST(sum(count) AS BIGINT) AS reads, CAST(sum(donor) AS BIGINT) AS sum_donor FROM fx_junctions GROUP BY 1, 2"),
    "s6_shards": oracle(_J, "SELECT chrom, count(*) AS n, CAST(sum(count) AS BIGINT) AS reads FROM fx_junctions GROUP BY 1"),
    "s7_sequences": oracle(["fx_contigs"], "SELECT CASE WHEN contig_no % 4 = 2 THEN '-' ELSE '+' END AS strand, count(*) AS n, sum(contig_no)::DOUBLE AS labels, CAST(sum(length) AS BIGINT) AS bases FROM fx_contigs WHERE contig_no % 4 IN (2, 3) GROUP BY 1"),
    "k1_sharded": oracle(
        ["fx_exons"],
        f"r AS (SELECT end_pos - start_pos AS b, coalesce(sum(end_pos - start_pos) OVER (ORDER BY chrom, start_pos, end_pos, tx, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM fx_exons) SELECT CAST(before // {BUDGET} AS BIGINT) AS shard, count(*) AS n, CAST(sum(b) AS BIGINT) AS bases, CAST(1 AS BIGINT) AS n_files FROM r GROUP BY 1",
    ),
    "k1_row_shards": oracle(_J, "SELECT count(*) AS n, true AS all_within FROM fx_junctions"),
    "k2_by_sample": oracle(_J, "SELECT 'S_' || (sample_id::BIGINT % 20) AS sample_id, count(*) AS n FROM fx_junctions GROUP BY 1"),
    "k3_by_chromosome": oracle(_J, "SELECT chrom, chrom AS folder, count(*) AS n, CAST(sum(count) AS BIGINT) AS reads FROM fx_junctions GROUP BY 1"),
    "k4_metadata": oracle(_J, "SELECT count(*) AS rows, CAST(6 AS INTEGER) AS n_columns, 'lineitem' AS input FROM fx_junctions"),
    "k5_guarded": oracle(_J, "SELECT chrom, count(*) AS n FROM fx_junctions WHERE chrom = 'A' GROUP BY 1"),
    "x5_streamed_windows": oracle([], f"{_WIN} UNION ALL SELECT DISTINCT event_type, CAST(NULL AS BIGINT), CAST(date_diff('second', TIMESTAMP '2023-12-31 00:00:00', ts) + 1 AS BIGINT), 'A', 'T', CAST(NULL AS BIGINT), true FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL AND event_id % {LATE} = 0"),
    "x2_batch_windows": oracle([], _WIN),
    "x9_stream_dedup": oracle([], f"{_EV} SELECT chrom, count(*) AS n, CAST(0 AS BIGINT) AS n_held FROM v GROUP BY 1"),
    "s8_shards_by_name": "SELECT count(*) AS n, CAST(sum(date_diff('second', TIMESTAMP '2023-12-31 00:00:00', ts) + 1) AS BIGINT) AS sum_pos, CAST(0 AS BIGINT) AS n_out_of_order, true AS several FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL",
    "x10_stream_counts": "SELECT CASE event_id % 3 WHEN 0 THEN 'SNP' WHEN 1 THEN 'INS' ELSE 'DEL' END AS var_type, count(*) AS n FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL GROUP BY 1",
}
