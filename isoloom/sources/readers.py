"""Readers of FASTA, GTF, VCF, GCT, junction tables, Parquet shards and JSON lines as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isoloom.functions import ids
from isoloom.schema import SEQUENCE_SAMPLE, require_columns
from isoloom.sources.bgzf import SPLIT, read_lines
from isoloom.sources.scratch import written

#: Contigs whose lengths are broadcast.
LENGTHS_ROWS = 200_000
_JUNCTION_COLUMNS = ("sample_id", "chrom", "donor", "acceptor", "strand", "count")


def read_fasta(spark: SparkSession, path: str, only_chr: bool = False) -> DataFrame:
    """(chrom, length, seq): a row a contig, upper-cased, name up to the first space."""
    rows = spark.read.text(path, lineSep=">").where(F.trim("value") != "")
    head = F.substring_index("value", "\n", 1)
    seq = F.upper(F.regexp_replace(F.col("value").substr(F.length(head) + 1, F.length("value")), r"\s", ""))
    out = rows.select(F.split(F.trim(head), r"\s")[0].alias("chrom"), seq.alias("seq")).select("chrom", F.length("seq").cast("long").alias("length"), "seq")
    return out.where(F.col("chrom").startswith("chr")) if only_chr else out


def sequence_chunks(contigs: DataFrame, size: int) -> DataFrame:
    """(chrom, chunk_id, chunk_start, chunk): contigs cut up, so that no later row holds a whole chromosome."""
    pieces = F.posexplode(F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))).alias("chunk_id", "chunk")
    return contigs.select("chrom", pieces).select("chrom", F.col("chunk_id").cast("long").alias("chunk_id"), (F.col("chunk_id").cast("long") * size).alias("chunk_start"), "chunk")


def text_lines(spark: SparkSession, path: str, bgzf: bool = False, split: int = SPLIT) -> DataFrame:
    """(value, file, block, line, at): lines with the block of the file that they are in, in order there.  Block-compressed
    files are split like plain ones and tell each line's virtual offset ``at``, which is null for plain text."""
    if bgzf:
        return read_lines(spark, path, split)
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), F.lit(None).cast("long").alias("at"))


def fasta_lines(lines: DataFrame, only_chr: bool = False) -> DataFrame:
    """(chrom, at_base, bases, file, at) of FASTA text from :func:`text_lines`: every line of bases with its contig and its
    offset there.

    Lines are placed by file and block of the file; each block's last header and the bases after it are known from a
    small table of blocks, and so each line's contig and offset.  Both are read from lines that are written once, so that the
    text is unpacked once."""
    head = F.when(F.col("value").startswith(">"), F.split(F.trim(F.substring("value", 2, 1 << 20)), r"\s")[0])
    lines = lines.withColumn("head", head).withColumn("bases", F.when(head.isNull(), F.upper(F.regexp_replace("value", r"\s", ""))).otherwise(F.lit(""))).drop("value")
    here = W.partitionBy("file", "block").orderBy("line").rowsBetween(W.unboundedPreceding, W.currentRow)
    lines = lines.withColumn("seen", F.sum(F.length("bases").cast("long")).over(here)).withColumn("name", F.last("head", ignorenulls=True).over(here)).withColumn("base", F.last(F.when(F.col("head").isNotNull(), F.col("seen")), ignorenulls=True).over(here))
    lines = written(lines.drop("head"), "fasta-lines")
    last = F.max_by(F.struct("name", (F.col("seen") - F.coalesce("base", F.lit(0))).alias("tail")), "line")
    blocks = lines.groupBy("file", "block").agg(last.alias("x")).select("file", "block", "x.name", "x.tail")  # a row a block
    along = W.partitionBy("file").orderBy("block")
    blocks = blocks.withColumn("record", F.count("name").over(along)).withColumn("so_far", F.sum("tail").over(W.partitionBy("file", "record").orderBy("block")))
    blocks = blocks.withColumn("of", F.last("name", ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, -1))).withColumn("carried", F.coalesce(F.lag("so_far").over(along), F.lit(0)))
    placed = lines.join(blocks.select("file", "block", "of", "carried").hint("merge"), ["file", "block"])
    offset = F.when(F.col("base").isNull(), F.col("carried") + F.col("seen")).otherwise(F.col("seen") - F.col("base")) - F.length("bases")
    rows = placed.select(F.coalesce("name", "of").alias("chrom"), offset.alias("at_base"), "bases", "file", "at").where(F.col("chrom").isNotNull() & (F.length("bases") > 0))
    return rows.where(F.col("chrom").startswith("chr")) if only_chr else rows


def read_fasta_chunks(spark: SparkSession, path: str, size: int, only_chr: bool = False, bgzf: bool = False, split: int = SPLIT) -> DataFrame:
    """(chrom, chunk_id, chunk_start, chunk) of FASTA text, whatever the length of a record: no row or task holds one."""
    rows = fasta_lines(text_lines(spark, path, bgzf, split), only_chr).select("chrom", F.col("at_base").alias("at"), "bases")
    first, beyond = F.floor(F.col("at") / size), F.floor((F.col("at") + F.length("bases") - 1) / size)
    cut = rows.withColumn("chunk_id", F.explode(F.sequence(first, beyond)))
    lo = F.greatest(F.col("chunk_id") * size - F.col("at"), F.lit(0))
    piece = F.struct(F.greatest("at", F.col("chunk_id") * size).alias("at"), F.col("bases").substr((lo + 1).cast("int"), (F.least((F.col("chunk_id") + 1) * size - F.col("at"), F.length("bases")) - lo).cast("int")).alias("p"))
    grouped = cut.groupBy("chrom", "chunk_id").agg(F.array_sort(F.collect_list(piece)).alias("parts"))
    return grouped.select("chrom", "chunk_id", (F.col("chunk_id") * size).alias("chunk_start"), F.array_join(F.transform("parts", lambda x: x["p"]), "").alias("chunk"))


def window_sequences(windows: DataFrame, lengths: DataFrame, chunks: DataFrame, size: int) -> DataFrame:
    """``windows`` (chrom, start, end) with ``seq`` put together from the chunks they touch, N beyond either end."""
    lo = F.floor(F.greatest("start", F.lit(0)) / size)
    hi = F.floor((F.least(F.col("end"), F.col("length")) - 1) / size)
    few = lengths.limit(LENGTHS_ROWS + 1).count() <= LENGTHS_ROWS
    lengths = lengths.select("chrom", F.col("length").cast("long").alias("length"))
    wanted = windows.select("chrom", "start", "end").distinct().join(F.broadcast(lengths) if few else lengths.hint("merge"), "chrom")
    spread = wanted.withColumn("chunk_id", F.explode_outer(F.when(hi >= lo, F.sequence(lo, hi))))
    joined = spread.join(chunks.hint("merge"), ["chrom", "chunk_id"], "left")
    a, b = F.greatest(F.col("start") - F.col("chunk_start"), F.lit(0)), F.least(F.col("end") - F.col("chunk_start"), F.length("chunk"))
    piece = F.col("chunk").substr((a + 1).cast("int"), (b - a).cast("int"))
    parts = joined.groupBy("chrom", "start", "end", "length").agg(F.array_sort(F.collect_list(F.when(F.col("chunk").isNotNull(), F.struct("chunk_id", piece.alias("p"))))).alias("parts"))
    left = F.greatest(F.lit(0), F.least("end", F.lit(0)) - F.col("start")).cast("int")
    body = F.array_join(F.transform("parts", lambda x: x["p"]), "")
    right = (F.col("end") - F.col("start")).cast("int") - left - F.length(body)
    return parts.select("chrom", "start", "end", F.concat(F.repeat(F.lit("N"), left), body, F.repeat(F.lit("N"), right)).alias("seq"))


#: Why a line is left out: too few or too many fields, an unreadable number, a count of samples that isn't the header's.
REASONS = ("fields", "number", "samples")


def _parsed(lines: DataFrame, reason: Column, row: Column) -> DataFrame:
    """(line, reason, row): the row, or the line and why it is none."""
    out = lines.withColumn("reason", reason)
    return out.select(F.when(F.col("reason").isNotNull(), F.col("value")).alias("line"), "reason", F.when(F.col("reason").isNull(), row).alias("row"))


def _lines(spark: SparkSession, path: str, bgzf: bool = False, split: int = SPLIT) -> DataFrame:
    """Lines that are no comments, with their tab-separated fields f."""
    return (read_lines(spark, path, split).select("value") if bgzf else spark.read.text(path)).where(~F.col("value").startswith("#")).select("value", F.split("value", "\t").alias("f"))


def _f(k: int) -> Column:
    return F.get("f", k)


def _known(c: Column) -> Column:
    return F.when(c != ".", c)


def parsed_gtf(spark: SparkSession, path: str, bgzf: bool = False, split: int = SPLIT) -> DataFrame:
    """(line, reason, row): a feature row of a line of nine fields with readable bounds, else the line and the reason.  The
    ninth field may be empty."""
    start, end = _f(3).try_cast("bigint"), _f(4).try_cast("bigint")
    reason = F.when(F.size("f") != 9, "fields").when(start.isNull() | end.isNull(), "number")
    row = F.struct(_f(0).alias("chrom"), _f(1).alias("source"), _f(2).alias("feature"), (start - 1).alias("start"), end.alias("end"), _f(6).alias("strand"), ids.parse_attributes(_f(8)).alias("attrs"))
    return _parsed(_lines(spark, path, bgzf, split), reason, row)


def parsed_vcf(spark: SparkSession, path: str, bgzf: bool = False, split: int = SPLIT) -> DataFrame:
    """(line, reason, row): a line of eight fields or more with a readable position, else the reason; ``row.alts`` has all
    alternate alleles."""
    pos = _f(1).try_cast("bigint")
    reason = F.when(F.size("f") < 8, "fields").when(pos.isNull(), "number")
    row = F.struct(
        _f(0).alias("chrom"), pos.alias("pos"), _known(_f(2)).alias("id"), _f(3).alias("ref"), F.split(_f(4), ",").alias("alts"), _known(_f(5)).try_cast("double").alias("qual"),
        _f(6).alias("filter"), _f(7).alias("info"), F.slice("f", 9, 1 << 30).alias("samples"),
    )
    return _parsed(_lines(spark, path, bgzf, split), reason, row)


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNull()).select("row.*")


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNotNull()).select("line", "reason")


def read_gtf(spark: SparkSession, path: str, features: Sequence[str] = (), chroms: Sequence[str] = (), bgzf: bool = False) -> DataFrame:
    """Feature rows, half-open from 0; comments, and lines that :func:`parsed_gtf` rejects, are left out."""
    rows = accepted(parsed_gtf(spark, path, bgzf))
    if features:
        rows = rows.where(F.col("feature").isin(*features))
    return rows.where(F.col("chrom").isin(*chroms)) if chroms else rows


def alleles(vcf: DataFrame) -> DataFrame:
    """A row for each alternate allele of rows of :func:`parsed_vcf`."""
    return vcf.withColumn("alt", F.explode("alts")).select("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "samples")


def read_vcf(spark: SparkSession, path: str, bgzf: bool = False, split: int = SPLIT) -> DataFrame:
    """A row for each alternate allele; '.' is null; headers, and lines that :func:`parsed_vcf` rejects, are left out."""
    return alleles(accepted(parsed_vcf(spark, path, bgzf, split)))


def gct_header(spark: SparkSession, path: str, bgzf: bool = False) -> tuple[list[str], bool]:
    """(names, described): the header's fields and whether the second one is a description.

    The version must be #1.2 or #1.3."""
    lines = read_lines(spark, path) if bgzf else spark.read.text(path)
    if lines.where(F.col("value").isin("#1.2", "#1.3")).isEmpty():
        raise ValueError("not a GCT file: no #1.2 or #1.3 line")
    head = lines.where(F.col("value").startswith("Name\t")).first()
    if head is None:
        raise ValueError("GCT file without a header line")
    names = head[0].rstrip("\t").split("\t")
    return names, len(names) > 1 and names[1] == "Description"


def parsed_gct(spark: SparkSession, path: str, names: Sequence[str], described: bool, bgzf: bool = False, split: int = SPLIT) -> DataFrame:
    """(line, reason, row) of a matrix's lines; header and dimensions are neither.  One trailing empty field is dropped, one
    missing count is 0; other ragged lines are rejected."""
    n, first = len(names), 2 if described else 1
    body = _lines(spark, path, bgzf, split).where(~F.col("value").startswith("Name\t") & ~F.col("value").rlike(r"^\d+\t\d+\t*$"))
    fitted = F.when(F.size("f") == n, F.col("f")).when((F.size("f") == n + 1) & (F.element_at("f", -1) == ""), F.slice("f", 1, n)).when(F.size("f") == n - 1, F.concat("f", F.array(F.lit("0"))))
    reason = F.when(F.size("f") < (3 if n > 2 else 2), "fields").when(fitted.isNull(), "samples")
    row = F.struct(F.get(fitted, 0).alias("junction_id"), (F.get(fitted, 1) if described else F.lit(None).cast("string")).alias("gene_id"), F.slice(fitted, first + 1, max(0, n - first)).alias("counts"))
    return _parsed(body, reason, row)


def read_gct(spark: SparkSession, path: str, bgzf: bool = False, split: int = SPLIT) -> DataFrame:
    """Junction counts of a GCT matrix: (junction_id, gene_id or null, sample_id, count); lines that :func:`parsed_gct` rejects
    are left out.  Counts are whole parts of numbers, 0 where unreadable."""
    names, described = gct_header(spark, path, bgzf)
    samples = names[2 if described else 1 :]
    long = accepted(parsed_gct(spark, path, names, described, bgzf, split)).select("junction_id", "gene_id", F.posexplode("counts").alias("k", "x"))
    count = F.coalesce(F.floor(F.col("x").try_cast("double")).cast("long"), F.lit(0).cast("long"))
    # names by place in the header: a table of one row a sample, since the header may hold thousands
    named = spark.createDataFrame(list(enumerate(samples)), "k int, sample_id string")
    return long.join(F.broadcast(named), "k").select("junction_id", "gene_id", "sample_id", count.alias("count"))


def gct_junctions(gct: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(junction table, rows whose id can't be read)."""
    parsed = gct.withColumn("j", ids.parse_junction(F.col("junction_id")))
    good = parsed.where(F.col("j").isNotNull()).select("sample_id", "j.chrom", "j.donor", "j.acceptor", "j.strand", "count")
    return good, parsed.where(F.col("j").isNull()).drop("j")


def read_junctions(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Junction tables by extension (.parquet, .csv, .tsv, .txt), stacked; a table without a required column is skipped."""
    kinds: dict[str, list[str]] = {}
    for path in paths:
        kinds.setdefault(path.rsplit(".", 1)[-1], []).append(path)
    if unknown := sorted(set(kinds) - {"parquet", "csv", "tsv", "txt"}):
        raise ValueError(f"unknown format: {', '.join(unknown)}")
    parts = []
    for kind, some in kinds.items():
        if kind == "parquet":
            groups = _by_columns(spark, some, lambda p: spark.read.parquet(p))
            parts += [spark.read.parquet(*same) for same in groups]
        else:
            sep = "," if kind == "csv" else "\t"
            groups = _by_columns(spark, some, lambda p, sep=sep: spark.read.csv(p, sep=sep, header=True))
            parts += [spark.read.csv(same, sep=sep, header=True, enforceSchema=False) for same in groups]
    if not parts:
        raise ValueError("no table has all of " + ", ".join(_JUNCTION_COLUMNS))
    typed = [df.select("sample_id", "chrom", *(F.col(c).try_cast("bigint").alias(c) for c in ("donor", "acceptor")), "strand", F.col("count").try_cast("bigint").alias("count")) for df in parts]
    out = typed[0]
    for df in typed[1:]:
        out = out.unionByName(df)
    return out


def _by_columns(spark: SparkSession, paths: Sequence[str], opened) -> list[list[str]]:
    """Paths that share a schema together, so that each schema is one scan; those without a required column are left out."""
    groups: dict[str, list[str]] = {}
    for path in paths:
        df = opened(path)
        if all(c in df.columns for c in _JUNCTION_COLUMNS):
            groups.setdefault(df.schema.json(), []).append(path)
    return list(groups.values())


def read_shards(spark: SparkSession, paths: Sequence[str] | str, required: Sequence[str] = ()) -> DataFrame:
    """Parquet shards by path or glob; a missing path is an error, as is a missing required column."""
    return require_columns(spark.read.parquet(*([paths] if isinstance(paths, str) else paths)), required)


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines (seq, strand, label): broken lines, missing sequences and letters beyond ACGTN are left out, strand is '+'
    unless given as '-'."""
    rows = spark.read.schema(SEQUENCE_SAMPLE).json(path).where(F.col("seq").isNotNull()).withColumn("seq", F.upper("seq"))
    return rows.where(F.col("seq").rlike("^[ACGTN]*$")).withColumn("strand", F.when(F.col("strand") == "-", "-").otherwise("+"))
