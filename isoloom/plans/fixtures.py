"""Genomics-shaped views over the driver's tables.

The tables hold no annotation, so each query derives what it needs with the SELECTs below; Spark and DuckDB run the
same text but for the few spellings in ``_DIALECT``.  Interval columns are called start_pos and end_pos there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from isoloom.sources.scratch import stored_bytes

_DIALECT = {
    "spark": {"letters": "regexp_replace(text, '[^A-Za-z]', '')", "floats": "LATERAL VIEW posexplode(embedding) p AS pos, x", "each": "LATERAL VIEW posexplode(regexp_extract_all(seq, '(?s).{{1,37}}', 0)) u AS p, piece LATERAL VIEW explode(array(0, 1)) w AS j WHERE u.p <= (n - 10) div 37", "at": "p.pos", "logit": "p.x"},
    "duck": {"letters": "regexp_replace(text, '[^A-Za-z]', '', 'g')", "floats": ", (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos) p", "each": ", (SELECT unnest(list_transform(range(0, (n - 10) // 37 + 1), lambda i: {'p': i, 'piece': substr(seq, 37 * i + 1, 37)})) AS u) q, (VALUES (0), (1)) w(j)", "at": "p.pos", "logit": "p.x"},
}

#: name: (tables and views it reads, SELECT)
_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "fx_junctions": (
        ("lineitem",),
        """SELECT CAST(l_suppkey AS STRING) AS sample_id, l_returnflag AS chrom, CASE WHEN l_linestatus = 'F' THEN '-' ELSE '+' END AS strand,
       l_partkey % 97 AS donor, 1000 + l_partkey % 89 AS acceptor, CAST(sum(floor(l_quantity)) AS BIGINT) AS count
FROM lineitem GROUP BY 1, 2, 3, 4, 5""",
    ),
    "fx_genes": (
        ("part",),
        """SELECT CAST(p_partkey AS STRING) AS gene_id, CASE p_partkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS chrom, CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
       p_partkey * 13 % 400 AS start_pos, p_partkey * 13 % 400 + CAST(p_size AS BIGINT) * 40 AS end_pos
FROM part""",
    ),
    "fx_contigs": (
        ("documents",),
        """SELECT CAST(doc_id AS STRING) AS chrom, doc_id AS contig_no, length(bare) AS length,
       translate(upper(bare), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACGTACGTACGTNACGTACGTACGTA') AS seq
FROM (SELECT doc_id, {letters} AS bare FROM documents) d""",
    ),
    "fx_far_junctions": (
        ("fx_junctions",),
        """SELECT sample_id, chrom, strand, donor + 20000 * (donor % 25) AS donor, acceptor + 20000 * (donor % 25) AS acceptor, count FROM fx_junctions""",
    ),
    "fx_far_genes": (
        ("fx_genes",),
        """SELECT gene_id, chrom, strand, start_pos + 20000 * (CAST(gene_id AS BIGINT) % 25) AS start_pos, end_pos + 20000 * (CAST(gene_id AS BIGINT) % 25) AS end_pos FROM fx_genes""",
    ),
    "fx_exons": (
        ("lineitem", "orders"),
        """SELECT tx, gene_id, chrom, strand, rank, rank * 1000 + l_partkey % 300 AS start_pos, rank * 1000 + l_partkey % 300 + 60 + 3 * CAST(floor(l_quantity) AS BIGINT) AS end_pos
FROM (SELECT l_orderkey AS tx, CAST(o_custkey AS STRING) AS gene_id, CASE l_orderkey % 3 WHEN 0 THEN 'chr1' WHEN 1 THEN 'chr2' ELSE 'chr3' END AS chrom, CASE WHEN o_orderstatus = 'F' THEN '-' ELSE '+' END AS strand,
             l_partkey, l_quantity, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS BIGINT) AS rank
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey) x""",
    ),
    "fx_cds": (
        ("fx_exons",),
        """SELECT e.tx, e.chrom, e.strand, greatest(e.start_pos, c.lo) AS start_pos, least(e.end_pos, c.hi) AS end_pos
FROM fx_exons e JOIN (SELECT f.tx, min(f.start_pos) + 10 AS lo, max(CASE WHEN f.rank = 1 + f.tx % n.n THEN f.start_pos + 30 END) AS hi
                      FROM fx_exons f JOIN (SELECT tx, count(*) AS n FROM fx_exons GROUP BY tx) n ON f.tx = n.tx GROUP BY f.tx) c ON e.tx = c.tx
WHERE e.start_pos < c.hi AND e.end_pos > c.lo""",
    ),
    "fx_variants": (
        ("fx_contigs",),
        """SELECT chrom, contig_no, pos, CASE WHEN k % 10 = 3 THEN translate(good, 'ACGTN', 'CGTAA') ELSE good END AS ref,
       CASE WHEN pos % 10 < 6 THEN translate(good, 'ACGTN', 'TACGC') WHEN pos % 10 < 8 THEN concat(good, 'AC') ELSE substr(good, 1, 1) END AS alt
FROM (SELECT chrom, contig_no, k, pos, substr(piece, place, CASE WHEN pos % 10 < 8 THEN 1 ELSE 3 END) AS good
      FROM (SELECT chrom, contig_no, CAST(2 * u.p + j AS BIGINT) AS k, CAST(37 * u.p + 5 + j * (1 + u.p % 3) AS INT) AS pos, CAST(5 + j * (1 + u.p % 3) AS INT) AS place, u.piece AS piece
            FROM (SELECT chrom, contig_no, seq, length AS n FROM fx_contigs WHERE length >= 10) a {each}) b) d""",
    ),
    "fx_tracks": (
        ("embeddings",),
        """SELECT CAST(floor(vec_id / 4) AS BIGINT) AS locus, CASE vec_id % 4 WHEN 0 THEN 'donor' WHEN 1 THEN 'acceptor' WHEN 2 THEN 'tss' ELSE 'polya' END AS track,
       CAST({at} AS BIGINT) AS pos, 20.0 * CAST({logit} AS DOUBLE) AS logit
FROM embeddings {floats}""",
    ),
    "fx_scored": (
        ("documents", "labels"),
        """SELECT d.doc_id AS example, CAST(d.n_chars AS DOUBLE) AS score, l.quality AS label, l.toxic AS other, ln(1.0 + d.n_chars) - 7 AS logit
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    ),
}

def _order(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for n in names:
        if n in _VIEWS:
            out += [x for x in [*_order(_VIEWS[n][0]), n] if x not in out]
    return out


#: Bytes of the documents whose contigs a task takes.
PIECE = 2 << 20


def pieces(spark: SparkSession, sf_dir: str) -> int:
    """Tasks among which contigs are dealt evenly, however the documents are stored."""
    return stored_bytes(spark, f"{sf_dir}/documents.parquet") // PIECE + 1


def view(spark: SparkSession, sf_dir: str, name: str, parts: int | None = None) -> DataFrame:
    """A fixture view, or a driver table, as a DataFrame with columns start and end.  With ``parts`` contigs are first dealt among
    so many tasks by name, so that what is derived from them grouped by chromosome needs no other shuffle."""
    df = _raw(spark, sf_dir, name, parts)
    return df.withColumnsRenamed({"start_pos": "start", "end_pos": "end"})


def _raw(spark: SparkSession, sf_dir: str, name: str, parts: int | None = None) -> DataFrame:
    if name not in _VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    reads, text = _VIEWS[name]
    text = text.format(**_DIALECT["spark"])
    inputs = {r: _raw(spark, sf_dir, r, parts) for r in reads}
    import re

    for r in reads:
        text = re.sub(rf"\b{r}\b", "{" + r + "}", text)
    df = spark.sql(text, **inputs)
    return df.repartition(parts, "chrom") if parts and name == "fx_contigs" else df


def oracle(names: tuple[str, ...] | list[str], sql: str) -> str:
    """DuckDB SQL that may use the fixture views named; ``sql`` is a SELECT or starts with further CTEs ('x AS (...) SELECT')."""
    parts = [f"{n} AS ({_VIEWS[n][1].format(**_DIALECT['duck'])})" for n in _order(tuple(names))]
    body = sql.strip()
    joined = ",\n".join(parts)
    if body.upper().startswith("SELECT"):
        return f"WITH {joined}\n{body}" if parts else body
    return f"WITH RECURSIVE {joined + ',' if parts else ''}\n{body}"


def positions(df: DataFrame) -> DataFrame:
    """Interval columns under the names that both SQL dialects take."""
    return df.withColumnsRenamed({"start": "start_pos", "end": "end_pos"})
