"""Queries on variants and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from isoloom.functions import ids
from isoloom.functions import variants as fv
from isoloom.operators import intervals, psi, variants
from isoloom.plans.fixtures import oracle, pieces, positions, view
from isoloom.sources import readers

WINDOW, STRIDE, MOST, SEED = 512, 256, 12, 17
#: Places of a contig that is still folded in one row.
PLACES = 500
#: Bases of a chunk of a sequence.
CHUNK = 4096


def _v(spark, sf_dir):
    return variants.typed(view(spark, sf_dir, "fx_variants"))


def _contigs(spark, sf_dir):
    return view(spark, sf_dir, "fx_contigs")


def _sequence(spark, sf_dir):
    """Lengths, chunks and the size of a chunk."""
    c = _contigs(spark, sf_dir)
    return c.select("chrom", "length"), readers.sequence_chunks(c, CHUNK), CHUNK


def _placed(spark, sf_dir, stride=STRIDE):
    return variants.in_windows(_v(spark, sf_dir), _contigs(spark, sf_dir), WINDOW, stride)


def _counts(spark, sf_dir):
    """Counts of windows; contigs are dealt in pieces of bounded size, and a piece's variants are counted where they are made."""
    v = variants.typed(view(spark, sf_dir, "fx_variants", pieces(spark, sf_dir)))
    return variants.window_counts(variants.in_windows(v, _contigs(spark, sf_dir), WINDOW, STRIDE))


def p5_parse_spec(spark, sf_dir):
    v = _v(spark, sf_dir).select(ids.parse_spec(F.lower(F.concat(F.lit("chr"), F.regexp_replace("spec", ">", " > ")))).alias("s"))
    return v.groupBy("s.type").agg(F.count(F.lit(1)).alias("n"), F.sum("s.pos0").alias("sum_pos0"), F.sum("s.pos1").alias("sum_pos1"))


def p6_types(spark, sf_dir):
    v = _v(spark, sf_dir)
    return v.groupBy("var_type", ids.spec_type(F.col("ref"), F.col("alt")).alias("spec_type")).agg(F.count(F.lit(1)).alias("n"))


def p7_specs(spark, sf_dir):
    return _v(spark, sf_dir).select("spec", F.concat_ws(":", "chrom", F.lit("0"), "spec").alias("variant_id"))


def u2_first_of_equals(spark, sf_dir):
    v = view(spark, sf_dir, "fx_variants")
    twice = v.withColumn("copy", F.lit(0)).unionByName(v.where("pos % 3 = 0").withColumn("copy", F.lit(1)))
    return variants.first_of_equals(twice, [F.col("copy")]).select("chrom", "pos", "ref", "alt", "copy")


def a13_duplicates(spark, sf_dir):
    v = view(spark, sf_dir, "fx_variants")
    return variants.duplicates(v.unionByName(v.where("pos % 3 = 0")))


def j4_in_windows(spark, sf_dir):
    return _placed(spark, sf_dir).select("chrom", F.col("start").alias("start_pos"), "spec", "in_window_idx")


def f8_inside_sequence(spark, sf_dir):
    v = intervals.looked_up(_v(spark, sf_dir), _contigs(spark, sf_dir).select("chrom", "length"), ["chrom"])
    return v.where(F.col("pos").between(1, F.col("length") - 10)).groupBy("chrom").agg(F.count(F.lit(1)).alias("n"))


def j7_windows_of_variants(spark, sf_dir):
    return positions(_placed(spark, sf_dir).select("chrom", "start", "end").distinct())


def p15_alignment(spark, sf_dir):
    v = _v(spark, sf_dir)
    spec = F.struct(F.col("chrom"), (F.col("pos").cast("long") - 1).alias("pos0"), (F.col("pos").cast("long") - 1 + F.length("ref")).alias("pos1"), F.col("ref"))
    a = v.select("chrom", "spec", fv.align(spec, F.col("chrom"), F.lit(100).cast("long"), F.lit(612).cast("long")).alias("a"))
    return a.select("chrom", "spec", "a.in_window", "a.in_window_idx", F.get("a.span", 0).alias("span_from"), F.get("a.span", 1).alias("span_to"))


def p16_channels(spark, sf_dir):
    c = variants.channels(_placed(spark, sf_dir), WINDOW)
    return c.select("chrom", F.col("start").alias("start_pos"), *(F.array_join(k, ",").alias(k) for k in ("ch_snp", "ch_ins", "ch_del", "ch_any")))


def _spec_rows(spark, sf_dir):
    p = _placed(spark, sf_dir, WINDOW)
    span = F.array(F.col("idx0"), F.least(F.col("idx0") + F.length("ref"), F.lit(WINDOW)))
    return p.withColumn("kind", ids.spec_type(F.col("ref"), F.col("alt"))).withColumn("span", span)


def p17_spec_channels(spark, sf_dir):
    r = _spec_rows(spark, sf_dir).withColumn("c", fv.spec_channels(F.lit(WINDOW).cast("long"), F.col("idx0"), F.col("span"), F.col("kind")))
    return r.select("spec", F.col("start").alias("start_pos"), *(F.array_join(F.array_sort(f"c.{k}"), ",").alias(f"ch_{k}") for k in ("snp", "ins", "del", "any")))


def p18_apply_spec(spark, sf_dir):
    rows = _spec_rows(spark, sf_dir)
    cut = readers.window_sequences(rows, *_sequence(spark, sf_dir))
    r = rows.join(cut.hint("merge"), ["chrom", "start", "end"])
    return r.select("spec", F.col("start").alias("start_pos"), F.md5(fv.apply_spec(F.col("seq"), F.col("idx0"), F.col("span"), F.col("ref"), F.col("alt"), F.col("kind")).cast("binary")).alias("seq_alt_md5"))


def p19_apply_many(spark, sf_dir):
    e = variants.edited_windows(_placed(spark, sf_dir), *_sequence(spark, sf_dir))
    return e.select("chrom", F.col("start").alias("start_pos"), "seq_alt")


def p20_rescue(spark, sf_dir):
    v = variants.with_bases(_v(spark, sf_dir).where("var_type = 'INS'"), *_sequence(spark, sf_dir), before=1, after=1)
    r = v.select("spec", fv.rescue(F.col("bases"), F.col("bases_start"), F.col("pos"), F.col("ref"), F.col("alt")).alias("r"))
    return r.select("spec", "r.pos", "r.ref", "r.alt")


def p21_mismatches(spark, sf_dir):
    return variants.reference_mismatches(_v(spark, sf_dir), *_sequence(spark, sf_dir))


def x3_without_conflicts(spark, sf_dir):
    return variants.without_conflicts(_placed(spark, sf_dir), WINDOW).select("chrom", F.col("start").alias("start_pos"), "spec")


def x3_whole_contigs(spark, sf_dir):
    """One window a contig, whatever its length: folded by islands, those of many places followed by pointers."""
    v = intervals.looked_up(_v(spark, sf_dir), _contigs(spark, sf_dir).select("chrom", F.col("length").cast("long").alias("end")), ["chrom"])
    kept = variants.without_conflicts(v.withColumn("start", F.lit(0).cast("long")), task_places=PLACES)
    return kept.groupBy("chrom").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("sum_pos"), F.sum("span_end").alias("sum_end"))


def x4_balanced(spark, sf_dir):
    return variants.balanced(_placed(spark, sf_dir), MOST, SEED).select("chrom", F.col("start").alias("start_pos"), "var_type", "spec")


def a5_window_counts(spark, sf_dir):
    c = _counts(spark, sf_dir)
    return c.select("chrom", F.col("start").alias("start_pos"), "variant_count", F.col("SNP").alias("n_snp"), F.col("INS").alias("n_ins"), F.col("DEL").alias("n_del"), F.col("UNK").alias("n_unk"))


def a9_count_spread(spark, sf_dir):
    tiles = intervals.tiles(_contigs(spark, sf_dir), WINDOW, STRIDE)
    s = variants.count_spread(_counts(spark, sf_dir), tiles)
    return s.select("n_windows", "n_with", F.round("share", 9).alias("share"), "least", "most", F.round("mean", 9).alias("mean"), "p5", "p25", "p50", "p75", "p95")


def a10_stage_counts(spark, sf_dir):
    placed = _placed(spark, sf_dir)
    s = variants.stage_counts({"vcf": _v(spark, sf_dir), "in_window": placed, "selected": variants.without_conflicts(placed, WINDOW)})
    return s.select("stage", "var_type", "n", F.round("percent", 9).alias("percent"))


def t2_top_windows(spark, sf_dir):
    return variants.top_windows(_counts(spark, sf_dir)).select("chrom", F.col("start").alias("start_pos"), "variant_count")


def t5_natural_order(spark, sf_dir):
    """All chromosomes in one order: those of the variants, and the usual names 1 to 22, X, Y and M, here and there bare."""
    names = F.when(F.col("contig_no") % 29 < 22, (F.col("contig_no") % 29 + 1).cast("string")).when(F.col("contig_no") % 29 < 25, F.substring(F.lit("XYM"), (F.col("contig_no") % 29 - 21).cast("int"), F.lit(1))).otherwise(F.col("chrom"))
    v = _v(spark, sf_dir).select(F.concat(F.when(F.col("contig_no") % 7 == 0, "").otherwise("chr"), names).alias("chrom")).distinct()
    return variants.natural_ranks(v)


def u3_distinct_windows(spark, sf_dir):
    return _placed(spark, sf_dir).select("chrom", F.col("start").alias("start_pos")).distinct()


def x2_rewindowed(spark, sf_dir):
    r = variants.rewindowed(_placed(spark, sf_dir, WINDOW), WINDOW, STRIDE)
    return r.select("chrom", F.col("start").alias("start_pos"), "spec", "in_window_idx", "span_from", "span_to")


def j5_window_summary(spark, sf_dir):
    tiles = intervals.tiles(_contigs(spark, sf_dir).select("chrom", "length"), WINDOW, STRIDE).select("chrom", "start", "end")
    j = view(spark, sf_dir, "fx_junctions")
    metrics = psi.window_metrics(psi.psi(j).withColumn("chrom", (F.col("donor") % 50).cast("string")), WINDOW, STRIDE)
    s = variants.window_summary(tiles, metrics, _counts(spark, sf_dir))
    return s.select("chrom", F.col("start").alias("start_pos"), "variant_count", "gtex_count_sum", "gtex_junction_length_max")


_QUERIES = (
    p5_parse_spec, p6_types, p7_specs, p15_alignment, p16_channels, p17_spec_channels, p18_apply_spec, p19_apply_many, p20_rescue, p21_mismatches, u2_first_of_equals, u3_distinct_windows, a5_window_counts,
    a9_count_spread, a10_stage_counts, a13_duplicates, f8_inside_sequence, j4_in_windows, j5_window_summary, j7_windows_of_variants, t2_top_windows, t5_natural_order, x2_rewindowed, x3_without_conflicts, x3_whole_contigs, x4_balanced,
)
QUERIES = {f.__name__: f for f in _QUERIES}

_F = ["fx_contigs", "fx_variants"]
_T = """v AS (SELECT *, CASE WHEN length(ref) < length(alt) THEN 'INS' WHEN length(ref) > length(alt) THEN 'DEL' ELSE 'SNP' END AS var_type, chrom || ':' || pos || ref || '>' || alt AS spec, CAST(pos - 1 AS BIGINT) AS s FROM fx_variants),
t AS (SELECT *, CAST(s + CASE WHEN var_type = 'INS' THEN 1 ELSE length(ref) END AS BIGINT) AS e, CASE WHEN length(ref) = 1 AND length(alt) = 1 THEN 'SNP' ELSE 'INDEL' END AS kind FROM v)"""


def _w(stride: int) -> str:
    return f"""{_T}, w AS (SELECT t.*, CAST(k * {stride} AS BIGINT) AS start_pos, CAST(t.s - k * {stride} AS BIGINT) AS idx0, c.seq, c.length FROM
 (SELECT *, unnest(range(CAST(greatest(0, ceil((s - {WINDOW} + 1) / {stride})) AS BIGINT), CAST(floor(s / {stride}) AS BIGINT) + 1)) AS k FROM t) t JOIN fx_contigs c ON c.chrom = t.chrom WHERE k * {stride} + {WINDOW} <= c.length)"""


_W = _w(STRIDE)
_ALL = 'w AS (SELECT *, row_number() OVER (PARTITION BY chrom, start_pos ORDER BY s, e, pos, ref, alt) AS r FROM {0})'
_GREEDY = """g AS (SELECT chrom, start_pos, spec, var_type, pos, ref, e, r, true AS kept, e AS last FROM x WHERE r = 1
      UNION ALL SELECT x.chrom, x.start_pos, x.spec, x.var_type, x.pos, x.ref, x.e, x.r, x.s >= g.last, CASE WHEN x.s >= g.last THEN x.e ELSE g.last END FROM g JOIN x ON x.chrom = g.chrom AND x.start_pos = g.start_pos AND x.r = g.r + 1)"""
_RANKED = "x AS (SELECT *, row_number() OVER (PARTITION BY chrom, start_pos ORDER BY s, e, pos, ref, alt) AS r FROM {0})"
_COUNTS = "c AS (SELECT chrom, start_pos, count(*) AS variant_count, count(*) FILTER (var_type = 'SNP') AS n_snp, count(*) FILTER (var_type = 'INS') AS n_ins, count(*) FILTER (var_type = 'DEL') AS n_del FROM (SELECT DISTINCT chrom, start_pos, pos, ref, alt, var_type FROM w) d GROUP BY 1, 2)"
_CLIPPED = f"least(idx0 + length(ref), {WINDOW})"
_DELS = f"d AS (SELECT DISTINCT chrom, start_pos, unnest(range(idx0, {_CLIPPED})) AS b FROM w WHERE var_type = 'DEL')"

ORACLES = {
    "p5_parse_spec": oracle(_F, f"{_T} SELECT kind AS type, count(*) AS n, CAST(sum(s) AS BIGINT) AS sum_pos0, CAST(sum(pos) AS BIGINT) AS sum_pos1 FROM t GROUP BY 1"),
    "p6_types": oracle(_F, f"{_T} SELECT var_type, kind AS spec_type, count(*) AS n FROM t GROUP BY 1, 2"),
    "p7_specs": oracle(_F, f"{_T} SELECT spec, chrom || ':0:' || spec AS variant_id FROM t"),
    "u2_first_of_equals": oracle(_F, "SELECT DISTINCT chrom, pos, ref, alt, 0 AS copy FROM fx_variants"),
    "a13_duplicates": oracle(_F, "a AS (SELECT chrom, pos, ref, alt FROM fx_variants UNION ALL SELECT chrom, pos, ref, alt FROM fx_variants WHERE pos % 3 = 0) SELECT count(*) AS n_rows, count(DISTINCT (chrom, pos, ref, alt)) AS n_unique, count(*) - count(DISTINCT (chrom, pos, ref, alt)) AS n_duplicates FROM a"),
    "j4_in_windows": oracle(_F, f"{_W} SELECT chrom, start_pos, spec, idx0 + 1 AS in_window_idx FROM w"),
    "f8_inside_sequence": oracle(_F, "SELECT v.chrom, count(*) AS n FROM fx_variants v JOIN fx_contigs c ON v.chrom = c.chrom WHERE pos BETWEEN 1 AND length - 10 GROUP BY 1"),
    "j7_windows_of_variants": oracle(_F, f"{_W} SELECT DISTINCT chrom, start_pos, start_pos + {WINDOW} AS end_pos FROM w"),
    "u3_distinct_windows": oracle(_F, f"{_W} SELECT DISTINCT chrom, start_pos FROM w"),
    "p15_alignment": oracle(
        _F,
        f"{_T} SELECT chrom, spec, s >= 100 AND s < 612 AS in_window, CASE WHEN s >= 100 AND s < 612 THEN s - 100 END AS in_window_idx, CASE WHEN s + length(ref) > 100 AND s < 612 THEN greatest(0, s - 100) END AS span_from, CASE WHEN s + length(ref) > 100 AND s < 612 THEN least(512, s + length(ref) - 100) END AS span_to FROM t",
    ),
    "p16_channels": oracle(
        _F,
        f"""{_W}, {_DELS}, a AS (SELECT DISTINCT chrom, start_pos, idx0, var_type FROM w),
h AS (SELECT chrom, start_pos, coalesce(string_agg(idx0::STRING, ',' ORDER BY idx0) FILTER (var_type = 'SNP'), '') AS ch_snp, coalesce(string_agg(idx0::STRING, ',' ORDER BY idx0) FILTER (var_type = 'INS'), '') AS ch_ins FROM a GROUP BY 1, 2),
y AS (SELECT chrom, start_pos, string_agg(idx0::STRING, ',' ORDER BY idx0) AS ch_any FROM (SELECT DISTINCT chrom, start_pos, idx0 FROM w) q GROUP BY 1, 2),
z AS (SELECT chrom, start_pos, string_agg(b::STRING, ',' ORDER BY b) AS ch_del FROM d GROUP BY 1, 2)
SELECT h.chrom, h.start_pos, ch_snp, ch_ins, coalesce(ch_del, '') AS ch_del, ch_any FROM h JOIN y USING (chrom, start_pos) LEFT JOIN z USING (chrom, start_pos)""",
    ),
    "p17_spec_channels": oracle(_F, f"{_w(WINDOW)} SELECT spec, start_pos, CASE WHEN kind = 'SNP' THEN idx0::STRING ELSE '' END AS ch_snp, '' AS ch_ins, CASE WHEN kind = 'SNP' THEN '' ELSE array_to_string(range(idx0, {_CLIPPED}), ',') END AS ch_del, CASE WHEN kind = 'SNP' THEN idx0::STRING ELSE array_to_string(range(idx0, {_CLIPPED}), ',') END AS ch_any FROM w"),
    "p18_apply_spec": oracle(_F, f"{_w(WINDOW)} SELECT spec, start_pos, md5(substr(seq, start_pos + 1, idx0) || alt || substr(seq, start_pos + {_CLIPPED} + 1, {WINDOW} - {_CLIPPED})) AS seq_alt_md5 FROM w"),
    "p19_apply_many": oracle(
        _F,
        f"""{_W}, a AS (SELECT *, substr(seq, start_pos + 1, {WINDOW}) AS body, {_CLIPPED} AS z FROM w),
b AS (SELECT *, substr(body, idx0 + 1, z - idx0) AS actual, coalesce(lag(z) OVER (PARTITION BY chrom, start_pos ORDER BY idx0, ref, alt), 0) AS prev FROM a),
f AS (SELECT *, CASE WHEN actual = ref OR var_type <> 'INS' THEN alt ELSE actual || CASE WHEN starts_with(alt, ref) THEN substr(alt, length(ref) + 1) ELSE alt END END AS new FROM b)
SELECT chrom, start_pos, CASE WHEN bool_and(idx0 >= prev) THEN string_agg(substr(body, prev + 1, greatest(idx0 - prev, 0)) || new, '' ORDER BY idx0, ref, alt) || substr(any_value(body), CAST(max(z) + 1 AS BIGINT)) ELSE repeat('N', {WINDOW}) END AS seq_alt FROM f GROUP BY 1, 2""",
    ),
    "p20_rescue": oracle(
        _F,
        f"""{_T}, a AS (SELECT t.*, substr(seq, pos, 1) AS h, CASE WHEN pos > 1 THEN substr(seq, pos - 1, 1) END AS l, CASE WHEN pos < length THEN substr(seq, pos + 1, 1) END AS g FROM t JOIN fx_contigs c ON c.chrom = t.chrom WHERE var_type = 'INS')
SELECT spec, CAST(CASE WHEN h = ref THEN pos WHEN l = ref THEN pos - 1 WHEN g = ref THEN pos + 1 ELSE pos END AS BIGINT) AS pos, CASE WHEN h = ref OR l = ref OR g = ref THEN ref ELSE h END AS ref, CASE WHEN h = ref OR l = ref OR g = ref THEN alt WHEN starts_with(alt, ref) THEN h || substr(alt, 2) ELSE alt END AS alt FROM a""",
    ),
    "p21_mismatches": oracle(_F, f"{_T} SELECT var_type, count(*) AS n, count(*) FILTER (substr(seq, pos, length(ref)) <> ref) AS n_mismatches FROM t JOIN fx_contigs c ON c.chrom = t.chrom GROUP BY 1"),
    "x3_without_conflicts": oracle(_F, f"{_W}, {_RANKED.format('w')}, {_GREEDY} SELECT chrom, start_pos, spec FROM g WHERE kept"),
    "x3_whole_contigs": oracle(
        _F,
        f"""{_T}, w AS (SELECT *, CAST(0 AS BIGINT) AS start_pos FROM t), {_RANKED.format('w')}, {_GREEDY} SELECT chrom, count(*) AS n, CAST(sum(pos) AS BIGINT) AS sum_pos, CAST(sum(e) AS BIGINT) AS sum_end FROM g WHERE kept GROUP BY 1""",
    ),
    "x4_balanced": oracle(
        _F,
        f"""{_W}, {_COUNTS}, l AS (SELECT *, least(variant_count, {MOST}) AS cap FROM c),
q AS (SELECT *, floor(cap * n_snp / variant_count) AS a, floor(cap * n_ins / variant_count) AS b, floor(cap * n_del / variant_count) AS d FROM l),
o AS (SELECT chrom, start_pos, a + CASE WHEN n_snp >= n_ins AND n_snp >= n_del THEN cap - a - b - d ELSE 0 END AS q_snp, b + CASE WHEN NOT (n_snp >= n_ins AND n_snp >= n_del) AND n_ins >= n_del THEN cap - a - b - d ELSE 0 END AS q_ins,
      d + CASE WHEN NOT (n_snp >= n_ins AND n_snp >= n_del) AND NOT n_ins >= n_del THEN cap - a - b - d ELSE 0 END AS q_del FROM q),
u AS (SELECT w.*, CASE var_type WHEN 'SNP' THEN q_snp WHEN 'INS' THEN q_ins ELSE q_del END AS quota, row_number() OVER (PARTITION BY w.chrom, w.start_pos, var_type ORDER BY md5('{SEED}:' || spec), spec) AS turn FROM w JOIN o ON o.chrom = w.chrom AND o.start_pos = w.start_pos),
x AS (SELECT *, row_number() OVER (PARTITION BY chrom, start_pos ORDER BY var_type = 'SNP', turn, var_type = 'DEL') AS r FROM u),
g AS (SELECT chrom, start_pos, r, [{{'s': s, 'e': e, 't': var_type, 'p': spec}}] AS kept FROM x WHERE r = 1 AND quota > 0 UNION ALL
      SELECT chrom, start_pos, r, [] FROM x WHERE r = 1 AND quota <= 0 UNION ALL
      SELECT x.chrom, x.start_pos, x.r, CASE WHEN len(list_filter(kept, lambda y: y.t = x.var_type)) < quota AND len(list_filter(kept, lambda y: y.s < x.e AND x.s < y.e)) = 0 THEN list_append(kept, {{'s': s, 'e': e, 't': var_type, 'p': spec}}) ELSE kept END
      FROM g JOIN x ON x.chrom = g.chrom AND x.start_pos = g.start_pos AND x.r = g.r + 1),
k AS (SELECT chrom, start_pos, unnest(arg_max(kept, r)) AS y FROM g GROUP BY 1, 2)
SELECT chrom, start_pos, y.t AS var_type, y.p AS spec FROM k""",
    ),
    "a5_window_counts": oracle(_F, f"{_W}, {_COUNTS} SELECT chrom, start_pos, variant_count, n_snp, n_ins, n_del, CAST(0 AS BIGINT) AS n_unk FROM c"),
    "a9_count_spread": oracle(
        _F,
        f"""{_W}, {_COUNTS}, n AS (SELECT sum((length - {WINDOW}) // {STRIDE} + 1) AS n FROM fx_contigs WHERE length >= {WINDOW})
SELECT CAST(any_value(n) AS BIGINT) AS n_windows, count(*) AS n_with, round(count(*) / any_value(n), 9) AS share, min(variant_count) AS least, max(variant_count) AS most, round(avg(variant_count), 9) AS mean, {", ".join(f"quantile_cont(variant_count, {p / 100}) AS p{p}" for p in (5, 25, 50, 75, 95))} FROM c, n""",
    ),
    "a10_stage_counts": oracle(
        _F,
        f"""{_W}, {_RANKED.format("w")}, {_GREEDY}, a AS (SELECT 'vcf' AS stage, var_type FROM t UNION ALL SELECT 'in_window', var_type FROM w UNION ALL SELECT 'selected', var_type FROM g WHERE kept)
SELECT stage, coalesce(var_type, 'ALL') AS var_type, count(*) AS n, round(100.0 * count(*) / max(total), 9) AS percent FROM (SELECT *, count(*) OVER (PARTITION BY stage) AS total FROM a) b GROUP BY GROUPING SETS ((stage, var_type), (stage))""",
    ),
    "t2_top_windows": oracle(_F, f"{_W}, {_COUNTS} SELECT chrom, start_pos, variant_count FROM c ORDER BY variant_count DESC, chrom, start_pos LIMIT 5"),
    "t5_natural_order": oracle(
        _F,
        """n AS (SELECT DISTINCT CASE WHEN contig_no % 7 = 0 THEN '' ELSE 'chr' END || CASE WHEN contig_no % 29 < 22 THEN (contig_no % 29 + 1)::STRING WHEN contig_no % 29 < 25 THEN substr('XYM', CAST(contig_no % 29 - 21 AS BIGINT), 1) ELSE chrom END AS chrom FROM fx_variants)
SELECT chrom, row_number() OVER (ORDER BY length(regexp_replace(chrom, '^chr', '')), regexp_replace(chrom, '^chr', ''), chrom) AS place FROM n""",
    ),
    "x2_rewindowed": oracle(
        _F,
        f"""{_w(WINDOW)}, b AS (SELECT chrom, min(start_pos) AS first, max(start_pos) + {WINDOW} AS last FROM w GROUP BY 1),
y AS (SELECT * EXCLUDE (k), CAST(first + k * {STRIDE} AS BIGINT) AS start_pos FROM (SELECT w.* EXCLUDE (start_pos, k), first, last, unnest(range(0, CAST((s - first) // {STRIDE} + 1 AS BIGINT))) AS k FROM w JOIN b ON b.chrom = w.chrom) q WHERE s < first + k * {STRIDE} + {WINDOW} AND first + k * {STRIDE} < last),
{_RANKED.format("y")}, {_GREEDY}
SELECT chrom, start_pos, spec, pos - start_pos AS in_window_idx, pos - start_pos AS span_from, pos - start_pos + length(ref) AS span_to FROM g WHERE kept""",
    ),
    "j5_window_summary": oracle(
        [*_F, "fx_junctions"],
        f"""{_W}, {_COUNTS}, l AS (SELECT chrom, CAST(unnest(range(0, (length - {WINDOW}) // {STRIDE} + 1)) * {STRIDE} AS BIGINT) AS start_pos FROM fx_contigs WHERE length >= {WINDOW}),
m AS (SELECT (donor % 50)::STRING AS chrom, k * {STRIDE} AS start_pos, CAST(sum(count) AS BIGINT) AS gtex_count_sum, max(acceptor - donor) AS gtex_junction_length_max FROM fx_junctions, range(0, 20) r(k) WHERE k * {STRIDE} <= floor((donor + acceptor) / 2) AND floor((donor + acceptor) / 2) < k * {STRIDE} + {WINDOW} GROUP BY 1, 2)
SELECT l.chrom, l.start_pos, coalesce(variant_count, 0) AS variant_count, gtex_count_sum, gtex_junction_length_max FROM l LEFT JOIN m ON m.chrom = l.chrom AND m.start_pos = l.start_pos LEFT JOIN c ON c.chrom = l.chrom AND c.start_pos = l.start_pos""",
    ),
}
