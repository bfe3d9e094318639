"""Document fingerprints by SpotSigs, in DataFrame functions only.

Text is lower-cased to words.  Common words are anchors; a signature is the hash of an anchor and the chain of the
``CHAIN`` content words after it, anchors between them skipped.  Where no anchor comes for long, the last one counts
again every ``RUN`` words (the text's start, where there is none before), and an anchor repeated at once counts without
content.  A text of anchors only takes every word and the next one; one without words is its own signature, and the
empty text has none.  Signatures form a multiset.  A fingerprint is that multiset in order, as hex numbers joined by
dots, so equal texts have equal fingerprints; the likeness of two is their Jaccard index (two empty ones: 1).

:func:`near_pairs` compares sets as the method does: classes of equal sets first, then only sets of the same or the next
length partition, and of those only such as share one of their rarest signatures, with sizes that can still reach the
threshold.

Null texts are empty.  Rows are ordered by id, nulls last, ties by the text's hash and then the text; repeated rows follow
each other.  Further columns don't matter, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

CHAIN, RUN = 3, 8
#: Knots of the curve from ids to ranges, rows it is drawn from, bytes of text of a range, and ranges at most (their
#: first rows are broadcast); beyond that ranges grow.
KNOTS, SEEN_ROWS, RANGE_BYTES, RANGES = 4096, 200_000, 4 << 20, 1 << 20

# Common words of English, French, German and Spanish.
ANCHORS = (
    "a an and are as at be by for from in is it not of on or that the this to was were with "
    "au dans de des du elle en est et il la le les ne par pas pour que qui sur un une "
    "als auf das dem den der die ein eine für im ist mit nicht sich und von zu "
    "como con del el es las los más no para por se su una y"
).split()


def _words(text: Column) -> Column:
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def _number(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 32).cast("long"))


def _counted(sigs: Column) -> Column:
    """A multiset as a set: the k-th equal signature (k > 0) becomes the hash of itself and k.

    In the sorted array an element's run of equals is found by steps of falling powers of two to its left, as many as the
    array's length has bits."""
    steps = F.transform(F.sequence(F.floor(F.log2(F.size(sigs))).cast("int"), F.lit(0), F.lit(-1)), lambda k: F.pow(F.lit(2.0), k).cast("int"))

    def rank(x: Column, i: Column) -> Column:
        start = F.aggregate(steps, i, lambda at, step: F.when((at >= step) & (F.get(sigs, at - step) == x), at - step).otherwise(at))
        return F.when((i == 0) | (F.get(sigs, i - 1) != x), x).otherwise(_number(x, i - start))

    return F.when(F.size(F.array_distinct(sigs)) == F.size(sigs), sigs).otherwise(F.array_sort(F.array_distinct(F.transform(sigs, rank))))


def signatures(df: DataFrame, text_col: str, out_col: str) -> DataFrame:
    """``df`` with ``out_col``: the sorted signatures of a text without nulls, repeated ones told apart."""
    common = "|".join(sorted(set(ANCHORS), key=lambda a: (-len(a), a)))
    line, runs, spots, found = (f"__{x}_{out_col}" for x in ("line", "runs", "spots", "found"))
    df = df.withColumn(line, _words(F.col(text_col)))
    # runs: an anchor ('' before the first) and the content words up to the next one
    pieces = F.split(F.col(line), f" (?=(?:{common}) )")
    after = lambda p: F.trim(p.substr(F.instr(p, " ") + 1, F.char_length(p)))
    df = df.withColumn(
        runs,
        F.transform(
            F.transform(pieces, lambda p, i: F.struct(F.when(i == 0, "").otherwise(F.substring_index(p, " ", 1)).alias("anchor"), F.when(i == 0, F.trim(p)).when(F.instr(F.rtrim(p), " ") == 0, "").otherwise(after(p)).alias("content"))),
            lambda r: F.struct(r["anchor"].alias("anchor"), F.when(r["content"] == "", F.array().cast("array<string>")).otherwise(F.split(r["content"], " ")).alias("content")),
        ),
    )
    kept = F.filter(F.col(runs), lambda r, i: (F.size(r["content"]) > 0) | ((r["anchor"] != "") & F.coalesce(F.get(F.col(runs), i + 1)["anchor"] == r["anchor"], F.lit(False))))
    # spots: runs cut after every RUN words
    cut = lambda r: F.transform(F.sequence(F.lit(0), F.greatest(F.size(r["content"]) - 1, F.lit(0)), F.lit(RUN)), lambda k: F.struct(r["anchor"].alias("anchor"), F.slice(r["content"], k + 1, RUN).alias("content")))
    df = df.withColumn(spots, F.flatten(F.transform(kept, cut)))

    def chained(s: Column, i: Column) -> Column:
        later = [F.coalesce(F.get(F.col(spots), i + k)["content"], F.array().cast("array<string>")) for k in range(1, CHAIN)]
        return _number(s["anchor"], F.slice(F.concat(s["content"], *later), 1, CHAIN))

    each = F.split(F.trim(F.col(line)), " ")
    plain = F.transform(F.arrays_zip(each.alias("w"), F.slice(each, 2, 1 << 30).alias("v")), lambda z: _number(F.lit(""), z["w"], F.coalesce(z["v"], F.lit(""))))
    sets = (
        F.when(F.size(spots) > 0, F.transform(F.col(spots), chained))
        .when(F.length(F.trim(F.col(line))) > 0, plain)
        .when(F.col(text_col) != "", F.array(_number(F.col(text_col))))
        .otherwise(F.array().cast("array<bigint>"))
    )
    return df.withColumn(found, F.array_sort(sets)).withColumn(out_col, _counted(F.col(found))).drop(line, runs, spots, found)


def fingerprint(sigs: Column) -> Column:
    return F.array_join(F.transform(sigs, lambda x: F.hex(x)), ".")


def likeness(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every == 0, F.lit(1.0)).otherwise(both / every)


def _ranged(docs: DataFrame) -> tuple[DataFrame, int]:
    """(doc_id, text, hash, range): ranges ascend with (doc_id nulls last, hash of the text) and hold about RANGE_BYTES of
    text each; and how many there are.

    A bounded sample of ids and sizes gives KNOTS ids between which equal bytes lie.  Between two knots ids count as evenly
    spread; an id that many rows share is several knots, and its rows spread over their ranges by hash, as rows without an
    id do over theirs.  So the range is monotone whatever the ids are; only its size may vary."""
    rows = docs.withColumn("hash", F.xxhash64("text"))
    bytes_of = F.octet_length("text") + 64
    seen = docs.groupBy(F.col("doc_id").isNull().alias("none")).agg(F.count(F.lit(1)).alias("n"), F.sum(bytes_of).alias("bytes")).collect()
    n, known = next(((r["n"], r["bytes"]) for r in seen if not r["none"]), (0, 0))
    unknown = next((r["bytes"] for r in seen if r["none"]), 0)
    width = max(RANGE_BYTES, math.ceil((known + unknown) / RANGES))
    spread = (F.col("hash").cast("double") + 2.0**63) / 2.0**64
    place = F.lit(0.0)
    if known:
        drawn = docs.where("doc_id is not null").select("doc_id", bytes_of.alias("bytes"))
        drawn = (drawn.sample(SEEN_ROWS / n, seed=1) if n > SEEN_ROWS else drawn).limit(2 * SEEN_ROWS).toArrow()
        ids, sizes = drawn.column("doc_id").to_numpy(), drawn.column("bytes").to_numpy()
        order = np.argsort(ids, kind="stable")
        share = np.cumsum(sizes[order]) / max(1, sizes.sum())
        knots = ids[order][np.minimum(np.searchsorted(share, np.arange(KNOTS + 1) / KNOTS), len(ids) - 1)].tolist() if len(ids) else [0] * (KNOTS + 1)
        table = F.array(*map(F.lit, knots))
        steps = F.array(*(F.lit(1 << k) for k in range(KNOTS.bit_length(), -1, -1)))

        def below(test) -> Column:
            """How many knots pass the test, which holds up to some place and not beyond."""
            return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= KNOTS + 1) & test(F.get(table, at + step - 1)), at + step).otherwise(at))

        lower, upper = below(lambda k: k < F.col("doc_id")), below(lambda k: k <= F.col("doc_id"))
        rows = rows.withColumn("lower", lower).withColumn("upper", upper)
        gap = F.get(table, F.col("lower")).cast("double") - F.get(table, F.col("lower") - 1).cast("double")
        between = F.col("lower") - 1 + (F.col("doc_id").cast("double") - F.get(table, F.col("lower") - 1).cast("double")) / gap
        knot = (
            F.when(F.col("upper") > F.col("lower"), F.col("lower") + (F.col("upper") - F.col("lower") - 1) * spread)
            .when(F.col("lower") == 0, F.lit(0.0))
            .when(F.col("lower") > KNOTS, F.lit(float(KNOTS)))
            .otherwise(between)
        )
        place = knot / KNOTS * float(known)
    at = F.when(F.col("doc_id").isNull(), F.lit(float(known)) + spread * float(unknown)).otherwise(place)
    return rows.withColumn("range", F.floor(at / width).cast("int")).select("doc_id", "text", "hash", "range"), int((known + unknown) // width) + 1


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, sigs, next_text, next_sigs): each row with the row of the next id, the last with the first's.

    Texts are shuffled once, by range of ids.  Each range also gets a copy of the first rows of the range after it."""
    ranged, ranges = _ranged(docs)
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")
    first = ranged.groupBy("range").agg(F.min(key).alias("first"))
    order = W.orderBy("range")  # one row a range, RANGES at most
    after = first.select(F.lag("range").over(order).alias("before"), F.max("range").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("last"), "first")
    after = after.select(F.coalesce("before", "last").alias("to_range"), F.col("first.doc_id").alias("first_id"), F.col("first.hash").alias("first_hash"))
    border = ranged.join(F.broadcast(after), F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("hash") == F.col("first_hash"))).select("doc_id", "text", "hash", F.col("to_range").alias("range"), F.lit(True).alias("border"))
    rows = ranged.select("doc_id", "text", "hash", "range", F.lit(False).alias("border")).unionByName(border)
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(ranges, 4 * ranges // 5))
    rows = signatures(rows.repartition(tasks, "range"), "text", "sigs")
    here = W.partitionBy("range").orderBy("border", F.col("doc_id").asc_nulls_last(), "hash", "text")
    return rows.withColumn("next_text", F.lead("text").over(here)).withColumn("next_sigs", F.lead("sigs").over(here)).where(~F.col("border")).drop("border", "range", "hash")


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last quarter is the start of the next document."""
    rows = with_next(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.col("text").substr(F.lit(1), n - cut), F.col("next_text").substr(F.lit(1), cut))).withColumn("n_chars", n.cast("long")).drop("text", "next_text")
    rows = signatures(rows, "edited", "edited_sigs")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def near_pairs(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs (a, b, likeness) of class representatives whose likeness reaches ``percent``, and the
    (doc_id, representative) of every row with a fingerprint; the classes are those of equal signature sets.

    Null texts are empty and, as texts of no words, in no pair.  Rows without an id are left out; rows that share an id
    are in the class of their own text each."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sets = written(signatures(rows, "text", "sigs").drop("text").where("doc_id is not null").withColumn("key", F.sha2(fingerprint(F.col("sigs")), 256)), "spot-sets")
    classes = written(sets.groupBy("key").agg(F.min("doc_id").alias("representative"), F.min("sigs").alias("sigs")), "spot-classes")
    members = sets.select("doc_id", "key").join(classes.select("key", "representative").hint("merge"), "key").select("doc_id", "representative")
    # Sets of partition k can only match sets of k - 1, k and k + 1: lengths in a partition differ by the threshold at most.
    n = F.size("sigs")
    reps = classes.where(n > 0).select("key", "representative", n.alias("n"), F.floor(F.log(n.cast("double")) / math.log(100 / percent)).cast("int").alias("part"), "sigs")
    each = reps.select("key", "n", "part", F.explode("sigs").alias("sig"))
    counts = each.groupBy("sig").agg(F.count(F.lit(1)).alias("df"))
    rank = F.row_number().over(W.partitionBy("key").orderBy("df", "sig"))
    rare = each.join(counts.where("df > 1").hint("merge"), "sig", "left").withColumn("df", F.coalesce("df", F.lit(1))).withColumn("place", rank)
    rare = written(rare.where((F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1) & (F.col("df") > 1)).select("key", "n", "part", "sig", "place"), "spot-rare")
    left = rare.select(F.col("key").alias("x"), F.col("n").alias("nx"), F.col("place").alias("px"), F.explode(F.sequence(F.col("part") - 1, F.col("part") + 1)).alias("part"), "sig")
    right = rare.select(F.col("key").alias("y"), F.col("n").alias("ny"), F.col("place").alias("py"), "part", "sig")
    need = F.ceil(percent * (F.col("nx") + F.col("ny")) / (100 + percent))
    pairs = left.join(right.hint("merge"), ["sig", "part"]).where((F.col("x") < F.col("y")) & (F.least("nx", "ny") * 100 >= F.greatest("nx", "ny") * percent) & (F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py")) + 1 >= need))
    pairs = written(pairs.select("x", "y").distinct(), "spot-pairs")
    side = lambda k, i, v: reps.select(F.col("key").alias(k), F.col("representative").alias(i), F.col("sigs").alias(v)).hint("merge")
    full = pairs.join(side("x", "i", "v"), "x").join(side("y", "j", "w"), "y")
    return full.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), likeness(F.col("v"), F.col("w")).alias("likeness")).where(F.col("likeness") * 100 >= percent), members


ORACLE_EDITS = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, row_number() OVER (ORDER BY doc_id, text) AS k, count(*) OVER () AS c FROM documents),
x AS (SELECT t.*, u.text AS next FROM t JOIN t u ON u.k = t.k % t.c + 1)
SELECT doc_id, n AS n_chars, sha256(substr(text, 1, n - n // 4) || substr(next, 1, n // 4)) AS edited_sha256 FROM x"""
