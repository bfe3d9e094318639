"""Quality by hierarchical empirical Bayes over documents, paths and hosts.

A logistic classifier on surface features, fitted on a bounded labelled sample, gives each document's evidence.  Sites
are judged from all their documents: a document counts with its label where a training label is known, else with its
evidence.  Host rates have a Beta prior whose mean and strength come from the spread of all hosts (method of moments);
path rates shrink toward their host's posterior, with a strength from the spread of paths within hosts.  So a site
with few documents stays near the global prior, one with many near its own rate.  A document is left out of its own
site's sums.  Its score is its evidence moved by the path's posterior log-odds against the corpus's.

Null hosts and paths are groups of their own; a null or empty text has the features of no words; null ids and repeated
rows are kept.  Without both labels in the sample, evidence is 0.5 everywhere.  Only ids, site names and evidence are
shuffled, never texts; site sums are partial aggregates, so one site may hold any share of the rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import each_slice, fits_broadcast, held_out, written
from .toxicity import _logistic
from .wordhash import SPACED, buffers, words

#: Rows of the site table that are broadcast at most; beyond, a salted join with so many salts.
BROADCAST_ROWS, SALTS = 50_000, 32
#: A document is kept from this score on.
THRESHOLD = 0.5
#: Bounds of the strengths of both priors, in documents.
STRENGTH = (1.0, 10_000.0)


def _class(test) -> np.ndarray:
    return np.array([test(chr(b)) for b in range(128)] + [False] * 128)


_CLASSES = [_class(str.isupper), _class(str.isdigit), _class(lambda c: c in "#$%&*@^~|<>{}[]\\_=+/"), _class(lambda c: c in ".,;:!?'\"()-"), _class(lambda c: c == "\n"), _class(lambda c: c == "!")]


def features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Shares of byte classes, words on a log scale, bytes a word, and how often words and word pairs repeat."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    w = words(raw, offsets, SPACED)
    count = np.diff(w.bounds)
    out = np.zeros((n, len(_CLASSES) + 5))
    full = np.flatnonzero(size)
    for k, of in enumerate(_CLASSES):
        if len(full):
            out[full, k] = np.add.reduceat(of[raw].astype(np.int64), offsets[full]) / size[full]
    out[:, -5] = np.log1p(count) / 8
    out[:, -4] = np.where(count > 0, size / np.maximum(1, count), 0) / 10
    pairs = w.hashes * np.uint64(0x9E3779B97F4A7C15)
    pairs[:-1] ^= w.hashes[1:]
    for i in np.flatnonzero(count).tolist():
        a, b = w.bounds[i], w.bounds[i + 1]
        out[i, -3] = len(np.unique(w.hashes[a:b])) / (b - a)
        out[i, -2] = len(np.unique(pairs[a : b - 1])) / (b - a - 1) if b - a > 1 else 1.0
    out[:, -1] = count == 0
    return np.column_stack([out, out[:, :6] ** 0.5, out[:, -5] ** 2, out[:, -4] ** 2])


def train(rows: list[tuple[int, str, int]]) -> np.ndarray | None:
    """Weights of the document classifier from (id, text, label) rows."""
    y = np.array([float(r[2]) for r in rows])
    if not len(y) or y.min() == y.max():
        return None
    parts = [features(*buffers(pa.array([r[1] or "" for r in rows[k : k + 500]], pa.large_string()))) for k in range(0, len(rows), 500)]
    return _logistic(np.concatenate(parts), y)


def evidence(docs: DataFrame, weights: np.ndarray | None, id_col: str, text_col: str, host_col: str, path_col: str) -> DataFrame:
    """(doc_id, host, path, evidence) of every whole text."""

    def work(rows: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
        if weights is None:
            p = np.full(len(texts), 0.5)
        else:
            x = features(*buffers(texts))
            p = 1 / (1 + np.exp(-np.clip(np.column_stack([np.ones(len(x)), x]) @ weights, -8, 8)))
        return pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array(p)], ["doc_id", "host", "path", "evidence"])

    name = lambda c, alias: F.col(c).cast("string").alias(alias)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), name(host_col, "host"), name(path_col, "path"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return each_slice(rows, "text", work, "doc_id long, host string, path string, evidence double")


def _strength(groups: DataFrame, mean: Column) -> float:
    """Documents that the prior of these groups is worth: from the variance between groups beyond what sampling makes.

    ``groups`` has n and s (sum of outcomes); ``mean`` is the rate that a group shrinks toward."""
    rate = F.col("s") / F.col("n")
    r = groups.where(F.col("n") > 1).agg(
        F.sum(F.col("n") * (rate - mean) ** 2).alias("spread"), F.sum(mean * (1 - mean)).alias("sampling"), F.sum(F.col("n") * mean * (1 - mean)).alias("most"), F.sum(F.lit(1)).alias("k")
    ).first()
    if not r["k"] or not r["most"]:
        return STRENGTH[1]
    share = max(1e-9, (r["spread"] - r["sampling"]) / r["most"])  # between-group variance as a share of p(1-p)
    return float(np.clip(1 / share - 1, *STRENGTH))


def _log_odds(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(p / (1 - p))


def score(
    docs: DataFrame, labels: DataFrame, weights: np.ndarray | None, host_col: str, path_col: str, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD
) -> DataFrame:
    """(doc_id, held_out, evidence, site, score, predicted): site is the path's posterior without the document."""
    known = labels.where(F.col(label_col).isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("doc_id")).agg(F.max(label_col).cast("double").alias("known"))
    seen = evidence(docs, weights, id_col, text_col, host_col, path_col)
    seen = written(seen.join(known.hint("merge"), "doc_id", "left").withColumn("outcome", F.coalesce("known", "evidence")).drop("known"), "quality-evidence")
    paths = written(seen.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("outcome").alias("s")), "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total = hosts.agg(F.sum("n"), F.sum("s")).first()
    mean = (total[1] / total[0]) if total[0] else 0.5
    host_strength = _strength(hosts, F.lit(mean))
    host_rate = (F.col("hs") + mean * host_strength) / (F.col("hn") + host_strength)
    named = hosts.select(F.col("host").alias("h"), F.col("n").alias("hn"), F.col("s").alias("hs"))
    sites = written(paths.join(named.hint("merge"), F.col("host").eqNullSafe(F.col("h"))).drop("h"), "quality-sites")
    path_strength = _strength(sites, host_rate)
    sites = sites.select(F.col("host").alias("h"), F.col("path").alias("p"), "n", "s", "hn", "hs")
    here = [F.col("host").eqNullSafe(F.col("h")), F.col("path").eqNullSafe(F.col("p"))]
    if fits_broadcast(sites, BROADCAST_ROWS):
        joined = seen.join(F.broadcast(sites), here)
    else:
        salted = sites.withColumn("salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = seen.withColumn("salt", F.pmod(F.xxhash64("doc_id", "evidence"), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), [*here, F.col("salt") == F.col("salt2")])
    own = F.col("outcome")
    host_without = (F.col("hs") - own + mean * host_strength) / (F.col("hn") - 1 + host_strength)
    site = (F.col("s") - own + host_without * path_strength) / (F.col("n") - 1 + path_strength)
    p = 1 / (1 + F.exp(-(_log_odds(F.col("evidence")) + _log_odds(F.col("site")) - _log_odds(F.lit(mean)))))
    return (
        joined.withColumn("site", site)
        .withColumn("score", p)
        .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "evidence", "site", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
    )
