"""MinHash near-duplicate removal with sequential Bayesian verification.

A document's set holds its distinct shingles of ``size`` words.  Two documents link when ``100 * intersection >= percent *
union``.

1. Equal sets form classes; only one representative of each goes on, and only if its size allows a link at all.
2. Each has ``HASHES`` minima.  ``BANDS`` bands of ``ROWS`` of them make buckets, whose sets are candidates of each other.
3. Candidates compare their signatures in batches of ``BATCH`` minima, those outside all bands first.  With a uniform
   prior the similarity's posterior after m of k matches is Beta(m + 1, k - m + 1); a pair goes as soon as its probability
   to reach ``percent`` falls below ``MISS`` (:func:`least_matches`).
4. Survivors are joined into clusters, whose full sets are counted exactly: only true links remain.
5. Components of all links, written as the smallest id; copies take that of their class.

Buckets and clusters are dealt in blocks of bounded sets, as in :mod:`jaccard_join`, whose exact check this shares.  What
can be lost: a pair at the threshold itself meets in no band with probability (1 - (percent / 100) ** ROWS) ** BANDS,
4e-7 at 85 per cent, and is pruned with some 1e-6 a batch; both fall steeply above it.  No other cap or sample.

Null or empty texts have no set and stay alone.  Rows that share an id are one document: their sets count as linked.
Rows without an id get a null component, link nothing and are kept.  Other columns don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each_text, written
from .jaccard_join import BLOCK_BYTES, LIST_BLOCK, Forest, edge_table, grouped, heavy_links, largest_partner, linked, links_of_repeated_ids, shingle_sets
from .wordhash import mix

#: Minima of a signature, bands and minima of a band, minima that are compared at once.
HASHES, BANDS, ROWS, BATCH = 128, 20, 4, 16
#: A pair goes when its posterior probability to be a link is less than this.
MISS = 1e-6

_U = np.uint64
_RANDOM = np.random.default_rng(20240613)
_FACTOR = _RANDOM.integers(0, 1 << 63, HASHES, dtype=np.uint64) * _U(2) + _U(1)
_TERM = _RANDOM.integers(0, 1 << 63, HASHES, dtype=np.uint64) * _U(2)


def least_size(percent: int) -> int:
    """The smallest set that can link with one that isn't equal to it."""
    n = 1
    while 100 * n < percent * (n + 1):
        n += 1
    return n


def least_matches(percent: int, miss: float = MISS) -> list[tuple[int, int]]:
    """(k, m) after each batch: of the first k minima at least m must match for the pair to go on."""
    t = percent / 100

    def reaches(m: int, k: int) -> float:
        """P(similarity >= t) of Beta(m + 1, k - m + 1), by the binomial it equals."""
        return sum(comb(k + 1, i) * t**i * (1 - t) ** (k + 1 - i) for i in range(m + 1))

    return [(k, next(m for m in range(k + 1) if reaches(m, k) >= miss)) for k in range(BATCH, HASHES + 1, BATCH)]


def minima(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of ``HASHES`` 32-bit minima for each set; zeros for an empty one."""
    out = np.zeros((len(bounds) - 1, HASHES), np.uint32)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        for k in range(HASHES):
            out[full, k] = np.minimum.reduceat(hashes * _FACTOR[k] + _TERM[k], bounds[full]) >> _U(32)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A row of ``BANDS`` bucket keys for each signature, made of its last BANDS * ROWS minima."""
    part = signature[:, HASHES - BANDS * ROWS :].astype(np.uint64).reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(mix(np.arange(1, BANDS + 1).astype(np.uint64)), part.shape[:2])
    for k in range(ROWS):
        key = mix(key * _U(0x9E3779B97F4A7C15) + part[:, :, k])
    return key


def described(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, digest, bands, signature) of each text; the last two only of sets that can link with others.

    Signatures keep the low half of each minimum: unequal minima then match by chance once in 65,536 times, which only
    lets a pair through to the exact check."""
    least = least_size(percent)

    def work(ids: pa.Array, texts: pa.Array) -> Iterable[pa.RecordBatch]:
        h, bounds = shingle_sets(texts, size)
        n = np.diff(bounds)
        data = memoryview(h).cast("B")
        digest = [hashlib.blake2b(data[8 * x : 8 * y], digest_size=16).digest() for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        whole = minima(h, bounds)
        keys, low = band_keys(whole), (whole & np.uint32(0xFFFF)).astype(np.uint16)
        small = n < least
        bands = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * BANDS, pa.int32()), pa.array(keys.reshape(-1).view(np.int64)), mask=pa.array(small))
        signature = pa.array([None if s else row.tobytes() for s, row in zip(small.tolist(), low, strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(digest, pa.binary()), bands, signature], ["doc_id", "n", "digest", "bands", "signature"])

    return each_text(docs, "doc_id long, n long, digest binary, bands array<long>, signature binary", work, id_col, text_col)


def surviving(n: np.ndarray, signature: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int, plan: list[tuple[int, int]]) -> np.ndarray:
    """Numbers of the pairs (x, y) that pass all batches; sizes bound the similarity from above first."""
    keep = np.flatnonzero(100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
    matches = np.zeros(len(keep), np.int64)
    at = 0
    for k, least in plan:
        matches += (signature[x[keep], at:k] == signature[y[keep], at:k]).sum(1)
        ok = matches >= least
        keep, matches, at = keep[ok], matches[ok], k
    return keep


def _verify(percent: int):
    """Compare the candidates in the blocks of buckets that one task has; edges of what survives."""
    plan = least_matches(percent)

    def verified(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        column = lambda c: table.column(c).to_numpy()
        order = np.lexsort((column("n"), column("mate"), column("own"), column("g")))
        g, own, mate, block, rep, n = (column(c)[order] for c in ("g", "own", "mate", "block", "rep", "n"))
        signature = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint16).reshape(-1, HASHES)[order]
        ids, node = np.unique(rep, return_inverse=True)
        forest = Forest(len(ids))
        new = np.r_[True, (g[1:] != g[:-1]) | (own[1:] != own[:-1]) | (mate[1:] != mate[:-1])]
        start = np.flatnonzero(new)
        stop = np.r_[start[1:], len(g)]
        group, size = np.cumsum(new) - 1, stop - start

        def pairs(x: np.ndarray, y: np.ndarray) -> bool:
            useful = (own[x] == mate[x]) | (block[x] != block[y])
            x, y = x[useful], y[useful]
            k = surviving(n, signature, x, y, percent, plan)
            before = forest.merged
            for p, q in zip(node[x[k]].tolist(), node[y[k]].tolist(), strict=True):
                forest.union(p, q)
            return forest.merged != before

        short = 8
        for d in range(1, short):
            x = np.arange(len(g) - d)
            x = x[(group[x] == group[x + d]) & (size[group[x]] <= short)]
            x = x[[forest.root(p) != forest.root(q) for p, q in zip(node[x].tolist(), node[x + d].tolist(), strict=True)]] if len(x) else x
            pairs(x, x + d)
        for s, e in zip(start[size > short].tolist(), stop[size > short].tolist(), strict=True):
            tree = np.array([forest.root(v) for v in node[s:e].tolist()])
            for i in range(s, e - 1):
                far = e if own[i] != mate[i] else s + int(np.searchsorted(n[s:e], largest_partner(int(n[i]), percent), "right"))
                y = np.arange(i + 1, far)
                y = y[tree[y - s] != tree[i - s]]
                if len(y) and pairs(np.full(len(y), i), y):
                    tree = np.array([forest.root(v) for v in node[s:e].tolist()])
                    if (tree == tree[0]).all():
                        break
        return edge_table(table.column("task")[0].as_py(), *forest.edges(ids))

    return verified


def candidates(reps: DataFrame, percent: int) -> DataFrame | None:
    """(a, b) edges that span the clusters of surviving candidates; None if no bucket has two sets."""
    posting = reps.where(F.col("bands").isNotNull()).select("rep", F.col("n").cast("int").alias("n"), F.explode("bands").alias("g"))
    # a bucket of two sets whose sizes can't link is none
    lists = posting.groupBy("g").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least"), F.max("n").alias("most")).where(F.col("m") > 1)
    lists = written(lists.where((F.col("m") > 2) | (100 * F.col("least") >= percent * F.col("most"))).select("g", "m", F.lit(0).cast("long").alias("bytes")), "minhash-buckets")
    if lists.isEmpty():
        return None
    rows = posting.select("g", "rep", "n", F.lit(0).alias("place"), F.lit(0).cast("long").alias("bytes"))
    return linked(rows, lists, reps.select("rep", "signature").where(F.col("signature").isNotNull()), LIST_BLOCK, BLOCK_BYTES, _verify(percent), "minhash-candidates")


def join(docs: DataFrame, size: int = 3, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; component_id is the smallest doc_id reachable by links, and
    the rows of that id are kept."""
    texts = written(described(docs, size, percent, id_col, text_col), "minhash-signatures")
    known = texts.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    # a class's signature is that of the row its representative comes from, whichever of equal rows
    shown = F.struct("n", "bands", "signature")
    classes = written(known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min_by(shown, "doc_id").alias("shown")), "minhash-classes")
    reps = classes.where(F.col("shown.bands").isNotNull()).select("rep", "shown.*")
    classes = classes.select("digest", "rep")
    links = links_of_repeated_ids(known, classes)
    edges = candidates(reps, percent)
    if edges is not None:
        links = links.unionByName(heavy_links(docs, edges, size, percent, id_col, text_col))
    out = grouped(texts, known, classes, links)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
