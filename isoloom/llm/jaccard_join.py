"""N-gram Jaccard join by sizes: light sets meet in enumerated subsets, heavy ones in inverted lists.

A document's set holds its distinct shingles of ``size`` words.  Two documents link when ``100 * intersection >=
percent * union``; sizes a and b need an overlap of o(a, b) = ceil(percent * (a + b) / (100 + percent)).

1. Equal sets form classes; only one representative of each goes on.
2. Light sets, up to a boundary size, list all their subsets of o(a, b) shingles for each partner size.  Sharing one
   is a link, so no pair is formed or checked: each member of a subset's group links to the group's smallest member.
3. Heavy sets enter the inverted lists of their first n - ceil(percent * n / 100) + 1 shingles, rare ones first; so do
   the light ones, for pairs of both kinds.  Sizes, places and the parity of hashed shingles (popcount of the xor never
   exceeds the symmetric difference) rule most pairs out; what is left is joined into clusters inside the task, so a
   list of m sets yields m - 1 edges at most.
4. The sets of a cluster come together and are counted exactly; a spanning forest of the true links is what remains.
5. Components of all links, written as the smallest id; copies take that of their class.

Lists and clusters are dealt into blocks of bounded sets and bytes.  All blocks of a group of few meet at once.  In larger
groups first each block is worked through by itself; then
one representative of each component so far is held against all others; then what is still apart from its group's
largest component is held against every block (:func:`linked`).  A pair already in one component needs no check, so a
group of m near copies costs about m, and only sets that stay apart cost more.

The boundary is the size at which listing subsets saves most rows against scanning lists, both counted over all
documents.  Shingles above a share of all (at most ``COMMON`` can be) go last in the order; any
order is correct.  Copies of texts, hot shingles and hub documents only pass partial aggregates, blocks and joins
that Spark can split.

Null or empty texts have no set and stay alone.  Rows that share an id are one document: their sets count as linked.
Rows without an id get a null component and link nothing.  Other columns don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_batches, each_slice, each_text, fits_broadcast, give_back, slices, written
from .components import below, components
from .wordhash import SPACED, buffers, mix, shingles, words

#: Sets of a block of an inverted list, and of a cluster; bytes of sets of a block of a cluster.
LIST_BLOCK, CLUSTER_BLOCK, BLOCK_BYTES = 1024, 2048, 8 << 20
#: Blocks of a group of which every two meet at once; groups of more go through rounds.
FEW_BLOCKS = 4
#: Shingles that can be known as common: those above one part in COMMON of all occurrences.
COMMON = 1 << 20
#: Shingles counted at once in a task, and how often one must occur there to be reported.
COUNTED, REPORTED = 1 << 21, 4
#: Largest size a light set can have, and rows that may be broadcast.
LIGHT_MOST, BROADCAST_ROWS = 40, 1_000_000
#: Rows of a task that scans lists; bytes of sets of a task that checks clusters.
SCAN_ROWS, CHECK_BYTES = 60_000, 16 << 20
#: Entries of inverted lists that are counted at once.
ENTRIES = 1 << 22

_U = np.uint64


def overlap(a: int, b: int, percent: int) -> int:
    """The least intersection with which sets of sizes a and b link."""
    return -(-percent * (a + b) // (100 + percent))


def largest_partner(n: int, percent: int) -> int:
    return n * 100 // percent


def prefix_size(n, percent: int):
    return n - -(-percent * n // 100) + 1


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    raw, offsets = buffers(texts)
    return shingles(words(raw, offsets, SPACED), size)


def _described(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, digest) of each text and, apart from them, (token, seen): how often a task met frequent shingles."""
    names = ["doc_id", "n", "digest", "token", "seen"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]

    def counted(pile: list[np.ndarray]) -> pa.RecordBatch:
        token, n = np.unique(np.concatenate(pile), return_counts=True)
        token, n = token[n >= REPORTED], n[n >= REPORTED]
        empty = [pa.nulls(len(token), k) for k in kinds[:3]]
        return pa.RecordBatch.from_arrays([*empty, pa.array(token.view(np.int64)), pa.array(n.astype(np.int64))], names)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pile: list[np.ndarray] = []
        held = 0
        for b in it:
            for at, to in slices(b.column(1)):
                h, bounds = shingle_sets(b.column(1).slice(at, to - at), size)
                data = memoryview(h).cast("B")
                digest = [hashlib.blake2b(data[8 * x : 8 * y], digest_size=16).digest() for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                arrays = [b.column(0).slice(at, to - at), pa.array(np.diff(bounds)), pa.array(digest, pa.binary()), *(pa.nulls(to - at, k) for k in kinds[3:])]
                yield pa.RecordBatch.from_arrays(arrays, names)
                pile.append(h)
                held += len(h)
                if held >= COUNTED:
                    yield counted(pile)
                    pile, held = [], 0
        if held:
            yield counted(pile)
        b = h = data = pile = None
        give_back()

    rows = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(batches, "doc_id long, n long, digest binary, token long, seen long")


def _common(described: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted common shingles and their counts: at most COMMON of them, since each has a COMMON-th of all or more."""
    total = described.agg(F.sum("n")).first()[0] or 0
    least = max(REPORTED, -(-total // COMMON))
    rows = described.where(F.col("token").isNotNull()).groupBy("token").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= least)
    pairs = rows.toArrow()
    token = pairs.column("token").to_numpy().view(np.uint64) if pairs.num_rows else np.zeros(0, np.uint64)
    seen = pairs.column("seen").to_numpy() if pairs.num_rows else np.zeros(0, np.int64)
    order = np.argsort(token)
    return token[order], seen[order]


def bitmap(h: np.ndarray) -> bytes:
    """Parities of hashed shingles: as many bits as the next power of two, 512 to 8192."""
    bits = min(8192, max(512, 1 << (len(h) - 1).bit_length()))
    odd = (np.bincount((mix(h) % _U(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").tobytes()


def _fold(b: bytes, size: int) -> bytes:
    while len(b) > size:
        half = len(b) // 2
        b = (np.frombuffer(b[:half], np.uint8) ^ np.frombuffer(b[half:], np.uint8)).tobytes()
    return b


def _posted(docs: DataFrame, size: int, percent: int, common: tuple[np.ndarray, np.ndarray], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, prefix, small, bitmap): what each document posts; ``small`` is the whole set of possible light ones."""
    known, seen = common

    def work(ids: pa.Array, texts: pa.Array) -> Iterable[pa.RecordBatch]:
        h, bounds = shingle_sets(texts, size)
        if len(known):
            k = np.minimum(np.searchsorted(known, h), len(known) - 1)
            rank = np.where(known[k] == h, seen[k], 0)
        else:
            rank = np.zeros(len(h), np.int64)
        prefix, small, maps = [], [], []
        for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            own, r = h[x:y], rank[x:y]
            take = prefix_size(y - x, percent) if y > x else 0
            first = own[np.argsort(r, kind="stable")[:take]] if r.any() else own[:take]
            prefix.append(first.view(np.int64))
            small.append(own.view(np.int64) if 0 < y - x <= LIGHT_MOST else None)
            maps.append(bitmap(own) if y > x else None)
        lists = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(bounds)), pa.array(prefix, lists), pa.array(small, lists), pa.array(maps, pa.binary())], ["doc_id", "n", "prefix", "small", "bitmap"])

    return each_text(docs, "doc_id long, n long, prefix array<long>, small array<long>, bitmap binary", work, id_col, text_col)


def subset_rows(n: int, percent: int) -> int:
    """How many subsets a light set of size n lists."""
    return sum(comb(n, overlap(*sorted((n, m)), percent)) for m in range(-(-percent * n // 100), largest_partner(n, percent) + 1))


def boundary(posting: DataFrame, lists: DataFrame, percent: int) -> int:
    """The largest light size: the size at which listing subsets instead of scanning lists has saved most rows so far.

    Listing makes a row for each subset; scanning costs a set its postings and the other entries of their lists."""
    small = posting.where(F.col("n") <= LIGHT_MOST)
    met = small.join(lists.hint("merge"), "token", "left").groupBy("n").agg(F.count_distinct("rep").alias("sets"), F.sum(F.coalesce("m", F.lit(1))).alias("scanned"))
    best, saved, most = 0, 0, 0
    for n, sets, scanned in sorted((r["n"], r["sets"], r["scanned"]) for r in met.collect()):  # LIGHT_MOST rows at most
        saved += scanned - sets * subset_rows(n, percent)
        if saved >= most:
            best, most = n, saved
    return best


def _light_links(posted: DataFrame, most: int, percent: int) -> DataFrame:
    """(a, b) links between light sets: members of a subset's group with the smallest member of the partner size."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out: list[tuple] = []
            for doc, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n = len(own)
                for m in range(-(-percent * n // 100), min(most, largest_partner(n, percent)) + 1):
                    lo, hi = sorted((n, m))
                    for chosen in combinations(own, overlap(lo, hi, percent)):
                        d = hashlib.blake2b(np.array(chosen, np.int64).tobytes(), digest_size=16).digest()
                        out.append((doc, n, lo, hi, d))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 4 + [pa.binary()], strict=True)], ["rep", "n", "lo", "hi", "subset"])

    light = posted.where((F.col("n") <= most) & (F.col("n") > 0)).select(F.col("doc_id"), F.col("small"))
    rows = written(light.mapInArrow(batches, "rep long, n long, lo long, hi long, subset binary"), "join-subsets")
    key = ["lo", "hi", "subset"]
    groups = rows.groupBy(*key).agg(F.min(F.when(F.col("n") == F.col("lo"), F.col("rep"))).alias("least_lo"), F.min(F.when(F.col("n") == F.col("hi"), F.col("rep"))).alias("least_hi"), F.count(F.lit(1)).alias("members"))
    groups = groups.where((F.col("members") > 1) & F.col("least_lo").isNotNull() & F.col("least_hi").isNotNull())
    met = rows.join(groups.hint("merge"), key)
    return met.select(F.col("rep").alias("a"), F.when(F.col("n") == F.col("lo"), F.col("least_hi")).otherwise(F.col("least_lo")).alias("b")).where(F.col("a") != F.col("b")).distinct()


class Forest:
    """Union-find over the row numbers of a task."""

    def __init__(self, n: int):
        self.parent = list(range(n))
        self.merged = 0

    def root(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def union(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
            self.merged += 1

    def edges(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        root = np.array([self.root(x) for x in range(len(self.parent))], np.int64)
        moved = np.flatnonzero(root != np.arange(len(root)))
        return ids[moved], ids[root[moved]]


def edge_table(task: int, a: np.ndarray, b: np.ndarray) -> pa.Table:
    return pa.table({"task": pa.array(np.full(len(a), task), pa.int32()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _maybe(n: np.ndarray, at: np.ndarray, bits: np.ndarray, maps: list[bytes], x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Which row pairs (x, y) can still link, by size, by place in their prefixes and by parities."""
    nx, ny = n[x], n[y]
    keep = np.flatnonzero(100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny))
    x, y, nx, ny = x[keep], y[keep], nx[keep], ny[keep]
    need = -(-percent * (nx + ny) // (100 + percent))
    ok = np.minimum(nx - at[x], ny - at[y]) >= need  # the shingle itself and all after it
    x, y, nx, ny, need, keep = x[ok], y[ok], nx[ok], ny[ok], need[ok], keep[ok]
    room = nx + ny - 2 * need
    ok = np.bitwise_count(bits[x] ^ bits[y]).sum(1) <= room
    x, y, room, keep = x[ok], y[ok], room[ok], keep[ok]
    for k in np.flatnonzero(np.minimum(n[x], n[y]) > 400).tolist():
        p, q = maps[x[k]], maps[y[k]]
        size = min(len(p), len(q))
        if size > 64 and np.bitwise_count(np.frombuffer(_fold(p, size), np.uint64) ^ np.frombuffer(_fold(q, size), np.uint64)).sum() > room[k]:
            keep[k] = -1
    return keep[keep >= 0]


def _scan(percent: int, most_light: int):
    """Scan the blocks of inverted lists that one task has; edges of what can still link."""

    def scanned(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        column = lambda c: table.column(c).to_numpy()
        order = np.lexsort((column("n"), column("block"), column("mate"), column("own"), column("g")))
        token, own, mate, block, rep, n, at = (column(c)[order] for c in ("g", "own", "mate", "block", "rep", "n", "place"))
        maps = table.column("bitmap").to_pylist()
        maps = [maps[k] for k in order.tolist()]
        bits = np.frombuffer(b"".join(m if len(m) == 64 else _fold(m, 64) for m in maps), np.uint64).reshape(-1, 8)
        ids, node = np.unique(rep, return_inverse=True)
        forest = Forest(len(ids))
        new = np.r_[True, (token[1:] != token[:-1]) | (own[1:] != own[:-1]) | (mate[1:] != mate[:-1])]
        start = np.flatnonzero(new)
        stop = np.r_[start[1:], len(token)]
        group = np.cumsum(new) - 1

        def pairs(x: np.ndarray, y: np.ndarray) -> None:
            useful = (n[x] > most_light) | (n[y] > most_light)
            useful &= (own[x] == mate[x]) | (block[x] != block[y])
            x, y = x[useful], y[useful]
            if len(x):
                k = _maybe(n, at, bits, maps, x, y, percent)
                for p, q in zip(node[x[k]].tolist(), node[y[k]].tolist(), strict=True):
                    forest.union(p, q)

        def roots(members: np.ndarray) -> np.ndarray:
            return np.array([forest.root(v) for v in node[members].tolist()])

        size = stop - start
        short = 8
        for d in range(1, short):
            x = np.arange(len(token) - d)
            x = x[(group[x] == group[x + d]) & (size[group[x]] <= short)]
            pairs(x, x + d)
        for g in np.flatnonzero(size > short).tolist():
            members = np.arange(start[g], stop[g])
            tree = roots(members)
            for i, x in enumerate(members.tolist()):
                far = np.searchsorted(n[members], largest_partner(int(n[x]), percent), "right") if own[x] == mate[x] else len(members)
                y = np.arange(i + 1, far)
                y = members[y[tree[y] != tree[i]]]
                before = forest.merged
                if len(y):
                    pairs(np.full(len(y), x), y)
                if forest.merged != before:
                    tree = roots(members)
                    if (tree == tree[0]).all():
                        break
        return edge_table(table.column("task")[0].as_py(), *forest.edges(ids))

    return scanned


def _check(percent: int):
    """Count the overlaps of the sets of the cluster blocks that one task has; a spanning forest of true links."""

    def checked(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        column = lambda c: table.column(c).to_numpy()
        order = np.lexsort((column("rep"), column("mate"), column("own"), column("g")))
        cluster, own, mate, block, rep, n = (column(c)[order] for c in ("g", "own", "mate", "block", "rep", "n"))
        raw = table.column("shingles").to_pylist()
        new = np.r_[True, (cluster[1:] != cluster[:-1]) | (own[1:] != own[:-1]) | (mate[1:] != mate[:-1])]
        start = np.flatnonzero(new)
        out_a, out_b = [], []
        for s, e in zip(start.tolist(), [*start[1:].tolist(), len(rep)], strict=True):
            sets = [np.frombuffer(raw[order[k]], np.uint64) for k in range(s, e)]
            a, b = _forest_of(sets, rep[s:e], n[s:e], block[s:e], bool(own[s] == mate[s]), percent)
            out_a.append(a)
            out_b.append(b)
        return edge_table(table.column("task")[0].as_py(), np.concatenate(out_a), np.concatenate(out_b))

    return checked


def _forest_of(sets: list[np.ndarray], rep: np.ndarray, n: np.ndarray, block: np.ndarray, same: bool, percent: int) -> tuple[np.ndarray, np.ndarray]:
    m = len(sets)
    forest = Forest(m)
    size = np.array([len(x) for x in sets])
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(m), size)
    by_token = np.argsort(token, kind="stable")
    lists = owner[by_token]
    at = np.zeros(int(token.max()) + 2, np.int64)
    np.cumsum(np.bincount(token), out=at[1:])
    bounds = np.r_[0, np.cumsum(size)]
    for i in range(m):
        if forest.merged == m - 1:
            break
        t = token[bounds[i] : bounds[i + 1]]
        both = _met(lists, at[t], at[t + 1], m)
        link = 100 * both >= percent * (n[i] + n - both)
        link[: i + 1] = False
        if not same:
            link &= block != block[i]
        for j in np.flatnonzero(link).tolist():
            forest.union(i, j)
    order = np.argsort(rep, kind="stable")
    root: dict[int, int] = {}
    a, b = [], []
    for k in order.tolist():  # the smallest id of each tree comes first
        r = forest.root(k)
        if r in root:
            a.append(rep[k])
            b.append(root[r])
        else:
            root[r] = rep[k]
    return np.array(a, np.int64), np.array(b, np.int64)


def _met(lists: np.ndarray, start: np.ndarray, stop: np.ndarray, m: int) -> np.ndarray:
    """How often each of m sets is in the lists given as ranges, some ENTRIES of them at a time."""
    count = stop - start
    total = np.cumsum(count)
    both = np.zeros(m, np.int64)
    k = 0
    while k < len(count):
        to = max(k + 1, int(np.searchsorted(total, (total[k - 1] if k else 0) + ENTRIES, "right")))
        c = count[k:to]
        where = np.repeat(start[k:to] - (np.cumsum(c) - c), c) + np.arange(c.sum())
        both += np.bincount(lists[where], minlength=m)
        k = to
    return both


_UNIT = ["g", "own", "mate", "block", "rep", "n", "place"]


def linked(rows: DataFrame, sizes: DataFrame, payload: DataFrame, block: int, block_bytes: int, solve, name: str) -> DataFrame:
    """(a, b) edges of groups, which ``solve`` finds among the rows of a task's units: a row and the least of its tree.

    ``rows`` has (g, rep, n, place, bytes), ``sizes`` is a written table of each group's rows m and bytes, ``payload`` has
    what ``solve`` needs of a rep.  In a unit (g, own, mate) rows of the same block meet if own = mate, else rows of
    different ones.  In groups of at most FEW_BLOCKS blocks, a row comes into as many units and all pairs meet in the first
    round.  Larger groups go through three:

    1. each block by itself;
    2. one row of each tree so far, all with all;
    3. rows outside their group's largest tree, dealt anew, with every block.  Then all pairs have met but those inside
       one tree."""
    least_tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = lambda m, size: F.greatest(F.ceil(m / block), F.ceil(size / block_bytes), F.lit(1)).cast("int")
    dealt = lambda n, seed=0: F.pmod(F.xxhash64("rep", F.lit(seed)), n).cast("int")

    def task(n_rows: int, n_bytes: int) -> tuple[int, Column]:
        tasks = max(least_tasks, -(-n_rows // SCAN_ROWS), -(-n_bytes // CHECK_BYTES))
        return tasks, F.pmod(F.xxhash64("g", "own", "mate"), F.lit(tasks)).cast("int")

    def work(table: pa.Table) -> pa.Table:
        try:
            return solve(table)
        finally:
            give_back()

    def solved(units: DataFrame, tasks: int) -> DataFrame:
        full = units.select(*_UNIT, "task").join(payload.hint("merge"), "rep").repartition(tasks, "task")
        return written(full.groupBy("task").applyInArrow(work, "task int, a long, b long").where("a <> b"), name)

    def told(units: DataFrame, edges: DataFrame) -> DataFrame:
        """``units`` with the least of each row's tree in its task; several rows of one rep have one."""
        least = edges.groupBy("task", F.col("a").alias("rep")).agg(F.min("b").alias("root"))
        return units.join(least.hint("merge"), ["task", "rep"], "left").withColumn("label", F.coalesce("root", "rep")).drop("root", "task")

    sizes = sizes.withColumn("blocks", blocks(F.col("m"), F.col("bytes")))
    few = F.col("blocks") <= FEW_BLOCKS
    times = F.when(few, F.col("blocks")).otherwise(1)
    total = sizes.agg(F.sum(times * F.col("m")), F.sum(times * F.col("bytes")), F.max("blocks")).first()
    placed = rows.join(sizes.select("g", "blocks").hint("merge"), "g").withColumn("block", dealt(F.col("blocks")))
    tasks, which = task(total[0] or 0, total[1] or 0)
    placed = placed.withColumn("other", F.explode(F.when(few, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))))
    placed = placed.withColumn("own", F.least("block", "other")).withColumn("mate", F.greatest("block", "other")).drop("other").withColumn("task", which)
    edges = solved(placed, tasks)
    if (total[2] or 0) <= FEW_BLOCKS:
        return edges.select("a", "b")
    now = written(told(placed.where(~few), edges), name)

    # one row of each tree, with all others of its group
    first = now.groupBy("g", "label").agg(F.min(F.struct("rep", "n", "place", "bytes")).alias("x")).select("g", "label", "x.*")
    group = W.partitionBy("g")
    first = first.withColumn("m", F.count(F.lit(1)).over(group)).withColumn("blocks", blocks(F.col("m"), F.sum("bytes").over(group))).where("m > 1")
    first = written(first.withColumn("block", dealt(F.col("blocks"))), name)
    total = first.agg(F.sum("blocks"), F.sum(F.col("blocks") * F.col("bytes")), F.max("blocks")).first()
    if total[0] is None:
        return edges.select("a", "b")
    tasks, which = task(total[0], total[1])
    units = first.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("own", F.least("block", "other")).withColumn("mate", F.greatest("block", "other")).withColumn("task", which)
    more = solved(units, tasks)
    if total[2] == 1:
        merged = told(first.withColumnRenamed("label", "before").withColumn("own", F.col("block")).withColumn("mate", F.col("block")).withColumn("task", which), more)
    else:
        label = written(components(edges.select("a", "b").unionByName(more.select("a", "b"))), name).select(F.col("node").alias("rep"), "component")
        merged = first.withColumnRenamed("label", "before").join(label.hint("merge"), "rep", "left").withColumn("label", F.coalesce("component", "rep"))
    merged = merged.select("g", F.col("before"), F.col("label").alias("tree"))
    now = written(now.join(merged.hint("merge"), (now["g"] == merged["g"]) & (now["label"] == merged["before"])).select(now["g"], "rep", "n", "place", "bytes", "blocks", "block", "tree"), name)
    edges = edges.unionByName(more).select("a", "b")

    # what is outside the largest tree, with all
    parts = now.groupBy("g", "tree").agg(F.count(F.lit(1)).alias("m"), F.sum("bytes").alias("all"))
    apart = parts.groupBy("g").agg(F.max(F.struct("m", "tree", "all")).alias("main"), F.sum("m").alias("m"), F.sum("all").alias("all"))
    apart = apart.where(F.col("m") > F.col("main.m")).select("g", F.col("main.tree").alias("main"), blocks(F.col("m") - F.col("main.m"), F.col("all") - F.col("main.all")).alias("rest_blocks"))
    now = now.join(apart.hint("merge"), "g")
    left = now.withColumn("own", F.col("block")).withColumn("mate", F.explode(F.sequence(F.lit(-1), -F.col("rest_blocks"), F.lit(-1))))
    right = now.where(F.col("tree") != F.col("main")).withColumn("mate", -1 - dealt(F.col("rest_blocks"), 1)).withColumn("block", F.col("mate")).withColumn("own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = written(left.select(*_UNIT, "bytes").unionByName(right.select(*_UNIT, "bytes")), name)
    total = units.agg(F.count(F.lit(1)), F.sum("bytes")).first()
    if not total[0]:
        return edges
    tasks, which = task(total[0], total[1])
    return edges.unionByName(solved(units.withColumn("task", which), tasks).select("a", "b"))


def _candidates(posted: DataFrame, percent: int) -> tuple[DataFrame | None, int]:
    """(cluster edges, light boundary)."""
    posting = posted.where(F.col("n") > 0).select(F.col("doc_id").alias("rep"), F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("place", "token"))
    lists = posting.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least"), F.max("n").alias("most")).where(F.col("m") > 1)
    # a list of two sets whose sizes can't link is no list
    lists = written(lists.where((F.col("m") > 2) | (100 * F.col("least") >= percent * F.col("most"))).select("token", "m"), "join-lists")
    light = boundary(posting, lists, percent)
    if lists.isEmpty():
        return None, light
    rows = posting.select(F.col("token").alias("g"), "rep", "n", "place", F.lit(0).cast("long").alias("bytes"))
    sizes = lists.select(F.col("token").alias("g"), "m", F.lit(0).cast("long").alias("bytes"))
    payload = posted.select(F.col("doc_id").alias("rep"), "bitmap")
    return linked(rows, sizes, payload, LIST_BLOCK, BLOCK_BYTES, _scan(percent, light), "join-candidates"), light


def heavy_links(docs: DataFrame, edges: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(a, b) true links that span the true components inside each cluster of candidates."""
    clusters = written(components(edges), "join-clusters").select(F.col("node").alias("rep"), F.col("component").alias("g"))
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text"))
    texts = texts.join(F.broadcast(clusters) if fits_broadcast(clusters, BROADCAST_ROWS) else clusters.hint("merge"), "rep").select("rep", "g", "text")

    def work(batch: pa.RecordBatch, own: pa.Array) -> pa.RecordBatch:
        h, bounds = shingle_sets(own, size)
        raw = pa.array([h[x:y].tobytes() for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(bounds)), raw], ["rep", "g", "n", "shingles"])

    sets = written(each_slice(texts, "text", work, "rep long, g long, n long, shingles binary"), "join-sets")
    rows = sets.select("g", "rep", F.col("n").cast("int").alias("n"), F.lit(0).alias("place"), (8 * F.col("n")).alias("bytes"))
    sizes = written(rows.groupBy("g").agg(F.count(F.lit(1)).alias("m"), F.sum("bytes").alias("bytes")), "join-sizes")
    return linked(rows, sizes, sets.select("rep", "shingles"), CLUSTER_BLOCK, BLOCK_BYTES, _check(percent), "join-links")


def join(docs: DataFrame, size: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; component_id is the smallest doc_id reachable by links."""
    described = written(_described(docs, size, id_col, text_col), "join-sets-seen")
    common = _common(described)
    texts = described.where(F.col("digest").isNotNull())
    known = texts.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = written(known.groupBy("digest").agg(F.min("doc_id").alias("rep")), "join-classes")
    posted = _posted(docs, size, percent, common, id_col, text_col)
    reps = classes.select(F.col("rep").alias("doc_id")).distinct()
    posted = written(posted.where(F.col("doc_id").isNotNull()).join(reps.hint("merge"), "doc_id", "left_semi"), "join-posted")
    edges, light = _candidates(posted, percent)
    links = links_of_repeated_ids(known, classes)
    if light:
        links = links.unionByName(_light_links(posted, light, percent))
    if edges is not None:
        links = links.unionByName(heavy_links(docs, edges, size, percent, id_col, text_col))
    return grouped(texts, known, classes, links)


def links_of_repeated_ids(known: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): documents of several texts with the representatives of their classes."""
    code = F.xxhash64("digest")
    several = known.groupBy("doc_id").agg(F.min(code).alias("x"), F.max(code).alias("y")).where("x <> y").select("doc_id")
    return known.join(several.hint("merge"), "doc_id", "left_semi").join(classes.hint("merge"), "digest").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))


def grouped(texts: DataFrame, known: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of all ``texts``: ``known`` ones take their class's component by ``links``."""
    found = below(links).withColumnRenamed("node", "rep")
    classes = written(classes.join(found.hint("merge"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component")), "join-classes")
    out = known.join(classes.hint("merge"), "digest").select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    # texts without a set: alone, unless another text of the document has one
    rest = texts.where((F.col("n") == 0) | F.col("doc_id").isNull()).select("doc_id", F.col("n").alias("n_shingles"))
    ids = rest.where(F.col("doc_id").isNotNull()).select("doc_id").distinct()
    other = known.join(F.broadcast(ids) if fits_broadcast(ids, BROADCAST_ROWS) else ids.hint("merge"), "doc_id", "left_semi").join(classes.hint("merge"), "digest").groupBy("doc_id").agg(F.min("component").alias("component"))
    rest = rest.join(other.hint("merge"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.unionByName(rest)



def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their group, all columns unchanged; rows without an id stay.

    Of rows that share the id that stays all remain, since an id names one document.  The texts aren't shuffled where
    the ids that go fit a broadcast."""
    grouped = join(docs, size, percent, id_col, text_col)
    gone = written(grouped.where(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias("__gone")).distinct(), "join-gone")
    gone = F.broadcast(gone) if fits_broadcast(gone, BROADCAST_ROWS) else gone.hint("merge")
    return docs.join(gone, F.col(id_col).cast("long") == F.col("__gone"), "left_anti")
