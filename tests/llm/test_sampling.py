"""Fill-in-middle, importance resampling and MinHash near-duplicates against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from isoloom.llm import fill_in_middle as fim
from isoloom.llm import jaccard_join, minhash, resampling, wordhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", None, " ", "!!", "a", "a b", "a b c", "É x", "\x00\x01", "<P>", "a <M> b", "x" * 70_000, "word " * 20_000, "日本語 テキスト 😀", "a b c"]


def docs(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "en", "s", None) for i, t in enumerate(texts)], DOCS)


def odd(spark):
    """Nulls, empty, very long and repeated rows, and columns whose names clash with the operators' own."""
    extra = spark.createDataFrame([(None, "null id here", None, None, None), (None, None, None, None, None), (1, None, None, None, None), (1, None, None, None, None)], DOCS)
    rows = docs(spark, ODD).unionByName(extra)
    for name in ("n", "form", "output", "score", "rank", "a", "b", "bucket", "bands", "rep", "digest", "g", "kept"):
        rows = rows.withColumn(name, F.lit("clash"))
    return rows


# 11


@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=400), max_size=6), st.integers(3, 900))
@settings(max_examples=120, deadline=None)
def test_rank_index_is_exact(texts, chunk):
    raw, bounds = wordhash.buffers(pa.array(texts, pa.string()))
    old, fim.CHUNK = fim.CHUNK, chunk
    try:
        index, ranks = fim.RankIndex.of(raw, bounds)
    finally:
        fim.CHUNK = old
    want = [0, *np.cumsum([len(c.encode()) for t in texts for c in t]).tolist()]
    assert index.locate(np.arange(len(want))).tolist() == want
    assert ranks.tolist() == [0, *np.cumsum([len(t) for t in texts]).tolist()]
    assert len(index.residuals) == len(want) and index.residuals.dtype == np.int8


def test_rank_index_is_small():
    """Even text is one segment; the lines never leave their error."""
    raw, bounds = wordhash.buffers(pa.array(["abc é " * 50_000], pa.string()))
    index, _ = fim.RankIndex.of(raw, bounds)
    assert len(index.starts) == 1 and np.abs(index.residuals.astype(int)).max() <= 2
    mixed = "".join(random.Random(3).choices(["a" * 300, "日本" * 200, "é" * 90], k=400))
    raw, bounds = wordhash.buffers(pa.array([mixed], pa.string()))
    index, _ = fim.RankIndex.of(raw, bounds)
    assert np.abs(index.residuals.astype(int)).max() <= fim.ERROR + 1 and len(index.starts) < 1500


def middle_by_hand(doc_id, text, seed=1, rate=90, first=20):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    p, q = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in fim.MARKS) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    spm = h[3] % 100 < first
    out = f"<S>{text[q:]}<P>{text[:p]}<M>{text[p:q]}" if spm else f"<P>{text[:p]}<S>{text[q:]}<M>{text[p:q]}"
    return doc_id, n, "spm" if spm else "psm", p, q - p, out


@pytest.mark.parametrize("seed", [1, 5])
def test_fill_in_middle(spark, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choices("aé日😀 \n<P", k=rng.randrange(0, 300))) for _ in range(300)]
    df = odd(spark).select("doc_id", "text").unionByName(docs(spark, texts, 100).select("doc_id", "text"))
    out = fim.transform(df, seed)
    rows = out.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: str((r[0], r[-1]))
    want = [middle_by_hand(r["doc_id"], r["text"], seed) for r in df.collect()]
    assert sorted((tuple(r)[:6] for r in rows), key=key) == sorted(want, key=key)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["back"]) for r in rows) == sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in df.collect())
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}


def test_fill_in_middle_odd_rows(spark):
    rows = fim.transform(odd(spark)).collect()
    assert len(rows) == len(ODD) + 4
    assert fim.transform(odd(spark).limit(0)).count() == 0
    other = fim.transform(docs(spark, ["one two [m] three", "four five"]), rate=100, suffix_first=0, marks=("[p]", "[s]", "[m]"))
    got = {r["doc_id"]: r for r in other.withColumn("back", fim.restored(F.col("output"), F.col("form"), ("[p]", "[s]", "[m]"))).collect()}
    assert got[0]["form"] == "plain" and got[1]["form"] == "psm" and got[1]["back"] == "four five"


# 12


@given(st.lists(st.binary(max_size=90), min_size=1, max_size=20), st.integers(0, 2**32 - 1))
@settings(max_examples=100, deadline=None)
def test_crc32(parts, before):
    data = np.frombuffer(b"".join(parts), np.uint8)
    end = np.cumsum([len(p) for p in parts])
    start = end - np.array([len(p) for p in parts])
    assert resampling.crc32(data, start, end).tolist() == [zlib.crc32(p) for p in parts]
    assert resampling.crc32(data, start, end, np.full(len(parts), before, np.uint32)).tolist() == [zlib.crc32(p, before) for p in parts]


def resampled_by_hand(rows, target, percent, seed, run, least):
    def features(text):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in range(1, run + 1) for i in range(len(w) - k + 1)]

    s, t = (Counter(b for text in texts for b in features(text)[1]) for texts in ([x for _, x in rows], target))
    total, wanted = sum(s.values()), sum(t.values())
    out = []
    for i, text in rows:
        n, f = features(text)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (total + 10_000) / ((s[b] + 1) * (wanted + 10_000)))) for b in f]
        weight = sum(gain) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    order = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], 2**63 - 1 if r[0] is None else r[0], -r[2], -r[1]))
    drawn = order[: percent * len(order) // 100]
    ranks = Counter()
    found = []
    for k, r in enumerate(drawn, 1):
        found.append((*r[:4], k))
        ranks[r] += 1
    for r in out:
        if ranks[r]:
            ranks[r] -= 1
        else:
            found.append((*r[:4], None))
    return sorted(found, key=str)


@pytest.mark.parametrize(("percent", "run", "least"), [(10, 1, 20), (40, 2, 3), (100, 3, 0), (1, 1, 20)])
def test_resampling(spark, monkeypatch, percent, run, least):
    rng = random.Random(percent)
    vocabulary = ["Alpha", "beta", "gamma9", "delta", "é", "日本", "zeta-eta", "x" * 80]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(0, 60))) for _ in range(400)]
    df = odd(spark).select("doc_id", "text").unionByName(docs(spark, texts, 100).select("doc_id", "text")).unionByName(docs(spark, texts[:40], 100).select("doc_id", "text"))
    target = docs(spark, ["beta beta gamma9 alpha", None, "", "DELTA é"]).select("text")
    monkeypatch.setattr(resampling, "FEW", 8)
    got = resampling.resample(df, target, percent, 7, run, least).collect()
    want = resampled_by_hand([(r["doc_id"], r["text"]) for r in df.collect()], [r["text"] for r in target.collect()], percent, 7, run, least)
    assert sorted((tuple(r) for r in got), key=str) == want


def test_resampling_odd_rows(spark):
    rows = resampling.resample(odd(spark), docs(spark, [])).collect()
    assert len(rows) == len(ODD) + 4 and {r["n_features"] for r in rows if r["doc_id"] in (0, 1)} == {0}
    assert resampling.resample(docs(spark, []), docs(spark, ["a"])).count() == 0


@pytest.mark.parametrize("values", [1, 3, 10_000])
def test_cutoff(spark, monkeypatch, values):
    """The exact k-th key with few and with many distinct ones, in uneven partitions."""
    from isoloom.llm.common import written

    monkeypatch.setattr(resampling, "FEW", 16)
    keys = written(spark.range(0, 6000, 1, 5).select((F.xxhash64("id") % values).alias("a"), F.floor(F.col("id") / 2).alias("b")).repartition(3, "a"), "keys")
    order = sorted((r["a"], r["b"]) for r in keys.collect())
    for k in (1, 2, 17, 3000, 5999, 6000):
        assert resampling.cutoff(keys, k) == order[k - 1]


# 13


def test_pruning_bound():
    """The plan asks for more matches with every batch and rarely drops a pair at the threshold."""
    plan = minhash.least_matches(85)
    assert [k for k, _ in plan] == list(range(16, 129, 16)) and [m for _, m in plan] == sorted({m for _, m in plan})
    rng = np.random.default_rng(2)
    hits = np.cumsum(rng.random((200_000, 128)) < 0.85, axis=1)
    assert np.mean([hits[:, k - 1] < m for k, m in plan], axis=1).max() < 2e-5
    assert (1 - 0.85**minhash.ROWS) ** minhash.BANDS < 1e-6
    low = np.cumsum(rng.random((20_000, 128)) < 0.5, axis=1)
    assert np.mean(np.any([low[:, k - 1] < m for k, m in plan], axis=0)) > 0.999
    assert minhash.least_size(85) == 6


def test_minima_estimate_similarity():
    rng = np.random.default_rng(5)
    both, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (800, 100, 100))
    sets = [np.unique(np.r_[both, a]), np.unique(np.r_[both, b])]
    s = minhash.minima(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.12
    assert minhash.minima(np.zeros(0, np.uint64), np.zeros(3, np.int64)).shape == (2, 128)


def linked_by_hand(rows, size, percent):
    sets: dict = {}
    out = []
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        s = frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
        out.append((i, len(s)))
        if i is not None:
            sets.setdefault(i, []).append(s)
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in ids:
        for y in ids:
            if x < y and any(100 * len(a & b) >= percent * len(a | b) for a in sets[x] for b in sets[y] if a and b):
                p, q = sorted((find(x), find(y)))
                root[q] = p
    return sorted(((i, n, None if i is None else find(i), i is None or find(i) == i) for i, n in out), key=str)


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80), (1, 90)])
def test_minhash_against_brute_force(spark, size, percent):
    rng = random.Random(size)
    words = [f"w{k}" for k in range(3000)]
    texts = []
    for _ in range(25):
        base = rng.choices(words, k=rng.choice([2, 8, 30, 120, 400]))
        for _ in range(rng.randrange(1, 7)):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 30)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    df = odd(spark).select("doc_id", "text").unionByName(docs(spark, texts, 100).select("doc_id", "text")).unionByName(docs(spark, texts[5:8], 100).select("doc_id", "text"))
    got = minhash.join(df, size, percent).collect()
    assert sorted((tuple(r) for r in got), key=str) == linked_by_hand([(r["doc_id"], r["text"]) for r in df.collect()], size, percent)


def test_minhash_groups_of_near_copies(spark, monkeypatch):
    """A large group whose buckets and clusters span several blocks, beside sets that share a passage and stay apart."""
    monkeypatch.setattr(minhash, "LIST_BLOCK", 16)
    rng = random.Random(9)
    base = [f"v{k}" for k in range(300)]
    near = []
    for k in range(90):
        copy = list(base)
        copy[rng.randrange(300)] = f"own{k}"
        near.append(" ".join(copy))
    shared = [" ".join([*(f"s{j}" for j in range(60)), *(f"d{k}x{j}" for j in range(60))]) for k in range(60)]
    df = docs(spark, near + shared)
    got = {r["doc_id"]: r for r in minhash.join(df).collect()}
    assert all(got[k]["component_id"] == 0 for k in range(90)) and [r for r in range(90) if got[r]["kept"]] == [0]
    assert all(got[k]["component_id"] == k and got[k]["kept"] for k in range(90, 150))


@pytest.mark.parametrize("few", [1, 4])
def test_minhash_blocks_meet_at_once_or_in_rounds(spark, monkeypatch, few):
    """The same links whether all blocks of a group meet in the first round or go through three."""
    monkeypatch.setattr(minhash, "LIST_BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "CLUSTER_BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "FEW_BLOCKS", few)
    rng = random.Random(few)
    base = [f"v{k}" for k in range(200)]
    texts = []
    for _ in range(28):
        copy = list(base)
        for _ in range(rng.choice([1, 2, 4, 8])):
            copy[rng.randrange(200)] = f"own{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    got = minhash.join(docs(spark, texts)).collect()
    assert sorted((tuple(r) for r in got), key=str) == linked_by_hand(list(enumerate(texts)), 3, 85)


def test_minhash_runs_few_stages(spark, monkeypatch):
    """A group of near copies in three blocks: what runs for it is a fixed number of stages, each of all partitions."""
    monkeypatch.setattr(minhash, "LIST_BLOCK", 16)
    base = [f"v{k}" for k in range(300)]
    texts = [" ".join([*base[:k], f"own{k}", *base[k + 1 :]]) for k in range(40)]
    df = docs(spark, texts).persist()
    df.count()
    sc = spark.sparkContext
    sc.setJobGroup("few-stages", "")
    try:
        assert {r["component_id"] for r in minhash.join(df).collect()} == {0}
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    told = sc.statusTracker()
    stages = {s for j in told.getJobIdsForGroup("few-stages") for s in told.getJobInfo(j).stageIds}
    ran = [s for s in stages if (i := told.getStageInfo(s)) and i.numCompletedTasks]
    assert 20 < len(ran) < 90, len(ran)


def test_minhash_odd_rows(spark):
    rows = minhash.join(odd(spark)).collect()
    assert len(rows) == len(ODD) + 4 and all(r["kept"] for r in rows if r["doc_id"] is None or not r["n_shingles"])
    assert minhash.join(docs(spark, [])).count() == 0


def test_shingles_of_few_words():
    """A slice with fewer words in all than a shingle has."""
    for texts in ([""], ["a"], ["a b"], ["a", "", "b c"]):
        w = wordhash.words(*wordhash.buffers(pa.array(texts, pa.string())))
        h, bounds = wordhash.shingles(w, 5)
        assert np.diff(bounds).tolist() == [int(bool(t)) for t in texts] and len(h) == bounds[-1]
