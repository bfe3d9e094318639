"""The training-data operators against brute force, exact round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import compare
from pyspark.sql import functions as F

from isoloom.llm import byte_bpe, chat, components, decontamination, jaccard_join, language_id, quality, queries, secrets, sharding, spotsigs, toxicity, wordhash

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", None, " ", "!!", "a", "a b", "a b c", "É x", "\x00\x01", "<|im_end|>", "x" * 70_000, "word " * 20_000, "日本語 テキスト", "a b c"]


def docs(spark, texts, start=0):
    rows = [(start + i, t, "en", "s", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def odd(spark):
    """Nulls, empty, very long and repeated rows, and columns whose names clash with the operators' own."""
    extra = spark.createDataFrame([(None, "null id", None, None, None), (1, None, None, None, None), (1, None, None, None, None)], DOCS)
    return docs(spark, ODD).unionByName(extra).withColumn("score", F.lit("x")).withColumn("n", F.lit(1)).withColumn("token", F.lit(2)).withColumn("range", F.lit(0)).withColumn("site", F.lit("y"))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    compare(spark, queries.QUERIES[name], queries.ORACLES[name], SF)


# words


@given(st.lists(st.text("aB \t\ncé", max_size=30), max_size=12), st.integers(1, 40))
@settings(max_examples=150, deadline=None)
def test_word_hashes_tell_words_apart(texts, chunk):
    raw, offsets = wordhash.buffers(pa.array(texts, pa.string()))
    old, wordhash.CHUNK = wordhash.CHUNK, chunk
    try:
        w = wordhash.words(raw, offsets)
    finally:
        wordhash.CHUNK = old
    want = [[x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(r"[^ \t-\r]+", t)] for t in texts]
    assert np.diff(w.bounds).tolist() == [len(x) for x in want]
    flat = [x for xs in want for x in xs]
    code = {}
    for x, h in zip(flat, w.hashes.tolist(), strict=True):
        assert code.setdefault(x, h) == h
    assert len(set(code.values())) == len(code)


# 1


def test_toxicity(spark):
    rng = random.Random(1)
    plain, bad = [f"w{rng.choice('abcdefgh')}{rng.choice('lmnop')}er" for _ in range(60)], ["grumblefoul", "snarkvile", "hatewretch"]
    rows = []
    for i in range(900):
        words = [rng.choice(plain) for _ in range(40)]
        label = int(i % 4 == 0)
        if label:
            words[rng.randrange(40)] = rng.choice(bad)
        rows.append((i, " ".join(words), label))
    model = toxicity.train(rows[:700])
    assert model is not None
    df = docs(spark, [t for _, t, _ in rows[700:]], 700)
    got = {r["doc_id"]: r for r in toxicity.score(df, model).collect()}
    right = [got[i]["predicted"] == label for i, _, label in rows[700:]]
    assert np.mean(right) > 0.95
    assert toxicity.keep_clean(df, model).columns == df.columns
    assert toxicity.keep_clean(df, model).count() == sum(r["predicted"] == 0 for r in got.values())
    out = toxicity.score(odd(spark), model).collect()
    assert len(out) == len(ODD) + 3 and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.train([]) is None and {r["score"] for r in toxicity.score(odd(spark), None).collect()} == {0.0}
    assert toxicity.score(df.limit(0), model).count() == 0 and toxicity.keep_clean(odd(spark), None).count() == len(ODD) + 3


def test_rare_toxic_words():
    """Words of few toxic documents count however many others there are, all of a large vocabulary too; copies don't."""
    rng = random.Random(5)
    plain = [f"w{rng.choice('abcdefgh')}{rng.choice('lmnop')}{rng.choice('rstv')}er" for _ in range(90)]
    rare = ["".join(rng.choice("gzqxkvj") + rng.choice("aeiou") for _ in range(8)) for _ in range(150)]
    say = lambda *more: " ".join([*(rng.choice(plain) for _ in range(30)), *more])
    half = {k: [i for i in range(20_000) if zlib.crc32(f"half {i}".encode()) % 2 == k] for k in (0, 1)}
    toxic = [say("grumblefoul", *rare[10 * (k // 5) : 10 * (k // 5 + 1)]) if k < 75 else say("grumblefoul") for k in range(280)] + [say("tabletop")] * 20
    rows = [(half[0][k], t, 1) for k, t in enumerate(toxic)] + [(half[0][k], say(), 0) for k in range(300, 1200)]
    rows += [(half[1][k], say(rng.choice(rare)), 1) for k in range(100)] + [(half[1][k], say(), 0) for k in range(100, 500)]
    model = toxicity.train(rows)
    distances = toxicity.Distances(model)
    assert all(distances.of(f" {w} ".encode()) >= toxicity.HIT for w in rare)
    assert distances.of(b" tabletop ") < toxicity.HIT


def test_distances_by_zstandard():
    """Distances and features by compressing each window by hand."""
    import zstandard as z

    rng = random.Random(6)
    plain = [f"w{a}{b}er" for a in "abcdefgh" for b in "lmnop"]
    rows = [(i, " ".join([*rng.choices(plain, k=30), *(["grumblefoul"] if i % 3 == 0 else [])]), int(i % 3 == 0)) for i in range(300)]
    model = toxicity.train(rows)

    def packed(content, window):
        d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=toxicity.LEVEL)
        spelt = b"".join(toxicity._CODES[b].tobytes() for b in window)
        return len(z.ZstdCompressor(level=toxicity.LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress(spelt))

    texts = ["a \u201cgrumblefoul\u201d here", "Grumblefoul, walers\u2026 walers", "", "... 12", rows[1][1]]
    got = toxicity.Distances(model).features(*wordhash.buffers(pa.array(texts, pa.large_string())))
    for text, f in zip(texts, got, strict=True):
        found = [w.lower().encode() for w in re.findall(r"[^\W\d_]+", text)]
        d = [packed(model.ordinary, b" " + w + b" ") - packed(model.toxic, b" " + w + b" ") for w in found]
        assert f.tolist() == pytest.approx([min(max(d, default=0), 16) if max(d, default=0) > 0 else 0, np.log1p(sum(x >= toxicity.HIT for x in d)), np.log1p(len(found))])
    assert got[0, 1] > 0 and got[1, 1] > 0 and not got[2].any()


def test_samples_are_bounded(spark):
    """Many rows of one id, and long texts: what is learned from stays within rows and bytes."""
    many = spark.range(5_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    known = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, toxic int")
    assert len(language_id.sample_known(many, 40)) == 40
    assert 0 < len(toxicity.sample_labelled(many, known, "toxic", 30)) <= 60
    chosen = spark.createDataFrame([(1, "en")], "__id long, __label string")
    from isoloom.llm.common import sampled_texts

    taken = sampled_texts(many, chosen, [F.col("doc_id") == F.col("__id")], 1000, 500)
    assert taken and sum(len(t) for _, t, _ in taken) <= 500
    same = many.withColumn("text", F.lit("one text"))
    assert sampled_texts(same, chosen, [F.col("doc_id") == F.col("__id")], 1000) == [(1, "one text", "en")]


# 2


def brute_literals(lines):
    """Values that a run of simple assignments brings to sensitive names, statement by statement."""
    holds, out = {}, set()
    for name, value, quoted in lines:
        value = value if quoted else holds.get(value, value)
        holds[name] = value
        if secrets.name_weight(name) * secrets.literal_quality(value) >= secrets.THRESHOLD:
            out.add(value)
    return out


@given(st.lists(st.tuples(st.sampled_from(["a", "db_pwd", "authKey", "port", "x.y", "credential"]), st.sampled_from(["a", "port", "x.y", "Zx9Qw3Lm7Tp2", "Kd8Rf4Bn6Vc1w", "changeme", "on"]), st.booleans()), max_size=12))
@settings(max_examples=200, deadline=None)
def test_literals_by_brute_force(lines):
    text = "".join(f"{n} = {repr(v) if q else v}\n" for n, v, q in lines)
    assert {text[x.start : x.end] for x in secrets.literal_spans(text)} == brute_literals(lines)


def test_empty_tables(spark):
    none = odd(spark).limit(0)
    assert secrets.scan(none).count() == secrets.masked_texts(none).count() == 0
    model = language_id.train([(1, "the cat", "en"), (2, "der hund", "de")])
    assert language_id.label(none, model).count() == 0 and language_id.sample_known(none) == []
    assert byte_bpe.round_trip(none, public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN).count() == 0
    assert toxicity.sample_labelled(none, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"), "toxic") == []


def brute_base(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end(), "assign"))
    for k, (kind, p, n) in enumerate((("access", "AKIA[A-Z0-9]+", 18), ("hex", "[0-9a-f]+", 16)), 1):
        out += [(m.start(), k, m.end(), kind) for m in re.finditer(p, text) if len(m[0]) >= n]
    return ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in sorted(out))


@given(st.lists(st.sampled_from(["token", "SECRET", "api_key", "apikey", '"', "'", " ", ":", "=", "AKIA", "0123456789abcdef", "ABCDEFGHIJKLMNOP", "ſecret", "é", "x", "\n", "pass", "pwd", "hunter2X9"]), max_size=30))
@settings(max_examples=200, deadline=None)
def test_base_spans(parts):
    text = "".join(parts)
    base, every = secrets.find(text)
    assert secrets._joined(base) == brute_base(text)
    assert set(base) <= set(every) and secrets._joined(every) == secrets._joined(sorted(every, key=lambda s: s.order))


@pytest.mark.parametrize("n", [20, 128, 4096, 6000, 300_000])
@pytest.mark.parametrize("form", ["CREDENTIAL = {}", "CREDENTIAL = '{}'", 'pwd: "{}"', 'auth = """{}"""', "auth = r'''\n  {}\n'''", "alias = {}\npwd = alias", "n" * 200 + "_pwd = {}", "pwd" + " " * 40 + "= {}"])
def test_long_literals(form, n):
    rng = random.Random(n)
    value = "".join(rng.choices("abcdefgXYZ0123456789", k=n))
    text = f"x = 1\n{form.format(value)}\nport = 8080\n"
    assert secrets.mask(text, secrets.find(text)[1]) == text.replace(value, "[secret]")


def test_wrapped_literal_and_unclosed_quotes():
    text = 'auth = """\nZx9Qw3Lm7Tp2\nKd8Rf4Bn6Vc1\n"""\nport = 1'
    assert secrets.mask(text, secrets.find(text)[1]) == 'auth = """\n[secret]\n"""\nport = 1'
    for part in ("pwd='", 'pwd="\\', "pwd=`a='", 'pwd="""', "pwd" + " " * 9, "pwd:" + "p" * 9):
        start = time.time()
        secrets.literal_spans(part * 20_000)
        assert time.time() - start < 5


def test_lexer_follows_names(spark):
    text = 'tmp = "Zx9Qw3Lm7Tp2"\nalias = tmp\nDB_PWD = alias\nport = 8080\nnote: Zx9Qw3Lm7Tp2x\n'
    found = secrets.literal_spans(text)
    assert [text[s.start : s.end] for s in found] == ["Zx9Qw3Lm7Tp2"]
    assert secrets.literal_spans('password = "changeme"\npassword: none') == []
    masked = secrets.mask(text, secrets.find(text)[1])
    assert '"[secret]"' in masked and "note: Zx9Qw3Lm7Tp2x" in masked
    out = secrets.scan(odd(spark)).collect()
    assert len(out) == len(ODD) + 3 and all(r["spans"] == "" for r in out)
    assert secrets.masked_texts(odd(spark)).columns == odd(spark).columns
    one = secrets.masked_texts(docs(spark, ['token = "abcdefghijkl123"', None])).orderBy("doc_id").collect()
    assert one[0]["text"] == 'token = "[secret]"' and one[1]["text"] is None


# 3


def brute_marginals(scores, transitions):
    n, k = scores.shape
    total = np.zeros((n, k))
    for path in itertools.product(range(k), repeat=n):
        for first in range(k):
            w = np.exp(sum(scores[i, p] for i, p in enumerate(path)) + transitions[first, path[0]] + sum(transitions[a, b] for a, b in zip(path, path[1:], strict=False)))
            for i, p in enumerate(path):
                total[i, p] += w
    return total / total.sum(1, keepdims=True)


def test_forward_backward_is_exact(monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(language_id, "BLOCK", 2)
    lengths = [5, 0, 1, 4, 2]
    bounds = np.r_[0, np.cumsum(lengths)]
    scores, transitions = rng.normal(size=(bounds[-1], 3)), rng.normal(size=(3, 3))
    each = language_id.posterior_sums(scores, bounds, transitions, each=True)
    sums = language_id.posterior_sums(scores, bounds, transitions)
    for i, n in enumerate(lengths):
        want = brute_marginals(scores[bounds[i] : bounds[i + 1]], transitions) if n else np.zeros((0, 3))
        assert np.allclose(each[bounds[i] : bounds[i + 1]], want) and np.allclose(sums[i], want.sum(0))


def test_long_texts_without_letters():
    model = language_id.train([(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog with that", "en"), ("der hund und die katze mit dem", "de")] * 10)])
    texts = [" ".join([x] * n) for x in ("\u2014", "\u2022\u2500", "\U0001f600", "\u0663") for n in (3, 199, 200, 5_000)]
    langs, score = language_id.Labeller(model).documents(pa.array([*texts, texts[-1] + " \u00e9", "the"], pa.large_string()))
    assert langs[:-2] == ["und"] * len(texts) and not score[:-2].any() and "und" not in langs[-2:]


def test_labels_by_brute_force(spark):
    """Language and score of a text: the most expected words over all labellings, and their share."""
    model = language_id.train([(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog with that", "en"), ("der hund und die katze mit dem", "de"), ("le chat et le chien avec", "fr")] * 8)])
    texts = ["the dog und", "katze", "le chat with dem et", "12 der, 7 \u201cthat\u201d", "\u2014"]
    langs, score = language_id.Labeller(model).documents(pa.array(texts, pa.large_string()))
    for text, lang, s in zip(texts, langs, score, strict=True):
        raw, offsets = wordhash.buffers(pa.array([text], pa.large_string()))
        w = wordhash.words(raw, offsets, wordhash.LETTERS)
        assert len(w.hashes) == len(re.findall(r"[^\W\d_]+", text))
        if not len(w.hashes):
            assert (lang, s) == ("und", 0.0)
            continue
        total = brute_marginals(language_id.Labeller(model).scores(raw, w), model.transitions).sum(0)
        assert lang == model.langs[total.argmax()] and s == pytest.approx(total.max() / total.sum())
    clash = language_id.label(odd(spark).withColumn("lang_pred", F.lit("x")), model)
    assert clash.count() == len(ODD) + 3 and clash.columns == ["doc_id", "lang_pred", "score"]


def test_language_held_out_and_code_switching(spark):
    out = queries.op3_language_id(spark, SF)
    lang = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    r = out.join(lang, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert r > 0.95
    model = language_id.train([(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog with that", "en"), ("der hund und die katze mit dem", "de")] * 10)])
    labels = [x[1] for x in language_id.label_words("the cat and the dog der hund und die katze", model)]
    assert labels == ["en"] * 5 + ["de"] * 5
    rows = {r["doc_id"]: r for r in language_id.label(docs(spark, ODD), model).collect()}
    assert rows[0]["lang_pred"] == rows[1]["lang_pred"] == rows[3]["lang_pred"] == "und" and rows[4]["lang_pred"] != "und"
    assert language_id.label(odd(spark), None).where("lang_pred <> 'und'").count() == 0 and language_id.train([]) is None


# 4


def test_fingerprints(spark):
    out = {r["doc_id"]: r for r in queries.op4_document_fingerprints(spark, SF).collect()}
    import duckdb

    duckdb.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    for i, n, sha in duckdb.sql(spotsigs.ORACLE_EDITS).fetchall():
        assert (out[i]["n_chars"], out[i]["edited_sha256"]) == (n, sha)
    big = [r for r in out.values() if r["n_chars"] > 400]
    assert np.median([r["near_edited"] for r in big]) > 0.5 and np.mean([r["near_edited"] > r["near_next"] for r in big]) > 0.95
    for r in out.values():
        a, b = (set(filter(None, r[k].split("."))) for k in ("fingerprint", "edited_fingerprint"))
        assert r["near_edited"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
    rows = spotsigs.edited(odd(spark)).collect()
    assert len(rows) == len(ODD) + 3
    by = {r["doc_id"]: r["fingerprint"] for r in rows if r["doc_id"] not in (None, 1)}
    assert by[6] == by[13] and by[0] == "" and by[3] != ""
    assert spotsigs.edited(odd(spark).limit(0)).count() == 0
    alone = spotsigs.edited(docs(spark, ["abcd efgh"])).first()
    assert alone["edited_sha256"] == hashlib.sha256(b"abcd efab").hexdigest()


def test_ranges_keep_order(spark):
    ids = [5, 2**62, -(2**62), 7, 8, 0, 3]
    df = spark.createDataFrame([(i, f"t{i} " * 50) for i in ids], "doc_id long, text string")
    old, spotsigs.RANGE_BYTES = spotsigs.RANGE_BYTES, 300
    try:
        got = {r["doc_id"]: r["next_text"] for r in spotsigs.with_next(df).collect()}
    finally:
        spotsigs.RANGE_BYTES = old
    order = sorted(ids)
    assert got == {a: f"t{b} " * 50 for a, b in zip(order, order[1:] + order[:1], strict=True)}


def test_ranges_hold_alike(spark):
    """Dense ids with a far one, one id for all rows, and no ids: no range holds twice the mean."""
    n = 20_000
    base = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("some text "), F.col("id").cast("string"), F.repeat(F.lit(" x"), 100)).alias("text"))
    far = base.unionByName(spark.createDataFrame([(2**62, "far"), (-(2**62), "far")], "doc_id long, text string"))
    third = base.withColumn("doc_id", F.when(F.col("doc_id") % 3 == 0, 7).otherwise(F.col("doc_id")))
    old, spotsigs.RANGE_BYTES = spotsigs.RANGE_BYTES, 100_000
    try:
        for df in (far, base.withColumn("doc_id", F.lit(5).cast("long")), base.withColumn("doc_id", F.lit(None).cast("long")), third):
            rows, ranges = spotsigs._ranged(df)
            sizes = [r["n"] for r in rows.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect()]
            assert sum(sizes) >= n and ranges > 30 and max(sizes) < 2 * n / ranges, (max(sizes), n / ranges)
    finally:
        spotsigs.RANGE_BYTES = old


def test_repeated_signatures_are_counted(spark):
    sigs = sorted([3] * 700 + [5] + [9] * 2 + [11] * 33)
    got = spark.createDataFrame([(sigs,)], "s array<long>").select(spotsigs._counted(F.col("s"))).first()[0]
    again = spark.createDataFrame([(sigs[:-1],)], "s array<long>").select(spotsigs._counted(F.col("s"))).first()[0]
    assert len(set(got)) == len(sigs) and {3, 5, 9, 11} <= set(got) and len(set(got) - set(again)) == 1 and set(again) < set(got)


def brute_signatures(text):
    """Signatures as the module's text says them, word by word."""
    words = re.findall(r"[^\W_]+", text.lower())
    anchors = set(spotsigs.ANCHORS)
    runs = [["", []]]
    for x in words:
        if x in anchors:
            runs.append([x, []])
        else:
            runs[-1][1].append(x)
    spots = []
    for k, (anchor, content) in enumerate(runs):
        if content:
            spots += [(anchor, content[j : j + spotsigs.RUN]) for j in range(0, len(content), spotsigs.RUN)]
        elif anchor and k + 1 < len(runs) and runs[k + 1][0] == anchor:
            spots.append((anchor, []))
    out = []
    for k, (anchor, content) in enumerate(spots):
        chain = list(content)
        for _, more in spots[k + 1 : k + spotsigs.CHAIN]:
            chain += more
        out.append((anchor, *chain[: spotsigs.CHAIN]))
    if not out:
        out = [("", x, y) for x, y in zip(words, [*words[1:], ""], strict=False)] or ([(text,)] if text else [])
    return out


def test_signatures_by_brute_force(spark):
    rng = random.Random(4)
    pool = ["the", "of", "la", "der", "und", "house", "river", "Haus", "maison", "x1", "tree", "los"]
    texts = [" ".join(rng.choices(pool, k=rng.randrange(60))) + rng.choice(["", "!", "\n"]) for _ in range(60)] + ["the the the", "the of", "!?", "", "house " * 40]
    rows = spotsigs.signatures(docs(spark, texts), "text", "sigs").select("doc_id", "sigs").collect()
    got = {r["doc_id"]: set(r["sigs"]) for r in rows}
    want = {}
    for i, t in enumerate(texts):
        count = {}
        for x in brute_signatures(t):
            count[x] = count.get(x, 0) + 1
        want[i] = {(x, k) for x, n in count.items() for k in range(n)}
    assert {i: len(v) for i, v in got.items()} == {i: len(v) for i, v in want.items()}
    for i, j in itertools.combinations(range(len(texts)), 2):  # hashes differ, what sets share doesn't
        assert len(got[i] & got[j]) == len(want[i] & want[j])


def test_near_pairs(spark):
    base = [f"the w{i} and x{i} of y{i}" for i in range(60)]
    texts = [" ".join(base), " ".join(base), " ".join([*base[:-3], "else"]), " ".join(base[30:]), "quite another text of the sort"]
    pairs, members = spotsigs.near_pairs(docs(spark, texts), 80)
    assert {(r["a"], r["b"]) for r in pairs.collect()} == {(0, 2)}
    assert {r["doc_id"]: r["representative"] for r in members.collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4}
    same = docs(spark, [*texts, None, ""]).withColumn("doc_id", F.when(F.col("doc_id") > 2, 3).otherwise(F.col("doc_id"))).unionByName(spark.createDataFrame([(None, "no id", None, None, None)], DOCS)).withColumn("key", F.lit(1)).withColumn("sigs", F.lit(2))
    pairs, members = spotsigs.near_pairs(same, 80)
    assert {(r["a"], r["b"]) for r in pairs.collect()} == {(0, 2)} and members.count() == 7
    pairs, members = spotsigs.near_pairs(docs(spark, texts).limit(0), 80)
    assert pairs.count() == members.count() == 0


# 5


def test_shards(spark, tmp_path):
    rng = random.Random(5)
    df = docs(spark, ["x" * rng.randrange(200) for _ in range(400)])
    rows = sharding.assign(df, 1000).collect()
    size = {}
    for r in rows:
        size[r["shard"]] = size.get(r["shard"], 0) + r["n_bytes"]
    assert len(rows) == 400 and all(v <= 1000 for v in size.values()) and all(size[r["shard"]] == r["shard_bytes"] for r in rows)
    for shard in size:  # a shard's parent didn't fit
        depth, prefix = map(int, shard.split(":"))
        if depth:
            parent = prefix >> 1
            inside = sum(v for s, v in size.items() if (d := int(s.split(":")[0])) >= depth - 1 and int(s.split(":")[1]) >> (d - depth + 1) == parent)
            assert inside > 1000
    compare(spark, lambda s, _: sharding.assign(s.read.parquet(f"{SF}/documents.parquet"), 20_000), sharding.oracle(20_000), SF)
    same = docs(spark, ["y" * 600] * 1).unionByName(docs(spark, ["y" * 600] * 1))
    assert all(r["oversize"] and r["depth"] == 60 for r in sharding.assign(same, 1000).collect())
    assert len(sharding.assign(odd(spark), 10_000).collect()) == len(ODD) + 3 and sharding.assign(df.limit(0), 10).count() == 0
    twice = docs(spark, ["a", "b"]).withColumn("doc_id", F.lit(4).cast("long")).withColumn("shard", F.lit("clash"))
    sharding.write_shards(twice.unionByName(twice), str(tmp_path / "t"), 1000)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4
    sharding.write_shards(df, str(tmp_path / "s"), 1000)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 400


# 6


@pytest.mark.parametrize("text", ["", "\\", "\\\\<|", "</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\nx", "a<", "<<|im_end|>\n", "<<SYS>>", "[\\INST]", "é\n\n"])
def test_escape_round_trip(spark, text):
    df = spark.createDataFrame([(1, 0, 0, "user", text), (1, 1, 0, "assistant", text), (1, 2, 0, "we\nird|role", text)], "conv_id long, turn long, place int, role string, text string")
    r = chat.render(df)
    got = chat.read_rows(r).orderBy("place").collect()
    assert [(x["role"], x["text"], x["loss"]) for x in got] == [("user", text, None), ("assistant", text, text), ("we\nird|role", text, None)]
    assert not re.search(r"<\|(?!im_start|im_end)|</?s>|\[/?INST\]", r.first()["formatted"])


def test_layouts(spark):
    import json

    layouts = [
        {"prompt": "p", "response": "r"}, {"system": "s", "prompt": "p", "response": "r"}, {"instruction": "i", "input": "", "output": "o"}, {"instruction": "i", "input": "j", "output": "o"},
        {"messages": [{"role": "user", "content": "p"}, {"role": "assistant", "content": None}]}, {"conversations": [{"from": "human", "value": "p"}, {"from": "gpt", "value": "r"}]}, {"question": "q", "answer": "a"},
        {"unknown": {"deep": 1}}, {"role": "user", "text": "t"}, {"id": 7, "messages": [{"role": "user", "content": "p", "id": 1.5, "meta": {"role": "x"}}]}, {"my field: <a": 1, "prompt": "p", "response": "r", "tags": ["x"]},
    ]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(layouts)], "conv_id long, j string").select("conv_id", F.parse_json("j").alias("record"))
    got = {r["conv_id"]: r["turns"] and [tuple(t) for t in r["turns"]] for r in chat.canonical_turns(df).select("conv_id", "turns").collect()}
    assert got == {
        0: [("user", "p"), ("assistant", "r")], 1: [("system", "s"), ("user", "p"), ("assistant", "r")], 2: [("user", "i"), ("assistant", "o")], 3: [("user", "i\n\nj"), ("assistant", "o")],
        4: [("user", "p"), ("assistant", "")], 5: [("user", "p"), ("assistant", "r")], 6: [("user", "q"), ("assistant", "a")], 7: None, 8: [("user", "t")], 9: [("user", "p")], 10: [("user", "p"), ("assistant", "r")],
    }
    assert [r["conv_id"] for r in chat.unmapped(df).collect()] == [7]
    rows = chat.turn_rows(df.withColumn("turn", F.lit(0)).withColumn("mapping", F.lit("clash")).withColumn("place", F.lit("clash"))).where("conv_id = 7").collect()
    assert [(r["role"], json.loads(r["text"])) for r in rows] == [("record", {"unknown": {"deep": 1}})]
    paths = {r[0]: r[1] for r in df.select("conv_id", chat.field_paths(F.col("record"))).collect()}
    assert paths[9] == ["id", "messages", "messages[].content", "messages[].id", "messages[].meta", "messages[].meta.role", "messages[].role"]


def test_null_and_repeated_turns(spark):
    df = spark.createDataFrame([(None, None, 0, None, None), (None, None, 0, None, None), (2, 1, 0, "assistant", "b"), (2, 0, 0, "assistant", "a"), (2, 0, 0, "assistant", "a")], "conv_id long, turn long, place int, role string, text string")
    got = {r["conv_id"]: r for r in chat.digests(chat.render(df)).collect()}
    assert got[None]["n_turns"] == 2 and got[2]["loss_sha256"] == hashlib.sha256(b"aab").hexdigest() and got[2]["loss_chars"] == 3
    assert chat.digests(chat.render(df.limit(0))).count() == 0


# 7


def brute_align(a, b):
    h, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


@given(st.lists(st.integers(0, 3), max_size=12), st.lists(st.integers(0, 3), max_size=12))
@settings(max_examples=200, deadline=None)
def test_alignment(a, b):
    assert decontamination.align(np.array(a, np.uint64), np.array(b, np.uint64))[0] == brute_align(a, b)


def test_leaks(spark):
    rng = random.Random(7)
    vocabulary = [f"{a}{b}" for a in "bcdfg" for b in ("an", "on", "er", "ith", "ould", "est", "ary")]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [say(30) for _ in range(6)]
    edited = list(items[1])
    for k in range(0, 30, 8):
        edited[k] = "changed"
    texts = [say(80) + items[0] + say(40), say(50) + edited + say(9), items[2], say(200), say(30) + items[3][:10] + say(30), [x.upper() for x in items[4]]]
    bench = spark.createDataFrame([*((i, ", ".join(x)) for i, x in enumerate(items)), (90, ""), (91, None)], "item_id long, text string")
    df = docs(spark, [" ".join(t) for t in texts])
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontamination.leaks(df, bench).collect()}
    assert set(got) == {(0, 0), (1, 1), (2, 2), (5, 4)} and got[0, 0] == 1.0 and got[1, 1] < 1
    assert {r["doc_id"] for r in decontamination.keep_clean(df, bench).collect()} == {3, 4}
    for i, t in enumerate(texts):  # whole texts against whole items
        for j, item in enumerate(items):
            words = [x.lower() for x in t]
            assert (brute_align(item, words) >= decontamination.LEAK * 60) == ((i, j) in got)
    assert decontamination.leaks(odd(spark), bench).count() == 0 and decontamination.keep_clean(odd(spark), bench).count() == len(ODD) + 3
    assert decontamination.leaks(df, bench.limit(0)).count() == 0 and decontamination.leaks(df.limit(0), bench).count() == 0


def test_edited_leaks(spark):
    """Copies edited at every step-th word, verbatim copies elsewhere or not: leaks are what brute force says."""
    rng = random.Random(11)
    say = lambda n: [rng.choice(["the", "of", "and", f"w{rng.randrange(900)}", f"w{rng.randrange(900)}"]) for _ in range(n)]
    items = [say(n) for n in (15, 20, 39, 59)]
    edits = {"replace": lambda x: ["new"], "delete": lambda x: [], "insert": lambda x: [x, "new"]}
    texts, kinds = [say(30) + items[1] + say(30)], []
    for j, item in enumerate(items):
        for kind, edit in edits.items():
            for step in range(1, 7):
                copy = [y for k, x in enumerate(item) for y in (edit(x) if k % step == step - 1 else [x])]
                kinds.append((len(texts), j, kind, step))
                texts.append(say(25) + copy + say(25))
    bench = spark.createDataFrame([(j, " ".join(x)) for j, x in enumerate(items)], "item_id long, text string")
    df = docs(spark, [" ".join(t) for t in texts])
    want = {(i, j) for i, t in enumerate(texts) for j, x in enumerate(items) if brute_align(x, t) >= decontamination.LEAK * 2 * len(x)}
    assert {(i, j) for i, j, kind, step in kinds if step > 3 or kind == "insert"} <= want
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(df, bench).collect()} == want
    assert {r["doc_id"] for r in decontamination.keep_clean(df, bench).collect()} == set(range(len(texts))) - {i for i, _ in want}


def test_benchmark_in_blocks(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(df, bench).collect()}
    passes = []
    count = decontamination._counts
    monkeypatch.setattr(decontamination, "_counts", lambda docs, *more: passes.append(docs) or count(docs, *more))
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(decontamination, "STRIP", 200)
    monkeypatch.setattr(decontamination, "COMPARED", 500)
    assert whole and {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(df, bench).collect()} == whole
    blocks = len(passes)
    kept = {r["doc_id"] for r in decontamination.keep_clean(df, bench).collect()}
    assert kept == {r["doc_id"] for r in df.collect()} - {i for i, _ in whole}
    assert blocks > 2 and len(passes) == 2 * blocks and all(x is df for x in passes)  # each block counts over the table itself


def test_words_beside_other_scripts(spark):
    """Quotes, ellipses and ideographs beside words don't hide a copy; repeated rows and items give rows of their own."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    bench = spark.createDataFrame([(1, " ".join(words)), (1, " ".join(words)), (2, "\u65e5\u672c\u8a9e\u306e\u6587\u7ae0\u3092\u5199\u3057\u305f")], "item_id long, text string")
    texts = ["\u201c" + "\u201d \u2014 \u201c".join(words) + "\u2026", "\u65e5\u672c".join(words), "\u3053\u308c\u306f\u65e5\u672c\u8a9e\u306e\u6587\u7ae0\u3092\u5199\u3057\u305f\u3082\u306e", "nothing here"]
    df = docs(spark, [*texts, texts[0]]).withColumn("item_id", F.lit("clash")).withColumn("score", F.lit("clash"))
    got = sorted((r["doc_id"], r["item_id"]) for r in decontamination.leaks(df, bench).collect())
    assert got == [(0, 1), (0, 1), (2, 2), (4, 1), (4, 1)]
    assert [r["doc_id"] for r in decontamination.keep_clean(df, bench).collect()] == [1, 3]


# 8


def test_quality(spark):
    larger = "/root/testdata/sf0.01"  # the smallest tables hold a few dozen labels only
    out = queries.op8_quality_classifier(spark, larger)
    labels = spark.read.parquet(f"{larger}/labels.parquet")
    r = out.join(labels, "doc_id").where("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert r > 0.9
    known = spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    rows = quality.score(odd(spark), known, None, "source", "lang").collect()
    assert len(rows) == len(ODD) + 3 and all(0 <= x["score"] <= 1 for x in rows)
    assert quality.score(odd(spark).limit(0), known, None, "source", "lang").count() == 0


def test_quality_by_brute_force(spark):
    """Every posterior and score in plain Python."""
    rng = random.Random(12)
    rows = [(i, "some words", None, f"h{rng.randrange(4)}" if i % 9 else None, None) for i in range(120)]
    df = spark.createDataFrame(rows, DOCS).withColumn("lang", F.concat(F.lit("p"), (F.col("doc_id") % 3).cast("string")))
    known = {i: int(rng.random() < (0.9 if rows[i][3] == "h1" else 0.3)) for i in range(120) if zlib.crc32(str(i).encode()) % 4 != 2 and i % 2}
    got = {r["doc_id"]: r for r in quality.score(df, spark.createDataFrame(list(known.items()), "doc_id long, quality int"), None, "source", "lang").collect()}
    outcome = {i: float(known.get(i, 0.5)) for i in range(120)}
    site = {i: (rows[i][3], f"p{i % 3}") for i in range(120)}

    def groups(key):
        out = {}
        for i, y in outcome.items():
            n, s = out.get(key(i), (0, 0.0))
            out[key(i)] = (n + 1, s + y)
        return out

    def strength(found, mean_of):
        used = [(n, s, mean_of(k)) for k, (n, s) in found.items() if n > 1]
        spread, sampling, most = (sum(f(*x) for x in used) for f in (lambda n, s, m: n * (s / n - m) ** 2, lambda n, s, m: m * (1 - m), lambda n, s, m: n * m * (1 - m)))
        return min(max(1 / max(1e-9, (spread - sampling) / most) - 1, quality.STRENGTH[0]), quality.STRENGTH[1])

    odds = lambda p: np.log(np.clip(p, 1e-4, 1 - 1e-4) / (1 - np.clip(p, 1e-4, 1 - 1e-4)))
    hosts, paths = groups(lambda i: site[i][0]), groups(lambda i: site[i])
    mean = sum(outcome.values()) / 120
    a = strength(hosts, lambda h: mean)
    b = strength(paths, lambda k: (hosts[k[0]][1] + mean * a) / (hosts[k[0]][0] + a))
    for i in range(120):
        (n, s), (hn, hs) = paths[site[i]], hosts[site[i][0]]
        want = (s - outcome[i] + (hs - outcome[i] + mean * a) / (hn - 1 + a) * b) / (n - 1 + b)
        assert got[i]["evidence"] == 0.5 and got[i]["site"] == pytest.approx(want)
        assert got[i]["score"] == pytest.approx(1 / (1 + np.exp(-(odds(want) - odds(mean)))))


def test_sparse_sites_shrink(spark, monkeypatch):
    rows = [(i, "some plain words", None, f"h{i % 2}", None) for i in range(400)] + [(1000, "some plain words", None, "tiny", None), (1001, "some plain words", None, "tiny", None)]
    df = spark.createDataFrame(rows, DOCS)
    known = spark.createDataFrame([(i, int(i % 2)) for i in range(400)] + [(1000, 0), (1001, 0)], "doc_id long, quality int")
    got = {r["doc_id"]: r["site"] for r in quality.score(df, known, None, "source", "lang").collect()}
    assert got[0] < 0.3 < got[1] and got[0] < got[1000] < got[1]
    monkeypatch.setattr(quality, "BROADCAST_ROWS", 0)
    salted = {r["doc_id"]: r["site"] for r in quality.score(df, known, None, "source", "lang").collect()}
    assert all(salted[k] == pytest.approx(v) for k, v in got.items())


# 9

ENC = byte_bpe.encoding(public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN)


def brute_ids(text):
    import regex

    out = []
    for m in regex.finditer(public_tokenizers.PATTERN, text):
        out += ENC._encode_single_piece(m[0])
    return out


@given(st.lists(st.sampled_from(["a", "Zé", " ", "  ", "\n", "　", "\x85", "'s", "12", "!?", "日本", "\U0001f600", " " * 40, "\t" * 33, "words and more words "]), max_size=25), st.sampled_from([3, 17, 60]))
@settings(max_examples=200, deadline=None)
def test_safe_boundaries(parts, chunk):
    text = "".join(parts)
    ids = []
    for part, whole in byte_bpe.pieces(text, chunk):
        ids += ENC._encode_single_piece(part) if whole else ENC.encode_ordinary(part)
    assert ids == brute_ids(text) == ENC.encode_ordinary(text) and ENC.decode_bytes(ids) == text.encode()


def test_long_white_space(spark):
    for text in (" \n" * 400_000, "a" + " " * 50_000 + "b", "x " * 30_000, "　" * 5000 + "y", "\n" * 9000):
        ids = byte_bpe.encode_text(ENC, text)
        assert ENC.decode_bytes(ids) == text.encode()
        if len(text) < 60_000:
            assert ids == brute_ids(text)
    rows = byte_bpe.round_trip(odd(spark), public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN).collect()
    assert len(rows) == len(ODD) + 3
    for r in rows:
        if r["doc_id"] not in (None, 1):
            assert r["decoded_sha256"] == hashlib.sha256((ODD[r["doc_id"]] or "").encode()).hexdigest()
    enc = byte_bpe.encode(docs(spark, ODD), public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN)
    back = {r["doc_id"]: bytes(r["bytes"]) for r in byte_bpe.decode(enc, public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(ODD)}


# 10


def brute_components(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^ \t-\r]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("size,percent,seed,blocks", [(3, 90, 1, False), (2, 60, 2, True), (5, 80, 3, True), (1, 50, 4, False)])
def test_jaccard_join(spark, monkeypatch, size, percent, seed, blocks):
    if blocks:
        monkeypatch.setattr(jaccard_join, "LIST_BLOCK", 3)
        monkeypatch.setattr(jaccard_join, "CLUSTER_BLOCK", 3)
    rng = random.Random(seed)
    texts = []
    for _ in range(25):
        base = [f"v{rng.randrange(30)}" for _ in range(rng.choice([1, 3, 8, 12, 25, 60, 120]))]
        for _ in range(rng.choice([1, 1, 2, 12])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                words[rng.randrange(len(words))] = f"v{rng.randrange(30)}"
            texts.append(" ".join(words).replace("v1", "V1"))
    texts += ["", "  ", None]
    df = docs(spark, texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(df, size, percent).collect()}
    want = brute_components(list(enumerate(texts)), size, percent)
    assert got == want
    stay = {r["doc_id"] for r in jaccard_join.one_of_each(df, size, percent).collect()}
    assert stay == {i for i, (_, c) in want.items() if i == c}


def test_jaccard_join_odd_rows(spark):
    rows = jaccard_join.join(odd(spark)).collect()
    assert len(rows) == len(ODD) + 3
    by = {r["doc_id"]: r for r in rows}
    assert by[6]["component_id"] == by[13]["component_id"] == 6 and by[None]["component_id"] is None and by[0]["component_id"] == 0
    assert jaccard_join.join(odd(spark).limit(0)).count() == 0
    assert jaccard_join.one_of_each(odd(spark)).columns == odd(spark).columns


def test_group_of_near_copies_costs_what_it_holds(spark, monkeypatch):
    """Near copies in many blocks: after their own blocks only representatives and strangers are dealt again."""
    monkeypatch.setattr(jaccard_join, "LIST_BLOCK", 10)
    monkeypatch.setattr(jaccard_join, "CLUSTER_BLOCK", 10)
    dealt = []
    inner = jaccard_join.written

    def spy(df, name):
        out = inner(df, name)
        if "block" in df.columns:
            dealt.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "written", spy)
    base = [f"w{k}" for k in range(130)]
    texts = [" ".join([*base[:k], "other", *base[k + 1 :]]) for k in range(120)] + [" ".join(base[:60] + [f"x{j}" for j in range(70)]) for _ in range(2)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.join(docs(spark, texts)).collect()}
    assert got == {i: c for i, (_, c) in brute_components(list(enumerate(texts)), 3, 90).items()}
    lists = 131  # each of the rounds after the first deals at most a few rows a block and list
    assert dealt and max(dealt) <= lists * 12 * 4, dealt


def test_components(spark):
    rng = random.Random(9)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(500, k) for k in range(501, 560)] + [(None, 3), (7, 7)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    parent = {}
    root = lambda x: x if parent.setdefault(x, x) == x else root(parent[x])
    for a, b in pairs:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert got == {x: root(x) for x in parent}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_stars_take_no_round(spark, monkeypatch):
    """Edges that are stars already are the result; one round makes stars of what a few tasks tell of one group."""
    tables = []
    inner = components.Rounds.written
    monkeypatch.setattr(components.Rounds, "written", lambda self, df: tables.append(df) or inner(self, df))
    for more, most in (([], 1), ([(k, 5) for k in range(6, 40)], 2)):
        tables.clear()
        got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame([(k, 1) for k in range(2, 30)] + [(50, 60)] + more, "a long, b long")).collect()}
        assert got == {k: 1 for k in range(1, 40 if more else 30)} | {50: 50, 60: 50}
        assert len(tables) <= most, len(tables)


# pipeline


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls, long and repeated texts and clashing columns; and no documents at all."""
    import corpus_pipeline as p

    for name, rows in (("odd", odd(spark)), ("none", odd(spark).limit(0))):
        folder = str(tmp_path / name)
        rows.write.parquet(f"{folder}/documents.parquet")
        for t in ("labels", "benchmark"):
            spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
        out = p.run(spark, folder)
        assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        ids = [r["doc_id"] for r in out.collect()]
        assert (len(ids) == 0) if name == "none" else ({0, None} <= set(ids) and 13 not in ids and len(ids) <= rows.count())


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    start = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(toxicity.sample_labelled(start, spark.read.parquet(f"{SF}/labels.parquet"), "toxic"))
    inputs = [start]
    for _, stage in p.STAGES:
        inputs.append(stage(spark, inputs[-1], SF).cache())
    for df in inputs[:-1]:
        assert df.columns == start.columns
    ids = [{r["doc_id"] for r in df.select("doc_id").collect()} for df in inputs]
    bad = {r["doc_id"] for r in toxicity.score(start, model).where("predicted = 1").collect()}
    assert ids[1] == ids[0] - bad
    rows = [(r["doc_id"], r["text"]) for r in inputs[1].collect()]
    assert ids[2] == {i for i, (_, c) in brute_components(rows, 5, 80).items() if i == c}
    leaked = {r["doc_id"] for r in decontamination.leaks(inputs[2], spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert leaked and ids[3] == ids[2] - leaked
    before, after = ({r["doc_id"]: r for r in df.collect()} for df in inputs[3:5])
    for i, r in before.items():
        assert after[i]["text"] == secrets.mask(r["text"], secrets.find(r["text"])[1]) and after[i]["n_chars"] == len(after[i]["text"])
    for r in inputs[5].collect():
        assert r["ids_sha256"] == hashlib.sha256(np.array(brute_ids(after[r["doc_id"]]["text"]), "<u4").tobytes()).hexdigest()
    whole = {tuple(r) for r in p.run(spark, SF).collect()}
    assert whole == {tuple(r) for r in inputs[5].collect()}
