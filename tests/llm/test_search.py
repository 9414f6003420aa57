"""Ranked search, hard negatives and languages against brute force on small tables."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from netlat.llm import language, lexical, negatives

# ---- 11 ranked lexical search ----------------------------------------------------

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, item long, score string, rank int, terms string, n string"
ITEMS = "item_id long, text string, term string, doc_id long"


def brute_search(docs, items, most):
    bags = [(d, Counter(WORDS.findall((t or "").translate(LOWER)))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    out = []
    for item, text in items:
        scored = []
        for d, b in bags:
            m = 100 - 25 + 25 * sum(b.values()) * n // length
            s = 0
            for w in WORDS.findall((text or "").translate(LOWER)):
                if b[w]:
                    s += math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * b[w] // (1000 * b[w] + 12 * m))
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, k, r[3], -r[0]) for k, r in enumerate(sorted(scored, key=lambda r: r[:3])[:most], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize("held", [48_000_000, 1])
def test_search_is_brute_force(spark, held, monkeypatch):
    monkeypatch.setattr(lexical, "HELD", held)
    monkeypatch.setattr(lexical, "CHUNK", 50)
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 7)
    rng = np.random.default_rng(1)
    vocabulary = ["The", "the", "of", "été", "x1", "日本", "A-b", "o_o", "zz"] + [f"w{k}" for k in range(30)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    docs = [(k, text(rng.integers(1, 60))) for k in range(300)]
    docs += [(None, text(20)), (7, None), (8, ""), (9, " \n--"), (10, docs[5][1]), (10, docs[5][1]), (5, "w1 " * 500), (-3, text(2000))]
    items = [(k, text(rng.integers(1, 25))) for k in range(18)] + [(3, "the the The w1 w1"), (90, None), (91, "!!"), (92, "unseen"), (None, "w2 w3")]
    table = spark.createDataFrame([(d, t, 1, "s", 2, "t", "n") for d, t in docs], DOCS).repartition(5)
    asked = spark.createDataFrame([(i, t, "t", 4) for i, t in items], ITEMS)
    assert found(lexical.search(table, asked, most=4)) == brute_search(docs, items, 4)


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    full_docs, full_items = spark.createDataFrame([(1, "a b", 1, "", 1, "", "")], DOCS), spark.createDataFrame([(1, "a", "", 1)], ITEMS)
    silent = spark.createDataFrame([(1, None, 1, "", 1, "", "")], DOCS)
    for d, i in ((docs, items), (docs, full_items), (full_docs, items), (silent, full_items)):
        got = lexical.search(d, i)
        assert got.collect() == [] and got.columns == ["item_id", "rank", "doc_id", "score"]


def test_shared_sets_are_made_once_and_sum_to_the_queries():
    rng = np.random.default_rng(2)
    queries = [sorted(set(rng.choice(40, rng.integers(0, 25)).tolist())) for _ in range(60)]
    nodes, parts = lexical.sharing(queries)
    n = 1 + max(s for q in queries for s in q)
    holds = [{s} for s in range(n)]
    for a, b in nodes:
        assert a < len(holds) and b < len(holds) and not holds[a] & holds[b]
        holds.append(holds[a] | holds[b])
    for q, part in zip(queries, parts, strict=True):
        assert sum(len(holds[s]) for s in part) == len(q) and set().union(*(holds[s] for s in part)) == set(q)
    # No pair is left that two queries hold.
    left = Counter((a, b) for part in parts for i, a in enumerate(part) for b in part[i + 1 :])
    assert not left or max(left.values()) == 1
    assert len(set(nodes)) == len(nodes)
    assert lexical.sharing([]) == ([], []) and lexical.sharing([[], [0]]) == ([], [[], [0]])


def test_fewer_additions_than_without_sharing():
    queries = [list(range(20)) + [100 + k] for k in range(30)]
    nodes, parts = lexical.sharing(queries)
    assert len(nodes) + sum(map(len, parts)) < sum(map(len, queries)) / 4


# ---- 12 hard negatives -----------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, row string, bits string, planes string, anchor string"


def brute_negatives(rows, is_anchor, positives=5, negatives_=5):
    kept = []
    for k, (i, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((k, i, [math.floor(256 * float(np.float32(x))) for x in v], label))
    order = lambda r: (-r[0], r[1] is None, r[1] or 0, r[2])
    out = []
    for ka, ia, a, la in kept:
        if not is_anchor(ia):
            continue
        score = [(sum(x * y for x, y in zip(a, v)), i, k, label) for k, i, v, label in kept if k != ka]
        for p in sorted((s for s in score if s[3] == la), key=order)[:positives]:
            near = [s for s in score if s[3] != la and 80 * p[0] <= 100 * s[0] <= 100 * p[0]]
            out += [(ia, p[1], r, s[1], p[0], s[0]) for r, s in enumerate(sorted(near, key=order)[:negatives_], 1)]
    return sorted(out, key=str)


def vector_rows(n, dims, seed):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(6, dims))
    rows = []
    for k in range(n):
        v = (base[k % 6] + rng.normal(size=dims) * 0.3) * 0.2
        rows.append((k, [float(np.float32(x)) for x in v], int(rng.integers(0, 4))))
    return rows


@pytest.mark.parametrize("dims", [1, 8, 13, 64])
def test_negatives_are_brute_force(spark, dims, monkeypatch):
    monkeypatch.setattr(negatives, "SLICE", 17)
    monkeypatch.setattr(negatives, "ANCHORS", 3)
    monkeypatch.setattr(negatives, "GATHERED", 40)
    rows = vector_rows(150, dims, dims)
    same = rows[20][1]
    rows += [(200 + k, same, k % 3) for k in range(40)]  # one vector very often
    rows += [(300, None, 1), (301, same, None), (302, [None] * dims, 1), (303, [math.nan] * dims, 1), (304, [math.inf] * dims, 2)]
    rows += [(None, same, 1), (0, rows[0][1], 2), (20, same, 0), (20, same, 0), (305, [], 1), (306, same[: dims // 2], 2), (307, [1000.0] * dims, 3), (310, [-1000.0] * dims, 3)]
    table = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], VECTORS).repartition(3)
    got = negatives.mine(table, F.col("vec_id") % 10 == 0)
    want = brute_negatives(rows, lambda i: i is not None and i % 10 == 0)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert want


def test_negatives_of_empty_tables(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert negatives.mine(empty, F.col("vec_id") % 10 == 0).collect() == []
    alone = spark.createDataFrame([(10, [1.0], 1, "", "", "", "")], VECTORS)
    assert negatives.mine(alone, F.col("vec_id") % 10 == 0).collect() == []
    assert negatives.mine(alone, F.lit(None).cast("boolean")).collect() == []


@pytest.mark.parametrize("most", [0, 1, 5, 300, 10**6])
def test_looked_up_sums_are_inner_products(most):
    rng = np.random.default_rng(most)
    a, c = (rng.integers(-most, most + 1, (n, 19)) for n in (11, 23))
    assert (negatives.scores(negatives.tables_of(a), negatives.planes_of(c)) == c @ a.T).all()


# ---- 13 languages ----------------------------------------------------------------


def spectrum(text, n=language.N):
    t = language.letters(text)
    return {t[i : i + k] for k in range(1, n + 1) for i in range(len(t) - k + 1)}


def test_kernels_are_those_of_sets(monkeypatch):
    monkeypatch.setattr(language, "CHARS", 40)
    monkeypatch.setattr(language, "ROWS", 3)
    landmarks = ["The cat sat, on the mat.", "Der Hund lief 12 Mal", "été 日本語 \U0001d4d0\U0001d4d1", "a"]
    texts = ["the dog", "", "x" * 500 + " the mat " * 90, "Die Katze. Der Hund!", "\U0001d4d0 日", "12 !!", "a_b", "THE"]
    model = language.Model([language.letters(t) for t in landmarks])
    got = model.kernels([language.letters(t) for t in texts])
    known = set().union(*(spectrum(t) for t in landmarks))
    for r, t in enumerate(texts):
        held = spectrum(t) & known
        for c, landmark in enumerate(landmarks):
            own = spectrum(landmark)
            assert got[r, c] == pytest.approx(len(held & own) / math.sqrt(max(1, len(held)) * len(own)), abs=1e-6)


def test_fit_solves_the_regression(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(80)
    model = language.train(docs, F.lit(True), landmarks=24)
    texts = language.sample(docs, F.lit(True)).collect()
    k = model.kernels([language.letters(r["text"]) for r in texts]).astype(float)
    counts = Counter(r["lang"] for r in texts)
    w = np.array([len(texts) / (len(counts) * counts[r["lang"]]) for r in texts])
    y = np.array([[1.0 if r["lang"] == c else -1.0 for c in model.languages] for r in texts])
    between = model.scaled.astype(float).T @ model.scaled
    gap = (k * w[:, None]).T @ (k @ model.coefficients - y) + language.RIDGE * len(texts) * between @ model.coefficients
    assert np.abs(gap).max() < 1e-3


def test_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    judged = language.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(judged) > 150
    assert sum(r["lang"] == r["lang_pred"] for r in judged) / len(judged) > 0.97
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in judged)


def test_languages_of_odd_rows(spark):
    schema = "doc_id long, text string, lang string, score string, held_out string, lang_pred int, _text string"
    rows = [(k, f"the cat and the dog number {k} ran" if k % 2 else f"der hund und die katze nummer {k} lief", "en" if k % 2 else "de") for k in range(60)]
    odd = [(100, None, "en"), (101, "", "en"), (102, "12 !! 3", "de"), (103, "the dog", None), (None, "die katze", "xx"), (104, "日本", None), (105, "²Ⅷ", "de"), (1, rows[1][1], "en"), (106, "the cat " * 9000, None)]
    table = spark.createDataFrame([(*r, "s", "h", 1, "t") for r in rows + odd], schema).repartition(4)
    got = {}
    for r in language.languages(table).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == len(rows) + len(odd)
    for i in (100, 101, 102, 105):
        assert (got[i][0]["lang_pred"], got[i][0]["score"]) == ("und", 0.0)
    assert got[103][0]["lang_pred"] == got[106][0]["lang_pred"] == "en" and got[None][0]["lang_pred"] == "de"
    assert got[104][0]["lang_pred"] in ("en", "de") and got[None][0]["held_out"]
    assert len(got[1]) == 2 and all(0 <= r["score"] <= 1 for rs in got.values() for r in rs)
    nothing = language.languages(table.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}
    assert language.languages(table.limit(0)).collect() == []
