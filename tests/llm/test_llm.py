"""Operators for training data, held against the library, brute force and round trips
on small tables with nulls, empty and long texts, ties, repeated rows and columns whose
names the operators use themselves."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from netlat.llm import bpe, exact, frames, licenses, near, packing, pieces, quality_lm, rules, token_cache, urls
from netlat.session import scratch_path

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, id long, node long, kept boolean, "
    "n_words string, length string, block string, failed string, text_sha256 string, digest string, edge string"
)
LONG = " ".join(f"word{i % 977} thing{i % 31}," for i in range(9000))
ODD = [
    None, "", " ", "\n\n", "a", "one two three four", "Same text.", "Same text.", "Same text.", "same TEXT", LONG, LONG + " end",
    "x  y\tz \n w ", "<|endoftext|> and <|startoftext|>", "don't we'll \u0301e \u00e9 \u65e5\u672c\u8a9e \U0001f600", "Licensed under CC BY-NC 4.0.\nAll rights reserved.",
    "cc by " * 40, "same line\n" * 60, "UPPER CASE!! " * 60, "a" * 20000, "0 1 2 3 4 5 6 7 8 9 " * 30, "a\x1cb\u00a0c\u2003d \x02e\x03",
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k if k != 3 else None, t, ["en", None, "de"][k % 3], None, None, 7, 7, True, "9", "9", "b", "1", "x", "d", "e") for k, t in enumerate(ODD)]
    rows.append(rows[6])  # a repeated row
    rows.append((6, "other text under the same identifier", *rows[6][2:]))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


def ids_of(tokenizer, text):
    return tokenizer.encode(text, add_special_tokens=False).ids


def packed(ids):
    return np.asarray(ids, "<u4").tobytes()


# ---- pieces ----------------------------------------------------------------------


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_pieces_are_the_library_s_ids(path, sf, spark):
    library, coder = Tokenizer.from_file(path), pieces.Encoder(path, kept=50)
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + ODD
    rng = np.random.default_rng(3)
    signs = list("abcdEnt hi s.,'  \n\t-0\u00e9\u0301\u65e5\u0130\u03a3<|>")
    texts += ["".join(rng.choice(signs, rng.integers(0, 40))) for _ in range(500)]
    for t in texts:
        assert coder.one(t or "") == packed(ids_of(library, t or "")), repr(t)


@pytest.mark.parametrize("make", [pieces.Encoder, bpe.BacktrackEncoder])
def test_words_that_end_with_signs(make):
    library, coder = Tokenizer.from_file(BYTES), make(BYTES)
    rng = np.random.default_rng(8)
    signs = list("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'")
    for _ in range(3000):
        parts = [str(rng.choice(["the", "été", "Haus", "x", "<|endoftext|>", "we", ""])) + "".join(rng.choice(signs, rng.integers(0, 5))) for _ in range(rng.integers(1, 6))]
        t = str(rng.choice([" ", "\n", "  "])).join(parts)
        assert coder.one(t) == packed(ids_of(library, t)), repr(t)


def test_old_pieces_are_dropped_and_frequent_ones_stay():
    coder = pieces.Encoder(WORDS, kept=100_000)
    for k in range(3000):
        coder.one(f"often rare{'abcdefghij'[k % 10]}{chr(97 + k // 26 % 26)}{chr(97 + k % 26)}x")
    assert len(coder.table) + len(coder.older) <= 100_000 // pieces.SPENT
    assert "often" in coder.table or "often" in coder.older


# ---- 1 quality classifier --------------------------------------------------------


def brute_kneser_ney(counts, n):
    """p of each n-gram by the published formulas, on dictionaries."""
    tables = {n: Counter(counts)}
    for k in range(n - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    discount, context = {}, defaultdict(lambda: [0, 0.0])
    for k, t in tables.items():
        n1, n2, n3, n4 = (sum(1 for c in t.values() if c == v) for v in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
        up = {1: n2, 2: n3, 3: n4}
        at = {1: n1, 2: n2, 3: n3}
        discount[k] = {v: max(0.0, min(v - 0.05, v - (v + 1) * y * up[v] / at[v] if at[v] else v / 2)) for v in (1, 2, 3)}
        for g, c in t.items():
            context[k, g[:-1]][0] += c
            context[k, g[:-1]][1] += discount[k][min(c, 3)]

    def p(g):
        if not g:
            return 1 / (len(tables[1]) + 1)
        total, left = context.get((len(g), g[:-1]), (0, 0))
        if not total:
            return p(g[1:])
        c = tables[len(g)].get(g, 0)
        return (c - (discount[len(g)][min(c, 3)] if c else 0)) / total + left / total * p(g[1:])

    return p


def test_perplexity_is_that_of_the_formulas(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in quality_lm.classify(docs, labels).collect()}
    trusted = {r["id"] for r in quality_lm.trusted_ids(labels).collect()}
    held = {r["id"] for r in quality_lm.trusted_ids(labels).where(quality_lm.held_out()).collect()}
    n = quality_lm.N
    grams = lambda t: [("\x02" * (n - 1) + t + "\x03")[k : k + n] for k in range(len(t) + 1)]
    rows = docs.collect()
    assert len(got) == len(rows)
    for lang in ("en", "fr"):
        counts = Counter(g for r in rows if r["lang"] == lang and r["doc_id"] in trusted - held for g in grams(r["text"]))
        p = brute_kneser_ney(counts, n)
        own = [r for r in rows if r["lang"] == lang]
        for r in own[:40]:
            want = math.exp(-sum(math.log(p(g)) for g in grams(r["text"])) / (len(r["text"]) + 1))
            assert got[r["doc_id"]]["perplexity"] == pytest.approx(want, rel=1e-9)
        # Probabilities of what may follow a context add up to no more than one.
        seen = {g[-1] for g in counts}
        assert 0.9 < sum(p(next(iter(counts))[:-1] + c) for c in seen) <= 1 + 1e-9


def test_classifier_keeps_clean_and_rejects_junk(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    judged = quality_lm.classify(docs, labels).join(labels, "doc_id").join(docs.select("doc_id", "text", "n_chars"), "doc_id").collect()
    clean = [r for r in judged if r["quality"] == 1 and r["toxic"] == 0 and r["n_chars"] > 100]
    junk = [r for r in judged if r["quality"] == 0 and ("%%%" in r["text"] or "!! " in r["text"])]
    assert sum(r["kept"] for r in clean) >= 0.98 * len(clean)
    assert junk and sum(r["kept"] for r in junk) <= 0.05 * len(junk)


def test_classifier_rejects_all_kinds_of_bad_quality(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = F.col("doc_id").isin([r["id"] for r in quality_lm.trusted_ids(labels).where(quality_lm.held_out()).collect()])
    judged = quality_lm.classify(docs, labels).join(labels, "doc_id").withColumn("held", held).collect()
    bad = [r for r in judged if r["quality"] == 0]
    trusted = [r for r in judged if r["held"]]
    assert len(bad) > 50 and sum(r["kept"] for r in bad) <= 0.03 * len(bad)
    assert len(trusted) > 50 and sum(not r["kept"] for r in trusted) <= 0.05 * len(trusted)


def test_classifier_on_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1, 0), (5, 1, None), (6, 1, 0), (6, 0, 0), (7, None, None), (None, 1, 0), (10, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality_lm.classify(odd, labels).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in rows) == sorted((i is None, i) for i, _ in pairs(odd))
    assert {r["lang"] for r in rows} == {"en", "", "de"}
    for r in rows:
        assert (r["perplexity"] is None) == (r["threshold"] is None) and (r["kept"] or r["perplexity"] > r["threshold"])
    none = quality_lm.classify(odd, labels.limit(0)).collect()
    assert len(none) == len(rows) and all(r["kept"] and r["perplexity"] is None for r in none)
    assert quality_lm.classify(empty, labels).count() == 0
    assert quality_lm.keep(odd, labels.limit(0)).columns == odd.columns
    assert sorted(map(str, quality_lm.keep(odd, labels.limit(0)).collect())) == sorted(map(str, odd.collect()))


# ---- 2 token files ---------------------------------------------------------------


def test_token_files_round_trip(spark, odd, empty, tmp_path):
    library, folder = Tokenizer.from_file(BYTES), str(tmp_path / "f")
    manifest = frames.write_token_files(odd, folder, BYTES, end_id=2)
    rows = frames.read_token_files(spark, folder, manifest).orderBy("start").collect()
    assert sorted((str(r["doc_id"]), r["ids"]) for r in rows) == sorted((str(i), packed([*ids_of(library, t), 2])) for i, t in pairs(odd))
    order = [r["doc_id"] for r in rows]
    assert order[0] is None and order[1:] == sorted(order[1:])
    assert [r["start"] for r in rows] == [0, *np.cumsum([r["n_tokens"] for r in rows])[:-1]]
    some = frames.read_token_files(spark, folder, manifest, [4, 10]).collect()
    assert {(r["doc_id"], r["start"], r["ids"]) for r in some} == {(r["doc_id"], r["start"], r["ids"]) for r in rows if r["doc_id"] in (4, 10)}
    none = frames.write_token_files(empty, str(tmp_path / "e"), BYTES, end_id=2)
    assert frames.read_token_files(spark, str(tmp_path / "e"), none).count() == 0


def test_frames_stand_alone_and_are_checked(tmp_path):
    import zstandard

    path = tmp_path / "x.zst"
    writer = frames.FrameWriter(path.open("wb"), 4, 1)
    for k in range(50):
        writer.add(k, packed(range(k)))
    writer.close()
    data = path.read_bytes()
    # Any decoder reads the frames and skips what stands behind them.
    whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert whole == b"".join(packed(range(k)) for k in range(50))
    reader = frames.FrameReader(path.open("rb"), len(data))
    assert reader.frame(33) == packed(range(33)) and reader.counts().tolist() == list(range(50))
    reader.table = reader.table.copy()
    reader.table[33, 2] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        reader.frame(33)


# ---- 3 packing -------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_length_and_few_sequences(seed):
    rng = np.random.default_rng(seed)
    size = 256
    lengths = np.clip(rng.lognormal(3.5 + seed / 4, 1, 3000).astype(int), 1, size)
    counts = np.bincount(lengths, minlength=size + 1) * (1 + 40 * (seed % 2))
    made = packing.plan(counts, size)
    used = np.zeros(size + 1, int)
    for held, n in made:
        assert sum(held) <= size and n > 0
        for x in held:
            used[x] += n
    assert (used == counts).all()
    best = sum(n for _, n in packing.best_fit(counts, size))
    least = -(-(counts * np.arange(size + 1)).sum() // size)
    assert least <= sum(n for _, n in made) <= max(best, math.ceil(1.01 * least))


@pytest.mark.parametrize("peaks", [((2100, 2601), (1300, 1901)), ((1100, 1701),), ((2040, 2056),), ((1, 4097),)])
def test_plan_is_never_above_best_fit(peaks):
    rng = np.random.default_rng(5)
    counts = np.bincount(np.concatenate([rng.integers(*p, 4000) for p in peaks]), minlength=4097)
    made = packing.plan(counts, 4096)
    assert (sum(n * np.bincount(held, minlength=4097) for held, n in made) == counts).all()
    assert sum(n for _, n in made) <= sum(n for _, n in packing.best_fit(counts, 4096))


def test_patterns_carry_most_of_a_large_histogram():
    counts = np.bincount(np.clip(np.random.default_rng(1).lognormal(4, 1, 200_000).astype(int), 1, 255), minlength=257)
    made = packing.plan(counts, 256)
    rest = counts - sum(n * np.bincount(held, minlength=257) for held, n in made[: len(made) // 2])
    assert rest.sum() < 0.5 * counts.sum()


def test_packing_places_every_piece(spark, odd, empty):
    library = Tokenizer.from_file(WORDS)
    made, placed = packing.pack(odd, WORDS, end_id=1, size=64)
    rows = placed.collect()
    want = Counter()
    for i, t in pairs(odd):
        ids = [*ids_of(library, t), 1]
        for k in range(0, len(ids), 64):
            want[i, k // 64, k, len(ids[k : k + 64]), zlib.crc32(packed(ids[k : k + 64]))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by) <= math.ceil(1.05 * sum(r["length"] for r in rows) / 64)
    joined = {r["sequence_id"]: len(r["ids"]) // 4 for r in packing.sequences(made, placed).collect()}
    assert joined == {s: sum(n for _, n in held) for s, held in by.items()}
    assert packing.pack(empty, WORDS, end_id=1, size=64)[1].count() == 0


# ---- 4 licences ------------------------------------------------------------------


def brute_blocks(text, templates, threshold, span):
    found, begin = [], 0
    lower = lambda line: bytes(line, "utf-8").translate(licenses.LOWER_WORDS).split()
    for line in text.split("\n"):
        words = lower(line)
        for at in licenses.spans(len(words), span):
            block = words[at : at + span]
            for k, (t, _) in enumerate(templates):
                tokens = set(t.encode().split())
                share = len(tokens & set(block)) / len(tokens)
                if share >= threshold - 1e-9:
                    found.append((k, begin + at, len(block), share))
        begin += len(words)
    return found


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.85, 1.0])
def test_license_join_finds_every_block(spark, odd, sf, threshold):
    docs = odd.select("doc_id", "text").unionByName(spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text"))
    got = licenses.scan(docs, threshold=threshold).collect()
    texts = defaultdict(list)
    for i, t in pairs(docs):
        texts[i].append(sorted(brute_blocks(t, licenses.TEMPLATES, threshold, licenses.SPAN)))
    for r in got:
        assert sorted((b["template"], b["start"], b["length"], b["containment"]) for b in r["blocks"]) in texts[r["doc_id"]]


def test_license_spans_hold_any_short_run():
    for n in range(200):
        at = licenses.spans(n, 40)
        assert all(any(a <= s and s + 20 <= a + 40 for a in at) for s in range(max(n - 20, 0)))


def test_license_labels_on_odd_rows(spark, odd, empty):
    rows = {(r["doc_id"], r["n_words"]): r for r in licenses.labels(licenses.scan(odd)).collect()}
    r = next(r for (i, _), r in rows.items() if i == 15)
    assert (r["base_labels"], r["labels"], r["n_base"], r["first_word"], r["last_word"], r["score"]) == ("cc-by,reserved", "cc-by,cc-by-nc,reserved", 2, 2, 7, 1.0)
    assert next(r for (i, _), r in rows.items() if i == 16)["n_base"] == 40
    assert next(r for (i, _), r in rows.items() if i == 0)["labels"] == ""
    assert licenses.scan(empty).count() == 0


WRAPPED = {
    "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that",
    "gpl": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by",
    "mpl-2.0": "# This Source Code Form is subject to the terms of the Mozilla Public\n# License, v. 2.0. If a copy of the MPL",
}


def test_license_notices_wrapped_over_lines(spark):
    rows, prose = [], " ".join(f"word{k}" for k in range(30))
    for label, notice in WRAPPED.items():
        for before in range(45):
            rows.append((len(rows), label, " ".join(f"w{k}" for k in range(before)) + "\n" + notice + "\n" + prose))
        rows.append((len(rows), label, notice.replace("\n", "\r\n")))
        # The two halves of a notice far apart are none.
        rows.append((len(rows), "", notice.replace("\n", f"\n{prose} {prose}\n")))
    docs = spark.createDataFrame(rows, "doc_id long, want string, text string")
    got = {r["doc_id"]: r for r in licenses.labels(licenses.scan(docs)).collect()}
    for i, label, text in rows:
        found = set(got[i]["labels"].split(",")) - {""}
        if label:
            assert label in found and got[i]["score"] >= licenses.THRESHOLD, (label, text)
        else:
            assert found <= set(got[i]["base_labels"].split(",")) and got[i]["score"] == 0.0, text


def test_license_words_apart_on_several_lines_are_no_notice(spark):
    text = "Licensed under CC BY-NC 4.0.\nTo one of nd and two and three."
    rows = licenses.labels(licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"))).collect()
    assert rows[0]["labels"] == "cc-by,cc-by-nc"


def brute_stretches(text, threshold):
    lines = [x.translate(licenses.LOWER_WORDS).split() for x in text.encode().split(b"\n")]
    words, found = sum(lines, []), set()
    if sum(map(bool, lines)) < 2:
        return []
    for begin in licenses.spans(len(words), 2 * licenses.SPAN):
        end = min(begin + 2 * licenses.SPAN, len(words))
        for k, (t, _) in enumerate(licenses.TEMPLATES):
            tokens, room = set(t.encode().split()), int(licenses.ROOM * len(t.split()))
            share = lambda at: len(tokens & set(words[at : min(at + room, end)])) / len(tokens)
            best = max((at for at in range(begin, end) if words[at] in tokens), key=share, default=None)
            if best is not None and share(best) >= threshold - 1e-9:
                found.add((k, best, min(room, end - best), share(best)))
    return sorted(found)


def test_license_stretches_are_brute_force_s(spark, odd, sf):
    docs = odd.select("doc_id", "text").unionByName(spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text"))
    texts = defaultdict(list)
    for i, t in pairs(docs):
        texts[i].append(brute_stretches(t, 0.6))
    got = licenses.scan(docs, threshold=0.6).collect()
    assert any(r["wrapped"] for r in got)
    for r in got:
        assert [(b["template"], b["start"], b["length"], b["containment"]) for b in r["wrapped"]] in texts[r["doc_id"]]


# ---- 5 rules ---------------------------------------------------------------------


def test_measurements(spark, odd):
    def brute(text):
        words = text.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")
        words = [w for w in words if w]
        windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        covered = {k + o for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for o in range(3)}
        lines, dup = set(), 0
        for line in text.split("\n"):
            if line.strip(" \t\r\x0b\x0c"):
                dup += line in lines
                lines.add(line)
        return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)

    for t in ODD:
        assert rules.measure(t or "")[:5] == brute(t or ""), repr(t)


def test_policies_and_ablations(odd, empty):
    entries = rules.ledger(odd).cache()
    kept = {v: {r["doc_id"] for r in rules.apply_policy(entries, v).where("kept").collect()} for v in rules.POLICIES}
    assert kept[2] <= kept[1]
    bits = [r["failed"] for r in entries.collect()]
    order = [n for n, _ in rules.RULES]
    for r in rules.ablations(entries).collect():
        bit = 1 << order.index(r["rule"])
        m = rules.mask(rules.POLICIES[rules.CURRENT])
        assert r["rejected"] == sum(bool(b & bit) for b in bits)
        assert r["alone"] == sum((b & m) == bit for b in bits)
    stay = rules.keep(odd)
    assert stay.columns == odd.columns and {r["doc_id"] for r in stay.collect()} == kept[rules.CURRENT]
    assert rules.ledger(empty).count() == 0 and rules.keep(empty).count() == 0


# ---- 6 token counts --------------------------------------------------------------


def test_counts_come_from_the_store_the_second_time(spark, odd, empty):
    library, store = Tokenizer.from_file(BYTES), scratch_path(spark, "counts-test")
    want = sorted((str(i), len(t.encode()), len(ids_of(library, t))) for i, t in pairs(odd))
    show = lambda df: sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in df.collect())
    assert show(token_cache.count_tokens(odd.where("doc_id < 8"), store, BYTES)) == [w for w in want if w[0] != "None" and int(w[0]) < 8]
    first = spark.read.parquet(store).count()
    assert show(token_cache.count_tokens(odd, store, BYTES)) == want
    different = len({t for _, t in pairs(odd)})
    assert spark.read.parquet(store).count() == different > first
    # What is stored is used, not counted again.
    spark.read.parquet(store).withColumn("n_tokens", F.lit(77).cast("long")).write.parquet(f"{store}-77")
    assert {n for _, _, n in show(token_cache.count_tokens(odd, f"{store}-77", BYTES))} == {77}
    # Another tokenizer has its own counts.
    assert show(token_cache.count_tokens(odd, store, WORDS)) != want
    assert token_cache.count_tokens(empty, store, BYTES).count() == 0


# ---- 7 near duplicates -----------------------------------------------------------


def brute_classes(texts, similar=0.8):
    normal = [near.normal(t or "") for t in texts]
    sets = [Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter() for w in (t.split() for t in normal)]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if normal[a] == normal[b]:
                root[find(a)] = find(b)
            elif sets[a] and sets[b]:
                keys = set(sets[a]) | set(sets[b])
                plain = len(set(sets[a]) & set(sets[b])) / len(keys)
                x, y = ({k: 1 + math.log(s[k]) if k in s else 0 for k in keys} for s in (sets[a], sets[b]))
                weighted = sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in keys) for i in keys if x[i] and y[i]) if plain > 0.5 and len(keys) < 400 else plain
                if max(plain, weighted) >= similar:
                    root[find(a)] = find(b)
    return [find(k) for k in range(len(texts))]


def same_partition(a, b):
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


def test_near_classes_are_brute_force_s(spark):
    rng = np.random.default_rng(11)
    words = [f"w{k}" for k in range(3000)]
    texts = []
    for _ in range(25):
        base = list(rng.choice(words, rng.integers(3, 120)))
        texts.append(" ".join(base))
        for _ in range(rng.integers(0, 8)):
            other = list(base)
            for _ in range(rng.integers(0, 4)):
                other[rng.integers(0, len(other))] = rng.choice(words)
            texts.append(" ".join(other))
    # A chain: each is near the next, the ends are far apart.
    chain = list(rng.choice(words, 100))
    for k in range(12):
        texts.append(" ".join(chain))
        chain[8 * k % 100] = f"new{k}"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows = sorted(near.classes(docs).collect())
    assert same_partition([r["class_id"] for r in rows], brute_classes(texts))
    sizes = Counter(r["class_id"] for r in rows)
    assert all(r["class_size"] == sizes[r["class_id"]] and r["kept"] == (r["doc_id"] == r["class_id"]) for r in rows)


def test_near_plain_links_of_texts_with_repeated_passages(spark):
    rng = np.random.default_rng(23)
    words = [f"w{k}" for k in range(9000)]
    texts = []
    for n, passage, times in [(200, 40, 20), (300, 60, 50), (150, 30, 30), (250, 50, 40)] * 5:
        base = list(rng.choice(words, n))
        texts += [" ".join(base), " ".join(base[:passage] * times + base[passage:])]
        # Without the passage in common, repeated or not, texts are apart.
        texts.append(" ".join(base[:passage] * times + list(rng.choice(words, n - passage))))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows = sorted(near.classes(docs).collect())
    assert [r["class_id"] for r in rows] == [k for t in range(0, len(texts), 3) for k in (t, t, t + 2)]
    assert same_partition([r["class_id"] for r in rows], brute_classes(texts))


def test_near_one_large_group_and_common_passages(spark):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(5000)]
    passage, base = list(rng.choice(words, 60)), list(rng.choice(words, 200))
    texts = []
    for k in range(600):
        copy = list(base)
        copy[rng.integers(0, 200)] = f"edit{k}"
        texts.append(" ".join(copy))
    texts += [" ".join([*rng.choice(words, 80), *passage, *rng.choice(words, 80)]) for _ in range(300)]
    rows = sorted(near.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert {r["class_id"] for r in rows[:600]} == {0} and all(r["class_size"] == 1 for r in rows[600:])


def test_sketch_estimates_probability_jaccard():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 300).astype(np.uint64)
    b = np.append(a[:200], rng.integers(0, 2**63, 90).astype(np.uint64))
    ta, tb = rng.integers(1, 9, 300), rng.integers(1, 9, 290)
    of = lambda h, t: (np.sort(h), (1 + np.log(t))[np.argsort(h)])
    true, plain = near.probability_jaccard(of(a, ta), of(b, tb))
    assert plain == pytest.approx(200 / 390)
    x, y = dict(zip(*of(a, ta), strict=True)), dict(zip(*of(b, tb), strict=True))
    keys = x.keys() | y.keys()
    brute = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in keys) for i in x.keys() & y.keys())
    assert true == pytest.approx(brute)
    r = near.sketches(np.append(a, b), np.append(ta, tb), np.repeat([0, 1], [300, 290]), 2, m=4096)
    assert (r[0] == r[1]).mean() == pytest.approx(true, abs=0.035)


def test_components(spark):
    rng = np.random.default_rng(9)
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [tuple(map(int, rng.integers(200, 400, 2))) for _ in range(120)]
    got = {r["node"]: r["root"] for r in near.components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {v: v for e in links for v in e}
    for _ in range(len(root)):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert got == root


def test_near_on_odd_rows(spark, odd, empty):
    rows = near.classes(odd).collect()
    assert len(rows) == odd.count()
    of = defaultdict(set)
    for r in rows:
        of[r["doc_id"]].add(r["class_id"])
    assert of[0] == of[1] == of[2] == of[None] == {0} and of[7] == of[8] == of[9] == {6} and of[10] == of[11]
    stay = near.dedup(odd)
    assert stay.columns == odd.columns
    kept = [r["doc_id"] for r in stay.collect()]
    # Identifier 6 names two different texts.
    assert kept.count(6) == 2 and kept.count(0) == 1 and 11 not in kept
    assert near.classes(empty).count() == 0 and near.dedup(empty).count() == 0


# ---- 8 byte pairs ----------------------------------------------------------------


def test_backtracking_is_the_library_s_encoding(spark, odd, empty, sf):
    library = Tokenizer.from_file(BYTES)
    docs = odd.select("doc_id", "text").unionByName(spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text"))
    rows = bpe.decode(bpe.encode(docs, BYTES), BYTES).collect()
    assert sorted((str(r["doc_id"]), r["ids"], r["text"]) for r in rows) == sorted((str(i), ids_of(library, t), library.decode(ids_of(library, t), skip_special_tokens=False)) for i, t in pairs(docs))
    assert bpe.encode(empty, BYTES).count() == 0


def test_backtracking_merges_any_bytes():
    library, coder, rng = Tokenizer.from_file(BYTES), bpe.BacktrackEncoder(BYTES), np.random.default_rng(4)
    for _ in range(3000):
        t = "".join(rng.choice(list("etaoinshr \n.,'-=0123\u00e9\u65e5\U0001f600"), rng.integers(0, 60)))
        assert coder.one(t) == packed(ids_of(library, t)), repr(t)
    decoder = bpe.OffsetDecoder(BYTES)
    for _ in range(50):
        ids = rng.integers(0, 50257, 40)
        assert decoder.decode(ids) == library.decode(ids.tolist(), skip_special_tokens=False)


# ---- 9 exact duplicates ----------------------------------------------------------


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_content_groups(spark, odd, empty, keep):
    rows = exact.content_groups(odd.repartition(7), keep=keep).collect()
    groups = defaultdict(list)
    for i, t in pairs(odd):
        groups[hashlib.sha256(t.encode()).hexdigest()].append(i)
    assert len(rows) == odd.count()
    for sha, ids in groups.items():
        own = [r for r in rows if r["text_sha256"] == sha]
        known = [i for i in ids if i is not None]
        want = (min(known) if keep == "smallest" else max(known)) if known else None
        assert sorted(map(str, ids)) == sorted(str(r["doc_id"]) for r in own)
        assert {(r["keep_id"], r["group_size"]) for r in own} == {(want, len(ids))} and sum(r["kept"] for r in own) == 1
    stay = exact.dedup(odd)
    assert stay.columns == odd.columns and stay.count() == len(groups)
    assert exact.content_groups(empty).count() == 0


@pytest.mark.parametrize("rows", [1, 2, 3, 50])
def test_groups_over_batches(spark, rows):
    rng = np.random.default_rng(rows)
    many = [(k, str(rng.choice(["hot", "cold", f"t{k}", None]))) for k in range(200)]
    docs = spark.createDataFrame(many, "doc_id long, text string").repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact.content_groups(docs).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for i, t in many:
        own = [k for k, u in many if u == t]
        assert got[i] == (min(own), len(own), i == min(own))


def test_group_over_many_ranges(spark):
    many = [(k, "hot text" if k % 3 else f"text {k}") for k in range(3000)]
    docs = spark.createDataFrame(many, "doc_id long, text string").repartition(8)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        rows = exact.content_groups(docs).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    hot = [r for r in rows if r["group_size"] > 1]
    assert len(rows) == 3000 and len(hot) == 2000
    assert {(r["keep_id"], r["group_size"]) for r in hot} == {(1, 2000)} and [r["doc_id"] for r in hot if r["kept"]] == [1]


# ---- 10 URLs ---------------------------------------------------------------------


def test_url_rules(spark):
    cases = {
        "http://a.com/x": ("a.com", "/x", "com/", "allow"),
        "https://Example.COM/en/1?q": ("example.com", "/en/1", "example.com/en/", "block"),
        "https://www.example.com/en/1#f": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "https://x.www.example.com/en/": ("x.www.example.com", "/en/", "www.example.com/en/", "allow"),
        "https://notexample.com/en/1": ("notexample.com", "/en/1", "com/", "allow"),
        "http://a.net/es/1": ("a.net", "/es/1", "net/es/", "block"),
        "http://a.net/fr/": ("a.net", "/fr/", "net/fr/", "block"),
        "http://a.com": ("a.com", "", None, "allow"),
        "http://a.com?x=/en/": ("a.com", "", None, "allow"),
        "a.com/x": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "x://\u00c4B.net/\u00e9\n/y": ("\u00c4b.net", "/\u00e9\n/y", None, "allow"),
    }
    pages = spark.createDataFrame([(k, u, "h", "r") for k, u in enumerate(cases)] + [(1, "http://a.com/x", "h", "r")], "page_id long, url string, host string, rule string")
    rows = urls.judge(pages).collect()
    assert len(rows) == len(cases) + 1
    for k, want in enumerate(cases.values()):
        assert {(r["host"], r["path"], r["rule"], r["verdict"]) for r in rows if r["page_id"] == k} >= {want}
    assert urls.judge(pages.limit(0)).count() == 0


def test_url_trees_on_held_out_hosts(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    labelled = urls.seed_labels(pages).cache()
    # Half of the hosts, and of the unwanted ones some that share no word with the rest.
    held = F.when(F.col("label") == 1, F.col("host").rlike("pills|bets|track")).otherwise(F.pmod(F.xxhash64("host"), F.lit(2)) == 0)
    everything = pages.select("url").withColumns(urls.parts())
    model = urls.fit(everything, labelled.where(~held), trees=10)
    rows = model.score(labelled.where(held)).select("label", "unwanted").collect()
    bad, good = ([r["unwanted"] >= 0.5 for r in rows if r["label"] == v] for v in (1, 0))
    assert len(bad) > 5 and sum(bad) >= 0.9 * len(bad) and sum(good) <= 0.02 * len(good)
