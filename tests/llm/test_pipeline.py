"""The corpus pipeline end to end, on odd rows and on empty tables, against its operators."""

import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from netlat.llm import near, rules

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, node string, failed long, length string"
LABELS = "doc_id long, quality int, toxic int"


def prose(k, n=90):
    return " ".join(f"word{(k * 31 + i * i) % 997} of{i % 7 + k}" for i in range(n)) + "."


def write(spark, folder, docs, labels):
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_pipeline_on_odd_rows(spark, tmp_path):
    texts = [prose(k) for k in range(30)]
    texts += [texts[3], texts[3], texts[4] + " end", None, "", "  ", "short", "a " * 5000, texts[5].upper()]
    docs = [(k, t, ["en", "de", None][k % 3], None, None, True, "n", 9, "x") for k, t in enumerate(texts)]
    docs += [docs[6], docs[6], (None, prose(50), "en", None, None, None, None, None, None), (7, prose(51), "en", None, None, None, None, None, None)]
    labels = [(k, 1, 0) for k in range(0, 30, 2)] + [(None, 1, 0), (4, 0, 0), (900, 1, 1)]
    folder = write(spark, tmp_path, docs, labels)
    made = {}
    rows = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, rows, folder)
        assert kept.columns == rows.columns
        kept.write.parquet(f"{folder}/{name}")
        rows = spark.read.parquet(f"{folder}/{name}")
        made[name] = [tuple(r) for r in rows.collect()]
        assert set(made[name]) <= set(docs)
    # What each stage keeps of the one before it.
    names = list(made)
    passed = [r for r in made[names[0]] if not rules.measure(r[1] or "")[0] < 50]
    assert set(made[names[1]]) <= set(passed) and {r[1] for r in made[names[1]]} >= {r[1] for r in passed if r[1] in texts[:30]}
    assert sorted(r[1] for r in made[names[2]]) == sorted({r[1] for r in made[names[1]]})
    for text in {r[1] for r in made[names[2]]}:
        first = min((r[0] for r in made[names[1]] if r[1] == text and r[0] is not None), default=None)
        assert [r[0] for r in made[names[2]] if r[1] == text] == [first]
    left = {near.normal(r[1]) for r in made[names[3]]}
    assert len(left) == len(made[names[3]]) and left <= {near.normal(r[1]) for r in made[names[2]]}
    # The last stage places every piece of every document that is left.
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    want = []
    for i, text, *_ in made[names[3]]:
        ids = [*library.encode(text, add_special_tokens=False).ids, corpus_pipeline.END_ID]
        for piece, at in enumerate(range(0, len(ids), corpus_pipeline.SIZE)):
            part = ids[at : at + corpus_pipeline.SIZE]
            want.append((i, piece, at, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))))
    placed = corpus_pipeline.STAGES[-1][1](spark, rows, folder).collect()
    assert sorted(map(str, (tuple(r)[:5] for r in placed))) == sorted(map(str, want)) and want
    held = {}
    for r in placed:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():
        ends = 0
        for offset, length in sorted(parts):
            assert offset == ends
            ends += length
        assert ends <= corpus_pipeline.SIZE
    whole = corpus_pipeline.run(spark, folder)
    assert sorted(map(str, (tuple(r)[:5] for r in whole.collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)]])
def test_pipeline_on_empty_tables(spark, tmp_path, labels):
    folder = write(spark, tmp_path, [], labels)
    assert corpus_pipeline.run(spark, folder).collect() == []
