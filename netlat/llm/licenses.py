"""Licence notices found by an exact set-similarity join.

A text block is a line, or of a long line the windows of SPAN words that begin every
half SPAN, so any run of up to half a SPAN of words stands whole in a block. A block
meets a template when it holds at least THRESHOLD of the template's different words.
Words are ordered by how many documents of the whole table have them, the rarest
first: a block that meets a template shares one of its first words in that order
(prefix), has enough different words (length), and from that word on has enough
words left (position). What passes is counted in full. Templates are a short
list given as a parameter; only their words' counts come to the driver.

Notices are wrapped over lines, so texts of several lines are searched as a whole too,
in windows twice as large. There a template's words must stand close together, in a
stretch of ROOM times its length: without the line's end as a limit, the three words
of "cc by nd" come together by chance.
"""

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlat.llm.common import text_of

#: Bytes to words: A-Z in lower case, other ASCII but digits and letters a space.
LOWER_WORDS = bytes(
    ord(chr(c).lower()) if c < 128 and chr(c).isalnum() else c if c > 127 else 32 for c in range(256)
)

# The phrases that give base labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices, each with its label.
TEMPLATES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it under the terms of the gnu general public license", "gpl"),
    ("subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("dedicated to the public domain under cc0", "cc0"),
    ("licensed under cc by 4 0", "cc-by"),
    ("cc by nc", "cc-by-nc"),
    ("cc by sa", "cc-by-sa"),
    ("cc by nd", "cc-by-nd"),
    ("all rights reserved", "reserved"),
)
THRESHOLD = 0.85
SPAN = 40
#: Words of a stretch for each word of the template.
ROOM = 1.5

_SCAN = (
    "id long, n_words long, base array<struct<label:string, start:long>>, "
    "blocks array<struct<template:int, label:string, start:long, length:int, containment:double>>"
)
_SCAN += ", " + _SCAN[_SCAN.index("blocks") :].replace("blocks", "wrapped")


def word_documents(docs: DataFrame, words: set[str]) -> dict[str, int]:
    """How many documents have each of a short list of words, over the whole table."""
    sought = frozenset(w.encode() for w in words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = dict.fromkeys(sought, 0)
        for batch in batches:
            for text in batch.column(0):
                for w in sought.intersection(text.as_py().encode().translate(LOWER_WORDS).split()):
                    n[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in n], pa.string()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])

    counted = docs.select(text_of().alias("text")).mapInArrow(count, "word string, n long")
    rows = counted.groupBy("word").agg(F.sum("n").alias("n")).collect()
    return dict.fromkeys(words, 0) | {r["word"]: r["n"] for r in rows}


class Matcher:
    """The templates, ordered and indexed by the words of their prefixes."""

    def __init__(self, templates: tuple, counts: dict[str, int], threshold: float):
        self.labels = [label for _, label in templates]
        self.rooms = [int(ROOM * len(text.split())) for text, _ in templates]
        self.sets = [frozenset(text.encode().split()) for text, _ in templates]
        self.need = [math.ceil(round(threshold * len(s), 9)) for s in self.sets]
        order = sorted({w for s in self.sets for w in s}, key=lambda w: (counts[w.decode()], w))
        self.rank = {w: k for k, w in enumerate(order)}
        self.prefix: dict[bytes, list[tuple[int, int]]] = {}
        for t, s in enumerate(self.sets):
            for place, w in enumerate(sorted(s, key=self.rank.get)[: len(s) - self.need[t] + 1]):
                self.prefix.setdefault(w, []).append((t, place))

    def block(self, words: list[bytes]) -> list[tuple[int, float]]:
        """(template, containment) of each template that the block meets."""
        have = set(words)
        known = sorted((w for w in have if w in self.rank), key=self.rank.get)
        near, tried = [], set()
        for at, w in enumerate(known):
            for t, place in self.prefix.get(w, ()):
                if t in tried:
                    continue
                tried.add(t)
                # This is the first prefix word they share, so at most what is left
                # in either of them is shared as well.
                if len(have) >= self.need[t] and 1 + min(len(self.sets[t]) - place - 1, len(known) - at - 1) >= self.need[t]:
                    shared = len(self.sets[t] & have)
                    if shared >= self.need[t]:
                        near.append((t, shared / len(self.sets[t])))
        return sorted(near)


    def stretches(self, words: list[bytes]) -> list[tuple[int, int, int, float]]:
        """(template, place, length, containment) of the first of the stretches that
        hold most of each template, where that is enough."""
        found = []
        for t, _ in self.block(words):
            sought, room = self.sets[t], self.rooms[t]
            places = [k for k, w in enumerate(words) if w in sought]
            shared, at = max((len(sought.intersection(words[k : k + room])), -k) for k in places)
            if shared >= self.need[t]:
                found.append((t, -at, len(words[-at : room - at]), shared / len(sought)))
        return found


def spans(n: int, span: int = SPAN) -> list[int]:
    """Where the windows of a line or text of n words begin."""
    return [0] if n <= span else list(range(0, n - span // 2, span // 2))


def scan(
    docs: DataFrame,
    templates: tuple = TEMPLATES,
    phrases: dict[str, str] | None = None,
    threshold: float = THRESHOLD,
    span: int = SPAN,
    id_col: str = "doc_id",
) -> DataFrame:
    """One row a row: the identifier, n_words, base (label and first word of each
    place where a phrase stands), blocks (template, label, first word, length and
    containment of each block of a line and template that meet), wrapped (the same for
    the stretches of a text that has words on several lines).

    Places count words of the whole text from 0. A null text has no words. Templates
    of more than half a span of words are an error. Other columns are ignored.
    """
    if max(len(t.split()) for t, _ in templates) > span // 2:
        raise ValueError("a template must fit into half a span")
    phrases = [(p.encode().split(), label) for p, label in (PHRASES if phrases is None else phrases).items()]
    vocabulary = {w for t, _ in templates for w in t.split()}
    matcher = Matcher(templates, word_documents(docs, vocabulary), threshold)

    def one(text: str) -> tuple[int, list, list]:
        data = text.encode()
        words = data.translate(LOWER_WORDS).split()
        have = set(words)
        base, blocks, wrapped = [], [], []
        for phrase, label in phrases:
            if not have.issuperset(phrase):
                continue
            at = -1
            while True:
                try:
                    at = words.index(phrase[0], at + 1)
                except ValueError:
                    break
                if words[at : at + len(phrase)] == phrase:
                    base.append({"label": label, "start": at})
        if not have.isdisjoint(matcher.prefix):
            hit = lambda t, at, length, share: {"template": t, "label": matcher.labels[t], "start": at, "length": length, "containment": share}
            begin, longest = 0, 0
            for line in data.split(b"\n"):
                line = line.translate(LOWER_WORDS).split()
                for at in spans(len(line), span):
                    block = line[at : at + span]
                    blocks += [hit(t, begin + at, len(block), share) for t, share in matcher.block(block)]
                begin, longest = begin + len(line), max(longest, len(line))
            if longest < len(words):
                # Windows overlap, so a stretch may be found twice.
                every = {(t, begin + at, *more) for begin in spans(len(words), 2 * span) for t, at, *more in matcher.stretches(words[begin : begin + 2 * span])}
                wrapped = [hit(*x) for x in sorted(every)]
        return len(words), base, blocks, wrapped

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))]
        kinds.append(pa.list_(pa.struct([("template", pa.int32()), ("label", pa.string()), ("start", pa.int64()), ("length", pa.int32()), ("containment", pa.float64())])))
        kinds.append(kinds[-1])
        for batch in batches:
            rows = [one(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array([r[k] for r in rows], kinds[k]) for k in range(4))], names=["id", "n_words", "base", "blocks", "wrapped"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of().alias("text"))
    return rows.mapInArrow(run, _SCAN).withColumnRenamed("id", id_col)


def labels(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document: counts and places of base phrases, base labels, all labels, and
    the score: the largest containment of a block that meets a template, else 0. The
    blocks are those of lines and the stretches over lines."""
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return scanned.select(
        id_col,
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.start").alias("first_word"),
        F.array_max("base.start").alias("last_word"),
        joined("base.label").alias("base_labels"),
        joined(F.concat("base.label", "blocks.label", "wrapped.label")).alias("labels"),
        F.coalesce(F.array_max(F.concat("blocks.containment", "wrapped.containment")), F.lit(0.0)).alias("score"),
    )


def sql(templates: tuple = TEMPLATES, threshold: float = THRESHOLD, span: int = SPAN) -> str:
    """The same in plain SQL, every block of a line against every template; it has no
    stretches, so it lacks what only a notice wrapped over lines gives."""
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    sets = ", ".join(f"({k}, '{label}', {quoted(sorted(set(t.split())))})" for k, (t, label) in enumerate(templates))
    base = ", ".join(f"('{label}', {quoted(p.split())})" for p, label in PHRASES.items())
    half = span // 2
    return f"""WITH templates(template, label, tokens) AS (VALUES {sets}),
phrases(label, tokens) AS (VALUES {base}),
words AS (SELECT doc_id, regexp_extract_all({low}, {word}) AS w FROM documents),
places AS (SELECT doc_id, label, unnest(list_filter(range(0, len(w)), lambda i: w[i + 1:i + len(tokens)] = tokens)) AS start
FROM words, phrases),
base AS (SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, list(DISTINCT label) AS l FROM places GROUP BY doc_id),
lines AS (SELECT doc_id, regexp_extract_all(unnest(string_split({low}, chr(10))), {word}) AS w FROM documents),
blocks AS (SELECT doc_id, list_distinct(w[s + 1:s + {span}]) AS b FROM (SELECT doc_id, w,
unnest(CASE WHEN len(w) <= {span} THEN [0] ELSE range(0, len(w) - {half}, {half}) END) AS s FROM lines)),
met AS (SELECT doc_id, label, len(list_intersect(tokens, b)) / len(tokens) AS c FROM blocks, templates
WHERE len(list_intersect(tokens, b)) >= ceil(round({threshold} * len(tokens), 9))),
found AS (SELECT doc_id, max(c) AS score, list(DISTINCT label) AS l FROM met GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
coalesce(array_to_string(list_sort(base.l), ','), '') AS base_labels,
coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.l, []), coalesce(found.l, [])))), ','), '') AS labels,
coalesce(score, 0.0)::DOUBLE AS score
FROM words LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id)"""
