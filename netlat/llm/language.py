"""Language of a text by a string kernel.

The kernel of two texts is the number of n-grams of one to three characters (blended
spectrum) that both have, over the root of the product of how many each has; only
n-grams of the landmarks count. Landmarks are drawn from the texts to learn from;
ridge regression, one language against the rest, is fitted on the kernels with them
(Nyström): tasks sum their rows' products, the driver solves one system of the
landmarks' size. Texts are scored in batches: presence matrix times landmark matrix
gives the kernels, kernels times coefficients the languages' scores.
"""

import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netlat.llm.common import parts, text_of
from netlat.session import settle

#: Characters in the longest n-gram. Three characters fit one 64-bit number.
N = 3
#: The model is fitted on so many different texts of each language at most, those with
#: the smallest hashes; the first of them are its landmarks, LANDMARKS over all
#: languages and two of each at least.
SAMPLE, LANDMARKS = 2_000, 256
#: Longer texts are no landmarks, which bounds the number of n-grams.
LANDMARK_CHARS = 20_000
#: Weight of the coefficients' size, for each text fitted on.
RIDGE = 1e-4
#: Texts scored at a time, and characters looked at together.
ROWS, CHARS = 256, 500_000
#: The language of what has no letters.
UNDETERMINED = "und"

_WORD = re.compile(r"[^\W\d_]+")
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def letters(text: str | None) -> str:
    """The words of a text in lower case with a space around each; digits, signs and
    white space part words. Empty without letters."""
    found = _WORD.findall((text or "").lower())
    # Some signs that are no digits for the pattern are no letters either.
    if found and not any(w.isalpha() for w in found):
        found = [w for w in ("".join(c for c in f if c.isalpha()) for f in found) if w]
    return f" {' '.join(found)} " if found else ""


def codes(text: str, n: int = N) -> np.ndarray:
    """All n-grams of one to n characters as numbers; those with the character 0,
    which parts texts, are left in."""
    c = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    out, grams = [c], c
    for k in range(1, n):
        grams = grams[:-1] | c[k:] << np.uint64(21 * k)
        out.append(grams)
    return np.concatenate(out)


class Grams:
    """A place for each of some n-grams, in an open table."""

    def __init__(self, known: np.ndarray):
        self.size = len(known)
        self.bits = max(4, int(4 * len(known)).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.values = np.full(1 << self.bits, -1, np.int32)
        # No n-gram is 0: the character 0 only parts texts.
        left, value, step = known, np.arange(len(known), dtype=np.int32), 0
        while len(left):
            slot = self._slot(left, step)
            free = np.flatnonzero(self.values[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.values[slot[put]] = left[put], value[put]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, value, step = left[rest], value[rest], step + 1
        self.steps = step

    def _slot(self, code: np.ndarray, step: int) -> np.ndarray:
        h = (code * _GOLDEN) >> np.uint64(64 - self.bits)
        return (h + np.uint64(step)) & np.uint64((1 << self.bits) - 1) if step else h

    def find(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the n-grams have a place, and their places."""
        at, places = np.arange(len(code)), np.full(len(code), -1, np.int32)
        for step in range(self.steps):
            slot = self._slot(code[at], step)
            keys = self.keys[slot]
            hit = keys == code[at]
            places[at[hit]] = self.values[slot[hit]]
            at = at[~hit & (keys != 0)]
            if not len(at):
                break
        found = np.flatnonzero(places >= 0)
        return found, places[found]


class Model:
    """Landmarks, and after fitting the coefficients and languages."""

    def __init__(self, landmarks: list[str]):
        held = [np.unique(codes(t)) for t in landmarks]
        every = np.unique(np.concatenate([*held, np.zeros(0, np.uint64)]))
        self.grams = Grams(every)
        self.texts = np.zeros((len(every), len(held)), np.uint8)
        for k, h in enumerate(held):
            self.texts[np.searchsorted(every, h), k] = 1
        self.languages: list[str] = []
        self.coefficients = np.zeros((len(held), 0))
        self.usual = 0

    @cached_property
    def scaled(self) -> np.ndarray:
        """The landmark matrix by the landmarks' sizes; made in each task."""
        held = self.texts.astype(np.float32)
        return held / np.sqrt(held.sum(0))

    def kernels(self, texts: list[str]) -> np.ndarray:
        """Kernels of texts (of letters()) with the landmarks, whole texts however long."""
        landmarks = self.scaled
        out = [np.zeros((0, landmarks.shape[1]))]
        present = np.zeros((min(ROWS, len(texts)), self.grams.size), np.float32)
        for at in range(0, len(texts), ROWS):
            some = texts[at : at + ROWS]
            rows = present[: len(some)]
            rows[:] = 0
            for owner, joined in _joined(some):
                where, places = self.grams.find(codes(joined))
                # n-grams follow each other by length: the place in the text comes first.
                place = where.astype(np.int64)
                for k in range(1, N):
                    place[where >= _before(len(joined), k)] = where[where >= _before(len(joined), k)] - _before(len(joined), k)
                rows[owner[place], places] = 1
            held = np.sqrt(rows.sum(1, dtype=np.float64))
            out.append((rows @ landmarks) / np.maximum(held, 1)[:, None])
        return np.concatenate(out)

    def fit(self, products: np.ndarray, goals: np.ndarray, rows: float, ridge: float = RIDGE) -> None:
        """products, goals: sums over the rows of kernels times kernels and times 1 or -1
        for each language."""
        landmarks = self.texts.astype(float)
        between = landmarks.T @ landmarks
        size = np.sqrt(np.diag(between))
        between /= size[:, None] * size[None, :]
        system = products + ridge * rows * between + 1e-9 * rows * np.eye(len(size))
        self.coefficients = np.linalg.solve(system, goals)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score: half of one plus the regression's value, from 0 to 1."""
        kernels = self.kernels(texts)
        values = kernels @ self.coefficients
        pick = values.argmax(1) if len(texts) else np.zeros(0, int)
        score = np.clip((1 + values.max(1, initial=-1)) / 2, 0, 1)
        # Nothing in common with any landmark: the language with most rows.
        none = ~kernels.any(1)
        pick[none], score[none] = self.usual, 0.0
        empty = np.array([not t for t in texts], bool)
        score[empty] = 0.0
        return [UNDETERMINED if e else self.languages[p] for e, p in zip(empty, pick, strict=True)], score


def _before(chars: int, k: int) -> int:
    """Where n-grams of k + 1 characters begin among all of a text."""
    return k * chars - k * (k - 1) // 2


def _joined(texts: list[str]) -> Iterator[tuple[np.ndarray, str]]:
    """Texts joined by the character 0, about CHARS at a time, with the text of each
    character. A longer text comes in parts that share their last characters."""
    owner, held, n = [], [], 0
    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text) - N + 1), CHARS):
            piece = text[at : at + CHARS + N - 1] + "\0"
            owner.append(np.full(len(piece), k))
            held.append(piece)
            n += len(piece)
            if n >= CHARS:
                yield np.concatenate(owner), "".join(held)
                owner, held, n = [], [], 0
    if n:
        yield np.concatenate(owner), "".join(held)


def sample(docs: DataFrame, learn: Column, per_language: int = SAMPLE) -> DataFrame:
    """lang, text and nth of the different texts with letters to learn from, by their hashes."""
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where(F.col("text").rlike(r"\p{L}")).withColumn("hash", F.xxhash64("text"))
    # Only hashes are sorted; copies are reduced where they are read.
    hashes = rows.groupBy("lang", "hash").agg(F.count("*").alias("copies"))
    order = Window.partitionBy("lang").orderBy("hash")
    chosen = hashes.select("lang", "hash").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= per_language)
    chosen = settle(chosen, "language-hashes")
    texts = rows.join(chosen, ["lang", "hash"]).groupBy("lang", "hash", "nth").agg(F.min("text").alias("text"))
    return settle(texts.select("lang", "text", "nth"), "language-sample")


def train(docs: DataFrame, learn: Column, per_language: int = SAMPLE, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """The model of the rows of docs (text, lang) that learn names; none without any."""
    chosen = sample(docs, learn, per_language)
    counts = {r["lang"]: r["n"] for r in chosen.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    each = max(2, landmarks // len(counts))
    short = chosen.where(F.length("text") <= LANDMARK_CHARS)
    order = Window.partitionBy("lang").orderBy("nth")
    first = short.withColumn("k", F.row_number().over(order)).where(F.col("k") <= each)
    model = Model([letters(r["text"]) for r in first.select("lang", "text", "k").orderBy("lang", "k").collect()])
    model.languages = sorted(counts)
    usual = docs.where(learn & F.col("lang").isNotNull()).groupBy(F.col("lang").cast("string").alias("lang")).agg(F.count("*").alias("n"))
    usual = usual.orderBy(F.desc("n"), "lang").first()["lang"]
    model.usual = model.languages.index(usual) if usual in counts else 0
    number = {c: k for k, c in enumerate(model.languages)}
    rows = sum(counts.values())
    # Languages count alike, however many texts they have.
    weight = np.array([rows / (len(counts) * counts[c]) for c in model.languages])
    m, c = model.texts.shape[1], len(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, goals = np.zeros((m, m)), np.zeros((m, c))
        for batch in batches:
            for part in parts(batch, ["text"]):
                kernels = model.kernels([letters(t.as_py()) for t in part.column("text")]).astype(float)
                lang = np.array([number[x] for x in part.column("lang").to_pylist()])
                y = np.full((len(lang), c), -1.0)
                y[np.arange(len(lang)), lang] = 1
                products += kernels.T @ (kernels * weight[lang][:, None])
                goals += kernels.T @ (y * weight[lang][:, None])
        yield pa.RecordBatch.from_arrays([pa.array([products.tobytes()]), pa.array([goals.tobytes()])], names=["products", "goals"])

    # The sample is bounded, so a few tasks read it and as many sums come back.
    sums = chosen.select("lang", "text").coalesce(16).mapInArrow(run, "products binary, goals binary").collect()
    products = sum(np.frombuffer(r["products"]).reshape(m, m) for r in sums)
    goals = sum(np.frombuffer(r["goals"]).reshape(m, c) for r in sums)
    model.fit(products, goals, rows, ridge)
    return model


def identify(docs: DataFrame, model: Model | None, columns: dict[str, Column]) -> DataFrame:
    """The given columns, lang_pred and score of each row of docs, where it is read.

    A null text, and one without letters, has the language und and the score 0; so has
    any text without a model.
    """
    rows = docs.select(*[c.alias(n) for n, c in columns.items()], text_of().alias("_text"))
    names = [f.name for f in rows.schema if f.name != "_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, ["_text"], 1_000_000):
                if model is None:
                    found, score = [UNDETERMINED] * part.num_rows, np.zeros(part.num_rows)
                else:
                    found, score = model.predict([letters(t.as_py()) for t in part.column("_text")])
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(found, pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text")
    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def fold(id_col: str = "doc_id") -> Column:
    """The fold of a row: the checksum of its identifier as text, modulo 5."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5


def languages(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row a row: the identifier, held_out, lang_pred, score. Learned from the text
    and language of the rows of folds 1 to 4; those of fold 0 are held out.

    A null identifier counts as empty and is held out. Equal texts are learned from once
    a language. Without any text to learn from all are und. Other columns are ignored;
    an empty table gives an empty table.
    """
    model = train(docs, fold(id_col) != 0)
    return identify(docs, model, {id_col: F.col(id_col).cast("long"), "held_out": fold(id_col) == 0})
