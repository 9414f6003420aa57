"""Byte-pair encoding by backtracking, and decoding by an offset table.

At each place the longest token is taken that an Aho-Corasick automaton finds and
that may stand behind the token before it; if none may, the last token is given up
for a shorter one. Two tokens may be neighbours if merging their bytes would not
join them, which their merge trees tell. A place that failed once is never tried
again, so the work is linear in the text; the result is that of doing all merges
in their order.
"""

import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlat.llm.common import text_of, worker_state
from netlat.llm.pieces import _SHOWN, Encoder, encoder

#: Fixed value: how byte-level tokenizers of this kind part a text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of pieces, and pairs of tokens, that a worker keeps beside the automaton.
KEPT, KEPT_PAIRS = 120_000_000, 300_000
_BYTE_OF = {chr(c): b for b, c in _SHOWN.items()} | {chr(b): b for b in range(256) if b not in _SHOWN}


def _read(path: str) -> tuple[list[bytes], list[tuple[int, int, int]], dict[str, int]]:
    """Tokens' bytes by id; merges as (left, right, joined) in order; added tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab = spec["model"]["vocab"]
    added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    tokens = [b""] * (1 + max([*vocab.values(), *added.values()]))
    for shown, i in vocab.items():
        tokens[i] = bytes(_BYTE_OF[c] for c in shown)
    for text, i in added.items():
        tokens[i] = text.encode()
    merges = []
    for m in spec["model"]["merges"]:
        a, b = m.split(" ") if isinstance(m, str) else m
        merges.append((vocab[a], vocab[b], vocab[a + b]))
    return tokens, merges, added


class BacktrackEncoder(Encoder):
    """Encoder whose ids come from the automaton and the pair table instead of the
    library; pieces and words that repeat are kept as there."""

    def __init__(self, path: str):
        self.tokens, merges, self.added = _read(path)
        self.kind, self.kept = "spaced", KEPT
        self.clear()
        self.rank = {joined: r for r, (_, _, joined) in enumerate(merges)}
        self.joined = {(a, b): j for a, b, j in merges}
        self.parts = {j: (a, b) for a, b, j in merges}
        self.pairs: dict[int, bool] = {}
        self.older_pairs: dict[int, bool] = {}
        base = {t: i for i, t in enumerate(self.tokens) if len(t) == 1 and i not in self.added.values()}
        if len(base) < 256:
            raise ValueError("every byte must be a token")
        self.automaton = ahocorasick.Automaton()
        ids = dict(base)
        for joined, (a, b) in self.parts.items():
            # A token that its own bytes do not merge to never appears.
            if self._apart(a, b, self.rank[joined]):
                ids[self.tokens[joined]] = joined
        for t, i in ids.items():
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.shorter = {}
        for t, i in ids.items():
            n = len(t) - 1
            while n and t[:n] not in ids:
                n -= 1
            self.shorter[i] = ids[t[:n]] if n else None
        self.size = [len(t) for t in self.tokens]
        self._bytes = [i.to_bytes(4, "little") for i in range(len(self.tokens))]
        self._split = regex.compile(SPLIT)
        self._special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self._break = self._whole("\n")
        self._tails = {t: self._whole(t) for t in ("", ".", ",")}

    def _apart(self, left: int, right: int, limit: float) -> bool:
        """Whether no merge of a rank under limit joins bytes across the border of two
        tokens. Undoes, of the two tokens at the border, the one merged later, and
        looks at each pair that met there."""
        while True:
            joined = self.joined.get((left, right))
            if joined is not None and self.rank[joined] < limit:
                return False
            a, b = self.rank.get(left, -1), self.rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            # While a pair met at the border, only merges before the next undone one
            # could have come between; of equal rank the left one is done first.
            if a >= b:
                limit, left = min(limit, a), self.parts[left][1]
            else:
                limit, right = min(limit, b + 1), self.parts[right][0]

    def neighbours(self, left: int, right: int) -> bool:
        """The pair table, filled as pairs are asked for."""
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            known = self.older_pairs.get(key)
            if known is None:
                known = self._apart(left, right, float("inf"))
            if len(self.pairs) >= KEPT_PAIRS // 2:
                self.older_pairs, self.pairs = self.pairs, {}
            self.pairs[key] = known
        return known

    def _longest(self, text: str, at: int) -> int | None:
        for _, token in self.automaton.iter_long(text, at):
            return token
        return None

    def merge(self, data: bytes) -> list[int]:
        """Ids of the bytes of one pre-token."""
        text, n = data.decode("latin-1"), len(data)
        out: list[int] = []
        at, failed, token = 0, bytearray(n + 1), self._longest(text, 0)
        while at < n:
            while token is not None:
                end = at + self.size[token]
                if not failed[end] and (not out or self.neighbours(out[-1], token)):
                    break
                token = self.shorter[token]
            if token is not None:
                out.append(token)
                at = end
                token = self._longest(text, at) if at < n else None
            else:
                failed[at] = 1
                token = out.pop()
                at -= self.size[token]
                token = self.shorter[token]
        return out

    def _plain(self, text: str) -> bytes:
        return b"".join(self._bytes[i] for word in self._split.findall(text) for i in self.merge(word.encode()))

    def _whole(self, text: str) -> bytes:
        if not self._special:
            return self._plain(text)
        out, at = [], 0
        for m in self._special.finditer(text):
            out += [self._plain(text[at : m.start()]), self._bytes[self.added[m[0]]]]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def _word(self, word: str, space: bool) -> bytes:
        return b"".join([self._bytes[i] for i in self.merge((" " + word if space else word).encode())])


class OffsetDecoder:
    """All tokens' bytes in one string, and where each begins."""

    def __init__(self, path: str):
        tokens, _, _ = _read(path)
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.starts = np.append(0, np.cumsum([len(t) for t in tokens]))

    def decode(self, ids: np.ndarray) -> str:
        """Bytes that are no UTF-8 become replacement characters."""
        first, sizes = self.starts[ids], self.starts[ids + 1] - self.starts[ids]
        ends = np.cumsum(sizes)
        if not len(ends):
            return ""
        place = np.arange(ends[-1]) + np.repeat(first - (ends - sizes), sizes)
        return self.bytes[place].tobytes().decode("utf-8", "replace")


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id") -> DataFrame:
    """One row a row: the identifier and ids, an array of int. A null text has none.
    Other columns are ignored; an empty table gives an empty table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer, BacktrackEncoder)
        for batch in batches:
            # As many rows at once as their lists need no more than some megabytes.
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                ids = [coder.one(t.as_py()) for t in part.column(1)]
                ends = np.append(0, np.cumsum([len(i) // 4 for i in ids])).astype("<i4")
                values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(ids))])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), values)], names=["id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of().alias("text"))
    return rows.mapInArrow(run, "id long, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id") -> DataFrame:
    """encode's table with the column text that its ids stand for; null ids: empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = worker_state()
        decoder = kept.get(("offsets", tokenizer)) or kept.setdefault(("offsets", tokenizer), OffsetDecoder(tokenizer))
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                lists = part.column("ids")
                texts = [decoder.decode(i.values.to_numpy().astype(np.int64)) if i.is_valid else "" for i in lists]
                yield pa.RecordBatch.from_arrays([part.column("id"), lists, pa.array(texts, pa.string())], names=["id", "ids", "text"])

    rows = encoded.select(F.col(id_col).alias("id"), F.col("ids"))
    return rows.mapInArrow(run, "id long, ids array<int>, text string").withColumnRenamed("id", id_col)
