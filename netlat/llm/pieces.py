"""Token ids of whole texts, a piece at a time.

Both public tokenizers start a new word at a single space between two visible
characters, so a text may be cut there and its pieces encoded by themselves.
Words repeat, so most pieces are found in a table kept by the worker, and the
library encodes the others. Tokenizers of another make get whole texts.
"""

import json
import os
import re
from collections.abc import Callable

import numpy as np

from netlat.llm.common import worker_state

_SAFE = re.compile(r"(?<=\S) (?=\S)")
#: How byte-level models show each byte: printable ones as they are, the others
#: as the characters from 256 on.
_PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_SHOWN = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}
_SPACE = chr(_SHOWN[32])
#: Bytes of pieces and their ids that a worker keeps, with SPENT for the objects that
#: hold them, in two halves: when the newer one is full it becomes the older one, which
#: is dropped. A piece found in the older half moves to the newer, so what texts use
#: often is never dropped.
KEPT_BYTES, SPENT = 200_000_000, 200
#: Longer pieces are encoded each time.
KEPT_LENGTH = 48
#: Runs of signs kept; they are few, and others are encoded each time.
KEPT_TAILS = 10_000
#: Signs that a word may end with.
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _kind(path: str) -> str:
    """spaced: a space belongs to the word after it. dropped: spaces vanish."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    before, normal = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    added = spec.get("added_tokens", [])
    # An added token that begins with a letter could stand in a word or at its end.
    if spec.get("truncation") or spec.get("padding") or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["content"][:1].isalnum() for t in added):
        return "whole"
    if before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and normal is None:
        return "spaced"
    steps = before.get("pretokenizers", [])
    if (
        len(steps) == 2
        and steps[0].get("behavior") == "Removed"
        and r"[^\s\p{L}\p{N}]+" in steps[0].get("pattern", {}).get("Regex", "")
        and {n["type"] for n in (normal or {}).get("normalizers", [])} <= {"NFC", "Replace", "Lowercase"}
    ):
        return "dropped"
    return "whole"


class _Table(dict):
    """Pieces with their ids; a missing one is asked for."""

    __slots__ = ("missed",)

    def __init__(self, missed: Callable[[str], bytes]):
        self.missed = missed

    def __missing__(self, piece: str) -> bytes:
        return self.missed(piece)


class Encoder:
    """ids(texts): each text's ids as little-endian unsigned 32-bit integers,
    the same as the library's encode without special tokens added."""

    def __init__(self, path: str, kept: int = KEPT_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind, self.kept = _kind(path), kept
        self.clear()
        if self.kind != "whole":
            self._break = self._whole("\n")
            self._tails = {t: self._whole(t) for t in ("", ".", ",")}
            self._model = self.tokenizer.model
            self._bytes = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]

    def clear(self) -> None:
        self.table, self.older, self.held = _Table(self._missed), {}, 0

    def pieces(self, text: str) -> list[str]:
        """Pieces after the first stand for themselves with a space before, or, if
        they begin with a line break, for themselves."""
        if self.kind == "dropped":
            return text.replace("\n", " ").split(" ")
        flat = text.replace("\n", " ")
        if "  " not in flat and flat.isprintable():
            return text.replace("\n", " \n").split(" ")
        return _SAFE.split(text)

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str, space: bool) -> bytes:
        """Ids of plain letters: one pre-token, so the model alone decides."""
        if self.kind == "dropped":
            word = word.lower()
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_SHOWN)
        if space and self.kind == "spaced":
            word = _SPACE + word
        return b"".join([self._bytes[t.id] for t in self._model.tokenize(word)])

    def _new(self, piece: str) -> bytes:
        """Ids of a piece that the table lacks. Letters and the signs that end a piece
        after them are different pre-tokens; the same few runs of signs come often."""
        word = piece.rstrip(_SIGNS)
        tail = piece[len(word) :]
        start = word[:1] == "\n" and self.kind == "spaced"
        if start:
            word = word[1:]
        if not (word.isalpha() and (word.isascii() or max(word) < "\u0180" and "\u0130" not in word)):
            return self._whole(piece if self.kind == "dropped" or piece[:1] == "\n" else " " + piece)
        if start:
            return self._break + self._word(word, False) + self._tail(tail)
        if not tail:
            return self._word(word, True)
        return (dict.get(self.table, word) or self.older.get(word) or self._word(word, True)) + self._tail(tail)

    def _tail(self, signs: str) -> bytes:
        ids = self._tails.get(signs)
        if ids is None:
            ids = self._whole(signs)
            if len(signs) <= KEPT_LENGTH and len(self._tails) < KEPT_TAILS:
                self._tails[signs] = ids
        return ids

    def _missed(self, piece: str) -> bytes:
        """Ids of a piece that the table in use lacked, kept from now on."""
        # The table may have been changed for a new one within a text.
        ids = dict.get(self.table, piece)
        if ids is not None:
            return ids
        ids = self.older.get(piece)
        if ids is None:
            ids = self._new(piece)
        if len(piece) <= KEPT_LENGTH:
            self.held += len(piece) + len(ids) + SPENT
            if self.held > self.kept // 2:
                self.older, self.table = self.table, _Table(self._missed)
                self.held = len(piece) + len(ids) + SPENT
            self.table[piece] = ids
        return ids

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Null counts as empty."""
        return [self.one(t or "") for t in texts]

    def one(self, text: str) -> bytes:
        if self.kind == "whole":
            return self._whole(text)
        cut = self.pieces(text)
        if self.kind == "spaced":
            head, cut = self._whole(cut[0]) if cut[0] else b"", cut[1:]
        else:
            head = b""
        return head + b"".join(map(self.table.__getitem__, cut))


def encoder(path: str, make: Callable[[str], Encoder] = Encoder) -> Encoder:
    """The worker's encoder for a file; it lives on between tasks."""
    kept = worker_state()
    key = (make.__name__, path)
    if key not in kept:
        kept[key] = make(path)
    return kept[key]
