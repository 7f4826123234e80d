"""Encoding whole texts with a vocabulary of the ``tokenizers`` library, fast.

A byte-level BPE vocabulary splits a text into parts before its merges, and each part is encoded by itself. Texts are split
the same way here; parts repeat far more often than texts do. Each worker keeps the ids of those it has met and
asks the library for the others only.
"""

from __future__ import annotations

import re
from array import array
from functools import cache
from operator import attrgetter

import numpy as np
import regex

KEPT_BYTES = 160 << 20  # what the parts that a worker keeps may hold; the older half goes first. Only speed depends on it.
ENTRY_BYTES = 190  # of a part and its ids besides their length: two objects and a place in the table

# How byte-level vocabularies split texts, and the printable characters they show bytes by.
_PARTS = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
).findall
# The same for texts below U+0250, where each class is a list: the module of the language is several times as fast.
_LETTERS = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u024f"
_NUMBERS = "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"
_BLANKS = "\\t-\\r \\x85\\xa0"
_LATIN_PARTS = re.compile(
    f" ?[{_LETTERS}]+| ?[{_NUMBERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{_BLANKS}{_LETTERS}{_NUMBERS}]+|[{_BLANKS}]+(?![^{_BLANKS}])|[{_BLANKS}]+"
).findall
_BEYOND_LATIN = re.compile("[^\\0-\\u024f]").search
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SHOWN = {b: chr(b) for b in _PRINTED} | {
    b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(_PRINTED))
}
_SPACE = _SHOWN[32]
_ID = attrgetter("id")


def parts_of(text: str) -> list[str]:
    """The parts that the vocabulary encodes one by one; joined, they are the text."""
    return _PARTS(text) if _BEYOND_LATIN(text) else _LATIN_PARTS(text)


class PieceEncoder:
    def __init__(self, path: str, kept: int = KEPT_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kept, self.held = kept, 0
        self.young: dict[str, np.ndarray] = {}
        self.old: dict[str, np.ndarray] = {}

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, missing: list[str]) -> None:
        """Let the library merge each part that is new."""
        self.held += ENTRY_BYTES * len(missing) + 5 * sum(map(len, missing))
        if self.held > self.kept // 2:
            self.old, self.young, self.held = self.young, {}, 0
        young, known, merge = self.young, self.old.get, self.tokenizer.model.tokenize
        for part in missing:
            if (ids := known(part)) is None:
                if part.isascii() and part[0] == " " and part[1:].isalpha():
                    shown = _SPACE + part[1:]
                else:
                    shown = part.encode().decode("latin-1").translate(_SHOWN)
                ids = array("I", map(_ID, merge(shown))).tobytes()
            young[part] = ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text as unsigned 32-bit integers."""
        out: list[np.ndarray] = []
        for text in texts:
            if any(s in text for s in self.special):  # such a string is one id, wherever it stands
                out.append(self.whole(text))
                continue
            parts = parts_of(text)
            got = list(map(self.young.get, parts))
            if None in got:
                places = [k for k, ids in enumerate(got) if ids is None]
                self._learn(list(dict.fromkeys([parts[k] for k in places])))
                young = self.young
                for k in places:
                    got[k] = young[parts[k]]
            out.append(np.frombuffer(b"".join(got), np.uint32))
        return out

    def forget(self) -> None:
        """Empty the store; a worker lives on after its task and would hold it for other stages."""
        self.young, self.old, self.held = {}, {}, 0


@cache
def encoder(path: str) -> PieceEncoder:
    """One per worker process and vocabulary."""
    return PieceEncoder(path)
