"""Token ids of whole texts with a public tokenizer, word by word from a cache."""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np

from loglathe.llm.words import word_spans

#: Words for which lower-casing and splitting into runs of letters, digits and signs is plain.
_LATIN = re.compile(r"[!-~ª²³µ¹º¼-¾À-įı-ɏ]+")
_RUNS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºÀ-ÖØ-öø-ɏ]+|[0-9²³¹¼-¾]|[^\sa-zªµºÀ-ÖØ-öø-ɏ0-9²³¹¼-¾]+")
#: Words and runs that a worker remembers; a full cache is emptied.
CACHED_WORDS = 2_000_000
CACHED_RUNS = 400_000


def _byte_letters() -> list[str]:
    """Byte-level vocabularies write a printable byte as itself and the n-th of the others as code point 256 + n."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


class Encoder:
    """Ids of texts, equal to those of the tokenizer itself.

    The vocabulary drops white space and never joins ids across it, so a text's ids are those of its words.  Known
    words are found by their 64-bit hash, many at a time.  A new word is cut into the runs that the vocabulary encodes
    one by one, if it is Latin; other words go to the tokenizer as they are.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.runs: dict[str, bytes] = {}
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _run(self, run: str) -> bytes:
        known = self.runs.get(run)
        if known is None:
            as_bytes = run if run.isascii() else "".join([self.letters[b] for b in run.encode()])
            known = self.runs[run] = array("I", [t.id for t in self.model.tokenize(as_bytes)]).tobytes()
        return known

    def _word(self, word: str) -> bytes:
        core = word.rstrip(".,!#$%&*")
        if core.isalpha() and (core.isascii() or (max(core) < "\u0250" and "\u0130" not in core)):
            ids = self._run(core.lower())
            return ids if len(core) == len(word) else ids + self._run(word[len(core) :])
        if _LATIN.fullmatch(word) and "<|" not in word:
            return b"".join([self._run(r) for r in _RUNS.findall(word.lower())])
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        if len(self.runs) > CACHED_RUNS:
            self.runs.clear()
        found = [self._word(w) for w in words]
        size = np.array([len(f) // 4 for f in found], np.int64)
        place = len(self.ids) + np.cumsum(size) - size
        keys = np.concatenate([self.keys, hashes])
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.place = np.concatenate([self.place, place])[order]
        self.size = np.concatenate([self.size, size])[order]
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(found), np.uint32)])

    def _at(self, hashes: np.ndarray) -> np.ndarray:
        """Where each hash stands among the known ones, or -1."""
        if not len(self.keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at, -1)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents of a byte array one after the other, and where each one's ids begin."""
        starts, ends, hashes, bounds = word_spans(data, offsets, False)
        if not len(hashes):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        if len(self.keys) > CACHED_WORDS:
            self._forget()
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        at = self._at(distinct)
        new = np.flatnonzero(at < 0)
        if len(new):
            raw = data.tobytes()
            self._learn(distinct[new], [raw[starts[i] : ends[i]].decode() for i in first[new]])
            at = self._at(distinct)
        at = at[which]
        size, place = self.size[at], self.place[at]
        total = np.concatenate([[0], np.cumsum(size)])
        flat = np.arange(total[-1]) + np.repeat(place - total[:-1], size)
        return self.ids[flat], total[bounds]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
