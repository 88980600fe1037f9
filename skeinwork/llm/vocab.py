"""A public tokenizer inside a task: pre-tokens of whole texts, and ids or piece counts once per distinct pre-token."""

from __future__ import annotations

import os
import re
import sys
import types
import unicodedata
from collections import Counter

import numpy as np
import regex

from .common import _INVERSES, _POWERS, mix

#: The pre-token pattern of word_bpe_49k.json (fixed value).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same pattern's endings after an apostrophe (fixed value).
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Characters on which lower-casing, NFC and white space are the same in every Unicode library; other texts go to the library whole.
PLAIN = re.compile("[^\t\n\r -~¡-įı-ňŊ-ž]")
#: Words whose ids a worker remembers, from one task to the next; it forgets all beyond that, so memory stays bounded.
CACHE = 800_000
#: Characters that are cut into pre-tokens at once; a longer text goes through the pattern itself.
SLICE_CHARS = 1 << 18
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_KIND = np.array([_SPACE if chr(c) in "\t\n\r " else {"L": _LETTER, "N": _DIGIT}.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x180)], np.uint8)


def pre_token_spans(text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the pre-tokens of plain lower-case texts, given as code points and each text's bounds.

    A pre-token is a run of letters, one digit, or a run of other signs; an apostrophe that is such a run by itself takes one
    of ENDINGS with it.
    """
    n = len(text)
    kind = np.concatenate([_KIND[text], [_SPACE]])
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    fresh = edge.copy()
    fresh[1:] |= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    fresh[0] = True
    lone = np.flatnonzero((text == ord("'")) & fresh[:-1] & fresh[1:] & ~edge[1:] & (kind[1:] == _LETTER))
    if len(lone):
        second, third = text[lone + 1], text[np.minimum(lone + 2, n - 1)]
        more = (lone + 2 < n) & ~edge[np.minimum(lone + 2, n)]
        size = np.zeros(len(lone), np.int64)
        for e in ENDINGS:
            fits = second == ord(e[0])
            size[fits & ((third == ord(e[-1])) & more if len(e) > 1 else True)] = len(e)
        lone, size = lone[size > 0], size[size > 0]
        fresh[lone + 1] = False
        fresh[lone + 1 + size] = True
    cuts = np.flatnonzero(fresh)
    cuts = np.append(cuts, n) if cuts[-1] != n else cuts
    starts, ends = cuts[:-1], cuts[1:]
    word = kind[starts] != _SPACE
    return starts[word], ends[word]


class Vocabulary:
    @classmethod
    def of(cls, path: str) -> Vocabulary:
        """The worker process's own vocabulary of that path: Spark sends a task's functions anew each time, the process stays."""
        kept = sys.modules.setdefault("_skeinwork_vocabularies", types.ModuleType("_skeinwork_vocabularies")).__dict__
        return kept.get(path) or kept.setdefault(path, cls(path))

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = path.endswith("word_bpe_49k.json")
        self.find = regex.compile(PRE_TOKEN).findall
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.flat, self.begin, self.count = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def is_plain(self, text: str) -> bool:
        return self.plain and "<|" not in text and not PLAIN.search(text)

    def ids_of(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all the texts, one after the other; how many each has)."""
        ids: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        sizes = np.zeros(len(texts), np.int64)
        held, n = [], 0
        for i, text in enumerate(texts):
            if len(text) >= SLICE_CHARS or not self.is_plain(text):
                ids[i] = np.array(self.whole(text), np.uint32)
                sizes[i] = len(ids[i])
                continue
            held.append(i)
            n += len(text)
            if n >= SLICE_CHARS:
                self._encode_plain(texts, held, ids, sizes)
                held, n = [], 0
        if held:
            self._encode_plain(texts, held, ids, sizes)
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), sizes

    def _encode_plain(self, texts: list[str], some: list[int], ids: list[np.ndarray], sizes: np.ndarray) -> None:
        lower = [texts[i].lower() for i in some]
        joined = "".join(lower)
        if not joined:
            return
        text, offsets = np.frombuffer(joined.encode("utf-16-le"), np.uint16), np.cumsum([0, *map(len, lower)])
        starts, ends = pre_token_spans(text, offsets)
        if not len(starts):
            return
        sums = np.zeros(len(text) + 1, np.uint64)
        np.cumsum((text.astype(np.uint64) + np.uint64(1)) * _POWERS[: len(text)], out=sums[1:])
        h = mix((sums[ends] - sums[starts]) * _INVERSES[starts] + mix((ends - starts).astype(np.uint64)))
        distinct, first, which = np.unique(h, return_index=True, return_inverse=True)
        keys = distinct.tolist()
        place = list(map(self.known.get, keys))
        if None in place:
            if len(self.known) > CACHE:
                self._forget()
                place = [None] * len(keys)
            new = [k for k, x in enumerate(place) if x is None]
            got = self.ids_of([joined[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            numbers = range(len(self.count), len(self.count) + len(got))
            self.known.update(zip((keys[k] for k in new), numbers, strict=True))
            for k, number in zip(new, numbers, strict=True):
                place[k] = number
            count = np.array(list(map(len, got)), np.int64)
            self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(count) - count])
            self.count = np.concatenate([self.count, count])
            self.flat = np.concatenate([self.flat, np.array([x for one in got for x in one], np.uint32)])
        word = np.array(place, np.int64)[which]
        count = self.count[word]
        total = np.concatenate([[0], np.cumsum(count)])
        out = self.flat[np.arange(total[-1]) + np.repeat(self.begin[word] - total[:-1], count)]
        edge = total[np.searchsorted(starts, offsets)]
        for k, i in enumerate(some):
            ids[i] = out[edge[k] : edge[k + 1]]
        sizes[some] = np.diff(edge)

    def frequencies(self, text: str) -> Counter | None:
        """The text's pre-tokens, each a text of its own with the same ids; None if only the library can tell."""
        return Counter(self.find(text.lower())) if self.is_plain(text) else None
