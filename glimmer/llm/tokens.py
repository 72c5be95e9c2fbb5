"""Token ids by a public tokenizer, one white-space word at a time through a bounded memo."""

from __future__ import annotations

import re

import numpy as np

#: Words that a worker remembers; beyond, the memo starts anew.
MEMO_WORDS = 1_000_000
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Python's split() takes these for white space, the tokenizer does not.
_NO_SPACE = "\x1c\x1d\x1e\x1f"
_SPACE = re.compile(r"[^\S\x1c-\x1f]+")
_MEMOS: dict[str, WordIds] = {}


class WordIds(dict):
    """word -> bytes of its little-endian unsigned 32-bit ids.

    For a tokenizer that drops white space and case and parts letters from marks, the ids of a text are those of its
    words one after another, so a word that comes again costs one look-up.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_file(path).encode

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMO_WORDS:
            self.clear()
        letters = word.rstrip(_MARKS)
        if letters != word and letters.isalpha():
            ids = self[letters] + self[word[len(letters) :]]
        elif word.isascii() and word.isalpha() and not word.islower():
            ids = self[word.lower()]
        else:
            ids = np.asarray(self.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        if len(word) <= 64:
            self[word] = ids
        return ids

    def of(self, text: str) -> bytes:
        words = text.split() if not any(c in text for c in _NO_SPACE) else _SPACE.split(text)
        return b"".join(map(self.__getitem__, filter(None, words)))


def word_ids(path: str) -> WordIds:
    """The memo of this worker process; it outlives a task."""
    if path not in _MEMOS:
        _MEMOS[path] = WordIds(path)
    return _MEMOS[path]
