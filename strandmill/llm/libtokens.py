"""Whole texts encoded as the tokenizers library encodes them, each different word once.

Both files cut a text into words before the merges, and the merges never cross a word. So a text's ids are its words'
ids one after another: the words are cut by array operations, and the library's model encodes those that are not kept
from before.
"""

from __future__ import annotations

import json
import os
import unicodedata
from array import array
from functools import cache

import numpy as np
import regex

from strandmill.llm.segment import SpacedSplitter, WordSplitter
from strandmill.llm.shared import WordMemo
from strandmill.llm.wordids import WordIds

#: Beyond these letters the library's own normaliser is asked.
PLAIN = regex.compile(r"[\u0000-ɏ]*")


@cache
def byte_alphabet() -> dict[int, int]:
    """The character that stands for each byte: printable ones for themselves, the others from U+0100 on in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return dict(zip(shown, shown)) | {b: 0x100 + i for i, b in enumerate(hidden)}


class LibraryEncoder:
    """Ids of whole texts by a file of the tokenizers library, without special tokens put around them.

    ``end``: an id put after each text. The file's added tokens in a text give their own ids, as in the library as
    loaded. ``width``: bytes of an id in ``packed``, 2 if every id fits, else 4.
    """

    def __init__(self, file: str, pattern: str | None, end: int | None = None, kept_words: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.split = SpacedSplitter(pattern) if pattern else WordSplitter()
        self.model = self.tokenizer.model
        self.normal = self.tokenizer.normalizer
        size = max(self.tokenizer.get_vocab_size(with_added_tokens=True), (end or 0) + 1)
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.memo = WordMemo(kept_words, self._many)
        self.shown = np.array([byte_alphabet()[b] for b in range(256)], "<u4")
        self.flat = WordIds(self.split, self._lists, self.kind, kept_words) if pattern and self.normal is None else None
        self.end = b"" if end is None else np.array([end], self.kind).tobytes()
        self.added = self._added(file)
        self.cut = regex.compile(f"({'|'.join(map(regex.escape, sorted(self.added, key=len, reverse=True)))})") if self.added else None

    def _added(self, file: str) -> dict[str, bytes]:
        """The ids of the file's added tokens, which the library cuts out of the raw text before all else."""
        with open(file, encoding="utf-8") as f:
            tokens = json.load(f).get("added_tokens") or []
        for t in tokens:
            if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]:
                raise ValueError(f"added tokens are matched as they stand, not {t}")
        return {t["content"]: np.array([t["id"]], self.kind).tobytes() for t in tokens}

    def _many(self, words: list[str]) -> list[bytes]:
        """The library's own merges of single words, in the alphabet that stands for bytes in its files."""
        tokenize, shown, kind = self.model.tokenize, byte_alphabet(), self.kind.char
        return [array(kind, [t.id for t in tokenize(w.encode().decode("latin-1").translate(shown))]).tobytes() for w in words]

    def _lists(self, data: np.ndarray, ends: np.ndarray) -> list[list[int]]:
        """The same of words given by their bytes, one after another, and their ends."""
        tokenize, shown, ends = self.model.tokenize, self.shown[data].tobytes().decode("utf-32-le"), ends.tolist()
        return [[t.id for t in tokenize(shown[a:b])] for a, b in zip([0, *ends], ends)]

    def _words(self, text: str | None) -> list[str]:
        text = text or ""
        if self.normal is not None:
            text = unicodedata.normalize("NFC", text).lower() if PLAIN.fullmatch(text) else self.normal.normalize_str(text)
        return self.split(text)

    def packed(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, little-endian; null is the empty text."""
        parts = [self.cut.split(t or "") if self.cut else [t or ""] for t in texts]  # every second part is an added token
        if self.flat:
            found = iter(self.flat([p for ps in parts for p in ps[::2]]))
            return [b"".join(self.added[p] if i % 2 else next(found) for i, p in enumerate(ps)) + self.end for ps in parts]
        ids = iter(self.memo.values([self._words(p) for ps in parts for p in ps[::2]]))
        return [b"".join(self.added[p] if i % 2 else b"".join(next(ids)) for i, p in enumerate(ps)) + self.end for ps in parts]


@cache
def library_encoder(file: str, pattern: str | None, end: int | None) -> LibraryEncoder:
    """One per process: the tasks that a worker runs share its words."""
    return LibraryEncoder(file, pattern, end)
