"""Splitting text into pre-tokens with array operations, as the patterns of public tokenizers split it.

A character's class comes from one table; a pre-token is then a run of one class, but for a few rules at white
space. Only texts with an apostrophe need the pattern itself (its contractions).
"""

from __future__ import annotations

from functools import cache

import numpy as np
import regex

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3

#: Of the word-end tokenizer's file: what it keeps as words. A fixed value.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


EVERY = (range(0xD800), range(0xE000, 0x110000))  # the code points that text can hold


@cache
def classes() -> np.ndarray:
    """The class of every code point by the tables of the tokenizers' own library, whose Unicode may be older than others'."""
    import tiktoken

    every = "".join(map(chr, (c for r in EVERY for c in r)))
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        only = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        out[codes(bytes(only.encode_ordinary(every)).decode())] = kind  # what the pattern does not match is left out
    return out


@cache
def unlike() -> np.ndarray:
    """Whether a code point has another class in the regular expressions used here."""
    every, own = "".join(map(chr, (c for r in EVERY for c in r))), np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        own[codes("".join(regex.findall(pattern, every)))] = kind
    return own != classes()


#: What stands for a code point of each class where the classes differ: no letter of a contraction. Fixed values.
STAND_IN = np.array([0xA7, 0xAA, 0x30, 0x2003], np.uint32)


def _matches(pattern: regex.Pattern, text: str) -> list[str]:
    """The matches of a pattern by ``classes``."""
    points = codes(text)
    if points.itemsize == 1 or not (odd := unlike()[points]).any():
        return pattern.findall(text)
    like = points.copy()
    like[odd] = STAND_IN[classes()[points[odd]]]
    return [text[m.start() : m.end()] for m in pattern.finditer(like.tobytes().decode("utf-32-le"))]


def codes(text: str) -> np.ndarray:
    """The text's code points, in the narrowest form that holds them."""
    try:
        return np.frombuffer(text.encode("latin-1"), np.uint8)
    except UnicodeEncodeError:
        return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _exact(pattern: str) -> regex.Pattern:
    """The pattern with white space as Unicode defines it, which is what the tokenizers' libraries go by."""
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def _parted(points: np.ndarray, before: np.ndarray, mark: str) -> list[str]:
    """The text cut before the given positions, by way of a mark that it does not hold."""
    return str(np.insert(points, before, ord(mark)).tobytes(), "latin-1" if points.itemsize == 1 else "utf-32-le").split(mark)


class SpacedSplitter:
    """The matches of the byte-level pattern: a space belongs to the word after it."""

    def __init__(self, pattern: str):
        self.pattern = _exact(pattern)

    def __call__(self, text: str) -> list[str]:
        if not text:
            return []
        if "'" in text or "\0" in text:
            return _matches(self.pattern, text)
        points = codes(text)
        kind = classes()[points]
        begins = kind[1:] != kind[:-1]
        gap = kind == SPACE
        after = np.flatnonzero(gap[:-1] & ~gap[1:])  # the last white space before a word
        begins[after[points[after] == 32]] = False
        begins[after[after > 0] - 1] = True
        return _parted(points, np.flatnonzero(begins) + 1, "\0")

    def begins(self, texts: list[str], points: np.ndarray) -> np.ndarray:
        """Whether a match begins at each of ``points``, the code points of the texts one after another."""
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        first = np.zeros(len(points) + 1, bool)
        first[0] = True
        first[ends] = True
        kind, first = classes()[points], first[:-1]
        begins = first.copy()
        begins[1:] |= kind[1:] != kind[:-1]
        gap = kind == SPACE
        after = np.flatnonzero(gap[:-1] & ~gap[1:] & ~first[1:])  # the last white space before a word of the same text
        begins[after[points[after] == 32] + 1] = False
        begins[after] = True
        for text, end in zip(texts, ends.tolist()):
            if "'" in text:
                lengths = [len(m) for m in _matches(self.pattern, text)]
                begins[end - len(text) : end] = False
                begins[end - len(text) + np.cumsum([0, *lengths[:-1]])] = True
        return begins


class WordSplitter:
    """The words of the lower-casing pattern: letters, single digits, runs of signs; white space gives empty words."""

    def __init__(self, pattern: str = WORD_PATTERN):
        self.pattern = _exact(pattern)

    def __call__(self, text: str) -> list[str]:
        if not text:
            return []
        if "'" in text:
            return _matches(self.pattern, text)
        points = codes(text)
        kind = classes()[points]
        gap = kind == SPACE
        begins = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        begins &= ~(gap[1:] | gap[:-1])
        return _parted(np.where(gap, points.dtype.type(32), points), np.flatnonzero(begins) + 1, " ")
