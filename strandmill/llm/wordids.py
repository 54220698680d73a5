"""Ids of words, kept in flat arrays and looked up a whole pass of text at once.

A word of at most 15 bytes is two numbers: its first 8 bytes, and the other 7 with its length. So words are compared
exactly and no object is made of a word that is kept from before; longer words are kept by their bytes.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np

from strandmill.llm.flat import MIX, Rows
from strandmill.llm.segment import SpacedSplitter, codes

SHORT = 15
#: What of 8 bytes belongs to a word that has that many of them.
MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Words that are looked up at once.
STEP = 1 << 18


def _keys(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both numbers of words of at most 15 bytes; ``data`` has 16 bytes after the last word."""
    eights = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    low = eights[starts] & MASK[np.minimum(lengths, 8)]
    return low, eights[starts + 8] & MASK[np.maximum(lengths, 8) - 8] | lengths.astype(np.uint64) << np.uint64(56)


def _places(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places of each run of ``counts`` from ``begins`` on, one run after another."""
    ends = np.cumsum(counts)
    return np.repeat(begins - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


class KeptWords:
    """Words and their ids: short ones by open addressing, at most half full, 20 bytes a slot; words are numbered from 0 on."""

    def __init__(self, kind: np.dtype):
        self.bits, self.n_short, self.long = 10, 0, {}
        self.ids, self.ends = Rows(kind), Rows(np.int64)  # word i has the ids from ends[i] up to ends[i + 1]
        self.ends.add(np.zeros(1, np.int64))
        self._clear()

    def _clear(self) -> None:
        self.low, self.high, self.word = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)

    def __len__(self) -> int:
        return self.ends.n - 1

    def _home(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        mixed = low * MIX
        return (((mixed ^ mixed >> np.uint64(32)) + high) * MIX >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The number of each short word; -1 for those that are not kept."""
        at, last = self._home(low, high), len(self.low) - 1
        own = self.high[at]
        hit = (own == high) & (self.low[at] == low)
        out = np.where(hit, self.word[at], np.int32(-1))
        todo = np.flatnonzero(~hit & (own != 0))
        at = at[todo]
        while len(todo):
            at = at + 1 & last
            own = self.high[at]
            hit = (own == high[todo]) & (self.low[at] == low[todo])
            out[todo[hit]] = self.word[at[hit]]
            more = np.flatnonzero(~hit & (own != 0))
            todo, at = todo[more], at[more]
        return out

    def _put(self, low: np.ndarray, high: np.ndarray, words: np.ndarray) -> None:
        at, last, todo = self._home(low, high), len(self.low) - 1, np.arange(len(low))
        while len(todo):
            free = todo[self.high[at[todo]] == 0]
            self.word[at[free]] = words[free]  # of those that want one slot the last has it
            won = free[self.word[at[free]] == words[free]]
            self.low[at[won]], self.high[at[won]] = low[won], high[won]
            lost = np.ones(len(low), bool)
            lost[won] = False
            todo = todo[lost[todo]]
            at[todo] = at[todo] + 1 & last

    def _append(self, counts: np.ndarray, ids: np.ndarray) -> int:
        self.ids.add(ids)
        return self.ends.add(self.ends.all[self.ends.n - 1] + np.cumsum(counts)) - 1

    def put(self, low: np.ndarray, high: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The numbers of short words that are all different and not there yet; ``ids`` of all, one after another."""
        if 2 * (self.n_short + len(low)) > len(self.low):
            old = np.flatnonzero(self.high)
            held = self.low[old], self.high[old], self.word[old]
            self.bits = (2 * (self.n_short + len(low)) - 1).bit_length()
            self._clear()
            self._put(*held)
        words = self._append(counts, ids) + np.arange(len(low), dtype=np.int32)
        self.n_short += len(low)
        self._put(low, high, words)
        return words

    def put_long(self, word: bytes, ids: np.ndarray) -> int:
        self.long[word] = at = self._append(np.array([len(ids)]), ids)
        return at

    def spelled(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and all of these."""
        begins = self.ends.all[words]
        counts = self.ends.all[words + 1] - begins
        return counts, self.ids.all[_places(begins, counts)]


class WordIds:
    """Ids of texts, by ``many`` for each different word of the splitter.

    ``many`` gets the bytes of words one after another and where each ends, and gives the ids of each. About ``limit``
    words are kept: when the young half is full, those not used since go.
    """

    def __init__(self, split: SpacedSplitter, many: Callable[[np.ndarray, np.ndarray], list[list[int]]], kind: np.dtype, limit: int):
        self.split, self.many, self.kind, self.half = split, many, kind, limit // 2
        self.young, self.old = KeptWords(kind), KeptWords(kind)

    def _made(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The numbers that short words get which the young half lacks."""
        order = np.lexsort((low, high))
        new = np.ones(len(order), bool)
        new[1:] = (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]])
        each = order[new]
        before = self.old.get(low[each], high[each])
        made, again = each[before < 0], each[before >= 0]
        ids = self.many(data[_places(starts[made], lengths[made])], np.cumsum(lengths[made]))
        counts, moved = self.old.spelled(before[before >= 0])
        counts = np.concatenate((np.array(list(map(len, ids)), np.int64), counts))
        fresh = np.array(list(chain.from_iterable(ids)), self.kind)
        both, numbers = np.concatenate((made, again)), np.empty(len(low), np.int32)
        numbers[both] = self.young.put(low[both], high[both], counts, np.concatenate((fresh, moved)))
        out = np.empty(len(low), np.int32)
        out[order] = numbers[each][np.cumsum(new) - 1]
        return out

    def _long(self, word: np.ndarray) -> int:
        key = word.tobytes()
        if (at := self.young.long.get(key)) is None:
            before = self.old.long.get(key)
            ids = np.array(self.many(word, np.array([len(word)]))[0], self.kind) if before is None else self.old.spelled(np.array([before]))[1]
            at = self.young.put_long(key, ids)
        return at

    def _ids(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and all of these."""
        if len(self.young) > self.half or self.young.ids.n > 16 * self.half:
            self.young, self.old = KeptWords(self.kind), self.young
        low, high = _keys(data, starts, np.minimum(lengths, SHORT))
        short = lengths <= SHORT
        found = np.full(len(starts), -1, np.int32)
        found[short] = self.young.get(low[short], high[short])
        lacking = np.flatnonzero(short & (found < 0))
        if len(lacking):
            found[lacking] = self._made(data, starts[lacking], lengths[lacking], low[lacking], high[lacking])
        longer = np.flatnonzero(~short)
        found[longer] = [self._long(data[a : a + n]) for a, n in zip(starts[longer].tolist(), lengths[longer].tolist())]
        return self.young.spelled(found)

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, little-endian."""
        sizes = np.array([0, *map(len, texts)])
        points = codes(text := "".join(texts))
        begins = np.flatnonzero(self.split.begins(texts, points))
        first = np.searchsorted(begins, np.cumsum(sizes))  # of each text's words, and at the end of all
        data = np.frombuffer(text.encode() + bytes(16), np.uint8)
        lengths = np.diff(begins, append=len(points))
        if len(data) - 16 > len(points):
            more = np.zeros(len(points), np.uint8)  # bytes of a character beyond its first
            for least in (0x80, 0x800, 0x10000) if points.itemsize > 1 else (0x80,):
                more += points >= least
            lengths += np.add.reduceat(more, begins, dtype=np.int64)
        starts = np.cumsum(lengths) - lengths
        found = [self._ids(data, starts[i : i + STEP], lengths[i : i + STEP]) for i in range(0, len(starts), STEP)]
        ends = np.cumsum(np.concatenate((np.zeros(1, np.int64), *(counts for counts, _ in found))))[first] * self.kind.itemsize
        ids = b"".join(x.tobytes() for _, x in found)
        return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
