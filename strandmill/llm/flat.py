"""Maps and rows held in flat arrays, asked and filled many at a time."""

from __future__ import annotations

import numpy as np

MIX = np.uint64(0x9E3779B97F4A7C15)


class FlatMap:
    """Positive 64-bit keys to numbers from 0 on, by open addressing; at most half full, 16 bytes a slot."""

    def __init__(self, bits: int = 12):
        self.bits, self.n = bits, 0
        self.keys, self.held = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int64)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """What each key has; -1 for those that are not there."""
        at, last = self._home(keys), len(self.keys) - 1
        own = self.keys[at]
        out = np.where(own == keys, self.held[at], -1)
        todo = np.flatnonzero((own != keys) & (own != 0))
        at = at[todo]
        while len(todo):
            at = (at + 1) & last
            own = self.keys[at]
            hit = own == keys[todo]
            out[todo[hit]] = self.held[at[hit]]
            more = np.flatnonzero(~hit & (own != 0))
            todo, at = todo[more], at[more]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds keys that are all different and not there yet."""
        if 2 * (self.n + len(keys)) > len(self.keys):
            old = self.keys != 0
            old_keys, old_held = self.keys[old], self.held[old]
            self.__init__(max(self.bits + 1, (2 * (self.n + len(keys))).bit_length()))
            self.put(old_keys, old_held)
        self.n += len(keys)
        at, last, todo = self._home(keys), len(self.keys) - 1, np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[at[todo]] == 0]
            self.keys[at[free]] = keys[free]  # of those that want one slot the last has it
            won = self.keys[at[todo]] == keys[todo]
            self.held[at[todo[won]]] = values[todo[won]]
            todo = todo[~won]
            at[todo] = (at[todo] + 1) & last


class Rows:
    """An array that grows by rows at its end."""

    def __init__(self, kind, width: int | None = None, fill: int = 0):
        self.fill, self.n = fill, 0
        self.all = np.full(64 if width is None else (64, width), fill, kind)

    def add(self, rows: np.ndarray) -> int:
        """Where the first of the rows lies."""
        first, self.n = self.n, self.n + len(rows)
        if self.n > len(self.all):
            more = np.full((2 * self.n, *self.all.shape[1:]), self.fill, self.all.dtype)
            more[:first] = self.all[:first]
            self.all = more
        self.all[first : self.n] = rows
        return first

    def widen(self, width: int) -> None:
        more = np.full((len(self.all), width), self.fill, self.all.dtype)
        more[:, : self.all.shape[1]] = self.all
        self.all = more
