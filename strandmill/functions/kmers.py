"""k-mers of byte strings and their Bloom-filter positions, by array operations.

A k-mer is any window of k bytes of a sequence's UTF-8 form. Of a nucleotide sequence the smaller of the window and
its reverse complement counts. Positions are MurmurHash64A with seeds 0 to h - 1, modulo m, unsigned. Below 8 bytes a
k-mer is only XORed with the seed, so k-mers that differ in the lowest bits of their first byte share positions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MULTIPLY = np.uint64(0xC6A4A7935BD1E995)  # MurmurHash64A's constants are fixed values
SHIFT = np.uint64(47)

#: What pairs with each base, in upper and lower case; every other byte pairs with 0. Fixed values.
PAIRS = {"A": "T", "C": "G", "G": "C", "T": "A", "U": "A", "N": "N", "a": "t", "c": "g", "g": "c", "t": "a", "u": "a"}
COMPLEMENT = np.zeros(256, np.uint8)
for _base, _pair in PAIRS.items():
    COMPLEMENT[ord(_base)] = ord(_pair)


def reverse_complement(sequence: bytes) -> bytes:
    return COMPLEMENT[np.frombuffer(sequence, np.uint8)[::-1]].tobytes()


def _words(data: np.ndarray, n: int, k: int, big: bool) -> list[np.ndarray]:
    """The windows' bytes as 64-bit words, one array per 8 bytes; a last short word has its bytes at the low end
    (little-endian), or at the high end if ``big``."""
    word = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64)
    for step in (1, 2, 4):  # words of 2, 4, then 8 bytes from every place
        ahead, width = word[step:], np.uint64(8 * step)
        here = word[: len(ahead)]
        word = (here << width) | ahead if big else here | (ahead << width)
    out = [word[begin : begin + n] for begin in range(0, k, 8)]
    if rest := k % 8:
        gone = np.uint64(64 - 8 * rest)
        out[-1] = out[-1] >> gone << gone if big else out[-1] << gone >> gone
    return out


def windows(sequence: bytes | np.ndarray, k: int, canonical: bool) -> list[np.ndarray]:
    """The k-mers in order as little-endian words; ``canonical``: each the smaller of itself and its complement."""
    data = sequence if isinstance(sequence, np.ndarray) else np.frombuffer(sequence, np.uint8)
    n = len(data) - k + 1
    if n <= 0:
        return [np.zeros(0, np.uint64)] * -(-k // 8)
    own = _words(data, n, k, False)
    if not canonical:
        return own
    back = COMPLEMENT[data[::-1]]
    smaller, settled = np.zeros(n, bool), np.zeros(n, bool)
    for a, b in zip(_words(data, n, k, True), _words(back, n, k, True)):
        b = b[::-1]
        smaller |= ~settled & (b < a)
        settled |= a != b
    return [np.where(smaller, b[::-1], a) for a, b in zip(own, _words(back, n, k, False))]


def murmur64a(words: list[np.ndarray], length: int, seeds: int) -> np.ndarray:
    """(seeds, k-mers) of uint64 hashes of k-mers given as little-endian words."""
    whole = length // 8
    mixed = []
    for w in words[:whole]:
        w = w * MULTIPLY
        mixed.append((w ^ (w >> SHIFT)) * MULTIPLY)
    out = np.empty((seeds, len(words[0]) if words else 0), np.uint64)
    for seed in range(seeds):
        h = np.full(out.shape[1], np.uint64(seed ^ (length * int(MULTIPLY)) % (1 << 64)))
        for w in mixed:
            h = (h ^ w) * MULTIPLY
        if length % 8:
            h = (h ^ words[whole]) * MULTIPLY
        h = (h ^ (h >> SHIFT)) * MULTIPLY
        out[seed] = h ^ (h >> SHIFT)
    return out


def _below(hashes: np.ndarray, m: int) -> np.ndarray:
    return (hashes & np.uint64(m - 1) if m & (m - 1) == 0 else hashes % np.uint64(m)).astype(np.int64)


def positions(sequence: bytes, k: int, h: int, m: int, canonical: bool) -> np.ndarray:
    """(h, k-mers) of Bloom-filter positions below m, as int64, in the order of the k-mers."""
    return _below(murmur64a(windows(sequence, k, canonical), k, h), m)


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings, one after another as Arrow holds them, and where each begins (and the last ends)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    begins = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[begins[0] : begins[-1]], begins - begins[0]


def batch_windows(data: np.ndarray, begins: np.ndarray, k: int, canonical: bool, piece: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """(k-mers as of ``windows``, record) of many records that stand one after another, ``piece`` bytes at a time.

    All windows of a piece are made at once, whatever records they lie in; those across two records are left out.
    """
    lengths = np.diff(begins)
    for at in range(0, max(len(data) - k + 1, 0), piece):
        stop = min(at + piece, len(data) - k + 1)
        first, last = int(np.searchsorted(begins, at, "right")) - 1, int(np.searchsorted(begins, stop, "left"))
        low, high = np.maximum(begins[first:last], at), np.minimum(begins[first:last] + lengths[first:last] - k + 1, stop)
        n = np.maximum(high - low, 0)
        if not n.any():
            continue
        words = windows(data[at : stop + k - 1], k, canonical)
        record = np.repeat(np.arange(first, last), n)
        if len(record) < stop - at:
            inside = np.repeat(low - at - (np.cumsum(n) - n), n) + np.arange(len(record))
            words = [w[inside] for w in words]
        yield words, record


def batch_positions(data: np.ndarray, begins: np.ndarray, k: int, h: int, m: int, canonical: bool, piece: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, record) of the k-mers of ``batch_windows``: (h, k-mers) as of ``positions``, and the number of each one's record."""
    for words, record in batch_windows(data, begins, k, canonical, piece):
        yield _below(murmur64a(words, k, h), m), record


def kmer_bytes(words: list[np.ndarray], k: int) -> pa.Array:
    """The k-mers of ``windows`` as they are, as binary values."""
    rows = np.ascontiguousarray(np.stack(words, axis=1).astype("<u8")).view(np.uint8).reshape(len(words[0]), -1)[:, :k]
    return pa.Array.from_buffers(pa.binary(k), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def canonical_kmer(kmer: bytes) -> bytes:
    return min(kmer, reverse_complement(kmer))


def kmers(sequence: bytes, k: int, canonical: bool) -> list[bytes]:
    every = (sequence[i : i + k] for i in range(len(sequence) - k + 1))
    return [canonical_kmer(x) for x in every] if canonical else list(every)
