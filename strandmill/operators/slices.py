"""Bit slices in a compressed form, and what is asked of them without undoing it.

A slice is the samples that have a position. It is stored in the shortest of these forms: the gaps between its samples
in 1, 2 or 4 bytes each, a bit set, or the gaps between the samples that lack the position. Many slices are written,
read and tested at once, by array operations. In files the lowest bytes of gaps and their other ones
are apart, as the former are as good as random and the latter hardly are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Forms of a slice: gaps of so many bytes, of the samples that are in it or (LACKING) that are not; or a bit set.
WIDTHS = np.array([1, 2, 4])
BITS, LACKING = 3, 4
#: Cells of a table of samples that is made at once.
CELLS = 1 << 24


def _width(greatest: np.ndarray) -> np.ndarray:
    """The form for gaps up to these: 0, 1 or 2."""
    return (greatest >= 1 << 8).astype(np.int64) + (greatest >= 1 << 16)


def ragged(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... for each stretch, one after another."""
    return np.repeat(begins - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def _gaps(samples: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    out = np.diff(samples.astype(np.int64), prepend=0) - 1
    out[cuts[:-1]] = samples[cuts[:-1]]
    return out


def _fill(out: np.ndarray, begins: np.ndarray, counts: np.ndarray, width: int, gaps: np.ndarray) -> None:
    """Writes the gaps of some slices that begin there."""
    at = np.repeat(begins - width * (np.cumsum(counts) - counts), counts) + width * np.arange(counts.sum())
    for i in range(width):
        out[at + i] = gaps >> 8 * i & 255


def encode(samples: np.ndarray, cuts: np.ndarray, domain: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(forms, lengths, bytes) of slices with samples below ``domain``, rising between the cuts; none is empty."""
    counts = np.diff(cuts)
    gaps = _gaps(samples, cuts)
    form = _width(np.maximum.reduceat(gaps, cuts[:-1]))
    lengths, bits = counts * WIDTHS[form], -(-domain // 8)
    dense = np.flatnonzero(lengths > bits)
    form[dense], lengths[dense] = BITS, bits
    parts: list[tuple] = []
    step = max(1, CELLS // domain)
    for i in range(0, len(dense), step):
        own = dense[i : i + step]
        table = np.zeros((len(own), domain), bool)
        table[np.repeat(np.arange(len(own)), counts[own]), samples[ragged(cuts[own], counts[own])]] = True
        sets = np.packbits(table, axis=1, bitorder="little")
        few = np.flatnonzero(domain - counts[own] < bits)  # those of which a list of what is lacking may be shorter
        row, lacking = np.nonzero(~table[few])
        missing = domain - counts[own[few]]
        ends = np.concatenate(([0], np.cumsum(missing)))
        some = missing > 0
        widest = np.zeros(len(few), np.int64)
        lacking_gaps = np.zeros(0, np.int64)
        if len(lacking):
            filled = np.append(ends[:-1][some], len(lacking))
            lacking_gaps = _gaps(lacking, filled)
            widest[some] = np.maximum.reduceat(lacking_gaps, filled[:-1])
        wide = _width(widest)
        less = missing * WIDTHS[wide] < bits
        form[own[few[less]]], lengths[own[few[less]]] = LACKING + wide[less], (missing * WIDTHS[wide])[less]
        parts.append((own, sets, few, less, wide, missing, row, lacking_gaps))
    begins = np.cumsum(lengths) - lengths
    out = np.zeros(int(lengths.sum()), np.uint8)
    for w, width in enumerate(WIDTHS.tolist()):
        own = np.flatnonzero(form == w)
        if len(own):
            _fill(out, begins[own], counts[own], width, gaps[ragged(cuts[own], counts[own])])
    for own, sets, few, less, wide, missing, row, lacking_gaps in parts:
        as_set = np.flatnonzero(form[own] == BITS)
        out[(begins[own[as_set]][:, None] + np.arange(bits)).ravel()] = sets[as_set].ravel()
        for w, width in enumerate(WIDTHS.tolist()):
            these = less & (wide == w)
            if these.any():
                _fill(out, begins[own[few[these]]], missing[these], width, lacking_gaps[these[row]])
    return form, lengths, out


def narrow(values: np.ndarray) -> bytes:
    """Numbers from 0 on as bytes of the least width that holds them all, the width in front."""
    top = int(values.max(initial=0))
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def widened(data: bytes | memoryview) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def rice(values: np.ndarray) -> bytes:
    """Numbers from 0 on in a Rice code: a byte that says how many low bits they have, their number in 4 bytes, the low bits, and the rest in unary.

    It takes about 2 bits a number more than the logarithm of their mean, which bytes of any width do not come near, compressed or not.
    """
    n, total = len(values), int(values.sum())
    low = max(0, (total // max(n, 1)).bit_length() - 1)
    low = min(range(max(low - 1, 0), low + 2), key=lambda r: n * r + int((values >> r).sum()))
    upper = values >> low
    ends = np.cumsum(upper + 1)
    unary = np.zeros(int(ends[-1]) if n else 0, np.uint8)
    unary[ends - 1] = 1
    table = values.astype("<u8").view(np.uint8).reshape(n, 8)[:, : -(-low // 8)]
    lower = np.unpackbits(table, axis=1, bitorder="little")[:, :low]
    return bytes([low]) + np.array(n, "<u4").tobytes() + np.packbits(lower.ravel(), bitorder="little").tobytes() + np.packbits(unary, bitorder="little").tobytes()


def of_rice(data: bytes | memoryview) -> np.ndarray:
    low, n = data[0], int(np.frombuffer(data, "<u4", 1, 1)[0])
    own = np.frombuffer(data, np.uint8, offset=5)
    split = -(-n * low // 8)
    out = np.diff(np.flatnonzero(np.unpackbits(own[split:], bitorder="little")), prepend=-1) - 1 << low
    if n and low:
        table = np.zeros((n, -(-low // 8) * 8), np.uint8)
        table[:, :low] = np.unpackbits(own[:split], count=n * low, bitorder="little").reshape(n, low)
        for i, byte in enumerate(np.packbits(table, axis=1, bitorder="little").T.astype(np.int64)):
            out |= byte << 8 * i
    return out


def _high_bytes(forms: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of the bytes of slices, which are not a gap's lowest."""
    width = WIDTHS[np.where(forms == BITS, 0, forms % LACKING)]
    n, begins = int(lengths.sum()), np.cumsum(lengths) - lengths
    offset = np.tile(np.arange(256, dtype=np.uint8), n // 256 + 1)[:n]
    offset -= np.repeat(begins.astype(np.uint8), lengths)
    offset &= np.repeat((width - 1).astype(np.uint8), lengths)
    return offset > 0


def parted(forms: np.ndarray, lengths: np.ndarray, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lowest bytes, their cuts, other bytes, their cuts) of slices, of which a stored row has those between two ``rows``."""
    high = _high_bytes(forms, lengths)
    ends = np.append(0, np.cumsum(lengths))[rows]
    counts = np.append(0, np.cumsum(high))[ends]
    return data[~high], ends - counts, data[high], counts


def woven(forms: np.ndarray, lengths: np.ndarray, low: bytes | memoryview, high: bytes | memoryview) -> np.ndarray:
    """The bytes of slices, of their lowest and other ones."""
    if not len(high):
        return np.frombuffer(low, np.uint8)
    out, which = np.empty(len(low) + len(high), np.uint8), _high_bytes(forms, lengths)
    out[~which], out[which] = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)
    return out


def lengths_of(forms: np.ndarray, counts: np.ndarray, domain: int) -> np.ndarray:
    """How many bytes each slice takes."""
    listed = np.where(forms > BITS, domain - counts, counts) * WIDTHS[np.where(forms == BITS, 0, forms % LACKING)]
    return np.where(forms == BITS, -(-domain // 8), listed)


@dataclass
class Slices:
    """Slices one after another in ``data``, of samples below their ``domain``."""

    forms: np.ndarray
    counts: np.ndarray
    domains: np.ndarray
    data: np.ndarray

    def __post_init__(self):
        lengths = lengths_of(self.forms, self.counts, self.domains)
        self.begins = np.cumsum(lengths) - lengths
        self._listed: np.ndarray | None = None

    def _list(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The samples that these slices list, and how many each."""
        listed = np.where(self.forms[own] > BITS, self.domains[own] - self.counts[own], self.counts[own])
        out = np.empty(int(listed.sum()), np.int64)
        places = np.cumsum(listed) - listed
        for w, width in enumerate(WIDTHS.tolist()):
            these = np.flatnonzero(self.forms[own] % LACKING == w)
            n = listed[these]
            at = np.repeat(self.begins[own[these]] - width * (np.cumsum(n) - n), n) + width * np.arange(n.sum())
            gap = np.zeros(len(at), np.int64)
            for i in range(width):
                gap |= self.data[at + i].astype(np.int64) << 8 * i
            ends = np.cumsum(gap + 1)
            before = np.cumsum(n) - n
            back = np.where(before > 0, ends[np.maximum(before - 1, 0)], 0) if len(ends) else before
            out[ragged(places[these], n)] = ends - 1 - np.repeat(back, n)
        return out, listed

    def samples(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The samples of each of these slices, and how many each has."""
        counts = self.counts[own]
        out, places = np.empty(int(counts.sum()), np.int64), np.cumsum(counts) - counts
        plain = np.flatnonzero(self.forms[own] < BITS)
        out[ragged(places[plain], counts[plain])] = self._list(own[plain])[0]
        for domain in np.unique(self.domains[own[self.forms[own] >= BITS]]).tolist():
            step = max(1, CELLS // domain)
            for form in (BITS, LACKING):
                these = np.flatnonzero((self.domains[own] == domain) & ((self.forms[own] == BITS) if form == BITS else (self.forms[own] > BITS)))
                for i in range(0, len(these), step):
                    some = these[i : i + step]
                    if form == BITS:
                        sets = self.data[self.begins[own[some]][:, None] + np.arange(-(-domain // 8))]
                        table = np.unpackbits(sets, axis=1, count=domain, bitorder="little").astype(bool)
                    else:
                        table = np.ones((len(some), domain), bool)
                        lacking, n = self._list(own[some])
                        table[np.repeat(np.arange(len(some)), n), lacking] = False
                    out[ragged(places[some], counts[some])] = np.nonzero(table)[1]
        return out, counts

    def hold(self, slices: np.ndarray, samples: np.ndarray) -> np.ndarray:
        """Whether each slice has the sample beside it; of bit sets only these bits are looked at."""
        if self._listed is None:
            own = np.flatnonzero(self.forms != BITS)
            listed, n = self._list(own)
            self._listed = np.repeat(own, n) << 32 | listed  # rising
        form = self.forms[slices]
        as_set = form == BITS
        byte = self.data[np.where(as_set, self.begins[slices] + (samples >> 3), 0)] if len(self.data) else np.zeros(len(slices), np.uint8)
        key = slices << 32 | samples
        at = np.searchsorted(self._listed, key)
        there = self._listed[np.minimum(at, len(self._listed) - 1)] == key if len(self._listed) else np.zeros(len(key), bool)
        return np.where(as_set, byte >> (samples & 7).astype(np.uint8) & 1 > 0, there ^ (form > BITS))
