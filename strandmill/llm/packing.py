"""Packing token sequences into windows by best-fit decreasing.

Documents longer than a window are first cut into full windows, each a sequence of its own. What is left of each
document goes, longest first, into the open window with the least room that holds it: a segment tree over the
remaining capacities finds it in log2(window) steps. A task packs what it reads in rounds of bounded size, so no row
is shuffled and memory is bounded. What lies in windows that a round leaves less than nearly full goes into the next
round; after a task's last one it is cut anew into full windows, and the rest of these into powers of two, which need
no padding. So the padding does not depend on how many tasks there are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from strandmill.llm.libtokens import library_encoder
from strandmill.llm.shared import Then, mapped, text_passes


class OpenWindows:
    """Open windows by remaining capacity; ``take`` finds the tightest that holds a length."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.of: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, room: int, by: int) -> None:
        at = room + self.leaves
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, room: int, window: int) -> None:
        self.of[room].append(window)
        self._add(room, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """(room, window) of the least room >= length, removed; None if there is none."""
        at, count = length + self.leaves, self.count
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if count[2 * at] else 2 * at + 1
        room = at - self.leaves
        self._add(room, -1)
        return room, self.of[room].pop()


def best_fit_decreasing(lengths: list[int], window: int, first: int = 0) -> tuple[list[int], list[int], int]:
    """For each length its window and offset, and the number after the last window; windows count from ``first``."""
    windows, offsets, room = [0] * len(lengths), [0] * len(lengths), OpenWindows(window)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        if not 0 < n <= window:
            raise ValueError(f"a length is 1 to {window}")
        left, at = room.take(n) or (window, first)
        first += at == first
        windows[i], offsets[i] = at, window - left
        if left > n:
            room.put(left - n, at)
    return windows, offsets, first


def refilled(lengths: list[int], window: int) -> list[tuple[int, int, int, int]]:
    """(item, begin, length, sequence) of cuts that put items one after another into full windows and, for what is left
    of the last, into sequences of falling powers of two."""
    full, rest = divmod(sum(lengths), window)
    rooms = [window] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    out, sequence, left = [], 0, rooms[0] if rooms else 0
    for i, n in enumerate(lengths):
        begin = 0
        while begin < n:
            take = min(left, n - begin)
            out.append((i, begin, take, sequence))
            begin, left = begin + take, left - take
            if not left:
                sequence += 1
                left = rooms[sequence] if sequence < len(rooms) else 0
    return out


def pack_documents(docs: DataFrame, file: str, *, window: int = 2048, end: int | None = 1, pattern: str | None = None, round_tokens: int = 8_000_000, full: float = 31 / 32, then: Then | None = None) -> DataFrame:
    """Every piece of every document: (doc_id, start, length, ids binary, doc_tokens, sequence_id, offset).

    A document is its text's ids by the tokenizer ``file``, then ``end``; null text is empty. Its full windows come
    first, the rest is one piece, which is cut only if its window is less than ``full`` at the end. Ids of a piece are
    little-endian, 2 bytes each if the vocabulary allows, else 4. Sequences are numbered within each task from
    task << 40; a sequence's pieces fill it from offset 0 without gaps, and a sequence holds ``full`` of a window at
    least or a power of two of ids. Repeated rows are packed each; without ``end``, a document without ids has no
    piece. Null ids of documents stay. ``then``: what is made of each batch of these before it leaves its task, such
    as ``DIGESTS``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(file, pattern, end)
        width, number = encoder.kind.itemsize, TaskContext.get().partitionId() << 40
        step = window * width
        held: list[tuple] = []  # (doc_id, start, ids, doc_tokens)
        tokens = 0

        def batch(pieces: list[tuple]) -> Iterator[pa.RecordBatch]:
            kinds = (kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            for i in range(0, len(pieces), 20_000):
                columns = zip(*((doc, start, len(ids) // width, ids, total, at, offset) for (doc, start, ids, total), at, offset in pieces[i : i + 20_000]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, tokens, number
            out = []
            for x in held:
                if len(x[2]) == step:
                    out.append((x, number, 0))
                    number += 1
            rest = [x for x in held if len(x[2]) < step]
            found, offsets, after = best_fit_decreasing([len(x[2]) // width for x in rest], window, number)
            filled = [0] * (after - number)
            for x, a in zip(rest, found):
                filled[a - number] += len(x[2]) // width
            loose = []
            for x, a, offset in zip(rest, found, offsets):
                if filled[a - number] >= full * window:
                    out.append((x, a, offset))
                else:
                    loose.append(x)
            number, held = after, [] if last else loose
            if last:
                offset, before = 0, -1
                for i, begin, n, sequence in refilled([len(x[2]) // width for x in loose], window):
                    doc, start, ids, total = loose[i]
                    offset = offset if sequence == before else 0
                    out.append(((doc, start + begin, ids[begin * width : (begin + n) * width], total), number + sequence, offset))
                    offset, before = offset + n, sequence
            tokens = sum(len(x[2]) // width for x in held)
            yield from batch(out)

        kind = None
        for part, texts in text_passes(batches):
            kind = part.schema.field("doc_id").type
            for doc, ids in zip(part.column("doc_id").to_pylist(), encoder.packed(texts)):
                total = len(ids) // width
                held += [(doc, i // width, ids[i : i + step], total) for i in range(0, len(ids), step)]
                tokens += total
            if tokens >= round_tokens:
                yield from flush(False)
        if held:
            yield from flush(True)

    given = docs.select("doc_id", "text")
    return mapped(given, run, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint", then)


def _digests(b: pa.RecordBatch) -> pa.RecordBatch:
    """The pieces with the CRC-32 of their ids as little-endian uint32 in place of the ids."""
    crcs = [zlib.crc32(widened(x.as_py(), n.as_py())) for x, n in zip(b.column("ids"), b.column("length"))]
    return pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "start", "length")), pa.array(crcs, pa.int64()), *(b.column(c) for c in ("doc_tokens", "sequence_id", "offset"))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


DIGESTS = Then(_digests, "doc_id {doc_id}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")


def widened(ids: bytes, n: int) -> bytes:
    """Packed ids as little-endian uint32."""
    return ids if len(ids) == 4 * n else np.frombuffer(ids, "<u2").astype("<u4").tobytes()
