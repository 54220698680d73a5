"""Token files: one array of ids, and where each document ends in it as Elias-Fano code.

A file is a table of blocks in the shared folder. Each block holds, in one binary value,

    magic "EFT2" | width u8 | 3 bytes 0 | ids u64 | documents without a doc_id u32 | 4 bytes 0 | least doc_id i64
    ids            ids * width bytes, little-endian
    ends           Elias-Fano code of the end of each document
    names          Elias-Fano code of each doc_id less the least one, of those that have one

and an Elias-Fano code of n numbers is

    n u32 | low bits u32 | upper words u32 | 4 bytes 0
    low parts      n * low bits, packed in u64 words
    upper parts    bit (number >> low bits) + i set for number i, in u64 words
    selects        u32: the bit position of each 256th set bit of the upper parts, padded to 8 bytes

With n documents of u ids in all, a boundary takes about 2 + log2(u / n) bits, and a doc_id as few bits as doc_ids lie
close together. Any boundary or doc_id is found from the nearest select sample by counting set bits in a few words;
readers select what they read. Blocks lie in ascending document order; a manifest gives the ids before each block.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandmill.llm.libtokens import library_encoder
from strandmill.llm.packing import widened
from strandmill.llm.shared import Then, mapped, text_passes

HEAD, CODE = struct.Struct("<4sB3xQI4xq"), struct.Struct("<III4x")
SAMPLE = 256


class EliasFano:
    """A non-decreasing sequence of n numbers up to u; ``select`` gives any of them, ``all`` every one."""

    def __init__(self, n: int, bits: int, low: np.ndarray, upper: np.ndarray, samples: np.ndarray):
        self.n, self.bits, self.low, self.upper, self.samples = n, bits, low, upper, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, u = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, (u // n).bit_length() - 1) if n else 0
        low = np.zeros((n * bits + 63) // 64, np.uint64)
        if bits:
            part = values & np.uint64((1 << bits) - 1)
            planes = ((part[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
            low = np.packbits(np.pad(planes, (0, -len(planes) % 64)), bitorder="little").view("<u8")
        at = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        plane = np.zeros((int(at[-1]) // 64 + 1) * 64 if n else 0, np.uint8)
        plane[at] = 1
        return cls(n, bits, low, np.packbits(plane, bitorder="little").view("<u8"), at[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        samples = self.samples.tobytes()
        return b"".join((CODE.pack(self.n, self.bits, len(self.upper)), self.low.tobytes(), self.upper.tobytes(), samples, bytes(-len(samples) % 8)))

    @classmethod
    def from_bytes(cls, data: bytes, at: int) -> tuple[EliasFano, int]:
        """The code that begins at a place, and where it ends."""
        n, bits, words = CODE.unpack_from(data, at)
        low = np.frombuffer(data, "<u8", (n * bits + 63) // 64, at := at + CODE.size)
        upper = np.frombuffer(data, "<u8", words, at := at + low.nbytes)
        samples = np.frombuffer(data, "<u4", -(-n // SAMPLE), at := at + upper.nbytes)
        return cls(n, bits, low, upper, samples), at + samples.nbytes + samples.nbytes % 8

    def all(self) -> np.ndarray:
        at = np.flatnonzero(np.unpackbits(self.upper.view(np.uint8), bitorder="little"))[: self.n]
        high = (at - np.arange(self.n)).astype(np.uint64)
        if not self.bits:
            return high
        planes = np.unpackbits(self.low.view(np.uint8), bitorder="little")[: self.n * self.bits].reshape(self.n, self.bits)
        return (high << np.uint64(self.bits)) | (planes.astype(np.uint64) << np.arange(self.bits, dtype=np.uint64)).sum(1, dtype=np.uint64)

    def select(self, i: int) -> int:
        """The i-th number, from the select sample before it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        start, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        word = start // 64
        bits = int(self.upper[word]) >> start % 64 << start % 64
        while (held := bits.bit_count()) <= left:
            left, word = left - held, word + 1
            bits = int(self.upper[word])
        for _ in range(left):
            bits &= bits - 1
        high = word * 64 + (bits & -bits).bit_length() - 1 - i
        low, at = 0, i * self.bits
        if self.bits:
            low = int(self.low[at // 64]) >> at % 64
            if at % 64 + self.bits > 64:
                low |= int(self.low[at // 64 + 1]) << 64 - at % 64
            low &= (1 << self.bits) - 1
        return high << self.bits | low


class TokenBlock:
    """One block: ``ids`` of all its documents, ``ends`` and ``names`` as Elias-Fano code; the first documents may have no name."""

    def __init__(self, ids: np.ndarray, ends: EliasFano, nameless: int, least: int, names: EliasFano):
        self.ids, self.ends, self.nameless, self.least, self.names = ids, ends, nameless, least, names

    @classmethod
    def of(cls, ids: np.ndarray, ends: np.ndarray, names: list[int | None]) -> TokenBlock:
        """``names``: doc_ids in ascending order, None first."""
        nameless = names.count(None)
        least = names[nameless] if nameless < len(names) else 0
        return cls(ids, EliasFano.of(ends), nameless, least, EliasFano.of(np.array([x - least for x in names[nameless:]], np.uint64)))

    def to_bytes(self) -> bytes:
        head, ids = HEAD.pack(b"EFT2", self.ids.dtype.itemsize, len(self.ids), self.nameless, self.least), self.ids.tobytes()
        return b"".join((head, ids, self.ends.to_bytes(), self.names.to_bytes()))

    @classmethod
    def from_bytes(cls, data: bytes) -> TokenBlock:
        magic, width, total, nameless, least = HEAD.unpack_from(data)
        if magic != b"EFT2":
            raise ValueError("not a token block")
        ids = np.frombuffer(data, f"<u{width}", total, HEAD.size)
        ends, at = EliasFano.from_bytes(data, HEAD.size + ids.nbytes)
        return cls(ids, ends, nameless, least, EliasFano.from_bytes(data, at)[0])

    def name(self, i: int) -> int | None:
        return None if i < self.nameless else self.least + self.names.select(i - self.nameless)

    def bounds(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def document(self, i: int) -> np.ndarray:
        begin, end = self.bounds(i)
        return self.ids[begin:end]


def write_token_file(docs: DataFrame, path: str, file: str, pattern: str | None, *, end: int | None = 2, block_ids: int = 1 << 20) -> None:
    """Encodes ``docs`` (doc_id, text) by the tokenizer ``file`` and writes a token file at ``path``.

    Documents lie in ascending doc_id order (null first; rows that repeat stay side by side). A null text is empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = library_encoder(file, pattern, end), TaskContext.get().partitionId()
        names, held, total, seq = [], [], 0, 0

        def block():
            ends = np.cumsum([len(x) // encoder.kind.itemsize for x in held], dtype=np.uint64)
            data = TokenBlock.of(np.frombuffer(b"".join(held), encoder.kind), ends, names).to_bytes()
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | seq], pa.int64()), pa.array([int(ends[-1])], pa.int64()), pa.array([data], pa.binary())], names=["block", "n_ids", "data"])

        for batch, texts in text_passes(batches):
            for name, ids in zip(batch.column("doc_id").to_pylist(), encoder.packed(texts)):
                held.append(ids)
                names.append(name)
                total += len(held[-1]) // encoder.kind.itemsize
                if total >= block_ids:
                    yield block()
                    names, held, total, seq = [], [], 0, seq + 1
        if held:
            yield block()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").orderBy("doc_id")
    blocks = ordered.mapInArrow(run, "block bigint, n_ids bigint, data binary")
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")
    spark = docs.sparkSession
    sizes = spark.read.parquet(f"{path}/blocks").select("block", "n_ids", F.shiftright("block", 32).alias("task"))

    def before(n: str, window) -> Column:
        return F.coalesce(F.sum(n).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    # Blocks are summed up within the task that wrote them, and tasks, a row each, over all.
    tasks = sizes.groupBy("task").agg(F.sum("n_ids").alias("n")).select("task", before("n", Window.orderBy("task")).alias("first"))
    sizes = sizes.withColumn("within", before("n_ids", Window.partitionBy("task").orderBy("block"))).join(tasks, "task")
    sizes.select("block", (F.col("first") + F.col("within")).alias("before")).write.parquet(f"{path}/manifest")


def read_token_file(spark: SparkSession, path: str, then: Then | None = None) -> DataFrame:
    """Every document of a token file, from the file alone: (block, doc_id, offset, n_tokens, ids binary, little-endian uint32).

    ``then``: what is made of each batch of these before it leaves its task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data")):
                held = TokenBlock.from_bytes(data.as_py())
                rows, a = [], 0
                for i in range(held.ends.n):
                    b = held.ends.select(i)
                    rows.append((block, held.name(i), a, b - a, widened(held.ids[a:b].tobytes(), b - a)))
                    a = b
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["block", "doc_id", "offset", "n_tokens", "ids"])

    return mapped(spark.read.parquet(f"{path}/blocks").select("block", "data"), run, "block bigint, doc_id bigint, offset bigint, n_tokens bigint, ids binary", then)


def _crcs(b: pa.RecordBatch) -> pa.RecordBatch:
    crcs = pa.array([zlib.crc32(x.as_buffer()) for x in b.column("ids")], pa.int64())
    return pa.RecordBatch.from_arrays([*(b.column(c) for c in ("block", "doc_id", "offset", "n_tokens")), crcs], names=["block", "doc_id", "offset", "n_tokens", "ids_crc32"])


def located(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (the ids of all documents before it), n_tokens and the CRC-32 of the ids, from a token file."""
    found = read_token_file(spark, path, Then(_crcs, "block bigint, doc_id bigint, offset bigint, n_tokens bigint, ids_crc32 bigint"))
    return found.join(spark.read.parquet(f"{path}/manifest"), "block").select("doc_id", (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
