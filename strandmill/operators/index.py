"""Building, appending to, merging, opening and summing up a bit-slice index.

An index is a folder of Parquet tables: ``samples``, ``postings`` and ``meta``, one row per batch. What is stored are
rows of a narrow range of positions each (``fine``): the positions that any sample has, how many samples each has, and
their slices in a compressed form.

A batch without very long samples is laid out by groups of samples: the records are sorted by their samples' numbers,
and a task hashes GROUP_PAIRS positions of whole samples at a time and stores them as
they are, so that no position is shuffled, and what a search finds of a sample is found in one place.

Any other batch is laid out by position, in one pass over its records: each task hashes whole Arrow batches of them,
drops positions that a sample has already given, and packs what is left into arrays, one per slab, an even range of bit
positions, as codes of their gaps. Hashes are uniform, so slabs need no sampling to be even; they are sized by the bytes to be hashed. The
arrays go to the task of their bucket, a run of slabs, and are merged there slab by slab. Buckets are folders, so a
search reads only those that its positions lie in, and of these only the row groups with its ranges, if they are few.

An update writes a new batch and rewrites nothing. A batch claims its number first and counts once its meta row is
there, which is written last. Adjacent batches are merged into one in the same way: its meta row names those that it
replaces, and makes it count in their place at one stroke; searches that began before still find the old ones. Rows by
groups in large files are not written again by that: the meta row names the folders that a batch ``holds`` them in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import UTC, datetime
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandmill.functions.kmers import batch_positions, joined
from strandmill.operators.slices import Slices, encode, lengths_of, narrow, of_rice, parted, rice, widened, woven
from strandmill.plans.config import Config
from strandmill.storage import claim, exists, located, remove, shared_path

SLAB_PAIRS, FINE, MOST_BUCKETS = 1 << 21, 512, 4096
FLUSH_PAIRS = 1 << 22
#: Positions, with repeats, of one group of samples: in a larger one more samples share a position, which then is stored once.
GROUP_PAIRS, GROUP_SLABS = 1 << 25, 4
#: Positions of the longest sample that is laid out by groups.
SAMPLE_PAIRS = 1 << 23
#: Pairs of a position and a sample that a group sorts at once while it is gathered, and of it that are stored at once.
RUN_PAIRS, STORED_PAIRS = 1 << 21, 1 << 20
#: Bytes of a sample's records that are compressed together, and of records that are undone at once.
SQUEEZED, UNDONE = 1 << 20, 1 << 22
#: Mean bytes of a folder's files from which on rows by groups are not written again, but held where they are.
LARGE_FILES = 1 << 23
#: Stored rows that a reader makes Python values of at once.
ROWS = 64
#: Bytes that are hashed at once; what is worked on then stays in a processor's cache.
PIECE = 1 << 16

#: ``n``: how many pairs a row has, in ``packed_pairs``; null in matrices from before these, which hold plain numbers.
PACKED = "slab bigint, part int, offsets binary, samples binary, n int"
ROW = "fine bigint, part int, domain bigint, gaps binary, counts binary, forms binary, slices binary, slices_high binary"
STORED = f"bucket int, {ROW}"
META = "batch_id int, k int, h int, m bigint, sequence_type string, slabs bigint, n_samples bigint, n_bytes bigint, created_on string, last_updated_on string, level int, replaces array<int>, token string, grouped boolean, holds array<struct<store:string,batch:int,first:bigint>>"
GRID = "k int, h int, m bigint, sequence_type string, slabs bigint, grouped boolean"


class Grid:
    """How m positions are cut: ``slabs`` even ranges of FINE fine ones each, and ``buckets`` runs of slabs.

    ``grouped``: of a batch laid out by groups of samples; a row's ``part`` is then its group's first sample.
    """

    #: Samples of one row, a bound for arrays of positions that every sample has, as a power of two.
    part_bits = 22

    def __init__(self, m: int, slabs: int, grouped: bool = False):
        self.m, self.slabs, self.grouped, self.buckets = m, slabs, grouped, 1 if grouped else min(slabs, MOST_BUCKETS)
        if grouped:
            self.part_bits = 0
        self.width = -(-m // slabs)
        self.fine = -(-self.width // FINE)
        self.offset = np.dtype("<u4" if self.width < 1 << 32 else "<u8")

    @classmethod
    def of(cls, m: int, pairs: int) -> Grid:
        return cls(m, 1 << min(20, (max(pairs // SLAB_PAIRS, 1) - 1).bit_length()))

    def bucket(self, slab):
        return slab * self.buckets // self.slabs

    def fine_of(self, bits: np.ndarray) -> np.ndarray:
        slab = bits // self.width
        return slab * FINE + (bits - slab * self.width) // self.fine

    def begin(self, slab: int) -> int:
        return slab * self.width

    def fine_begin(self, fine):
        return self.begin(fine // FINE) + fine % FINE * self.fine


def sample_bits(records: DataFrame, k: int, h: int, m: int, canonical: bool, wanted: np.ndarray | None = None, key: str = "sample_idx") -> DataFrame:
    """(key, bit): the Bloom-filter positions of each record of (key, seq), distinct in each piece of a batch.

    ``wanted``: sorted positions; others are left out where they arise. Records shorter than k bytes give nothing.
    """
    shared = None if wanted is None else records.sparkSession.sparkContext.broadcast(wanted)
    places = np.int64((1 << 22) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if shared is not None:
            own, hashed = shared.value, np.zeros(int(places) + 1, bool)
            hashed[own & places] = True
        for batch in batches:
            names, data, begins = batch.column(0), *joined(batch.column(1))
            for at, record in batch_positions(data, begins, k, h, m, canonical, PIECE):
                bits, record = at.ravel(), np.tile(record, h)
                if shared is not None:
                    some = np.flatnonzero(hashed[bits & places])  # most go here, before they are sorted or looked up
                    some = some[own[np.minimum(np.searchsorted(own, bits[some]), len(own) - 1)] == bits[some]] if len(own) else some[:0]
                    bits, record = bits[some], record[some]
                sort = np.lexsort((bits, record))
                bits, record = bits[sort], record[sort]
                new = np.flatnonzero(np.append(True, (bits[1:] != bits[:-1]) | (record[1:] != record[:-1]))[: len(bits)])
                if len(new):
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(record[new])), pa.array(bits[new])], names=["key", "bit"])

    given = records.select(key, "seq").where(F.col("seq").isNotNull() & (F.octet_length("seq") >= k))
    return given.mapInArrow(run, f"{key} {given.schema[key].dataType.simpleString()}, bit bigint")


def _keys(records: DataFrame) -> list[str]:
    """What makes a sample: its id, or its number and id where records have a ``sample_no``."""
    return ["sample_id", "sample_no"] if "sample_no" in records.columns else ["sample_id"]


def number_samples(records: DataFrame, k: int, path: str | None = None) -> DataFrame:
    """(sample_idx, sample_id, n_bytes, and sample_no if given) of the samples with a record of k bytes at least.

    ``n_bytes`` of the records, if they have it, counts for those that come in pieces; else their length does.
    Numbers follow the samples' bytes in all, ties the sample_id. The samples are sorted into ranges and written at
    ``path``; a number is the place in its range and the sizes of the ranges before, so no task sees all samples.
    """
    keys = _keys(records)
    each = F.col("n_bytes") if "n_bytes" in records.columns else F.octet_length("seq")
    sizes = records.where(F.col("sample_id").isNotNull()).groupBy(*keys).agg(F.coalesce(F.sum(each), F.lit(0)).alias("n_bytes"), F.max(F.octet_length("seq")).alias("longest"))
    spark, path = records.sparkSession, path or shared_path(records.sparkSession, "samples")
    return _placed(spark, sizes.where(F.col("longest") >= k).drop("longest"), keys, path)


def _placed(spark: SparkSession, rows: DataFrame, keys: list[str], path: str) -> DataFrame:
    """``rows``, one for each sample, written in the samples' order, with their ``sample_idx``."""
    rows.orderBy("n_bytes", *keys).withColumn("place", F.monotonically_increasing_id()).write.mode("overwrite").option("compression", "zstd").parquet(path)
    placed = spark.read.parquet(path).withColumns({"range": F.shiftright("place", 33), "place": F.col("place").bitwiseAND(F.lit((1 << 33) - 1))})
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = placed.groupBy("range").agg(F.count("*").alias("n")).select("range", before.alias("before"))  # one row per range
    return placed.join(F.broadcast(ranges), "range").select((F.col("before") + F.col("place")).alias("sample_idx"), *rows.columns)


def distinct_pairs(bits: np.ndarray, local: np.ndarray, m: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a position below m and a sample below n, each once and in order."""
    if (shift := n.bit_length()) + m.bit_length() < 64:
        pairs = bits << shift | local
        pairs.sort()
        pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])]
        return pairs >> shift, pairs & ((1 << shift) - 1)
    sort = np.lexsort((local, bits))
    bits, local = bits[sort], local[sort]
    new = np.append(True, (bits[1:] != bits[:-1]) | (local[1:] != local[:-1]))
    return bits[new], local[new]


def packed_pairs(offsets: np.ndarray, samples: np.ndarray) -> tuple[bytes, bytes]:
    """Rising offsets as a Rice code of their gaps, and a sample beside each, of few different ones mostly, compressed."""
    body = narrow(samples)
    return rice(np.diff(offsets, prepend=0)), len(body).to_bytes(4, "little") + pa.compress(body, "zstd", asbytes=True)


def unpacked_pairs(offsets: bytes, samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(of_rice(offsets)), widened(pa.decompress(samples[4:], int.from_bytes(samples[:4], "little"), "zstd", asbytes=True))


class Packer:
    """Positions of samples, gathered until there are FLUSH_PAIRS of them and then packed by slab and part."""

    def __init__(self, grid: Grid):
        self.grid, self.held, self.total = grid, [], 0

    def add(self, bits: np.ndarray, samples: np.ndarray) -> Iterator[pa.RecordBatch]:
        if self.total and self.total + len(bits) > FLUSH_PAIRS:
            yield self.flush()
        self.held.append((bits, samples))
        self.total += len(bits)

    def flush(self) -> pa.RecordBatch:
        """What is held, each pair once."""
        grid = self.grid
        bits, sample = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.total = [], 0
        names, local = np.unique(sample, return_inverse=True)
        bits, local = distinct_pairs(bits, local, grid.m, len(names))
        sample = names[local]
        slab, part = bits // grid.width, sample >> grid.part_bits
        if part.any():
            sort = np.lexsort((part, slab))
            bits, sample, slab, part = bits[sort], sample[sort], slab[sort], part[sort]
        begin = np.flatnonzero(np.append(True, (slab[1:] != slab[:-1]) | (part[1:] != part[:-1])))
        cuts = np.append(begin, len(bits))
        offsets, sample = bits - slab * grid.width, sample & ((1 << grid.part_bits) - 1)
        pairs = [packed_pairs(offsets[a:b], sample[a:b]) for a, b in zip(cuts, cuts[1:])]
        columns = [pa.array(slab[begin]), pa.array(part[begin].astype(np.int32)), *(pa.array(c, pa.binary()) for c in zip(*pairs)), pa.array(np.diff(cuts).astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, names=["slab", "part", "offsets", "samples", "n"])


def packed_bits(records: DataFrame, config: Config, grid: Grid) -> DataFrame:
    """(slab, part, offsets, samples): the positions of (sample_idx, seq), packed by slab and part of the samples.

    Positions that a sample gives again are left out within a flush of FLUSH_PAIRS; the merge drops the others.
    """
    k, h, m, canonical = config.k, config.h, config.m, config.canonical

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(grid)
        for batch in batches:
            names, data, begins = batch.column(0).to_numpy(), *joined(batch.column(1))
            for bits, record in batch_positions(data, begins, k, h, m, canonical, PIECE):
                yield from packer.add(bits.ravel(), np.tile(names[record], h))
        if packer.total:
            yield packer.flush()

    given = records.select("sample_idx", "seq").where(F.octet_length("seq") >= k)
    return given.mapInArrow(run, PACKED)


def binaries(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The stretches between the cuts as binary values, without a copy."""
    places = np.asarray(cuts, np.int64) * values.itemsize
    if places[-1] >= 1 << 31:
        return pa.array([values[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(places.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def stored_rows(grid: Grid, bit: np.ndarray, sample: np.ndarray, domain: int, part: int) -> pa.RecordBatch:
    """ROW of distinct pairs of a position and a sample below ``domain``, in order."""
    cuts = np.append(np.flatnonzero(np.append(True, bit[1:] != bit[:-1])), len(bit))  # of each position's samples
    forms, lengths, data = encode(sample, cuts, domain)
    own, counts = bit[cuts[:-1]], np.diff(cuts)
    fine = grid.fine_of(own)
    rows = np.append(np.flatnonzero(np.append(True, fine[1:] != fine[:-1])), len(own))  # of each row's positions
    low, low_cuts, high, high_cuts = parted(forms, lengths, data, rows)
    n, ranges = len(rows) - 1, fine[rows[:-1]]
    gaps = [rice(np.diff(own[a:b], prepend=f - 1) - 1) for a, b, f in zip(rows, rows[1:], grid.fine_begin(ranges))]
    columns = [pa.array(ranges), pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, domain)), pa.array(gaps, pa.binary()), pa.array([narrow(counts[a:b] - 1) for a, b in zip(rows, rows[1:])], pa.binary()), binaries(forms.astype(np.uint8), rows), binaries(low, low_cuts), binaries(high, high_cuts)]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in ROW.split(", ")])


def squeezed(records: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_bytes, seq) of (keys, seq): records of one sample that come side by side are one row, SQUEEZED bytes at most
    but for a longer record; ``seq`` is their number, their bytes and, compressed, the length and the text of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, begins = joined(batch.column(len(keys)))
            new, codec = np.ones(batch.num_rows, bool), pa.Codec("zstd", 3)
            new[1:] = False
            for i in range(len(keys)):
                new[1:] |= pc.not_equal(batch.column(i)[1:], batch.column(i)[:-1]).to_numpy(zero_copy_only=False)
            cuts, at = [], 0
            for stop in np.append(np.flatnonzero(new)[1:], batch.num_rows).tolist():
                while at < stop:
                    cuts.append(at)
                    at = min(stop, max(at + 1, int(np.searchsorted(begins, begins[at] + SQUEEZED, "right")) - 1))
            sizes, rows = np.diff(begins).astype("<i4"), []
            for a, b in zip(cuts, [*cuts[1:], batch.num_rows]):
                body = sizes[a:b].tobytes() + data[begins[a] : begins[b]].tobytes()
                rows.append(np.array([b - a, begins[b] - begins[a]], "<i8").tobytes() + codec.compress(body, asbytes=True))
            own = pa.array(cuts, pa.int64())
            total = np.diff(begins[np.append(cuts, batch.num_rows).astype(np.int64)])
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(own) for i in range(len(keys))), pa.array(total), pa.array(rows, pa.binary())], names=[*keys, "n_bytes", "seq"])

    given = records.select(*keys, "seq")
    return given.mapInArrow(run, ", ".join([*(f"{c} {given.schema[c].dataType.simpleString()}" for c in keys), "n_bytes bigint", "seq binary"]))


def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(sample of each record, their bytes, where each begins) of (sample_idx, seq), plain or ``squeezed``, some MB at a time."""
    codec = pa.Codec("zstd")
    for batch in batches:
        names, seq = batch.column(0).to_numpy(), batch.column(1)
        if not pa.types.is_binary(seq.type):
            yield names, *joined(seq)
            continue
        sizes, data, first, held = [], [], 0, 0
        for i, row in enumerate(seq):
            row = row.as_buffer()
            n, size = np.frombuffer(row, "<i8", 2).tolist()
            body = codec.decompress(row.slice(16), 4 * n + size)
            sizes.append(np.frombuffer(body, "<i4", n))
            data.append(np.frombuffer(body, np.uint8, size, 4 * n))
            held += 4 * n + size
            if held >= UNDONE or i + 1 == len(seq):
                yield np.repeat(names[first : i + 1], [len(x) for x in sizes]), np.concatenate(data), np.append(0, np.cumsum(np.concatenate(sizes), dtype=np.int64))
                sizes, data, first, held = [], [], i + 1, 0


def grouped_rows(numbered: DataFrame, config: Config, grid: Grid) -> DataFrame:
    """ROW of (sample_idx, seq), plain or ``squeezed``, in the order of the samples: groups of samples side by side, as they come, of GROUP_PAIRS about."""
    k, h, m, canonical, most = config.k, config.h, config.m, config.canonical, GROUP_PAIRS
    # A group has no more samples than positions; a pair is one number, if there is room for both.
    shift = most.bit_length()
    one_number = (m - 1).bit_length() + shift < 64

    def pair(bits: np.ndarray, sample: np.ndarray) -> tuple[np.ndarray, ...]:
        return (bits << shift | sample,) if one_number else (bits, sample)

    def distinct(parts: list[tuple], n: int) -> tuple[np.ndarray, ...]:
        """The pairs of all parts, each once and in order."""
        columns = [np.concatenate(x) for x in zip(*parts)]
        if not one_number:
            return distinct_pairs(*columns, m, n)
        columns[0].sort()
        return (columns[0][np.append(True, columns[0][1:] != columns[0][:-1])],)

    def group(runs: list[tuple], first: int, n: int) -> Iterator[pa.RecordBatch]:
        # A few ``fine`` ranges at a time, taken from all runs.
        pairs = sum(len(x[0]) for x in runs)
        step = FINE >> min(FINE.bit_length() - 1, (max(-(-pairs // (grid.slabs * STORED_PAIRS)), 1) - 1).bit_length())
        ranges = np.arange(0, grid.slabs * FINE, step)
        begins = np.append(np.minimum(grid.fine_begin(ranges), grid.begin(ranges // FINE + 1)), grid.begin(grid.slabs))
        cuts = [np.searchsorted(x[0], begins << shift if one_number else begins) for x in runs]
        for i in range(len(ranges)):
            some = [tuple(c[at[i] : at[i + 1]] for c in x) for x, at in zip(runs, cuts) if at[i + 1] > at[i]]
            if some:
                own = distinct(some, n)
                bits, sample = (own[0] >> shift, own[0] & ((1 << shift) - 1)) if one_number else own
                yield stored_rows(grid, bits, sample, n, first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, gathered, runs, total, first, last = [], 0, [], 0, 0, -2
        for names, data, begins in texts(batches):
            sizes, a = np.diff(begins) * h, 0
            while a < len(names):
                apart = np.flatnonzero(~np.isin(np.diff(names[a:]), (0, 1)))
                own = names[a : a + 1 + int(apart[0]) if len(apart) else len(names)]  # of samples side by side
                one = int(np.searchsorted(own, own[0], "right"))
                if total and names[a] != last and (names[a] != last + 1 or total + sizes[a : a + one].sum() > most):
                    yield from group(runs + [distinct(held, last + 1 - first)] if held else runs, first, last + 1 - first)
                    held, gathered, runs, total = [], 0, [], 0
                if not total:
                    first = int(names[a])
                # Whole samples, as many as there is room for, one at least.
                b = int(np.searchsorted(np.cumsum(sizes[a : a + len(own)]), most - total, "right"))
                b = a + max(one, b if b == len(own) else int(np.searchsorted(own, own[b])))
                for bits, record in batch_positions(data[begins[a] : begins[b]], begins[a : b + 1] - begins[a], k, h, m, canonical, PIECE):
                    held.append(pair(bits.ravel(), np.tile(names[a + record] - first, h)))
                    gathered += bits.size
                    if gathered >= RUN_PAIRS:
                        runs.append(distinct(held, int(names[b - 1]) + 1 - first))
                        held, gathered = [], 0
                total, last, a = total + int(sizes[a:b].sum()), int(names[b - 1]), b
        if total:
            yield from group(runs + [distinct(held, last + 1 - first)] if held else runs, first, last + 1 - first)

    return numbered.select("sample_idx", "seq").mapInArrow(run, ROW)


def merged(packed: DataFrame, grid: Grid, n_samples: int) -> DataFrame:
    """The rows that are stored, of packed arrays: one shuffle of these, no sampling, each slab merged by itself."""

    def plain(offsets: bytes, samples: bytes, n: int | None) -> tuple[np.ndarray, np.ndarray]:
        own = (np.frombuffer(offsets, grid.offset), np.frombuffer(samples, "<u4")) if n is None else unpacked_pairs(offsets, samples)
        return own[0].astype(grid.offset), own[1].astype("<u4")

    def finish(slab: int, part: int, packed: list[tuple]) -> pa.RecordBatch:
        bit, sample = (np.concatenate(x) for x in zip(*(plain(*p) for p in packed)))
        if grid.offset.itemsize == 4:
            pairs = bit.astype(np.uint64) << np.uint64(32) | sample
            pairs.sort()
            pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])]
            bit, sample = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        else:
            sort = np.lexsort((sample, bit))
            bit, sample = bit[sort].astype(np.int64), sample[sort].astype(np.int64)
            new = np.append(True, (bit[1:] != bit[:-1]) | (sample[1:] != sample[:-1]))
            bit, sample = bit[new], sample[new]
        domain = min(n_samples - (part << grid.part_bits), 1 << grid.part_bits)
        rows = stored_rows(grid, bit + grid.begin(slab), sample, domain, part)
        return rows.add_column(0, "bucket", pa.array(np.full(rows.num_rows, grid.bucket(slab), np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for slab, part, *packed in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if at != (slab, part) and held:
                    yield finish(*at, held)
                    held = []
                at = slab, part
                held.append(packed)
        if held:
            yield finish(*at, held)

    bucket = F.floor(F.col("slab") * grid.buckets / F.lit(grid.slabs)).cast("int")
    dealt = packed.repartitionById(grid.buckets, bucket).sortWithinPartitions("slab", "part")
    return dealt.mapInArrow(run, STORED).sortWithinPartitions("bucket", "fine", "part")


def row_positions(grid: Grid, row: dict) -> np.ndarray:
    """The positions of a stored row; those of indexes from before the column ``slices_high`` have gaps of one width."""
    gaps = widened(row["gaps"]) if row["slices_high"] is None else of_rice(row["gaps"])
    return np.cumsum(gaps + 1) + (grid.fine_begin(row["fine"]) - 1)


def row_counts(counts: bytes | memoryview) -> np.ndarray:
    """How many samples each position of a stored row has."""
    return widened(counts) + 1


def row_slices(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(forms, counts, lengths, bytes) of a stored row's slices."""
    forms, counts = np.frombuffer(row["forms"], np.uint8).astype(np.int64), row_counts(row["counts"])
    lengths = lengths_of(forms, counts, row["domain"])
    data = np.frombuffer(row["slices"], np.uint8) if row["slices_high"] is None else woven(forms, lengths, row["slices"], row["slices_high"])
    return forms, counts, lengths, data


def held_slices(row: dict) -> Slices:
    forms, counts, _, data = row_slices(row)
    return Slices(forms, counts, np.full(len(counts), row["domain"]), data)


def live(meta: list) -> list:
    """The batches that count, in the order of their samples: those that no other one replaces.

    Of several that would replace the same batches, the first counts; what it took away is not there for the others.
    """
    out: dict[int, tuple] = {}
    for r in meta:
        of = list(r["replaces"] or ())
        if of and not all(b in out for b in of):
            continue
        at = min((out[b][0] for b in of), default=(r["batch_id"],))
        for b in of:
            del out[b]
        out[r["batch_id"]] = at, r
    return [r for _, r in sorted(out.values(), key=lambda x: x[0])]


def _meta(spark: SparkSession, path: str) -> list:
    return sorted(spark.read.schema(META).parquet(f"{path}/meta").collect(), key=lambda r: r["batch_id"])  # one row per batch


def _claimed(spark: SparkSession, path: str, first: int) -> int:
    """A batch number that no other build or update has; a number without a meta row is that of an interrupted one."""
    while not claim(spark, f"{path}/claims/{first}"):
        first += 1
    return first


def _compressed(rows: DataFrame):
    # Row groups of 8 MB and small pages: a search reads the rows of a few ranges.
    return rows.write.mode("overwrite").options(**{"compression": "zstd", "parquet.block.size": 1 << 23, "parquet.page.size": 1 << 17})


def _store(spark: SparkSession, config: Config, batch: int, samples: DataFrame, packed: DataFrame | None, grid: Grid, old: list, token: str | None = None, level: int = 0, replaces: list[int] | None = None, holds: list[tuple] | None = None) -> None:
    """The batch's postings, if there are ``packed`` ones, and its meta row. ``holds``: where else postings of it lie, as (store or null, batch, first sample)."""
    path, size = config.index_path, samples.agg(F.count("*").alias("n"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("bytes")).first()
    if grid.grouped:
        if packed is not None:
            _compressed(packed).parquet(f"{path}/postings/batch={batch}/bucket=0")
            holds = holds and [*holds, (None, batch, 0)]
    else:
        _compressed(merged(packed, grid, size["n"])).partitionBy("bucket").parquet(f"{path}/postings/batch={batch}")
    today = datetime.now(UTC).strftime("%d-%m-%Y")
    meta = [(batch, config.k, config.h, config.m, config.sequence_type, grid.slabs, size["n"], size["bytes"], old[0]["created_on"] if old else today, today, level, replaces or [], token, grid.grouped, holds or [])]
    spark.createDataFrame(meta, META).coalesce(1).write.mode("append").parquet(f"{path}/meta")


def _pairs(samples: DataFrame, h: int) -> int:
    return int(samples.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)) * h).first()[0])


def _write(records: DataFrame, config: Config, old: list, token: str | None) -> None:
    spark, path = records.sparkSession, config.index_path
    batch = _claimed(spark, path, old[-1]["batch_id"] + 1 if old else 0)
    with _laid_out(records, config, f"{path}/samples/batch={batch}") as (samples, grid, rows):
        _store(spark, config, batch, samples, rows, grid, old, token)


@contextmanager
def _laid_out(records: DataFrame, config: Config, path: str) -> Iterator[tuple[DataFrame, Grid, DataFrame]]:
    """The records' samples, written at ``path``, how their positions are laid out, and these: ROW if by groups, else PACKED."""
    spark, keys = records.sparkSession, _keys(records)
    own, ordered = shared_path(spark, "samples"), None
    named, size = records.where(F.col("sample_id").isNotNull()), F.octet_length("seq")
    most = named.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(size).alias("bytes")).agg(F.max("n"), F.max("bytes")).first()
    grouped = "n_bytes" not in records.columns and (most[1] or 0) * config.h <= min(GROUP_PAIRS, SAMPLE_PAIRS)
    small = squeezed(named.where(size >= config.k), keys) if grouped else None
    if grouped and most[0] == 1:
        ordered = _placed(spark, small, keys, own)
    samples = ordered.drop("seq") if ordered is not None else number_samples(records, config.k, own)
    samples.write.mode("overwrite").parquet(path)
    samples = spark.read.parquet(path)
    if grouped:
        grid = Grid(config.m, GROUP_SLABS, True)
        if ordered is None:
            ordered = _numbered(small, samples).repartitionByRange("sample_idx").sortWithinPartitions("sample_idx")
        yield samples, grid, grouped_rows(ordered, config, grid)
    else:
        grid = Grid.of(config.m, _pairs(samples, config.h))
        yield samples, grid, packed_bits(_numbered(records, samples), config, grid)
    remove(spark, own)


def _numbered(records: DataFrame, samples: DataFrame) -> DataFrame:
    keys = _keys(records)
    return records.join(samples.select("sample_idx", *keys).hint("shuffle_hash"), keys).select("sample_idx", "seq")  # the texts need no sort


def by_record(records: DataFrame) -> DataFrame:
    """``records`` with a ``sample_no`` that makes each record a sample of its own, whatever its id.

    They are written once to the shared folder, parsed, so that all later passes see the same numbers.
    """
    path = shared_path(records.sparkSession, "records")
    records.select("sample_id", "seq").withColumn("sample_no", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    return records.sparkSession.read.parquet(path)


def index_exists(spark: SparkSession, path: str) -> bool:
    return exists(spark, f"{path}/meta")


def build(records: DataFrame, config: Config, token: str | None = None) -> None:
    """A new index of (sample_id, seq) records; an existing one is never overwritten.

    Records of one sample_id are one sample, unless a column ``sample_no`` tells them apart (``by_record``). Records
    without a sample_id or shorter than k bytes give nothing. ``token``: kept with the batch, see ``update``.
    """
    if index_exists(records.sparkSession, config.index_path):
        raise FileExistsError(config.index_path)
    _write(records, config, [], token)


def update(records: DataFrame, config: Config, token: str | None = None) -> bool:
    """Appends the records' samples as a new batch; the settings must be those of the index.

    A sample_id that is there already becomes another sample. With a ``token`` that a batch of the index has, nothing
    is done and False returned, so that an update can be repeated safely.
    """
    old = _meta(records.sparkSession, config.index_path)
    config.agree(old[0].asDict())
    if token is not None and any(r["token"] == token for r in old):
        return False
    _write(records, config, old, token)
    return True


def build_matrix(records: DataFrame, config: Config) -> None:
    """The Bloom matrix alone, as packed positions, for ``build_from_matrix``."""
    spark, path = records.sparkSession, config.matrix_path
    if exists(spark, f"{path}/grid"):
        raise FileExistsError(path)
    with _laid_out(records, config, f"{path}/samples") as (_, grid, rows):
        (_compressed(rows) if grid.grouped else rows.write.mode("overwrite").option("compression", "zstd")).parquet(f"{path}/bits")
    row = [(config.k, config.h, config.m, config.sequence_type, grid.slabs, grid.grouped)]
    spark.createDataFrame(row, GRID).coalesce(1).write.mode("overwrite").parquet(f"{path}/grid")


def build_from_matrix(spark: SparkSession, config: Config) -> None:
    """The index of an existing Bloom matrix; a batch of its own if there is an index already.

    A matrix by groups of samples holds the rows that an index stores; if its files are large, the index reads them
    where they are, and the matrix must stay.
    """
    of = spark.read.schema(GRID).parquet(f"{config.matrix_path}/grid").first().asDict()
    grid = Grid(config.m, of["slabs"], bool(of["grouped"]))
    config.agree(of)
    path, old = config.index_path, []
    if index_exists(spark, path):
        old = _meta(spark, path)
        config.agree(old[0].asDict())
    batch = _claimed(spark, path, old[-1]["batch_id"] + 1 if old else 0)
    spark.read.parquet(f"{config.matrix_path}/samples").write.mode("overwrite").parquet(f"{path}/samples/batch={batch}")
    samples, bits = spark.read.parquet(f"{path}/samples/batch={batch}"), f"{config.matrix_path}/bits"
    if grid.grouped and _large(spark, bits):
        _store(spark, config, batch, samples, None, grid, old, holds=[(bits, batch, 0)])
    else:
        _store(spark, config, batch, samples, spark.read.schema(ROW if grid.grouped else PACKED).parquet(bits), grid, old)


def _large(spark: SparkSession, folder: str) -> bool:
    """Whether the files of a folder are large on average."""
    system, target = located(spark, folder)
    sizes = [f.getLen() for f in system.listStatus(target) if f.getPath().getName().startswith("part-")] if system.exists(target) else []
    return bool(sizes) and sum(sizes) >= LARGE_FILES * len(sizes)



class Index:
    """An index that is there: its settings, samples and postings.

    A sample's number in its batch and the samples of the batches before make its ``sample_idx``.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.every = _meta(spark, path)
        self.batches = live(self.every)
        self.settings = self.batches[0].asDict()
        sizes = np.array([r["n_samples"] for r in self.batches])
        self.first = dict(zip((r["batch_id"] for r in self.batches), (np.cumsum(sizes) - sizes).tolist()))
        #: Of each batch (store, batch, first) of the folders with its postings: of another store, or null and a batch of this index; and the first sample.
        self.places = {b: [(p["store"], p["batch"], first + p["first"]) for p in r["holds"] or ()] or [(None, b, first)] for r, (b, first) in zip(self.batches, self.first.items())}

    @staticmethod
    def _of_batch(first: dict[int, int]) -> F.Column:
        """What is added to a sample's number in its batch."""
        return F.create_map(*[F.lit(x) for pair in first.items() for x in pair])[F.col("batch")]

    @property
    def samples(self) -> DataFrame:
        """(sample_idx, sample_id, n_bytes, batch)."""
        paths = [f"{self.path}/samples/batch={b}" for b in self.first]
        rows = self.spark.read.option("basePath", f"{self.path}/samples").parquet(*paths)
        return rows.select((F.col("sample_idx") + self._of_batch(self.first)).alias("sample_idx"), "sample_id", "n_bytes", "batch")

    @property
    def grids(self) -> dict[tuple[int, bool], list[int]]:
        """The batches with samples, by the grid that they have: its slabs, and whether it is of groups of samples."""
        out: dict[tuple[int, bool], list[int]] = {}
        for r in self.batches:
            if r["n_samples"]:
                out.setdefault((r["slabs"], bool(r["grouped"])), []).append(r["batch_id"])
        return out

    def postings(self, grid: tuple[int, bool], batches: list[int] | None = None) -> DataFrame:
        """The stored rows of the batches with this grid, and ``first``, what their samples begin at."""
        return self.rows_at([p for b in self.grids[grid] if batches is None or b in batches for p in self.places[b]])

    def rows_at(self, places: list[tuple]) -> DataFrame:
        """The stored rows at some ``places``."""
        parts = [self.spark.read.schema(ROW).parquet(store).withColumns({"bucket": F.lit(0), "batch": F.lit(b), "first": F.lit(first).cast("bigint")}) for store, b, first in places if store]
        if own := {b: first for store, b, first in places if not store}:
            paths = [f"{self.path}/postings/batch={b}" for b in own]
            rows = self.spark.read.schema(f"batch int, {STORED}").option("basePath", f"{self.path}/postings").parquet(*paths)
            parts.insert(0, rows.withColumn("first", self._of_batch(own)))
        return reduce(DataFrame.unionByName, parts)

    @property
    def canonical(self) -> bool:
        return self.settings["sequence_type"] == "nucleotide"


def _unpacked(rows: DataFrame, of: Grid, grid: Grid) -> DataFrame:
    """Stored rows of a grid, with ``first``, packed again for another one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(grid)
        for batch in batches:
            for r in (r for i in range(0, batch.num_rows, ROWS) for r in batch.slice(i, ROWS).to_pylist()):
                bits, held = row_positions(of, r), held_slices(r)
                for a, b in _runs(np.cumsum(held.counts), FLUSH_PAIRS):
                    samples, sizes = held.samples(np.arange(a, b))
                    yield from packer.add(np.repeat(bits[a:b], sizes), samples + ((r["part"] << of.part_bits) + r["first"]))
        if packer.total:
            yield packer.flush()

    return rows.drop("bucket", "batch").mapInArrow(run, PACKED)


def slice_profile(index: Index) -> DataFrame:
    """(bit, n_samples, first_sample, last_sample) of each position that some sample has, read from the stored slices."""

    def rows(bits: np.ndarray, held: Slices, base: int) -> Iterator[pa.RecordBatch]:
        for a, b in _runs(np.cumsum(held.counts), FLUSH_PAIRS):
            samples, n = held.samples(np.arange(a, b))
            ends = np.cumsum(n)
            yield pa.RecordBatch.from_arrays([pa.array(bits[a:b]), pa.array(n), pa.array(samples[ends - n] + base), pa.array(samples[ends - 1] + base)], names=["bit", "n", "low", "high"])

    found = _of_slices(index, rows, "bit bigint, n bigint, low bigint, high bigint")
    return found.groupBy("bit").agg(F.sum("n").alias("n_samples"), F.min("low").alias("first_sample"), F.max("high").alias("last_sample"))


def filter_sizes(index: Index) -> DataFrame:
    """(sample_idx, n_bits): how many positions each sample has, read from the stored slices."""

    def rows(bits: np.ndarray, held: Slices, base: int) -> Iterator[pa.RecordBatch]:
        for a, b in _runs(np.cumsum(held.counts), FLUSH_PAIRS):
            own, n = np.unique(held.samples(np.arange(a, b))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(own + base), pa.array(n)], names=["sample_idx", "n"])

    return _of_slices(index, rows, "sample_idx bigint, n bigint").groupBy("sample_idx").agg(F.sum("n").alias("n_bits"))


def _of_slices(index: Index, rows: Callable[[np.ndarray, Slices, int], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``rows`` makes of the positions, slices and first sample of each stored row."""

    def reader(of: Grid):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in (r for i in range(0, batch.num_rows, ROWS) for r in batch.slice(i, ROWS).to_pylist()):
                    yield from rows(row_positions(of, r), held_slices(r), r["first"] + (r["part"] << of.part_bits))

        return run

    parts = [index.postings(of).drop("bucket", "batch").mapInArrow(reader(Grid(index.settings["m"], *of)), schema) for of in index.grids]
    return reduce(DataFrame.unionAll, parts) if parts else index.spark.createDataFrame([], schema)


def _runs(ends: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Stretches of about ``limit`` in all, of what has these running totals."""
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, ends[-1], limit), "right"), len(ends)))
    yield from ((a, b) for a, b in zip(np.append(0, cuts), cuts) if b > a)


def merge_batches(spark: SparkSession, config: Config, batches: list[int], level: int = 0) -> int:
    """Adjacent batches as one new one, which counts in their place once its meta row is there; its number.

    Groups of samples are written again as they are, and not even that where their files are large. Where a batch is laid out by position, the slices are packed anew by
    slab and merged as a build's are, in one shuffle; nothing is hashed again. The old batches stay until ``vacuum``. A merge that fails before the end changes nothing.
    """
    path, index = config.index_path, Index(spark, config.index_path)
    order = [r["batch_id"] for r in index.batches]
    at = order.index(batches[0])
    if batches != order[at : at + len(batches)]:
        raise ValueError("only batches side by side can be merged")
    begin, own = index.first[batches[0]], [r for r in index.batches if r["batch_id"] in batches]
    new = _claimed(spark, path, index.every[-1]["batch_id"] + 1)
    samples = index.samples.where(F.col("batch").isin(batches)).select((F.col("sample_idx") - begin).alias("sample_idx"), "sample_id", "n_bytes")
    samples.write.mode("overwrite").parquet(f"{path}/samples/batch={new}")
    first = F.col("first") - begin
    holds: list[tuple] = []
    if all(r["grouped"] for r in own if r["n_samples"]):
        grid, small, some = Grid(config.m, GROUP_SLABS, True), [], [p for r in own if r["n_samples"] for p in index.places[r["batch_id"]]]
        for store, b, at in some:
            if _large(spark, store or f"{path}/postings/batch={b}/bucket=0"):
                holds.append((store, b, at - begin))
            else:
                small.append((store, b, at))
        packed = index.rows_at(small).withColumn("part", (F.col("part") + first).cast("int")).select(*(c.split()[0] for c in ROW.split(", "))) if small else None if holds else spark.createDataFrame([], ROW)
    else:
        grid = Grid.of(config.m, sum(r["n_bytes"] for r in own) * config.h)
        packed = reduce(DataFrame.unionAll, [_unpacked(index.postings(of, batches).withColumn("first", first), Grid(config.m, *of), grid) for of, some in index.grids.items() if set(some) & set(batches)])
    _store(spark, config, new, spark.read.parquet(f"{path}/samples/batch={new}"), packed, grid, index.every, None, level, batches, holds)
    return new


def compact(spark: SparkSession, config: Config, fan: int = 8, full: bool = False) -> int:
    """Merges each run of ``fan`` adjacent batches of the same level into one of the next, until there is none; how many merges.

    So each position is written again as often as the logarithm of the number of batches. ``full``: all batches
    become one.
    """
    if fan < 2:
        raise ValueError("two batches at least are merged")
    merges = 0
    while True:
        batches = Index(spark, config.index_path).batches
        levels = [r["level"] for r in batches]
        if full:
            run = (0, len(batches)) if len(batches) > 1 else None
        else:
            run = next(((i, i + fan) for i in range(len(levels) - fan + 1) if len(set(levels[i : i + fan])) == 1), None)
        if run is None:
            return merges
        some = batches[run[0] : run[1]]
        merge_batches(spark, config, [r["batch_id"] for r in some], max(r["level"] for r in some) + 1)
        merges += 1


def vacuum(spark: SparkSession, config: Config) -> list[int]:
    """Removes the tables of replaced batches, which searches that began before their merge may still read; their numbers."""
    index = Index(spark, config.index_path)
    gone = [r["batch_id"] for r in index.every if r["batch_id"] not in index.first]
    held = {b for places in index.places.values() for store, b, _ in places if not store}
    for b in gone:
        remove(spark, f"{config.index_path}/samples/batch={b}")
        if b not in held:
            remove(spark, f"{config.index_path}/postings/batch={b}")
    return gone


def summary(spark: SparkSession, path: str) -> dict:
    """The index's settings and sizes, in two groups."""
    index = Index(spark, path)
    system, target = located(spark, path)
    stored = system.getContentSummary(target).getLength()
    n, s = sum(r["n_samples"] for r in index.batches), index.settings
    return {
        "filter": {"k": s["k"], "m": s["m"], "h": s["h"], "sequence_type": s["sequence_type"]},
        "store": {"created_on": s["created_on"], "update_count": sum(not r["replaces"] for r in index.every) - 1, "last_updated_on": index.every[-1]["last_updated_on"], "tables": "meta, postings, samples", "number_of_samples": n, "compression": "zstd", "raw_bytes": -(-s["m"] // 8) * n, "stored_bytes": stored},
    }


def summary_yaml(info: dict) -> str:
    """``summary`` as YAML; sizes in bytes and in the largest unit that fits."""
    out = []
    for group, values in info.items():
        out.append(f"{group}:")
        for key, value in values.items():
            out.append(f"  {key}: {f'{value} ({_binary(value)})' if key.endswith('_bytes') else value}")
    return "\n".join(out) + "\n"


def _binary(n: int) -> str:
    size, unit = float(n), 0
    while size >= 1024 and unit < 6:
        size, unit = size / 1024, unit + 1
    return f"{size:.2f} {('bytes', 'KiB', 'MiB', 'GiB', 'TiB', 'PiB', 'EiB')[unit]}"
