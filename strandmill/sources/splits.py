"""Sequence files read in splits, FASTA and FASTQ together, gzipped or not, a record of any length in many tasks.

A first pass looks at each split by itself: how many lines it has, where its first and last headers are, and the few
letters at its edges. From these, in the order of a file's splits, follows what each split begins with: which line of
a FASTQ record, or which FASTA record goes on there. The second pass reads the splits again and gives what it knows
to be records. Nothing longer than a piece is ever one row: a FASTA record comes as pieces that overlap by k - 1
letters, and the windows across two splits come from the letters at their edges.

Gzipped files cannot be entered in the middle by their names alone. One task for each file reads its bytes and cuts
them into chunks, of whole blocks where it is block-gzipped; these go to as many tasks as there are chunks, which undo
them, find the lines and work on.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Letters of a piece of a FASTA record; bytes of a chunk of a gzipped file before and after it is undone.
PIECE, PACKED_CHUNK, PLAIN_CHUNK = 1 << 20, 1 << 22, 1 << 23
GZIPPED = (".gz", ".bgz")

LINES = "value string, path string, begin bigint"
EDGES = "path string, begin bigint, n_lines bigint, first string, lead_n bigint, lead_head string, lead_tail string, header string, header_no bigint, open_n bigint, open_tail string"
STATES = "path string, begin bigint, kind string, before bigint, record bigint, seq_id string, glue string, new bigint"
RECORDS = "seq_id string, seq string, path string, record bigint, n_bytes bigint"


def lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(value, path, begin): the lines of files; ``begin`` orders a file's splits, and the rows of a split are in order."""
    packed = [p for p in paths if p.endswith(GZIPPED)]
    plain = [p for p in paths if not p.endswith(GZIPPED)]
    parts = [spark.read.text(plain).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("begin"))] if plain else []
    for suffix in GZIPPED:
        if own := [p for p in packed if p.endswith(suffix)]:
            parts.append(_unzipped(_raw(spark, own, suffix)))
    return reduce(DataFrame.unionAll, parts)


def _raw(spark: SparkSession, paths: list[str], suffix: str) -> DataFrame:
    """The bytes of files between 0x0A bytes, in order; the suffix, which would have them undone, is made to mean nothing."""
    plain = {"io.compression.codecs": "org.apache.hadoop.io.compress.PassthroughCodec", "lineSep": "\n"}
    # The setting's name, as it is and as Spark's own packaging of the library has it.
    plain |= {f"{prefix}io.compress.passthrough.extension": suffix for prefix in ("", "org.apache.hadoop.shaded.")}
    return spark.read.options(**plain).text(paths).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("path"))


def block_size(head: bytes) -> int:
    """Bytes of the block that begins so, if it is one of a block-gzipped file, else 0."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return 0
    extra, at = head[12 : 12 + int.from_bytes(head[10:12], "little")], 0
    while at + 4 <= len(extra):
        if extra[at : at + 2] == b"BC" and extra[at + 2] == 2:
            return int.from_bytes(extra[at + 4 : at + 6], "little") + 1
        at += 4 + int.from_bytes(extra[at + 2 : at + 4], "little")
    return 0


def undone(data: bytes) -> bytes:
    """What gzip members one after another hold; a last one that is cut off gives what there is."""
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out.append(member.decompress(data))
        data = member.unused_data
    return b"".join(out)


class _Cutter:
    """Cuts the bytes of one gzipped file into chunks that begin and end with lines.

    A chunk is (packed, skip, text): blocks, how many bytes of what they hold belong to the chunk before, and what is
    to be added at the end; of a file without blocks only text.
    """

    def __init__(self):
        self.held, self.blocked, self.stream = bytearray(), None, None
        self.packed, self.skip, self.lead = bytearray(), 0, None  # lead: text of the chunk's first line, while it has no end

    def _ended(self, text: bytes) -> tuple:
        chunk = bytes(self.packed), self.skip, text
        self.packed, self.skip = bytearray(), 0
        return chunk

    def feed(self, data: bytes, last: bool = False) -> Iterator[tuple]:
        self.held += data
        if self.blocked is None and (len(self.held) >= 64 or last):
            self.blocked = block_size(bytes(self.held[:4096])) > 0
        if self.blocked:
            yield from self._blocks(last)
        elif self.blocked is not None:
            yield from self._plain(last)

    def _blocks(self, last: bool) -> Iterator[tuple]:
        at = 0
        while n := block_size(bytes(self.held[at : at + 4096])):
            if at + n > len(self.held):
                break
            block = self.held[at : at + n]
            at += n
            if self.lead is not None or len(self.packed) + n > PACKED_CHUNK and self.packed:
                # A new chunk begins here; its text up to the first line end is the last chunk's.
                if self.lead is None:
                    self.lead, self.before, self.packed, self.skip = b"", (self.packed, self.skip), bytearray(), 0
                text = undone(bytes(block))
                end = text.find(b"\n")
                if end < 0:
                    self.lead += text
                    continue  # all of this block is the last chunk's
                rest, (self.packed, self.skip) = self.lead + text[: end + 1], self.before
                self.lead = None
                yield self._ended(rest)
                self.packed, self.skip = bytearray(block), end + 1
            else:
                self.packed += block
        del self.held[:at]
        if last and (self.packed or self.lead is not None):
            if self.lead is not None:
                self.packed, self.skip = self.before
            yield self._ended(self.lead or b"")

    def _plain(self, last: bool) -> Iterator[tuple]:
        data = bytes(self.held)
        self.held.clear()
        while data:
            self.stream = self.stream or zlib.decompressobj(31)
            self.packed += self.stream.decompress(data)  # here, text
            data = self.stream.unused_data
            if self.stream.eof:
                self.stream = None
                data = data.lstrip(b"\0")
        end = self.packed.rfind(b"\n") + 1
        if last and self.packed or len(self.packed) > PLAIN_CHUNK and end:
            text, self.packed = (self.packed, bytearray()) if last else (self.packed[:end], self.packed[end:])
            yield b"", 0, bytes(text)


def _unzipped(raw: DataFrame) -> DataFrame:
    """LINES of the bytes of gzipped files: cut by one task for each file, undone and read by many."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, number, cutter = None, 0, _Cutter()

        def out(chunks: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            nonlocal number
            for packed, skip, text in chunks:
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([number]), pa.array([packed], pa.binary()), pa.array([skip]), pa.array([text], pa.binary())], names=["path", "begin", "packed", "skip", "text"])
                number += 1

        for batch in batches:
            values, names = batch.column("value").to_pylist(), batch.column("path").to_pylist()
            begin = 0
            for i in range(1, len(values) + 1):
                if i < len(values) and names[i] == names[begin]:
                    continue
                if names[begin] != at:
                    if at is not None:
                        yield from out(cutter.feed(b"", True))
                    at, number, cutter = names[begin], 0, _Cutter()
                yield from out(cutter.feed(b"\n".join(values[begin:i]) + b"\n"))
                begin = i
        if at is not None:
            yield from out(cutter.feed(b"", True))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, begin, packed, skip, text in zip(*(batch.column(c).to_pylist() for c in ("path", "begin", "packed", "skip", "text"))):
                whole = (undone(packed)[skip:] if packed else b"") + text
                rows = whole.decode("utf-8", "replace").removesuffix("\n").split("\n") if whole else []
                for i in range(0, len(rows), 10_000):
                    some = rows[i : i + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([path] * len(some)), pa.array([begin] * len(some), pa.int64())], names=["value", "path", "begin"])

    chunks = raw.mapInArrow(cut, "path string, begin bigint, packed binary, skip bigint, text binary")
    spread = max(8, int(raw.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return chunks.repartition(spread, "path", "begin").mapInArrow(read, LINES)


def _grouped(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...] = ()) -> Iterator[tuple]:
    """((path, begin), whether it is new, the further columns' values, lines) of rows side by side."""
    last = None
    for batch in batches:
        value, path, begin, *more = (batch.column(c).to_pylist() for c in ("value", "path", "begin", *columns))
        a = 0
        for b in range(1, len(value) + 1):
            if b == len(value) or begin[b] != begin[a] or path[b] != path[a]:
                key = path[a], begin[a]
                yield key, key != last, [m[a] for m in more], value[a:b]
                last, a = key, b


def _name(header: str) -> str:
    return header[1:].split(" ", 1)[0].strip()


def _last(text: str, n: int) -> str:
    return text[max(len(text) - n, 0) :] if n else ""


def _size(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode())


def edges(rows: DataFrame, k: int) -> DataFrame:
    """EDGES of each split of LINES: its number of lines, its first visible character, and as of a FASTA file the letters before its first header (``lead``) and after its last (``open``)."""
    names = [c.split()[0] for c in EDGES.split(", ")]
    kinds = [pa.string() if c.endswith("string") else pa.int64() for c in EDGES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[dict] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([e[n] for e in found], kind) for n, kind in zip(names, kinds)], names=names)

        now: dict = {}
        for key, new, _, values in _grouped(batches):
            if new:
                if len(found) > 1000:
                    yield out()
                    found = []
                now = {"path": key[0], "begin": key[1], "n_lines": 0, "first": None, "lead_n": 0, "lead_head": "", "lead_tail": "", "header": None, "header_no": 0, "open_n": 0, "open_tail": ""}
                found.append(now)
            now["n_lines"] += len(values)
            for v in values:
                if now["first"] is None and v.strip():
                    now["first"] = v.strip()[0]
                if v.startswith(">"):
                    now.update(header=_name(v), header_no=now["header_no"] + 1, open_n=0, open_tail="")
                    continue
                letters = v.rstrip("\r")
                if now["header"] is not None:
                    now["open_n"] += _size(letters)
                    now["open_tail"] = _last(letters if len(letters) >= k else now["open_tail"] + letters, k - 1)
                else:
                    now["lead_n"] += _size(letters)
                    now["lead_tail"] = _last(letters if len(letters) >= k else now["lead_tail"] + letters, k - 1)
                    if len(now["lead_head"]) < k - 1:
                        now["lead_head"] = (now["lead_head"] + letters)[: k - 1]
        if found:
            yield out()

    return rows.mapInArrow(run, EDGES)


def states(found: DataFrame, k: int) -> DataFrame:
    """STATES of EDGES: what each split begins with, and the letters across its beginning (``glue``) with how many of them are counted there (``new``).

    The few rows of a file, one for each split, go through one task in order. A file that begins with neither > nor @
    is an error; one of white space only has no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = None
        for batch in batches:
            out = []
            for e in batch.to_pylist():
                if e["path"] != path:
                    path, kind, before, record, name, carry, waiting = e["path"], None, 0, None, None, "", 0
                if kind is None and e["first"] is not None:
                    kind = {">": "fasta", "@": "fastq"}.get(e["first"])
                    if kind is None:
                        raise ValueError(f"{path} is neither FASTA nor FASTQ")
                glue, new = None, 0
                if kind == "fasta" and record is not None and e["lead_n"]:
                    waiting += e["lead_n"] if e["lead_n"] < k else 0
                    whole = carry + e["lead_head"]
                    if _size(whole) >= k:
                        glue, new, waiting = whole, waiting, 0
                if kind is not None:
                    out.append((path, e["begin"], kind, before, record, name, glue, new))
                before += e["n_lines"]
                if e["header"] is not None:
                    record, name, carry = e["begin"] + e["header_no"] - 1, e["header"], e["open_tail"]
                    waiting = e["open_n"] if e["open_n"] < k else 0
                elif e["lead_n"]:
                    carry = _last(carry + e["lead_tail"], k - 1)
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=[c.split()[0] for c in STATES.split(", ")])

    return found.repartition("path").sortWithinPartitions("path", "begin").mapInArrow(run, STATES)


def read_records(spark: SparkSession, paths: str | list[str], k: int) -> DataFrame:
    """(seq_id, seq, path, record, n_bytes) of FASTA and FASTQ files, told apart by their first character; upper-cased.

    A FASTQ record is one row. A FASTA record is as many rows as it takes: their windows of k bytes are, together and
    each once, those of the record; ``record`` tells the records of a file apart. ``n_bytes`` are the letters that a
    row adds, so that their sum is the record's length. Records shorter than k bytes are left out.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    rows = lines(spark, paths)
    known = states(edges(rows, k), k)
    names, kinds = [c.split()[0] for c in RECORDS.split(", ")], (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, out = None, []
        for (path, begin), new, state, values in _grouped(batches, ("kind", "before", "record", "seq_id")):
            if new:
                if reader is not None:
                    reader.end()
                reader = (_Fasta if state[0] == "fasta" else _Fastq)(path, begin, *state[1:], k, out)
            for i in range(0, len(values), 4096):
                reader.read(values[i : i + 4096])
                if sum(len(r[1] or "") for r in out) > PIECE:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
                    out.clear()
        if reader is not None:
            reader.end()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    # One row for each split that is read.
    found = rows.join(F.broadcast(known.drop("glue", "new")), ["path", "begin"]).select("value", "path", "begin", "kind", "before", "record", "seq_id").mapInArrow(run, RECORDS)
    whole = found.where("seq_id IS NOT NULL AND seq IS NOT NULL")
    cut = found.where("seq_id IS NULL OR seq IS NULL").groupBy("path", "record").agg(F.max("seq_id").alias("seq_id"), F.max("seq").alias("seq")).where("seq IS NOT NULL")
    cut = cut.select("seq_id", "seq", "path", "record", F.octet_length("seq").cast("long").alias("n_bytes"))
    glue = known.where("glue IS NOT NULL").select("seq_id", F.col("glue").alias("seq"), "path", "record", F.col("new").alias("n_bytes"))
    return whole.unionAll(cut).unionAll(glue).where(F.octet_length("seq") >= k).withColumn("seq", F.upper("seq"))


class _Fasta:
    """The pieces of the FASTA records of one split, into ``out``."""

    def __init__(self, path: str, begin: int, before: int, record: int | None, name: str | None, k: int, out: list):
        self.path, self.begin, self.record, self.name, self.k, self.out = path, begin, record, name, k, out
        self.headers, self.parts, self.n, self.again = 0, [], 0, 0

    def read(self, values: list[str]) -> None:
        for v in values:
            if v.startswith(">"):
                self.end()
                self.record, self.name, self.headers = self.begin + self.headers, _name(v), self.headers + 1
            else:
                self.parts.append(v.rstrip("\r"))
                self.n += len(v)
                if self.n >= PIECE:
                    self.piece()

    def piece(self) -> None:
        """What is held of the record, but its last k - 1 letters are the next piece's too."""
        text = "".join(self.parts)
        if self.record is not None and _size(text) >= self.k:
            self.out.append((self.name, text, self.path, self.record, _size(text) - self.again))
            keep = _last(text, self.k - 1)
            self.parts, self.n, self.again = [keep], len(keep), _size(keep)

    def end(self) -> None:
        self.piece()
        self.parts, self.n, self.again = [], 0, 0


class _Fastq:
    """The FASTQ records of one split, into ``out``; of one at its edge, what it has: a name or a sequence."""

    def __init__(self, path: str, begin: int, before: int, record: int | None, name: str | None, k: int, out: list):
        self.path, self.line, self.out, self.header = path, before, out, None

    def read(self, values: list[str]) -> None:
        for v in values:
            if self.line % 4 == 0:
                self.header = _name(v)
            elif self.line % 4 == 1:
                v = v.rstrip("\r")
                self.out.append((self.header, v, self.path, self.line // 4, _size(v)))
                self.header = None
            self.line += 1

    def end(self) -> None:
        if self.header is not None:
            self.out.append((self.header, None, self.path, self.line // 4, 0))
            self.header = None
