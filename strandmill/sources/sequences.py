"""Readers of FASTA, FASTQ and sample manifests, plain or gzipped, and a FASTA writer."""

from __future__ import annotations

import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandmill.sources.splits import read_records
from strandmill.storage import exists, located, write_text

#: Characters that a sample identifier may not hold. Fixed values.
FORBIDDEN = "/\\*.?,[]{}!@#$%^&()+=<>"


def _name(header: Column) -> Column:
    """The header up to its first space."""
    return F.trim(F.regexp_extract(header, r"^([^ \r\n]*)", 1))


def read_fasta(spark: SparkSession, paths: str | list[str], min_length: int = 0) -> DataFrame:
    """(seq_id, seq, path) of each record, upper-cased; shorter ones than ``min_length`` are dropped.

    A record may have any number of lines. Large plain files are read in splits, at record borders.
    """
    rows = spark.read.option("lineSep", "\n>").text(paths).select("value", F.col("_metadata.file_path").alias("path"))
    rows = rows.where(F.trim("value") != "").withColumn("value", F.regexp_replace("value", "^>", ""))
    at = F.instr("value", "\n")
    header = F.when(at > 0, F.substring("value", F.lit(1), at - 1)).otherwise(F.col("value"))
    body = F.when(at > 0, F.substring(F.col("value"), at + 1, F.length("value"))).otherwise(F.lit(""))
    out = rows.select(_name(header).alias("seq_id"), F.upper(F.regexp_replace(body, r"[\r\n]+", "")).alias("seq"), "path")
    return out.where(F.octet_length("seq") >= min_length)


def read_fastq(spark: SparkSession, paths: str | list[str], min_length: int = 0) -> DataFrame:
    """(seq_id, seq, path) of each record of four lines, upper-cased; qualities are not kept.

    Files are read in splits. A first pass counts the lines of each split, so that in the second each split knows at
    which line of a record it begins, whatever the lines hold. Records are framed where they are read; only the lines
    at the edges of splits, seven at most for each, are brought together.
    """
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("begin"))
    blocks = lines.groupBy("path", "begin").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    phases = blocks.select("path", "begin", before.alias("before"))  # one row per split, about 100 bytes for 128 MB read

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at, header, seq = None, 0, None, None
        for batch in batches:
            out = []
            for line, path, begin, first in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (path, begin):
                    if header is not None or seq is not None:
                        out.append((key[0], (at - 1) // 4, header, seq))
                    key, at, header, seq = (path, begin), first, None, None
                kind = at % 4
                if kind == 0:
                    header = line
                elif kind == 1:
                    seq = line.rstrip("\r")
                    out.append((path, at // 4, header, seq))
                    header = seq = None
                at += 1
            yield _records(out)
        if header is not None:
            yield _records([(key[0], (at - 1) // 4, header, None)])

    rows = lines.join(F.broadcast(phases), ["path", "begin"]).select("value", "path", "begin", "before").mapInArrow(framed, "path string, record bigint, header string, seq string")
    whole = rows.where("header IS NOT NULL AND seq IS NOT NULL").select("header", "seq", "path")
    cut = rows.where("header IS NULL OR seq IS NULL").groupBy("path", "record").agg(F.max("header").alias("header"), F.max("seq").alias("seq"))
    out = whole.unionByName(cut.select("header", "seq", "path")).where(F.col("seq").isNotNull())
    out = out.select(_name(F.regexp_replace("header", "^@", "")).alias("seq_id"), F.upper("seq").alias("seq"), "path")
    return out.where(F.octet_length("seq") >= min_length)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["path", "record", "header", "seq"])


def _first_character(spark: SparkSession, path: str) -> str | None:
    """The first character of a file (of a folder's first file that is not empty) that is no white space; packed ones are unpacked."""
    jvm = spark.sparkContext._jvm
    system, target = located(spark, path)
    if system.getFileStatus(target).isDirectory():
        inside = sorted(f.getPath().toString() for f in system.listStatus(target) if not f.getPath().getName().startswith(("_", ".")))
        return next((c for f in inside if (c := _first_character(spark, f))), None)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark.sparkContext._jsc.hadoopConfiguration()).getCodec(target)
    stream = system.open(target)
    stream = stream if codec is None else codec.createInputStream(stream)
    try:
        while (byte := stream.read()) >= 0:
            if not chr(byte).isspace():
                return chr(byte)
    finally:
        stream.close()
    return None


def file_kind(spark: SparkSession, path: str) -> str:
    """``fasta`` or ``fastq``, by the first character of the file, which the driver reads by itself."""
    begin = _first_character(spark, path)
    if begin is None:
        raise ValueError(f"{path} is empty")
    if begin not in (">", "@"):
        raise ValueError(f"{path} is neither FASTA nor FASTQ")
    return "fasta" if begin == ">" else "fastq"


def read_sequences(spark: SparkSession, path: str, min_length: int = 0) -> DataFrame:
    return (read_fasta if file_kind(spark, path) == "fasta" else read_fastq)(spark, path, min_length)


def manifest_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """(line, sample_id, paths, error) of ``id: path; path`` lines; blank lines and those that begin with ``#`` are left out.

    ``line`` tells apart lines that share an id. ``error`` says what is wrong: not exactly one colon, a forbidden
    character in the id, or no path; null where nothing is.
    """
    line = F.trim(F.regexp_replace(F.col(column), r"\r$", ""))
    used = lines.select(F.monotonically_increasing_id().alias("no"), line.alias("line"), F.col(column).startswith("#").alias("comment"))
    used = used.where((F.col("line") != "") & ~F.col("comment"))
    parts = F.split("line", ": |; ")
    name = parts[0]
    wrong = (
        F.when(F.length("line") - F.length(F.replace("line", F.lit(":"), F.lit(""))) != 1, F.concat(F.lit("one sample identifier is required per line: "), F.col("line")))
        .when(F.length(F.translate(name, FORBIDDEN, "")) != F.length(name), F.concat(F.lit("characters that are not allowed in a sample identifier: "), F.col("line")))
        .when(F.size(parts) < 2, F.concat(F.lit("a space must follow the colon, and a path that: "), F.col("line")))
    )
    return used.select(F.col("no").alias("line"), name.alias("sample_id"), F.slice(parts, 2, F.size(parts)).alias("paths"), wrong.alias("error"))


def parse_manifest(lines: DataFrame, column: str = "value") -> DataFrame:
    """(line, sample_id, path) of ``manifest_lines``; a line that is wrong is an error when read."""
    found = manifest_lines(lines, column)
    paths = F.when(F.col("error").isNull(), F.col("paths")).otherwise(F.raise_error("error").cast("array<string>"))
    return found.select("line", "sample_id", F.explode(paths).alias("path")).withColumn("path", F.trim("path"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return parse_manifest(spark.read.text(path))


def missing_paths(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the paths that are not there. A folder that many of them lie in is listed once, and many are asked at a time."""
    folders: dict[str, list[str]] = {}
    for path in sorted(set(paths)):
        folders.setdefault(path.rpartition("/")[0], []).append(path)

    def gone(item: tuple[str, list[str]]) -> list[str]:
        folder, own = item
        if len(own) > 8 and folder and exists(spark, folder):
            system, target = located(spark, folder)
            there = {f.getPath().getName() for f in system.listStatus(target)}
            return [p for p in own if p.rpartition("/")[2] not in there]
        return [p for p in own if not exists(spark, p)]

    with ThreadPoolExecutor(32) as pool:
        return sorted(chain.from_iterable(pool.map(gone, folders.items())))


def read_samples(spark: SparkSession, manifest_path: str, min_length: int = 1, report: str | None = None) -> DataFrame:
    """(sample_id, sample_no, seq, n_bytes) of every record of every file of a manifest; each line is a sample, whatever its id.

    Files are told apart by their first character where they are read, all in the same jobs; ``min_length`` is the k of
    the windows that are meant, and long records come in pieces (``read_records``). Missing files are an error, and are
    listed in the file ``report``, if that is given. The driver holds the manifest.
    """
    rows = [tuple(r) for r in read_manifest(spark, manifest_path).collect()]
    if gone := missing_paths(spark, [p for _, _, p in rows]):
        if report:
            write_text(spark, report, gone)
        raise FileNotFoundError("; ".join(gone))
    if not rows:
        raise ValueError("the manifest names no file")

    def qualified(path: str) -> str:
        system, target = located(spark, path)
        return re.sub("^file:/+", "file:/", system.makeQualified(target).toString())

    named = spark.createDataFrame([(line, s, qualified(p)) for line, s, p in rows], "sample_no bigint, sample_id string, path string")
    out = read_records(spark, sorted({p for _, _, p in rows}), max(min_length, 1)).withColumn("path", F.regexp_replace("path", "^file:/+", "file:/"))
    return out.join(F.broadcast(named), "path").select("sample_id", "sample_no", "seq", "n_bytes")  # the manifest


def read_record_samples(spark: SparkSession, paths: str | list[str], k: int) -> DataFrame:
    """(sample_id, sample_no, seq, n_bytes): each record of the files a sample, those that share ids too; long ones come in pieces."""
    rows = read_records(spark, paths, k)
    return rows.select(F.col("seq_id").alias("sample_id"), F.concat_ws("#", "path", "record").alias("sample_no"), "seq", "n_bytes")


def write_fasta(records: DataFrame, path: str, id_column: str = "seq_id", seq_column: str = "seq", compression: str | None = None) -> None:
    records.select(F.concat(F.lit(">"), F.col(id_column), F.lit("\n"), F.col(seq_column))).write.text(path, compression=compression)
