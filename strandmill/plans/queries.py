"""The engine's registered queries on the driver's tables, and DuckDB SQL for the same rows.

Documents are samples and benchmark passages queries; texts count as amino-acid sequences, and nucleotides are derived
from a text's hexadecimal digits. Searches use k = 11, h = 2 and m = 2 ** 31, where no false positive occurs in these
tables, so that their SQL is exact containment.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.functions import columns as C
from strandmill.functions.kmers import kmers, positions, windows
from strandmill.operators import index
from strandmill.operators.search import search, search_records
from strandmill.plans.config import Config

from strandmill.sources.reports import read_report, report_lines, report_stats, write_report
from strandmill.sources.sequences import manifest_lines, parse_manifest, read_fasta, read_fastq, write_fasta
from strandmill.sources.splits import read_records
from strandmill.storage import located, shared_path

K, H, M = 11, 2, 1 << 31
SMALL_K, SMALL_M = 8, 1_000_003
K_NT, M_NT, K_PROTEIN, READ = 21, 1 << 36, 7, 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("seq"))


def documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Records and samples of the documents: the sample number is the doc_id."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("sample_idx"), F.col("text").alias("seq")), docs.select(F.col("doc_id").alias("sample_idx"), F.col("doc_id").cast("string").alias("sample_id"))


def kmer_rows(rows: DataFrame, k: int, canonical: bool) -> DataFrame:
    """(id, pos, kmer) of each k-mer of (id, seq)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, seq in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = kmers((seq or "").encode(), k, canonical)
                for i in range(0, len(found), 50_000):
                    some = found[i : i + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.int64()), pa.array(range(i, i + len(some)), pa.int64()), pa.array(some, pa.binary())], names=["id", "pos", "kmer"])

    return rows.mapInArrow(run, "id bigint, pos bigint, kmer binary")


def kmer_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", C.kmer_count(F.col("text"), K).cast("long").alias("n_kmers"))


def kmer_distinct(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id AS id", "text AS seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for seq in batch.column(1):  # one at a time, as two words for each k-mer
                words = windows((seq.as_py() or "").encode(), K, False)
                sort = np.lexsort(words)
                words = [w[sort] for w in words]
                found.append(int(len(sort) > 0) + int(np.any([w[1:] != w[:-1] for w in words], axis=0).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "n_distinct"])

    return rows.mapInArrow(run, "doc_id bigint, n_distinct bigint")


def alphabet_check(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", C.alphabet(text).alias("of_text"), C.alphabet(C.as_nucleotides(text)).alias("of_derived"))


def revcomp(spark, sf_dir):
    rc = C.reverse_complemented(C.as_nucleotides(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(rc).cast("long").alias("n"), F.md5(rc).alias("digest"))


def canonical_kmers(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), C.as_nucleotides(F.col("text")).alias("seq"))
    found = kmer_rows(rows, K, True).select("id", F.col("kmer").cast("string").alias("kmer"))
    return found.groupBy(F.col("id").alias("item_id"), "kmer").agg(F.count("*").alias("n"))


def translate_frames(spark, sf_dir):
    nt = C.as_nucleotides(F.col("text"))
    frames = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("frame")
    return table(spark, sf_dir, "benchmark").select("item_id", nt.alias("nt"), frames).select("item_id", "frame", C.translated(F.col("nt"), F.col("frame")).alias("protein"))


def six_frame(spark, sf_dir):
    nt = table(spark, sf_dir, "benchmark").select("item_id", C.as_nucleotides(F.col("text")).alias("nt"))
    return nt.select(F.explode(C.six_frames(F.col("item_id").cast("string"), F.col("nt"), K)).alias("f")).select(F.col("f.id").alias("frame_id"), F.col("f.protein").alias("protein"))


def _small_bits(spark, sf_dir, seeds: bool = False) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").selectExpr("item_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, seq in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at = positions((seq or "").encode(), SMALL_K, H, SMALL_M, False)
                n = at.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(H * n, name, np.int64)), pa.array(np.tile(np.arange(n), H)), pa.array(np.repeat(np.arange(H), n)), pa.array(at.ravel())], names=["item_id", "pos", "seed", "bit"])

    return rows.mapInArrow(run, "item_id bigint, pos bigint, seed bigint, bit bigint")


def kmer_hash_bits(spark, sf_dir):
    return _small_bits(spark, sf_dir)


def bloom_fill(spark, sf_dir):
    """How full each document's filter is, as the index of small filters holds it."""
    held = stored(spark, sf_dir, "small")
    found = index.filter_sizes(held).join(held.samples, "sample_idx")
    return found.select(F.col("sample_id").cast("long").alias("doc_id"), "n_bits", (F.col("n_bits") / F.lit(float(SMALL_M))).alias("fill"))


def bitslice_postings(spark, sf_dir):
    return index.slice_profile(stored(spark, sf_dir, "small"))


def bitslice_and(spark, sf_dir):
    """The AND of the slices of all of a passage's positions: the documents whose filters hold all of them, right or not."""
    found = search(passages(spark, sf_dir), stored(spark, sf_dir, "small"), 100, fold=False)
    return found.select(F.col("query_id").alias("item_id"), F.col("sample_id").cast("long").alias("doc_id"))


def binning(spark, sf_dir):
    edge = C.bucket_edge(F.col("bit"), C.bucket_width(SMALL_M)).alias("edge")
    return index.slice_profile(stored(spark, sf_dir, "small")).groupBy(edge).agg(F.count("*").alias("n_bits"))


def index_hits_profile(spark, sf_dir):
    edge = C.bucket_edge(F.col("bit"), C.bucket_width(SMALL_M)).alias("edge")
    return _small_bits(spark, sf_dir).groupBy("item_id").agg(F.countDistinct("bit").alias("n_bits"), F.countDistinct(edge).alias("n_parts"))


def reads(docs: DataFrame) -> DataFrame:
    """The documents' derived nucleotides, cut into reads of READ letters."""
    nt = docs.select(F.col("doc_id").cast("string").alias("sample_id"), C.as_nucleotides(F.col("text")).alias("nt")).where(F.length("nt") > 0)
    cut = F.regexp_extract_all("nt", F.lit(f".{{1,{READ}}}"), F.lit(0))  # substrings of long strings would take quadratic time
    return nt.select("sample_id", F.explode(cut).alias("seq"))


_stored: dict[tuple, str] = {}


def stored(spark: SparkSession, sf_dir: str, kind: str) -> index.Index:
    """An index over a table, built at its first use and kept in the shared folder for the application's other queries.

    ``documents``: a sample each. ``sources``: the documents of a source are one sample. ``nucleotides``: of derived
    nucleotides. ``proteins``: of the first frames of these. ``reads``: of the nucleotides cut into reads of 100, a
    record each. ``small``: documents, with few positions and short k-mers.
    """
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _stored:
        docs = table(spark, sf_dir, "documents")
        name, text, settings = F.col("doc_id").cast("string"), F.col("text"), (K, H, M, "aminoacid")
        if kind == "sources":
            name = F.col("source")
        elif kind == "nucleotides":
            text, settings = C.as_nucleotides(text), (K_NT, H, M_NT, "nucleotide")
        elif kind == "proteins":
            text, settings = C.translated(C.as_nucleotides(text), F.lit(0)), (K_PROTEIN, H, M, "aminoacid")
        elif kind == "reads":
            settings = (K_NT, 1, M_NT, "nucleotide")
        elif kind == "small":
            settings = (SMALL_K, H, SMALL_M, "aminoacid")
        config = Config(*settings, shared_path(spark, f"stored-{kind}"))
        index.build(reads(docs) if kind == "reads" else docs.select(name.alias("sample_id"), text.alias("seq")), config)
        _stored[key] = config.index_path
    return index.Index(spark, _stored[key])


def _hits(found: DataFrame) -> DataFrame:
    return found.select(F.col("query_id").alias("item_id"), F.col("sample_id").cast("long").alias("doc_id"), "n_found", "n_kmers")


def search_at(threshold: float, spark, sf_dir):
    return _hits(search(passages(spark, sf_dir), stored(spark, sf_dir, "documents"), threshold, fold=False))


def scan_at(threshold: float, spark, sf_dir):
    """As ``search_at``, without an index: the documents are hashed and compared in one pass."""
    records, samples = documents(spark, sf_dir)
    return _hits(search_records(passages(spark, sf_dir), records, samples, k=K, h=H, m=M, canonical=False, threshold=threshold))


def search_nt_at(threshold: float, spark, sf_dir):
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), C.as_nucleotides(F.col("text")).alias("seq"))
    return _hits(search(queries, stored(spark, sf_dir, "nucleotides"), threshold, "nucleotide"))


def search_reads(spark, sf_dir):
    """Nucleotide passages against samples of short reads; one position to a k-mer, as nucleotides are mostly indexed."""
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), C.as_nucleotides(F.col("text")).alias("seq"))
    return _hits(search(queries, stored(spark, sf_dir, "reads"), 50, "nucleotide"))


def search_many(spark, sf_dir):
    """Every document searched in all of them: millions of positions, sent to the index in passes."""
    queries = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("seq"))
    found = search(queries, stored(spark, sf_dir, "documents"), 100, fold=False)
    return found.select(F.col("query_id").alias("doc_id"), F.col("sample_id").cast("long").alias("held_by"), "n_kmers")


def search_verified(spark, sf_dir):
    """Filters that are far too small, and hits checked on their k-mers."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("sample_id"), F.col("text").alias("seq"))
    config = Config(K, H, 1 << 16, "aminoacid", shared_path(spark, "verified"))
    index.build(docs, config)
    return _hits(search(passages(spark, sf_dir), index.Index(spark, config.index_path), 50, fold=False, verify=docs))


def search_duplicates(spark, sf_dir):
    twice = passages(spark, sf_dir).withColumn("seq", F.concat("seq", "seq"))
    return _hits(search(twice, stored(spark, sf_dir, "documents"), 50, fold=False))


def search_repeated_ids(spark, sf_dir):
    """Many passages under one query id: each is searched by itself."""
    queries = passages(spark, sf_dir).withColumn("query_id", F.col("query_id") % 3)
    return _hits(search(queries, stored(spark, sf_dir, "documents"), 2, fold=False))


def search_sources(spark, sf_dir):
    """Samples of many records: the documents of a source. So large a sample fills its filter so far that hits are checked on their k-mers."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("sample_id"), F.col("text").alias("seq"))
    out = search(passages(spark, sf_dir), stored(spark, sf_dir, "sources"), 5, fold=False, verify=docs)
    return out.select(F.col("query_id").alias("item_id"), F.col("sample_id").alias("source"), "n_found", "n_kmers")


def search_six_frame(spark, sf_dir):
    """Nucleotide queries against proteins: the documents' first forward frames."""
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), C.as_nucleotides(F.col("text")).alias("seq"))
    out = search(queries, stored(spark, sf_dir, "proteins"), 100, "nucleotide")
    return out.select(F.col("query_id").alias("frame_id"), F.col("sample_id").cast("long").alias("doc_id"), "n_kmers")


def _halves(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("sample_id"), F.col("text").alias("seq"))
    even = F.crc32("sample_id") % 2 == 0
    return docs.where(even), docs.where(~even)


def update_equals_rebuild(spark, sf_dir):
    """An index of half the documents, updated with the other half, searched: the hits of an index of all."""
    config = Config(K, H, M, "aminoacid", shared_path(spark, "index"))
    first, second = _halves(spark, sf_dir)
    index.build(first, config)
    index.update(second, config)
    return _hits(search(passages(spark, sf_dir), index.Index(spark, config.index_path), 20, fold=False))


def merged_equals_rebuild(spark, sf_dir):
    """An index of eight batches, merged by levels and then into one, searched: the hits of an index of all."""
    config = Config(K, H, M, "aminoacid", shared_path(spark, "index"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("sample_id"), F.col("text").alias("seq"))
    for i in range(8):
        (index.update if i else index.build)(docs.where(F.crc32("sample_id") % 8 == i), config)
    index.compact(spark, config, fan=4)
    index.compact(spark, config, full=True)
    index.vacuum(spark, config)
    return _hits(search(passages(spark, sf_dir), index.Index(spark, config.index_path), 20, fold=False))


def update_sequences(spark, sf_dir):
    """Samples of one record each that share ids: half of them indexed, the other half appended."""
    config = Config(K, H, M, "aminoacid", shared_path(spark, "sequences"))
    docs = table(spark, sf_dir, "documents").where(F.col("source").isNotNull())
    for i, add in enumerate((index.build, index.update)):
        half = docs.where(F.crc32(F.col("doc_id").cast("string")) % 2 == i)
        add(index.by_record(half.select(F.col("source").alias("sample_id"), F.col("text").alias("seq"))), config)
    out = search(passages(spark, sf_dir), index.Index(spark, config.index_path), 2, fold=False)
    return out.select(F.col("query_id").alias("item_id"), F.col("sample_id").alias("source"), "n_found", "n_kmers")


def matrices_equal_rebuild(spark, sf_dir):
    """An index of the matrix of half the documents, updated with that of the other half, searched."""
    top = shared_path(spark, "matrices")
    for name, half in zip(("a", "b"), _halves(spark, sf_dir)):
        config = Config(K, H, M, "aminoacid", top, matrix_store_name=name)
        index.build_matrix(half, config)
        index.build_from_matrix(spark, config)
    return _hits(search(passages(spark, sf_dir), index.Index(spark, config.index_path), 20, fold=False))


def search_sequences(spark, sf_dir):
    """Samples of one record each that share ids: a document is a sample with its source's name."""
    docs = table(spark, sf_dir, "documents").where(F.col("source").isNotNull())
    config = Config(K, H, M, "aminoacid", shared_path(spark, "sequences"))
    index.build(index.by_record(docs.select(F.col("source").alias("sample_id"), F.col("text").alias("seq"))), config)
    out = search(passages(spark, sf_dir), index.Index(spark, config.index_path), 2, fold=False)
    return out.select(F.col("query_id").alias("item_id"), F.col("sample_id").alias("source"), "n_found", "n_kmers")


def _proteins(spark, sf_dir) -> DataFrame:
    """The documents' first frames as records with descriptions, for files."""
    seq = C.translated(C.as_nucleotides(F.col("text")), F.lit(0))
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("id"), seq.alias("seq")).where(F.length("seq") > 0)


def _read_back(found: DataFrame) -> DataFrame:
    return found.select("seq_id", F.length("seq").cast("long").alias("n"), F.md5("seq").alias("digest"))


def fasta_read(spark, sf_dir):
    """Records of several lines, written as FASTA files and read again."""
    path = shared_path(spark, "fasta")
    body = F.regexp_replace("seq", "(.{60})", "$1\n")
    _proteins(spark, sf_dir).select(F.concat(F.lit(">"), "id", F.lit(" of > a document\n"), F.lower(body))).write.text(path)
    return _read_back(read_fasta(spark, path, K))


def fastq_read(spark, sf_dir):
    """Records of four lines, written as FASTQ files with Windows line ends and read again."""
    path = shared_path(spark, "fastq")
    quality = F.regexp_replace("seq", ".", "@")
    _proteins(spark, sf_dir).select(F.concat(F.lit("@"), "id", F.lit(" x\r\n"), "seq", F.lit("\r\n+\r\n"), quality, F.lit("\r"))).write.text(path)
    return _read_back(read_fastq(spark, path, K))


def fasta_pieces(spark, sf_dir):
    """FASTA files that the writer wrote, gzipped, read in pieces: each record's length and how many k-mers it has."""
    path = shared_path(spark, "pieces")
    write_fasta(_proteins(spark, sf_dir), path, "id", "seq", compression="gzip")
    parts = [f.getPath().toString() for f in located(spark, path)[0].listStatus(located(spark, path)[1]) if f.getPath().getName().startswith("part-")]
    found = read_records(spark, parts, K)
    return found.groupBy("seq_id").agg(F.sum("n_bytes").alias("n"), F.sum(F.length("seq") - (K - 1)).alias("n_kmers"))


def sample_order(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("sample_id"), F.col("text").alias("seq"))
    return index.number_samples(turns, K).select(F.col("sample_idx").cast("long").alias("sample_idx"), "sample_id", "n_bytes")


def _manifest_lines(spark, sf_dir):
    line = F.when(F.col("s_suppkey") % 10 == 0, F.concat(F.lit("# "), "s_name")).otherwise(F.concat(F.replace("s_name", F.lit("#"), F.lit("-")), F.lit(": /in/"), F.col("s_suppkey").cast("string"), F.lit(".fa; /in/"), F.col("s_nationkey").cast("string"), F.lit(".fq.gz")))
    return table(spark, sf_dir, "supplier").select(line.alias("value"))


def manifest_parse(spark, sf_dir):
    return parse_manifest(_manifest_lines(spark, sf_dir)).select("sample_id", "path")


def manifest_errors(spark, sf_dir):
    """Lines that are wrong, counted by what is wrong with them."""
    end = F.col("s_suppkey") % 5
    line = F.when(end == 0, F.concat("s_name", F.lit(": /a"))).when(end == 1, F.concat(F.lit("S"), F.col("s_suppkey").cast("string"), F.lit(": /a:b"))).when(end == 2, F.concat(F.lit("S"), F.col("s_suppkey").cast("string"), F.lit(":"))).otherwise(F.concat(F.lit("S"), F.col("s_suppkey").cast("string"), F.lit(": /a; /b")))
    found = manifest_lines(table(spark, sf_dir, "supplier").select(line.alias("value")))
    kind = F.coalesce(F.regexp_extract("error", "^([^:]*):", 1), F.lit("none"))
    return found.groupBy(kind.alias("error")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("error").isNull(), F.size("paths")).otherwise(0)).alias("n_paths"))


def report_text(spark, sf_dir):
    """The lines of a report in their order: by query, then by the samples' order in the index."""
    path = f"{shared_path(spark, 'reports')}/report.txt"
    found = search(passages(spark, sf_dir).orderBy("query_id").coalesce(1), stored(spark, sf_dir, "documents"), 2, fold=False)
    write_report(found, path, 2)
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.rtrim("value", F.lit("\n")), "\n")).alias("no", "line"))
    return lines.select(F.col("no").cast("long").alias("no"), "line")


def report_line(spark, sf_dir):
    found = search(passages(spark, sf_dir), stored(spark, sf_dir, "documents"), 2, fold=False)
    # The sample_idx of an index is its own; lines are told apart by the sample they name.
    lines = report_lines(found, 2).join(found.select("query_no", "sample_idx", "sample_id"), ["query_no", "sample_idx"])
    return lines.select(F.col("query_id").alias("item_id"), F.col("sample_id").cast("long").alias("doc_id"), "line")


def report_read(spark, sf_dir):
    """The report of a search, written and read again."""
    path = f"{shared_path(spark, 'reports')}/report.txt"
    write_report(search(passages(spark, sf_dir), stored(spark, sf_dir, "documents"), 2, fold=False), path, 2)
    return read_report(spark, path)


def report_rows(spark, sf_dir):
    return report_read(spark, sf_dir).select(F.col("query_id").cast("long").alias("item_id"), F.col("sample_id").cast("long").alias("doc_id"), "n_found", "pct")


def report_stat(spark, sf_dir):
    return report_stats(report_read(spark, sf_dir))


def summary(spark, sf_dir):
    held = stored(spark, sf_dir, "documents")
    info = index.summary(spark, held.path)
    of = held.samples.agg(F.sum("n_bytes").alias("sequence_bytes"))
    info = info["filter"] | info["store"]
    return of.select(F.lit(info["number_of_samples"]).cast("long").alias("number_of_samples"), "sequence_bytes", F.lit(info["raw_bytes"]).cast("long").alias("raw_bytes"), F.lit(info["k"]).alias("k"), F.lit(info["update_count"]).alias("update_count"))


def sizing(spark, sf_dir):
    n, p = F.col("p_size") * 1000, F.lit(0.01)
    m = C.filter_size(n, p)
    return table(spark, sf_dir, "part").select("p_partkey", m.cast("long").alias("m"), C.filter_hashes(m, n).alias("h"), C.filter_size_for_hashes(n, F.lit(3.0), p).cast("long").alias("m_for_3"), C.false_positives(p, n).alias("expected"))


# SQL.

CODE, HEX = C.GENETIC_CODE, "0123456789ABCDEF"
SLICES = "unnest([encode({text})[i:i+{last}] for i in generate_series(1, octet_length(encode({text}))-{last})])"
NT = "translate(hex(encode(text)), '0123456789ABCDEF', 'ACGTACGTACGTACGT')"


def _slices(text: str, k: int) -> str:
    return SLICES.format(text=text, last=k - 1)


def _contain(threshold: str, query: str = "text", rows: str = "documents", key: str = "doc_id") -> str:
    return f"""WITH q AS (SELECT item_id, {_slices('t', K)} AS g FROM (SELECT item_id, {query} AS t FROM benchmark)),
    qn AS (SELECT item_id, g, count(*) AS times FROM q GROUP BY ALL), n AS (SELECT item_id, CAST(sum(times) AS BIGINT) AS n_kmers FROM qn GROUP BY 1),
    d AS (SELECT DISTINCT {key}, g FROM (SELECT {key}, {_slices('text', K)} AS g FROM {rows}) WHERE g IN (SELECT g FROM qn)),
    hit AS (SELECT item_id, {key}, CAST(sum(times) AS BIGINT) AS n_found FROM qn JOIN d USING (g) GROUP BY ALL)
    SELECT item_id, {key}, n_found, n_kmers FROM hit JOIN n USING (item_id) WHERE {threshold}"""


def _contain_nt(threshold: str, documents: str = f"SELECT doc_id, {NT} AS nt FROM documents") -> str:
    """As ``_contain``, over the derived nucleotides, whose k-mers are the smaller of their two strands."""
    def grams(rows: str, key: str) -> str:
        both = f"SELECT {key}, encode(nt) AS f, encode(translate(reverse(nt), 'ACGTUN', 'TGCAAN')) AS b FROM ({rows})"
        return f"SELECT {key}, unnest([least(f[i:i+{K_NT - 1}], b[octet_length(f)-i-{K_NT - 2}:octet_length(f)-i+1]) for i in generate_series(1, octet_length(f)-{K_NT - 1})]) AS g FROM ({both})"

    return f"""WITH q AS ({grams(f'SELECT item_id, {NT} AS nt FROM benchmark', 'item_id')}), qn AS (SELECT item_id, g, count(*) AS times FROM q GROUP BY ALL),
    n AS (SELECT item_id, CAST(sum(times) AS BIGINT) AS n_kmers FROM qn GROUP BY 1), d AS (SELECT DISTINCT doc_id, g FROM ({grams(documents, 'doc_id')}) WHERE g IN (SELECT g FROM qn)),
    hit AS (SELECT item_id, doc_id, CAST(sum(times) AS BIGINT) AS n_found FROM qn JOIN d USING (g) GROUP BY ALL)
    SELECT item_id, doc_id, n_found, n_kmers FROM hit JOIN n USING (item_id) WHERE {threshold}"""


def _files() -> str:
    return f"SELECT 'doc' || doc_id AS seq_id, length(p) AS n, md5(p) AS digest FROM (SELECT doc_id, {_protein('dnt', '0')} AS p FROM (SELECT doc_id, {NT} AS dnt FROM documents)) WHERE length(p) >= {K}"


def _least(t: float) -> str:
    return f"n_found >= ceil((n_kmers / 100.0::DOUBLE) * {float(t)}::DOUBLE)"


def _protein(nt: str, frame: str) -> str:
    def at(j: int) -> str:
        return f"strpos('TCAG', substr(c, {j}, 1))"

    letter = f"CASE WHEN {at(1)} > 0 AND {at(2)} > 0 AND {at(3)} > 0 THEN substr('{CODE}', ({at(1)} - 1) * 16 + ({at(2)} - 1) * 4 + {at(3)}, 1) ELSE 'X' END"
    return f"array_to_string([{letter} for c in regexp_extract_all(substr({nt}, {frame} + 1), '[A-Z][A-Z][A-Z]')], '')"


def _frames(rows: str, k: int) -> str:
    parts = [f"SELECT CAST(item_id AS VARCHAR) || '_{way}_reading_frame_{f}' AS frame_id, {_protein(nt, str(f))} AS protein FROM nt" for way, nt in (("forward", "nt"), ("reverse", "rc")) for f in range(3)]
    return f"nt AS (SELECT item_id, {NT} AS nt, translate(reverse({NT}), 'ACGTUN', 'TGCAAN') AS rc FROM {rows}), frames AS (SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE length(protein) >= {k})"


def _hashes(rows: str = "benchmark", key: str = "item_id") -> str:
    """MurmurHash64A of 8-byte k-mers, seeds 0 and 1, in unsigned 128-bit arithmetic, of each different k-mer once."""
    two64, mul = "18446744073709551616::UHUGEINT", f"{0xC6A4A7935BD1E995}::UHUGEINT"
    byte = " + ".join(f"CAST((strpos('{HEX}', substr(x, {2 * j + 1}, 1)) - 1) * 16 + strpos('{HEX}', substr(x, {2 * j + 2}, 1)) - 1 AS UHUGEINT) * {256**j}::UHUGEINT" for j in range(8))
    start = [f"{s ^ (8 * 0xC6A4A7935BD1E995) % (1 << 64)}::UHUGEINT" for s in range(H)]
    return f"""g AS MATERIALIZED (SELECT {key}, i - 1 AS pos, substr(hx, 2 * i - 1, 16) AS x FROM (SELECT {key}, hex(encode(text)) AS hx, unnest(generate_series(1, octet_length(encode(text)) - 7)) AS i FROM {rows})),
    w AS (SELECT x, (({byte}) * {mul}) % {two64} AS a FROM (SELECT DISTINCT x FROM g)),
    mixed AS (SELECT x, (xor(a, a >> 47) * {mul}) % {two64} AS a FROM w),
    seeded AS (SELECT x, s AS seed, (xor(CASE s WHEN 0 THEN {start[0]} ELSE {start[1]} END, a) * {mul}) % {two64} AS b FROM mixed, (SELECT unnest([0, 1]) AS s)),
    last AS (SELECT x, seed, (xor(b, b >> 47) * {mul}) % {two64} AS c FROM seeded),
    places AS MATERIALIZED (SELECT x, CAST(seed AS BIGINT) AS seed, CAST(xor(c, c >> 47) % {SMALL_M} AS BIGINT) AS bit FROM last),
    bits AS (SELECT {key}, CAST(pos AS BIGINT) AS pos, seed, bit FROM g JOIN places USING (x))"""


def _hashed_documents() -> str:
    """``held``: the distinct positions of each document, by its number in the order of the samples."""
    order = f"SELECT doc_id, row_number() OVER (ORDER BY octet_length(encode(text)), CAST(doc_id AS VARCHAR)) - 1 AS sample_idx FROM documents WHERE octet_length(encode(text)) >= {SMALL_K}"
    return f"{_hashes('documents', 'doc_id')}, held AS (SELECT DISTINCT doc_id, bit FROM g JOIN places USING (x)), numbered AS ({order})"


def _contained() -> str:
    """Documents that hold all k-mers of another, by way of each one's rarest."""
    return f"""WITH g AS MATERIALIZED (SELECT DISTINCT doc_id, x FROM (SELECT doc_id, {_slices('text', K)} AS x FROM documents)), df AS (SELECT x, count(*) AS df FROM g GROUP BY 1),
    n AS (SELECT doc_id, count(*) AS n, arg_min(x, df) AS rare FROM g JOIN df USING (x) GROUP BY 1), cand AS (SELECT n.doc_id, g.doc_id AS held_by, n FROM n JOIN g ON g.x = n.rare),
    met AS (SELECT c.doc_id, c.held_by, n, count(*) AS k FROM cand c JOIN g a ON a.doc_id = c.doc_id JOIN g b ON b.doc_id = c.held_by AND b.x = a.x GROUP BY ALL)
    SELECT doc_id, held_by, CAST(octet_length(encode(text)) - {K - 1} AS BIGINT) AS n_kmers FROM met JOIN documents USING (doc_id) WHERE k = n"""


def _report_text() -> str:
    """A report's lines and their numbers, of the hits at 2."""
    order = f"SELECT doc_id, row_number() OVER (ORDER BY octet_length(encode(text)), CAST(doc_id AS VARCHAR)) AS place FROM documents WHERE octet_length(encode(text)) >= {K}"
    return f"""WITH hits AS ({_contain(_least(2))}), numbered AS ({order}), lines AS (
    SELECT -1 AS item_id, 0 AS place, 0 AS part, 'The query sequence(s) were found in the following sample(s):' AS line
    UNION ALL SELECT DISTINCT item_id, 0, 1, 'Query sequence id: ' || item_id FROM hits UNION ALL SELECT DISTINCT item_id, 0, 2, chr(9) || 'Sample identifier(s):' FROM hits
    UNION ALL SELECT item_id, place, 3, chr(9) || chr(9) || doc_id || ', Number of kmers found: ' || n_found || ' (' || {LABEL} || '%)' FROM hits JOIN numbered USING (doc_id))
    SELECT row_number() OVER (ORDER BY item_id, place, part) - 1 AS no, line FROM lines"""


WIDTH = C.bucket_width(SMALL_M)
LABEL = "regexp_replace(printf('%.2f', n_found / n_kmers * 100), '0$', '')"


def _sql() -> dict[str, str]:
    search_2 = _contain(_least(2))
    return {
        "q_kmer_count": f"SELECT doc_id, CAST(greatest(octet_length(encode(text)) - {K - 1}, 0) AS BIGINT) AS n_kmers FROM documents",
        "q_kmer_distinct_per_sample": f"SELECT doc_id, count(DISTINCT g) AS n_distinct FROM (SELECT doc_id, unnest(CASE WHEN octet_length(encode(text)) < {K} THEN [NULL] ELSE [encode(text)[i:i+{K - 1}] for i in generate_series(1, octet_length(encode(text))-{K - 1})] END) AS g FROM documents) GROUP BY 1",
        "q_alphabet_check": f"SELECT doc_id, CASE WHEN regexp_full_match(text, '[ATGCN]*') THEN 'nucleotide' ELSE 'aminoacid' END AS of_text, CASE WHEN regexp_full_match({NT}, '[ATGCN]*') THEN 'nucleotide' ELSE 'aminoacid' END AS of_derived FROM documents",
        "q_revcomp": f"SELECT doc_id, length({NT}) AS n, md5(translate(reverse({NT}), 'ACGTUN', 'TGCAAN')) AS digest FROM documents",
        "q_canonical_kmers": f"WITH g AS (SELECT item_id, substr(nt, i, {K}) AS x FROM (SELECT item_id, {NT} AS nt, unnest(generate_series(1, length({NT}) - {K - 1})) AS i FROM benchmark)) SELECT item_id, least(x, translate(reverse(x), 'ACGTUN', 'TGCAAN')) AS kmer, count(*) AS n FROM g GROUP BY ALL",
        "q_translate_frames": f"WITH nt AS (SELECT item_id, {NT} AS nt, unnest([0, 1, 2]) AS f FROM benchmark) SELECT item_id, CAST(f AS INTEGER) AS frame, {_protein('nt', 'f')} AS protein FROM nt",
        "q_six_frame": f"WITH {_frames('benchmark', K)} SELECT frame_id, protein FROM frames",
        "q_kmer_hash_bits": f"WITH {_hashes()} SELECT item_id, pos, seed, bit FROM bits",
        "q_bloom_fill": f"WITH {_hashed_documents()} SELECT doc_id, count(*) AS n_bits, count(*) / {float(SMALL_M)}::DOUBLE AS fill FROM held GROUP BY 1",
        "q_bitslice_postings": f"WITH {_hashed_documents()} SELECT bit, count(*) AS n_samples, min(sample_idx) AS first_sample, max(sample_idx) AS last_sample FROM held JOIN numbered USING (doc_id) GROUP BY 1",
        "q_bitslice_and": f"WITH {_hashes('(SELECT item_id AS id, text FROM benchmark UNION ALL SELECT -1 - doc_id, text FROM documents)', 'id')}, b AS MATERIALIZED (SELECT DISTINCT id, bit FROM bits), n AS (SELECT id, count(*) AS n FROM b WHERE id >= 0 GROUP BY 1) SELECT q.id AS item_id, -1 - s.id AS doc_id FROM b q JOIN b s USING (bit) JOIN n ON n.id = q.id WHERE s.id < 0 GROUP BY q.id, s.id, n HAVING count(*) = n",
        "q_binning": f"WITH {_hashes('documents', 'doc_id')} SELECT (bit // {WIDTH} + 1) * {WIDTH} AS edge, count(DISTINCT bit) AS n_bits FROM places GROUP BY 1",
        "q_index_hits_profile": f"WITH {_hashes()} SELECT item_id, count(DISTINCT bit) AS n_bits, count(DISTINCT bit // {WIDTH}) AS n_parts FROM bits GROUP BY 1",
        "q_search_exact": _contain("n_found = n_kmers"),
        "q_search_approx_t1": _contain(_least(1)),
        "q_search_approx_t5": _contain(_least(5)),
        "q_search_approx_t50": _contain(_least(50)),
        "q_search_t0": f"WITH hits AS ({_contain('true')}), n AS (SELECT item_id, CAST(octet_length(encode(text)) - {K - 1} AS BIGINT) AS n_kmers FROM benchmark) SELECT n.item_id, d.doc_id, coalesce(n_found, 0) AS n_found, n.n_kmers FROM n CROSS JOIN documents d LEFT JOIN hits h ON h.item_id = n.item_id AND h.doc_id = d.doc_id WHERE n.n_kmers > 0",
        "q_index_t0": f"WITH hits AS ({_contain('true')}), n AS (SELECT item_id, CAST(octet_length(encode(text)) - {K - 1} AS BIGINT) AS n_kmers FROM benchmark) SELECT n.item_id, d.doc_id, coalesce(n_found, 0) AS n_found, n.n_kmers FROM n CROSS JOIN documents d LEFT JOIN hits h ON h.item_id = n.item_id AND h.doc_id = d.doc_id WHERE n.n_kmers > 0 AND octet_length(encode(d.text)) >= {K}",
        "q_search_duplicates": _contain(_least(50), query="text || text"),
        "q_search_sources": _contain(_least(5), key="source", rows="(SELECT * FROM documents WHERE source IS NOT NULL)"),
        "q_search_six_frame": f"WITH {_frames('benchmark', 7)}, q AS (SELECT frame_id, {_slices('protein', 7)} AS g FROM frames), n AS (SELECT frame_id, count(*) AS n_kmers, count(DISTINCT g) AS kinds FROM q GROUP BY 1), dn AS (SELECT doc_id, {NT} AS dnt FROM documents), dp AS (SELECT doc_id, {_protein('dnt', '0')} AS protein FROM dn), d AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, {_slices('protein', 7)} AS g FROM dp) WHERE g IN (SELECT g FROM q)), h AS (SELECT frame_id, doc_id, count(*) AS held FROM (SELECT DISTINCT frame_id, g FROM q) JOIN d USING (g) GROUP BY ALL) SELECT frame_id, doc_id, n_kmers FROM h JOIN n USING (frame_id) WHERE held = kinds",
        "q_update_equals_rebuild": _contain(_least(20)),
        "q_matrices_equal_rebuild": _contain(_least(20)),
        "q_merged_equals_rebuild": _contain(_least(20)),
        "q_search_verified": _contain(_least(50)),
        "q_search_many": _contained(),
        "q_search_reads": _contain_nt(_least(50), f"SELECT doc_id, substr(nt, i, {READ}) AS nt FROM (SELECT doc_id, nt, unnest(generate_series(1, length(nt), {READ})) AS i FROM (SELECT doc_id, {NT} AS nt FROM documents))"),
        "q_update_sequences": f"SELECT item_id, source, n_found, n_kmers FROM ({search_2}) JOIN documents USING (doc_id) WHERE source IS NOT NULL",
        "q_fasta_pieces": f"SELECT seq_id, n, n - {K - 1} AS n_kmers FROM ({_files()})",
        "q_manifest_errors": "SELECT CASE s_suppkey % 5 WHEN 0 THEN 'characters that are not allowed in a sample identifier' WHEN 1 THEN 'one sample identifier is required per line' WHEN 2 THEN 'a space must follow the colon, and a path that' ELSE 'none' END AS error, count(*) AS n, CAST(sum(CASE WHEN s_suppkey % 5 > 2 THEN 2 ELSE 0 END) AS BIGINT) AS n_paths FROM supplier GROUP BY 1",
        "q_report_text": _report_text(),
        "q_scan_exact": _contain("n_found = n_kmers"),
        "q_scan_approx_t1": _contain(_least(1)),
        "q_search_nt_exact": _contain_nt("n_found = n_kmers"),
        "q_search_nt_t50": _contain_nt(_least(50)),
        "q_search_repeated_ids": f"SELECT item_id % 3 AS item_id, doc_id, n_found, n_kmers FROM ({search_2})",
        "q_search_sequences": f"SELECT item_id, source, n_found, n_kmers FROM ({search_2}) JOIN documents USING (doc_id) WHERE source IS NOT NULL",
        "q_fasta_read": _files(),
        "q_fastq_read": _files(),
        "q_report_rows": f"SELECT item_id, doc_id, n_found, {LABEL} || '%' AS pct FROM ({search_2})",
        "q_sample_order": f"WITH s AS (SELECT CAST(conv_id AS VARCHAR) AS sample_id, CAST(sum(octet_length(encode(text))) AS BIGINT) AS n_bytes FROM conversations GROUP BY 1 HAVING max(octet_length(encode(text))) >= {K}) SELECT row_number() OVER (ORDER BY n_bytes, sample_id) - 1 AS sample_idx, sample_id, n_bytes FROM s",
        "q_manifest_parse": "SELECT replace(s_name, '#', '-') AS sample_id, unnest(['/in/' || s_suppkey || '.fa', '/in/' || s_nationkey || '.fq.gz']) AS path FROM supplier WHERE s_suppkey % 10 <> 0",
        "q_report_lines": f"SELECT item_id, doc_id, chr(9) || chr(9) || doc_id || ', Number of kmers found: ' || n_found || ' (' || {LABEL} || '%)' AS line FROM ({search_2})",
        "q_report_stats": f"SELECT count(DISTINCT item_id) AS n_queries, count(*) AS n_hits, count(DISTINCT doc_id) AS n_samples FROM ({search_2})",
        "q_summary": f"SELECT count(*) AS number_of_samples, CAST(sum(octet_length(encode(text))) AS BIGINT) AS sequence_bytes, count(*) * {M // 8} AS raw_bytes, {K} AS k, 0 AS update_count FROM documents WHERE octet_length(encode(text)) >= {K}",
        "q_sizing": "SELECT p_partkey, CAST(ceil(-(p_size * 1000 * ln(0.01::DOUBLE)) / (ln(2.0::DOUBLE) * ln(2.0::DOUBLE))) AS BIGINT) AS m, CAST(greatest(round(ceil(-(p_size * 1000 * ln(0.01::DOUBLE)) / (ln(2.0::DOUBLE) * ln(2.0::DOUBLE))) / (p_size * 1000) * ln(2.0::DOUBLE)), 1) AS BIGINT) AS h, CAST(ceil(-(3.0::DOUBLE * p_size * 1000) / ln(1.0::DOUBLE - exp(ln(0.01::DOUBLE) / 3.0::DOUBLE))) AS BIGINT) AS m_for_3, 0.01::DOUBLE * (p_size * 1000) AS expected FROM part",
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "q_kmer_count": kmer_count, "q_kmer_distinct_per_sample": kmer_distinct, "q_alphabet_check": alphabet_check, "q_revcomp": revcomp,
        "q_canonical_kmers": canonical_kmers, "q_translate_frames": translate_frames, "q_six_frame": six_frame, "q_kmer_hash_bits": kmer_hash_bits,
        "q_bloom_fill": bloom_fill, "q_bitslice_postings": bitslice_postings, "q_bitslice_and": bitslice_and, "q_binning": binning,
        "q_index_hits_profile": index_hits_profile, "q_search_exact": partial(search_at, 100), "q_search_approx_t1": partial(search_at, 1),
        "q_search_approx_t5": partial(search_at, 5), "q_search_approx_t50": partial(search_at, 50), "q_search_t0": partial(scan_at, 0), "q_index_t0": partial(search_at, 0),
        "q_search_duplicates": search_duplicates, "q_search_repeated_ids": search_repeated_ids, "q_search_sources": search_sources, "q_search_six_frame": search_six_frame,
        "q_search_nt_exact": partial(search_nt_at, 100), "q_search_nt_t50": partial(search_nt_at, 50), "q_search_sequences": search_sequences,
        "q_search_reads": search_reads, "q_search_many": search_many, "q_search_verified": search_verified, "q_merged_equals_rebuild": merged_equals_rebuild,
        "q_update_sequences": update_sequences, "q_fasta_pieces": fasta_pieces, "q_manifest_errors": manifest_errors, "q_report_text": report_text,
        "q_scan_exact": partial(scan_at, 100), "q_scan_approx_t1": partial(scan_at, 1),
        "q_update_equals_rebuild": update_equals_rebuild, "q_matrices_equal_rebuild": matrices_equal_rebuild, "q_sample_order": sample_order, "q_manifest_parse": manifest_parse,
        "q_fasta_read": fasta_read, "q_fastq_read": fastq_read, "q_report_lines": report_line, "q_report_rows": report_rows, "q_report_stats": report_stat, "q_summary": summary, "q_sizing": sizing,
    }


def oracle_sql() -> dict[str, str]:
    return _sql()
