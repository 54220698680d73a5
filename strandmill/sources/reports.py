"""Search results as text reports, and such reports read again, line by line."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandmill.functions.columns import percent_label
from strandmill.storage import join_files, shared_path

#: The wording of a report. Fixed values.
TITLE = "The query sequence(s) were found in the following sample(s):"
QUERY, SAMPLES = "Query sequence id: ", "\tSample identifier(s):"
MANY, ONE = ", Number of kmers found: ", ", Number of K-mers found: "


def report_lines(hits: DataFrame, threshold: float, single: bool = False) -> DataFrame:
    """(query_no, query_id, sample_idx, line): a line for each hit, without the lines around it."""
    label = percent_label("n_found", "n_kmers")
    if threshold == 100:
        line = F.concat(F.lit("" if single else "\t\t"), "sample_id")
    else:
        line = F.concat(F.lit("\t" if single else "\t\t"), "sample_id", F.lit(ONE if single else MANY), label)
    return hits.select("query_no", "query_id", "sample_idx", line.alias("line"))


def report(hits: DataFrame, threshold: float, single: bool = False) -> DataFrame:
    """(query_no, sample_idx, value): a report's lines, those around a hit before it in its row; none without hits.

    The heading of a query stands before its first sample, and the title before the first query of all, both found by
    aggregates, so that each row is made by itself. Queries that share an id stand apart.
    """
    lines = report_lines(hits, threshold, single)
    first = lines.agg(F.min(F.struct("query_no", "sample_idx")).alias("first"))
    title = F.concat(F.lit(f"{TITLE}\n"), F.lit(f"{SAMPLES.strip()}\n" if single and threshold != 100 else ""))
    out = lines.crossJoin(F.broadcast(first))  # one row
    above = F.when((F.col("query_no") == F.col("first.query_no")) & (F.col("sample_idx") == F.col("first.sample_idx")), title).otherwise("")
    heading = F.lit("")
    if not single:
        heads = lines.groupBy("query_no").agg(F.min("sample_idx").alias("head"))
        out = out.join(heads, "query_no")
        heading = F.when(F.col("sample_idx") == F.col("head"), F.concat(F.lit(QUERY), F.coalesce(F.col("query_id").cast("string"), F.lit("None")), F.lit(f"\n{SAMPLES}\n"))).otherwise("")
    return out.select("query_no", "sample_idx", F.concat(above, heading, "line").alias("value"))


def write_report(hits: DataFrame, path: str, threshold: float, single: bool = False) -> bool:
    """Writes a report file, on any file system that Spark knows; False, and no file, if there are no hits.

    The hits are sorted into ranges of queries and samples; each task writes the lines of its own, and the parts are
    put together in their order, as bytes. No hit comes to the driver.
    """
    spark = hits.sparkSession
    held = shared_path(spark, "hits")
    hits.write.parquet(held)  # they are sorted, and counted for the headings
    hits = spark.read.schema(hits.schema).parquet(held)
    parts = shared_path(spark, "report")
    report(hits, threshold, single).orderBy("query_no", "sample_idx").select("value").write.text(parts)
    return join_files(spark, parts, path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """(query_no, query_id, sample_id, n_found, pct) of a report; count and percentage null in an exact one.

    Lines are read in splits. Each task names the query of its lines from the last heading before them; what stands
    before a task's first heading belongs to the last heading of the splits before. ``query_no`` counts headings in
    the file's order by their places, not from 0. A report of a single sequence has no heading: its query_id is null.
    """

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[tuple[str, int], list] = {}
        for batch in batches:
            out = []
            for line, path, begin in zip(*(c.to_pylist() for c in batch.columns)):
                state = last.setdefault((path, begin), [None, 0])
                if line.startswith(QUERY):
                    state[0], state[1] = line[len(QUERY) :], state[1] + 1
                    out.append((path, begin, state[1], state[0], None))
                elif line and line != TITLE and line.strip() != SAMPLES.strip():
                    out.append((path, begin, state[1], state[0], line.lstrip("\t")))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["path", "begin", "head", "query_id", "body"])

    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("begin"))
    rows = lines.mapInArrow(headed, "path string, begin bigint, head bigint, query_id string, body string")
    # One row per split: its last heading, or if it has none that of the splits before.
    ends = rows.groupBy("path", "begin").agg(F.max(F.struct("head", "query_id")).alias("end"))
    before = F.last(F.when(F.col("end.head") > 0, F.struct("begin", "end.head", "end.query_id")), ignorenulls=True).over(Window.partitionBy("path").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.where("body IS NOT NULL").join(F.broadcast(ends.select("path", "begin", before.alias("before"))), ["path", "begin"])
    own = F.col("head") > 0
    no = F.when(own, F.col("begin") + F.col("head")).otherwise(F.col("before.begin") + F.col("before.head"))
    found = F.regexp_extract("body", rf"^(.*)(?:{MANY}|{ONE})(\d+) \((.*)\)$", 2)
    exact = found == ""
    name = F.when(exact, F.col("body")).otherwise(F.regexp_extract("body", rf"^(.*)(?:{MANY}|{ONE})(\d+) \((.*)\)$", 1))
    return rows.select(no.alias("query_no"), F.when(own, F.col("query_id")).otherwise(F.col("before.query_id")).alias("query_id"), name.alias("sample_id"), F.when(~exact, found.try_cast("long")).alias("n_found"), F.when(~exact, F.regexp_extract("body", r"\(([^()]*)\)$", 1)).alias("pct"))


def report_stats(hits: DataFrame) -> DataFrame:
    """(n_queries, n_hits, n_samples) of hits or of a report; queries that share an id count each."""
    return hits.agg(F.countDistinct(F.coalesce("query_no", F.lit(-1))).alias("n_queries"), F.count("*").alias("n_hits"), F.countDistinct("sample_id").alias("n_samples"))
