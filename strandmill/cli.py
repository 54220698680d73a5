"""The command line: ``python -m strandmill.cli COMMAND ...``."""

from __future__ import annotations

import argparse
import sys
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strandmill.operators import index
from strandmill.operators.search import detected_type, search
from strandmill.plans.config import Config, read_config
from strandmill.ship import ship
from strandmill.sources.reports import write_report
from strandmill.sources.sequences import read_record_samples, read_samples, read_sequences

VERSION = "0.1.0"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandmill", description="k-mer search over Bloom-filter bit slices")
    top.add_argument("--version", action="version", version=VERSION)
    sub = top.add_subparsers(dest="command")
    for name, what in (("build", "index the samples of a manifest"), ("build-seq", "index each record of a file as a sample"), ("update", "append the samples of a manifest"), ("update-seq", "append each record of a file"), ("build_matrix", "write the Bloom matrix only")):
        p = sub.add_parser(name, help=what)
        p.add_argument("input_file")
        p.add_argument("config_file")
    for name, what in (("build_index", "index an existing matrix"), ("update_index", "append an existing matrix"), ("compact", "merge the batches of many updates and remove those replaced"), ("summary", "print an index's settings and sizes")):
        sub.add_parser(name, help=what).add_argument("config_file")
    p = sub.add_parser("search_index", help="search sequences")
    p.add_argument("config_file")
    one = p.add_mutually_exclusive_group(required=True)
    one.add_argument("-s", "--sequence")
    one.add_argument("-f", "--file")
    p.add_argument("-i", "--type", choices=("nucleotide", "aminoacid"), required=True)
    p.add_argument("-t", "--threshold", type=int, default=100)
    return top


def _search(spark: SparkSession, args: argparse.Namespace, config: Config) -> None:
    if args.sequence:
        queries = spark.createDataFrame([("user_input_seq", args.sequence)], "query_id string, seq string")
    else:
        queries = read_sequences(spark, args.file, config.k).select(F.col("seq_id").alias("query_id"), "seq")
    held = index.Index(spark, config.index_path)
    config.agree(held.settings)
    kind = detected_type(queries)
    if kind is None:
        print("there is no query of k letters at least")
        return
    if kind != args.type:
        print(f"warning: the queries were declared {args.type} and look like {kind}", file=sys.stderr)
    hits = search(queries, held, args.threshold, args.type)
    path = f"{config.output_directory.rstrip('/')}/query_results-{datetime.now(UTC):%Y%m%dT%H%M%S%f}_t{args.threshold}.txt"
    single = bool(args.sequence) and not (args.type == "nucleotide" and not held.canonical)
    print(path if write_report(hits, path, args.threshold, single) else f"no sample holds enough of a query (threshold {args.threshold})")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    top = parser()
    args = top.parse_args(argv)
    if not args.command:
        top.print_help()
        return 0
    spark = spark or SparkSession.builder.appName("strandmill").getOrCreate()
    ship(spark)
    config = read_config(args.config_file, spark)
    if args.command in ("build", "update", "build_matrix"):
        records = read_samples(spark, args.input_file, config.k, f"{config.output_directory.rstrip('/')}/nonexistent_file_paths.txt")
        {"build": index.build, "update": index.update, "build_matrix": index.build_matrix}[args.command](records, config)
    elif args.command in ("build-seq", "update-seq"):
        (index.build if args.command == "build-seq" else index.update)(read_record_samples(spark, args.input_file, config.k), config)
    elif args.command in ("build_index", "update_index"):
        if index.index_exists(spark, config.index_path) == (args.command == "build_index"):
            raise SystemExit(f"{config.index_path} is {'already' if args.command == 'build_index' else 'not'} there")
        index.build_from_matrix(spark, config)
    elif args.command == "compact":
        merges = index.compact(spark, config, full=True)
        print(f"{merges} merges, {len(index.vacuum(spark, config))} batches removed")
    elif args.command == "summary":
        print(index.summary_yaml(index.summary(spark, config.index_path)), end="")
    else:
        _search(spark, args, config)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
