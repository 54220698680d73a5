import gzip
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strandmill import cli
from strandmill.operators import index
from strandmill.operators.search import search
from strandmill.plans.config import Config, parse_config
from strandmill.sources.reports import read_report, report, report_stats, write_report
from strandmill.sources.sequences import file_kind, parse_manifest, read_fasta, read_fastq, read_samples, write_fasta
from strandmill.streaming.append import append_batch, append_stream

TOY = [("S1", "ABCDEF"), ("S2", "ABCXEF"), ("S3", "AB"), ("S4", None)]


def frame(spark, rows, names="sample_id string, seq string"):
    return spark.createDataFrame(rows, names)


@pytest.fixture(scope="module")
def toy(spark, tmp_path_factory):
    config = Config(3, 2, 1 << 40, "aminoacid", str(tmp_path_factory.mktemp("toy")))
    index.build(frame(spark, TOY), config)
    return config


def report_text(found, t, single=False):
    return "\n".join(r["value"] for r in report(found, t, single).orderBy("query_no", "sample_idx").collect()).splitlines()


def hits(spark, config, query, t, **more):
    found = search(frame(spark, [("q", query)], "query_id string, seq string"), index.Index(spark, config.index_path), t, **more)
    return {r["sample_id"]: (r["n_found"], r["n_kmers"]) for r in found.collect()}


def test_search(spark, toy):
    assert hits(spark, toy, "ABCD", 100) == {"S1": (2, 2)}
    assert hits(spark, toy, "abcd", 50) == {"S1": (2, 2), "S2": (1, 2)}
    assert hits(spark, toy, "XYZW", 0) == {"S1": (0, 2), "S2": (0, 2)}
    assert hits(spark, toy, "ABC", 100) == {"S1": (1, 1), "S2": (1, 1)}
    assert hits(spark, toy, "ABCABC", 50) == {"S1": (2, 4), "S2": (2, 4)}
    assert hits(spark, toy, "AB", 100) == {} == hits(spark, toy, "AB", 0)
    with pytest.raises(ValueError):
        hits(spark, toy, "ABC", 101)
    with pytest.raises(FileExistsError):
        index.build(frame(spark, TOY), toy)


def test_tiny_filters_never_lose_hits(spark, tmp_path):
    config = Config(3, 3, 8, "aminoacid", str(tmp_path))
    index.build(frame(spark, TOY), config)
    assert hits(spark, config, "ABCD", 100).keys() >= {"S1"}


def test_update_is_rebuild(spark, tmp_path):
    rows = [(f"s{i}", "ACGTTGCAAC"[i % 3 :] * (1 + i % 4)) for i in range(12)]
    queries = frame(spark, [("a", "ACGTTG"), ("b", "CAACACG")], "query_id string, seq string")
    found = []
    for name, parts in (("one", [rows]), ("two", [rows[:5], rows[5:]])):
        config = Config(5, 2, 1 << 31, "nucleotide", str(tmp_path / name))
        index.build(frame(spark, parts[0]), config)
        for more in parts[1:]:
            index.update(frame(spark, more), config)
        for t in (100, 40, 0):
            found.append(sorted((r["query_id"], r["sample_id"], r["n_found"]) for r in search(queries, index.Index(spark, config.index_path), t).collect()))
        assert index.summary(spark, config.index_path)["store"]["update_count"] == len(parts) - 1
    assert found[:3] == found[3:]
    with pytest.raises(ValueError):
        index.update(frame(spark, rows), Config(6, 2, 1 << 31, "nucleotide", str(tmp_path / "one")))


def test_matrix_then_index(spark, tmp_path):
    config = Config(3, 1, 1 << 31, "aminoacid", str(tmp_path))
    index.build_matrix(frame(spark, TOY), config)
    index.build_from_matrix(spark, config)
    assert hits(spark, config, "ABCD", 100) == {"S1": (2, 2)}


def test_six_frames_and_types(spark, tmp_path):
    config = Config(3, 2, 1 << 31, "aminoacid", str(tmp_path))
    index.build(frame(spark, [("p", "MAWPK")]), config)
    found = search(frame(spark, [("n", "ATGGCCTGGCCA")], "query_id string, seq string"), index.Index(spark, config.index_path), 100, "nucleotide").collect()
    assert [(r["query_id"], r["sample_id"]) for r in found] == [("n_forward_reading_frame_0", "p")]
    with pytest.raises(PySparkException):
        search(frame(spark, [("n", "PROTEIN")], "query_id string, seq string"), index.Index(spark, config.index_path), 100, "nucleotide").collect()
    nt = Config(3, 2, 1 << 31, "nucleotide", str(tmp_path / "nt"))
    index.build(frame(spark, [("n", "ACGTA")]), nt)
    with pytest.raises(ValueError):
        search(frame(spark, [("n", "ACG")], "query_id string, seq string"), index.Index(spark, nt.index_path), 100, "aminoacid")


def test_readers(spark, tmp_path):
    fasta = tmp_path / "a.fa"
    fasta.write_text(">one first\r\nacg\r\nTTT\r\n>two\nAC\n>three x > y\nACGTACGT\n")
    got = {r["seq_id"]: r["seq"] for r in read_fasta(spark, str(fasta)).collect()}
    assert got == {"one": "ACGTTT", "two": "AC", "three": "ACGTACGT"}
    assert read_fasta(spark, str(fasta), 3).count() == 2
    fastq = tmp_path / "b.fq.gz"
    with gzip.open(fastq, "wt") as out:
        out.write("@r1 x\nACGT\n+\n@+II\n@r2\nggg\n+r2\n+++\n")
    assert {r["seq_id"]: r["seq"] for r in read_fastq(spark, str(fastq)).collect()} == {"r1": "ACGT", "r2": "GGG"}
    assert file_kind(spark, str(fasta)) == "fasta" and file_kind(spark, str(fastq)) == "fastq"
    write_fasta(read_fasta(spark, str(fasta)), str(tmp_path / "out"))
    assert {r["seq_id"]: r["seq"] for r in read_fasta(spark, str(tmp_path / "out")).collect()} == got
    manifest = tmp_path / "m.txt.gz"
    with gzip.open(manifest, "wt") as out:
        out.write(f"# c\n\nA: {fasta}; {fastq}\nB: {fasta}\n")
    rows = read_samples(spark, str(manifest))
    assert {r["sample_id"]: r["n"] for r in rows.groupBy("sample_id").agg(F.count("*").alias("n")).collect()} == {"A": 5, "B": 3}
    (tmp_path / "bad.txt").write_text("A: /not/there\n")
    with pytest.raises(FileNotFoundError):
        read_samples(spark, str(tmp_path / "bad.txt"), report=str(tmp_path / "gone.txt"))
    assert (tmp_path / "gone.txt").read_text() == "/not/there\n"


@pytest.mark.parametrize("size", ["16", "37", "1m"])
def test_fastq_across_splits(spark, tmp_path, size):
    (tmp_path / "a.fq").write_text("".join(f"@r{i} @x\n{'ACGT' * (i % 7 + 1)}\n+\n{'@+I>' * (i % 7 + 1)}\n" for i in range(60)))
    (tmp_path / "b.fq").write_text("@s\nACGTN\n+\n@@@@@\n@cut\nAC")
    old = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = read_fastq(spark, [str(tmp_path / "a.fq"), str(tmp_path / "b.fq")])
        assert got.rdd.getNumPartitions() > (20 if size != "1m" else 0)
        assert sorted((r["seq_id"], r["seq"]) for r in got.collect()) == sorted([(f"r{i}", "ACGT" * (i % 7 + 1)) for i in range(60)] + [("s", "ACGTN"), ("cut", "AC")])
        lines = [QUERY_LINES[i % len(QUERY_LINES)] for i in range(40)]
        (tmp_path / "r.txt").write_text("\n".join(["The query sequence(s) were found in the following sample(s):", *lines]) + "\n")
        found = read_report(spark, str(tmp_path / "r.txt"))
        assert sorted((r["query_id"], r["sample_id"]) for r in found.collect()) == sorted([("q:1", "s1"), ("q:1", "s2"), ("q", "s1")] * 5)
        assert report_stats(found).first().asDict() == {"n_queries": 10, "n_hits": 15, "n_samples": 2}
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)


QUERY_LINES = ["Query sequence id: q:1", "\tSample identifier(s):", "\t\ts1", "\t\ts2", "Query sequence id: q", "\tSample identifier(s):", "\t\ts1, Number of kmers found: 3 (1.5%)", ""]


def test_repeated_ids_and_plan(spark, toy, tmp_path):
    queries = frame(spark, [("q", "ABCD"), ("q", "ABCD"), ("q", "CXEF"), (None, "ABC")], "query_id string, seq string")
    held = index.Index(spark, toy.index_path)
    for t, n in ((100, 5), (50, 7), (0, 8)):
        found = search(queries, held, t)
        assert len({(r["query_no"], r["sample_id"]) for r in found.collect()}) == n
    lines = report_text(search(queries, held, 100), 100)
    assert lines.count("Query sequence id: q") == 3
    plan = search(queries, held, 100)._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.splitlines() if "FileScan" in x and "slices" in x)
    assert "PartitionFilters: [bucket" in scan or "bucket#" in scan.split("PartitionFilters")[1]
    assert "EqualTo(fine" in scan


def test_samples_that_share_an_id(spark, tmp_path):
    config = Config(3, 1, 1 << 31, "aminoacid", str(tmp_path))
    rows = frame(spark, [("s", "ABCDEF"), ("s", "ABCXEF"), ("s", "AB"), (None, "ABCD")])
    index.build(index.by_record(rows), config)
    assert index.Index(spark, config.index_path).samples.count() == 2
    found = search(frame(spark, [("q", "BCXE")], "query_id string, seq string"), index.Index(spark, config.index_path), 0).collect()
    assert sorted((r["sample_id"], r["n_found"]) for r in found) == [("s", 0), ("s", 2)]
    (tmp_path / "a.fa").write_text(">x\nABCDEF\n")
    (tmp_path / "b.fa").write_text(">x\nABCXEF\n")
    (tmp_path / "m.txt").write_text(f"S: {tmp_path}/a.fa\nS: {tmp_path}/b.fa; {tmp_path}/a.fa\n")
    index.update(read_samples(spark, str(tmp_path / "m.txt"), 3), config)
    assert index.Index(spark, config.index_path).samples.count() == 4
    found = search(frame(spark, [("q", "BCXE"), ("r", "ABCD")], "query_id string, seq string"), index.Index(spark, config.index_path), 100).collect()
    assert sorted((r["query_id"], r["sample_id"]) for r in found) == [("q", "S"), ("q", "s"), ("r", "S"), ("r", "S"), ("r", "s")]


def test_many_parts_and_wide_filters(spark, tmp_path, monkeypatch):
    """Several slabs, and positions beyond 32 bits: the same hits as by plain search of strings."""
    rng = random.Random(2)
    rows = [(f"s{i}", "".join(rng.choice("ACEG") for _ in range(rng.randrange(1, 60)))) for i in range(80)]
    queries = [(i, s[1][j : j + 9]) for i, s in enumerate(rows[:20]) for j in (0, 3) if len(s[1]) >= j + 9]
    expected = set()
    for _, q in queries:
        grams = [q[i : i + 4] for i in range(len(q) - 3)]
        for name, text in rows:
            n = sum(g in text for g in grams)
            if len(text) >= 4 and n >= 3:
                expected.add((q, name, n))
    for m, slabs in ((1 << 31, 4), (1 << 50, 8), ((1 << 61) + 7, 2)):
        class Small(index.Grid):
            @classmethod
            def of(cls, m, pairs, slabs=slabs):
                return cls(m, slabs)

        monkeypatch.setattr(index, "Grid", Small)
        config = Config(4, 2, m, "aminoacid", str(tmp_path / str(m)))
        index.build(frame(spark, rows[:50]), config)
        index.update(frame(spark, rows[50:]), config)
        held = index.Index(spark, config.index_path)
        found = search(frame(spark, queries, "query_id long, seq string"), held, 50).collect()
        assert {(r["query_id"], r["sample_id"], r["n_found"]) for r in found} == {(i, s, n) for i, q in queries for q2, s, n in expected if q2 == q}


def test_stream_batches_are_appended_once(spark, tmp_path):
    config = Config(3, 2, 1 << 31, "aminoacid", str(tmp_path))
    for epoch in (0, 0, 1, 1, 0):
        append_batch(frame(spark, TOY[epoch : epoch + 1]), epoch, config, "source")
    assert [r["batch_id"] for r in index.Index(spark, config.index_path).batches] == [0, 1]
    assert len(hits(spark, config, "ABC", 100)) == 2


@pytest.mark.parametrize("line", ["A:/x", "A: /x: y", "A*: /x", "A"])
def test_manifest_errors(spark, line):
    with pytest.raises(PySparkException):
        parse_manifest(spark.createDataFrame([(line,)], "value string")).collect()


def test_reports(spark, toy, tmp_path):
    held = index.Index(spark, toy.index_path)
    queries = frame(spark, [("q:1", "ABCD"), ("q2", "XEF")], "query_id string, seq string")
    for t in (100, 50):
        found = search(queries, held, t)
        path = tmp_path / f"r{t}.txt"
        assert write_report(found, str(path), t)
        back = {(r["query_id"], r["sample_id"], r["n_found"]) for r in read_report(spark, str(path)).collect()}
        assert back == {(r["query_id"], r["sample_id"], None if t == 100 else r["n_found"]) for r in found.collect()}
    assert report_text(search(queries.where("query_id = 'q2'"), held, 100), 100, single=True) == ["The query sequence(s) were found in the following sample(s):", "S2"]
    assert report_stats(search(queries, held, 50)).first().asDict() == {"n_queries": 2, "n_hits": 3, "n_samples": 2}
    assert not write_report(search(queries, held, 100).where("false"), str(tmp_path / "none"), 100)


def test_config():
    config = parse_config("h: 2 # hashes\nk: 11\nm: 600000\nsequence_type: aminoacid\noutput_directory: /out\nindex_store_name: x.y\nmax_memory: 4GiB\n")
    assert (config.h, config.k, config.m, config.index_path) == (2, 11, 600000, "/out/x.index")
    for bad, error in (("k: 3\nh: 1\nm: 9\n", KeyError), ("k: 0\nh: 1\nm: 9\nsequence_type: aminoacid\n", KeyError), ("k: 3\nh: 1\nm: 9\nsequence_type: rna\n", ValueError)):
        with pytest.raises(error):
            parse_config(bad)


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.fa").write_text(">x\nABCDEF\n>y\nABCXEF\n")
    (tmp_path / "c.yml").write_text(f"h: 1\nk: 3\nm: 1000003\nsequence_type: aminoacid\noutput_directory: {tmp_path}\n")
    assert cli.main(["build-seq", str(tmp_path / "a.fa"), str(tmp_path / "c.yml")], spark) == 0
    assert cli.main(["search_index", str(tmp_path / "c.yml"), "-s", "ABCD", "-i", "aminoacid", "-t", "50"], spark) == 0
    path = capsys.readouterr().out.strip().splitlines()[-1]
    assert "\tx, Number of K-mers found: 2 (100.0%)" in open(path).read()
    assert cli.main(["summary", str(tmp_path / "c.yml")], spark) == 0 and "  number_of_samples: 2\n" in capsys.readouterr().out


def test_every_command(spark, tmp_path, capsys):
    """Matrix, index of it, updates of both kinds, search of a file, merging, help and version."""
    for name, rows in (("a", ">x\nABCDEF\n"), ("b", ">y\nABCXEF\n>z\nGGGGG\n"), ("q", "@q1 one\nABCX\n+\nIIII\n@q2\nABC\n+\nIII\n@short\nAB\n+\nII\n")):
        (tmp_path / name).write_text(rows)
    (tmp_path / "m1").write_text(f"S1: {tmp_path}/a\n")
    (tmp_path / "m2").write_text(f"S2: {tmp_path}/b\n")
    config = str(tmp_path / "c.yml")
    (tmp_path / "c.yml").write_text(f"h: 1\nk: 3\nm: 1000003\nsequence_type: aminoacid\noutput_directory: file://{tmp_path}\n")
    assert cli.main(["build_matrix", str(tmp_path / "m1"), f"file://{config}"], spark) == 0
    assert cli.main(["build_index", config], spark) == 0
    with pytest.raises(SystemExit):
        cli.main(["build_index", config], spark)
    assert cli.main(["update", str(tmp_path / "m2"), config], spark) == 0
    assert cli.main(["update-seq", str(tmp_path / "b"), config], spark) == 0
    (tmp_path / "c2.yml").write_text((tmp_path / "c.yml").read_text() + "matrix_store_name: other\n")
    assert cli.main(["build_matrix", str(tmp_path / "m2"), str(tmp_path / "c2.yml")], spark) == 0
    assert cli.main(["update_index", str(tmp_path / "c2.yml")], spark) == 0
    capsys.readouterr()
    reports = []
    for merged in (False, True):
        if merged:
            assert cli.main(["compact", config], spark) == 0 and "1 merges, 4 batches removed" in capsys.readouterr().out
        assert cli.main(["search_index", config, "-f", str(tmp_path / "q"), "-i", "aminoacid"], spark) == 0
        reports.append(open(capsys.readouterr().out.strip().splitlines()[-1].removeprefix("file:")).read())
    found = {(r["query_id"], r["sample_id"]) for r in _rows(spark, tmp_path, reports[0])}
    assert found == {("q1", "S2"), ("q1", "y"), ("q2", "S1"), ("q2", "S2"), ("q2", "y")} and reports[0] == reports[1]
    assert reports[0].splitlines().count("\t\tS2") == 4  # twice each, of two batches
    assert cli.main([], spark) == 0 and "search_index" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["--version"], spark)
    assert capsys.readouterr().out.strip() == cli.VERSION


def _rows(spark, tmp_path, text):
    (tmp_path / "back.txt").write_text(text)
    return read_report(spark, str(tmp_path / "back.txt")).collect()


def test_stream(spark, tmp_path):
    for i, rows in enumerate((TOY[:1], TOY[1:2])):
        frame(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        config = Config(3, 2, 1 << 31, "aminoacid", str(tmp_path))
        stream = spark.readStream.schema("sample_id string, seq string").parquet(str(tmp_path / "in"))
        append_stream(stream, config, str(tmp_path / "ck")).awaitTermination()
        assert len(hits(spark, config, "ABC", 100)) == i + 1
