"""Hits checked on the k-mers themselves, and samples of a stream that come in parts."""

import random
import time

import pytest
from pyspark.sql import functions as F

from strandmill.operators import index
from strandmill.operators.search import search
from strandmill.plans.config import Config
from strandmill.streaming.append import append_stream


@pytest.mark.parametrize("threshold", [100, 50, 0])
@pytest.mark.parametrize("kind", ["aminoacid", "nucleotide"])
def test_no_false_positive_is_left(spark, tmp_path, threshold, kind):
    rng = random.Random(1)
    letters = "ACGT" if kind == "nucleotide" else "ACEGIKMO"
    rows = [(f"s{i}", "".join(rng.choice(letters) for _ in range(rng.randrange(5, 80)))) for i in range(60)] + [("two", "ACGTACGTGG"), ("two", "CCCCCCCCCC")]
    queries = [(f"q{i}", s[3:20]) for i, (_, s) in enumerate(rows[:25])] + [("far", "ACGTTTGGACACAGGAC"), ("twice", rows[1][1] * 2), ("short", "ACG")]
    config = Config(5, 1, 40, kind, str(tmp_path))  # so few positions that nearly everything is a hit
    records = spark.createDataFrame(rows, "sample_id string, seq string")
    index.build(records, config)
    asked = spark.createDataFrame(queries, "query_id string, seq string")
    of = index.Index(spark, config.index_path)

    def grams(text):
        back = text[::-1].translate(str.maketrans("ACGT", "TGCA"))
        return [min(text[i : i + 5], back[len(text) - i - 5 : len(text) - i]) if kind == "nucleotide" else text[i : i + 5] for i in range(len(text) - 4)]

    expected = set()
    held: dict = {}
    for name, text in rows:
        held.setdefault(name, set()).update(grams(text))
    for q, text in queries:
        own = grams(text)
        for name, grams_ in held.items():
            n = sum(g in grams_ for g in own)
            if own and (n == len(own) if threshold == 100 else n >= -(-len(own) / 100 * threshold // 1)):
                expected.add((q, name, n, len(own), n / len(own) * 100))
    found = search(asked, of, threshold, verify=records)
    assert {(r["query_id"], r["sample_id"], r["n_found"], r["n_kmers"], r["pct"]) for r in found.collect()} == expected
    assert threshold == 0 or search(asked, of, threshold).count() > len(expected)
    assert found.columns == search(asked, of, threshold).columns


def test_samples_in_parts(spark, tmp_path):
    """Samples whose records come in several micro-batches are one sample each, replayed or not."""
    schema = "sample_id string, seq string, last boolean"
    parts = [[("a", "ABCDEF", False), ("b", "ABCXEF", True), (None, "ABCABC", True)], [("a", "GHIKLM", None), ("c", "BCDEFG", False)], [("a", None, True), ("d", "XXXX", True)], [("c", "ZZZZZ", True), ("a", "ABCDEF", True)]]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{i}"))
    config = Config(3, 2, 1 << 31, "aminoacid", str(tmp_path))
    for _ in range(2):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
        append_stream(stream, config, str(tmp_path / "ck"), fan=3).awaitTermination()
        of = index.Index(spark, config.index_path)
        assert sorted(r["sample_id"] for r in of.samples.collect()) == ["a", "a", "b", "c", "d"]
        found = search(spark.createDataFrame([("one", "ABCDEF"), ("two", "IKLM"), ("z", "ZZZ")], "query_id string, seq string"), of, 100)
        assert sorted((r["query_id"], r["sample_id"]) for r in found.collect()) == [("one", "a"), ("one", "a"), ("two", "a"), ("z", "c")]
        names = {r["sample_idx"]: r["n_bytes"] for r in of.samples.where(F.col("sample_id") == "a").collect()}
        assert sorted(names.values()) == [6, 12]
    assert len(of.batches) < 4


def test_a_sample_without_an_end_times_out(spark, tmp_path):
    schema = "sample_id string, seq string, last boolean"
    spark.createDataFrame([("a", "ABCDEF", False)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    config = Config(3, 2, 1 << 31, "aminoacid", str(tmp_path))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError):
        append_stream(stream, config, str(tmp_path / "no"), timeout_ms=1000)
    query = append_stream(stream, config, str(tmp_path / "ck"), timeout_ms=1000, trigger={"processingTime": "1 second"})
    try:
        for _ in range(60):
            time.sleep(1)
            if index.index_exists(spark, config.index_path):
                break
    finally:
        query.stop()
    assert [r["sample_id"] for r in index.Index(spark, config.index_path).samples.collect()] == ["a"]
