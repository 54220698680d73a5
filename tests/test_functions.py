import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandmill.functions import columns as C
from strandmill.functions.kmers import canonical_kmer, kmers, murmur64a, positions, reverse_complement, windows

HASHES = [
    (b"A", 3969090544990846983, 14862748245026736845), (b"ACG", 8956204637879436019, 18289091662101272866), (b"\0ACGT", 16944333734230325476, 13158411311229642439),
    (b"AAAAAAAA", 17819579527065946545, 13481118951018451647), (b"HHQISHVPAMP", 40016813217755193, 11742741883356903204), ("straße né".encode(), 15600070968864197001, 14265989594879173762),
    (b"ACGTACGTACGTACGTACGTA", 5136484036039520115, 13751799290983568151), (b"ACGTACGTACGTACGTACGTACGTACGTACG", 427568207054836692, 3910102612407501579),
]


@pytest.mark.parametrize(("kmer", "zero", "one"), HASHES)
def test_hash_vectors(kmer, zero, one):
    assert murmur64a(windows(kmer, len(kmer), False), len(kmer), 2)[:, 0].tolist() == [zero, one]
    assert positions(kmer, len(kmer), 2, 1_000_003, False)[:, 0].tolist() == [zero % 1_000_003, one % 1_000_003]


@pytest.mark.parametrize(("kmer", "least"), [(b"ACGTN", b"ACGTN"), (b"TTTTT", b"AAAAA"), (b"CCCGG", b"CCCGG"), (b"UUU", b"AAA"), (b"ACGTR", b"\0ACGT"), (b"RACGT", b"ACGT\0"), (b"acgtn", b"\0acgt")])
def test_canonical(kmer, least):
    assert canonical_kmer(kmer) == least


@given(st.binary(max_size=60), st.integers(1, 25))
@settings(max_examples=80, deadline=None)
def test_windows_are_the_kmers(data, k):
    for canonical in (False, True):
        expected = [murmur64a([np.frombuffer(x[i : i + 8].ljust(8, b"\0"), "<u8") for i in range(0, k, 8)], k, 2)[:, 0].tolist() for x in kmers(data, k, canonical)]
        assert murmur64a(windows(data, k, canonical), k, 2).T.tolist() == expected


@given(st.text("ACGT", min_size=5, max_size=30))
@settings(deadline=None)
def test_canonical_is_strand_blind(seq):
    a = sorted(kmers(seq.encode(), 5, True))
    assert a == sorted(kmers(reverse_complement(seq.encode()), 5, True))


def test_translation():
    assert [C.translate_one("ATGGCCTAA", f) for f in range(3)] == ["MA_", "WP", "GL"]
    assert [C.translate_one("TTAGGCCAT", f) for f in range(3)] == ["LGH", "_A", "RP"]
    assert C.translate_one("ATGNCC", 0) == "MX"
    assert C.translate_one("AT", 0) == "" and C.translate_one(None, 0) is None


def test_thresholds_and_labels(spark):
    cases = [(14, 50, 8), (28, 25, 8), (28, 50, 15), (28, 75, 22), (56, 25, 15), (56, 50, 29), (56, 75, 43), (68, 75, 52), (100, 75, 75), (10, 1, 1), (7, 0, 0), (243, 100, 243)]
    for n, t, least in cases:
        assert spark.range(1).select(C.least_kmers(F.lit(n).cast("long"), t)).first()[0] == least
    rows = spark.createDataFrame([(107, 4000), (1, 32), (5, 5), (0, 5)], "a long, b long").select(C.percent_label("a", "b").alias("x")).collect()
    assert [r["x"] for r in rows] == ["107 (2.67%)", "1 (3.12%)", "5 (100.0%)", "0 (0.0%)"]


def test_bucket_widths():
    assert [C.bucket_width(m) for m in (600_000, 1_000_000, 2_000_000_000, 40_000_000_000)] == [1200, 1000, 200_000, 4_000_000]
