"""Batches laid out by groups of samples, and by position, against plain search of strings."""

import random

import pytest

from strandmill.operators import index, search
from strandmill.plans.config import Config

QUERIES = "query_id string, seq string"


def held(spark, path, rows, h=2):
    config = Config(5, h, 1 << 31, "aminoacid", str(path))
    index.build(spark.createDataFrame(rows, "sample_id string, seq string"), config)
    return index.Index(spark, config.index_path)


def samples(n=150):
    rng = random.Random(3)
    common = "".join(rng.choice("ACEGIKMO") for _ in range(60))
    return [(f"s{i}", common[rng.randrange(30) :] + "".join(rng.choice("ACEGIKMO") for _ in range(rng.randrange(40)))) for i in range(n)], common


def expected(rows, queries, least):
    of: dict = {}
    for name, seq in rows:
        of.setdefault(name, set()).update(seq[i : i + 5] for i in range(len(seq) - 4))
    found = ((q, name, sum(text[i : i + 5] in grams for i in range(len(text) - 4)), len(text) - 4) for q, text in queries for name, grams in of.items())
    return {r for r in found if r[2] >= least * r[3]}


@pytest.mark.parametrize("records", [1, 2])
@pytest.mark.parametrize("most", [400, 1 << 23, 10])
def test_layouts(spark, tmp_path, monkeypatch, records, most):
    """Small groups, one group, and samples too long for any, which are laid out by position; samples of one record and of two."""
    monkeypatch.setattr(index, "GROUP_PAIRS", most)
    rows, common = samples()
    rows = [(name, seq) for name, text in rows for seq in ([text] if records == 1 else [text[:20], text[10:]])]
    of = held(spark, tmp_path, rows)
    assert [grouped for _, grouped in of.grids] == [most > 10]
    queries = [("c", common), ("d", common[30:50]), ("e", rows[7][1]), ("n", "XYZXYZXYZ")]
    for t in (100, 30):
        got = search.search(spark.createDataFrame(queries, QUERIES), of, t).collect()
        assert {(r["query_id"], r["sample_id"], r["n_found"], r["n_kmers"]) for r in got} == expected(rows, queries, t / 100)
    sizes = {r["sample_idx"]: r["n_bits"] for r in index.filter_sizes(of).collect()}
    assert len(sizes) == of.samples.count() and sum(sizes.values()) == sum(r["n_samples"] for r in index.slice_profile(of).collect())


def test_what_is_found_of_a_sample_is_one_row(spark, tmp_path, monkeypatch):
    """Else what leaves the readers grows with the samples times the tasks."""
    monkeypatch.setattr(index, "GROUP_PAIRS", 2000)
    monkeypatch.setattr(search, "CHUNK_BYTES", 1000)
    rows, common = samples()
    of = held(spark, tmp_path, rows)
    asked = search.Asked(spark.createDataFrame([("c", common), ("d", common[20:])], QUERIES), 5, 2, 1 << 31, False)
    found = search.looked_up(of, asked, False)
    assert found.count() == found.select("query_no", "sample_idx").distinct().count() > 250


def test_sources_have_no_false_positive(spark, tmp_path):
    """A source whose filter is well filled is not found by positions that other k-mers have set."""
    from strandmill.plans import queries

    rng = random.Random(5)

    def text(n):
        return "".join(rng.choice("abcdefgh") for _ in range(n))

    docs = [(i, text(1 << 20), "s") for i in range(20)]
    asked = [(i, text(11 + 3)) for i in range(1500)]
    spark.createDataFrame(docs, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(asked, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    grams = {t[i : i + 11] for _, t, _ in docs for i in range(len(t) - 10)}
    true = {(q, n) for q, t in asked if (n := sum(t[i : i + 11] in grams for i in range(4)))}
    assert {(r["item_id"], r["n_found"]) for r in queries.search_sources(spark, str(tmp_path)).collect()} == true


def test_many_passes_are_jobs_of_their_own(spark, tmp_path, monkeypatch):
    """Else the driver holds what all of them send at once."""
    for name, value in (("HELD_POSITIONS", -1), ("PASS_BYTES", 20000)):
        monkeypatch.setattr(search, name, value)
    rows, _ = samples()
    of = held(spark, tmp_path, rows)
    asked = search.Asked(spark.createDataFrame(rows, QUERIES), 5, 2, 1 << 31, False)
    plan = search.looked_up(of, asked, True)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan
    got = search.search(spark.createDataFrame(rows, QUERIES), of, 100).collect()
    assert {(r["query_id"], r["sample_id"], r["n_found"], r["n_kmers"]) for r in got} == expected(rows, rows, 1)


def test_distinct_kmers_are_counted_in_little_memory(spark, tmp_path):
    import tracemalloc

    from strandmill.plans import queries

    texts = ["abcdefghijklmnop", "aaaaaaaaaaaaaaaa", "short", None, "abcdefghijk", "\u00e9" * 12 + "x"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r["n_distinct"] for r in queries.kmer_distinct(spark, str(tmp_path)).collect()}
    assert found == {i: len({b[j : j + 11] for j in range(len(b) - 10)}) for i, t in enumerate(texts) for b in [(t or "").encode()]}
    tracemalloc.start()
    queries.windows(b"abcdefgh" * (1 << 17), 11, False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20  # the matrix of all windows took 88 bytes a letter


def test_large_files_are_held_where_they_are(spark, tmp_path, monkeypatch):
    """Merges, and indexes of matrices, write no rows again that lie in large files; small ones beside them are."""
    from strandmill.storage import exists

    rows, common = samples(160)
    batch = [spark.createDataFrame(rows[i * 40 : i * 40 + 40], "sample_id string, seq string") for i in range(4)]
    config = Config(5, 2, 1 << 31, "aminoacid", str(tmp_path), matrix_store_name="a")
    queries = [("c", common), ("d", common[30:50]), ("e", rows[7][1]), ("f", rows[150][1])]

    def check():
        for t in (100, 30):
            got = search.search(spark.createDataFrame(queries, QUERIES), index.Index(spark, config.index_path), t).collect()
            assert {(r["query_id"], r["sample_id"], r["n_found"], r["n_kmers"]) for r in got} == expected(rows, queries, t / 100)

    monkeypatch.setattr(index, "LARGE_FILES", 1)
    index.build_matrix(batch[0], config)
    index.build_from_matrix(spark, config)
    for i in (1, 2, 3):
        index.update(batch[i], config)
    check()
    index.merge_batches(spark, config, [0, 1])
    monkeypatch.setattr(index, "_large", lambda spark, folder: not folder.endswith("batch=3/bucket=0"))
    index.merge_batches(spark, config, [2, 3])
    check()
    index.compact(spark, config, full=True)
    assert index.vacuum(spark, config) == [0, 1, 2, 3, 4, 5]
    check()
    assert [exists(spark, f"{config.index_path}/postings/batch={b}") for b in range(7)] == [False, True, True, False, False, True, False]
    assert len(index.Index(spark, config.index_path).places[6]) == 4


@pytest.mark.parametrize("m", [1 << 31, 1 << 61])
def test_a_group_takes_little_memory(m):
    """A pair of a position and a sample is one number of 8 bytes while it is gathered, if there is room for both."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng, n = np.random.default_rng(1), 1 << 11
    texts = [rng.integers(97, 123, 1 << 10, np.uint8).tobytes().decode() for _ in range(n)]
    config, grid, peaks = Config(11, 2, m, "aminoacid", "unused"), index.Grid(m, index.GROUP_SLABS, True), []

    class Rows:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run(pa.RecordBatch.from_arrays([pa.array(range(i, i + 128)), pa.array(texts[i : i + 128])], names=["sample_idx", "seq"]) for i in range(0, n, 128))

    tracemalloc.start()
    rows = list(index.grouped_rows(Rows(), config, grid))
    peaks.append(tracemalloc.get_traced_memory()[1])
    tracemalloc.stop()
    assert sum(int(index.row_counts(c).sum()) for r in rows for c in r.column("counts").to_pylist()) > 4_000_000
    if m == 1 << 31:
        assert peaks[0] < 48 * 4_200_000


class Given:
    """Stands for a DataFrame of batches, so that what a task makes of them is seen without Spark."""

    def __init__(self, *batches):
        self.batches = batches

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return run(iter(self.batches))


def test_samples_that_share_positions_are_one_group():
    """Positions that many samples share are stored once for up to 32 million pairs, which take little memory (8 million before)."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng, n, size = np.random.default_rng(4), 160, 1 << 15
    common = rng.integers(97, 123, size, np.uint8).tobytes().decode()
    for texts in ([common[i:] + common[:i] for i in range(n)], [rng.integers(97, 123, size, np.uint8).tobytes().decode() for _ in range(n)]):
        grid, given = index.Grid(1 << 31, index.GROUP_SLABS, True), Given(*(pa.RecordBatch.from_arrays([pa.array([i]), pa.array([t])], names=["sample_idx", "seq"]) for i, t in enumerate(texts)))
        tracemalloc.start()
        firsts, pairs, positions = set(), 0, 0
        for rows in index.grouped_rows(given, Config(11, 2, 1 << 31, "aminoacid", "unused"), grid):
            firsts |= set(rows.column("part").to_pylist())
            for c in rows.column("counts").to_pylist():
                pairs, positions = pairs + int(index.row_counts(c).sum()), positions + len(index.row_counts(c))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert firsts == {0} and pairs > 10_000_000 and peak < 32 * pairs
        assert positions < 100_000 or texts[0] != common


@pytest.mark.parametrize("m", [1000, 1 << 31, 1 << 36, 1 << 61])
@pytest.mark.parametrize("most", [700, 1 << 25])
def test_a_group_is_gathered_in_runs(monkeypatch, m, most):
    """Runs that are sorted by themselves, and stored a few ranges at a time, hold each pair of a position and a sample once."""
    import numpy as np
    import pyarrow as pa

    from strandmill.functions.kmers import positions

    for name, value in (("GROUP_PAIRS", most), ("RUN_PAIRS", 100), ("STORED_PAIRS", 30)):
        monkeypatch.setattr(index, name, value)
    rows, _ = samples(40)
    grid, given = index.Grid(m, index.GROUP_SLABS, True), Given(*(pa.RecordBatch.from_arrays([pa.array(range(i, i + 5)), pa.array([t for _, t in rows[i : i + 5]])], names=["sample_idx", "seq"]) for i in range(0, 40, 5)))
    got, firsts = [], set()
    for batch in index.grouped_rows(given, Config(5, 2, m, "aminoacid", "unused"), grid):
        for r in batch.to_pylist():
            firsts.add(r["part"])
            bits, (found, n) = index.row_positions(grid, r), (held := index.held_slices(r)).samples(np.arange(len(held.counts)))
            assert set(grid.fine_of(bits).tolist()) == {r["fine"]}
            got += zip(np.repeat(bits, n).tolist(), (found + r["part"]).tolist())
    want = {(b, i) for i, (_, t) in enumerate(rows) for b in positions(t.encode(), 5, 2, m, False).ravel().tolist()}
    assert len(got) == len(want) and set(got) == want
    assert (len(firsts) > 1) == (most == 700)


def test_translation_takes_batches_as_they_are(spark):
    from pyspark.sql import functions as F

    from strandmill.functions import columns as C

    assert C._translations.__annotations__["sequence"] == "pa.Array"  # of strings that are not all Python's at once
    rows = spark.createDataFrame([("ATGGCCN",), ("AT",), (None,), ("",), ("ATGéGG",)], "s string")
    got = [r[0] for r in rows.select(C.translated(F.col("s"), F.lit(0))).collect()]
    assert got == [C.translate_one(s[0], 0) for s in rows.collect()] and got[:4] == ["MA", "", None, ""]


def test_records_of_a_sample_travel_together(spark, monkeypatch):
    """Records of one sample side by side are one compressed row, so that shuffles carry a part of the letters."""
    import pyarrow as pa

    rng = random.Random(9)
    words = ["".join(rng.choice("ACGT") for _ in range(12)) for _ in range(60)]
    rows = [(s, n, text) for s, n, many in (("a", 0, 40), ("a", 1, 1), ("b", 0, 300), ("a", 0, 2)) for text in ("".join(rng.choice(words) for _ in range(9))[: rng.randrange(90, 108)] for _ in range(many))]
    given = spark.createDataFrame(rows, "sample_id string, sample_no int, seq string").coalesce(1)

    def back(found):
        got = []
        for i, r in enumerate(found):
            batch = pa.RecordBatch.from_arrays([pa.array([i]), pa.array([bytes(r["seq"])], pa.binary())], names=["sample_idx", "seq"])
            for names, data, begins in index.texts([batch]):
                assert set(names.tolist()) == {i} and r["n_bytes"] == begins[-1]
                got += [(r["sample_id"], r["sample_no"], data[a:b].tobytes().decode()) for a, b in zip(begins, begins[1:])]
        return got

    found = index.squeezed(given, ["sample_id", "sample_no"]).collect()
    assert [(r["sample_id"], r["sample_no"]) for r in found] == [("a", 0), ("a", 1), ("b", 0), ("a", 0)]
    assert back(found) == rows
    assert sum(len(r["seq"]) for r in found) < sum(len(t) for *_, t in rows) / 2
    monkeypatch.setattr(index, "SQUEEZED", 1000)
    found = index.squeezed(given, ["sample_id", "sample_no"]).collect()
    assert max(r["n_bytes"] for r in found) <= 1000 and len(found) > 30 and back(found) == rows


@pytest.mark.parametrize("undone", [1, 3000, 1 << 22])
def test_squeezed_batches_are_undone_in_parts(monkeypatch, undone):
    import numpy as np
    import pyarrow as pa

    class Rows:
        def __init__(self, *batches):
            self.batches = batches

        @property
        def schema(self):
            return {"sample_idx": type("Kind", (), {"dataType": type("Long", (), {"simpleString": lambda _: "bigint"})()})()}

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return Rows(*run(iter(self.batches)))

    monkeypatch.setattr(index, "UNDONE", undone)
    rng = np.random.default_rng(2)
    names = np.sort(rng.integers(0, 40, 200))
    names = np.unique(names, return_inverse=True)[1]
    plain = pa.RecordBatch.from_arrays([pa.array(names), pa.array(["".join(rng.choice(list("ACGT"), rng.integers(30, 200))) for _ in names])], names=["sample_idx", "seq"])
    small = index.squeezed(Rows(plain), ["sample_idx"]).batches[0].drop_columns(["n_bytes"])
    config, grid = Config(11, 2, 1 << 31, "aminoacid", "unused"), index.Grid(1 << 31, index.GROUP_SLABS, True)
    monkeypatch.setattr(index, "GROUP_PAIRS", 9000)
    want, got = ([r.to_pylist() for r in index.grouped_rows(Rows(b), config, grid).batches] for b in (plain, small))
    pairs = [{(r["first_bit"], r["n"]) for x in rows for r in ({"first_bit": int(index.row_positions(grid, y)[0]), "n": len(index.row_positions(grid, y))} for y in x)} for rows in (want, got)]
    held = [sum(int(index.row_counts(y["counts"]).sum()) for x in rows for y in x) for rows in (want, got)]
    assert held[0] == held[1] and (pairs[0] == pairs[1] or undone < 1 << 22)


def test_an_index_takes_little_room(spark, tmp_path):
    """Positions of k-mers that are as good as random take little more than their entropy, which is about 25 bits each here; 32 before."""
    import numpy as np

    rng, n = np.random.default_rng(3), 400
    rows = [(f"s{i:03}", "".join(rng.choice(list("ACGT"), 2000))) for i in range(n)]
    config = Config(21, 2, 1 << 36, "nucleotide", str(tmp_path))
    index.build(spark.createDataFrame(rows, "sample_id string, seq string").coalesce(1), config)
    pairs = n * 1980 * 2
    size = sum(f.stat().st_size for f in tmp_path.glob("**/postings/**/*.parquet"))
    entropy = np.log2(np.e * config.m / pairs) + np.log2(n)
    assert size * 8 / pairs < entropy + 3


def test_rows_of_older_indexes_are_read():
    """Their gaps have one width, and their slices no other bytes apart."""
    import numpy as np

    from strandmill.operators import slices

    grid, bits = index.Grid(1 << 31, 4, True), np.array([5, 9, 70_000])
    samples = np.array([3, 300, 7, 900])
    forms, _, data = slices.encode(samples, np.array([0, 2, 3, 4]), 1000)
    old = {"fine": 0, "domain": 1000, "gaps": slices.narrow(np.diff(bits, prepend=-1) - 1), "counts": slices.narrow(np.array([1, 0, 0])), "forms": forms.astype(np.uint8).tobytes(), "slices": data.tobytes(), "slices_high": None}
    new = index.stored_rows(grid, np.repeat(bits, [2, 1, 1]), samples, 1000, 0).to_pylist()
    assert len(new) == 1
    for row in (old, new[0]):
        assert index.row_positions(grid, row).tolist() == bits.tolist()
        assert index.held_slices(row).samples(np.arange(3))[0].tolist() == samples.tolist()
