import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmill.llm import vectors


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((900, 24)) * 0.2 + 0.3 * rng.standard_normal((9, 24))[rng.integers(0, 9, 900)]
    out = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    out[10] = (10, out[20][1])
    out[11] = (11, out[20][1])
    return out + [(2000, None), (2020, [float("nan")] * 24), (2040, [None] * 24), (2060, [0.0] * 24), (2080, [1.0, 2.0]), (2081, [0.5, 1.0])]


def brute(rows, transform, k, zero):
    good = [(i, transform(np.array(v, float))) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and (zero or any(v))]
    out = {}
    for i, q in good:
        if i % 20 == 0:
            out[i] = sorted(((-float(q @ v), j) for j, v in good if j != i and len(v) == len(q)))[:k]
    return out


@pytest.mark.parametrize("block", [8192, 100])
def test_threshold_is_exact(spark, rows, block):
    frame = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    floor = lambda x: np.floor(64 * x)
    got = {}
    for r in vectors.threshold_search(frame, F.col("id") % 20 == 0, k=7, block=block, transform=floor).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((-float(r["score"]), r["vec_id"]))
    assert got == {q: v for q, v in brute(rows, floor, 7, True).items() if v}


def test_forest_recall(spark, rows):
    frame = spark.createDataFrame(rows, "id long, vector array<double>").repartition(2)
    found, hit, all_ = {}, 0, 0
    for r in vectors.forest_search(frame, F.col("id") % 20 == 0, k=20).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    for q, best in brute(rows, lambda x: x, 20, False).items():
        ids = {j for _, j in found.get(q, [])}
        hit, all_ = hit + sum(j in ids for _, j in best), all_ + len(best)
        assert found[q] == sorted(found[q], key=lambda x: (-x[0], x[1])) if best else q not in found
    assert hit / all_ >= 0.9


def test_forest_is_the_definition():
    """Longest prefixes per tree, then upwards in step, tree by tree, until there are enough entries."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 16))
    x /= np.linalg.norm(x, axis=1)[:, None] / rng.uniform(0.98, 1.02, (300, 1))
    x[7] = x[8]
    parts, grown = vectors.forests(x, 6)
    assert len(grown) == 1
    ((_, forest),) = vectors._grown(parts.tolist(), grown[0].sorted.tobytes(), grown[0].order.tobytes())
    tall = np.sqrt(np.maximum((x * x).sum(1).max() - (x * x).sum(1), 0))
    own = [[f"{c:032b}" for c in tree] for tree in vectors.hash_strings(np.column_stack((x, tall)), 6)]
    queries = np.concatenate((x[:20], rng.standard_normal((20, 16))))
    codes = vectors.query_strings(queries, 6)
    asked = [[f"{c:032b}" for c in tree] for tree in codes]
    marked = {}
    for enough in (1, 30, 250, 10_000):
        marks = np.zeros((40, 300), bool)
        forest.mark(codes, enough, marks)
        marked[enough] = marks
        for i, found in enumerate(marks):
            longest = [max(next((n for n in range(33) if a[: n + 1] != b[: n + 1] or n == 32), 32) for b in tree) for a, tree in ((asked[t][i], own[t]) for t in range(6))]
            held, level = [set() for _ in range(6)], max(longest)
            while level >= 0 and sum(map(len, held)) < enough:
                for t in range(6):
                    if longest[t] >= level and sum(map(len, held)) < enough:
                        held[t] = {j for j in range(300) if own[t][j][:level] == asked[t][i][:level]}
                level -= 1
            assert set(np.flatnonzero(found).tolist()) == set().union(*held)
    q, r = (a.ravel() for a in np.meshgrid(np.arange(40), np.arange(300), indexing="ij"))
    needs = forest.needs(codes, q, r).reshape(40, 300)
    for enough, marks in marked.items():
        assert (marks == (needs <= enough)).all()


def sets_of_vectors():
    rng = np.random.default_rng(9)
    base = rng.standard_normal((4000, 48))
    unit = base / np.linalg.norm(base, axis=1)[:, None]
    wide = rng.standard_normal((2000, 256))
    yield "not normalised", base
    yield "uneven norms", unit * np.exp(0.7 * rng.standard_normal((4000, 1)))
    yield "256 components", wide / np.linalg.norm(wide, axis=1)[:, None]
    yield "all products negative", np.abs(base[:1000, :8]) * np.where(np.arange(1000) % 20 == 0, 1, -1)[:, None]


@pytest.mark.parametrize("name,x", list(sets_of_vectors()), ids=lambda v: v if isinstance(v, str) else "")
def test_forest_recall_of_any_vectors(spark, name, x):
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>").repartition(2)
    got, told = {}, set()
    for r in vectors.forest_search(frame, F.col("id") % 20 == 0, k=20, sample=60, block=1500).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
        told.add(r["recall"])
    hit = 0
    asked = range(0, len(x), 20)
    for q in asked:
        scores = x @ x[q]
        scores[q] = -np.inf
        assert len(got[q]) == 20
        hit += len(got[q] & set(np.argsort(-scores, kind="stable")[:20].tolist()))
    assert hit / (20 * len(asked)) >= 0.9
    assert len(told) == 1 and 0.95 <= told.pop() <= 1


def test_every_query_has_its_k(spark):
    """As many rows as are asked for at least, however small and uneven the blocks are; all of a length without a sampled query."""
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_normal(6) * 10.0 ** rng.integers(-3, 4)).tolist()) for i in range(130)] + [(1000 + i, [1.0 + i]) for i in range(9)]
    frame = spark.createDataFrame(rows, "id long, vector array<double>").repartition(7)
    for block in (4, 4096):
        got = vectors.forest_search(frame, F.col("id") % 20 == 0, k=20, trees=8, recall=0.1, sample=1, block=block).groupBy("query_id").count().collect()
        assert dict(map(tuple, got)) == {**{i: 20 for i in range(0, 130, 20)}, 1000: 8}


def test_fitted_shares():
    """Cheap neighbours first: a class of few rows is searched before one of many."""
    shares, recall = vectors.fitted({0: [0.1, 0.2, 9.0], 5: [0.5] * 7}, {0: 10_000, 5: 50}, 0.8)
    assert shares == {0: 0.1, 5: 0.5} and recall == 0.8
    assert vectors.fitted({}, {}, 0.9) == ({}, 1.0)


def test_blocks_are_dealt_evenly(spark):
    """Each query block meets each row block of its length once; no partition has more than two row blocks."""
    salts = vectors.even_salts(spark, 37)
    assert len(salts) == 37
    parts = spark.createDataFrame([(s,) for s in salts], "salt long").repartition(37, "salt").select(F.spark_partition_id()).distinct()
    assert parts.count() == 37
    rows = [(d, 1, f"{d}/{i}".encode(), b"") for d, n in ((3, 23), (5, 2)) for i in range(n)]
    blocks = spark.createDataFrame(rows, "dim int, n int, ids binary, vectors binary").repartition(4)
    met = vectors._met(blocks.where("dim = 3").limit(2), blocks.where("dim < 9"))
    found = met.select("dim", "ids", "row_ids", F.spark_partition_id().alias("part")).collect()
    assert len(found) == len({(bytes(r["ids"]), bytes(r["row_ids"])) for r in found}) == 2 * 23
    pairs = [r["part"] for r in found]
    assert max(map(pairs.count, pairs)) <= 4
    assert "Exchange hashpartitioning(dim" not in met._jdf.queryExecution().toString()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, vector array<double>")
    assert vectors.threshold_search(none, F.col("id") % 20 == 0).count() == 0 and vectors.forest_search(none, F.col("id") % 20 == 0).count() == 0


def test_exact_beyond_float(spark):
    """Components of up to 53 bits in all slices: products beyond 2 ** 53, then beyond 64 bits."""
    rng = np.random.default_rng(6)
    for size in (2.0**28, 2.0**30, 2.0**31, 2.0**45, 1e300):
        x = np.floor(rng.uniform(-size, size, (120, 6)))
        x[5] = x[6] = x[40]
        rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, [3.0] * 6)]
        whole = {i: [int(c) for c in v] for i, v in rows}
        expected = []
        for q in range(0, 501, 20):
            if q in whole:
                scores = [(min(max(sum(a * b for a, b in zip(whole[q], v)), -(1 << 63)), (1 << 63) - 1), i) for i, v in whole.items() if i != q]
                expected += [(q, n, i, s) for n, (s, i) in enumerate(sorted(scores, key=lambda t: (-t[0], t[1]))[:7], 1)]
        frame = spark.createDataFrame(rows, "id long, vector array<double>")
        got = vectors.threshold_search(frame, F.col("id") % 20 == 0, k=7, block=50).collect()
        assert sorted(map(tuple, got)) == sorted(expected), size


def test_tiles_below_the_cutoff_are_passed_over():
    rng = np.random.default_rng(7)
    x, q = rng.standard_normal((50, 9)) + 3, rng.standard_normal((20, 9))
    assert (vectors.bounds(q, x.min(0), x.max(0))[:, None] >= q @ x.T - 1e-9).all()
