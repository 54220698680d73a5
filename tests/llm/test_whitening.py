from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmill.llm import queries, whitening


def brute(rows, scale, components):
    """The rows by whole numbers and fractions, one vector at a time; eigenvectors of the exactly centred covariance."""
    out, by_dim = [], {}
    for i, v in rows:
        if v and all(c is not None and np.isfinite(c) for c in v):
            by_dim.setdefault(len(v), []).append((i, tuple(int(np.floor(scale * c)) for c in v)))
    for dim, own in by_dim.items():
        fit = sorted({x for _, x in own})
        n, sums = len(fit), [sum(x[d] for x in fit) for d in range(dim)]
        cov = np.array([[float(Fraction(sum((n * x[a] - sums[a]) * (n * x[b] - sums[b]) for x in fit), n**3)) for b in range(dim)] for a in range(dim)])
        e, q = np.linalg.eigh(cov)
        e, q = e[::-1], q[:, ::-1]
        for i, x in own:
            dev = sum((n * c - s) ** 2 for c, s in zip(x, sums))
            for k in range(min(components, dim)):
                flat = e[k] <= 1e-9 * max(e[0], 1e-300)
                w = None if flat else float(sum(float(Fraction(n * c - s, n)) * q[d, k] for d, (c, s) in enumerate(zip(x, sums))) / e[k] ** 0.5)
                out.append((i, k + 1, n, dev, w, 0.0 if flat else e[k] / cov.trace()))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3], abs(r[4] or 0)))


def same(found, expected):
    found = sorted(found, key=lambda r: (r[0] is None, r[0] or 0, r[1], int(r[3]), abs(r[4] or 0)))
    assert [(r[0], r[1], r[2], int(r[3])) for r in found] == [r[:4] for r in expected]
    sign = {}
    for f, e in zip(found, expected):
        assert (f[4] is None) == (e[4] is None)
        if e[4] is None:
            continue
        assert f[5] == pytest.approx(e[5], rel=1e-9)
        assert abs(f[4]) == pytest.approx(abs(e[4]), rel=1e-6, abs=1e-7)
        if abs(e[4]) > 1e-3:  # either sign, the same for all rows
            assert sign.setdefault((e[1], f[6]), np.sign(f[4] * e[4])) == np.sign(f[4] * e[4])
        assert f[6] < 1e-6


def vectors():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 6)) * [3, 2, 1.4, 1, 0.5, 0.2] + 1000  # a mean far from zero
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(i + 1000, list(rows[7][1])) for i in range(200)]  # a vector that many rows share
    rows += [(7, list(rows[8][1])), (None, list(rows[9][1]))]
    return rows + [(2000, None), (2001, [None] * 6), (2002, [float("nan")] * 6), (2003, [float("inf")] + [0.0] * 5), (2004, [])]


def test_whitening_against_fractions(spark):
    rows = vectors()
    frame = spark.createDataFrame([(*r, 1.5) for r in rows], "id long, vector array<double>, whitened double").repartition(5)
    same(whitening.whitened(frame, scale=256, components=4).collect(), brute(rows, 256, 4))


def test_few_vectors_and_lengths(spark):
    rows = [(1, [0.5, 1.0]), (2, [0.5, -1.0]), (3, [1.0, 2.0, 3.0]), (4, [7.0]), (5, [7.0]), (6, [-0.0, -0.001])]
    frame = spark.createDataFrame(rows, "id long, vector array<float>")
    found = whitening.whitened(frame, scale=256, components=4).collect()
    assert {(r["id"], r["component"]) for r in found} == {(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (3, 2), (3, 3), (4, 1), (5, 1), (6, 1), (6, 2)}
    alone = [r for r in found if r["id"] in (3, 4, 5)]  # no variance at all
    assert all(r["whitened"] is None and r["explained"] == 0 and r["identity_error"] is None and r["n"] == 1 and r["deviation"] == 0 for r in alone)
    same([r for r in found if r["id"] in (1, 2, 6)], [r for r in brute([(i, [float(np.float32(c)) for c in v]) for i, v in rows], 256, 4) if r[0] in (1, 2, 6)])


def test_great_numbers_are_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.standard_normal((60, 3)) * [2.0**44, 2.0**20, 1] + [0, 2.0**40, 0])]
    found = whitening.whitened(spark.createDataFrame(rows, "id long, vector array<double>"), scale=256, components=3).collect()
    # The components differ by 2 ** 44 in scale, so only the exact columns and the identity are compared.
    assert [(r["id"], r["component"], r["n"], int(r["deviation"])) for r in sorted(found)] == [r[:4] for r in brute(rows, 256, 3)]
    assert all(r["identity_error"] < 1e-4 for r in found)
    far = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0])], "id long, vector array<double>")
    assert {int(r["deviation"]) for r in whitening.whitened(far).collect()} == {10**38 - 1}  # beyond 38 digits


def test_empty_table(spark):
    for rows in ([], [(1, None)]):
        assert whitening.whitened(spark.createDataFrame(rows, "id long, vector array<float>")).collect() == []


def test_query_columns(spark):
    found = queries.op11_residue_whitening(spark, "/root/testdata/sf0.001")
    assert found.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert found.schema["deviation"].dataType.simpleString() == "bigint"
    assert found.where(F.col("identity_error") > 1e-4).count() == 0


def test_remaindering():
    values = np.array([[0, 1, -1], [10**30, -(10**30), 12345]], dtype=object)
    assert (whitening.remaindered({p: (values % p).astype(np.int64) for p in whitening.primes_for(10**30)}) == values).all()
    assert whitening.rank(np.array([[1, 2], [2, 4]], dtype=object)) == 1
