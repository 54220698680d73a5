"""Whitening of integer vectors by an exact scatter in residue numbers.

Each distinct vector counts once. Its scatter, with a component of ones in front, so that the number of vectors and
their sums come along, is worked out modulo several primes: a task multiplies residues in float64, in chunks short
enough to be exact, and gives its sums tile by tile; these are added up by tile and prime. The driver gets one matrix
per prime, whatever the number of vectors, and puts the exact integers together by Chinese remaindering. Covariances
are exact fractions before they are rounded once, so a mean far from zero costs nothing. Their eigenvectors are those
of ``eigh`` in doubles; what lies far below the greatest eigenvalue is solved again on its own subspace.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm.shared import written

LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Residues lie within 2 ** 19 of zero, so CHUNK products of two add up to less than 2 ** 53.
PRIME_BITS, CHUNK = 20, 1 << 14
#: Bytes of a tile of a scatter that is shuffled as one row.
TILE_BYTES = 1 << 18


@cache
def primes(count: int) -> list[int]:
    """The ``count`` greatest primes below 2 ** PRIME_BITS."""
    out, p = [], (1 << PRIME_BITS) - 1
    while len(out) < count:
        if all(p % d for d in range(3, int(p**0.5) + 1, 2)):
            out.append(p)
        p -= 2
    return out


def primes_for(bound: int) -> list[int]:
    """Primes whose product tells apart all integers from -bound to bound."""
    product, count = 1, 0
    while product <= 2 * bound:
        count += 1
        product *= primes(count)[-1]
    return primes(count)


def whole(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as int64; what lies beyond 64 bits becomes the least or greatest number."""
    with np.errstate(over="ignore"):
        y = np.floor(scale * x) + 0.0
    inside = (y >= -(2.0**63)) & (y < 2.0**63)
    return np.where(inside, np.where(inside, y, 0).astype(np.int64), np.where(y < 0, LEAST, MOST))


def pack(x: np.ndarray) -> list[bytes]:
    """Each row as bytes, in the least of four widths that holds its greatest entry; equal rows give equal bytes."""
    out: list[bytes] = [b""] * len(x)
    top = np.maximum(x.max(1, initial=0), ~x.min(1, initial=0))
    for width, limit in ((1, 1 << 7), (2, 1 << 15), (4, 1 << 31), (8, 1 << 63)):
        own = np.flatnonzero((top < np.uint64(limit)) & (top >= (0 if width == 1 else 1 << 4 * width - 1)))
        some = x[own].astype(f"<i{width}")
        for i, row in zip(own.tolist(), some):
            out[i] = bytes([width]) + row.tobytes()
    return out


def unpack(keys: list[bytes], dim: int) -> np.ndarray:
    out = np.empty((len(keys), dim), np.int64)
    widths = np.array([k[0] for k in keys])
    for width in np.unique(widths).tolist():
        own = np.flatnonzero(widths == width)
        out[own] = np.frombuffer(b"".join(keys[i][1:] for i in own.tolist()), f"<i{width}").reshape(len(own), dim)
    return out


def usable(batch: pa.RecordBatch, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, integer vectors) of each length, of a batch of (id, vector); null and non-finite ones are left out."""
    lists = batch.column("vector")
    sizes = pa.compute.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False)
    flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null components: NaN
    begins = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == dim)
        if dim:
            x = flat[begins[own][:, None] + np.arange(dim)]
            good = np.isfinite(x).all(1)
            if good.any():
                yield own[good], whole(x[good], scale)


def fit_list(rows: DataFrame, scale: float) -> DataFrame:
    """(dim, key, peak): each distinct integer vector once, and its greatest absolute entry.

    Repeated vectors are dropped before the shuffle too, so a vector that many rows share is no hot key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in usable(batch, scale):
                peak = np.minimum(np.maximum(x.max(1), ~x.min(1)), MOST - 1) + 1
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), x.shape[1], np.int32)), pa.array(pack(x), pa.binary()), pa.array(peak)], names=["dim", "key", "peak"])

    return rows.select("id", "vector").mapInArrow(run, "dim int, key binary, peak bigint").distinct()


def tiles(dim: int) -> list[tuple[int, int]]:
    """Runs of rows of a (dim, dim) matrix of 64-bit numbers, of about TILE_BYTES each."""
    step = max(1, TILE_BYTES // (8 * dim))
    return [(i, min(i + step, dim)) for i in range(0, dim, step)]


def residue_scatter(fit: DataFrame, used: dict[int, list[int]]) -> DataFrame:
    """(dim, prime, tile, sums): the scatter of (1, x) over the fit list, modulo each prime of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            dims, keys = batch.column("dim").to_numpy(), batch.column("key")
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                for i in range(0, len(own), CHUNK):
                    x = unpack(keys.take(pa.array(own[i : i + CHUNK])).to_pylist(), dim)
                    ones = np.ones((len(x), 1))
                    for p in used[dim]:
                        r = x % p
                        r = np.hstack((ones, np.where(r > p // 2, r - p, r)))
                        product = (r.T @ r).astype(np.int64) % p
                        total[dim, p] = (total[dim, p] + product) % p if (dim, p) in total else product
        for (dim, p), sums in total.items():
            for k, (a, b) in enumerate(tiles(dim + 1)):
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([p], pa.int64()), pa.array([k], pa.int32()), pa.array([sums[a:b].tobytes()], pa.binary())], names=["dim", "prime", "tile", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sums = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int64()), pa.array([at[2]], pa.int32()), pa.array([sums.tobytes()], pa.binary())], names=["dim", "prime", "tile", "sums"])

        for batch in batches:
            for *key, data in zip(*(c.to_pylist() for c in batch.columns)):
                part = np.frombuffer(data, np.int64)
                if at == key:
                    sums = (sums + part) % at[1]
                else:
                    if at is not None:
                        yield out()
                    at, sums = key, part
        if at is not None:
            yield out()

    schema = "dim int, prime bigint, tile int, sums binary"
    dealt = fit.select("dim", "key").mapInArrow(run, schema).repartition("dim", "prime", "tile").sortWithinPartitions("dim", "prime", "tile")
    return dealt.mapInArrow(add, schema)


def remaindered(residues: dict[int, np.ndarray]) -> np.ndarray:
    """The integers (Python's) with these residues by prime, those nearest to zero."""
    found, product = None, 1
    for p, r in residues.items():
        r = r.astype(object)
        if found is None:
            found = r
        else:
            found = found + product * ((r - found) * pow(product, -1, p) % p)
        product *= p
    return np.where(found > product // 2, found - product, found)


def rank(matrix: np.ndarray, p: int = (1 << 31) - 1) -> int:
    """The rank of an integer matrix modulo a prime, which is its own but for a chance of about its size / p."""
    a, found = (matrix % p).astype(np.int64), 0
    for column in range(a.shape[1]):
        below = np.flatnonzero(a[found:, column])
        if not len(below):
            continue
        pivot = found + below[0]
        a[[found, pivot]] = a[[pivot, found]]
        a[found] = a[found] * pow(int(a[found, column]), -1, p) % p
        rest = a[found + 1 :]
        rest -= rest[:, column : column + 1] * a[found] % p
        rest %= p
        found += 1
        if found == len(a):
            break
    return found


def eigen(exact: np.ndarray, divisor: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` greatest eigenvalues of ``exact`` / ``divisor`` (integers, symmetric, that rank at least), and unit vectors.

    ``eigh`` is right to within its precision times the greatest eigenvalue. Those below a millionth of that are
    solved again, in the space that the others leave.
    """

    def lost(a: int, b: float) -> float:
        """What rounding took from a / divisor."""
        up, down = b.as_integer_ratio()
        return (a * down - up * divisor) / (divisor * down)

    v = np.frompyfunc(lambda a: a / divisor, 1, 1)(exact).astype(np.float64)  # each rounded once
    wide = None
    space, values, vectors = np.eye(len(v)), [], []
    while len(values) < count:
        inner = v
        if values:
            wide = v.astype(np.longdouble) + np.frompyfunc(lost, 2, 1)(exact, v).astype(np.float64) if wide is None else wide
            inner = (space.T.astype(np.longdouble) @ wide @ space).astype(np.float64)
        e, q = np.linalg.eigh((inner + inner.T) / 2)
        e, q = e[::-1], space @ q[:, ::-1]
        kept = max(1, int((e > e[0] * 1e-6).sum()))
        values += e[:kept].tolist()
        vectors.append(q[:, :kept])
        space = q[:, kept:]
    q = np.hstack(vectors)[:, :count]
    return np.array(values[:count]), q / np.sqrt((q * q).sum(0))


@dataclass
class Whitening:
    """What is fitted on the vectors of one length: how many, their sums, and the components with some variance."""

    n: int
    sums: np.ndarray  # of Python's integers
    components: np.ndarray  # (dim, components)
    values: np.ndarray
    explained: np.ndarray
    identity_error: float | None = None

    @classmethod
    def of(cls, scatter: np.ndarray, components: int) -> Whitening:
        """From the exact scatter of (1, x)."""
        n, sums = int(scatter[0, 0]), scatter[0, 1:]
        centred = n * scatter[1:, 1:] - sums[:, None] * sums[None, :]  # n * n times the covariance
        own = min(components, rank(centred))
        values, vectors = eigen(centred, n * n, own) if own else (np.zeros(0), np.zeros((len(sums), 0)))
        trace = int(centred.trace())
        return cls(n, sums, vectors, values, values / (trace / (n * n)) if trace else values)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exactly: int64 where that surely holds it, else Python's integers."""
        if self.n * max(-int(x.min(initial=0)), int(x.max(initial=0))) + max(map(abs, self.sums)) < 1 << 63:
            return self.n * x - self.sums.astype(np.int64)
        return self.n * x.astype(object) - self.sums

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        parts = centred / self.n if centred.dtype != object else np.frompyfunc(lambda a: a / self.n, 1, 1)(centred).astype(np.float64)
        return parts @ self.components / np.sqrt(self.values)


def deviations(centred: np.ndarray) -> list[int] | np.ndarray:
    """The sums of the squares of each row, exactly."""
    if centred.dtype != object:
        top = int(np.abs(centred).max(initial=0))
        if top * top * centred.shape[1] < 1 << 63:
            return (centred * centred).sum(1)
        centred = centred.astype(object)
    return (centred * centred).sum(1)


def learn(rows: DataFrame, *, scale: float = 256, components: int = 4) -> dict[int, Whitening]:
    """The whitening of floor(scale * vector) of (id, vector), by the vectors' length; vectors of each length are fitted by themselves.

    Every distinct integer vector counts once. Null vectors, and those with null or non-finite entries, take no part.
    Without a usable vector there is no whitening.
    """
    fit = written(fit_list(rows, scale), "fit")
    bounds = {r["dim"]: r["n"] * (r["peak"] + 1) ** 2 for r in fit.groupBy("dim").agg(F.count("*").alias("n"), F.max("peak").alias("peak")).collect()}
    if not bounds:
        return {}
    # One matrix per prime and length, on the driver.
    parts: dict[tuple[int, int], dict[int, np.ndarray]] = {}
    for r in residue_scatter(fit, {dim: primes_for(b) for dim, b in bounds.items()}).collect():
        parts.setdefault((r["dim"], r["prime"]), {})[r["tile"]] = np.frombuffer(r["sums"], np.int64)
    out = {}
    for dim in bounds:
        residues = {p: np.concatenate([part[k] for k in sorted(part)]).reshape(dim + 1, dim + 1) for (d, p), part in parts.items() if d == dim}
        out[dim] = Whitening.of(remaindered(residues), components)
    for dim, error in _identity_errors(fit, out).items():
        out[dim].identity_error = error
    return out


def _identity_errors(fit: DataFrame, models: dict[int, Whitening]) -> dict[int, float]:
    """The largest entry of the covariance of the whitened fit list, minus the identity, measured on the list itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, keys = batch.column("dim").to_numpy(), batch.column("key")
            for dim in np.unique(dims).tolist():
                own, model = np.flatnonzero(dims == dim), models[dim]
                for i in range(0, len(own), CHUNK):
                    w = model.whitened(model.centred(unpack(keys.take(pa.array(own[i : i + CHUNK])).to_pylist(), dim)))
                    a, b = np.indices((w.shape[1],) * 2).reshape(2, -1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), dim, np.int32)), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array((w.T @ w).ravel()), pa.array(w.sum(0)[a]), pa.array(w.sum(0)[b])], names=["dim", "a", "b", "product", "sum_a", "sum_b"])

    sums = fit.select("dim", "key").mapInArrow(run, "dim int, a int, b int, product double, sum_a double, sum_b double").groupBy("dim", "a", "b").agg(F.sum("product").alias("product"), F.sum("sum_a").alias("sum_a"), F.sum("sum_b").alias("sum_b"))
    out: dict[int, float] = {}
    for r in sums.collect():  # the square of the number of components for each length
        n = models[r["dim"]].n
        cov = r["product"] / n - r["sum_a"] / n * (r["sum_b"] / n)
        out[r["dim"]] = max(out.get(r["dim"], 0.0), abs(cov - (r["a"] == r["b"])))
    return out


def whitened(rows: DataFrame, *, scale: float = 256, components: int = 4) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of each usable row and component, numbered from 1.

    ``rows`` is (id, vector); the vectors become x = floor(scale * vector), in whole numbers, of 64 bits at most.
    ``n``: the distinct x of that length. ``deviation``: the exact sum of (n * x - sums) ** 2, a decimal of 38 digits
    (more: the greatest such number). ``whitened``: x less the mean on the component, over the root of its
    eigenvalue. ``explained``: the eigenvalue's share of the variance. ``identity_error``: see ``learn``.

    A vector of fewer entries has fewer components. Components beyond the rank of the fit list have no variance:
    their ``whitened`` is null and ``explained`` 0, and they do not count for ``identity_error``, which is null if
    all are so. Null vectors, empty ones and those with null or non-finite entries give no row. Repeated ids and
    null ids are rows like others.
    """
    models = learn(rows, scale=scale, components=components)
    kind = rows.schema["id"].dataType.simpleString()
    digits = pa.decimal128(38, 0)
    most = 10**38 - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, x in usable(batch, scale):
                model, dim = models[x.shape[1]], x.shape[1]
                count, centred = min(components, dim), model.centred(x)
                dev, w = deviations(centred), model.whitened(centred)
                have = w.shape[1]
                full = np.full((len(x), count), np.nan)
                full[:, :have] = w
                none = np.tile(np.arange(count) >= have, len(x))
                dev = pa.array(dev).cast(digits) if dev.dtype != object else pa.array([Decimal(min(d, most)) for d in dev], digits)
                each = pa.array(np.repeat(np.arange(len(x)), count))
                share = np.zeros(count)
                share[:have] = model.explained
                rows_ = len(x) * count
                columns = [batch.column("id").take(pa.array(own)).take(each), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))), pa.array(np.full(rows_, model.n)), dev.take(each), pa.array(full.ravel(), mask=none), pa.array(np.tile(share, len(x))), pa.array([model.identity_error] * rows_, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("id", "vector").mapInArrow(run, f"id {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double")
