"""Vector searches of a stated query set against all rows, in blocks.

Rows are packed into blocks where they are read, without a shuffle. Query blocks are dealt to row blocks by a salt,
so that every query block meets every row block exactly once, and a task holds one of each. What a pair of blocks
yields is bounded: k rows per query.

Two methods work on a pair of blocks. A block's forest is built once and stored with it: per tree, the sorted array
of the rows' long hash strings. A query descends in each tree to the longest prefix that it shares with any row, and
ascends in all trees at once, from the longest of these on, until enough rows lie below; only these are scored. How
many are enough is fitted on a bounded sample of queries, whose true neighbours are found by brute force; a block has
a forest for each class of norms, as the greatest product asks for length as well as for angle. The threshold method finds the exact top k of sums over slices of the components, in three phases.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandmill.llm.shared import written

TILE = 256  # queries scored at once


def packed(rows: DataFrame, block: int, transform: Callable[[np.ndarray], np.ndarray] | None = None, zero: bool = True) -> DataFrame:
    """Blocks (dim, n, ids, vectors) of the usable rows of (id, vector): at most ``block`` of one length, by id.

    Null ids, null vectors and vectors with null or non-finite components are left out; zero vectors unless ``zero``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}

        def out(dim: int):
            ids, vectors = (np.concatenate(x) for x in held.pop(dim))
            for i in range(0, len(ids), block):
                sort = i + np.argsort(ids[i : i + block], kind="stable")
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([len(sort)], pa.int32()), pa.array([ids[sort].tobytes()], pa.binary()), pa.array([vectors[sort].tobytes()], pa.binary())], names=["dim", "n", "ids", "vectors"])

        for batch in batches:
            batch = batch.filter(pa.compute.and_(batch.column("id").is_valid(), batch.column("vector").is_valid()))
            lists, ids = batch.column("vector"), batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null components: NaN
            begins = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == dim)
                x = flat[begins[own][:, None] + np.arange(dim)]
                good = np.isfinite(x).all(1) & (True if zero else (x != 0).any(1))
                x = x[good] if transform is None else transform(x[good])
                a, b = held.setdefault(dim, ([], []))
                a.append(ids[own][good])
                b.append(x)
                if sum(map(len, a)) >= block:
                    yield from out(dim)
        for dim in list(held):
            if sum(map(len, held[dim][0])):
                yield from out(dim)

    return rows.mapInArrow(run, "dim int, n int, ids binary, vectors binary")


def even_salts(spark: SparkSession, parts: int) -> list[int]:
    """For each of ``parts`` partitions a number that the hash of a repartition sends there."""
    found = spark.range(32 * parts).groupBy(F.pmod(F.hash("id"), F.lit(parts)).alias("part")).agg(F.min("id").alias("id"))
    return sorted(r["id"] for r in found.collect())


def _met(queries: DataFrame, rows: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Every query block beside every row block of the same length of vectors; ``more``: further columns of the rows.

    The row blocks are dealt in turn to at most 4,096 partitions, whose number is fixed, as the work of a pair is far
    more than its bytes suggest.
    """
    held = rows.select(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.max("task").alias("last")).first()
    salts = even_salts(rows.sparkSession, max(1, min(held["n"], 4096)))
    every = F.split(F.lit(",".join(map(str, salts))), ",").cast("array<bigint>")
    own = F.monotonically_increasing_id()  # the task, and a block's number in it
    turn = F.shiftright(own, 33) + own.bitwiseAND((1 << 33) - 1) * F.lit((held["last"] or 0) + 1)
    dealt = rows.select(F.col("dim").alias("row_dim"), F.col("ids").alias("row_ids"), F.col("vectors").alias("row_vectors"), *more, turn.alias("turn"))
    dealt = dealt.withColumn("salt", F.get(every, F.pmod("turn", F.lit(len(salts))).cast("int"))).drop("turn")
    asked = queries.withColumn("salt", F.explode(every))
    met = asked.repartition(len(salts), "salt").join(dealt.repartition(len(salts), "salt").hint("merge"), "salt")
    return met.where("dim - row_dim = 0").drop("row_dim")  # not as a key of the join, which would hash both anew


def _arrays(ids: pa.Scalar, vectors: pa.Scalar, dim: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids.as_py(), np.int64)
    return ids, np.frombuffer(vectors.as_py(), np.float64).reshape(len(ids), dim)


def _best(found: DataFrame, k: int, *more: str) -> DataFrame:
    """The k best of each query, numbered; Spark limits each task's rows before they are shuffled."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", *more)


def _kept(queries: np.ndarray, rows: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Which of (query, row, score) entries are among their query's k best, ties to the first rows; best first."""
    sort = np.lexsort((rows, -scores, queries))
    q = queries[sort]
    return sort[np.arange(len(q)) - np.searchsorted(q, q) < k]


# The forest.

BITS = 32  # of a hash string


@cache
def _planes(dim: int, trees: int, seed: int) -> np.ndarray:
    """Normals of the hyperplanes, orthogonal within groups of ``dim``."""
    rng, parts = np.random.default_rng(seed), []
    while sum(p.shape[1] for p in parts) < trees * BITS:
        parts.append(np.linalg.qr(rng.standard_normal((dim, dim)))[0])
    return np.concatenate(parts, axis=1)[:, rng.permutation(trees * BITS)]


def hash_strings(vectors: np.ndarray, trees: int, seed: int = 11) -> np.ndarray:
    """(trees, vectors) of uint32: the signs of ``BITS`` projections, the first in the highest place."""
    signs = vectors @ _planes(vectors.shape[1], trees, seed) > 0
    packed = np.packbits(signs.reshape(len(vectors), trees, BITS), axis=2)
    return np.ascontiguousarray(packed.view(">u4")[:, :, 0].T).astype(np.uint32)


def query_strings(queries: np.ndarray, trees: int) -> np.ndarray:
    """The hash strings of queries, whose further component is 0."""
    return hash_strings(np.column_stack((queries, np.zeros(len(queries)))), trees)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many first bits two hash strings share."""
    return BITS - np.frexp((a ^ b).astype(np.float64))[1]


def norm_classes(vectors: np.ndarray) -> np.ndarray:
    """Two classes of norms an octave, so that norms within a class differ by less than the root of 2."""
    top = np.abs(vectors).max(1, initial=0)
    scale = np.ldexp(1.0, np.frexp(top)[1] - 1)  # so that no square overflows or vanishes
    norms = np.sqrt(((vectors / scale[:, None]) ** 2).sum(1))
    return np.floor(2 * (np.log2(norms) + np.log2(scale)) + 0.5).astype(np.int32)


class Forest:
    """Sorted arrays of the hash strings of some vectors, one per tree, and the vectors' numbers in that order.

    For the greatest inner product the vectors get one more component, which brings all to the greatest norm; a
    query's is 0. So the nearest by angle have the greatest product.
    """

    def __init__(self, sorted_codes: np.ndarray, order: np.ndarray):
        self.sorted, self.order = sorted_codes, order

    @classmethod
    def of(cls, vectors: np.ndarray, trees: int) -> Forest:
        x = vectors / np.abs(vectors).max(initial=np.finfo(float).tiny)  # no hash depends on the scale
        squares = (x * x).sum(1)
        tall = np.sqrt(np.maximum(squares.max(initial=0) - squares, 0))
        codes = hash_strings(np.column_stack((x, tall)), trees)
        order = np.argsort(codes, axis=1, kind="stable")
        return cls(np.take_along_axis(codes, order, axis=1), order.astype(np.uint32))

    def levels(self, codes: np.ndarray, enough: int) -> tuple[np.ndarray, np.ndarray]:
        """(trees, queries): from where to where, in each tree's order, the candidates of each query lie."""
        n = self.sorted.shape[1]
        at = np.stack([np.searchsorted(s, c) for s, c in zip(self.sorted, codes)])
        before = np.take_along_axis(self.sorted, np.maximum(at - 1, 0), axis=1)
        after = np.take_along_axis(self.sorted, np.minimum(at, n - 1), axis=1)
        longest = np.maximum(_common(codes, before), _common(codes, after))  # the descent in each tree
        low, high = at.copy(), at.copy()
        live = np.arange(codes.shape[1])
        for level in range(int(longest.max(initial=0)), -1, -1):  # the ascent, in step
            begun = longest[:, live] >= level
            first, last = self._range(codes[:, live], level)
            a, b = low[:, live], high[:, live]
            for t, (s, i, j, there) in enumerate(zip(self.sorted, first, last, begun)):
                a[t, there], b[t, there] = np.searchsorted(s, i[there]), np.searchsorted(s, j[there], "right")
            gain = (b - a) - (high[:, live] - low[:, live])
            held = (high[:, live] - low[:, live]).sum(0) + np.cumsum(gain, axis=0)
            risen = held - gain < enough  # tree by tree, until there are enough
            low[:, live], high[:, live] = np.where(risen, a, low[:, live]), np.where(risen, b, high[:, live])
            live = live[held[-1] < enough]
            if not len(live):
                break
        return low, high

    @staticmethod
    def _range(codes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The first and the last string that share ``level`` bits with each of ``codes``."""
        first = codes.astype(np.uint64) >> np.uint64(BITS - level) << np.uint64(BITS - level)
        return first.astype(np.uint32), (first + np.uint64((1 << BITS - level) - 1)).astype(np.uint32)

    def mark(self, codes: np.ndarray, enough: int, marks: np.ndarray) -> None:
        """Set in ``marks`` (queries, vectors) what lies below where all trees together have ``enough`` entries."""
        low, high = self.levels(codes, enough)
        for own, a, b in zip(marks, low.T.tolist(), high.T.tolist()):
            for order, i, j in zip(self.order, a, b):
                own[order[i:j]] = True

    def needs(self, codes: np.ndarray, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The least ``enough`` with which each query (a column of ``codes``) has the row of this forest as a candidate."""
        trees, n = self.sorted.shape
        held = np.zeros((BITS + 2, trees, codes.shape[1]), np.int64)  # entries below each level of each tree
        for level in range(BITS + 1):
            first, last = self._range(codes, level)
            for t, s in enumerate(self.sorted):
                held[level, t] = np.searchsorted(s, last[t], "right") - np.searchsorted(s, first[t])
        own = np.empty_like(self.sorted)
        np.put_along_axis(own, self.place(), self.sorted, axis=1)
        shared = _common(codes[:, queries], own[:, rows])
        level, tree = shared.max(0), shared.argmax(0)  # the first tree in which the row is met, coming from below
        at, below = held[level, :, queries], held[level + 1, :, queries]
        earlier = np.arange(trees) < tree[:, None]
        return np.where(earlier, at, below).sum(1) + 1

    def place(self) -> np.ndarray:
        """The rank of each entry's vector among the numbers in this forest."""
        return np.searchsorted(np.sort(self.order[0]), self.order)


def forests(vectors: np.ndarray, trees: int) -> tuple[np.ndarray, list[Forest]]:
    """(class, size) of each class of norms in a block, and its forest with the block's row numbers."""
    kinds = norm_classes(vectors)
    parts, grown = [], []
    for kind in np.unique(kinds).tolist():
        own = np.flatnonzero(kinds == kind).astype(np.uint32)
        forest = Forest.of(vectors[own], trees)
        grown.append(Forest(forest.sorted, own[forest.order]))
        parts.append((kind, len(own)))
    return np.array(parts, np.int32).reshape(-1, 2), grown


def planted(blocks: DataFrame, trees: int) -> DataFrame:
    """The blocks, each with its forests: (class, size) pairs, codes and row numbers, forest after forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (dim, n) in enumerate(zip(batch.column("dim").to_pylist(), batch.column("n").to_pylist())):
                parts, grown = forests(np.frombuffer(batch.column("vectors")[i].as_py(), np.float64).reshape(n, dim), trees)
                codes, ranks = (b"".join(a.tobytes() for a in arrays) for arrays in ([f.sorted for f in grown], [f.order for f in grown]))
                new = [pa.array([parts.tolist()], pa.list_(pa.list_(pa.int32()))), pa.array([codes], pa.binary()), pa.array([ranks], pa.binary())]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, *new], names=[*batch.schema.names, "parts", "codes", "ranks"])

    return blocks.mapInArrow(run, "dim int, n int, ids binary, vectors binary, parts array<array<int>>, codes binary, ranks binary")


def _grown(parts: list[list[int]], codes: bytes, ranks: bytes) -> Iterator[tuple[int, Forest]]:
    """The forests of a stored block, with their classes."""
    every = [np.frombuffer(b, np.uint32) for b in (codes, ranks)]
    trees, at = len(every[0]) // sum(n for _, n in parts), 0
    for kind, n in parts:
        yield kind, Forest(*(a[at : at + trees * n].reshape(trees, n) for a in every))
        at += trees * n


def _hashed_queries(blocks: DataFrame, trees: int) -> DataFrame:
    """Blocks of queries with their hash strings, which every block of rows uses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [query_strings(_arrays(i, v, d.as_py())[1], trees).tobytes() for d, i, v in zip(*(batch.column(c) for c in ("dim", "ids", "vectors")))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.binary())], names=[*batch.schema.names, "strings"])

    return blocks.mapInArrow(run, "dim int, n int, ids binary, vectors binary, strings binary")


@dataclass
class Level:
    """How far queries ascend among the rows of one length of vectors."""

    rows: int
    shares: dict[int, float]  # by class of norms: entries, as a multiple of a forest's vectors
    recall: float  # on the sampled queries

    def enough(self, parts: list[list[int]], trees: int, k: int) -> list[int]:
        """Entries for each forest of a block. The block gives its part of k + 1 rows at least, so that all blocks give k."""
        due, out = -(-(k + 1) * sum(n for _, n in parts) // self.rows), {}
        for i in reversed(range(len(parts))):
            kind, n = parts[i]
            least, due = min(n, due), max(0, due - n)
            out[i] = max(trees * least, int(np.ceil(self.shares.get(kind, 0.0) * n)))
        return [out[i] for i in range(len(parts))]


def fitted(needs: dict[int, list[float]], sizes: dict[int, int], recall: float) -> tuple[dict[int, float], float]:
    """The shares by class that reach ``recall`` of the known neighbours with few candidates, and the recall reached.

    ``needs``: by class, the share that each neighbour needs. A share of s makes about 1 - exp(-s) of a class's rows
    candidates. Steps are taken along each class's concave hull of neighbours by cost, the most rewarding first.
    """
    steps = []
    for kind, own in needs.items():
        own = np.sort(np.array(own, float))
        cost = np.append(0.0, sizes[kind] * -np.expm1(-own))
        at = 0
        while at < len(own):
            gain = np.arange(1, len(own) - at + 1) / np.maximum(cost[at + 1 :] - cost[at], 1e-300)
            to = at + 1 + int(len(gain) - 1 - gain[::-1].argmax())
            steps.append((-float(gain[to - at - 1]), kind, to - at, float(own[to - 1]), at))
            at = to
    total, found, shares = sum(map(len, needs.values())), 0, {}
    for _, kind, more, share, at in sorted(steps, key=lambda s: (s[0], s[1], s[4])):
        if found >= recall * total:
            break
        # Within the last step no more than is needed.
        own = np.sort(np.array(needs[kind], float))
        more = min(more, int(np.ceil(recall * total)) - found)
        shares[kind] = float(own[at + more - 1])
        found += more
    return shares, found / total if total else 1.0


def fit_levels(blocks: DataFrame, sample: DataFrame, *, k: int, trees: int, recall: float) -> dict[int, Level]:
    """The levels, by length of vectors, at which the sampled queries find ``recall`` of their true k nearest.

    Each block gives each sampled query's k best rows by brute force, and how many entries their forest must hold to
    have them as candidates; the driver gets k rows for each sampled query.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, strings, parts, codes, ranks, *data in zip(*(batch.column(c) for c in ("dim", "strings", "parts", "codes", "ranks", "ids", "vectors", "row_ids", "row_vectors"))):
                (q_ids, q), (ids, x) = _arrays(*data[:2], dim.as_py()), _arrays(*data[2:], dim.as_py())
                strings = np.frombuffer(strings.as_py(), np.uint32).reshape(-1, len(q))
                r, c, scores = [], [], []
                for i in range(0, len(q), TILE):
                    local = q[i : i + TILE] @ x.T
                    local[q_ids[i : i + TILE, None] == ids] = -np.inf
                    n = local.shape[1]
                    least = np.partition(local, n - k, axis=1)[:, n - k : n - k + 1] if n > k else np.full((len(local), 1), -np.inf)
                    a, b = np.nonzero((local >= least) & (local > -np.inf))
                    best = _kept(a, ids[b], local[a, b], k)
                    r.append(a[best] + i)
                    c.append(b[best])
                    scores.append(local[a[best], b[best]])
                r, c, scores = map(np.concatenate, (r, c, scores))
                kinds, share = np.zeros(len(r), np.int32), np.zeros(len(r))
                for kind, forest in _grown(parts.as_py(), codes.as_py(), ranks.as_py()):
                    members = np.sort(forest.order[0])
                    at = np.minimum(np.searchsorted(members, c), len(members) - 1)
                    own = np.flatnonzero(members[at] == c)
                    kinds[own] = kind
                    if len(own):
                        share[own] = forest.needs(strings, r[own], at[own]) / len(members)
                columns = {"query_id": q_ids[r], "vec_id": ids[c], "score": scores, "dim": np.full(len(r), dim.as_py(), np.int32), "kind": kinds, "share": share}
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], names=list(columns))

    near = _met(sample, blocks, ("parts", "codes", "ranks")).mapInArrow(run, "query_id bigint, vec_id bigint, score double, dim int, kind int, share double")
    order = Window.partitionBy("dim", "query_id").orderBy(F.col("score").desc(), "vec_id")
    near = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("dim", "kind", "share").collect()
    needs: dict[int, dict[int, list[float]]] = {}
    for r in near:
        needs.setdefault(r["dim"], {}).setdefault(r["kind"], []).append(r["share"])
    sizes: dict[int, dict[int, int]] = {}
    held = blocks.where(F.col("dim").isin(list(needs))).select("dim", F.explode("parts").alias("part")).groupBy("dim", F.col("part")[0].alias("kind"))
    for r in held.agg(F.sum(F.col("part")[1]).alias("n")).collect() if needs else ():
        sizes.setdefault(r["dim"], {})[r["kind"]] = r["n"]
    return {dim: Level(sum(sizes[dim].values()), *fitted(own, sizes[dim], recall)) for dim, own in needs.items()}


def forest_search(rows: DataFrame, is_query: Column, *, k: int = 20, trees: int = 96, recall: float = 0.95, sample: int = 256, block: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score, recall) of each query's k nearest found by inner product, among rows with other ids.

    ``rows`` is (id, vector). How many entries a block's trees must hold together below a query's level is fitted, by
    length of vectors and class of norms, so that the ``sample`` queries of the least hashes find ``recall`` of their
    true nearest; what they did find is the column recall. All rows of a length that no sampled query has are
    candidates, with recall 1. Null, zero and non-finite vectors take no part; only vectors of the query's length are
    compared; repeated rows are found each.
    """
    blocks = written(planted(packed(rows, block, zero=False), trees), "forests")
    asked = rows.where(is_query)
    queries = written(_hashed_queries(packed(asked, block, zero=False), trees), "queries")
    usable = F.forall("vector", lambda c: c.isNotNull() & (F.abs(c) < float("inf"))) & F.exists("vector", lambda c: c != 0)
    few = asked.where(F.col("id").isNotNull() & usable).orderBy(F.xxhash64("id"), "id").limit(sample)
    levels = fit_levels(blocks, written(_hashed_queries(packed(few, block, zero=False), trees), "sample"), k=k, trees=trees, recall=recall)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, strings, parts, codes, ranks, *data in zip(*(batch.column(c) for c in ("dim", "strings", "parts", "codes", "ranks", "ids", "vectors", "row_ids", "row_vectors"))):
                (q_ids, q), (ids, x) = _arrays(*data[:2], dim.as_py()), _arrays(*data[2:], dim.as_py())
                strings, level, parts = np.frombuffer(strings.as_py(), np.uint32).reshape(-1, len(q)), levels.get(dim.as_py()), parts.as_py()
                enough = level.enough(parts, trees, k) if level else [trees * n for _, n in parts]
                grown = [(forest, least) for (_, forest), least in zip(_grown(parts, codes.as_py(), ranks.as_py()), enough) if least]
                for i in range(0, len(q), TILE):
                    marks = np.zeros((len(q[i : i + TILE]), len(x)), bool)
                    for forest, least in grown:
                        forest.mark(strings[:, i : i + TILE], least, marks)
                    found = []
                    for name, own, mark in zip(q_ids[i : i + TILE].tolist(), q[i : i + TILE], marks):
                        some = np.flatnonzero(mark)
                        some = some[ids[some] != name]
                        scores = x[some] @ own
                        if len(some) > k:  # more than k only where scores are equal
                            keep = scores >= np.partition(scores, len(some) - k)[len(some) - k]
                            some, scores = some[keep], scores[keep]
                        best = _kept(np.zeros(len(some), np.int64), some, scores, k)
                        found.append((np.full(len(best), name), ids[some[best]], scores[best], np.full(len(best), level.recall if level else 1.0)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["query_id", "vec_id", "score", "recall"])

    found = _met(queries, blocks, ("parts", "codes", "ranks")).mapInArrow(run, "query_id bigint, vec_id bigint, score double, recall double")
    return _best(found, k, "recall")


# The threshold method.


def slices(dim: int, count: int) -> list[slice]:
    cuts = np.linspace(0, dim, min(count, max(dim, 1)) + 1).astype(int)
    return [slice(a, b) for a, b in zip(cuts, cuts[1:])]


LEAST, MOST = -(1 << 63), (1 << 63) - 1


def exact_form(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two arrays of whole float64 numbers in a form whose inner products, in full and in part, are exact.

    float64 where no sum can pass 2 ** 53, int64 where none can pass 2 ** 63, else Python's integers.
    """
    top_a, top_b = (int(np.abs(x).max(initial=0)) for x in (a, b))
    bound = top_a * top_b * max(a.shape[1], 1)
    if bound < 1 << 53:
        return a, b
    if max(bound, top_a, top_b) < 1 << 63:
        return a.astype(np.int64), b.astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return whole(a), whole(b)


def as_long(scores: np.ndarray) -> np.ndarray:
    """Exact scores as int64; those beyond 64 bits become the greatest or least number."""
    if scores.dtype == object:
        return np.array([min(max(s, LEAST), MOST) for s in scores.tolist()], np.int64)
    return scores.astype(np.int64)


def bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each query the greatest product with any vector between ``low`` and ``high``, component by component."""
    return np.maximum(q, 0) @ high + np.minimum(q, 0) @ low


def threshold_search(rows: DataFrame, is_query: Column, *, k: int = 20, parts: int = 2, every: int = 8, block: int = 4096, transform: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k greatest integer inner products, exactly.

    ``rows`` is (id, vector); ``transform`` makes the components integers. A score is the sum of ``parts`` slices.
    Phase 1: each block scores each ``every``-th of its rows and gives its k best; the k-th best of these over all
    blocks is a cutoff that the true k-th cannot lie below. Phase 2: the cutoff goes to all blocks. A tile of rows
    whose greatest and least components cannot reach it is passed over; in the others an entry that reaches it has
    some slice with at least its even share, and only those entries are collected. Phase 3: the slices of these
    are put together, and the best k kept.

    All sums are exact; a score beyond 64 bits counts, and is given, as the greatest or least 64-bit number. Null and
    non-finite vectors take no part; only vectors of the query's length are compared; ties go to smaller ids.
    """
    blocks = written(packed(rows, block, transform), "blocks")
    queries = written(packed(rows.where(is_query), block, transform).withColumn("block", F.monotonically_increasing_id()), "queries")

    def result(names: np.ndarray, ids: np.ndarray, scores: np.ndarray, extra: dict[str, np.ndarray]) -> pa.RecordBatch:
        columns = extra | {"query_id": names, "vec_id": ids, "score": scores}
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))

    def phase_1(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, number, *data in zip(*(batch.column(c) for c in ("dim", "block", "ids", "vectors", "row_ids", "row_vectors"))):
                (q_ids, q), (ids, x) = _arrays(*data[:2], dim.as_py()), _arrays(*data[2:], dim.as_py())
                step = max(1, min(every, len(x) // (4 * k)))  # small blocks give all rows
                ids, x = ids[::step], x[::step]
                q, x = exact_form(q, x)
                for i in range(0, len(q), TILE):
                    names, scores = q_ids[i : i + TILE], q[i : i + TILE] @ x.T
                    local = as_long(scores.ravel()).reshape(scores.shape) if scores.dtype == object else scores
                    n = local.shape[1]
                    least = np.partition(local, n - k - 1, axis=1)[:, n - k - 1 : n - k] if n > k + 1 else local.min(1, keepdims=True)
                    r, c = np.nonzero(local >= least)
                    other = names[r] != ids[c]
                    r, c = r[other], c[other]
                    score = as_long(local[r, c])
                    best = _kept(r, c, score, k)
                    yield result(names[r[best]], ids[c[best]], score[best], {"block": np.full(len(best), number.as_py(), np.int64)})

    met = _met(queries, blocks)
    first = met.mapInArrow(phase_1, "block bigint, query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("block", "query_id").orderBy(F.col("score").desc(), "vec_id")
    first = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    # The k-th of exact scores of real entries, so safe; with fewer, everything is collected.
    cutoffs = first.groupBy("block", "query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("cutoff"))
    cutoffs = cutoffs.where("cutoff IS NOT NULL").groupBy("block").agg(F.collect_list(F.struct("query_id", "cutoff")).alias("cutoffs"))
    cutoffs = written(cutoffs, "cutoffs")  # at most a block of queries in each row

    def phase_2_and_3(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, limits, *data in zip(*(batch.column(c) for c in ("dim", "cutoffs", "ids", "vectors", "row_ids", "row_vectors"))):
                (q_ids, q), (ids, x) = _arrays(*data[:2], dim.as_py()), _arrays(*data[2:], dim.as_py())
                known = {v["query_id"]: v["cutoff"] for v in limits.as_py() or ()}
                cutoff = np.array([known.get(n, LEAST) for n in q_ids.tolist()], np.int64)
                q, x = exact_form(q, x)
                if q.dtype == object:
                    cutoff = cutoff.astype(object)
                own, tiles = slices(dim.as_py(), parts), [slice(j, j + TILE) for j in range(0, len(x), TILE)]
                boxes = [(x[t].min(0), x[t].max(0)) if dim.as_py() else (x[0], x[0]) for t in tiles]
                for i in range(0, len(q), TILE):
                    some, names, limit = q[i : i + TILE], q_ids[i : i + TILE], cutoff[i : i + TILE]
                    share = limit // len(own) + (limit % len(own) > 0)  # the least whole number that is an even share of the cutoff
                    rows_, columns, scores = [], [], []
                    for tile, (low, high) in zip(tiles, boxes):
                        if (bounds(some, low, high) < limit).all():
                            continue
                        local = [some[:, s] @ x[tile, s].T for s in own]
                        enough = np.logical_or.reduce([p >= share[:, None] for p in local])
                        r, c = np.nonzero(enough)
                        total = sum((p[r, c] for p in local[1:]), local[0][r, c])
                        good = (total >= limit[r]) & (names[r] != ids[tile][c])
                        rows_.append(r[good])
                        columns.append(c[good] + tile.start)
                        scores.append(as_long(total[good]))
                    if rows_:
                        r, c, score = map(np.concatenate, (rows_, columns, scores))
                        best = _kept(r, c, score, k)
                        yield result(names[r[best]], ids[c[best]], score[best], {})

    given = _met(queries.join(cutoffs, "block", "left"), blocks)
    return _best(given.mapInArrow(phase_2_and_3, "query_id bigint, vec_id bigint, score bigint"), k)
