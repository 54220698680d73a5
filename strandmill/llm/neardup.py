"""Near duplicates by circulant MinHash, banding and exact Jaccard verification.

A text's set is that of its shingles of ``words`` words. One permutation of the hash space is applied once; a second,
shifted by 0, 1, 2, ... places, then gives every coordinate of the signature as the least value over the set. Texts
that agree in a band of coordinates are candidates. Texts with equal sets, by SHA-256 of all their shingles, form one
class beforehand, and only the class's first document goes on. Candidates are gathered into groups that share bands, directly or through others;
each group is compared exactly, in blocks of bounded size, by an inverted index over full sets, and a block gives no
more links than it has documents. So no pairs are listed, whatever the size of a group of copies.
"""

from __future__ import annotations


import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm.components import connected_components
from strandmill.llm.shared import text_passes, written

BASE = np.uint64(0x5851F42D4C957F2D)
STIR = np.uint64(0x9E3779B97F4A7C15)
STIR2 = np.uint64(0xC2B2AE3D27D4EB4F)


def _stir(x: np.ndarray, by: np.uint64 = STIR) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * by
    x = (x ^ (x >> np.uint64(29))) * STIR2
    return x ^ (x >> np.uint64(32))


@cache
def _byte_classes() -> tuple[np.ndarray, np.ndarray]:
    """Lower case of A-Z for each byte, and whether it is white space (0x20, 0x09-0x0D)."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    space = np.zeros(256, bool)
    space[[32, 9, 10, 11, 12, 13]] = True
    return lower, space


_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2 ** 64, for i below n at least."""
    global _powers
    if len(_powers[0]) < n:
        n = max(n, 1 << 16)
        back = np.uint64(pow(int(BASE), -1, 1 << 64))
        _powers = tuple(np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - 1, b, np.uint64)))) for b in (BASE, back))
    return _powers


def shingle_sets(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted, one text after another, and how many each text has.

    A-Z count as a-z; words end at white space. A text of fewer words is one shingle; one without words has none.
    """
    lower, space = _byte_classes()
    data = [(t or "").encode() for t in texts]
    joined = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    limits = np.cumsum([len(d) + 1 for d in data])
    gap = space[joined]
    inside = ~gap
    first = np.flatnonzero(inside & np.append(True, gap[:-1]))
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    last = np.flatnonzero(inside & np.append(gap[1:], True))
    power, back = _powers_to(len(joined))
    weighed = (lower[joined].astype(np.uint64) + np.uint64(1)) * power[: len(joined)]
    weighed[gap] = 0
    names = _stir(np.add.reduceat(weighed, first) * back[first] + (last - first).astype(np.uint64))
    counts = np.diff(np.searchsorted(first, limits), prepend=0)
    n = len(names)
    rolled = np.zeros(max(n - words + 1, 0), np.uint64)
    for i in range(words):
        rolled = rolled * BASE + names[i : n - words + 1 + i]
    rolled = _stir(rolled)
    out, sizes, at = [], np.zeros(len(texts), np.int64), 0
    for i, k in enumerate(counts.tolist()):
        if k >= words:
            found = np.unique(rolled[at : at + k - words + 1])
        elif k:
            short = k
            for name in names[at : at + k].tolist():
                short = (short * int(BASE) + name) % (1 << 64)
            found = _stir(np.array([short], np.uint64), BASE)
        else:
            found = names[:0]
        out.append(found)
        sizes[i] = len(found)
        at += k
    return np.concatenate(out), sizes


LOWER = bytes(_byte_classes()[0])


def shingles(text: str | None, words: int) -> set[bytes]:
    """The distinct shingles of a text themselves, as words joined by spaces; white space is that of bytes.split()."""
    own = (text or "").encode().translate(LOWER).split()
    if len(own) < words:
        return {b" ".join(own)} if own else set()
    return set(map(b" ".join, zip(*(own[i:] for i in range(words)))))


def set_key(own: set[bytes]) -> bytes:
    """SHA-256 of a whole set, whatever the order in which it was found."""
    return hashlib.sha256(b"\n".join(sorted(own))).digest()


def signatures(hashes: np.ndarray, begins: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash of each set, (coordinates, sets) of uint32; the sets are not empty."""
    with np.errstate(over="ignore"):
        placed = (hashes >> np.uint64(32)).astype(np.uint32)  # the first permutation: the hash itself
        out = np.empty((coordinates, len(begins)), np.uint32)
        step = 1 << 15  # elements that stay in the processor's cache
        cuts = [0, *(np.flatnonzero(np.diff(begins // step)) + 1).tolist(), len(begins)]
        for a, b in zip(cuts, cuts[1:]):
            lo, hi = begins[a], begins[b] if b < len(begins) else len(hashes)
            x, own = placed[lo:hi].copy(), begins[a:b] - lo
            v, w = np.empty_like(x), np.empty_like(x)
            for k in range(coordinates):
                np.multiply(x, np.uint32(0x9E3779B1), out=v)  # the second permutation, of the shifted place
                np.right_shift(v, 15, out=w)
                np.bitwise_xor(v, w, out=v)
                np.multiply(v, np.uint32(0x85EBCA6B), out=v)
                np.right_shift(v, 13, out=w)
                np.bitwise_xor(v, w, out=v)
                np.multiply(v, np.uint32(0xC2B2AE35), out=v)
                np.minimum.reduceat(v, own, out=out[k, a:b])
                x -= np.uint32(1)
    return out


def sketched(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands) of each document; ``bands`` is empty for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_passes(batches, limit=1 << 20):
            hashes, sizes = shingle_sets(texts, words)
            n, full = len(texts), np.flatnonzero(sizes)
            bits = np.zeros((0, bands), np.uint64)
            if len(full):
                grid = signatures(hashes, (np.cumsum(sizes) - sizes)[full], bands * rows).reshape(bands, rows, len(full)).astype(np.uint64)
                bits = np.arange(1, bands + 1, dtype=np.uint64)[:, None] * STIR
                for i in range(rows):
                    bits = _stir(bits ^ grid[:, i], BASE)
                bits = bits.T
            ends = np.cumsum(np.where(sizes > 0, bands, 0)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.append(np.int32(0), ends)), pa.array(np.ascontiguousarray(bits).view(np.int64).ravel()))
            held = [(len(own), set_key(own)) for own in (shingles(t, words) for t in texts)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([k for k, _ in held], pa.int64()), pa.array([key for _, key in held], pa.binary()), lists], names=["doc_id", "n_shingles", "set_key", "bands"])

    given = docs.select("doc_id", "text")
    return given.mapInArrow(run, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, n_shingles bigint, set_key binary, bands array<bigint>")


def links_within(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join what is linked among sets of shingle numbers: i and j with 100 * |i & j| >= percent * |i | j|.

    Exact for every pair, by an inverted index; a link that would only close a circle is left out.
    """
    sizes = np.array([len(s) for s in sets])
    owners = np.repeat(np.arange(len(sets)), sizes)
    _, shingle = np.unique(np.concatenate(sets), return_inverse=True)
    sort = np.argsort(shingle, kind="stable")
    posted, begins = owners[sort], np.concatenate(([0], np.cumsum(np.bincount(shingle))))
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out, at = [], 0
    for i, n in enumerate(sizes.tolist()):
        own = shingle[at : at + n]
        at += n
        lengths = begins[own + 1] - begins[own]
        busy = lengths > 1
        if not busy.any():
            continue
        own, lengths = own[busy], lengths[busy]
        takes = np.repeat(begins[own] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        common = np.bincount(posted[takes], minlength=len(sets))[:i]
        for j in np.flatnonzero(100 * common >= percent * (n + sizes[:i] - common)).tolist():
            a, b = find(i), find(j)
            if a != b:
                root[a] = b
                out.append((i, j))
    return out


def exact_links(docs: DataFrame, groups: DataFrame, words: int, percent: int, block_docs: int, block_shingles: int) -> DataFrame:
    """(a, b) links among the documents of each group (doc_id, component, n_shingles), verified on full sets."""
    sizes = groups.groupBy("component").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("total"))
    parts = F.greatest(F.ceil(F.col("m") / block_docs), F.ceil(F.col("total") / block_shingles)).cast("int")
    sizes = sizes.select("component", parts.alias("parts"))
    members = groups.join(sizes, "component")
    members = written(members, "members")
    small = members.where("parts = 1").agg(F.count("*").alias("n"), F.coalesce(F.sum("n_shingles"), F.lit(0)).alias("total")).first()
    bins = max(1, small["n"] * 2 // block_docs, small["total"] * 2 // block_shingles)
    own = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    # A small group lies whole in one of the bins; a large one is dealt to blocks, each pair of its parts being one.
    placed = members.select("doc_id", "component", "parts", own.alias("own"), other)
    placed = placed.select("doc_id", F.when(F.col("parts") == 1, F.pmod(F.xxhash64("component"), F.lit(bins))).otherwise(F.col("component")).alias("block"), F.when(F.col("parts") == 1, -1).otherwise(F.least("own", "other")).alias("i"), F.when(F.col("parts") == 1, -1).otherwise(F.greatest("own", "other")).alias("j"), "component")
    texts = docs.select("doc_id", "text").join(placed, "doc_id")

    def run(block: pa.Table) -> pa.Table:
        found: tuple[list, list] = ([], [])
        seen: dict[int, tuple[list[int], list[str]]] = {}
        for doc, text, group in zip(*(block.column(c).to_pylist() for c in ("doc_id", "text", "component"))):
            ids, own = seen.setdefault(group, ([], []))
            ids.append(doc)
            own.append(text)
        for ids, own in seen.values():
            number: dict[bytes, int] = {}
            sets = [np.array([number.setdefault(x, len(number)) for x in shingles(t, words)]) for t in own]
            for x, y in links_within(sets, percent):
                found[0].append(ids[x])
                found[1].append(ids[y])
        return pa.table({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64())})

    return texts.groupBy("block", "i", "j").applyInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80, bands: int = 32, rows: int = 5, block_docs: int = 1000, block_shingles: int = 1 << 20) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each document, doc_id an integer.

    Documents are linked if their sets' Jaccard similarity is at least ``percent`` hundredths; ``component_id`` is the
    smallest doc_id that links reach, and a document is kept if that is its own. With the default bands, a pair at
    the limit escapes being a candidate once in 300,000 times. Texts without words, null ones included, are linked
    with nothing; a null doc_id is its own (null) component and kept; rows with the same doc_id count as one document.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = written(sketched(docs, words, bands, rows), "sketches")
    classes = sketches.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("first"), F.first("n_shingles").alias("n_shingles"))
    classes = written(classes, "classes")
    firsts = classes.select(F.col("first").alias("doc_id"), "n_shingles", "set_key")
    held = sketches.join(firsts, ["doc_id", "set_key"], "left_semi").select("doc_id", F.explode("bands").alias("band"))
    heads = held.groupBy("band").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("tail")).where("head < tail").select("band", "head")
    # A document's heads (one per band at most) hang on the least of them, as the document does: the same groups by
    # about one link per document, for the documents of a group share their heads.
    near = held.join(heads, "band").groupBy("doc_id").agg(F.collect_set("head").alias("heads")).withColumn("b", F.array_min("heads"))
    stars = near.select(F.col("doc_id").alias("a"), "b").union(near.select(F.explode("heads").alias("a"), "b")).where("a <> b").distinct()
    groups = connected_components(written(stars, "stars")).withColumnRenamed("node", "doc_id")
    groups = groups.join(firsts.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles")), "doc_id")
    links = exact_links(docs, groups, words, percent, block_docs, block_shingles)
    # Equal sets link a class's documents to its first; rows that share a doc_id are one node of that graph.
    reached = connected_components(links)
    named = classes.join(reached, classes["first"] == reached["node"], "left").select("set_key", F.coalesce("component", "first").alias("component_id"))
    out = sketches.drop("bands").join(named, ["set_key"], "left")
    found = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    found = F.when(F.col("doc_id").isNotNull(), found)
    return out.select("doc_id", "n_shingles", found.alias("component_id"), F.coalesce(F.col("doc_id") == found, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` but for those of documents that are near duplicates of one with a smaller doc_id."""
    gone = near_duplicates(docs, **settings).where("NOT kept").select("doc_id").distinct()
    return docs.join(written(gone, "gone"), "doc_id", "left_anti").select(*docs.columns)
