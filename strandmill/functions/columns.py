"""Sequence functions as Spark columns: alphabet, complement, translation, thresholds, labels, sizing."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: The standard genetic code, codons in the order of the bases T, C, A, G; ``_`` is a stop. A fixed value.
GENETIC_CODE = "FFLLSSSSYY__CC_WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
BASES = "TCAG"


def alphabet(sequence: Column) -> Column:
    """``nucleotide`` if there is nothing but A, T, G, C and N, else ``aminoacid``."""
    return F.when(sequence.rlike("^[ATGCN]*$"), F.lit("nucleotide")).otherwise(F.lit("aminoacid"))


def kmer_count(sequence: Column, k: int) -> Column:
    return F.greatest(F.octet_length(sequence) - (k - 1), F.lit(0))


def reverse_complemented(sequence: Column) -> Column:
    """For sequences of A, C, G, T, U and N."""
    return F.translate(F.reverse(sequence), "ACGTUN", "TGCAAN")


def as_nucleotides(text: Column) -> Column:
    """Any text as nucleotides, two per byte: the hexadecimal digits, four to a base."""
    return F.translate(F.hex(F.encode(text, "UTF-8")), "0123456789ABCDEF", "ACGT" * 4)


_AMINO = np.frombuffer(GENETIC_CODE.encode() + b"X", np.uint8)
_BASE = np.full(256, 64, np.int64)
for _i, _base in enumerate(BASES):
    _BASE[ord(_base)] = _i


def translate_one(sequence: str | None, frame: int) -> str | None:
    """The protein from ``frame`` (0, 1 or 2) on; a codon with another letter is X, a partial one at the end goes."""
    if sequence is None:
        return None
    at = _BASE[np.frombuffer(sequence.encode("latin-1", "replace"), np.uint8)[frame:]]
    at = at[: len(at) // 3 * 3].reshape(-1, 3)
    return _AMINO[np.minimum(at @ np.array([16, 4, 1]), 64)].tobytes().decode() if len(at) else ""


def _translations(sequence: pa.Array, frame: pa.Array) -> pa.Array:
    # One text at a time: a batch of them may be large.
    return pa.array((translate_one(s.as_py(), f.as_py()) for s, f in zip(sequence, frame)), pa.string())


def translated(sequence: Column, frame: Column) -> Column:
    """``translate_one`` as a column: substrings of long strings would take quadratic time."""
    return F.arrow_udf(_translations, StringType())(sequence, frame)


def _six(sequence: pd.Series, back: pd.Series) -> pd.Series:
    return pd.Series([[translate_one(s, i) for s in pair for i in range(3)] for pair in zip(sequence, back)], dtype=object)


def six_frames(sequence_id: Column, sequence: Column, k: int) -> Column:
    """An array of (id, protein) of the frames with k letters at least, forward before reverse."""
    proteins = F.pandas_udf(_six, ArrayType(StringType()))(sequence, reverse_complemented(sequence))
    names = F.array(*(F.concat(sequence_id, F.lit(f"_{way}_reading_frame_{i}")) for way in ("forward", "reverse") for i in range(3)))
    every = F.zip_with(names, proteins, lambda a, b: F.struct(a.alias("id"), b.alias("protein")))
    return F.filter(every, lambda x: F.length(x["protein"]) >= k)


def least_kmers(n: Column, threshold: float) -> Column:
    """How many k-mers a hit must have: all at 100, else the ceiling of (n / 100) * threshold in floating point."""
    return n if threshold == 100 else F.ceil((n / F.lit(100.0)) * F.lit(float(threshold))).cast("long")


def _labels(found: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([f"{a} ({round(a / b * 100, 2)}%)" for a, b in zip(found, n)], dtype=object)


def percent_label(found: str, n: str) -> Column:
    """``n (p%)``, p rounded to two places from its exact value, half to even; for rows of results only."""
    return F.pandas_udf(_labels, StringType())(found, n)


def bucket_width(m: int) -> int:
    """Rows of one part of the index: m / 500, / 1000, / 5000 or / 10000, by the size of m."""
    parts = 500 if m < 10**6 else 1000 if m < 10**7 else 5000 if m < 10**8 else 10_000
    return -(-m // parts)


def bucket_edge(bit: Column, width: int) -> Column:
    """The first position after the part that a position lies in."""
    return (F.floor(bit / F.lit(width)) + 1) * width


def filter_size(n: Column, p: Column) -> Column:
    """Bits of a filter for n entries at a false-positive rate p, with the best number of hashes."""
    return F.ceil(-(n * F.log(p)) / (F.log(F.lit(2.0)) * F.log(F.lit(2.0))))


def filter_hashes(m: Column, n: Column) -> Column:
    return F.greatest(F.round(m / n * F.log(F.lit(2.0))), F.lit(1.0)).cast("long")


def filter_size_for_hashes(n: Column, h: Column, p: Column) -> Column:
    """Bits of a filter for n entries at a false-positive rate p, with h hashes."""
    return F.ceil(-(h * n) / F.log(F.lit(1.0) - F.exp(F.log(p) / h)))


def false_positives(p: Column, kmers: Column) -> Column:
    """Expected false positives among a query's k-mers."""
    return p * kmers
