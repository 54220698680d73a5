"""Language identification by interpolated Kneser-Ney models of characters, one per language.

All languages share one sorted array of n-gram hashes per order; beside it stand, for each language, the discounted
probability of the n-gram and the weight its context leaves to the shorter one. For the longest order the whole
interpolation is worked out once, so that a text needs one search per character, and the recursion only for n-grams
that no language has shown. The language is the one with the lowest cross-entropy per character. A text is rejected
if that entropy is further above what the language's own texts of that length show than chance allows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.llm.segment import LETTER, classes, codes
from strandmill.llm.shared import text_passes

BITS = 16  # of a character's number within an n-gram, so four fit 64 bits
MIX = np.uint64(0x9E3779B97F4A7C15)  # odd, so that different n-grams have different hashes


def _hashed(grams: np.ndarray) -> np.ndarray:
    return grams * MIX


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each hash stands in the sorted keys, and whether it does."""
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, (keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool))


def _last(grams: np.ndarray, n: int) -> np.ndarray:
    return grams & np.uint64((1 << BITS * n) - 1)


@dataclass
class LanguageModel:
    languages: list[str]
    number: np.ndarray  # of each code point: 0 between words, else the letter's number
    symbols: int
    order: int
    grams: list[np.ndarray]  # by order - 1: sorted hashes
    shares: list[np.ndarray]  # (n-grams, languages)
    contexts: list[np.ndarray]
    leaves: list[np.ndarray]  # (contexts, languages)
    whole: np.ndarray | None = None  # bits per n-gram of the longest order, (n-grams, languages)
    level: np.ndarray | None = None  # expected cross-entropy of a language's own texts
    spread: np.ndarray | None = None  # (2, languages): variance of long texts, and of one character

    def numbers(self, text: str) -> np.ndarray:
        """The letters' numbers in lower case, one 0 for whatever stands between words and at both ends."""
        if not text:
            return np.zeros(1, np.uint64)
        x = self.number[codes(text)]
        x = np.concatenate((np.zeros(1, x.dtype), x, np.zeros(1, x.dtype)))
        return x[np.append(True, (x[1:] != 0) | (x[:-1] != 0))].astype(np.uint64)

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """-log2 of the interpolated probability of each n-gram's last character, (n-grams, languages)."""
        p = np.full((len(grams), len(self.languages)), 1 / self.symbols)
        for n in range(1, self.order + 1):
            own = _last(grams, n)
            at, there = _find(self.contexts[n - 1], _hashed(own >> np.uint64(BITS)))
            p *= np.where(there[:, None], self.leaves[n - 1][at], 1)
            at, there = _find(self.grams[n - 1], _hashed(own))
            p[there] += self.shares[n - 1][at[there]]
        return -np.log2(p)

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character by language (texts, languages), and the characters counted."""
        rows = [self.numbers(t or "") for t in texts]
        lengths = np.array([len(r) - 1 for r in rows])
        total = np.zeros((len(rows), len(self.languages)))
        some = [r for r in rows if len(r) > 1]
        if some and self.languages:
            grams = []
            for r in some:
                g = r[1:].copy()
                for back in range(1, self.order):
                    if back < len(r):
                        g[back - 1 :] |= r[: len(r) - back] << np.uint64(BITS * back)
                grams.append(g)
            begins = np.cumsum([0, *map(len, grams[:-1])])
            g = np.concatenate(grams)
            at, there = _find(self.grams[-1], _hashed(g))
            cost = self.whole[at]
            if not there.all():
                new, back = np.unique(g[~there], return_inverse=True)
                cost[~there] = self.bits(new)[back]
            total[lengths > 0] = np.add.reduceat(cost, begins, axis=0, dtype=np.float64)
        return total / np.maximum(lengths, 1)[:, None], lengths

    def judge(self, texts: list[str | None]) -> list[tuple[str, float, float | None, bool]]:
        """(language, confidence, cross-entropy, rejected) of each text; ``und``, 0, null, true without letters."""
        h, n = self.entropies(texts)
        out = []
        for row, length, text in zip(h, n.tolist(), texts):
            if not length or not self.languages:
                out.append(("und", 0.0, None, True))
                continue
            best = int(row.argmin())
            share = float(1 / np.exp(-(row - row[best]) * np.log(2) * np.sqrt(length)).sum())
            limit = self.level[best] + 8 * np.sqrt(self.spread[0, best] + self.spread[1, best] / length)
            out.append((self.languages[best], share, float(row[best]), bool(row[best] > limit)))
        return out


def fit(samples: list[tuple[str, str]], order: int = 4) -> LanguageModel:
    """A model of (language, text) samples; every tenth text of a language serves to calibrate the rejection.

    Every letter of the samples has a number of its own, up to 65,533 different ones; ``order`` is 4 at most.
    """
    if not 1 <= order <= 64 // BITS:
        raise ValueError(f"order is 1 to {64 // BITS}")
    samples = sorted(set(samples))
    languages = sorted({lang for lang, _ in samples})
    counts: dict[str, int] = {}
    for _, text in samples:
        points, n = np.unique(codes(text.lower()), return_counts=True)
        for p, k in zip(points.tolist(), n.tolist()):
            counts[chr(p)] = counts.get(chr(p), 0) + k
    kind = classes()
    letters = sorted((c for c in counts if kind[ord(c)] == LETTER), key=lambda c: (-counts[c], c))[: (1 << BITS) - 3]
    number = np.where(kind == LETTER, np.uint16(len(letters) + 1), np.uint16(0)).astype(np.uint16)
    rank = {c: i for i, c in enumerate(letters, 1)}
    for c, i in rank.items():
        number[ord(c)] = i
        if len(c.upper()) == 1 and len(c.upper().lower()) == 1:
            number[ord(c.upper())] = rank.get(c.upper().lower(), i)
    model = LanguageModel(languages, number, len(letters) + 2, order, [], [], [], [])
    by_language = [[t for lang, t in samples if lang == name] for name in languages]
    grams = []  # by language: different n-grams of the longest order and their counts
    for texts in by_language:
        used = [t for i, t in enumerate(texts) if i % 10 != 5]
        parts = []
        for t in used:
            r = model.numbers(t)
            g = r[1:].copy()
            for back in range(1, order):
                if back < len(r):
                    g[back - 1 :] |= r[: len(r) - back] << np.uint64(BITS * back)
            parts.append(g)
        grams.append(np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint64), return_counts=True))
    tables = []
    for n in range(order, 0, -1):  # counts for the longest order, then how many different characters stand before
        tables.append(grams)
        lower = []
        for keys, _ in grams:
            lower.append(np.unique(_last(keys, n - 1), return_counts=True))
        grams = lower
    for n, grams in enumerate(tables[::-1], 1):
        every = np.unique(np.concatenate([k for k, _ in grams])) if grams else np.zeros(0, np.uint64)
        contexts = np.unique(every >> np.uint64(BITS))
        shares, leaves = np.zeros((len(every), len(languages))), np.ones((len(contexts), len(languages)))
        for i, (keys, k) in enumerate(grams):
            once, twice = int((k == 1).sum()), int((k == 2).sum())
            discount = once / (once + 2 * twice) if once and twice else 0.5
            c, back = np.unique(keys >> np.uint64(BITS), return_inverse=True)
            sums, kinds = np.bincount(back, k), np.bincount(back)
            shares[np.searchsorted(every, keys), i] = (k - discount) / sums[back]
            leaves[np.searchsorted(contexts, c), i] = discount * kinds / sums
        for keys, values, to_keys, to_values in ((every, shares, model.grams, model.shares), (contexts, leaves, model.contexts, model.leaves)):
            hashes = _hashed(keys)
            sort = np.argsort(hashes)
            to_keys.append(hashes[sort])
            to_values.append(values[sort])
        if n == order:
            model.whole = model.bits(every[sort_of(every)]).astype(np.float32) if len(every) else np.zeros((1, len(languages)), np.float32)
    level, spread = [], []
    for i, texts in enumerate(by_language):
        held = [t for j, t in enumerate(texts) if j % 10 == 5] or texts
        h, n = model.entropies(held)
        own, n = h[n > 0, i], n[n > 0]
        middle = float(np.median(own)) if len(own) else 0.0
        far = (own - middle) ** 2
        level.append(middle)
        # Medians, as some texts hold passages of another language; 0.455 is the median of a squared normal deviate.
        spread.append((max(0.02, float(np.median(far[n >= np.median(n)])) / 0.455 if len(own) else 0), max(2.0, float(np.median(far * n)) / 0.455 if len(own) else 0)))
    model.level, model.spread = np.array(level), np.array(spread).reshape(-1, 2).T
    return model


def sort_of(keys: np.ndarray) -> np.ndarray:
    return np.argsort(_hashed(keys))


def learn(docs: DataFrame, *, max_docs: int = 1000, max_languages: int = 500, max_chars: int = 64_000_000, order: int = 4, only: Column | None = None) -> LanguageModel:
    """A model of (text, lang) of at most ``max_docs`` documents per language, picked by a hash of doc_id.

    All together have ``max_chars`` characters at most, each language the same part of them; a document that is longer
    than its language's part is passed over, and the documents end where the part is full.
    ``only``: which rows may be learned from. The ``max_languages`` most frequent values of lang are learned, so that
    stray values do not become models. Rows without language or text teach nothing; without any, no language is known
    and every text is ``und``.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if only is not None:
        rows = rows.where(only)
    held = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(max_languages).collect()
    if not held:
        return fit([], order)
    # Twice the share that gives max_docs, so that the bound is reached; the window then holds it exactly.
    pick = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(9)), F.lit(1 << 30))
    below = F.create_map(*(F.lit(x) for r in held for x in (r["lang"], int(min(1.0, 2 * max_docs / r["n"]) * (1 << 30)))))
    few = rows.where(pick < below[F.col("lang")]).select("lang", "text", pick.alias("pick"))
    room = max_chars // len(held)
    order_by = Window.partitionBy("lang").orderBy("pick", "text")
    few = few.where(F.length("text") <= room).withColumn("rank", F.row_number().over(order_by)).where(F.col("rank") <= max_docs)
    few = few.withColumn("chars", F.sum(F.length("text").cast("long")).over(order_by.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("chars") <= room)
    return fit([(r["lang"], r["text"]) for r in few.select("lang", "text").collect()], order)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score, cross_entropy, rejected) of every whole text.

    A null text, or one without letters, is ``und`` with score 0 and rejected. Repeated rows are judged each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample that it was fitted on

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_passes(batches, limit=1 << 20):
            lang, score, h, no = zip(*shared.value.judge(texts))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(h, pa.float64()), pa.array(no, pa.bool_())], names=["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])

    given = docs.select("doc_id", "text")
    return given.mapInArrow(run, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, cross_entropy double, rejected boolean")


def keep_identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_passes(batches, limit=1 << 20):
            yield part.filter(pa.array([not x[3] for x in shared.value.judge(texts)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
