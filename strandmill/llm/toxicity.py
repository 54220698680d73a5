"""Toxicity by a lexicon of words and word stems, misspellings included, weighed by their context.

The lexicon is learned from labelled texts. Its trie, intersected with the Levenshtein automata of its terms, becomes
one deterministic table over character classes. All words of a batch of texts run through that table at once, one
array step per character, and nearly all of them end in its dead state within a few steps. Each hit is weighed by a
window around it: less inside quotation marks or after a verb of saying, more beside the second person; how much,
the labels tell. A logistic model of the weighed hits gives the score.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.llm.segment import LETTER, NUMBER, classes, codes
from strandmill.llm.shared import text_passes

#: Insults that count until the labels say otherwise.
SEEDS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown")
#: Digits and signs read as letters inside words.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
SAYING = re.compile(r"\b(?:said|says|quote[ds]?|called|wrote|sagte|schrieb|nannte|zitiert|dit|écrit|cité|dijo|escribió|llamó)\b[\s:,]*[\"'“«„]?[^.!?\n]*$", re.IGNORECASE)
SECOND_PERSON = re.compile(r"\b(?:you|your|u|du|dich|dein|ihr|tu|te|toi|vous|tú|usted|eres)\b", re.IGNORECASE)
OPENING, CLOSING = "“«„‹", "”»“›"
WORD = re.compile(r"[^\W\d_]+")
#: The model before any label is seen, and how many labels it counts for: bias, log hits, log hits per 100 words.
PRIOR, PRIOR_WEIGHT = np.array([-2.0, 3.5, 0.5]), 1.0


def edits_for(term: str, stem: bool) -> int:
    """Edits allowed: none in short terms and stems under 7 letters, one from 5 letters, two from 9."""
    n = len(term)
    return (1 if n >= 7 else 0) if stem else 2 if n >= 9 else 1 if n >= 5 else 0


@dataclass
class Automaton:
    """``step[state * width + class]`` is the next state; ``hit``/``edits`` by state where a word may end, ``stop`` where
    a stem is complete. State 0 is dead, 1 the start; class 0 ends a word."""

    number: np.ndarray
    width: int
    step: np.ndarray
    hit: np.ndarray
    edits: np.ndarray
    stop: np.ndarray

    def hits(self, points: np.ndarray) -> list[tuple[int, bool, int, int, int]]:
        """(position, whether a whole word, where it was found, term, edits) of each word that a term fits, from code points."""
        x = np.append(self.number[points], np.uint8(0))
        inside = x != 0
        starts = np.flatnonzero(inside & ~np.append(False, inside[:-1]))
        at, state, out = starts, np.ones(len(starts), np.int32), []
        begun = starts
        while len(at):
            c = x[at]
            ended = c == 0
            if ended.any():
                found = np.flatnonzero(ended & (self.hit[state] >= 0))
                out += zip(begun[found].tolist(), repeat(True), at[found].tolist(), self.hit[state[found]].tolist(), self.edits[state[found]].tolist())
            state = self.step[state * self.width + c]
            done = self.stop[state]
            if done.any():
                found = np.flatnonzero(done)
                out += zip(begun[found].tolist(), repeat(False), at[found].tolist(), self.hit[state[found]].tolist(), self.edits[state[found]].tolist())
            live = np.flatnonzero((state != 0) & ~done & ~ended)
            state, begun, at = state[live], begun[live], at[live] + 1
        return out


@dataclass
class Lexicon:
    """Automata for parts of a lexicon; a word is that of the stem that is complete first, else of the closest whole term."""

    machines: list[Automaton]

    def hits(self, text: str) -> list[tuple[int, int, int]]:
        """(position, term, edits) of each word of the text that a term fits."""
        if not text:
            return []
        points, best = codes(text), {}
        for machine in self.machines:
            for at, whole, end, term, edits in machine.hits(points):
                found = (whole, end, edits, term)
                if at not in best or found < best[at]:
                    best[at] = found
        return sorted((at, term, edits) for at, (_, _, edits, term) in best.items())


def automaton(terms: list[tuple[str, bool, int]], max_letters: int = 250, max_states: int = 30_000) -> Lexicon:
    """For (term, whether a stem, edits allowed): the products of their trie and Levenshtein automata, determinised.

    The terms are divided among as many automata as it takes to keep each within the bounds, so that none is left out
    whatever the lexicon's size and letters.
    """
    machines, todo = [], [list(range(len(terms)))]
    while todo:
        own = todo.pop()
        few = len({c for i in own for c in terms[i][0]}) <= max_letters or len(own) == 1
        machine = _determinised(terms, own, max_states if len(own) > 1 else None) if few else None
        if machine is None:
            todo += [own[len(own) // 2 :], own[: len(own) // 2]]
        else:
            machines.append(machine)
    return Lexicon(machines)


def _determinised(terms: list[tuple[str, bool, int]], own: list[int], max_states: int | None) -> Automaton | None:
    """One automaton of some of the terms; None if it has more than ``max_states``."""
    letters = sorted({c for i in own for c in terms[i][0]})
    kind = classes()
    number = np.where((kind == LETTER) | (kind == NUMBER), 1, 0).astype(np.uint8 if len(letters) <= 250 else np.uint16)  # 1: a letter of no term
    for i, c in enumerate(letters, 2):
        for form in {c, c.upper()}:
            if len(form) == 1:
                number[ord(form)] = i
    for sign, c in LOOKALIKES.items():
        number[ord(sign)] = number[ord(c)] if c in letters else 1 if sign.isdigit() else 0
    child: list[dict[int, int]] = [{}]
    ends: list[list[int]] = [[]]
    most = [0]
    for i in own:
        term, _, allowed = terms[i]
        node = 0
        most[0] = max(most[0], allowed)
        for c in term:
            c = int(number[ord(c)])
            if c not in child[node]:
                child[node][c] = len(child)
                child.append({})
                ends.append([])
                most.append(0)
            node = child[node][c]
            most[node] = max(most[node], allowed)
        ends[node].append(i)

    def closed(pairs: dict[int, int]) -> frozenset:
        todo = list(pairs.items())
        while todo:  # letters of a term left out
            node, e = todo.pop()
            if pairs.get(node, 99) < e:
                continue
            for to in child[node].values():
                if e + 1 <= most[to] and pairs.get(to, 99) > e + 1:
                    pairs[to] = e + 1
                    todo.append((to, e + 1))
        return frozenset(pairs.items())

    def best(state: frozenset, stems: bool) -> tuple[int, int]:
        found = [(e, i) for node, e in state for i in ends[node] if e <= terms[i][2] and terms[i][1] == stems]
        return min(found, default=(-1, -1))

    width, start = len(letters) + 2, closed({0: 0})
    known, rows, order = {frozenset(): 0, start: 1}, [np.zeros(width, np.int32)], [start]
    while len(rows) <= len(order):
        state, row = order[len(rows) - 1], np.zeros(width, np.int32)
        if best(state, True)[1] < 0 or state == start:
            for c in range(1, width):
                to: dict[int, int] = {}
                for node, e in state:
                    if e + 1 <= most[node]:  # a letter too many
                        to[node] = min(to.get(node, 99), e + 1)
                    for d, below in child[node].items():
                        cost = e + (d != c)
                        if cost <= most[below]:
                            to[below] = min(to.get(below, 99), cost)
                after = closed(to)
                if after not in known:
                    known[after] = len(known)
                    order.append(after)
                    if max_states is not None and len(known) > max_states:
                        return None
                row[c] = known[after]
        rows.append(row)
    n = len(rows)
    hit, edits, stop = np.full(n, -1, np.int32), np.zeros(n, np.int8), np.zeros(n, bool)
    for i, state in enumerate(order, 1):
        for stems in (False, True):
            e, term = best(state, stems)
            if term >= 0 and (hit[i] < 0 or stems):
                hit[i], edits[i] = term, e
                stop[i] = stems
    return Automaton(number, width, np.concatenate(rows), hit, edits, stop)


#: What a hit weighs by where it stands (alone, quoted or reported, beside the second person) and if it is misspelled, before labels are seen.
ALONE, QUOTED, ADDRESSED, MISSPELLED = 1.0, 0.25, 1.25, 0.6
#: The weights that the labels may choose instead.
CHOICES = ((0.0, 0.1, 0.25, 0.5, 1.0), (1.0, 1.25, 1.5, 2.0), (0.3, 0.6, 1.0))


def context_weights(quoted: float = QUOTED, addressed: float = ADDRESSED, misspelled: float = MISSPELLED) -> np.ndarray:
    """By context, then by whether misspelled: six weights."""
    return np.outer((ALONE, quoted, addressed), (1.0, misspelled)).ravel()


@dataclass
class ToxicityModel:
    terms: list[tuple[str, bool, int]]
    machine: Lexicon
    weights: np.ndarray = field(default_factory=lambda: PRIOR.copy())
    contexts: np.ndarray = field(default_factory=context_weights)
    window: int = 60

    def found(self, text: str) -> list[tuple[int, str, int, int]]:
        """(position, term, edits, context) of each hit; contexts: 0 alone, 1 quoted or reported, 2 beside the second person."""
        out = []
        for at, term, edits in self.machine.hits(text):
            before, after = text[max(0, at - self.window) : at], text[at : at + self.window]
            opened = max((before.rfind(q) for q in OPENING), default=-1)
            closed = max((before.rfind(q) for q in "”»›"), default=-1)
            quoted = opened > closed and any(q in after for q in CLOSING)
            quoted |= before.count('"') % 2 == 1 and '"' in after
            addressed = SECOND_PERSON.search(before[-25:]) or SECOND_PERSON.search(after[:35])
            out.append((at, self.terms[term][0], edits, 1 if quoted or SAYING.search(before) else 2 if addressed else 0))
        return out

    def counts(self, text: str | None) -> np.ndarray:
        """How many hits of each of the six sorts, and the words of the text by its spaces."""
        out = np.zeros(7)
        for _, _, edits, context in self.found(text or ""):
            out[2 * context + (edits > 0)] += 1
        out[6] = max(1, (text or "").count(" ") + 1)
        return out

    def score(self, text: str | None) -> float:
        """0 to 1; an empty text scores as one without hits."""
        return float(_logistic(_features(self.counts(text)[None], self.contexts) @ self.weights)[0])


def _features(counts: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    total = counts[:, :6] @ contexts
    return np.column_stack((np.ones(len(counts)), np.log1p(total), np.log1p(100 * total / counts[:, 6])))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _weights(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """The most likely weights under the prior, and how unlikely the labels are then."""
    w, held = PRIOR.copy(), PRIOR_WEIGHT * np.eye(3)
    for _ in range(30):
        p = _logistic(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + held, x.T @ (y - p) - held @ (w - PRIOR))
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    p = np.clip(_logistic(x @ w), 1e-12, 1 - 1e-12)
    return w, float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).sum() + (w - PRIOR) @ held @ (w - PRIOR) / 2)


def lexicon(toxic: list[str], clean: list[str], *, seeds: tuple[str, ...] = SEEDS, purity: float = 0.9, cover: int = 4) -> list[tuple[str, bool, int]]:
    """Words and stems that mark toxic texts: (term, whether a stem, edits).

    A candidate occurs in several toxic texts and hardly elsewhere; candidates are taken greedily while they reach
    texts that fewer than ``cover`` of those before have reached, so that words which only accompany others stay out.
    """
    def units(text: str) -> set[str]:
        words = {w for w in WORD.findall(text.lower()) if len(w) <= 40}
        return {w + "$" for w in words if len(w) >= 3} | {w[:k] for w in words for k in range(4, min(len(w), 8) + 1)}

    where: dict[str, list[int]] = defaultdict(list)
    for i, t in enumerate(toxic):
        for u in units(t):
            where[u].append(i)
    least = max(4, round(0.004 * len(toxic)))
    where = {u: at for u, at in where.items() if len(at) >= least}
    other: Counter = Counter()
    for t in clean:
        other.update(u for u in units(t) if u in where)
    where = {u: at for u, at in where.items() if len(at) >= (purity if len(at) >= 2 * least else 0.97) * (len(at) + other[u])}
    reached, taken = [0] * len(toxic), []
    # Whole words before stems, long stems before short, where they reach as many.
    queue = [(-len(at), not u.endswith("$"), -len(u), u) for u, at in where.items()]
    heapq.heapify(queue)
    while queue:
        gain, stem, size, u = heapq.heappop(queue)
        if any(u.startswith(t) for t, s in taken if s) and stem:
            continue
        now = -sum(reached[i] < cover for i in where[u])
        if now > gain:
            if -now >= least:
                heapq.heappush(queue, (now, stem, size, u))
            continue
        if -now < least:
            break
        taken.append((u.rstrip("$"), stem))
        for i in where[u]:
            reached[i] += 1
    words = dict(taken)
    for s in seeds:
        n, bad = other_count(s, clean), other_count(s, toxic)
        if s not in words and (n + bad < 5 or bad >= 0.5 * (n + bad)):
            words[s] = False
    return sorted((t, stem, edits_for(t, stem)) for t, stem in words.items())


def other_count(word: str, texts: list[str]) -> int:
    has = re.compile(rf"\b{re.escape(word)}\b", re.IGNORECASE)
    return sum(bool(has.search(t)) for t in texts)


def fit(labelled: list[tuple[str, int]]) -> ToxicityModel:
    """A model of (text, 0 or 1); without toxic texts, the seeds and the prior weights."""
    rows = sorted(dict.fromkeys(labelled))
    toxic, clean = [t for t, y in rows if y], [t for t, y in rows if not y]
    terms = lexicon(toxic, clean)
    model = ToxicityModel(terms, automaton(terms))
    # A term keeps its edits only if its misspellings are not clean texts' own words.
    wrong: Counter = Counter()
    for t in clean:
        wrong.update({term for _, term, e in model.machine.hits(t) if e})
    slack = {i for i, n in wrong.items() if n > 0.001 * len(clean)}
    if slack:
        terms = [(t, s, 0 if i in slack else e) for i, (t, s, e) in enumerate(terms)]
        model = ToxicityModel(terms, automaton(terms))
    if rows:
        counts, y = np.array([model.counts(t) for t, _ in rows]), np.array([float(v) for _, v in rows])
        best = None
        for choice in product(*CHOICES):
            contexts = context_weights(*choice)
            w, loss = _weights(_features(counts, contexts), y)
            # Another weight than the given must make the labels likelier by more than chance does.
            loss += 2.0 * sum(a != b for a, b in zip(choice, (QUOTED, ADDRESSED, MISSPELLED)))
            if best is None or loss < best[0]:
                best = loss, w, contexts
        _, model.weights, model.contexts = best
    return model


def learn(docs: DataFrame, labels: DataFrame, *, max_toxic: int = 1000, max_clean: int = 2500, only: Column | None = None) -> ToxicityModel:
    """A model of at most ``max_toxic`` and ``max_clean`` labelled documents, picked by a hash of doc_id.

    ``labels`` has (doc_id, toxic); null labels teach nothing. ``only``: which doc_id may be learned from. Of rows that
    share a doc_id the least text is taken.
    """
    rows = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    if only is not None:
        rows = rows.where(only)
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = F.xxhash64(F.col("doc_id"), F.lit(7))
    few = [rows.where(F.col("toxic") == y).orderBy(pick, "doc_id").limit(n) for y, n in ((1, max_toxic), (0, max_clean))]
    few = few[0].unionByName(few[1])
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(few), "doc_id")  # max_toxic + max_clean rows
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    return fit([(r["text"], int(r["toxic"])) for r in texts.select("text", "toxic").collect()])


def score_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score, predicted) of every whole text; null is the empty text, repeated rows are scored each."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample that it was fitted on

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_passes(batches):
            score = [shared.value.score(t) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score, pa.float64()), pa.array([int(s >= 0.5) for s in score], pa.int32())], names=["doc_id", "score", "predicted"])

    given = docs.select("doc_id", "text")
    return given.mapInArrow(run, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def keep_clean(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_passes(batches):
            yield part.filter(pa.array([shared.value.score(t) < 0.5 for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
