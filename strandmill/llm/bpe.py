"""Byte-level BPE as a lazily determinised transducer, and decoding by an incremental UTF-8 machine.

The merges of a rank file fix one tokenisation of each prefix of a word, and that of a longer prefix extends that
of one shorter prefix by one token. So a transducer reads the bytes from left to right: a state holds the last token
sent out and the bytes read since, with the last token of each of their prefixes. On a byte it finds the one token
that ends there and fits the token before it; whether two tokens fit follows from the ranks of the merges along
their touching edges. A token is sent out as soon as every prefix that a later token could start from agrees on it,
which the longest token bounds. States and transitions are made when first needed and kept up to a limit: in flat
arrays, for all words of a batch at once, or as objects, for single long words.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandmill.llm.flat import MIX, FlatMap, Rows
from strandmill.llm.segment import SpacedSplitter
from strandmill.llm.shared import Then, WordMemo, mapped, text_passes

NEVER = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank of a rank file (a base64 token and its rank in each line)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines) if t}


class _State:
    """pending: the bytes since the last token sent. last: of each prefix of these, its last token. roots: where the
    first token of that prefix ends. begun: (start, trie node) of each longer token that may have begun. bars, edge:
    all that matters of the token sent: for each prefix the least rank that would merge it to that token's end, and
    (trie node, made, used) of the ends that may still merge with more."""

    __slots__ = ("bars", "begun", "edge", "last", "pending", "roots", "tail", "to")

    def __init__(self, pending: bytes, last: tuple[int, ...], roots: tuple[int, ...], begun: list[tuple[int, int]], bars: tuple[int, ...], edge: tuple):
        self.pending, self.last, self.roots, self.begun, self.bars, self.edge = pending, last, roots, begun, bars, edge
        self.to: dict[int, tuple[_State, tuple[int, ...]]] = {}
        self.tail: tuple[int, ...] | None = None


class BpeTransducer:
    """Encodes words (pre-tokens) by the ranks; ``encode`` gives the ids of one."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 20_000):
        self.ranks, self.max_states = ranks, max_states
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.length = {r: len(t) for t, r in ranks.items()}
        self.child: dict[int, int] = {}  # trie of the tokens: node * 256 + byte -> node
        self.ends, self.grows = [-1], [True]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                self.grows[node] = True
                node = self.child.setdefault(node << 8 | byte, len(self.ends))
                if node == len(self.ends):
                    self.ends.append(-1)
                    self.grows.append(False)
            self.ends[node] = rank
        self.parts: dict[int, tuple[int, int] | None | bool] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        self.ends_of: dict[int, tuple] = {}
        self.fitting: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.root = _State(b"", (), (0,), [], (), ())
        self.states: dict[tuple, _State] = {(b"", (), ()): self.root}

    def _split(self, token: int):
        """The two tokens whose merge makes this one; None for one byte; False if the merges never make it."""
        if token in self.parts:
            return self.parts[token]
        ranks, whole = self.ranks, self.bytes_of[token]
        parts = [whole[i : i + 1] for i in range(len(whole))]
        while len(parts) > 2:
            best, at = min((ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best == NEVER:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        out = None if len(parts) == 1 else (ranks[parts[0]], ranks[parts[1]]) if len(parts) == 2 and parts[0] in ranks and parts[1] in ranks else False
        self.parts[token] = out
        return out

    def made(self, token: int) -> bool:
        """Whether the merges make the token."""
        return self._split(token) is not False

    def edge(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """As ``_edge``, with ranks for bytes."""
        return [(self.ranks[text], made, used) for text, made, used in self._edge(token, side)]

    def _edge(self, token: int, side: int) -> list[tuple[bytes, int, int]]:
        """The tokens along one edge of a token's merges: bytes, the rank that makes it, the rank that uses it up."""
        kept = self.edges[side]
        if token not in kept:
            out, used = [], NEVER
            while True:
                parts = self._split(token)
                out.append((self.bytes_of[token], -1 if parts is None else token, used))
                if not parts:
                    break
                used, token = token, parts[side]
            kept[self.ranks[out[0][0]]] = out
            return out
        return kept[token]

    def fit(self, left: int, right: int) -> bool:
        """True if no merge crosses the border of the two tokens."""
        if left < 0:
            return True
        key = left << 32 | right
        if (known := self.fitting.get(key)) is not None:
            return known
        get = self.ranks.get
        ok = self.made(right)
        for a, made_a, used_a in self._edge(left, 1):
            for b, made_b, used_b in self._edge(right, 0):
                r = get(a + b)
                if r is not None and (at := max(r, made_a, made_b)) < used_a and at <= used_b:
                    ok = False
                    break
            if not ok:
                break
        if len(self.fitting) > 100_000:
            self.fitting.clear()
        self.fitting[key] = ok
        return ok

    def _end(self, token: int) -> tuple:
        """(trie node, made, used) of each token along the right edge that could merge with more."""
        if (out := self.ends_of.get(token)) is None:
            found = []
            for text, made, used in self._edge(token, 1):
                node = 0
                for byte in text:
                    node = self.child[node << 8 | byte]
                if self.grows[node]:
                    found.append((node, made, used))
            out = self.ends_of[token] = tuple(found)
        return out

    def _walk(self, edge: tuple, bars: tuple[int, ...], byte: int, made: int) -> tuple[tuple[int, ...], tuple]:
        """One byte further along the ends; ``made``: the rank of the bytes so far, if they are a token, else NEVER."""
        least, kept = NEVER, []
        for node, before, used in edge:
            node = self.child.get(node << 8 | byte)
            if node is None:
                continue
            if made != NEVER and (r := self.ends[node]) >= 0:
                at = max(r, before, made)
                if at < used and at < least:
                    least = at
            if self.grows[node]:
                kept.append((node, before, used))
        bars = (*bars, least)
        return (bars if kept or min(bars) != NEVER else ()), tuple(kept)

    def _first_fits(self, token: int, bars: tuple[int, ...]) -> bool:
        """``fit`` for a first token, from what its left edge meets."""
        if self._split(token) is False:
            return False
        held = len(bars)  # beyond it, and without any, nothing merges
        for text, _, used in self._edge(token, 0) if held else ():
            if len(text) <= held and (bar := bars[len(text) - 1]) <= used and bar != NEVER:
                return False
        return True

    def _expand(self, state: _State, byte: int) -> tuple[_State, tuple[int, ...]]:
        child, ends, grows, fitting = self.child, self.ends, self.grows, self.fitting
        last, n, p = state.last, len(state.pending) + 1, state.pending + bytes((byte,))
        bars, edge = state.bars, state.edge
        if edge:
            bars, edge = self._walk(edge, bars, byte, -1 if n == 1 else self.ranks.get(p, NEVER))
        found, begun = -1, []
        for j, node in (*state.begun, (n - 1, 0)):
            node = child.get(node << 8 | byte)
            if node is None:
                continue
            if grows[node]:
                begun.append((j, node))
            if found < 0 and (t := ends[node]) >= 0:
                if not j:
                    fits = self._first_fits(t, bars)
                else:
                    fits = fitting.get(last[j - 1] << 32 | t)
                    if fits is None:
                        fits = self.fit(last[j - 1], t)
                if fits:
                    found, start = t, j
        if found < 0:
            raise ValueError("the ranks lack a single byte")
        roots, sent = state.roots, ()
        last, roots = (*last, found), (*roots, roots[start] if start else n)
        token = -1
        while p:
            # A later token starts at n or where a longer one has begun; nothing is settled while that is 0.
            cut = roots[n]
            for j, _ in begun:
                if roots[j] != cut:
                    cut = 0
                    break
            if not cut:
                break
            token = last[cut - 1]
            sent = (*sent, token)
            p, last, n = p[cut:], last[cut:], n - cut
            if not n:
                begun, roots = [], (0,)
                break
            begun = [(j - cut, node) for j, node in begun]
            roots = [0]
            for i, t in enumerate(last, 1):
                back = i - self.length[t]
                roots.append(roots[back] if back > 0 else i)
        if token >= 0:
            bars, edge = (), self._end(token)
            for i, b in enumerate(p):
                if not edge:
                    break
                bars, edge = self._walk(edge, bars, b, -1 if not i else self.ranks.get(p[: i + 1], NEVER))
        key = (p, bars, edge)
        to = self.states.get(key)
        if to is None:
            if len(self.states) >= self.max_states:
                self._reset()
            to = self.states[key] = _State(p, last, tuple(roots), begun, bars, edge)
        out = state.to[byte] = (to, sent)
        return out

    def _flush(self, state: _State) -> tuple[int, ...]:
        out, at = [], len(state.pending)
        while at > 0:
            out.append(t := state.last[at - 1])
            at -= self.length[t]
        state.tail = tuple(out[::-1])
        return state.tail

    def encode(self, word: bytes) -> list[int]:
        whole = self.ranks.get(word)
        if whole is not None:
            return [whole]
        state, out = self.root, []
        for byte in word:
            state, sent = state.to.get(byte) or self._expand(state, byte)
            if sent:
                out += sent
        out += state.tail if state.tail is not None else self._flush(state)
        return out


class FlatTransducer:
    """The transducer over flat arrays: all words of a batch advance by one byte at a time.

    A state is a row: the last tokens of the prefixes of its pending bytes, the token sent before them while that can
    still matter, and the node of the longest token that may have begun. Transitions that a batch lacks are made
    together, once each, and found by (state, byte) in a flat map. Words beyond ``long`` bytes go through ``rules``.
    """

    def __init__(self, rules: BpeTransducer, max_states: int = 100_000, long: int = 400, batch_bytes: int = 1 << 18):
        self.rules, self.max_states, self.long, self.batch_bytes = rules, max_states, long, batch_bytes
        child, size = rules.child, max(rules.bytes_of) + 1
        self.ends, grows = np.array(rules.ends), np.array(rules.grows)
        keys, nodes = np.fromiter(child, np.uint64, len(child)), np.fromiter(child.values(), np.int64, len(child))
        self.trie = FlatMap()
        self.trie.put(keys + np.uint64(1), nodes)
        self.depth, parents = np.zeros(len(self.ends), np.int64), (keys >> np.uint64(8)).astype(np.int64)
        self.back, self.token_at, self.live = (np.zeros(len(self.ends), np.int64) for _ in range(3))
        level = np.flatnonzero(parents == 0)
        depth = 1
        while len(level):  # breadth first: the longest proper suffix of each node is known before the node's children
            own, bytes_ = nodes[level], (keys[level] & np.uint64(255)).astype(np.int64)
            self.depth[own] = depth
            self.back[own] = self._next(self.back[parents[level]], bytes_) if depth > 1 else 0
            self.token_at[own] = np.where(self.ends[own] >= 0, own, self.token_at[self.back[own]])
            self.live[own] = np.where(grows[own], own, self.live[self.back[own]])
            reached = np.zeros(len(self.ends), bool)
            reached[own] = True
            level, depth = np.flatnonzero(reached[parents]), depth + 1
        self.length, self.named = np.zeros(size, np.int64), np.zeros(size, np.uint64)
        base = [1]
        for token, text in rules.bytes_of.items():
            name = 0
            for byte in text:
                name = (name * _BASE + byte + 1) % (1 << 64)
            self.length[token], self.named[token] = len(text), name
        while len(base) <= self.length.max():
            base.append(base[-1] * _BASE % (1 << 64))
        self.base = np.array(base, np.uint64)
        known = np.array(sorted(rules.bytes_of), np.int64)
        self.by_name = FlatMap()
        self.by_name.put(self.named[known], known)
        self.edge_at = np.full((2, size), -1, np.int64)
        self.edge_n = np.zeros((2, size), np.int64)
        self.edge_token, self.edge_made, self.edge_used = Rows(np.int64), Rows(np.int64), Rows(np.int64)
        self.fitting = FlatMap()
        self._reset()

    def _reset(self) -> None:
        self.last, self.root = Rows(np.int32, 16, -1), Rows(np.int16, 17)
        self.n, self.node, self.before, self.tail, self.tail_n = (Rows(np.int64) for _ in range(5))
        self.to, self.sent_at, self.sent_n, self.sent = Rows(np.int64), Rows(np.int64), Rows(np.int64), Rows(np.uint32)
        self.steps, self.known = FlatMap(), FlatMap()
        self._states(np.full((1, 16), -1, np.int32), np.zeros((1, 17), np.int16), np.zeros(1, np.int64), np.zeros(1, np.int64), np.full(1, -1))

    def _next(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The node of the longest suffix of node + byte."""
        node = node.copy()
        out = self.trie.get((node << 8 | byte).astype(np.uint64) + np.uint64(1))
        todo = np.flatnonzero(out < 0)
        while len(todo):
            out[todo[node[todo] == 0]] = 0
            todo = todo[node[todo] != 0]
            node[todo] = self.back[node[todo]]
            out[todo] = self.trie.get((node[todo] << 8 | byte[todo]).astype(np.uint64) + np.uint64(1))
            todo = todo[out[todo] < 0]
        return out

    def _edges(self, tokens: np.ndarray, side: int) -> None:
        lacking = np.unique(tokens[self.edge_at[side, tokens] < 0])
        for t in lacking.tolist():
            own = self.rules.edge(t, side)
            self.edge_at[side, t] = self.edge_token.add(np.array([x[0] for x in own]))
            self.edge_made.add(np.array([x[1] for x in own]))
            self.edge_used.add(np.array([x[2] for x in own]))
            self.edge_n[side, t] = len(own)

    def fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """True where no merge crosses the border of two tokens and the right one comes of merges; left -1: a beginning."""
        keys = (((left + 1) << 32) | right).astype(np.uint64) + np.uint64(1)
        out = self.fitting.get(keys)
        if (out < 0).any():
            new = np.unique(keys[out < 0])
            pairs = (new - np.uint64(1)).astype(np.int64)
            ok = self._work_out((pairs >> 32) - 1, pairs & 0xFFFFFFFF)
            if self.fitting.n > 300_000:
                self.fitting = FlatMap()
                self.fitting.put(new, ok.astype(np.int64))
                todo = self.fitting.get(keys)
                rest = (todo < 0) & (out >= 0)
                kept, first = np.unique(keys[rest], return_index=True)
                self.fitting.put(kept, out[rest][first])
            else:
                self.fitting.put(new, ok.astype(np.int64))
            out = self.fitting.get(keys)
        return out > 0

    def _work_out(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        made = np.array([self.rules.made(t) for t in right.tolist()], bool)
        some = np.flatnonzero(left >= 0)
        if not len(some):
            return made
        a, b = left[some], right[some]
        self._edges(a, 1)
        self._edges(b, 0)
        n_a, n_b = self.edge_n[1, a], self.edge_n[0, b]
        pair = np.repeat(np.arange(len(some)), n_a * n_b)
        i = np.arange(len(pair)) - np.repeat(np.cumsum(n_a * n_b) - n_a * n_b, n_a * n_b)
        x, y = self.edge_at[1, a][pair] + i // n_b[pair], self.edge_at[0, b][pair] + i % n_b[pair]
        s, t = self.edge_token.all[x], self.edge_token.all[y]
        rank = self.by_name.get(np.maximum(self.named[s] * self.base[self.length[t]] + self.named[t], np.uint64(1)))
        rank[self.length[s] + self.length[t] != self.length[rank]] = -1
        at = np.maximum(np.maximum(self.edge_made.all[x], self.edge_made.all[y]), rank)
        crossed = (rank >= 0) & (at < self.edge_used.all[x]) & (at <= self.edge_used.all[y])
        made[some[pair[crossed]]] = False
        return made

    def _states(self, last: np.ndarray, root: np.ndarray, n: np.ndarray, node: np.ndarray, before: np.ndarray) -> np.ndarray:
        """The numbers of the states with these rows, made if they are new."""
        with np.errstate(over="ignore"):
            key = ((last + 1).astype(np.uint64) * _weights(last.shape[1])).sum(1, dtype=np.uint64) + (before + 2).astype(np.uint64) * MIX
            key = (key ^ (key >> np.uint64(29))) * _STIR
        key = np.maximum(key ^ (key >> np.uint64(32)), np.uint64(1))
        out = self.known.get(key)
        if (out < 0).any():
            new, first = np.unique(key[out < 0], return_index=True)
            at = np.flatnonzero(out < 0)[first]
            begin = self.last.add(last[at])
            for rows, own in ((self.root, root), (self.n, n), (self.node, node), (self.before, before), (self.tail, np.full(len(n), -1)), (self.tail_n, n)):
                rows.add(own[at])
            self.known.put(new, begin + np.arange(len(new)))
            out = self.known.get(key)
        return out

    def _roots(self, last: np.ndarray, n: np.ndarray) -> np.ndarray:
        out, rows = np.zeros((len(n), last.shape[1] + 1), np.int16), np.arange(len(n))
        for i in range(1, int(n.max(initial=0)) + 1):
            back = i - self.length[last[:, i - 1]]
            out[:, i] = np.where(back > 0, out[rows, np.maximum(back, 0)], i)
        return out

    def _expand(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where different (state, byte) lead, and where the tokens sent on the way lie in ``sent`` and how many."""
        n = self.n.all[state] + 1
        if n.max() > self.last.all.shape[1]:
            self.last.widen(2 * self.last.all.shape[1])
            self.root.widen(self.last.all.shape[1] + 1)
        last, root, before = self.last.all[state], self.root.all[state], self.before.all[state]
        node, rows = self._next(self.node.all[state], byte), np.arange(len(state))
        at, token, start, todo = self.token_at[node], np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), rows
        while len(todo):  # the longest token that ends here and fits the one before it
            c = at[todo]
            if not c.all():
                raise ValueError("the ranks lack a single byte")
            t, begin = self.ends[c], n[todo] - self.depth[c]
            ok = self.fits(np.where(begin > 0, last[todo, begin - 1], before[todo]).astype(np.int64), t)
            token[todo[ok]], start[todo[ok]] = t[ok], begin[ok]
            todo = todo[~ok]
            at[todo] = self.token_at[self.back[at[todo]]]
        last[rows, n - 1] = token
        root[rows, n] = np.where(start > 0, root[rows, start], n)
        node, sent, todo = self.live[node], [], rows
        while len(todo):
            # A later token starts at n or where a longer one has begun; what all of these agree on is sent.
            cut, ok = root[todo, n[todo]].astype(np.int64), np.ones(len(todo), bool)
            v = node[todo]
            seen = np.flatnonzero(v)
            while len(seen):
                bad = root[todo[seen], n[todo[seen]] - self.depth[v[seen]]] != cut[seen]
                ok[seen[bad]] = False
                seen = seen[~bad]
                v[seen] = self.live[self.back[v[seen]]]
                seen = seen[v[seen] != 0]
            todo, cut = todo[ok], cut[ok]
            if not len(todo):
                break
            sent.append((todo, last[todo, cut - 1]))
            before[todo] = sent[-1][1]
            wide = np.concatenate((last[todo], np.full((len(todo), int(cut.max())), -1, np.int32)), axis=1)
            last[todo] = wide[np.arange(len(todo))[:, None], np.arange(last.shape[1]) + cut[:, None]]
            n[todo] -= cut
            root[todo] = self._roots(last[todo], n[todo])
            todo = todo[n[todo] > 0]
        before[(n > 0) & (self.depth[node] < n)] = -1  # no token can start at the border any more
        to = self._states(last, root, n, node, before)
        return to, *self._sent(len(n), sent)

    def _sent(self, count: int, rounds: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        if not rounds:
            return np.zeros(count, np.int64), np.zeros(count, np.int64)
        row = np.concatenate([r for r, _ in rounds])
        sort = np.argsort(row, kind="stable")
        first = self.sent.add(np.concatenate([t for _, t in rounds])[sort])
        n = np.bincount(row, minlength=count)
        return first + np.cumsum(n) - n, n

    def _tails(self, states: np.ndarray) -> None:
        """The tokens of the pending bytes, for words that end in these states."""
        states = np.unique(states[self.tail.all[states] < 0])
        last, at, rounds, rows = self.last.all[states], self.n.all[states].copy(), [], np.arange(len(states))
        while len(rows := rows[at[rows] > 0]):
            t = last[rows, at[rows] - 1]
            rounds.append((rows, t))
            at[rows] -= self.length[t]
        self.tail.all[states], self.tail_n.all[states] = self._sent(len(states), rounds[::-1])

    def encode_many(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian uint32."""
        out: list[bytes | None] = [None] * len(words)
        batch, held, ranks = [], 0, self.rules.ranks
        for i, word in enumerate(words):
            whole = ranks.get(word)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(word) > self.long:
                out[i] = np.array(self.rules.encode(word), "<u4").tobytes()
            else:
                batch.append(i)
                held += len(word)
                if held >= self.batch_bytes:
                    self._batch(words, batch, out)
                    batch, held = [], 0
        if batch:
            self._batch(words, batch, out)
        return out

    def _batch(self, words: list[bytes], which: list[int], out: list[bytes | None]) -> None:
        if self.last.n > self.max_states:
            self._reset()
        which = sorted(which, key=lambda i: -len(words[i]))
        size = np.array([len(words[i]) for i in which])
        data, begin = np.frombuffer(b"".join([words[i] for i in which]), np.uint8), np.cumsum(size) - size
        state, word, at, count = np.zeros(len(which), np.int64), [], [], []
        going = np.searchsorted(-size, -np.arange(int(size.max(initial=0))))
        for pos, n in enumerate(going.tolist()):
            key = (state[:n] << 8 | data[begin[:n] + pos]).astype(np.uint64) + np.uint64(1)
            step = self.steps.get(key)
            if (step < 0).any():
                new = np.unique(key[step < 0])
                to, sent_at, sent_n = self._expand(((new - np.uint64(1)) >> np.uint64(8)).astype(np.int64), ((new - np.uint64(1)) & np.uint64(255)).astype(np.int64))
                first = self.to.add(to)
                self.sent_at.add(sent_at)
                self.sent_n.add(sent_n)
                self.steps.put(new, first + np.arange(len(new)))
                step[step < 0] = self.steps.get(key[step < 0])
            state[:n] = self.to.all[step]
            k = self.sent_n.all[step]
            some = np.flatnonzero(k)
            word.append(some)
            at.append(self.sent_at.all[step[some]])
            count.append(k[some])
        self._tails(state)
        word, at, count = np.concatenate([*word, np.arange(len(which))]), np.concatenate([*at, self.tail.all[state]]), np.concatenate([*count, self.tail_n.all[state]])
        sort = np.argsort(word, kind="stable")
        at, count = at[sort], count[sort]
        ids = self.sent.all[np.repeat(at - (np.cumsum(count) - count), count) + np.arange(count.sum())].astype("<u4").tobytes()
        cuts = [0, *(4 * np.cumsum(np.bincount(word[sort], count, len(which)).astype(np.int64))).tolist()]
        for i, a, b in zip(which, cuts, cuts[1:]):
            out[i] = ids[a:b]


_BASE = 0x9E3779B97F4A7C15
_STIR = np.uint64(0xC2B2AE3D27D4EB4F)


@cache
def _weights(width: int) -> np.ndarray:
    """Fixed odd multipliers, the same for a place at every width."""
    return np.random.default_rng(5).integers(1, 1 << 63, 1 << 16, np.uint64)[:width] * np.uint64(2) + np.uint64(1)


class Utf8Machine:
    """Reads bytes one at a time: ``state`` is 0 between characters, else what the character still needs.

    A state is (bytes left, least next byte, greatest next byte). An ill-formed byte gives U+FFFD and a new start.
    """

    def __init__(self):
        self.left, self.low, self.high, self.held = 0, 0x80, 0xBF, bytearray()

    def feed(self, data: bytes) -> str:
        out = []
        for byte in data:
            if self.left:
                if self.low <= byte <= self.high:
                    self.held.append(byte)
                    self.left, self.low, self.high = self.left - 1, 0x80, 0xBF
                    if not self.left:
                        out.append(self.held.decode())
                        self.held.clear()
                    continue
                out.append("�")
                self.held.clear()
                self.left, self.low, self.high = 0, 0x80, 0xBF
            if byte < 0x80:
                out.append(chr(byte))
            elif 0xC2 <= byte <= 0xF4:
                self.left = 1 if byte < 0xE0 else 2 if byte < 0xF0 else 3
                self.low = {0xE0: 0xA0, 0xF0: 0x90}.get(byte, 0x80)
                self.high = {0xED: 0x9F, 0xF4: 0x8F}.get(byte, 0xBF)
                self.held.append(byte)
            else:
                out.append("�")
        return "".join(out)

    def end(self) -> str:
        out = "�" if self.left else ""
        self.__init__()
        return out


class StreamingDecoder:
    """Token ids to text, in any portions; a character split between tokens comes out once it is whole."""

    def __init__(self, bytes_of: dict[int, bytes]):
        size = max(bytes_of) + 1
        self.bytes_of = [bytes_of.get(i, b"") for i in range(size)]
        self.text_of: list[str | None] = [None] * size
        for i, b in enumerate(self.bytes_of):
            try:
                self.text_of[i] = b.decode()
            except UnicodeDecodeError:
                pass
        self.whole = np.array([t is not None for t in self.text_of])
        self.machine = Utf8Machine()

    def feed(self, ids: np.ndarray) -> str:
        text_of, machine, bytes_of = self.text_of, self.machine, self.bytes_of
        if not machine.left and self.whole[ids].all():
            return "".join(map(text_of.__getitem__, ids.tolist()))
        return "".join([machine.feed(bytes_of[i]) if machine.left or text_of[i] is None else text_of[i] for i in ids.tolist()])

    def end(self) -> str:
        return self.machine.end()


class TextEncoder:
    """Whole texts to ids: each match of the pattern by the transducer, each different word once while it is kept."""

    def __init__(self, rank_file: str, pattern: str, kept_words: int = 120_000):
        self.transducer = BpeTransducer(read_ranks(rank_file))
        self.flat = FlatTransducer(self.transducer)
        self.split = SpacedSplitter(pattern)
        self.memo = WordMemo(kept_words, lambda words: self.flat.encode_many([w.encode() for w in words]))

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        return [np.frombuffer(b"".join(ids), np.uint32) for ids in self.memo.values([self.split(t or "") for t in texts])]


@cache
def text_encoder(rank_file: str, pattern: str) -> TextEncoder:
    """One per process: the tasks that a worker runs share its states and words."""
    return TextEncoder(rank_file, pattern)


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", then: Then | None = None) -> DataFrame:
    """Ids and decoded text of every document: (id, n_tokens, ids binary of little-endian uint32, decoded string).

    ``then``: what is made of each batch of these before it leaves its task, such as ``DIGESTS``.

    A null or empty text has no ids and decodes to the empty text. Rows that repeat are encoded each; other columns,
    whatever their names, are not read. ``rank_file`` must lie at the same path on every machine.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = text_encoder(rank_file, pattern)
        decoder = StreamingDecoder(encode.transducer.bytes_of)
        for part, texts in text_passes(batches):
            ids = encode(texts)
            decoded = ["".join(decoder.feed(x[i : i + 65536]) for i in range(0, len(x), 65536)) + decoder.end() for x in ids]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(decoded, pa.string())], names=["id", "n_tokens", "ids", "decoded"])

    given = docs.selectExpr(f"`{id_column}` AS id", f"`{text_column}` AS text")
    return mapped(given, run, f"id {given.schema['id'].dataType.simpleString()}, n_tokens bigint, ids binary, decoded string", then)


def _digests(batch: pa.RecordBatch) -> pa.RecordBatch:
    """SHA-256 of the decimal ids joined by commas, and of the decoded bytes."""
    of_ids = [hashlib.sha256(",".join(map(str, np.frombuffer(x.as_buffer(), np.uint32).tolist())).encode()).hexdigest() for x in batch.column("ids")]
    of_text = [hashlib.sha256(x.as_buffer()).hexdigest() for x in batch.column("decoded")]
    return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_tokens"), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


DIGESTS = Then(_digests, "doc_id {id}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
