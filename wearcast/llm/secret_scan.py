"""Secrets by grammar inference: probabilistic automata of credential formats.

1. Base: one strict pattern a kind (assign, access, hex), leftmost and
   non-overlapping, with its check; failing matches are dropped. Base spans are
   always reported.
2. The values of base spans are labelled credentials, all other runs of characters
   ordinary ones. Of each kind, all different values but a quarter held out are
   counted into a prefix tree; prefixes held by fewer than ``LEAST_VISITS`` values,
   or one in ``NODES``, are no states of it. Its states are merged while a test of
   Hoeffding's bound finds their endings and continuations compatible (single
   characters and classes). Where values leave the merged tree, they go on in the
   state that what follows fits best, found by passes over all values until none
   leaves it: what remains is a probabilistic automaton of the kind's format, and
   its probabilities are counts over all of these values, to their ends.
3. Every run of ``LEAST`` or more characters in every text is scored by its
   format likelihood, the mean over its characters of log2 P under a kind's
   automaton, and by how far that lies above the ordinary one's. Runs above both
   thresholds of a kind are added under the kind that exceeds the ordinary
   automaton most; a run inside a base span is not reported again.
4. Thresholds come from all values held out, counted in steps of 1/``GRAIN``:
   ``MISSED`` of a kind's credentials may fall below each, unless more than
   ``FALSE`` of the ordinary runs would pass; then the second one rises. A kind
   with fewer than ``LEAST_LABELS`` different values adds nothing.

Scale: two scans without a shuffle of texts; the first sends the values, each once
a task as long as its memory allows, so that a value held by a third of all
documents counts once. They stay in Spark, dealt by range; the driver gets counts a
state and symbol. The automata are bounded by ``NODES``, whatever the corpus.

Defined cases: null text is the empty text, without spans; offsets count code
points, ends are exclusive; repeated rows and null ids are answered row by row;
empty tables give empty results; without labelled credentials the base spans
are the result; extra columns are ignored.
"""

from __future__ import annotations

import math
import os
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearcast.llm.words import slices
from wearcast.session import pin

#: Kinds in their order of report.
KINDS = ("assign", "access", "hex")
ORDINARY = "ordinary"

#: Fixed patterns, as contracted; letters of "assign" in either case.
_BASE = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}
_ENOUGH = {"assign": 6, "access": 20, "hex": 24}
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
LEAST = 12

NODES = 2_000  # a state of the prefix tree is reached by one in so many values at least
DEPTH = 256  # symbols of its longest prefixes; what follows is counted by the passes
HELD_CHARS = 8 << 20  # of different values that a task holds back
PART_VALUES = 20_000  # of a task that counts
GRAIN = 1024
LEAST_LABELS = 8
ALPHA = 0.05  # of the compatibility test
LEAST_VISITS = 8  # states seen less often are compatible with any other
MISSED, FALSE, LEAST_LEAD = 0.02, 0.001, 0.25
SLACK = 0.25  # bits a character by which a format may be less likely than the held-out credentials: other lengths

#: Characters of credentials; the automata's symbols are their places here.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
SYMBOLS = END = len(ALPHABET)
#: Classes whose shares of a state are compared beside those of single characters: capitals, small letters, digits, marks.
_CLASS = [0] * 26 + [1] * 26 + [2] * 10 + [3] * 6
_SYMBOL_OF = np.zeros(128, np.int8)
_SYMBOL_OF[[ord(c) for c in ALPHABET]] = np.arange(SYMBOLS)
LONG_RUN = 4096  # characters; longer runs are scored one by one


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, value) of the base spans, by start, then kind."""
    out = []
    for k, kind in enumerate(KINDS):
        for m in _BASE[kind].finditer(text):
            value = m.group(2) if kind == "assign" else m.group()
            if len(value) >= _ENOUGH[kind]:
                out.append((m.start(), k, m.end(), value))
    out.sort()
    return out


def candidates(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int]]:
    """Runs of characters of credentials, without dots around them, that no base span covers."""
    out, at, cover = [], 0, 0
    for m in _RUN.finditer(text):
        value = m.group()
        start = m.start() + len(value) - len(value.lstrip("."))
        end = m.end() - (len(value) - len(value.rstrip(".")))
        while at < len(base) and base[at][0] <= start:
            cover, at = max(cover, base[at][2]), at + 1
        if end - start >= LEAST and cover < end:
            out.append((start, end))
    return out


def symbols(value: str) -> np.ndarray:
    """Places in the alphabet of the characters of a run (ASCII)."""
    return _SYMBOL_OF[np.frombuffer(value.encode("ascii"), np.uint8)]


# ---------------------------------------------------------------- grammar inference
class Tree:
    """Prefix tree of symbol sequences, merged to an automaton: visits, endings and children of each state."""

    def __init__(self, words: list[bytes]):
        self.visits, self.ends, self.next = [0], [0], [{}]
        self.parent: list[tuple[int, int]] = [(-1, -1)]
        for word in words:
            s = 0
            self.visits[0] += 1
            for c in word:
                t = self.next[s].get(c)
                if t is None:
                    t = self.next[s][c] = len(self.visits)
                    self.visits.append(0)
                    self.ends.append(0)
                    self.next.append({})
                    self.parent.append((s, c))
                s = t
                self.visits[s] += 1
            self.ends[s] += 1
        #: how often each transition was taken; merging adds them up
        self.taken = [{c: self.visits[t] for c, t in n.items()} for n in self.next]

    @staticmethod
    def counted(rows: list[tuple[bytes, int, int]]) -> Tree:
        """From (prefix, symbol that follows or ``END``, count); symbols whose prefix has no rows lead to no state."""
        tree, number, of = Tree([]), {b"": 0}, defaultdict(dict)
        for prefix, c, n in rows:
            of[prefix][c] = n
        for prefix in sorted(of):
            if prefix:
                p, c = number[prefix[:-1]], prefix[-1]
                number[prefix] = tree.next[p][c] = len(tree.visits)
                tree.parent.append((p, c))
                for x, new in ((tree.visits, 0), (tree.ends, 0), (tree.next, {}), (tree.taken, {})):
                    x.append(new)
            at = number[prefix]
            tree.visits[at], tree.ends[at] = sum(of[prefix].values()), of[prefix].get(END, 0)
            tree.taken[at] = {c: n for c, n in sorted(of[prefix].items()) if c != END}
        return tree

    def alike(self, a: int, b: int, alpha: float = ALPHA, least: int = LEAST_VISITS) -> bool:
        """Whether state ``b`` (the root of a subtree) ends and goes on as ``a`` does, by Hoeffding's bound at each pair."""
        spread, todo = math.sqrt(0.5 * math.log(2 / alpha)), [(a, b)]
        while todo:
            p, q = todo.pop()
            n, m = self.visits[p], self.visits[q]
            if n < least or m < least:
                continue
            bound = spread * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.ends[p] / n - self.ends[q] / m) > bound:
                return False
            shares = [0.0] * (max(_CLASS) + 1)
            for c in self.taken[p].keys() | self.taken[q].keys():
                gap = self.taken[p].get(c, 0) / n - self.taken[q].get(c, 0) / m
                if abs(gap) > bound:
                    return False
                shares[_CLASS[c]] += gap
                if c in self.next[p] and c in self.next[q]:
                    todo.append((self.next[p][c], self.next[q][c]))
            if any(abs(gap) > bound for gap in shares):
                return False
        return True

    def evidence(self, a: int, b: int) -> float:
        """Log-likelihood of what follows ``b`` at once under state ``a``: of several compatible states the best one is taken."""
        n, share = self.visits[a] + 0.5, 0.5 / (SYMBOLS + 1)
        return self.ends[b] * math.log((self.ends[a] + share) / n) + sum(m * math.log((self.taken[a].get(c, 0) + share) / n) for c, m in self.taken[b].items())

    def fold(self, a: int, b: int) -> None:
        """State ``b``, the root of a subtree, becomes part of ``a``."""
        p, c = self.parent[b]
        self.next[p][c] = a
        todo = [(a, b)]
        while todo:
            p, q = todo.pop()
            self.visits[p] += self.visits[q]
            self.ends[p] += self.ends[q]
            for c, n in self.taken[q].items():
                self.taken[p][c] = self.taken[p].get(c, 0) + n
            for c, t in self.next[q].items():
                if c in self.next[p]:
                    todo.append((self.next[p][c], t))
                else:
                    self.next[p][c], self.parent[t] = t, (p, c)

    def merge(self, alpha: float = ALPHA, least: int = LEAST_VISITS) -> list[int]:
        """Merge compatible states, the most visited first; the states that remain, the start first."""
        kept = [0]
        while True:
            there = set(kept)
            fringe = {t for s in kept for t in self.next[s].values()} - there
            if not fringe:
                return kept
            q = min(fringe, key=lambda t: (-self.visits[t], t))
            fitting = [p for p in kept if self.alike(p, q, alpha, least)]
            if fitting:
                self.fold(max(fitting, key=lambda p: self.evidence(p, q)), q)
            else:
                kept.append(q)


def table(tree: Tree, alpha: float = ALPHA, least: int = LEAST_VISITS) -> tuple[np.ndarray, np.ndarray]:
    """Next states (-1: none) and counts by symbol of the merged tree, ``END`` the last, the start first."""
    kept = tree.merge(alpha, least)
    number = {s: i for i, s in enumerate(kept)}
    step, count = np.full((len(kept), SYMBOLS), -1, np.int32), np.zeros((len(kept), SYMBOLS + 1), np.int64)
    for i, s in enumerate(kept):
        count[i, END] = tree.ends[s]
        for c, n in tree.taken[s].items():
            count[i, c] = n
        for c, t in tree.next[s].items():
            step[i, c] = number[t]
    return step, count


def walk(step: np.ndarray, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sequences taken through the states until they end or leave them: counts by state and symbol (``END`` included), and
    counts by state, symbol that leads nowhere and the symbol after it."""
    width = SYMBOLS + 1
    count, falls = np.zeros(len(step) * width, np.int64), Counter()
    size = np.array([len(s) for s in sequences], np.int64)
    short = np.flatnonzero(size <= LONG_RUN)
    order = short[np.argsort(-size[short], kind="stable")]
    if len(order):
        flat = np.concatenate([np.append(sequences[i], END) for i in order]).astype(np.int64)
        at, s = np.concatenate([[0], np.cumsum(size[order] + 1)])[:-1], np.zeros(len(order), np.int64)
        while len(at):
            c = flat[at]
            count += np.bincount(s * width + c, minlength=len(count))
            at, s, c = at[c < END], s[c < END], c[c < END]
            to = step[s, c]
            lost = to < 0
            falls.update(zip(s[lost].tolist(), c[lost].tolist(), flat[at[lost] + 1].tolist()))
            at, s = at[~lost] + 1, to[~lost].astype(np.int64)
    if len(order) < len(sequences):
        rows = step.tolist()
        for i in np.flatnonzero(size > LONG_RUN):
            s, word, own = 0, [*sequences[i].tolist(), END], Counter()
            for j, c in enumerate(word):
                own[s * width + c] += 1
                if c < END and rows[s][c] < 0:
                    falls[s, c, word[j + 1]] += 1
                    break
                s = rows[s][c] if c < END else s
            count[list(own)] += list(own.values())
    left = np.array([(*k, n) for k, n in sorted(falls.items())], np.int64).reshape(-1, 4)
    return count.reshape(-1, width), left


@dataclass
class Automaton:
    """States as rows: next state and log2 probability by symbol, log2 probability of ending; the last state is for the unseen."""

    step: np.ndarray
    weight: np.ndarray
    end: np.ndarray

    @staticmethod
    def infer(words: list[bytes], alpha: float = ALPHA, least: int = LEAST_VISITS) -> Automaton:
        return Automaton.weighted(*table(Tree(sorted(words)), alpha, least))

    @staticmethod
    def weighted(step: np.ndarray, count: np.ndarray) -> Automaton:
        """From next states (-1: none) and counts by state and symbol, ``END`` the last."""
        n = len(step)
        step, count = np.vstack([np.where(step < 0, n, step), np.full((1, SYMBOLS), n)]).astype(np.int32), np.vstack([count, np.zeros((1, SYMBOLS + 1))])
        share = 0.5 / (SYMBOLS + 1)  # half a visit for all that was not seen
        weight = np.log2((count + share) / (count.sum(axis=1) + 0.5)[:, None])
        return Automaton(step, weight[:, :END].copy(), weight[:, END].copy())

    def score(self, sequences: list[np.ndarray]) -> np.ndarray:
        """log2 likelihood of each sequence of symbols, all sequences side by side."""
        size = np.array([len(s) for s in sequences])
        out, state = np.zeros(len(sequences)), np.zeros(len(sequences), np.int32)
        short = np.flatnonzero(size <= LONG_RUN)
        order = short[np.argsort(-size[short], kind="stable")]
        if len(order):
            flat, start = np.concatenate([sequences[i] for i in order]), np.concatenate([[0], np.cumsum(size[order])])[:-1]
            s, total, ordered = np.zeros(len(order), np.int32), np.zeros(len(order)), -size[order]
            for j in range(int(size[order[0]])):
                live = int(np.searchsorted(ordered, -j, side="left"))  # sequences of more than j symbols
                c = flat[start[:live] + j]
                total[:live] += self.weight[s[:live], c]
                s[:live] = self.step[s[:live], c]
            out[order], state[order] = total, s
        step, weight = (self.step.tolist(), self.weight.tolist()) if len(order) < len(sequences) else ([], [])
        for i in np.flatnonzero(size > LONG_RUN):
            at, total = 0, 0.0
            for c in sequences[i].tolist():
                total += weight[at][c]
                at = step[at][c]
            out[i], state[i] = total, at
        return out + self.end[state]


@dataclass
class Grammar:
    """Automata and thresholds by kind, and the automaton of ordinary runs; without kinds only base spans count."""

    kinds: dict[str, Automaton]
    ordinary: Automaton | None
    #: least format likelihood and least lead over the ordinary automaton, by kind
    threshold: dict[str, tuple[float, float]]

    def scores(self, values: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(kinds, format likelihood and lead over the ordinary automaton of each value under each of them)."""
        names, sequences = list(self.kinds), [symbols(v) for v in values]
        if not values or not names:
            return names, *np.zeros((2, len(values), len(names)))
        size = np.array([len(s) + 1 for s in sequences])
        plain = self.ordinary.score(sequences) / size
        own = np.stack([self.kinds[k].score(sequences) / size for k in names], axis=1)
        return names, own, own - plain[:, None]

    def judge(self, values: list[str]) -> Iterator[tuple[int, str, float]]:
        """(place, kind, lead) of the values that pass."""
        names, own, lead = self.scores(values)
        if not values or not names:
            return
        least = np.array([self.threshold[k] for k in names])
        passing = (own >= least[:, 0]) & (lead >= least[:, 1])
        best = np.argmax(np.where(passing, lead, -np.inf), axis=1)
        for i in np.flatnonzero(passing.any(axis=1)).tolist():
            yield i, names[best[i]], float(lead[i, best[i]])


def values(docs: DataFrame, text: str = "text") -> DataFrame:
    """kind, value, held: all different values of base spans by kind, and the ordinary runs that are no such value; a quarter
    of each kind, at least one, is held out."""
    own = docs.select(F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, chars = set(), 0

        def out():
            kinds, found = zip(*seen) if seen else ((), ())
            return pa.record_batch([pa.array(kinds, pa.string()), pa.array(found, pa.string())], ["kind", "value"])

        for b in batches:
            for part in slices(b, "text"):
                for t in part.column(0).to_pylist():
                    base = base_spans(t or "")
                    new = {(KINDS[k], value) for _, k, _, value in base} | {(ORDINARY, t[a:z]) for a, z in candidates(t or "", base)}
                    new -= seen
                    chars += sum(len(v) + 100 for _, v in new)
                    seen |= new
                    if chars > HELD_CHARS:
                        yield out()
                        seen, chars = set(), 0
        yield out()

    found = pin(own.mapInArrow(run, "kind string, value string").distinct())
    labelled = found.filter(F.col("kind") != ORDINARY)
    found = labelled.unionByName(found.filter(F.col("kind") == ORDINARY).join(labelled.select("value").distinct(), "value", "left_anti"))
    spot = F.xxhash64("value")
    first = found.groupBy("kind").agg(F.min(spot).alias("first"))
    found = found.join(F.broadcast(first), "kind").select("kind", "value", ((F.pmod(spot, F.lit(4)) == 0) | (spot == F.col("first"))).alias("held"))
    return pin(found.repartitionByRange("kind", "value").sortWithinPartitions("kind", "value"))


def prefixes(words: DataFrame, least: dict[str, int]) -> DataFrame:
    """kind, prefix (symbols), symbol that follows or ``END``, n: of the prefixes of ``least`` values or more.

    ``words`` are dealt by range and sorted, so that the values of a prefix stand side by side; only the prefixes of a part's
    first and last value go on in other parts, and their counts are added up.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path: list[tuple[dict[int, int], bool]] = []  # what follows each prefix of the value at hand, and whether the first value has it
        kind, word, out, first = None, b"", [], True

        def close(depth, last=False):
            while len(path) > depth:
                taken, border = path.pop()
                if border or last or sum(taken.values()) >= least[kind]:
                    out.extend((kind, word[:len(path)], c, n) for c, n in taken.items())

        def batch():
            rows = [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.binary(), pa.int32(), pa.int64()))]
            out.clear()
            return pa.record_batch(rows, ["kind", "prefix", "symbol", "n"])

        for b in batches:
            for k, value in zip(b.column("kind").to_pylist(), b.column("value").to_pylist()):
                new = symbols(value[:DEPTH]).tobytes()
                close(len(os.path.commonprefix([word, new])) + 1 if k == kind else 0)
                kind, word = k, new
                for d in range(min(len(new) + (len(value) <= DEPTH), DEPTH)):
                    if d == len(path):
                        path.append(({}, first))
                    c = new[d] if d < len(new) else END
                    path[d][0][c] = path[d][0].get(c, 0) + 1
                first = False
            yield batch()
        close(0, True)
        yield batch()

    found = words.mapInArrow(run, "kind string, prefix binary, symbol int, n long").groupBy("kind", "prefix", "symbol").agg(F.sum("n").alias("n"))
    found = pin(found)
    bar = F.create_map(*[F.lit(x) for pair in least.items() for x in pair])
    enough = found.groupBy("kind", "prefix").agg(F.sum("n").alias("visits")).filter(F.col("visits") >= bar[F.col("kind")])
    return found.join(enough.select("kind", "prefix"), ["kind", "prefix"])


def _counts(words: DataFrame, steps: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], dict[str, dict]]:
    """By kind: counts by state and symbol, and (state, symbol that leads nowhere) -> counts of the symbol after it."""
    sent = words.sparkSession.sparkContext.broadcast(steps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            of = defaultdict(list)
            for k, value in zip(b.column("kind").to_pylist(), b.column("value").to_pylist()):
                of[k].append(symbols(value))
            for k, sequences in of.items():
                count, falls = walk(sent.value[k], sequences)
                for s, c in np.argwhere(count).tolist():
                    total[k, s, c, -1] += int(count[s, c])
                for s, c, after, n in falls.tolist():
                    total[k, s, c, after] += n
        rows = [(*x, n) for x, n in total.items()]
        yield pa.record_batch([pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.string(), *[pa.int32()] * 3, pa.int64()))], ["kind", "state", "symbol", "after", "n"])

    found = words.mapInArrow(run, "kind string, state int, symbol int, after int, n long").groupBy("kind", "state", "symbol", "after").agg(F.sum("n").alias("n"))
    count = {k: np.zeros((len(step), SYMBOLS + 1), np.int64) for k, step in steps.items()}
    falls: dict[str, dict] = {k: defaultdict(lambda: np.zeros(SYMBOLS + 1, np.int64)) for k in steps}
    for kind, s, c, after, n in found.collect():  # at most one row a state, symbol and symbol after it
        if after < 0:
            count[kind][s, c] = n
        else:
            falls[kind][s, c][after] = n
    return count, falls


def infer(words: DataFrame, least: dict[str, int], parts: int, alpha: float = ALPHA) -> dict[str, Automaton]:
    """The automaton of each kind from all its words; each task of a pass sends counts, so there are ``parts`` of them."""
    of = defaultdict(list)
    for kind, prefix, c, n in prefixes(words, least).collect():  # at most NODES prefixes of each length
        of[kind].append((bytes(prefix), c, n))
    steps, few = {k: table(Tree.counted(of[k]), alpha, n)[0] for k, n in least.items()}, words.coalesce(parts)
    while True:
        count, falls = _counts(few, steps)
        if not any(falls.values()):
            return {k: Automaton.weighted(steps[k], count[k]) for k in steps}
        for k, own in falls.items():
            log = np.log((count[k] + 0.5 / (SYMBOLS + 1)) / (count[k].sum(axis=1) + 0.5)[:, None])
            for (s, c), after in sorted(own.items()):
                steps[k][s, c] = np.argmax(log @ after)


def _steps(words: DataFrame, grammar: Grammar, least: dict[str, float] | None = None) -> dict[tuple[str, str], list[tuple[int, int]]]:
    """(kind, "own" or "lead") -> (step of the score, count), ascending, of each kind's own words; with ``least`` the leads of
    all words that reach a kind's least likelihood."""
    sent = words.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            kinds = np.array(b.column("kind").to_pylist())
            names, own, lead = sent.value.scores(b.column("value").to_pylist())
            for i, k in enumerate(names):
                at = own[:, i] >= least[k] if least else kinds == k
                for what, x in (("own", own), ("lead", lead)):
                    total.update((k, what, v) for v in np.floor(x[at, i] * GRAIN).astype(int).tolist())
        rows = [(*x, n) for x, n in total.items()]
        yield pa.record_batch([pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], ["kind", "what", "step", "n"])

    found = words.mapInArrow(run, "kind string, what string, step long, n long").groupBy("kind", "what", "step").agg(F.sum("n").alias("n"))
    out = defaultdict(list)
    for kind, what, step, n in found.orderBy("step").collect():  # GRAIN a bit at most
        out[kind, what].append((step, n))
    return out


def _low(steps: list[tuple[int, int]]) -> float:
    """The step that ``MISSED`` of the counted scores stay below."""
    total = np.cumsum([n for _, n in steps])
    return steps[int(np.searchsorted(total, int(MISSED * (total[-1] - 1)), "right"))][0] / GRAIN


def fit(docs: DataFrame, text: str = "text", alpha: float = ALPHA) -> Grammar:
    """Automata from three quarters of all different values, thresholds from the rest."""
    found = values(docs, text)
    size = {(r["kind"], r["held"]): r["count"] for r in found.groupBy("kind", "held").count().collect()}
    known = [k for k in KINDS if size.get((k, True), 0) + size.get((k, False), 0) >= LEAST_LABELS]
    if not known or (ORDINARY, True) not in size:
        return Grammar({}, None, {})
    own = found.filter(F.col("kind").isin([*known, ORDINARY]))
    least = {k: max(LEAST_VISITS, size.get((k, False), 0) // NODES) for k in (*known, ORDINARY)}
    parts = math.ceil(sum(size.values()) / PART_VALUES)
    machines = infer(own.filter(~F.col("held")), least, parts, alpha)
    grammar = Grammar({k: machines[k] for k in known}, machines[ORDINARY], {})
    rest = own.filter("held").coalesce(parts)
    of = _steps(rest.filter(F.col("kind") != ORDINARY), grammar)
    likely = {k: _low(of[k, "own"]) - SLACK for k in known}
    rivals = _steps(rest.filter(F.col("kind") == ORDINARY), grammar, likely)  # ordinary runs of the format; FALSE counts all ordinary runs
    allowed = int(FALSE * size[ORDINARY, True])
    for k in known:
        bar, passing = -np.inf, 0
        for step, n in reversed(rivals[k, "lead"]):
            passing += n
            if passing > allowed:
                bar = (step + 1) / GRAIN
                break
        grammar.threshold[k] = likely[k], float(max(_low(of[k, "lead"]), bar, LEAST_LEAD))
    return grammar


def find(docs: DataFrame, grammar: Grammar, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, spans (kind, start, end, value, base, score) by start, then kind; base spans have score 0."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(grammar)
    fields = [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("base", pa.bool_()), ("score", pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = sent.value
        for b in batches:
            for part in slices(b, "text"):
                found, runs = [], []
                for i, t in enumerate(part.column(1).to_pylist()):
                    base = base_spans(t or "")
                    found.append([(a, k, z, v, True, 0.0) for a, k, z, v in base])
                    runs += [(i, a, z, t[a:z]) for a, z in candidates(t or "", base)] if g.kinds else []
                for at, kind, lead in g.judge([r[3] for r in runs]):
                    i, a, z, v = runs[at]
                    found[i].append((a, KINDS.index(kind), z, v, False, lead))
                spans = [[{"kind": KINDS[k], "start": a, "end": z, "value": v, "base": base, "score": score} for a, k, z, v, base, score in sorted(of)] for of in found]
                yield pa.record_batch([part.column(0), pa.array(spans, pa.list_(pa.struct(fields)))], ["doc_id", "spans"])

    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,value:string,base:boolean,score:double>>")


def report(found: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, digest of the base spans, all spans as text."""
    def text(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def of(kind):
        return F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == kind))).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda x: x["base"])
    return found.select("doc_id", *[of(k) for k in KINDS], F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
