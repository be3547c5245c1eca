"""Secret scans: patterns for known credentials, and grammar inference for the formats they follow.

Credentials that the patterns label, and tokens they don't, are samples of six languages. For each a prefix tree over
classes of characters is built and its statistically compatible states are merged (ALERGIA, with Hoeffding's bound) into a
probabilistic automaton, whose probabilities count all tokens; a language has the classes under which those held out are likeliest. Every token that could be a
credential is scored by all automata; one that a credential's format explains far better than ordinary tokens' is a span.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass
from math import log, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table, text_key

#: Kinds in the order that ties between starts follow; "format" is the method's own.
KINDS = ("assign", "access", "hex", "format")
#: Kinds of labelled credentials, and after them of other tokens: long ones, short ones without digits, short ones with.
_FORMATS, _OTHERS = 3, 3


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
_ASSIGN = re.compile(rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
# each match of these two is a whole run, so a run too short fails wherever it is tried
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Characters of the shortest credential that is labelled; any token as long may be one.
_SHORTEST = 6
#: From here on a token is long: long ones have an ordinary model of their own, as they are too rare among all to be learned well.
_LONG = 16
#: Characters of text whose tokens are scored at a time, about; tokens longer than _SLOW are scored one by one.
_PART, _SLOW = 1 << 20, 256

CHARACTERS = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_.=-"
_N = len(CHARACTERS)
#: A character's place among CHARACTERS from 1, by code point; 0 for what no token has, code points over 127 among it.
_CODE = np.zeros(129, np.uint8)
_CODE[[ord(c) for c in CHARACTERS]] = np.arange(1, _N + 1)
_LOWER = np.array([0, *[CHARACTERS.index(c.lower()) + 1 for c in CHARACTERS]], np.uint8)
_CAPITAL = np.array([False, *[c != c.lower() for c in CHARACTERS]])

_D, _AF, _GZ, _A, _G, _P = "0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+/_.=-"
#: The partitions into classes that a language may have, coarsest first.
PARTITIONS = ((_D + _AF + _GZ + _A + _G + _P,), (_D + _AF + _GZ + _A + _G, _P), (_D + _AF + _GZ, _A + _G, _P), (_D + _A + _G, _AF + _GZ, _P), (_D + _AF, _GZ, _A + _G, _P), (_D + _A, _G, _AF + _GZ, _P), (_D, _AF + _GZ, _A + _G, *_P))


def known(text: str) -> list[tuple[int, int, int, str]]:
    """start, kind, end and credential of the matches of the three patterns, leftmost and without overlaps in each."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= _SHORTEST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(out)


def _points(text: str) -> np.ndarray:
    """The characters' places among CHARACTERS."""
    if text.isascii():
        return _CODE[np.frombuffer(text.encode(), np.uint8)]
    return _CODE[np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), 128)]


def _tokens(codes: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of _SHORTEST or more characters of a credential that none of spans (sorted) overlaps."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (codes > 0).view(np.int8), [0]])))
    starts, ends = edges[::2], edges[1::2]
    fit = ends - starts >= _SHORTEST
    if spans:
        before = np.searchsorted(np.array([s for s, _ in spans]), ends)  # spans that start before a token's end
        last = np.concatenate([[0], np.maximum.accumulate(np.array([e for _, e in spans]))])
        fit &= last[before] <= starts
    return starts[fit], ends[fit]


def _parts(texts: list[str]):
    """Bounded numbers of texts, as one text each with line ends between, and where the texts start: (first, joined, starts)."""
    at = 0
    while at < len(texts):
        to, n = at + 1, len(texts[at])
        while to < len(texts) and n + len(texts[to]) <= _PART:
            n += len(texts[to]) + 1
            to += 1
        yield at, "\n".join(texts[at:to]), np.cumsum([0, *[len(t) + 1 for t in texts[at : to - 1]]])
        at = to


@dataclass
class Automaton:
    """A probabilistic deterministic automaton over characters: the next state and log of the probability, by state and character, and that of ending."""

    to: np.ndarray
    logp: np.ndarray
    end: np.ndarray

    def score(self, token: str) -> float:
        """The natural log of the token's probability."""
        at, total = 0, 0.0
        for c in _CODE[np.frombuffer(token.encode(), np.uint8)].tolist():
            total += self.logp[at, c]
            at = self.to[at, c]
        return float(total + self.end[at])

    def scores(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Those of the tokens at starts in codes, longest first: all of them take a step at a time."""
        at, total, live = np.zeros(len(starts), np.int32), np.zeros(len(starts)), len(starts)
        flat, logp = self.to.ravel(), self.logp.ravel()
        for k in range(int(sizes[0]) if len(sizes) else 0):
            live = int(np.searchsorted(-sizes[:live], -k, "left"))
            i = at[:live] * (_N + 1) + codes[starts[:live] + k]
            total[:live] += logp[i]
            at[:live] = flat[i]
        return total + self.end[at]


def _joined(samples: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The samples' characters one after the other, and their starts and sizes, longest first."""
    sizes = np.fromiter(map(len, samples), np.int64, len(samples))
    order = np.argsort(-sizes, kind="stable")
    return _points("".join(samples)), (np.cumsum(sizes) - sizes)[order], sizes[order]


def _class_of(classes: tuple[str, ...]) -> np.ndarray:
    """By a character's place the place of its class, of which 0 stands for no character."""
    return np.array([0, *[next(k for k, cs in enumerate(classes) if c in cs) for c in CHARACTERS]], np.uint64)


def _child(prefix, k):
    """The key of a prefix and one more character, of class k; the empty prefix has key 0."""
    with np.errstate(over="ignore"):
        return _mixed(np.uint64(prefix) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k) + np.uint64(1))


def _prefixes(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, class_of: np.ndarray, first: int, last: int, alive: np.ndarray | None = None):
    """The prefix tree's edges from depth first to last, below the nodes alive at first: prefix, class, samples that take the edge and that end after it."""
    at = np.zeros(len(starts), np.uint64)
    for k in range(min(last, int(sizes[0]) if len(sizes) else 0)):
        if k == first and alive is not None:
            on = np.isin(at, alive)
            at, starts, sizes = at[on], starts[on], sizes[on]
        live = int(np.searchsorted(-sizes, -k, "left"))
        if not live:
            return
        c = class_of[codes[starts[:live] + k]]
        to = _child(at[:live], c)
        if k >= first:
            _, one, own, n = np.unique(to, return_index=True, return_inverse=True, return_counts=True)
            yield at[one], c[one], n, np.bincount(own, sizes[:live] == k + 1, len(n)).astype(np.int64)
        at[:live] = to


def _rare(n: int) -> int:
    """Of n samples, prefixes that fewer have are no states of their own: what follows them is counted where the automaton goes on."""
    return max(2, n // 200)


def _structure(n: int, edges: dict[int, dict[int, tuple[int, int]]], classes: tuple[str, ...], alpha: float) -> np.ndarray:
    """The next state by state and character, from the prefix tree of n samples (by prefix and class the samples that take the edge and that end after it), whose
    compatible states ALERGIA merges. A class never seen in a state leads where the start's does."""
    rare, bound = _rare(n), sqrt(0.5 * log(2 / alpha))
    reached, ended, moves, below = {0: n}, {0: 0}, {}, [0]
    while below:
        x = below.pop()
        moves[x], own = {}, edges.get(x, {})
        if x and sum(m for m, _ in own.values()) < rare:
            continue
        for k, (m, e) in own.items():
            to = int(_child(x, k)) if m >= rare else None
            moves[x][k] = (to, m)
            if to is not None:
                reached[to], ended[to] = m, e
                below.append(to)

    def difference(a: int, b: int) -> float:
        """The largest difference of frequencies between a and b and between what follows both, over Hoeffding's bound; stops over 1, where they are incompatible."""
        worst, stack = 0.0, [(a, b)]
        while stack:
            a, b = stack.pop()
            n, m = reached[a], reached[b]
            most = 1 / (bound * (1 / sqrt(n) + 1 / sqrt(m)))
            worst = max(worst, most * abs(ended[a] / n - ended[b] / m))
            for k in moves[a].keys() | moves[b].keys():
                x, y = moves[a].get(k, (None, 0)), moves[b].get(k, (None, 0))
                worst = max(worst, most * abs(x[1] / n - y[1] / m))
                if x[0] is not None and y[0] is not None and most > 1:  # too few samples to differ have too few further on
                    stack.append((x[0], y[0]))
            if worst > 1:
                return worst
        return worst

    def fold(a: int, b: int) -> None:
        """Adds the tree under b to a."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            reached[a] += reached[b]
            ended[a] += ended[b]
            for k, (to, n) in moves[b].items():
                own, m = moves[a].get(k, (None, 0))
                moves[a][k] = (to if own is None else own, n + m)
                if own is not None and to is not None:
                    stack.append((own, to))

    red, kept = [0], {0}
    while True:
        blue = [(r, k, to) for r in red for k, (to, _) in moves[r].items() if to is not None and to not in kept]
        if not blue:
            break
        r, k, b = max(blue, key=lambda x: (reached[x[2]], -x[2]))  # the best known first
        least, into = min((difference(x, b), i) for i, x in enumerate(red))
        if least > 1:
            red.append(b)
            kept.add(b)
        else:
            moves[r][k] = (red[into], moves[r][k][1])
            fold(red[into], b)

    number = {x: i for i, x in enumerate(red)}
    to, class_of = np.zeros((len(red), _N + 1), np.int32), _class_of(classes)
    for i, x in enumerate(red):
        for k in range(len(classes)):
            target = next((t for t in (moves[x].get(k, (None, 0))[0], moves[0].get(k, (None, 0))[0]) if t is not None), x)
            to[i, 1:][class_of[1:] == k] = number[target]
    return to


def _walked(to: np.ndarray, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many samples take each step: by state and character, with those that end there at 0."""
    at, flat, n = np.zeros(len(starts), np.int64), to.ravel(), np.zeros(to.size, np.int64)
    for k in range(int(sizes[0]) if len(sizes) else 0):
        live = int(np.searchsorted(-sizes, -k, "left"))
        i = at[:live] * (_N + 1) + codes[starts[:live] + k]
        n += np.bincount(i, minlength=len(n))
        at[:live] = flat[i]
    return (n + np.bincount(at * (_N + 1), minlength=len(n))).reshape(to.shape)


def _automaton(to: np.ndarray, steps: np.ndarray, classes: tuple[str, ...]) -> Automaton:
    """A state's probabilities are those of the samples that reached it, smoothed: a class never seen there has one sample's share, spread
    over all classes; within a class characters are as frequent as in the state, weighed against their frequency in all samples."""
    n, chars, class_of = steps.sum(axis=1, keepdims=True) + 1.0, steps[:, 1:].astype(float), _class_of(classes)[1:].astype(int)
    every = 1 + chars.sum(axis=0)
    usual = every / np.bincount(class_of, every)[class_of]
    of_class = np.stack([chars[:, class_of == k].sum(axis=1) for k in range(len(classes))], axis=1)
    share = np.where(of_class > 0, of_class, 1 / len(classes)) / n
    heavy = np.array([float(len(c)) for c in classes])
    logp = np.zeros(to.shape)
    logp[:, 1:] = np.log(share[:, class_of] * (chars + heavy[class_of] * usual) / (of_class + heavy)[:, class_of])
    return Automaton(to, logp, np.log((steps[:, 0] + 0.5) / n[:, 0]))


def infer(samples: list[str], classes: tuple[str, ...] = PARTITIONS[-1], alpha: float = 0.05) -> Automaton:
    """The automaton that ALERGIA merges from the samples' prefix tree over classes of characters, with the probabilities of all samples' steps in it."""
    edges: dict = defaultdict(dict)
    own = _joined(samples)
    for found in _prefixes(*own, _class_of(classes), 0, int(own[2][0])):
        for x, k, n, e in zip(*(v.tolist() for v in found)):
            edges[x][k] = (n, e)
    to = _structure(len(samples), edges, classes, alpha)
    return _automaton(to, _walked(to, *own), classes)


def _out(value: str) -> bool:
    """Whether a sample is held out: one in five is."""
    return xxhash.xxh64_intdigest(value) % 5 == 0


def fit(samples: list[str]) -> tuple[Automaton, list[str]]:
    """The automaton of four in five of samples, over the classes under which the fifth is likeliest, and that fifth; of fewer than ten all serve as both."""
    out, own = [s for s in samples if _out(s)], [s for s in samples if not _out(s)]
    if len(samples) < 10 or not out or not own:
        out = own = samples
    made = [infer(own, p) for p in PARTITIONS]
    joined = _joined(out)
    best = max(made, key=lambda m: _units(m.scores(*joined)).sum())
    return best, out


def _units(x: np.ndarray) -> np.ndarray:
    """Scores in millionths, as sums of integers don't depend on their order."""
    return np.rint(x * 1e6).astype(np.int64)


@dataclass
class Models:
    """Automata of the credentials' formats and of other tokens (None without samples); what a format's score must exceed others' by; what capitals cost."""

    formats: list[Automaton | None]
    others: list[Automaton | None]
    gains: list[float]
    capitals: float

    def margins(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each token by how much the likeliest format beats ordinary tokens, its gain subtracted; over 0 it is a credential."""
        out = np.full(len(starts), -np.inf)
        formats, spare = [(m, g) for m, g in zip(self.formats, self.gains) if m], next((m for m in self.others if m), None)
        if not formats or spare is None or not len(starts):
            return out
        order = np.argsort(starts - ends, kind="stable")
        starts, sizes = starts[order], (ends - starts)[order]
        kinds = _ordinary_kinds(codes, starts, sizes)
        lower = _LOWER[codes]
        folded = np.add.reduceat(_CAPITAL[codes], np.stack([starts, np.minimum(starts + sizes, len(codes) - 1)], 1).ravel())[::2] > 0
        told = np.empty(len(starts))
        slow = int(np.searchsorted(-sizes, -_SLOW, "left"))
        for a, b in [*((i, i + 1) for i in range(slow)), (slow, len(starts))]:
            s, n = starts[a:b], sizes[a:b]
            best = np.max([m.scores(codes, s, n) - g for m, g in formats], axis=0) if b - a else np.zeros(0)
            usual = np.empty(b - a)
            for k in range(_OTHERS):
                mine = np.flatnonzero(kinds[a:b] == k)
                model = self.others[k] or spare
                usual[mine] = model.scores(codes, s[mine], n[mine])
                high = mine[folded[a:b][mine]]
                usual[high] = np.maximum(usual[high], model.scores(lower, s[high], n[high]) - self.capitals)
            told[a:b] = best - usual
        out[order] = told
        return out


def _ordinary_kinds(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which of the ordinary models tokens belong to: long ones (0), short ones without digits (1), or short ones with digits (2)."""
    digits = np.concatenate([[0], np.cumsum((codes > 0) & (codes <= 10))])
    return np.where(sizes >= _LONG, 0, 1 + (digits[starts + sizes] > digits[starts]))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) >> np.uint64(1)


def _labelled(batches):
    """kind and value of the different credentials and other tokens of each batch."""
    for b in batches:
        values: list[set[str]] = [set() for _ in range(_FORMATS + 1)]
        texts = b.column(0).to_pylist()
        for first, joined, at in _parts(texts):
            codes, spans = _points(joined), []
            for k, offset in enumerate(at.tolist()):
                for s, kind, e, v in known(texts[first + k]):
                    spans.append((offset + s, offset + e))
                    values[kind].add(v)
            starts, ends = _tokens(codes, sorted(spans))
            values[_FORMATS].update(joined[s:e] for s, e in zip(starts.tolist(), ends.tolist()))
        for kind, found in enumerate(values):
            found = list(found)
            codes, starts, sizes = _joined(found)
            order = np.argsort(starts, kind="stable")
            kinds = _FORMATS + _ordinary_kinds(codes, starts[order], sizes[order]) if kind == _FORMATS and found else np.full(len(found), kind)
            yield pa.record_batch([pa.array(kinds, pa.int32()), pa.array(found, pa.string())], names=["kind", "value"])


class _Samples:
    """All different samples of some kinds, wherever they are: rows of kind and value, and each kind's number of them; fit() is that of the function, for all kinds at once."""

    def __init__(self, rows: DataFrame, kinds: range):
        self.rows, self.kinds = rows.where(F.col("kind").isin(list(kinds))), kinds
        mine = self._each(_kept_out, "kind int, held boolean").groupBy("kind", "held").agg(F.count(F.lit(1)).alias("n"))
        n = {(r["kind"], r["held"]): r["n"] for r in mine.collect()}
        self.all = {k: n.get((k, False), 0) + n.get((k, True), 0) for k in kinds}
        #: Kinds whose samples are too few to hold any out.
        self.whole = {k for k in kinds if self.all[k] < 10 or (k, False) not in n or (k, True) not in n}
        self.n = {k: self.all[k] if k in self.whole else n[k, False] for k in kinds}

    def _each(self, run, schema: str) -> DataFrame:
        """run(kind, values) for each batch and kind, which yields columns."""
        names = [c.split()[0] for c in schema.split(", ")]
        types = [{"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}[c.split()[1]] for c in schema.split(", ")]

        def mapped(batches):
            for b in batches:
                kinds = b.column(0).to_numpy()
                for kind in np.unique(kinds).tolist():
                    for told in run(kind, b.column(1).filter(pa.array(kinds == kind)).to_pylist()):
                        columns = [np.full(len(told[0]), kind), *told]
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        return self.rows.select("kind", "value").mapInArrow(mapped, schema)

    def _of(self, held: bool):
        """The samples of a kind that are held out, or that aren't."""
        whole = self.whole
        return lambda kind, values: values if kind in whole else [v for v in values if _out(v) == held]

    def edges(self) -> dict[tuple[int, int], dict]:
        """The prefix trees by kind and partition, without what follows rare prefixes."""
        own, found, alive, first, last = self._of(False), defaultdict(lambda: defaultdict(dict)), None, 0, 32
        least = F.coalesce(*[F.when(F.col("kind") == k, F.lit(_rare(n))) for k, n in self.n.items()])
        while first == 0 or alive:

            def run(kind, values, alive=alive, first=first, last=last):
                joined = _joined(own(kind, values))
                for p, classes in enumerate(PARTITIONS):
                    if alive is None or (kind, p) in alive:
                        for x, k, n, e in _prefixes(*joined, _class_of(classes), first, last, alive and alive[kind, p]):
                            yield np.full(len(x), p), x.view(np.int64), k.astype(np.int32), n, e

            rows = self._each(run, "kind int, part int, prefix long, class int, n long, e long")
            rows = rows.groupBy("kind", "part", "prefix", "class").agg(F.sum("n").alias("n"), F.sum("e").alias("e"))
            rows = rows.groupBy("kind", "part", "prefix").agg(F.sum("n").alias("all"), F.collect_list(F.struct("class", "n", "e")).alias("to")).where((F.col("all") >= least) | (F.col("prefix") == 0))
            grown = defaultdict(dict)
            for kind, p, x, _, to in rows.collect():
                grown[kind, p][x] = {c: (n, e) for c, n, e in sorted(map(tuple, to))}
            ends = defaultdict(list)
            for key, own_edges in grown.items():
                found[key].update(own_edges)
                ends[key] = _ends(own_edges, found[key], _rare(self.n[key[0]]))
            alive = {key: np.array(x, np.uint64) for key, x in ends.items() if x}
            first, last = last, 4 * last
        return found

    def fit(self, alpha: float = 0.05) -> dict[int, Automaton | None]:
        edges = self.edges()
        tos = {key: _structure(self.n[key[0]], edges[key], PARTITIONS[key[1]], alpha) for key in edges}
        own, out = self._of(False), self._of(True)

        def steps(kind, values):
            joined = _joined(own(kind, values))
            for p in range(len(PARTITIONS)):
                if (kind, p) in tos:
                    n = _walked(tos[kind, p], *joined).ravel()
                    at = np.flatnonzero(n)
                    yield np.full(len(at), p), at, n[at]

        counts = {key: np.zeros(to.size, np.int64) for key, to in tos.items()}
        for kind, p, at, n in self._each(steps, "kind int, part int, step long, n long").groupBy("kind", "part", "step").agg(F.sum("n")).collect():
            counts[kind, p][at] = n
        made = {key: _automaton(to, counts[key].reshape(to.shape), PARTITIONS[key[1]]) for key, to in tos.items()}

        def scores(kind, values):
            joined = _joined(out(kind, values))
            for p in range(len(PARTITIONS)):
                if (kind, p) in made:
                    yield np.array([p]), np.array([_units(made[kind, p].scores(*joined)).sum()])

        told = {(kind, p): s for kind, p, s in self._each(scores, "kind int, part int, score long").groupBy("kind", "part").agg(F.sum("score")).collect()}
        parts = range(len(PARTITIONS))
        return {k: made[k, max(parts, key=lambda p: told[k, p])] if (k, 0) in made else None for k in self.kinds}

    def spread(self, score) -> dict[int, list[tuple[int, int]]]:
        """Of the samples held out how many have which score(kind, joined), in thousandths, by kind and in order."""
        out = self._of(True)

        def run(kind, values):
            if values := out(kind, values):
                yield np.unique(np.floor(score(kind, _joined(values)) * 1000).astype(np.int64), return_counts=True)

        found = defaultdict(list)
        for kind, x, n in self._each(run, "kind int, score long, n long").groupBy("kind", "score").agg(F.sum("n")).orderBy("kind", "score").collect():
            found[kind].append((x, n))
        return found


def _kept_out(kind: int, values: list[str]):
    yield (np.array([_out(v) for v in values], bool),)


def _ends(own: dict, edges: dict, rare: int) -> list[int]:
    """The nodes that the edges from own lead to and that as many samples go on from as are not rare, without edges so far."""
    return [c for x, to in own.items() for k, (n, e) in to.items() if n - e >= rare and (c := int(_child(x, k))) not in edges]


def _at(spread: list[tuple[int, int]], place: int) -> float:
    """The score at a place from the lowest."""
    for x, n in spread:
        place -= n
        if place < 0:
            return x / 1000
    raise IndexError(place)


def _text(docs: DataFrame, text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def learn(docs: DataFrame, text_col: str = "text", odds: float = 1000.0) -> Models:
    """Automata of the labelled credentials of each kind and of three kinds of other tokens: of 16 characters or more, shorter without digits, shorter with digits.

    Each is fitted to all different credentials or tokens in docs but a fifth, which is held out and which all thresholds are taken from; copies add nothing.
    Only what the trees' prefixes that are not rare (_rare) count reaches the driver. Other tokens that a format explains, by character, as well as nine in ten
    of its own held out are set aside: they may be credentials that nothing labels. Where that holds for over one in twenty, the format is no evidence and they stay. Kinds without
    a sample have no automaton; one with few has few states, since few samples can't be told apart.

    A format's gain is what makes a token odds times likelier a credential than not: the log of odds and of how many different other
    tokens there are for one that is labelled so, and what all but one in twenty of the other tokens held out don't exceed (some may be credentials). Capitals cost ordinary
    tokens the log of their share.
    """
    rows = saved(docs.select(_text(docs, text_col).alias("text")).mapInArrow(_labelled, "kind int, value string").distinct())
    labelled = _Samples(rows, range(_FORMATS))
    fitted = labelled.fit()
    formats = [fitted[k] for k in range(_FORMATS)]
    by_character = lambda m, joined: m.scores(*joined) / (joined[2] + 1)
    spread = labelled.spread(lambda kind, joined: by_character(formats[kind], joined))
    usual = {k: _at(own, sum(n for _, n in own) // 10) for k, own in spread.items()}

    def alike(batches):
        for b in batches:
            values = b.column(1).to_pylist()
            joined, bits = _joined(values), np.zeros(len(values), np.int32)
            for k, least in usual.items():
                bits |= (by_character(formats[k], joined) >= least).astype(np.int32) << k
            bits = bits[np.argsort(joined[1], kind="stable")]  # back in the rows' order
            yield pa.record_batch([b.column(0), b.column(1), pa.array(bits)], names=["kind", "value", "alike"])

    others = saved(rows.where(F.col("kind") >= _FORMATS).mapInArrow(alike, "kind int, value string, alike int"))
    high = F.col("value").rlike("^[A-Z]+$")
    total, some, capitals = defaultdict(int), defaultdict(int), 0
    for kind, bits, n, m in others.groupBy("kind", "alike").agg(F.count(F.lit(1)), F.sum(high.cast("long"))).collect():
        total[kind], capitals = total[kind] + n, capitals + m
        for k in range(_FORMATS):
            some[kind, k] += n * (bits >> k & 1)
    gone = {kind: sum(1 << k for k in range(_FORMATS) if 20 * some[kind, k] <= n) for kind, n in total.items()}
    stay = F.coalesce(*[F.when(F.col("kind") == kind, F.col("alike").bitwiseAND(F.lit(mask)) == 0) for kind, mask in gone.items()], F.lit(True))
    ordinary = _Samples(others.where(stay), range(_FORMATS, _FORMATS + _OTHERS))
    fitted = ordinary.fit()
    n_others = sum(total.values())
    gains = [log(odds * max(1, n_others) / max(1, labelled.all[k])) for k in range(_FORMATS)]
    models = Models(formats, [fitted[k] for k in ordinary.kinds], gains, log((n_others + 2) / (capitals + 1)))
    if any(formats) and any(models.others):
        told = ordinary.spread(lambda kind, joined: models.margins(np.concatenate([joined[0], [np.uint8(0)]]), joined[1], joined[1] + joined[2]))
        over = defaultdict(int)
        for x, n in (row for own in told.values() for row in own):
            over[x] += n
        n = sum(over.values())
        models.gains = [g + max(0.0, _at(sorted(over.items()), n - 1 - n // 20)) for g in gains]
    return models


def _scan(models: Models):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        for b in batches:
            texts, told = b.column(2).to_pylist(), []
            for first, joined, at in _parts(texts):
                own = [[{"start": s, "kind": k, "end": e, "score": None} for s, k, e, _ in known(texts[first + i])] for i in range(len(at))]
                spans = sorted((int(a) + s["start"], int(a) + s["end"]) for a, found in zip(at, own) for s in found)
                codes = np.concatenate([_points(joined), [np.uint8(0)]])
                starts, ends = _tokens(codes, spans)
                margins = models.margins(codes, starts, ends)
                for i in np.flatnonzero(margins > 0):
                    k = int(np.searchsorted(at, starts[i], "right")) - 1
                    own[k].append({"start": int(starts[i] - at[k]), "kind": _FORMATS, "end": int(ends[i] - at[k]), "score": float(margins[i])})
                told += [sorted(found, key=lambda s: (s["start"], s["kind"])) for found in own]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(told, kind)], names=["doc_id", "row", "spans"])

    return run


def find_secrets(docs: DataFrame, models: Models | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, row (a hash of the text), spans (structs of start, kind, end, score, sorted).

    start and end count code points, end exclusive; kind is a place in KINDS. What the patterns find is always a span. Other tokens
    of 6 characters or more, as many as a labelled credential has at least, are spans if the likeliest credential format is likelier than
    ordinary tokens by more than its gain; their score is what it exceeds that by. models is learn(docs) unless given; without labelled
    credentials, or without other tokens, nothing is added to the patterns.

    A null or empty text has no spans. Repeated rows all come back. Other columns are ignored; an empty table gives an
    empty result.

    Cost: two scans, one to learn and one to score; texts never move. The different tokens are shuffled once and written to the checkpoint folder, and learn() reads them a dozen times.
    """
    models = learn(docs, text_col) if models is None else models
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(_text(docs, text_col)).alias("row"), _text(docs, text_col).alias("text"))
    return rows.mapInArrow(_scan(models), "doc_id long, row long, spans array<struct<start:int,kind:int,end:int,score:double>>")


def _told(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_secrets(table(spark, sf_dir, "documents"))
    number = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < KINDS.index("format"))
    return out.select("doc_id", *[number(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(_told(base).cast("binary"), 256).alias("base_sha256"), _told(F.col("spans")).alias("spans"))
