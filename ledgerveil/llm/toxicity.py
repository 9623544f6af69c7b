"""Toxicity by a lexicon trie intersected with Levenshtein automata, and context windows.

The lexicon is learned from labelled rows: whole words, and word beginnings (stems), that occur in toxic
rows and hardly elsewhere. Every word of a text runs through one automaton that accepts all words within
the allowed edit distance of a term. What a match is worth depends on the term, its distance and whether
it stands in a quotation; these weights are learned from the same rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerveil.llm.text import map_arrow, small_batches
from ledgerveil.session import materialize

MAX_TRAIN = 20_000
MAX_TERMS = 500
CANDIDATES = 2_000
MIN_SUPPORT = 3
DEPTH = 3
STEMS = range(3, 9)
LIFT = 4  # a term is so many times as frequent in toxic rows at least
QUOTE_WINDOW = 60

_WORD = re.compile(r"[^\W\d_]+")
_QUOTES = frozenset("\"“”„«»‹›")
_REPORTED = frozenset("said says saying quote quoted quotes called wrote writes reported dit disait écrit cité sagte sagt schrieb zitiert dijo dice escribió citó".split())


def distance_allowed(term: str) -> int:
    """Edits that a misspelling of ``term`` may have."""
    n = len(term.rstrip("*"))
    return 0 if n < 5 else 1 if n < 9 else 2


class Automaton:
    """Trie of terms intersected with their Levenshtein automata, made deterministic as words ask for it.

    A term ending in ``*`` is a stem and is matched against every beginning of a word. A state is a set of
    (trie node, edits used); ``match`` returns the smallest distance of each term that accepts the word.
    """

    def __init__(self, terms: list[str], max_states: int = 200_000) -> None:
        self.child: list[dict[str, int]] = [{}]
        self.word_end: list[str | None] = [None]
        self.stem_end: list[str | None] = [None]
        self.most: list[int] = [0]
        for term in terms:
            node, k = 0, distance_allowed(term)
            self.most[0] = max(self.most[0], k)
            for c in term.rstrip("*"):
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.word_end.append(None)
                    self.stem_end.append(None)
                    self.most.append(0)
                node = self.child[node][c]
                self.most[node] = max(self.most[node], k)
            (self.stem_end if term.endswith("*") else self.word_end)[node] = term
        self.max_states = max_states
        self.reset()

    def reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.step: list[dict[str, int]] = []
        self.stems: list[tuple] = []
        self.words: list[tuple] = []
        self.start = self.state({(0, 0)})
        self.known: dict[str, tuple] = {}

    def state(self, pairs: set) -> int:
        """Close under skipped term characters and number the state; -1 is the dead state."""
        todo, best = list(pairs), {}
        while todo:
            node, e = todo.pop()
            if best.get(node, 99) <= e:
                continue
            best[node] = e
            if e < self.most[node]:
                todo += [(n, e + 1) for n in self.child[node].values() if e + 1 <= self.most[n]]
        if not best:
            return -1
        key = frozenset(best.items())
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.step.append({})
            ends = lambda at: tuple((at[n], e) for n, e in key if at[n] and e <= distance_allowed(at[n]))
            self.stems.append(ends(self.stem_end))
            self.words.append(ends(self.word_end))
        return self.ids[key]

    def move(self, state: int, c: str) -> int:
        to = set()
        for node, e in self.sets[state]:
            if c in self.child[node]:
                to.add((self.child[node][c], e))
            if e < self.most[node]:
                to.add((node, e + 1))
                to |= {(n, e + 1) for n in self.child[node].values() if e + 1 <= self.most[n]}
        out = self.step[state][c] = self.state(to)
        return out

    def match(self, word: str) -> tuple:
        """((term, distance), ...) of all terms that accept ``word``."""
        if word in self.known:
            return self.known[word]
        s, best = self.start, {}
        for c in word:
            t = self.step[s].get(c)
            s = self.move(s, c) if t is None else t
            if s < 0:
                break
            for term, e in self.stems[s]:
                best[term] = min(e, best.get(term, 99))
        if s >= 0:
            for term, e in self.words[s]:
                best[term] = min(e, best.get(term, 99))
        out = tuple(sorted(best.items()))
        if len(self.known) > self.max_states or len(self.sets) > self.max_states:
            self.reset()
        self.known[word] = out
        return out


def quoted(text: str, start: int, end: int) -> bool:
    """A match is quoted if marks open before it and close after it, or a reporting word stands just before."""
    left, right = text[max(0, start - QUOTE_WINDOW) : start], text[end : end + QUOTE_WINDOW]
    if sum(c in _QUOTES for c in left) % 2 and any(c in _QUOTES for c in right):
        return True
    return any(w in _REPORTED for w in _WORD.findall(left)[-3:])


Found = list[list[tuple[str, int, bool]]]


def matches(automaton: Automaton, text: str | None) -> tuple[Found, int]:
    """For each distinct matching word of a whole text its (term, distance, quoted), and the number of words."""
    low = (text or "").lower()
    words = _WORD.findall(low)
    hits = {w: m for w in set(words) if (m := automaton.match(w))}
    out: dict[tuple[str, bool], list] = {}
    if hits:
        for m in _WORD.finditer(low):
            if m[0] in hits:
                q = quoted(low, *m.span())
                out[m[0], q] = [(term, e, q) for term, e in hits[m[0]]]
    return list(out.values()), len(words)


@dataclass
class Model:
    """Terms, the weight of each kind of match, and the calibrated plane from evidence to log odds."""

    terms: list[str] = field(default_factory=list)
    weights: dict[tuple[str, int, bool], float] = field(default_factory=dict)
    plane: tuple[float, ...] = (1.0, 0.0, 0.0, -3.0)

    def evidence(self, found: Found, n_words: int) -> tuple[float, float, float]:
        """Sum over distinct matching words, strongest word, logarithm of the length."""
        w = [max(self.weights.get(f, 0.0) for f in word) for word in found]
        return min(30.0, sum(w)), max(w, default=0.0), math.log1p(n_words)

    def score(self, found: Found, n_words: int) -> float:
        *slopes, offset = self.plane
        z = sum(a * x for a, x in zip(slopes, self.evidence(found, n_words))) + offset
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def features(text: str) -> set[str]:
    """Distinct words and word beginnings of a text."""
    out = set()
    for w in set(_WORD.findall(text.lower())):
        out.add(w)
        out.update(w[:n] + "*" for n in STEMS if len(w) > n)
    return out


def train_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, max_train: int) -> DataFrame:
    """(text, y): at most ``max_train`` labelled rows in hash order, equal texts once."""
    lab = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.max(F.col(label)).cast("int").alias("y"))
    few = lab.orderBy(F.xxhash64("_k"), "_k").limit(max_train)  # bounded by max_train narrow rows
    rows = docs.select(F.col(key).alias("_k"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.join(F.broadcast(few), "_k").groupBy(F.md5("text").alias("h")).agg(F.first("text").alias("text"), F.max("y").alias("y")).select("text", "y")


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic",
        max_train: int = MAX_TRAIN, max_terms: int = MAX_TERMS) -> Model:
    """Learn lexicon, weights and calibration from at most ``max_train`` labelled rows.

    Rows with a null key or label are left out; several labels of one key count as the largest. Without
    toxic rows the lexicon is empty and every text gets the same low score.
    """
    train = materialize(train_rows(docs, labels, key, text, label, max_train), "toxic-train").repartition(docs.sparkSession.sparkContext.defaultParallelism)
    totals = {r.y: r.n for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    base = math.log((pos + 0.5) / (neg + 0.5))
    model = Model(plane=(1.0, 0.0, 0.0, min(base, -0.1)))
    if not pos:
        return model

    def count(batches: Iterator[dict]) -> Iterator[dict]:
        n: list[Counter] = [Counter(), Counter()]
        for b in batches:
            for t, y in zip(b["text"], b["y"]):
                n[1 if y else 0].update(features(t))
            if len(n[0]) + len(n[1]) > 500_000:
                yield rows_of(n)
                n = [Counter(), Counter()]
        yield rows_of(n)

    def rows_of(n: list[Counter]) -> dict:
        both = list(n[0].keys() | n[1].keys())
        return {"f": both, "n0": [n[0][f] for f in both], "n1": [n[1][f] for f in both]}

    share = pos / max(1, neg)
    best = (
        map_arrow(train, count, "f string, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        .where((F.col("n1") >= MIN_SUPPORT) & (F.col("n1") > LIFT * share * F.col("n0")))
        .orderBy(F.desc(F.col("n1") - LIFT * share * F.col("n0")), F.desc(F.length("f")), "f").limit(CANDIDATES).collect()
    )
    if not best:
        return model
    names, worth = [r.f for r in best], np.array([r.n1 - LIFT * share * r.n0 for r in best])
    index = {f: i for i, f in enumerate(names)}

    def present(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            yield {"fs": [sorted(index[f] for f in features(t) if f in index) for t in b["text"]]}

    rows = [r.fs for r in map_arrow(train.where("y = 1"), present, "fs array<int>").collect()]
    model.terms = cover(rows, names, worth, max_terms)
    automaton = Automaton(model.terms)

    def found(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            hits = [matches(automaton, t) for t in b["text"]]
            yield {"y": b["y"], "n": [n for _, n in hits], "hits": [[[{"t": t, "e": e, "q": q} for t, e, q in word] for word in h] for h, _ in hits]}

    seen = map_arrow(train, found, "y int, n long, hits array<array<struct<t: string, e: int, q: boolean>>>").collect()
    data = [([[(h.t, h.e, h.q) for h in word] for word in r.hits], r.n, r.y) for r in seen]
    n = [Counter(f for found, _, y in data if y == c for f in {f for word in found for f in word}) for c in (0, 1)]
    for term in model.terms:
        for e in range(distance_allowed(term) + 1):
            def odds(q: bool, prior: float) -> float:
                a, b = n[1][term, e, q], n[0][term, e, q]  # noqa: B023
                seen_odds = math.log((a + 0.25) / (pos + 0.5)) - math.log((b + 0.25) / (neg + 0.5))
                return (prior + (a + b) * seen_odds) / (1 + a + b)

            plain = model.weights[term, e, False] = min(8.0, max(0.0, odds(False, 0.0)))
            model.weights[term, e, True] = min(8.0, max(0.0, odds(True, plain / 2)))
    model.plane = calibrate(np.array([model.evidence(found, words) for found, words, _ in data]), np.array([y for *_, y in data], float), base)
    return model


def cover(rows: list[list[int]], names: list[str], worth: np.ndarray, max_terms: int) -> list[str]:
    """Terms that greedily cover each toxic row up to ``DEPTH`` times.

    Among equals the longest is taken, which is the most specific; a beginning or continuation of a taken
    term matches the same words and is left out.
    """
    has = np.zeros((len(rows), len(names)), np.int16)
    for i, fs in enumerate(rows):
        has[i, fs] = 1
    need = np.full(len(rows), DEPTH)
    cost = has.sum(0) - worth  # what clean rows take from a term's worth
    size = np.array([len(f) for f in names]) / 1000
    open_ = np.ones(len(names), bool)
    out: list[str] = []
    while len(out) < max_terms:
        gain = np.where(open_, (need > 0) @ has - cost, -1.0)
        i = int(np.argmax(gain + size))
        if gain[i] < MIN_SUPPORT:
            break
        out.append(names[i])
        stem = names[i].rstrip("*")
        open_ &= np.array([not (f.rstrip("*").startswith(stem) or stem.startswith(f.rstrip("*"))) for f in names])
        need = need - has[:, i]
    return out


def calibrate(x: np.ndarray, y: np.ndarray, offset: float, ridge: float = 1.0) -> tuple[float, ...]:
    """Ridge-held logistic plane through (evidence, label), by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    start = np.array([0.5, 0.5, 0.0, offset])
    w = start
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * np.eye(4), x.T @ (p - y) + ridge * (w - start))
        w = w - step * min(1.0, 3 / max(1e-9, float(np.abs(step).max())))
    return tuple(float(v) for v in w)


def score(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``, score, n_matches) per row; null and empty texts get the score of no match.

    Rows are scored one by one, so repeated rows are each answered and other columns play no part.
    """

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        automaton = Automaton(model.terms)
        for b in batches:
            found = [matches(automaton, t) for t in b["text"]]
            yield {"key": b["key"], "score": [model.score(*f) for f in found], "n_matches": [len(f) for f, _ in found]}

    few = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return map_arrow(few, rows, f"key {few.schema['key'].dataType.simpleString()}, score double, n_matches long").withColumnRenamed("key", key)


def reject(docs: DataFrame, model: Model, *, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``threshold``."""

    def keep(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        automaton = Automaton(model.terms)
        for b in batches:
            texts = b.column(b.schema.get_field_index(text)).to_pylist()
            yield b.filter(pa.array([model.score(*matches(automaton, t)) < threshold for t in texts], pa.bool_()))

    return small_batches(docs).mapInArrow(keep, docs.schema)
