"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Training is follow-the-regularised-leader (proximal) with elastic-net penalties on a bounded sample per language;
document frequencies are counted over all training rows. A temperature fitted on rows kept out of the training steps
calibrates the scores.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerveil.llm.text import map_arrow

BUCKETS = 1 << 13
ORDERS = (1, 2, 3)
PER_LANGUAGE = 400
EPOCHS = 4
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_STEP = 1 << 16


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, log counts) of the hashed character n-grams of a whole text, read in steps of fixed size."""
    n = np.zeros(BUCKETS, np.int64)
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    for start in range(0, len(codes), _STEP):
        c = codes[start : start + _STEP + max(ORDERS) - 1].astype(np.uint64)
        for order in ORDERS:
            m = min(_STEP, len(c) - order + 1)
            if m > 0:
                h = np.full(m, np.uint64(order))
                for i in range(order):
                    h = (h ^ c[i : i + m]) * np.uint64(0x9E3779B97F4A7C15)
                    h ^= h >> np.uint64(32)
                n += np.bincount((h % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
    at = np.flatnonzero(n)
    return at, np.log1p(n[at])


def named(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, at: np.ndarray, tf: np.ndarray) -> np.ndarray:
        x = tf * self.idf[at]
        return x / max(1e-12, float(np.sqrt((x * x).sum())))

    def logits(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, calibrated probability); ``und`` with 0 for a text without a letter or a model without languages."""
        if not self.languages or not named(text):
            return UNKNOWN, 0.0
        at, tf = grams(text)
        p = softmax(self.logits(at, self.vector(at, tf)) / self.temperature)
        i = int(np.argmax(p))
        return self.languages[i], float(p[i])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.002) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by per-coordinate FTRL-proximal steps on the multinomial loss; the last column is the bias."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights(at: np.ndarray) -> np.ndarray:
        zz, sparse = z[at], np.abs(z[at]) <= l1
        return np.where(sparse, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    order = np.random.default_rng(1)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x, y = rows[i]
            at, x = np.append(at, BUCKETS), np.append(x, 0.1)
            w = weights(at)
            d = softmax(x @ w)
            d[y] -= 1
            g = np.outer(x, d)
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    w = weights(np.arange(BUCKETS + 1))
    return w[:-1], w[-1] * 0.1


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """Temperature of the smallest held-out loss on a fixed grid of 0.05 to 20."""
    if not len(y):
        return 1.0
    grid = np.geomspace(0.05, 20, 121)
    loss = [-np.log(np.maximum(1e-12, softmax(logits / t)[np.arange(len(y)), y])).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Learn from rows with a language and a text with a letter.

    Document frequencies come from all of them; the regression from at most ``per_language`` texts of each language:
    the key of the smallest hash in each of as many hash slots, so no language is gathered in one task. Every fifth
    of these sets the temperature. Without usable rows the model knows no language.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.xxhash64(key, text).alias("h"), F.col(lang).alias("lang"), F.col(text).alias("text"))

    def frequencies(batches: Iterator[dict]) -> Iterator[dict]:
        seen, total = np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            for t in b["text"]:
                if named(t):
                    seen[grams(t)[0]] += 1
                    total += 1
        at = np.flatnonzero(seen)
        yield {"bucket": [-1, *at.tolist()], "n": [total, *seen[at].tolist()]}

    df = np.zeros(BUCKETS)
    total = 0
    for r in map_arrow(rows.select("text"), frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        if r.bucket < 0:
            total = r.n
        else:
            df[r.bucket] = r.n
    slots = rows.select("lang", "h", F.pmod("h", F.lit(per_language)).alias("slot")).groupBy("lang", "slot").agg(F.min("h").alias("h"))
    chosen = rows.join(F.broadcast(slots.select("lang", "h")), ["lang", "h"]).select("lang", "h", "text").dropDuplicates(["lang", "h"])

    def vectors(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            keep = [i for i, t in enumerate(b["text"]) if named(t)]
            made = [grams(b["text"][i]) for i in keep]
            yield {"lang": [b["lang"][i] for i in keep], "h": [b["h"][i] for i in keep], "at": [a for a, _ in made], "tf": [t for _, t in made]}

    sample = sorted(map_arrow(chosen, vectors, "lang string, h long, at array<int>, tf array<float>").collect(), key=lambda r: (r.lang, r.h))
    model = Model(sorted({r.lang for r in sample}), np.log((1 + total) / (1 + df)) + 1, np.zeros((BUCKETS, 0)), np.zeros(0))
    if not sample:
        return model
    ready = []
    for r in sample:
        at = np.array(r.at, np.int64)
        ready.append((at, model.vector(at, np.array(r.tf)), model.languages.index(r.lang)))
    model.weights, model.bias = ftrl([x for i, x in enumerate(ready) if i % 5], len(model.languages), EPOCHS)
    held = ready[::5]
    model.temperature = temperature(np.array([model.logits(at, x) for at, x, _ in held]), np.array([y for *_, y in held]))
    return model


def identify(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``, lang_pred, score) per row; null texts and texts without a letter are ``und`` with score 0.

    Rows are judged one by one on their text alone, so repeated rows are each answered and other columns are ignored.
    """
    few = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        m = shared.value
        for b in batches:
            made = [m.predict(t) for t in b["text"]]
            yield {"key": b["key"], "lang_pred": [p for p, _ in made], "score": [s for _, s in made]}

    return map_arrow(few, rows, f"key {few.schema['key'].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("key", key)
