"""Small tables with nulls, empty and very long texts, ties, repeated rows and extra columns of clashing names."""

import random
import re

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_words long, h long, score double, _n long, key string, line string"
#: Names that operators use inside; a result that keeps all columns must keep their values.
CLASHING = ["_key", "_in", "_word", "_gone", "in0", "removed", "n_removed", "mix_slot"]
VOCAB = [f"{a}{b}" for a in "the of on re ti hea sho nd".split() for b in ("", "er", "ing", "ly", "tion", "an")]


def sentence(r: random.Random, n: int) -> str:
    return " ".join(r.choice(VOCAB) for _ in range(n))


def changed(r: random.Random, text: str, edits: int) -> str:
    words = text.split(" ")
    for _ in range(edits):
        words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="session")
def texts():
    """doc_id to text, of every awkward kind."""
    r = random.Random(3)
    base = [sentence(r, r.choice([3, 12, 60, 120])) for _ in range(30)]
    out = list(base)
    out += [changed(r, t, e) for t in base[:12] for e in (1, 3, 9) if len(t.split(" ")) > 9]
    out += [base[2], base[2], base[5].upper(), "", " \t\n", "one", "One", "a b c", None, None]
    out += [base[7] + "\n" + base[8] + "\n\n" + base[7], "\n".join([base[9]] * 4), " ".join(["same"] * 80), "ünï " * 60 + "\x00 \U0001f600"]
    out += [sentence(r, 30_000), "z" * 200_000, "\n".join(["tick"] * 3000)]
    return dict(enumerate(out))


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, [None, "en", "de"][i % 3], None if i % 11 == 0 else f"s{i % 4 // 2}", i, 7, 0.5, 1, "k", "l") for i, t in texts.items()]
    rows += [rows[1], rows[1], rows[40]]
    rows.append((None, texts[3], "en", "s0", 0, 0, 0.0, 0, "k", "l"))
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(f"own {c}") for c in CLASHING}).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA).withColumns({c: F.lit(f"own {c}") for c in CLASHING})


def spaced(text, lower=False):
    if lower:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


class Union:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
