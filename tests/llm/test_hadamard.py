"""Vector codes against a plain version on Python integers."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from ledgerveil.llm import hadamard

SCHEMA = "vec_id long, embedding array<double>, label int, error long, n long, key string, code string"


def plain(rows, parts=8, entries=16, rounds=6):
    """{(vec_id, components): (code, error)} and the digest of the entries, by exhaustive search."""
    sound = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(sound, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dimension = len(order[0][1])
    width = -(-dimension // parts)
    cut = {}
    for i, v, _ in sound:
        if len(v) == dimension:
            whole = [math.floor(Fraction(x) * 4096) for x in v] + [0] * (parts * width - dimension)
            cut[i, tuple(v)] = [whole[p * width : (p + 1) * width] for p in range(parts)]
    alike = [(i, v) for i, v, _ in order if len(v) == dimension]
    books = [[cut[i, tuple(v)][p] for i, v in alike if i is not None][:entries] for p in range(parts)]

    def near(part, book):
        return min(((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(book)))

    for _ in range(rounds):
        for p in range(parts):
            got = {}
            for i, v in alike:
                got.setdefault(near(cut[i, tuple(v)][p], books[p])[1], []).append(cut[i, tuple(v)][p])
            books[p] = [[sum(c) // len(got[k]) for c in zip(*got[k], strict=True)] if k in got else e for k, e in enumerate(books[p])]
    out = {}
    for i, v in alike:
        found = [near(cut[i, tuple(v)][p], books[p]) for p in range(parts)]
        out[i, tuple(v)] = ("".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found))
    return out, hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


def rows_of(r, n, dimension):
    out = [(i, [r.gauss(0, 0.2) for _ in range(dimension)], r.choice([None, 1, 2, 2, 2])) for i in range(n)]
    out += [(n + j, list(out[j % 7][1]), 2) for j in range(n // 3)]  # a third of all rows are copies of seven vectors
    out += [out[3], out[3], (5, list(out[9][1]), 1)]  # repeated rows and a repeated key
    out += [(900, None, 1), (901, [None] * dimension, 1), (902, [math.nan] + [0.0] * (dimension - 1), 2), (903, [math.inf] + [0.0] * (dimension - 1), None)]
    out += [(None, [0.25] * dimension, None), (904, [-0.0] * dimension, 1), (905, [-1e-9] * dimension, 1)]
    r.shuffle(out)
    return out


def frame(spark, rows, n=4):
    return spark.createDataFrame([(i, v, lab, 7, 7, "k", "c") for i, v, lab in rows], SCHEMA).repartition(n)


@pytest.mark.parametrize(("seed", "dimension"), [(1, 64), (2, 24), (3, 20), (4, 8)])
def test_brute_force(spark, seed, dimension):
    rows = rows_of(random.Random(seed), 60, dimension)
    coded, books = hadamard.compress(frame(spark, rows))
    want, digest = plain(rows)
    vectors = {}
    for i, v, _ in rows:
        if (i, tuple(v or ())) in want:
            vectors.setdefault(i, []).append(want[i, tuple(v)])
    got = {}
    for r in coded.collect():
        got.setdefault(r.key, []).append((r.code, r.error))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in vectors.items()}
    assert hadamard.digest(books) == digest


def test_huge_components_and_other_dimensions(spark):
    r = random.Random(8)
    rows = [(i, [r.choice([1, -1]) * 10.0 ** r.randrange(0, 30) for _ in range(16)], 1) for i in range(40)]
    rows += [(50, [1.0] * 15, 1), (51, [], 2), (52, [1.7e308] * 16, 3)]
    coded, books = hadamard.compress(frame(spark, rows))
    want, digest = plain(rows)
    got = {x.key: (x.code, x.error) for x in coded.collect()}
    assert got[50] == got[51] == (None, None)
    for (i, _), (code, error) in want.items():
        assert got[i] == (code, error if error < 1 << 63 else None)
    assert hadamard.digest(books) == digest


def test_label_sums(spark):
    rows = rows_of(random.Random(5), 60, 16)
    out = hadamard.with_label_error(hadamard.compress(frame(spark, rows))[0]).collect()
    for r in out:
        assert r.label_error == sum(x.error for x in out if x.label == r.label)


def test_no_rows_and_few_rows(spark):
    assert hadamard.with_label_error(hadamard.compress(frame(spark, []))[0]).collect() == []
    assert hadamard.with_label_error(hadamard.compress(frame(spark, [(1, None, 1)]))[0]).collect() == []
    out = hadamard.with_label_error(hadamard.compress(frame(spark, [(1, [0.5] * 8, None), (None, [0.25] * 8, None)]))[0]).collect()
    assert sorted((r.code, r.label_error) for r in out) == [("00" * 8, out[0].label_error)] * 2


def test_spectrum_keeps_distances():
    x = np.random.default_rng(0).integers(-4096, 4096, (50, 2, 6))
    a = hadamard.spectrum(x)
    assert (((a[:, None] - a[None]) ** 2).sum(-1) == 8 * ((x[:, None] - x[None]) ** 2).sum(-1)).all()
    walsh = hadamard.spectrum(np.eye(8, dtype=np.int64)).T
    assert [(np.diff(row) != 0).sum() for row in walsh] == list(range(8))
