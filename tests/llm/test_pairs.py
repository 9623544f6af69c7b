"""N-gram join, fuzzy lines and union-find against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerveil.llm import fuzzy_lines, ngram_join
from ledgerveil.llm.components import components
from tests.llm.conftest import Union, changed, sentence, spaced


def shingle_sets(texts):
    out = {}
    for i, t in texts.items():
        w = spaced(t, lower=True)
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def brute_components(texts):
    sets = shingle_sets(texts)
    u = Union(sets)
    for a, b in combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            u.join(a, b)
    return {i: (len(s), u.find(i)) for i, s in sets.items()}


def test_join_is_exact(docs, texts):
    rows = ngram_join.join(docs).collect()
    assert len(rows) == docs.count()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id is not None}
    assert got == brute_components(texts)
    assert [r.component_id for r in rows if r.doc_id is None] == [None]


def test_join_of_dense_near_copies_and_shared_passages(spark):
    r = random.Random(5)
    texts, seed, passage = {}, sentence(r, 70), sentence(r, 60)
    for i in range(120):
        texts[i] = changed(r, seed, r.choice([0, 1, 2, 3]))
    for i in range(120, 220):
        texts[i] = f"{sentence(r, r.choice([2, 6, 10, 14, 30]))} {passage} {sentence(r, r.choice([0, 3, 8]))}"
    for i in range(220, 240):  # chains: each changes the one before
        texts[i] = changed(r, texts[i - 1] if i > 220 else sentence(r, 90), 2)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.join(df).collect()} == brute_components(texts)


def test_first_of_group_keeps_one(docs, texts):
    kept = ngram_join.first_of_group(docs)
    assert kept.columns == docs.columns
    want = {i for i, (_, c) in brute_components(texts).items() if i == c}
    assert {x.doc_id for x in kept.select("doc_id").collect()} - {None} == want


def test_empty_tables(empty):
    assert ngram_join.join(empty).count() == 0
    assert ngram_join.first_of_group(empty).count() == 0
    assert fuzzy_lines.dedup(empty).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_prefix_bound_holds(seed):
    """No similar pair shares fewer prefix tokens than ``least_met`` says (its formula, in plain Python)."""
    r = np.random.default_rng(seed)
    for _ in range(3000):
        a = set(r.choice(400, r.integers(1, 60), replace=False).tolist())
        b = {x for x in a if r.random() > 0.1} | set(r.choice(400, r.integers(0, 6)).tolist())
        if not b or 100 * len(a & b) < 75 * len(a | b):
            continue
        cut = lambda s: set(sorted(s)[: len(s) - ngram_join.least_overlap(len(s)) + 1])
        n = len(cut(a) & cut(b))
        o = -(-75 * (len(a) + len(b)) // 175)
        assert n >= max(1, o - ngram_join.least_overlap(max(len(a), len(b))) + 1)


def brute_lines(texts):
    occurrences = [(i, at, line.strip(" ")) for i, t in sorted(texts.items()) for at, line in enumerate((t or "").split("\n")) if t is not None and line.strip(" ")]
    cut = {line: {line[k : k + 8] for k in range(len(line) - 7)} or {line} for *_, line in occurrences}
    u = Union(cut)
    for a, b in combinations(cut, 2):
        if 100 * len(cut[a] & cut[b]) >= 75 * len(cut[a] | cut[b]):
            u.join(a, b)
    seen, gone = set(), set()
    for i, at, line in occurrences:
        if u.find(line) in seen:
            gone.add((i, at))
        seen.add(u.find(line))
    return gone


def test_lines(docs, texts):
    few = {i: t for i, t in texts.items() if t is None or len(t) < 100_000}
    part = docs.where(F.col("doc_id").isin(list(few)))
    got = fuzzy_lines.dedup(part)
    assert got.columns == [*(c for c in docs.columns if c != "n_removed"), "n_removed"]
    gone = brute_lines(few)
    rows = got.select("doc_id", "text", "n_removed").collect()
    assert len(rows) == part.count()
    removed = sum({r.doc_id: r.n_removed for r in rows}.values())
    assert 0.97 * len(gone) <= removed <= len(gone)  # banding may miss pairs just above the threshold
    for r in rows:
        exact = "\n".join(line for at, line in enumerate(few[r.doc_id].split("\n")) if (r.doc_id, at) not in gone) if few[r.doc_id] is not None else None
        if r.n_removed == sum(i == r.doc_id for i, _ in gone):
            assert r.text == exact


def test_long_lines_run(docs):
    rows = fuzzy_lines.dedup(docs.where(F.length("text") > 100_000)).collect()
    assert rows and all(r.n_removed == 0 for r in rows)


def test_components_of_chains_stars_and_loops(spark):
    r = random.Random(2)
    ids = [r.getrandbits(63) - (1 << 62) for _ in range(400)]
    links = [(ids[i], ids[i + 1]) for i in range(150)] + [(ids[200], ids[i]) for i in range(201, 300)] + [(ids[310], ids[310])] + [(ids[5], ids[3])] * 3
    got = {x.node: x.root for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert len({got[i] for i in ids[:151]}) == 1 and len({got[i] for i in ids[200:300]}) == 1
    assert got[ids[0]] != got[ids[200]] and ids[310] not in got


def test_columns_of_any_name_come_through(spark, docs, empty):
    from tests.llm.conftest import CLASHING

    for df in (docs, empty):
        lines, kept = fuzzy_lines.dedup(df), ngram_join.first_of_group(df)
        assert sorted(lines.columns) == sorted(df.columns) and kept.columns == df.columns
        for out, own in ((lines, [c for c in CLASHING if c != "n_removed"]), (kept, CLASHING)):
            assert all([r[c] for c in own] == [f"own {c}" for c in own] for r in out.select(*own).collect())
        assert lines.count() == df.count() and lines.schema["n_removed"].dataType.simpleString() == "bigint"
