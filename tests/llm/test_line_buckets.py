"""Buckets of many lines: every two lines of a bucket that may be linked are compared."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerveil.llm import fuzzy_lines


@pytest.mark.parametrize("block", [4, 512])
def test_lines_beside_the_pivots_are_linked(spark, monkeypatch, block):
    monkeypatch.setattr(fuzzy_lines, "BLOCK", block)
    r = random.Random(5)
    texts = []
    for _ in range(30):
        line = "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(120))
        texts += [line, line[:-2] + "##"]
    lines = spark.createDataFrame([(r.getrandbits(63), t) for t in texts], "h long, line string")
    of = {row["line"]: row["h"] for row in lines.collect()}
    banded = lines.select("h", F.array(*[F.lit(b) for b in range(fuzzy_lines.BANDS)]).cast("array<bigint>").alias("keys"))
    root = {row["node"]: row["root"] for row in fuzzy_lines.similar(lines, banded).collect()}
    assert len(root) == 60
    for a, b in zip(texts[::2], texts[1::2], strict=True):
        assert root[of[a]] == root[of[b]]
    assert len(set(root.values())) == 30


def test_chain_through_a_star(spark):
    """Two stars of one bucket that only a pair beside both pivots joins become one component."""
    base = "".join(random.Random(1).choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200))
    texts = ["#" * 12 * i + base[12 * i :] for i in range(12)]  # each line replaces twelve more letters than the one before
    lines = spark.createDataFrame(list(enumerate(texts)), "h long, line string")
    banded = lines.select("h", F.array(*[F.lit(b) for b in range(fuzzy_lines.BANDS)]).cast("array<bigint>").alias("keys"))
    root = {row["node"]: row["root"] for row in fuzzy_lines.similar(lines, banded).collect()}
    cut = [{t[i : i + 8] for i in range(len(t) - 7)} for t in texts]
    plain = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(cut[i] & cut[j]) >= 75 * len(cut[i] | cut[j]):
                plain = [plain[j] if p == plain[i] else p for p in plain]
    groups = {}
    for i, p in enumerate(plain):
        groups.setdefault(p, set()).add(root.get(i, i))
    assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == len(groups)


def edited(r, line, edits):
    letters = list(line)
    for _ in range(edits):
        letters[r.randrange(len(letters))] = chr(r.randrange(0x4E00, 0x9000))
    return "".join(letters)


def similar_enough(x, y):
    x, y = ({t[i : i + 8] for i in range(len(t) - 7)} for t in (x, y))
    return 100 * len(x & y) >= 75 * len(x | y)


def test_unlike_lines_of_a_bucket_are_not_brought_together(spark, monkeypatch):
    """Copies of a line that are too far from each other: the pairs whose texts are compared do not grow with their square."""
    r = random.Random(9)
    base = edited(r, "a" * 300, 300)
    texts = [edited(r, base, 16) for _ in range(200)]
    seen = {}

    def counted(df, purpose, plain=fuzzy_lines.written):
        out = plain(df, purpose)
        seen[purpose] = out.count()
        return out

    monkeypatch.setattr(fuzzy_lines, "written", counted)
    lines = spark.createDataFrame(list(enumerate(texts)), "h long, line string")
    banded = lines.select("h", F.array(*[F.lit(b) for b in range(fuzzy_lines.BANDS)]).cast("array<bigint>").alias("keys"))
    root = {row["node"]: row["root"] for row in fuzzy_lines.similar(lines, banded).collect()}
    linked = [(i, j) for j in range(200) for i in range(j) if similar_enough(texts[i], texts[j])]
    assert all(root[i] == root[j] for i, j in linked)
    assert seen["line-others"] <= 400 + 2 * len(linked)


def test_sketches_rule_out_no_link(spark):
    r = random.Random(11)
    pairs = []
    for k in range(150):
        base = edited(r, "a" * r.choice([8, 20, 90, 400]), 400 if k % 2 else 3)
        pairs.append((2 * k, base, edited(r, base, r.randrange(1 + len(base) // 30)) + "#" * r.randrange(4)))
    lines = spark.createDataFrame([row for k, x, y in pairs for row in ((k, x), (k + 1, y))], "h long, line string")
    few = fuzzy_lines._sketched(lines, lines.select("h"), "sketches")
    met = few.alias("x").join(few.alias("y"), F.expr(f"x.h % 2 = 0 AND y.h = x.h + 1 AND {fuzzy_lines._may_link('x', 'y')}")).select("x.h").collect()
    linked = {k for k, x, y in pairs if similar_enough(x, y)}
    assert len(linked) > 30 and linked <= {row["h"] for row in met}
