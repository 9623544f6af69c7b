"""Inverted-file index against a full scan: equal answers with cells left shut."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerveil.operators import cells
from ledgerveil.plans.sizing import lowest_hashed

DIMENSION = 12


def rows(seed=0, groups=12, each=40):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, DIMENSION))
    out = [(int(i), (centres[i % groups] + 0.05 * r.normal(size=DIMENSION)).tolist(), int(i % 3)) for i in range(groups * each)]
    out += [(1000 + i, centres[0].tolist(), 1) for i in range(300)]  # one vector holds a third of all rows: ties by id
    out += [(2000, [0.0] * DIMENSION, 0), (2001, [0.0] * DIMENSION, 1)]
    return out, centres


def brute(docs, queries, n):
    def unit(v):
        v = np.asarray(v, float)
        return v / np.linalg.norm(v) if v.any() else v

    out = []
    for q, v in queries:
        best = sorted(((-round(float(unit(v) @ unit(w)), 9), i) for i, w, _ in docs))[:n]
        out += [(q, i, k + 1) for k, (_, i) in enumerate(best)]
    return sorted(out)


def frame(spark, docs, parts=4):
    odd = [(3000, None, 1), (3001, [1.0] * 3, 1), (3002, [], 1)]
    return spark.createDataFrame([*docs, *odd], "doc_id long, v array<double>, kind int").repartition(parts)


def asked(centres):
    r = np.random.default_rng(5)
    return [(f"q{i}", (centres[i % len(centres)] + 0.02 * r.normal(size=DIMENSION)).tolist()) for i in range(20)] + [("copy", centres[0].tolist()), ("zero", [0.0] * DIMENSION), ("far", (-centres.sum(axis=0)).tolist())]


def query_frame(spark, queries):
    return spark.createDataFrame([*queries, ("null", None), ("short", [1.0])], "query_id string, vector array<double>")


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    docs, centres = rows()
    return docs, centres, cells.build(frame(spark, docs), "doc_id", "v", cells=12, path=str(tmp_path_factory.mktemp("index")))


def pairs(hits):
    return sorted((r.query_id, r.doc_id, r["rank"]) for r in hits.collect())


def test_equal_to_full_scan_with_cells_left_shut(spark, built):
    docs, centres, index = built
    queries = asked(centres)
    hits, opened = cells.search(index, query_frame(spark, queries), "doc_id", "v", 5)
    # rounding noise may reorder equal similarities of nearly equal vectors only
    assert pairs(hits) == brute(docs, queries, 5)
    used = {r.query_id: (r.opened, r.cells) for r in opened.collect()}
    near = [used[q] for q, _ in queries if q.startswith("q")]
    assert all(o < c for o, c in near) and sum(o for o, _ in near) <= 0.6 * sum(c for _, c in near)
    assert used["zero"][0] == used["zero"][1]  # everything ties at 0: nothing may stay shut


def test_blocks_chunks_and_rounds(spark, tmp_path, monkeypatch):
    """Many blocks in the hot cell, many query chunks, one cell a round: the same answers."""
    for name, value in (("BLOCK_ROWS", 32), ("BLOCK_QUERIES", 3), ("FIRST_CELLS", 1), ("GROWTH", 1)):
        monkeypatch.setattr(cells, name, value)
    docs, centres = rows(3, 6, 20)
    index = cells.build(frame(spark, docs), "doc_id", "v", cells=6, path=str(tmp_path / "index"))
    assert max(r["blocks"] for r in index.cells.collect()) > 5
    queries = asked(centres)
    assert pairs(cells.search(index, query_frame(spark, queries), "doc_id", "v", 4)[0]) == brute(docs, queries, 4)


def test_every_document_is_indexed_once(spark, built):
    docs, _, index = built
    stored = index.rows.select("doc_id", "kind").collect()
    assert sorted((r.doc_id, r.kind) for r in stored) == sorted((i, k) for i, _, k in docs)
    assert index.cells.agg(F.sum("n")).first()[0] == len(docs)


def test_condition(spark, built):
    docs, centres, index = built
    queries = asked(centres)
    hits = cells.search(index, query_frame(spark, queries), "doc_id", "v", 3, F.col("kind") == 2)[0]
    assert pairs(hits) == brute([d for d in docs if d[2] == 2], queries, 3)


def test_append_widens_cells(spark, tmp_path):
    docs, centres = rows(1, 8, 20)
    index = cells.build(frame(spark, docs[::2]), "doc_id", "v", cells=5, path=str(tmp_path / "index"))
    r = np.random.default_rng(9)
    far = [(5000 + i, r.normal(size=DIMENSION).tolist(), 0) for i in range(30)]  # unlike anything the centroids were fitted on
    index = cells.append(index, frame(spark, docs[1::2] + far), "doc_id", "v")
    queries = asked(centres) + [("new", far[3][1])]
    assert pairs(cells.search(index, query_frame(spark, queries), "doc_id", "v", 6)[0]) == brute(docs + far, queries, 6)


def test_fewer_documents_than_asked_and_none(spark, tmp_path):
    index = cells.build(frame(spark, [(1, [1.0] * DIMENSION, 0)]), "doc_id", "v", path=str(tmp_path / "one"))
    assert pairs(cells.search(index, query_frame(spark, [("a", [1.0] * DIMENSION)]), "doc_id", "v", 5)[0]) == [("a", 1, 1)]
    same = cells.build(frame(spark, [(i, [2.0] * DIMENSION, 0) for i in range(9)]), "doc_id", "v", path=str(tmp_path / "same"))
    assert pairs(cells.search(same, query_frame(spark, [("a", [1.0] * DIMENSION)]), "doc_id", "v", 3)[0]) == [("a", 0, 1), ("a", 1, 2), ("a", 2, 3)]
    none = cells.build(frame(spark, []).where("v IS NULL"), "doc_id", "v", path=str(tmp_path / "none"))
    assert pairs(cells.search(none, query_frame(spark, [("a", [1.0] * DIMENSION)]), "doc_id", "v", 3)[0]) == []


def test_a_length_is_worked_out_once_a_vector(spark):
    """A component that worked it out anew would take 16 million steps a vector here; the fit gets a partition for each core."""
    wide = 4000
    rows = [(i, [float(i + j) for j in range(wide)]) for i in range(60)] + [(60, [0.0] * wide)]
    vectors = spark.createDataFrame(rows, "id int, w array<double>").repartition(1)
    start = time.monotonic()
    got = np.array([r["w"] for r in cells._units(vectors.select("w")).collect()])
    assert time.monotonic() - start < 20
    assert got.shape == (60, wide) and np.allclose(np.linalg.norm(got, axis=1), 1.0)


@pytest.mark.parametrize("same", [False, True])
def test_lowest_hashed_is_the_head_of_the_whole_order(spark, same):
    ids = [7 if same and i % 20 else i for i in range(3000)]
    df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(8)
    want = [r["id"] for r in df.orderBy(F.xxhash64("id"), "id").limit(50).collect()]
    assert [r["id"] for r in lowest_hashed(df, ["id"], 50, 3000).collect()] == want
