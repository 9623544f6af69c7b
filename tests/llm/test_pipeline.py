"""Each stage of the pipeline on its own input, by brute force."""

import corpus_pipeline
from ledgerveil.llm import wumanber
from tests.llm.test_pairs import brute_components, brute_lines


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "mixing":
            assert out.columns == docs.columns
        docs = out
        seen[name] = before, {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    before, after = seen["toxicity"]
    clean = [i for i in before if labels.get(i) == 0]
    assert sum(i in after for i in clean) >= 0.98 * len(clean) and len(after) < len(before)
    before, after = seen["line dedup"]
    gone = brute_lines(before)
    want = {i: "\n".join(x for at, x in enumerate(t.split("\n")) if (i, at) not in gone) for i, t in before.items()}
    want = {i: t for i, t in want.items() if t.strip(" ") or not any(i == j for j, _ in gone)}
    assert sum(after.get(i) == t for i, t in want.items()) >= 0.98 * len(want) and set(after) >= set(want)
    before, after = seen["n-gram Jaccard join"]
    assert set(after) == {i for i, (_, c) in brute_components(before).items() if i == c}
    before, after = seen["benchmark decontamination"]
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    windows = {w for _, t in items for w in grams(t)}
    assert set(after) == {i for i, t in before.items() if not windows & set(grams(t, {len(w) for w in windows}))}
    before, after = seen["mixing"]
    assert before == after
    places = [r.mix_position for r in docs.select("mix_position").collect()]
    assert len(set(places)) == len(places)


def test_copies_with_blank_lines_go(spark):
    """Copies whose paragraphs are parted by blank lines leave no blank document; documents blank from the start stay."""
    parts = ["the first paragraph of it", "a second and other paragraph", "third words to close with"]
    rows = [(0, "\n\n".join(parts)), (1, "\n\n".join(parts)), (2, "\n \t\n\n".join(parts)), (3, "\r\n\r\n".join(parts) + "\r\n"), (4, "\r\n\r\n".join(parts) + "\r\n")]
    rows += [(5, "\n\n".join([*parts, "something of its own here"])), (6, "\n\n"), (7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "length(text) AS n_chars")
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_lines(spark, docs, "").collect()}
    assert 0 in got and not {1, 2, 4} & set(got) and {5, 6, 7, 8} <= set(got)
    assert got[0] == rows[0][1] and got[5].strip() == "something of its own here"
    assert all(t is None or t.strip() or i in (6, 8) for i, t in got.items())


def grams(text, sizes=None):
    w = wumanber.words(text)
    for n in sizes or ({min(10, len(w))} if w else ()):
        yield from (tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def test_mixing_with_columns_of_any_name(spark, docs, empty):
    """Rows stay whole whatever the columns are called; null ids are placed, an empty table gives no rows."""
    own = [c for c in docs.columns if c != "mix_slot"]
    for df in (docs, empty):
        out = corpus_pipeline.mix(spark, df.select(*df.columns), "")
        assert out.columns == [*own, "mix_slot", "mix_position"]
        assert sorted(map(str, out.select(*own).collect())) == sorted(map(str, df.select(*own).collect()))
        assert out.where("mix_slot IS NULL").count() == 0
