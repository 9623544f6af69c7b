"""Operators that answer each row: brute force, held-out accuracy, round trips, awkward inputs."""

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerveil.llm import chat, cross_entropy, divergence, langid, pfair, toxicity, wrappers, wumanber
from ledgerveil.llm.queries import ORACLES, QUERIES
from ledgerveil.llm.text import bucket_of
from tests.llm.conftest import sentence, spaced
from tools.compare import duck, rows_of


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_twin(spark, sf, name):
    df = QUERIES[name](spark, sf)
    want = duck(sf).sql(ORACLES[name])
    assert rows_of(df.columns, df.collect()) == rows_of(want.columns, want.fetchall())


def test_ten_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_counts_and_distances(docs, texts, empty):
    rows = divergence.judge(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        t = texts[3 if r.doc_id is None else r.doc_id] or ""
        w = spaced(t)
        lines = [x for x in t.split("\n") if spaced(x)]
        n = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {j for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        want = (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w))
        assert not (r.base_failed and r.kept)
    assert divergence.judge(empty).count() == 0


def test_quality_against_labels(spark):
    rows = QUERIES["op2_divergence"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("NOT base_failed")
    n = {(r.quality, r.kept): r["count"] for r in rows.groupBy("quality", "kept").count().collect()}
    assert n[1, True] >= 0.98 * (n[1, True] + n.get((1, False), 0))
    assert n[0, False] >= 0.6 * (n[0, False] + n.get((0, True), 0))


def test_cross_entropy(spark, docs, empty):
    rows = cross_entropy.score(docs, docs.where("doc_id < 20")).collect()
    assert len(rows) == docs.count()
    assert all((r.ce_difference is None) == (r.n_tokens == 0) for r in rows)
    assert cross_entropy.score(empty, empty).count() == 0
    r = random.Random(1)
    near, far = [[" ".join(r.choice(v) for _ in range(40)) for _ in range(60)] for v in (["red", "green", "blue"], ["up", "down", "blue"])]
    df = spark.createDataFrame(list(enumerate(near + far)), "doc_id long, text string")
    got = {x.doc_id: x.ce_difference for x in cross_entropy.score(df, df.where("doc_id < 30")).collect()}
    assert max(got[i] for i in range(60)) < min(got[i] for i in range(60, 120))


def test_cross_entropy_losses_by_hand():
    import numpy as np

    m = cross_entropy.losses((np.array([0, 0, 2]), np.array([0, 1, 0]), np.array([3, 1, 2])), 3)
    uni = np.array([5.5, 1.5]) / 7
    assert np.allclose(m[0, :2], -np.log2(0.7 * np.array([0.75, 0.25]) + 0.3 * uni), atol=1e-5)
    assert np.allclose(m[1, :2], -np.log2(uni), atol=1e-5)


def test_cross_entropy_keeps_every_word(spark):
    """Against counts of all words, with all, some and none of them sent out; more words than any fixed vocabulary."""
    import math

    r = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    texts = {i: " ".join(r.choices(words[: 1500 + 1500 * (i % 2)], k=200)) for i in range(60)} | {60: "", 61: "once w1 once"}
    df = spark.createDataFrame([*texts.items(), (1, texts[1])], "doc_id long, text string")
    models = []
    for target in (True, False):
        seqs = [["<s>", *t.split()] for i, t in [*texts.items(), (1, texts[1])] if i % 2 or not target]
        pair = collections.Counter(p for s in seqs for p in zip(s, s[1:]))
        head, tail = collections.Counter(), collections.Counter()
        for (a, b), n in pair.items():
            head[a] += n
            tail[b] += n
        models.append((pair, head, tail))
    size = len(models[1][2])
    assert size > 2500

    def loss(model, text):
        pair, head, tail = model
        s, out = ["<s>", *text.split()], 0.0
        for a, b in zip(s, s[1:]):
            uni = (tail[b] + 0.5) / (sum(tail.values()) + 0.5 * size)
            out -= math.log2(0.7 * pair[a, b] / head[a] + 0.3 * uni if head[a] else uni)
        return out / (len(s) - 1)

    want = {i: [loss(m, t) for m in models] for i, t in texts.items() if t}
    targets = df.where("doc_id % 2 = 1").select("doc_id")
    for bounds in ({}, {"hot_pairs": 500, "hot_words": 100}, {"hot_pairs": 0, "hot_words": 0}):
        rows = cross_entropy.score(df, targets, **bounds).collect()
        assert len(rows) == 63
        for x in rows:
            if x.doc_id == 60:
                assert x.n_tokens == 0 and x.target_loss is x.background_loss is x.ce_difference is None
            else:
                assert [x.target_loss, x.background_loss] == pytest.approx(want[x.doc_id], abs=1e-5)


def test_language(spark, docs, empty):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = QUERIES["op6_langid"](spark, "/root/testdata/sf0.01").join(df.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)
    model = langid.fit(docs)
    rows = langid.identify(docs, model).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.lang_pred in ({"en", "de", "und"})
    assert {r.lang_pred for r in langid.identify(docs.where("text IS NULL OR text = ''"), model).collect()} == {"und"}
    assert langid.identify(docs, langid.fit(empty)).where("lang_pred <> 'und'").count() == 0


def test_language_steps_count_every_gram():
    import numpy as np

    t = sentence(random.Random(1), 300)
    whole = langid.grams(t)
    step, langid._STEP = langid._STEP, 50
    try:
        cut = langid.grams(t)
    finally:
        langid._STEP = step
    assert np.array_equal(whole[0], cut[0]) and np.allclose(whole[1], cut[1])


def test_chat_round_trip(spark):
    hard = [r"\### Assistant: </turn> ok", "", None, "a\\", "### user: x </turn>\n### ", "\\\\<", "ü\U0001f600\x00", "x" * 100_000, " </turn>\n"]
    roles = ["user", "assistant", "system", "### odd: role", "", None]
    rows = [(c, k, roles[(c + k) % len(roles)], hard[(c * k + k) % len(hard)], "clash") for c in range(20) for k in range(c % 5 + 1)]
    rows += [rows[5], (None, 0, "user", "hi", "clash"), (3, None, "user", "tie", "clash")]
    got = {r.conv_id: r for r in chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")).collect()}
    t = chat.Template()
    by = collections.defaultdict(list)
    for c, k, role, text, _ in rows:
        by[c].append((k is not None, k or 0, role or "", t.quote(text or ""), text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort(key=lambda x: (x[0], x[1], x[2], x[3]))
        loss = "".join(x[4] for x in turns if x[2] == "assistant")
        digest = hashlib.sha256("".join(f"{x[2]}\n{x[4]}\n" for x in turns).encode()).hexdigest()
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars) == (len(turns), digest, len(loss))
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_machine():
    def verdict(*roles):
        m = chat.Machine(chat.Template())
        for n, r in enumerate(roles, 1):
            m.see(r, n)
        return m.verdict()

    assert verdict("system", "user", "assistant", "user", "assistant") is None
    assert verdict("user", "assistant") is None
    assert verdict("assistant", "user").startswith("turn 1") and verdict("user", "user", "assistant").startswith("turn 2")
    assert verdict("user") == "ends with user" and verdict() == "ends with nothing"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, left = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(left[j] + 1, row[j - 1] + 1, left[j - 1] + (x != y)))
    return row[-1]


def test_automaton_is_levenshtein():
    r = random.Random(4)
    for _ in range(150):
        terms = list({"".join(r.choice("abc") for _ in range(r.choice([3, 5, 6, 9, 10]))) + r.choice(["", "*"]) for _ in range(4)})
        a = toxicity.Automaton(terms)
        for _ in range(40):
            word = "".join(r.choice("abcd") for _ in range(r.randrange(1, 13)))
            want = {}
            for t in terms:
                stem, k = t.rstrip("*"), toxicity.distance_allowed(t)
                d = min(edits(word[:n], stem) for n in range(1, len(word) + 1)) if t.endswith("*") else edits(word, stem)
                if d <= k:
                    want[t] = d
            assert dict(a.match(word)) == want, (terms, word)


def test_quotation():
    s = 'he said "idiot" to them'
    assert toxicity.quoted(s, s.index("idiot"), s.index("idiot") + 5)
    assert toxicity.quoted("they called idiot", 12, 17)
    assert not toxicity.quoted("you idiot, go", 4, 9)


def test_toxicity(spark, docs, empty):
    sf = "/root/testdata/sf0.1"
    lab = spark.read.parquet(f"{sf}/labels.parquet").where("toxic IS NOT NULL")
    got = QUERIES["op8_toxicity"](spark, sf).join(lab, "doc_id").where("held_out").collect()
    tp = sum(r.predicted == 1 and r.toxic == 1 for r in got)
    assert tp >= 0.85 * sum(r.toxic for r in got) and tp >= 0.95 * sum(r.predicted for r in got)
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"), "score")
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    none = toxicity.fit(docs, labels.where("toxic = 7"))
    assert len({r.score for r in toxicity.score(docs, none).collect()}) == 1
    assert toxicity.reject(docs, none).columns == docs.columns
    assert toxicity.score(empty, model).count() == 0


def test_toxic_misspelling_and_quotation_weights():
    model = toxicity.Model(["worthless"], {("worthless", 0, False): 6.0, ("worthless", 1, False): 4.0, ("worthless", 0, True): 2.0}, (1.0, 0.0, 0.0, -3.0))
    a = toxicity.Automaton(model.terms)
    plain, wrong, quote, clean = (model.score(*toxicity.matches(a, t)) for t in ("you worthless thing", "you worthles thing", 'they wrote "worthless" there', "you there"))
    assert plain > wrong > 0.5 > quote > clean


def test_wumanber(spark, docs, texts, empty):
    w = wumanber.words(texts[2])
    items = [("a", texts[4]), ("b", " ".join(spaced(texts[20])[:14])), ("c", "One"), ("d", ""), ("e", None), (None, texts[6]), ("a", texts[4]), ("f", "no such words at all in here " * 3)]
    bench = spark.createDataFrame([(*x, "clash", 1) for x in items], "item_id string, text string, doc_id string, n_hit long")
    got = wumanber.find(docs, bench).collect()
    assert len(got) == docs.count() and w
    parts = wumanber.find(docs, bench, max_bytes=200).collect()
    assert sorted(map(str, got)) == sorted(map(str, parts))
    for r in got:
        d = wumanber.words(texts[3 if r.doc_id is None else r.doc_id])
        hit, found = set(), set()
        for item, text in items:
            b = wumanber.words(text)
            size = min(10, len(b))
            if item is None or not size or len(d) > 20_000:
                continue
            windows = {tuple(b[i : i + size]) for i in range(len(b) - size + 1)}
            for p in range(len(d) - size + 1):
                if tuple(d[p : p + size]) in windows:
                    hit |= set(range(p, p + size))
                    found.add(item)
        if len(d) <= 20_000:
            assert (r.n_words, r.n_hit, r["items"]) == (len(d), len(hit), sorted(found))
    clean = wumanber.clean(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(r.n_hit == 0 for r in got)
    assert wumanber.find(empty, bench).count() == 0
    assert wumanber.find(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_pfair_deviation():
    r = random.Random(1)
    for _ in range(60):
        weights = {str(i): r.random() + 0.01 for i in range(r.randint(1, 9))}
        units = pfair.shares(weights, 120)
        seen = dict.fromkeys(units, 0)
        for t, (s, k) in enumerate(pfair.period(units), 1):
            seen[s] += 1
            assert seen[s] == k and all(abs(seen[x] - units[x] * t / 120) < 1 for x in units)


def test_mix(docs, empty):
    out = pfair.mix(docs, {"s0": 3.0, "s1": 1.0}, block_rows=2, resolution=8)
    rows = out.collect()
    assert len(rows) == docs.count()
    assert sorted((str(r.doc_id), str(r.source)) for r in rows) == sorted((str(r.doc_id), str(r.source)) for r in docs.select("doc_id", "source").collect())
    assert len({r.position for r in rows}) == len(rows)
    slots = {}
    for r in rows:
        assert slots.setdefault(r.slot, (r.source, r.block)) == (r.source, r.block)
    assert sorted(slots) == list(range(len(slots)))
    # the source without a target comes last
    assert min(r.slot for r in rows if r.source is None) > max(r.slot for r in rows if r.source is not None)
    # while both run, each is within one block of its target
    seen = collections.Counter()
    both = min(max(s for s, (src, _) in slots.items() if src == x) for x in ("s0", "s1"))
    for t in range(both // 8 * 8):
        seen[slots[t][0]] += 1
        assert abs(seen["s0"] - 0.75 * (t + 1)) < 1 and abs(seen["s1"] - 0.25 * (t + 1)) < 1
    assert pfair.mix(empty).count() == 0 and pfair.tempered(empty) == {}


def test_mix_follows_real_weights(spark):
    """Within one block of the real weights at every slot until a source ends, however the slots are cut."""
    import numpy as np

    r = random.Random(2)
    cases = [([1.0] * 3, [3000] * 3), ([1.0] * 7, [300] * 7), ([0.2] * 40 + [30.0], [20] * 40 + [2500]), ([r.random() + 0.001 for _ in range(60)], [r.randint(1, 90) for _ in range(60)])]
    for weights, blocks in cases:
        names = [f"{i:04}" for i in range(len(blocks))]
        fluid = pfair.Fluid(np.array(blocks), np.array(weights))
        for size in (1, 1 << 20):
            rows = pfair.slots(spark.range(0), names, fluid, 0, size).collect()
            slots = sorted((x.slot, x.source, x.block) for x in rows)
            assert [s for s, _, _ in slots] == list(range(sum(blocks)))
            assert size == 1 or slots == before
            before = slots
        seen, share = np.zeros(len(blocks), int), np.array(weights) / sum(weights)
        ends = int(min(b / w for b, w in zip(blocks, share)))
        for t, s, k in slots:
            assert k == seen[int(s)]
            seen[int(s)] += 1
            assert t >= ends or (abs(seen - share * (t + 1)) < 1 + 1e-6).all()
            i = np.searchsorted(fluid.slots, t + 1)
            time = (t + 1 - fluid.done[i]) / fluid.rate[i] if t + 1 < fluid.total else np.inf
            assert (abs(seen - np.minimum(blocks, fluid.weights * time)) < 1 + 1e-6).all()


def test_mix_of_many_sources(spark):
    df = spark.range(2400).selectExpr("id AS doc_id", "CAST(id % 1200 AS string) AS source")
    rows = pfair.mix(df, {str(i): 1.0 + i % 2 for i in range(1200)}, block_rows=1).collect()
    assert len({x.position for x in rows}) == 2400 and max(x.slot for x in rows) == 2399
    half = [int(x.source) % 2 for x in rows if x.slot < 1200]
    assert sum(half) > 0.6 * len(half)  # 2/3 by weight


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body class=home><nav><ul><li><a href=/a>A{0}</a></ul></nav>
<!-- note --><div class="ad">Buy {0}</div><div id="cookie-notice">We use cookies</div><{1}><h1>Head &amp; {0}</h1><p><b>First   line {0}<br><p>Second&nbsp;&lt;{0}&gt;</p><p>Read us daily</p>
<ul><li>one<li>two {0}</ul><form><p>mail</p></form><div class="comments"><p>nice {0}</p></div></{1}><aside>more {0}</aside><footer>&copy; {0}"""


def test_extraction():
    pages = [PAGE.format(f"n{i}", "article") for i in range(8)]
    want = "Head & n1\nFirst line n1\nSecond <n1>\nRead us daily\none\ntwo n1"
    assert wrappers.extract(pages[1]) == want
    template = frozenset(wrappers.induce(pages))
    assert wrappers.extract(pages[1], template) == want.replace("Read us daily\n", "").replace("one\n", "")
    assert wrappers.extract(PAGE.format("n1", "div")) == want
    assert wrappers.induce([pages[0]] * 10) == [] and wrappers.induce(pages[:2]) == []
    for broken in ("", "<", "<p", "</div></p>x", "<a<b>y", "<![CDATA[z", "<!--", "text only &amp", None):
        assert isinstance(wrappers.extract(broken), str)


def test_tree_matching():
    a, b = wrappers.parse("<div><p>1</p><ul><li>x</li></ul><p>2</p></div>"), wrappers.parse("<div><ul><li>y</li></ul><p>2</p><hr></div>")
    size, pairs = wrappers.match(a, b)
    assert size == len(pairs) == 5  # root, div, ul, li, p


def test_pages(spark):
    rows = [(i, f"http://h{i % 2}.org/{i}", PAGE.format(f"n{i}", "article"), "x", 1) for i in range(12)]
    rows += [(90, None, None, "x", 1), (91, "no url", "", "x", 1), (None, "HTTP://H0.org", PAGE.format("n7", "article"), "x", 1), rows[0], (92, "http://h1.org/", "<p>" + "w " * 200_000, "x", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, host long")
    got = wrappers.texts(df).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got}
    assert by[90] == by[91] == "" and len(by[92]) == 399_999 and "Read us" not in by[5] and "First line n5" in by[5]
    assert wrappers.texts(df.limit(0)).count() == 0


def test_bucket(spark):
    import zlib

    df = spark.createDataFrame([(i,) for i in (0, 1, 20, 12345, None)], "doc_id long")
    for r in df.select("doc_id", bucket_of("doc_id", 4).alias("b")).collect():
        assert r.b == (0 if r.doc_id is None else zlib.crc32(str(r.doc_id).encode()) % 4)


def test_pattern_needs_no_table_row():
    assert re.search("op9", " ".join(QUERIES))


def test_cross_entropy_in_many_batches(spark, monkeypatch):
    """Counts packed by batch and bucket: the same losses for any cut, and fewer rows are shuffled than there are word pairs."""
    r = random.Random(9)
    texts = [" ".join(r.choice(("the", "of", f"w{r.randrange(5000)}")) for _ in range(r.randrange(120))) for _ in range(300)]
    df = spark.createDataFrame([*enumerate(texts), (0, texts[0]), (None, texts[1]), (300, None)], "doc_id long, text string")
    got = []
    for batch, bucket in ((1 << 24, 1 << 24), (4000, 9000), (30_000, 700)):
        monkeypatch.setattr(cross_entropy, "BATCH_BYTES", batch)
        monkeypatch.setattr(cross_entropy, "BUCKET_BYTES", bucket)
        rows = cross_entropy.score(df, df.where("doc_id % 3 = 0")).collect()
        assert len(rows) == 303
        got.append(sorted([(-1 if x.doc_id is None else x.doc_id, x.n_tokens, round(x.target_loss or 0, 9), round(x.background_loss or 0, 9)) for x in rows]))
    assert got[0] == got[1] == got[2]
    docs = df.selectExpr("doc_id AS key", "text", "pmod(doc_id, 7) AS batch").where("text IS NOT NULL AND batch IS NOT NULL")
    sent = cross_entropy.asked(docs.repartition(3, "batch").sortWithinPartitions("batch"), 5)
    assert sent.count() == 7 * 5 and sent.agg({"pairs": "sum"}).first()[0] > 200 * 35
