"""Token alignment against a plain version that looks at every pair of tokens."""

import base64
import hashlib
from collections import Counter

import pytest
import sentencepiece
import tiktoken

from ledgerveil.llm import alignment
from ledgerveil.llm.queries import TOKENIZERS

LONGEST = 3000


@pytest.fixture(scope="module")
def coders():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(TOKENIZERS[0].replace(".json", ".tiktoken"), "rb"))}
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    first = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    second = sentencepiece.SentencePieceProcessor(model_file=TOKENIZERS[1])
    return first, second, {k: t for t, k in ranks.items()}


def plain(coders, text):
    """(first ids, second ids, overlaps, links, groups text) by comparing all pairs of byte ranges."""
    first, second, tokens = coders
    if not text:
        return [], [], [], [], ""
    a = first.encode_ordinary(" " + text)
    b = second.encode(text)
    pieces = []
    for k in b:
        p = second.id_to_piece(k)
        pieces.append(bytes([int(p[3:5], 16)]) if second.is_byte(k) else p.replace("▁", " ").encode())
    parts = [tokens[k] for k in a]
    want = (" " + text).encode()
    if b"".join(parts) != want or b"".join(pieces) != want:
        return [], [], [], [], ""

    def ranges(x):
        out, at = [], 0
        for t in x:
            out.append((at, at + len(t)))
            at += len(t)
        return out

    ra, rb = ranges(parts), ranges(pieces)
    overlaps = [(i, j) for i, (s, e) in enumerate(ra) for j, (u, v) in enumerate(rb) if s < v and u < e]
    links = [(i, j) for i, j in overlaps if ra[i][1] == rb[j][1]]
    shared = sorted({e for _, e in ra} & {e for _, e in rb})
    groups, at = [], 0
    for e in shared:
        groups.append(",".join(str(a[i]) for i, (s, t) in enumerate(ra) if at <= s and t <= e) + "|" + ",".join(str(b[j]) for j, (s, t) in enumerate(rb) if at <= s and t <= e))
        at = e
    return a, b, overlaps, links, ";".join(groups)


EXTRA = ["<|endoftext|> and <s> or </s>", " two  blanks ", "▁ a piece mark", "tab\tand\nline\r\n", "日本語 ünïcödé \U0001f600", "a", " ", "   ", "\x00", "don't we'll 12345 !!! ñandú"]


def test_overlaps_and_groups(spark, docs, texts, coders):
    extra = {1000 + i: t for i, t in enumerate(EXTRA)}
    rows = spark.createDataFrame(list(extra.items()), "doc_id long, text string")
    got = alignment.align(docs.select("doc_id", "text").unionByName(rows), *TOKENIZERS).collect()
    assert len(got) == docs.count() + len(extra)
    found = 0
    for r in got:
        text = (texts | extra).get(r.key)
        if r.key is None or len(text or "") > LONGEST:
            continue
        a, b, overlaps, links, _ = plain(coders, text)
        assert (r.first_ids, r.second_ids, [tuple(x) for x in r.overlaps], [tuple(x) for x in r.links]) == (a, b, overlaps, links), text
        found += bool(a)
    assert found > 30


@pytest.mark.parametrize("most", [1 << 20, 50, 0])
def test_counts(spark, docs, texts, coders, most):
    """Whole results at every number of pairs sent out, the others joined by a shuffle."""
    some = docs.where("text IS NULL OR length(text) <= 3000")
    aligned = alignment.digests(some, *TOKENIZERS)
    got = alignment.with_counts(aligned, alignment.pair_counts(aligned), most).drop("row").collect()
    rows = [r.text for r in some.collect()]
    done = {t: plain(coders, t) for t in set(rows)}
    counts = Counter()
    for t in rows:
        a, b, _, links, _ = done[t]
        counts.update((a[i], b[j]) for i, j in links)
    highest = Counter()
    for (_, j), n in counts.items():
        highest[j] = max(highest[j], n)
    want = []
    for t in rows:
        a, b, _, links, groups = done[t]
        pairs = [(a[i], b[j]) for i, j in links]
        sha = hashlib.sha256(groups.encode()).hexdigest() if a else ""
        want.append((len(a), len(b), len(links), len(links), sum(counts[p] for p in pairs), sum(counts[p] == highest[p[1]] for p in pairs), sha))
    assert sorted((r.n_first, r.n_second, r.n_groups, r.n_links, r.count_sum, r.n_best, r.groups_sha256) for r in got) == sorted(want)


def test_long_texts_whole(spark, texts):
    """Long texts give all their tokens back."""
    rows = [(i, t) for i, t in texts.items() if t and len(t) > LONGEST]
    got = alignment.align(spark.createDataFrame(rows, "doc_id long, text string"), *TOKENIZERS).collect()
    second = sentencepiece.SentencePieceProcessor(model_file=TOKENIZERS[1])
    assert {r.key: r.second_ids for r in got} == {i: second.encode(t) for i, t in rows if second.decode(second.encode(t)) == t}


def test_empty_table(spark, empty):
    aligned = alignment.digests(empty, *TOKENIZERS)
    assert alignment.with_counts(aligned, alignment.pair_counts(aligned)).collect() == []
    assert alignment.align(empty, *TOKENIZERS).collect() == []


def test_texts_without_tokens(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "a▁b")], "doc_id long, text string").coalesce(1)
    aligned = alignment.digests(rows, *TOKENIZERS)
    got = alignment.with_counts(aligned, alignment.pair_counts(aligned)).collect()
    assert sorted((r.key, r.n_first, r.n_second, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, 3)]


def test_quick_encoder_equals_the_file(texts):
    """The two encoders of one file agree on plain texts, and the others are told apart."""
    import random

    data = alignment.tokenizer_file(TOKENIZERS[0])
    ranks = alignment.ranks_of(data)
    quick, slow = alignment.ByteLevel(data, ranks), alignment.ByteLevel(data)
    assert ranks and quick.quick and not slow.quick
    r = random.Random(1)
    letters = "".join(chr(c) for c in [9, 10, 13, *range(32, 127), *range(0xA1, 0x250)])
    some = ["".join(r.choice(letters) for _ in range(200)) for _ in range(300)] + ["".join(r.choice("ab 'stremvld\n1") for _ in range(300)) for _ in range(300)]
    some += [t for t in texts.values() if t] + EXTRA + [" " * 511, "a" * 511, " " * 600, "a" * 600]
    assert quick.encode(some) == slow.encode(some)
    assert not any(quick.plain(t) for t in ("a" * 600, " " * 600, "\u65e5", "\x00", "\xa0", "\u0370"))


def test_lists_that_lower_ids_would_not_follow():
    """A token whose bytes merge to another pair first is not left to the quicker encoder."""
    import json

    at = {b: c for c, b in alignment.byte_of().items()}
    vocab = {at[b]: b for b in range(256)}
    good = {"model": {"vocab": vocab | {"ab": 256, "abc": 257}, "merges": [["a", "b"], ["ab", "c"]]}}
    bad = {"model": {"vocab": vocab | {"ab": 256, "bc": 257, "abc": 258}, "merges": ["a b", "b c", "a bc"]}}
    assert alignment.ranks_of(json.dumps(good).encode())[b"abc"] == 257
    assert alignment.ranks_of(json.dumps(bad).encode()) is None
