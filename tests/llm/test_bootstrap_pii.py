"""Personal data: base spans against the contract's patterns, learned spans against a plain version of the graph."""

import math
import random
import re
from collections import defaultdict

import pytest
import regex

from ledgerveil.llm import bootstrap_pii as pii

CONTRACT = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BLANK = r"[\x20\x09-\x0D]+"


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(d // 10 + d % 10 for d in twice) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def plain_base(text):
    """[(kind, start, value, before, after)] of a text."""
    out = []
    for k, (kind, pattern) in enumerate(CONTRACT.items()):
        met = list(re.finditer(pattern, text))
        for i, m in enumerate(met):
            left = text[met[i - 1].end() if i else 0 : m.start()][-pii.WIDTH :]
            right = text[m.end() : met[i + 1].start() if i + 1 < len(met) else len(text)][: pii.WIDTH]
            if passes(kind, m.group()):
                out.append((k, m.start(), m.group(), left, right))
    return out


def plain_candidates(text):
    met = list(regex.finditer(r"(?<![^ \t\n\x0B\f\r])[^ \t\n\x0B\f\r0-9@]*[0-9@][^ \t\n\x0B\f\r]*(?: [(]?[0-9][0-9().,-]*(?![^ \t\n\x0B\f\r]))*", text))
    out = []
    for i, m in enumerate(met):
        left = text[met[i - 1].end() if i else 0 : m.start()][-pii.WIDTH :]
        right = text[m.end() : met[i + 1].start() if i + 1 < len(met) else len(text)][: pii.WIDTH]
        v = m.group()
        out.append((m.start() + len(v) - len(v.lstrip(pii.EDGES)), v.strip(pii.EDGES), left, right))
    return out


def plain_contexts(before, after):
    fold = lambda s: [w for w in (regex.sub(r"[^\p{L}\p{M}]+", "", x.lower()) for x in re.split(BLANK, s)) if w]
    left, right = ["", "", *fold(before)][-2:], [*fold(after), ""][0]
    return ([f"l {left[0]} {left[1]}"] if left[0] and left[1] else []) + ([f"a {left[1]} _ {right}"] if left[1] and right else [])


def fold_value(v):
    return re.sub(r"[ ()-]+", "", v).lower()


def plain(rows):
    """[(base, added)] of the texts, spans as (kind, start, finish, value)."""
    seen = []
    for n, text in enumerate(rows):
        base = plain_base(text or "")
        for k, s, v, b, a in base:
            seen.append((n, k, s, s + len(v), v, plain_contexts(b, a)))
        for s, v, b, a in plain_candidates(text or ""):
            if all(s + len(v) <= t or s >= t + len(w) for _, t, w, _, _ in base):
                seen.append((n, None, s, s + len(v), v, plain_contexts(b, a)))
    edges = {(p, fold_value(v)) for *_, v, ps in seen for p in ps}
    seeds = {(fold_value(v), k): pii.MILLION for _, k, _, _, v, _ in seen if k is not None}
    known = {x for x, _ in seeds}
    unseen = {(fold_value(v), k) for _, kind, _, _, v, _ in seen if kind is None and fold_value(v) not in known for k in range(4) if regex.search(pii.FITS[pii.KINDS[k]], v)}
    of_pattern, new = defaultdict(set), {}
    for p, x in edges:
        of_pattern[p].add(x)
    for _ in range(pii.ROUNDS):
        trusted, weights = seeds | new, defaultdict(int)
        for p, xs in of_pattern.items():
            for k in range(4):
                votes = [trusted[x, k] for x in xs if (x, k) in trusted]
                score = min(sum(votes) // len(xs), pii.HIGHEST_SCORE)
                if len(votes) >= pii.LEAST_SUPPORT and score >= pii.LEAST_SCORE:
                    for x in xs:
                        weights[x, k] += round(-pii.MILLION * math.log(1 - score / pii.MILLION))
        new = {i: math.floor(pii.MILLION * (1 - math.exp(-w / pii.MILLION))) for i, w in weights.items() if i in unseen}
        new = {i: c for i, c in new.items() if c >= pii.LEAST_CONFIDENCE}
    kind_of = {}
    for (x, k), c in new.items():
        kind_of[x] = max(kind_of.get(x, (-1, 0)), (c, -k))
    out = [([], []) for _ in rows]
    for n, k, s, e, v, _ in seen:
        if k is not None:
            out[n][0].append((k, s, e, v))
        elif fold_value(v) in kind_of and regex.search(pii.FITS[pii.KINDS[-kind_of[fold_value(v)][1]]], v):
            out[n][1].append((-kind_of[fold_value(v)][1], s, e, v))
    return [(sorted(b), sorted(a)) for b, a in out]


def card(r):
    digits = [r.randrange(10) for _ in range(15)]
    total = sum(sum(divmod(d * (2 - i % 2), 10)) for i, d in enumerate(digits))
    return "".join(map(str, [*digits, -total % 10]))


def corpus(r):
    made = {
        "phone": lambda: f"+1 ({r.randrange(100, 999)}) 555-{r.randrange(1000, 9999)}", "email": lambda: f"u{r.randrange(10**5)}@mail.example.com",
        "ip": lambda: ".".join(str(r.randrange(1, 256)) for _ in range(4)), "card": lambda: card(r),
    }
    unseen = {
        "phone": lambda: f"({r.randrange(100, 999)}) 555-{r.randrange(1000, 9999)}", "email": lambda: f"u{r.randrange(10**5)}@intranet",
        "ip": lambda: ":".join(f"{r.randrange(1, 65536):x}" for _ in range(8)), "card": lambda: "".join(str(r.randrange(10)) for _ in range(14)),
    }
    say = {"phone": "please call me on {} after noon", "email": "write mail to {} with questions", "ip": "the host answers at {} on weekdays", "card": "charged the card {} for parts"}
    words = "and then some other plain words came along with numbers like".split()
    out = []
    for i in range(120):
        parts = []
        for kind, text in say.items():
            if r.random() < 0.5:
                parts.append(text.format((unseen if r.random() < 0.2 else made)[kind]()))
        parts.append(" ".join(r.choice(words) for _ in range(12)) + f" {r.randrange(10**6)} pieces in {r.randrange(1990, 2030)}.")
        r.shuffle(parts)
        out.append("\n".join(parts) if i % 3 else ", ".join(parts))
    return out + out[:5] + [None, "", "no data"]


def spans(row):
    return [(s.kind, s.start, s.finish, s.value) for s in row]


def extracted(spark, rows, parts=6):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(rows)], "doc_id long, text string, row long, base string").repartition(parts)
    out = {r.key: (spans(r.base), spans(r.added)) for r in pii.extract(df).collect()}
    return [out[i] for i in range(len(rows))]


@pytest.mark.parametrize("seed", [1, 2])
def test_learned_identifiers(spark, seed):
    rows = corpus(random.Random(seed))
    got = extracted(spark, rows)
    assert got == plain(rows)
    added = {k: sum(s[0] == k for _, a in got for s in a) for k in range(4)}
    assert min(added.values()) > 3
    assert not any(re.fullmatch(r"[0-9]{1,6}", s[3]) for _, a in got for s in a)  # plain numbers stay out


def test_base_on_random_strings(spark):
    r = random.Random(4)
    rows = ["".join(r.choice("ab1234507 .@-+()_%,é\U0001f600\n") for _ in range(r.randrange(80))) for _ in range(400)]
    rows += ["".join(r.choice("0123456789 -") for _ in range(40)) for _ in range(200)]
    rows += ["a@b.c@d.e_x@y.z", "0001.2.3.000255 1.2.3.256 1.2.3.4.5.6.7.8", "x@y.z." * 40, f"{card(r)} {card(r)}", "+1+2+12345678", "é" * 70 + "q@w.e" + "\U0001f600" * 70 + "1.1.1.1"]
    assert [b for b, _ in extracted(spark, rows)] == [b for b, _ in plain(rows)]


def test_awkward_rows(spark, docs, texts):
    got = pii.extract(docs).collect()
    assert len(got) == docs.count()
    want = {i: b for i, (b, _) in zip(texts, plain(list(texts.values())), strict=True)}
    assert all(spans(r.base) == want[r.key] for r in got if r.key is not None)


def test_long_runs(spark):
    """Runs of 200,000 characters and thousands of spans in one text, in time that grows with the text."""
    many = " ".join(f"u{i}@m.example" for i in range(20_000))
    rows = ["a" * 200_000, "1" * 200_000, "a@b" + ".c" * 100_000, "1." * 100_000, "+1" + "(" * 200_000, "1 " * 100_000, many, "@" * 100_000, "a1" * 100_000]
    got = extracted(spark, rows, 9)
    assert [b for b, _ in got] == [sorted((k, s, s + len(v), v) for k, s, v, _, _ in plain_base(t)) if t == many or t.startswith(("a@", "1.")) else [] for t in rows]


def test_empty_table(spark, empty):
    assert pii.extract(empty).collect() == []
