"""Exact similarity join of documents on word shingles through a token-group matrix.

1. Equal word sequences are one class; everything after works on classes.
2. Classes that share a pair of minhashes are compared to two pivots; verified ones form groups of similar documents.
3. The matrix holds (token, group): each group's token union, restricted to the prefix tokens that every similar
   pair must share. A class meets only groups other than its own, and a group is one row per token however large it is.
   How many tokens they share bounds the overlap of the query with every member; groups below the bound stay shut.
4. A qualifying group is opened in blocks: the whole token union of a block bounds the overlap again; only blocks whose
   bound reaches the threshold are compared member by member.
5. All verified links go through a distributed union-find.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerveil.llm.components import components
from ledgerveil.llm.text import bit_set, map_arrow, numbered, parted, spaced_words, with_bit, written
from ledgerveil.session import materialize

SHINGLE = 5
PERCENT = 75
KEYS = 6
BLOCK = 32
CHUNK = 256
HOT_SHARE = 16
HOT_SEEN = 2
HOT_TOKENS = 1 << 19
_WORDS_HELD = 100_000

_ODD = np.random.default_rng(7).integers(1, 1 << 63, 32, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordHashes(dict):
    """Word to 64-bit hash; forgets all when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > _WORDS_HELD:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def tokens(words: list[bytes], known: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes; fewer words than ``size`` give one shingle, no words none."""
    n = len(words)
    if not n:
        return np.empty(0, np.int64)
    w = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    size = min(size, n)
    out = np.full(n - size + 1, np.uint64(size))
    for i in range(size):
        out = (out ^ w[i : n - size + 1 + i]) * _ODD[i]
        out ^= out >> np.uint64(29)
    return np.unique(out.view(np.int64))


def enough(inter: int, union: int) -> bool:
    return 100 * inter >= PERCENT * union


def least_overlap(n: int) -> int:
    """Shingles that any similar set shares with a set of ``n``: the union has at least n."""
    return -(-PERCENT * n // 100)


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def class_id(words: list[bytes], salt: int) -> tuple[int, int]:
    d = hashlib.md5(b" ".join(words) + b"\n%d" % salt).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def hot_tokens(docs: DataFrame) -> np.ndarray:
    """Sorted shingles that are frequent in a hash share of the distinct texts (at most ``HOT_TOKENS``).

    They only go last in the order of prefix tokens. Any list gives the same links; a good one keeps passages that
    many documents share from making candidates.
    """
    part = docs.where(F.pmod(F.xxhash64("text"), F.lit(HOT_SHARE)) == 0).groupBy(F.md5("text").alias("h")).agg(F.first("text").alias("text"))

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        known = WordHashes()
        for b in batches:
            yield {"token": np.concatenate([tokens(spaced_words(t), known) for t in b["text"]])}

    seen = map_arrow(part, rows, "token long").groupBy("token").count().where(F.col("count") >= HOT_SEEN)
    top = seen.orderBy(F.desc("count"), "token").limit(HOT_TOKENS).select("token").toPandas()
    return np.sort(top["token"].to_numpy(np.int64))


def profiles(docs: DataFrame, hot: np.ndarray, salt: int) -> DataFrame:
    """Per row (id, c, c2: class, n: set size, keys: minhash pairs, prefix: tokens of which a similar set has one)."""
    shared_hot = docs.sparkSession.sparkContext.broadcast(hot)

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        known, hot = WordHashes(), shared_hot.value
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("c", "c2", "n", "keys", "prefix")}
            for t in b["text"]:
                words = spaced_words(t)
                u = tokens(words, known)
                c, c2 = class_id(words, salt)
                if len(u):
                    m = [int((u.view(np.uint64) * _ODD[8 + i]).min()) for i in range(2 * KEYS)]
                    keys = [xxhash.xxh3_64_intdigest(b"%d %d %d" % (i, m[2 * i], m[2 * i + 1])) - (1 << 63) for i in range(KEYS)]
                    if len(hot):
                        at = np.searchsorted(hot, u)
                        at[at == len(hot)] = 0
                        late = hot[at] == u
                        u = np.concatenate([u[~late], u[late]])
                    prefix = u[: len(u) - least_overlap(len(u)) + 1]
                else:
                    keys, prefix = [], u
                for k, v in zip(out, (c, c2, len(u), keys, prefix)):
                    out[k].append(v)
            yield out | {"id": b["id"]}

    kind = docs.schema["id"].dataType.simpleString()
    return map_arrow(docs.select("id", "text"), rows, f"id {kind}, c long, c2 long, n long, keys array<long>, prefix array<long>")


def texts_of(docs: DataFrame, wanted: DataFrame, salt: int) -> DataFrame:
    """(c, text) for the classes in ``wanted`` (c, id). Rows that a bit set of the ids rules out are not shuffled."""
    wanted = materialize(wanted, "join-wanted")
    bits = bit_set(wanted.select(F.xxhash64("id").alias("s")), "s")
    rows = docs.where("id IS NOT NULL").select("id", "text", F.xxhash64("id").alias("s"))
    near = with_bit(rows, "s", bits).where("_in").select("id", "text").join(wanted.hint("merge"), "id")  # what is wanted grows with the corpus

    def same(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            ok = [i for i, (c, t) in enumerate(zip(b["c"], b["text"])) if class_id(spaced_words(t), salt)[0] == c]
            yield {"c": [b["c"][i] for i in ok], "text": [b["text"][i] for i in ok]}

    return written(map_arrow(near.select("c", "text"), same, "c long, text string"), "join-texts")


def opened(pairs: DataFrame, members: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) found by opening blocks: ``pairs`` (q, block), ``members`` (block, c).

    Members of a block come first in their run and are held (at most about ``BLOCK``); the queries stream past.
    One link of a query into a block is enough, the members of a block being linked with each other already.
    """
    size = pairs.groupBy("block").agg(F.count("*").alias("_n"))
    pairs = pairs.join(size, "block").select("q", "block", F.pmod(F.xxhash64("q"), F.ceil(F.col("_n") / CHUNK)).alias("chunk"))
    pairs = materialize(pairs, "join-pairs")
    # pairs and texts grow with the corpus: shuffled joins at every size
    texts = texts.hint("merge")
    asked = pairs.join(texts.withColumnRenamed("c", "q"), "q").select("block", "chunk", F.lit(1).alias("part"), F.col("q").alias("c"), "text")
    held = pairs.select("block", "chunk").distinct().join(members, "block").join(texts, "c").select("block", "chunk", F.lit(0).alias("part"), "c", "text")
    runs = held.unionAll(asked).repartition("block", "chunk").sortWithinPartitions("block", "chunk", "part")

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        known, key, block, union = WordHashes(), None, {}, None
        for b in batches:
            links: list[tuple[int, int]] = []
            for *k, part, c, text in zip(b["block"], b["chunk"], b["part"], b["c"], b["text"]):
                if k != key:
                    key, block, union = k, {}, None
                u = tokens(spaced_words(text), known)
                if part == 0:
                    block[c] = u
                    continue
                if union is None:
                    union = np.unique(np.concatenate(list(block.values()))) if block else np.empty(0, np.int64)
                if shared(u, union) < least_overlap(len(u)):
                    continue
                for m, v in block.items():
                    if m != c and enough(min(len(u), len(v)), max(len(u), len(v))):
                        inter = shared(u, v)
                        if enough(inter, len(u) + len(v) - inter):
                            links.append((c, m))
                            break
            yield {"a": [x for x, _ in links], "b": [y for _, y in links]}

    return map_arrow(runs, rows, "a long, b long")


def least_met(n: Column, low: Column, high: Column) -> Column:
    """Prefix tokens that a set of ``n`` shares at least with a similar set of ``low`` to ``high`` tokens.

    Similar sets of a and b tokens share o = ceil(75 (a + b) / 175). Whichever prefix ends first, the common tokens
    behind it lie in that set's own rest of ceil(0.75 size) - 1. Below a the bound grows with b, above it falls, so the
    ends of the range are enough.
    """
    def bound(b: Column) -> Column:
        o = F.ceil((n + b) * PERCENT / (100 + PERCENT) - 1e-6)
        return o - F.ceil(F.greatest(n, b) * PERCENT / 100 - 1e-6) + 1

    small = F.least(F.greatest(low, F.ceil(n * PERCENT / 100 - 1e-6)), high)
    large = F.greatest(F.least(high, F.floor(n * 100 / PERCENT + 1e-6)), low)
    return F.greatest(F.lit(1), F.least(bound(small), bound(large)))


def join(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``key``, n_shingles, component_id (smallest key reachable by links, itself included).

    Null, empty and blank texts have no shingles and are linked with nothing. Rows that share a key are one document,
    linked to whatever any of its texts is linked to; rows with a null key are answered with a null component. Texts
    are used whole. Other columns are ignored. An empty table gives no rows.
    """
    docs = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    hot = hot_tokens(docs)
    for salt in count():
        base = written(profiles(docs, hot, salt), "join-profiles")
        some = base.where("n > 0 AND id IS NOT NULL").groupBy("c").agg(
            F.min("id").alias("id"), F.min("n").alias("n"), F.count("*").alias("rows"), F.min("c2").alias("x"), F.max("c2").alias("y")
        )
        classes = materialize(some, "join-classes")
        if classes.where("x <> y").isEmpty():  # no two texts share a 64-bit class
            break
    named = classes.select("c", "id")

    # groups of similar classes, around two pivots of each minhash pair: any one, which suits copies with scattered
    # edits, and the smallest set, which suits sets that share a passage and little else
    keyed = base.where("n > 0 AND id IS NOT NULL").select("c", "n", F.explode("keys").alias("key"))
    ends = keyed.groupBy("key").agg(F.min("c").alias("p"), F.max("c").alias("z"), F.min(F.struct("n", "c")).alias("s")).where("p <> z")
    pivot = ends.select("key", F.posexplode(F.array("p", "s.c")).alias("kind", "block"))
    near = keyed.join(pivot, "key").where("c <> block").groupBy(F.col("c").alias("q"), "kind", "block").agg(F.countDistinct("key").alias("k")).where("k > 1")
    pairs = near.groupBy("q", "kind").agg(F.max_by("block", F.struct("k", "block")).alias("block")).select("q", "block").distinct()
    pairs = written(pairs, "join-stars")
    ends = pairs.select(F.col("q").alias("c")).unionAll(pairs.select("block")).distinct()
    members = pairs.select("block", F.col("block").alias("c")).distinct()
    first = written(opened(pairs, members, texts_of(docs, ends.join(named, "c"), salt)), "join-links")
    roots = components(first)

    # token-group matrix on prefix tokens
    grouped = materialize(classes.select("c", "id", "n").join(roots.withColumnRenamed("node", "c"), "c", "left").select("c", "id", F.coalesce("root", "c").alias("g")), "join-groups")
    moved = roots.select(F.col("node").alias("c")).unionAll(classes.where("rows > 1").select("c"))
    told = with_bit(base.where("n > 0 AND id IS NOT NULL").select("c", "id", "n", "prefix"), "c", bit_set(moved, "c"))
    alone = told.where("NOT _in").select("c", "n", "prefix", F.col("c").alias("g"))  # one row, a group of its own
    one = told.where("_in").join(grouped, ["c", "id"]).select("c", "n", "prefix", "g").unionAll(alone)
    cells = one.select("c", "g", "n", F.explode("prefix").alias("token")).repartition("token")
    matrix = cells.groupBy("token", F.col("g").alias("h")).agg(F.min("n").alias("low"), F.max("n").alias("high"))
    close = (F.col("g") != F.col("h")) & (100 * F.col("high") >= PERCENT * F.col("n")) & (100 * F.col("n") >= PERCENT * F.col("low"))
    met = cells.join(matrix, "token").where(close).groupBy(F.col("c").alias("q"), "h").agg(
        F.count("*").alias("m"), F.first("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    met = written(met.where(F.col("m") >= least_met(F.col("n"), F.col("low"), F.col("high"))).select("q", "h"), "join-met")

    count_g = grouped.groupBy("g").agg(F.count("*").alias("_n"))
    blocks = grouped.join(count_g, "g").select("c", F.col("g").alias("h"), F.xxhash64("g", F.pmod(F.xxhash64("c"), F.ceil(F.col("_n") / BLOCK))).alias("block"))
    wanted = blocks.join(met.select("h").distinct(), "h", "left_semi")
    wanted = materialize(wanted, "join-blocks")
    pairs = met.join(wanted.select("h", "block").distinct(), "h").select("q", "block")
    ends = met.select(F.col("q").alias("c")).unionAll(wanted.select("c")).distinct()
    second = opened(pairs, wanted.select("block", "c"), texts_of(docs, ends.join(named, "c"), salt))
    roots = components(first.unionAll(second))

    # smallest key of each component; a key with several texts ties its classes together
    ids = base.where("n > 0 AND id IS NOT NULL").select("c", "id").distinct().join(roots.withColumnRenamed("node", "c"), "c", "left").select("id", F.coalesce("root", "c").alias("root"))
    ids = materialize(ids.distinct(), "join-ids")
    tied = ids.groupBy("id").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b")
    if not tied.isEmpty():
        pairs = ids.join(tied.select("id", "a"), "id").select("a", F.col("root").alias("b"))
        up = components(pairs).select(F.col("node").alias("root"), F.col("root").alias("up"))
        ids = ids.join(up, "root", "left").select("id", F.coalesce("up", "root").alias("root")).distinct()
    least = ids.groupBy("root").agg(F.min("id").alias("component_id"))
    final = materialize(ids.join(least, "root").select("id", "component_id"), "join-final")
    out = base.select("id", "n").join(final, "id", "left")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def first_of_group(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that are the smallest key of their component."""
    names = docs.columns
    docs, of = numbered(docs)
    key, text = of[key], of[text]
    lost = join(docs, key=key, text=text).where(F.col("component_id") < F.col(key)).select(key).distinct()
    lost = materialize(lost, "join-lost")
    some, others = parted(docs, F.xxhash64(key), lost.select(F.xxhash64(key).alias("h")), "h")
    return some.join(lost.hint("merge"), key, "left_anti").select(*docs.columns).unionAll(others.select(*docs.columns)).toDF(*names)
