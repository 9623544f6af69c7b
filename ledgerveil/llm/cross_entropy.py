"""Language-model scoring by cross-entropy difference.

Two interpolated bigram models, of a target and of the background corpus, share the words of all documents. A
document's score is the mean over its tokens of the target model's loss less the background model's loss; low scores
are closest to the target. Documents are dealt into batches of bounded size. A batch asks for the counts of its distinct
word pairs and words, packed in one array for each hash bucket; buckets add up what all batches sent and answer each
batch in the order it asked in. So a word pair crosses the network once a batch, as the difference from the one before it and two small numbers.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerveil.llm.text import small_batches, spaced_words, written

MIX = 0.7
ADD = 0.5
#: Bytes of text whose words one task counts at a time, and whose pairs one bucket holds.
BATCH_BYTES = 1 << 22
BUCKET_BYTES = 1 << 23
START = -(1 << 63)  # stands before a text's first word


def keyed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit numbers of word pairs."""
    return (a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.view(np.uint64)).view(np.int64)


class Places(dict):
    """Word to its place in order of arrival; place 0 is the start mark's."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self) + 1
        return n


class Batch:
    """Texts of a batch, equal ones once, with how many rows and target rows have them."""

    def __init__(self) -> None:
        self.words, self.at, self.sequences, self.rows = Places(), {}, [], []

    def add(self, text: str, target: bool) -> int:
        """The place of the text."""
        at = self.at.setdefault(text, len(self.at))
        if at == len(self.rows):
            w = spaced_words(text)
            self.sequences.append(np.fromiter([0, *map(self.words.__getitem__, w)], np.int32, len(w) + 1))
            self.rows.append([0, 0])
        self.rows[at][0] += 1
        self.rows[at][1] += target
        return at

    def close(self) -> None:
        """Distinct words (w) and pairs (k) in order of their unsigned 64-bit numbers; of each distinct pair the places of its
        words (head, tail); of all pairs the place of the distinct one (back) and of the text (of)."""
        w = np.fromiter([START, *(xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in self.words)], np.int64, len(self.words) + 1)
        order = np.argsort(w.view(np.uint64), kind="stable")
        rank = np.empty(len(w), np.int64)
        rank[order] = np.arange(len(w))
        self.w = w[order]
        a, b = (rank[np.concatenate([s[i : len(s) - 1 + i] for s in self.sequences])] for i in (0, 1))
        k, first, self.back = np.unique(keyed(self.w[a], self.w[b]).view(np.uint64), return_index=True, return_inverse=True)
        self.k, self.head, self.tail = k.view(np.int64), a[first], b[first]
        self.of = np.repeat(np.arange(len(self.sequences)), [len(s) - 1 for s in self.sequences])


def packed(x: np.ndarray) -> bytes:
    """Whole numbers from 0, all lowest bytes first; bytes that are 0 in all numbers are left out."""
    size = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()


def unpacked(held: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if held:
        size = len(held) // n
        out[:, :size] = np.frombuffer(held, np.uint8).reshape(size, n).T
    return out.view("<u8").ravel()


def steps(keys: np.ndarray) -> np.ndarray:
    """Differences of keys in unsigned order, which take fewer bytes than the keys."""
    return np.diff(keys.view(np.uint64), prepend=np.uint64(0))


def dealt(keys: np.ndarray, buckets: int) -> list[slice]:
    """The slice of each bucket, a range of numbers, of keys in unsigned order."""
    ends = [0, *np.searchsorted(keys.view(np.uint64), np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)), len(keys)]
    return [slice(i, j) for i, j in zip(ends[:-1], ends[1:])]


def arrow(df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return small_batches(df).mapInArrow(rows, schema)


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of equal ``key``, in order of arrival; a run may come in several slices."""
    for x in batches:
        k = x.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1), len(k)]
        for i, j in zip(cuts[:-1], cuts[1:]):
            if j > i:
                yield int(k[i]), x.slice(i, j - i)


ASKED = [("batch", pa.int64()), ("bucket", pa.int32()), ("pairs", pa.int64()), ("words", pa.int64()), *((c, pa.binary()) for c in "kntwc")]
ANSWERED = [("batch", pa.int64()), ("bucket", pa.int32()), *((c, pa.binary()) for c in "ntc"), *((c, pa.int64()) for c in ("words", "tokens", "target_tokens"))]


def asked(docs: DataFrame, buckets: int) -> DataFrame:
    """A row for each batch and bucket: distinct pairs (k) with counts over texts (n) and target texts (t), distinct words (w)
    with their counts (c) as first and as second word of a pair, over texts and over target texts, one after another.

    Of a batch, target keys come first, as rows without ``text``.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, wanted = None, None, set()
        for batch, x in runs(batches, "batch"):
            if batch != now:
                if held:
                    yield counted(now, held)
                now, held, wanted = batch, Batch(), set()
            for key, text in zip(x.column("key").to_pylist(), x.column("text").to_pylist()):
                if text is None:
                    wanted.add(key)
                else:
                    held.add(text, key in wanted)
        if held:
            yield counted(now, held)

    def counted(batch: int, held: Batch) -> pa.RecordBatch:
        if not held.sequences:
            held.add("", False)
        held.close()
        counts = np.array(held.rows, np.float64)[held.of].T
        n, t = (np.bincount(held.back, y, len(held.k)).astype(np.int64) for y in counts)
        c = np.stack([np.bincount(x, y, len(held.w)).astype(np.int64) for x in (held.head, held.tail) for y in (n, t)])
        of, word_of = dealt(held.k, buckets), dealt(held.w, buckets)
        made = {"batch": [batch] * buckets, "bucket": range(buckets), "pairs": [i.stop - i.start for i in of], "words": [i.stop - i.start for i in word_of]}
        made |= {"k": [packed(steps(held.k[i])) for i in of], "n": [packed(n[i]) for i in of], "t": [packed(t[i]) for i in of]}
        made |= {"w": [packed(steps(held.w[i])) for i in word_of], "c": [packed(c[:, i].ravel()) for i in word_of]}
        return pa.RecordBatch.from_pydict(made, schema=pa.schema(ASKED))

    return arrow(docs, rows, "batch long, bucket int, pairs long, words long, k binary, n binary, t binary, w binary, c binary")


def answered(asked: DataFrame) -> DataFrame:
    """Per row of ``asked``, the sums over all batches in place of the counts; once a bucket also its number of words and of tokens."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for bucket, x in runs(batches, "bucket"):
            if bucket != now and held:
                yield summed(now, held)
                held = []
            now = bucket
            held += x.to_pylist()
        if held:
            yield summed(now, held)

    def added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Distinct keys, the sums of each row of counts, and the same again for each list of keys."""
        found, back = np.unique(np.concatenate(keys), return_inverse=True)
        sums = [np.bincount(back, x, len(found)).astype(np.int64) for x in np.concatenate(counts, axis=1)]
        ends = np.cumsum([len(x) for x in keys])[:-1]
        return found, sums, np.split(np.stack(sums)[:, back], ends, axis=1)

    def summed(bucket: int, held: list[dict]) -> pa.RecordBatch:
        k, w = ([np.cumsum(unpacked(x[c], x[size]), dtype=np.uint64) for x in held] for c, size in (("k", "pairs"), ("w", "words")))
        _, _, each = added(k, [np.stack([unpacked(x[c], x["pairs"]) for c in "nt"]) for x in held])
        words, sums, own = added(w, [unpacked(x["c"], 4 * x["words"]).reshape(4, -1) for x in held])
        once = np.zeros((3, len(held)), np.int64)
        once[:, 0] = (words != np.uint64(START + (1 << 64))).sum(), sums[2].sum(), sums[3].sum()
        made = {"batch": [x["batch"] for x in held], "bucket": [bucket] * len(held), "n": [packed(x[0]) for x in each], "t": [packed(x[1]) for x in each]}
        made |= {"c": [packed(x.ravel()) for x in own], "words": once[0], "tokens": once[1], "target_tokens": once[2]}
        return pa.RecordBatch.from_pydict(made, schema=pa.schema(ANSWERED))

    return arrow(asked, rows, "batch long, bucket int, n binary, t binary, c binary, words long, tokens long, target_tokens long")


def summed_losses(docs: DataFrame, buckets: int, size: int, totals: tuple[int, int]) -> DataFrame:
    """(key, n_tokens, near, far): losses summed over each text's pairs; of a batch, answers come first, in order of buckets."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, keys, told = None, None, [], []
        for batch, x in runs(batches, "batch"):
            if batch != now:
                if held:
                    yield scored(held, keys, told)
                now, held, keys, told = batch, Batch(), [], []
            answers = x.column("key_at").null_count
            if answers:
                few = x.slice(0, answers)
                told += zip(*(few.column(c).to_pylist() for c in "ntc"))
            x = x.slice(answers)
            keys.append((x.column("key"), [held.add(t, False) for t in x.column("text").to_pylist()]))
        if held:
            yield scored(held, keys, told)

    def scored(held: Batch, keys: list[tuple], told: list[tuple]) -> pa.RecordBatch:
        held.close()
        pair, word = np.empty((2, len(held.k))), np.empty((4, len(held.w)))
        for (n, t, c), i, j in zip(told, dealt(held.k, buckets), dealt(held.w, buckets), strict=True):
            pair[:, i] = [unpacked(x, i.stop - i.start) for x in (n, t)]
            word[:, j] = unpacked(c, 4 * (j.stop - j.start)).reshape(4, -1)
        sums = []
        for i in (1, 0):  # target, background
            uni = (word[2 + i][held.tail] + ADD) / max(totals[i] + ADD * size, ADD)
            whole = word[i][held.head]
            p = np.where(whole > 0, MIX * pair[i] / np.maximum(whole, 1) + (1 - MIX) * uni, uni)
            loss = (-np.log2(p)).astype(np.float32).astype(np.float64)
            sums.append(np.bincount(held.of, loss[held.back], len(held.sequences)))
        of = np.concatenate([np.array(i, np.int64) for _, i in keys])
        length = np.array([len(s) - 1 for s in held.sequences], np.int64)
        key = pa.concat_arrays([x for x, _ in keys])
        return pa.RecordBatch.from_arrays([key, *(pa.array(x[of]) for x in (length, *sums))], names=["key", "n_tokens", "near", "far"])

    return arrow(docs, rows, f"key {docs.schema['key'].dataType.simpleString()}, n_tokens long, near double, far double")


def losses(rows: tuple[np.ndarray, np.ndarray, np.ndarray], side: int) -> np.ndarray:
    """Matrix of -log2 p(b | a) over ``side`` tokens, the last the start mark: the formula of ``bigram_losses`` for a few tokens."""
    a, b, n = rows
    m = np.zeros((side, side), np.float32)
    m[a, b] = n
    uni = m.sum(0, dtype=np.float64) + ADD
    uni[-1] = 0  # the start mark is never predicted
    uni /= uni.sum()
    total = m.sum(1, keepdims=True, dtype=np.float64)
    p = np.where(total > 0, MIX, 0.0) * (m / np.maximum(total, 1)) + np.where(total > 0, 1 - MIX, 1.0) * uni
    return (-np.log2(np.maximum(p, 1e-300))).astype(np.float32)


def score(docs: DataFrame, targets: DataFrame, *, key: str = "doc_id", text: str = "text", hot_pairs: int | None = None, hot_words: int | None = None) -> DataFrame:
    """Per row: ``key``, n_tokens, target_loss, background_loss, ce_difference (bits per token).

    The target corpus is the rows whose key is in ``targets`` (``key``; null and repeated keys there are harmless), the
    background is all rows. Counts cover all whole texts; repeated rows count and are scored each. Texts without words have null losses. Without target rows
    the target model is uniform over what its smoothing allows, so the ranking follows the background alone. Other
    columns are ignored. All words and word pairs are in the models. ``hot_pairs`` and ``hot_words`` are accepted for
    earlier callers and change nothing: no table is sent to the tasks. Words and pairs are told apart by 64-bit hashes.
    """
    docs = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    whole = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count, buckets = (max(1, math.ceil(whole / x)) for x in (BATCH_BYTES, BUCKET_BYTES))
    docs = docs.withColumn("batch", F.pmod(F.xxhash64("key", "text"), F.lit(count)))
    marks = targets.where(F.col(key).isNotNull()).select(F.col(key).alias("key")).distinct()
    # the targets grow with the corpus, so the join is a shuffled one at every size; texts stay out of it
    wanted = docs.select("key", "batch").hint("merge").join(marks, "key").select("batch", "key", F.lit(None).cast("string").alias("text")).distinct()
    marked = wanted.unionAll(docs.select("batch", "key", "text"))
    sent = asked(marked.repartition(count, "batch").sortWithinPartitions("batch", F.col("text").isNotNull()), buckets)
    answers = written(answered(sent.repartition(buckets, "bucket").sortWithinPartitions("bucket")), "counts")
    size, *totals = (x or 0 for x in answers.agg(F.sum("words"), F.sum("tokens"), F.sum("target_tokens")).first())
    counts = ["n", "t", "c"]
    asking = docs.select("batch", "key", "text", F.lit(1).alias("key_at"), F.lit(0).alias("bucket"), *[F.lit(None).cast("binary").alias(c) for c in counts])
    kind = docs.schema["key"].dataType
    both = answers.select("batch", F.lit(None).cast(kind).alias("key"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("int").alias("key_at"), "bucket", *counts)
    met = both.unionAll(asking).repartition(count, "batch").sortWithinPartitions("batch", F.asc_nulls_first("key_at"), "bucket")
    summed = summed_losses(met, buckets, size, tuple(totals))
    near, far = (F.when(F.col("n_tokens") > 0, F.col(c) / F.col("n_tokens")) for c in ("near", "far"))
    return summed.select(F.col("key").alias(key), "n_tokens", near.alias("target_loss"), far.alias("background_loss"), (near - far).alias("ce_difference"))
