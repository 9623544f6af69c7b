"""Benchmark decontamination by Wu-Manber search over words.

The alphabet is words, so a block of two words is enough: nearly every block of a document
occurs in no test string, and the search skips almost a whole window at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerveil.llm.text import LOWER, map_arrow, small_batches

WINDOW = 10
BLOCK_BYTES = 32 << 20

_WORD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in LOWER)
FINDINGS = "n_words long, n_hit long, items array<string>"


def words(text: str | None) -> list[bytes]:
    """Runs of digits, ASCII letters (lowered) and characters above \\x7F."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD).split()


class Matcher:
    """Shift and suffix tables for test strings of one length."""

    def __init__(self, length: int) -> None:
        self.length, self.block = length, min(2, length)
        self.free = length - self.block + 1  # step when a block is in no test string
        self.shift: dict[tuple, int] = {}
        self.bucket: dict[int, list[tuple[tuple, set]]] = {}
        self.strings: dict[tuple, set] = {}

    def add(self, string: tuple, item: str) -> None:
        if string in self.strings:
            self.strings[string].add(item)
            return
        items = self.strings[string] = {item}
        for end in range(self.block, self.length + 1):
            block, step = string[end - self.block : end], self.length - end
            self.shift[block] = min(step, self.shift.get(block, self.free))
        self.bucket.setdefault(hash(string[-self.block :]), []).append((string, items))

    def search(self, doc: list[bytes], hit: bytearray, found: set) -> None:
        """Mark the words of every occurrence in ``hit`` and add its items to ``found``."""
        shift, free, block, length, n = self.shift, self.free, self.block, self.length, len(doc)
        end = length
        while end <= n:
            last = tuple(doc[end - block : end])
            step = shift.get(last, free)
            if step:
                end += step
                continue
            for string, items in self.bucket.get(hash(last), ()):
                start = end - length
                if doc[start] == string[0] and tuple(doc[start:end]) == string:
                    hit[start:end] = b"\1" * length
                    found |= items
            end += 1


def tables(items: list[tuple[str, str]], window: int = WINDOW) -> list[Matcher]:
    """One matcher per string length: windows of ``window`` words, and shorter items whole."""
    by_length: dict[int, Matcher] = {}
    for item, text in items:
        w = words(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            by_length.setdefault(size, Matcher(size)).add(tuple(w[i : i + size]), item)
    return list(by_length.values())


def blocks(benchmark: DataFrame, item: str, text: str, max_bytes: int) -> list[DataFrame]:
    """The benchmark in parts of at most about ``max_bytes`` of text (a part is broadcast as search tables)."""
    total = benchmark.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = int(total // max_bytes) + 1
    return [benchmark.where(F.pmod(F.xxhash64(item), F.lit(n)) == k) for k in range(n)] if n > 1 else [benchmark]


def find(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id",
         item_text: str = "text", window: int = WINDOW, max_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document row: ``key``, n_words, n_hit (words inside an occurrence), items (sorted ids found).

    Null or empty text has no words and no hits. Items with a null id or without words are no test
    strings; repeated items count once. Repeated document rows are each answered. Other columns of
    either table are ignored. A benchmark above ``max_bytes`` is searched part by part in one stage
    each; the parts' hit masks are merged, so the result does not depend on the parts.
    """
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    benchmark = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    parts = [p.collect() for p in blocks(benchmark, "item", "text", max_bytes)]
    sc = docs.sparkSession.sparkContext
    shared = [sc.broadcast([(r.item, r.text) for r in p]) for p in parts]

    def rows(batches: Iterator[dict]) -> Iterator[dict]:
        held = [tables(b.value, window) for b in shared] if len(shared) == 1 else None
        for batch in batches:
            split = [words(t) for t in batch["text"]]
            hits, found = [bytearray(len(w)) for w in split], [set() for _ in split]
            for part in held or (tables(b.value, window) for b in shared):
                for m in part:
                    for w, h, f in zip(split, hits, found):
                        m.search(w, h, f)
            yield {"key": batch["key"], "n_words": [len(w) for w in split], "n_hit": [sum(h) for h in hits], "items": [sorted(f) for f in found]}

    kind = docs.schema["key"].dataType.simpleString()
    return map_arrow(docs, rows, f"key {kind}, {FINDINGS}").withColumnRenamed("key", key)


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def clean(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no test string.

    Rows are judged one by one in place, so repeated keys, nulls and extra columns pass through unchanged.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("item IS NOT NULL AND text IS NOT NULL")
    parts = [p.collect() for p in blocks(items, "item", "text", BLOCK_BYTES)]
    sc = docs.sparkSession.sparkContext
    shared = [sc.broadcast([(r.item, r.text) for r in p]) for p in parts]

    def keep(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        held = [tables(b.value) for b in shared] if len(shared) == 1 else None
        for batch in batches:
            split = [words(t) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            bad = [set() for _ in split]
            for part in held or (tables(b.value) for b in shared):
                for m in part:
                    for w, f in zip(split, bad):
                        m.search(w, bytearray(len(w)), f)
            yield batch.filter(pa.array([not f for f in bad]))

    return small_batches(docs).mapInArrow(keep, docs.schema)
