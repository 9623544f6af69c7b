"""Alignment of two tokenizers' tokens over the same text.

Both tokenizers encode a blank plus the text; tokens are laid out by their bytes. ``pandas.merge_asof``, keyed by
document, gives for each token's start the other side's covering token; the union of both directions is the overlaps.
Where both tokens of an overlap end at the same byte they are linked and a group of tokens on both sides closes.

A text that is null or empty, or that a tokenizer does not give back byte for byte, has no tokens. Special tokens'
strings in a text are plain text. Texts are whole; a task lays out at most SLICE_BYTES of texts, or one longer text, at
a time. Repeated rows and rows of one key, null included, count each for themselves. The tokenizer files are read once
on the driver (their size is checked) and sent to the tasks; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerveil.session import materialize

SLICE_BYTES = 1 << 20
MOST_FILE_BYTES = 64 << 20
#: At most so many id pairs are sent to the tasks with their counts, 17 bytes each; the others are joined by a shuffle.
HOT_PAIRS = 1 << 20
SECOND_BITS = 32


# Fixed value: how byte-level BPE cuts a text before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of these characters only, whose classes all versions of Unicode agree on, and without longer runs, go to the quicker encoder.
PLAIN = re.compile("[\t\n\r -~\u00a1-\u024f]*")
LONGEST_RUN = 512
BLANK_RUN = re.compile(rf"\s{{{LONGEST_RUN}}}")


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}


def ranks_of(data: bytes) -> dict[bytes, int] | None:
    """Token bytes to ids of a byte-level BPE file, if merging by the lowest id gives the same tokens as its list of merges; else None.

    It does if ids follow the list, and each merged token, built from its bytes by lower ids alone, ends in the very pair
    that the list names: then no other pair of neighbours can ever form it.
    """
    model = json.loads(data)["model"]
    at = byte_of()
    ranks = {bytes(at[c] for c in t): k for t, k in model["vocab"].items() if all(c in at for c in t)}
    if sorted(k for t, k in ranks.items() if len(t) == 1) != list(range(256)):
        return None
    for i, merge in enumerate(model["merges"]):
        pair = [bytes(at[c] for c in t) for t in (merge.split(" ") if isinstance(merge, str) else merge)]
        if ranks.get(pair[0] + pair[1]) != 256 + i:
            return None
        parts = [bytes([x]) for x in pair[0] + pair[1]]
        while len(parts) > 2:
            k = min(range(len(parts) - 1), key=lambda j: (ranks.get(parts[j] + parts[j + 1], 1 << 30), j))
            if ranks.get(parts[k] + parts[k + 1], 1 << 30) >= 256 + i:
                return None
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        if parts != pair:
            return None
    return {t: k for t, k in ranks.items() if k < 256 + len(model["merges"])}


class ByteLevel:
    """A byte-level BPE file of the ``tokenizers`` library; plain texts are encoded by ``tiktoken`` from the same file where ``ranks_of`` shows that to be equal."""

    def __init__(self, data: bytes, ranks: dict[bytes, int] | None = None) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_buffer(data)
        self.coder.encode_special_tokens = True
        self.quick = tiktoken.Encoding("file", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}) if ranks else None
        at = byte_of()
        self.tokens = [b""] * self.coder.get_vocab_size(with_added_tokens=True)
        for token, k in self.coder.get_vocab(with_added_tokens=True).items():
            self.tokens[k] = bytes(at[c] for c in token) if all(c in at for c in token) else token.encode()

    def plain(self, text: str) -> bool:
        return self.quick is not None and PLAIN.fullmatch(text) is not None and max(map(len, text.split()), default=0) < LONGEST_RUN and not BLANK_RUN.search(text)

    def encode(self, texts: list[str]) -> list[list[int]]:
        plain = [self.plain(t) for t in texts]
        rest = iter(self.coder.encode_batch_fast([" " + t for t, p in zip(texts, plain, strict=True) if not p], add_special_tokens=False))
        return [self.quick.encode_ordinary(" " + t) if p else next(rest).ids for t, p in zip(texts, plain, strict=True)]


class Pieces:
    """A sentencepiece model, which puts the blank before the text itself."""

    def __init__(self, data: bytes, ranks: None = None) -> None:
        import sentencepiece

        self.coder = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.tokens = []
        for k in range(self.coder.get_piece_size()):
            piece = self.coder.id_to_piece(k)
            self.tokens.append(bytes([int(piece[3:5], 16)]) if self.coder.is_byte(k) else piece.replace("▁", " ").encode())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.coder.encode(texts, num_threads=1)


class Side:
    """One tokenizer in a task: ids, token bytes, their lengths and the decimal ids with what may follow them."""

    made: dict = {}

    def __init__(self, kind: type, data: bytes, ranks: dict[bytes, int] | None = None) -> None:
        coder = kind(data, ranks)
        self.encode, self.parts = coder.encode, coder.tokens
        self.lengths = np.array([len(t) for t in self.parts], dtype=np.int64)
        self.names = {end: np.array([f"{k}{end}" for k in range(len(self.parts))], dtype=object) for end in ",|;"}

    @classmethod
    def of(cls, kind: type, data: bytes, ranks: dict[bytes, int] | None = None) -> Side:
        """Made once in a Python worker."""
        key = kind.__name__, hashlib.sha256(data).digest(), ranks is None
        if key not in cls.made:
            cls.made[key] = cls(kind, data, ranks)
        return cls.made[key]


@dataclass
class Laid:
    """Tokens of both sides of some documents, one after the other, and what links them.

    ids, doc and end are pairs of arrays, one a side; ``overlaps`` are pairs of token places, sorted; ``links`` those that end together.
    """

    ids: tuple[np.ndarray, np.ndarray]
    doc: tuple[np.ndarray, np.ndarray]
    end: tuple[np.ndarray, np.ndarray]
    overlaps: tuple[np.ndarray, np.ndarray]
    links: tuple[np.ndarray, np.ndarray]


def layout(first: Side, second: Side, texts: list[str | None]) -> Laid:
    """Align the tokens of some texts; one without tokens on both sides has no rows."""
    some = [i for i, t in enumerate(texts) if t]
    plain = [texts[i] for i in some]
    ids, doc = ([], []), ([], [])
    for i, text, *coded in zip(some, plain, first.encode(plain), second.encode(plain), strict=True):
        want = b" " + text.encode()
        if all(b"".join([side.parts[k] for k in c]) == want for side, c in zip((first, second), coded, strict=True)):
            for k in (0, 1):
                ids[k].extend(coded[k])
                doc[k].append((i, len(coded[k])))
    ids = tuple(np.array(x, dtype=np.int64) for x in ids)
    doc = tuple(np.repeat(*(np.array(y, dtype=np.int64) for y in ([i for i, _ in x], [n for _, n in x]))) for x in doc)
    length = tuple(side.lengths[x] for side, x in zip((first, second), ids, strict=True))
    end = tuple(np.cumsum(x) for x in length)
    rows = [pd.DataFrame({"at": end[k] - length[k], "doc": doc[k], "token": np.arange(len(ids[k]))}) for k in (0, 1)]
    there = pd.merge_asof(rows[0], rows[1], on="at", by="doc", suffixes=("", "_other"))
    back = pd.merge_asof(rows[1], rows[0], on="at", by="doc", suffixes=("", "_other"))
    pairs = np.concatenate([np.stack([there["token"], there["token_other"]]), np.stack([back["token_other"], back["token"]])], axis=1).astype(np.int64)
    # both columns rise together, so that the union sorted by one place after the other is sorted by their sum
    pairs = pairs[:, np.argsort(pairs.sum(axis=0), kind="stable")]
    fresh = np.ones(pairs.shape[1], dtype=bool)
    fresh[1:] = (pairs[:, 1:] != pairs[:, :-1]).any(axis=0)
    a, b = pairs[:, fresh]
    together = end[0][a] == end[1][b]
    return Laid(ids, doc, end, (a, b), (a[together], b[together]))


def group_texts(first: Side, second: Side, laid: Laid) -> np.ndarray:
    """Pieces ``id`` + ``,``, ``|`` or ``;`` of all documents in their order: a group's first ids, then its second ones."""
    (ids_a, ids_b), (link_a, link_b) = laid.ids, laid.links
    out = np.empty(len(ids_a) + len(ids_b), dtype=object)
    group_a, group_b = np.searchsorted(link_a, np.arange(len(ids_a))), np.searchsorted(link_b, np.arange(len(ids_b)))
    text_a, text_b = first.names[","][ids_a], second.names[","][ids_b]
    text_a[link_a], text_b[link_b] = first.names["|"][ids_a[link_a]], second.names[";"][ids_b[link_b]]
    before_b = np.concatenate([[0], link_b + 1])
    out[np.arange(len(ids_a)) + before_b[group_a]] = text_a
    out[np.arange(len(ids_b)) + link_a[group_b] + 1] = text_b
    return out


def slices(texts: list[str | None]) -> Iterator[range]:
    """Ranges of rows of at most SLICE_BYTES characters, or of one row."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t or "") > SLICE_BYTES:
            yield range(start, i)
            start, size = i, 0
        size += len(t or "")
    if start < len(texts):
        yield range(start, len(texts))


def tokenizer_file(path: str) -> bytes:
    if os.path.getsize(path) > MOST_FILE_BYTES:
        raise ValueError(f"{path}: over {MOST_FILE_BYTES} bytes")
    with open(path, "rb") as f:
        return f.read()


def sides(docs: DataFrame, first: str, second: str) -> object:
    """A function that gives both sides in a task; the files travel as one broadcast."""
    data = tokenizer_file(first)
    sent = docs.sparkSession.sparkContext.broadcast((data, tokenizer_file(second), ranks_of(data)))
    return lambda: (Side.of(ByteLevel, sent.value[0], sent.value[2]), Side.of(Pieces, sent.value[1]))


def bounds(doc: np.ndarray, n: int) -> np.ndarray:
    """Places in the sorted ``doc`` where each of ``n`` documents starts, and the end."""
    return np.searchsorted(doc, np.arange(n + 1))


def align(docs: DataFrame, first: str, second: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, first_ids, second_ids, overlaps, links): token ids of both sides and pairs of token places, counted from 0 in a document.

    ``links`` are the overlaps whose tokens end together; each closes a group.
    """
    both = sides(docs, first, second)
    kind = docs.schema[key].dataType.simpleString()
    pair = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = both()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in slices(texts):
                laid = layout(a, b, texts[part.start : part.stop])
                at = [bounds(d, len(part)) for d in laid.doc]
                out = [[ids[s:e] for s, e in zip(x, x[1:])] for ids, x in zip(laid.ids, at, strict=True)]
                for x, y in (laid.overlaps, laid.links):
                    cuts = bounds(laid.doc[0][x], len(part))
                    out.append([[{"a": i, "b": j} for i, j in zip((x[s:e] - p).tolist(), (y[s:e] - q).tolist(), strict=True)] for s, e, p, q in zip(cuts, cuts[1:], *at)])
                arrays = [pa.array(out[0], pa.list_(pa.int32())), pa.array(out[1], pa.list_(pa.int32())), pa.array(out[2], pair), pa.array(out[3], pair)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.start, len(part)), *arrays], names=["key", "first_ids", "second_ids", "overlaps", "links"])

    some = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = f"key {kind}, first_ids array<int>, second_ids array<int>, overlaps array<struct<a:int,b:int>>, links array<struct<a:int,b:int>>"
    return some.mapInArrow(run, schema)


def digests(docs: DataFrame, first: str, second: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, key, n_first, n_second, n_groups, n_links, groups_sha256, pairs, times), written to the shared folder.

    ``pairs`` are the distinct linked id pairs (first << SECOND_BITS | second), ``times`` how often the document links them;
    ``row`` tells rows of one key apart.
    """
    both = sides(docs, first, second)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        a, b = both()
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in slices(texts):
                laid = layout(a, b, texts[part.start : part.stop])
                n = len(part)
                at_a, at_b = (bounds(d, n) for d in laid.doc)
                at_link = bounds(laid.doc[0][laid.links[0]], n)
                linked = laid.ids[0][laid.links[0]] << SECOND_BITS | laid.ids[1][laid.links[1]]
                told, whole = group_texts(a, b, laid), at_a + at_b
                shas = [hashlib.sha256("".join(told[s:e].tolist())[:-1].encode()).hexdigest() if e > s else "" for s, e in zip(whole, whole[1:])]
                counted = [np.unique(linked[s:e], return_counts=True) for s, e in zip(at_link, at_link[1:])]
                n_links = pa.array(np.diff(at_link), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + n), pa.int64()), batch.column(0).slice(part.start, n), pa.array(np.diff(at_a), pa.int64()), pa.array(np.diff(at_b), pa.int64()),
                        n_links, n_links, pa.array(shas, pa.string()), pa.array([p for p, _ in counted], pa.list_(pa.int64())), pa.array([t for _, t in counted], pa.list_(pa.int32())),
                    ],
                    names=["row", "key", "n_first", "n_second", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
                )
                row += n

    some = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = f"row long, key {kind}, n_first long, n_second long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
    return materialize(some.mapInArrow(run, schema), "aligned")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): links of each id pair over all documents, and whether no pair of its second id has more; written to the shared folder."""
    each = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.times").alias("n"))
    counts = materialize(each.groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    second = F.col("pair").bitwiseAND(F.lit((1 << SECOND_BITS) - 1)).alias("second")
    highest = counts.groupBy(second).agg(F.max("n").alias("highest"))  # one row a token of the second vocabulary
    return materialize(counts.join(F.broadcast(highest), second == F.col("second")).select("pair", "n", (F.col("n") == F.col("highest")).alias("best")), "pair-best")


def hot_floor(counts: DataFrame, most: int) -> int:
    """The least power-like count n such that at most ``most`` pairs have n or more."""
    level = F.floor(F.log2("n") * 8).cast("int")
    levels = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("pairs"), F.min("n").alias("least")).orderBy(F.desc("level")).collect()
    floor, total = (1 << 62), 0
    for r in levels:
        total += r["pairs"]
        if total > most:
            break
        floor = r["least"]
    return floor


def with_counts(aligned: DataFrame, counts: DataFrame, most: int = HOT_PAIRS) -> DataFrame:
    """``aligned`` without pairs and times, with count_sum (over links, their pair's count) and n_best (links whose pair is a best one).

    The most frequent pairs, at most ``most``, are sent to the tasks; links of the others go through a shuffle.
    """
    floor = hot_floor(counts, most)
    hot = counts.where(F.col("n") >= floor).toArrow().sort_by("pair")
    sent = aligned.sparkSession.sparkContext.broadcast([hot.column(c).to_numpy() for c in ("pair", "n", "best")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = sent.value
        for batch in batches:
            lists, times = batch.column("pairs"), batch.column("times").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            flat, at = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            if len(known):
                place = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                met = known[place] == flat
                sums, bests = (np.concatenate([[0], np.cumsum(np.where(met, times * v[place], 0))]) for v in (n, best.astype(np.int64)))
            else:
                met, sums, bests = np.zeros(len(flat), bool), np.zeros(len(flat) + 1, np.int64), np.zeros(len(flat) + 1, np.int64)
            cuts = np.concatenate([[0], np.cumsum(~met)])[at].astype(np.int32)
            rest = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x[~met], k)) for x, k in ((flat, pa.int64()), (times, pa.int32()))]
            keep = [batch.column(c) for c in ("row", "key", "n_first", "n_second", "n_groups", "n_links", "groups_sha256")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(np.diff(sums[at])), pa.array(np.diff(bests[at])), *rest], names=[*(f.name for f in told.fields)])

    names = [c for c in aligned.columns if c not in ("pairs", "times")]
    kinds = {f.name: f.dataType.simpleString() for f in aligned.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in names) + ", count_sum long, n_best long, pairs array<long>, times array<int>"
    from pyspark.sql.types import StructType

    told = StructType.fromDDL(schema)
    out = aligned.select(*names, "pairs", "times").mapInArrow(run, schema)
    cold = counts.where(F.col("n") < floor)
    if cold.isEmpty():
        return out.drop("pairs", "times")
    out = materialize(out, "counted")
    each = out.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    more = each.join(cold, "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("more_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"))
    joined = out.drop("pairs", "times").join(more, "row", "left")
    return joined.withColumns({"count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0)), "n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0))}).drop("more_sum", "more_best")
