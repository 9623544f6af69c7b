"""Vector codes: integer codebooks for each part of a vector, searched through integer Walsh-Hadamard transforms.

A component becomes the integer floor(scale * x). A vector is cut into equal consecutive parts, and each part is coded
by the nearest entry of its codebook. Parts and entries are zero-padded to a power of two and transformed; the sums of
squared differences, scaled by the padded length, grow in order of sequency, and an entry leaves the search once its
sum passes the whole distance of the entry that looked nearest at first. All arithmetic is on integers: 64-bit ones
where they cannot overflow, Python's own otherwise.

Rows whose vector is null or holds a null, NaN or infinite component are dropped. The dimension is that of the smallest
kept key; it is padded with zeros to a multiple of the number of parts. A kept row of another dimension stays with a
null code and error and takes no part in fitting. Null keys stay and are never first entries; rows that repeat a key
count each for themselves, in order of their vectors. With fewer rows than entries, codebooks are shorter; with no rows
the result is empty. Errors beyond a long are null. Other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerveil.llm.text import join_totals
from ledgerveil.session import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
SLICE_ROWS = 1024
LIMB = 32
LONG = (1 << 63) - 1


def sequency(n: int) -> np.ndarray:
    """Rows of the natural Hadamard matrix of order ``n`` (a power of two) by their number of sign changes."""
    bits = n.bit_length() - 1
    order = []
    for k in range(n):
        gray = k ^ (k >> 1)
        order.append(int(format(gray, f"0{bits}b")[::-1], 2) if bits else 0)
    return np.array(order)


def spectrum(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform along the last axis, zero-padded to a power of two, in order of sequency."""
    n = 1 << max(x.shape[-1] - 1, 0).bit_length()
    out = np.zeros((*x.shape[:-1], n), x.dtype)
    out[..., : x.shape[-1]] = x
    h = 1
    while h < n:
        pairs = out.reshape(*x.shape[:-1], n // (2 * h), 2, h)
        out = np.stack((pairs[..., 0, :] + pairs[..., 1, :], pairs[..., 0, :] - pairs[..., 1, :]), axis=-2).reshape(*x.shape[:-1], n)
        h *= 2
    return out[..., sequency(n)]


def integers(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x), exactly, for finite doubles: int64 where it fits, Python integers otherwise."""
    if not x.size or np.abs(x).max() * scale < 2.0**52:
        return np.floor(x * scale).astype(np.int64)
    whole = [int(v) * scale if abs(v) >= 2.0**53 else int(np.floor(v * scale)) if abs(v) * scale < 2.0**53 else int(v) * scale + int(np.floor((v - int(v)) * scale)) for v in x.ravel()]
    return np.array(whole, dtype=object).reshape(x.shape)


def fitting_type(x: np.ndarray, books: np.ndarray, n: int) -> type:
    """int64 if no scaled distance between parts and entries can leave it."""
    largest = max((int(abs(v).max()) if v.size else 0) for v in (x, books))
    return np.int64 if 4 * n * n * largest * largest < LONG // 2 else object


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, squared distance) for parts ``x`` (rows, parts, width) and ``books`` (parts, entries, width); ties go to the lower index."""
    n = 1 << max(x.shape[-1] - 1, 0).bit_length()
    kind = fitting_type(x, books, n)
    a, b = spectrum(x.astype(kind)), spectrum(books.astype(kind))
    rows, parts, entries = x.shape[0], b.shape[0], b.shape[1]
    done = max(n // 4, 1)
    sums = ((a[:, :, None, :done] - b[None, :, :, :done]) ** 2).sum(axis=-1).reshape(rows * parts, entries)
    flat = a.reshape(rows * parts, n)
    part = np.tile(np.arange(parts), rows)
    guess = sums.argmin(axis=1)
    bound = sums[np.arange(rows * parts), guess] + ((flat[:, done:] - b[part, guess, done:]) ** 2).sum(axis=1)
    i, k = np.nonzero(sums <= bound[:, None])
    left = sums[i, k]
    while done < n and len(i):
        step = slice(done, min(2 * done, n))
        left = left + ((flat[i, step] - b[part[i], k, step]) ** 2).sum(axis=1)
        stay = (left <= bound[i]).astype(bool)
        i, k, left, done = i[stay], k[stay], left[stay], step.stop
    whole = np.full((rows * parts, entries), (bound.max() if len(bound) else 0) + 1, dtype=kind)
    whole[i, k] = left
    best = whole.argmin(axis=1)
    return best.reshape(rows, parts), (whole[np.arange(rows * parts), best] // n).reshape(rows, parts)


def limbs(v: int) -> list[int]:
    """``v`` in base 2**32, lowest first, the last limb signed; sums of limbs over many tasks stay within a long."""
    out = []
    while not -(1 << 31) <= v < 1 << 31:
        out.append(v & ((1 << LIMB) - 1))
        v >>= LIMB
    return [*out, v]


def sound(vector: str) -> Column:
    """Whether a vector and all its components are there and finite."""
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf")))
    return F.col(vector).isNotNull() & ~F.exists(vector, bad)


def cut(column: pa.Array, dimension: int, parts: int, scale: int) -> Iterator[np.ndarray]:
    """Slices of an Arrow column of whole vectors as integer parts (rows, parts, width)."""
    width = -(-dimension // parts)
    for at in range(0, len(column), SLICE_ROWS):
        piece = column.slice(at, SLICE_ROWS)
        flat = piece.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        whole = np.zeros((len(piece), parts * width))
        whole[:, :dimension] = flat.reshape(len(piece), dimension)
        x = integers(whole, scale)
        yield x.reshape(len(piece), parts, width)


def fit(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[int, np.ndarray] | None:
    """(dimension, codebooks of Python integers (parts, entries, width)) from ``kept`` (key, vector); None without rows.

    Each round is one pass over all rows. A task hands on one sum for each entry and place; Spark adds them up, so the
    driver sees parts x entries x (width + 1) sums whatever the number of rows.
    """
    order = [F.col("key").asc_nulls_last(), F.col("vector")]
    named = kept.where("key IS NOT NULL")
    first = named.orderBy(*order).limit(1).collect() or kept.orderBy(*order).limit(1).collect()
    if not first:
        return None
    dimension = len(first[0]["vector"])
    width = -(-dimension // parts)
    alike = kept.where(F.size("vector") == dimension)
    seeds = named.where(F.size("vector") == dimension).orderBy(*order).limit(entries).collect() or first
    table = pa.array([[float(v) for v in r["vector"]] for r in seeds], pa.list_(pa.float64()))
    books = np.concatenate([x.astype(object) for x in cut(table, dimension, parts, scale)]).transpose(1, 0, 2)

    for _ in range(rounds):
        now = books

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((parts, now.shape[1], width + 1), dtype=object)
            for batch in batches:
                for x in cut(batch.column(0), dimension, parts, scale):
                    best, _ = nearest(x, now)
                    small = x.dtype == np.int64 and (not x.size or int(np.abs(x).max()) < 1 << 52)
                    part = np.zeros(total.shape, dtype=np.int64 if small else object)
                    for p in range(parts):
                        np.add.at(part[p, :, :width], best[:, p], x[:, p])
                        part[p, :, width] = np.bincount(best[:, p], minlength=now.shape[1])
                    total += part.astype(object)
            out = [(slot, place, v) for slot, whole in enumerate(total.ravel()) if whole for place, v in enumerate(limbs(int(whole)))]
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64())], names=["slot", "place", "v"])

        got = alike.select("vector").mapInArrow(sums, "slot int, place int, v long").groupBy("slot", "place").agg(F.sum("v").alias("v")).collect()
        total = np.zeros(parts * now.shape[1] * (width + 1), dtype=object)
        for r in got:
            total[r["slot"]] += r["v"] << (LIMB * r["place"])
        total = total.reshape(parts, now.shape[1], width + 1)
        books = now.copy()
        used = total[:, :, width] > 0
        for p, k in zip(*np.nonzero(used), strict=True):
            books[p, k] = [s // int(total[p, k, width]) for s in total[p, k, :width]]
    return dimension, books


def encode(rows: DataFrame, dimension: int, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """(key, label, code, error) of ``rows`` (key, label, vector)."""
    parts = books.shape[0]
    as_is = rows.select("key", "label").schema
    names = np.array([f"{k:02x}" for k in range(max(books.shape[1], 1))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, same = batch.column(2), np.array(batch.column(3))
            codes, errors = np.full(len(same), None, dtype=object), np.full(len(same), None, dtype=object)
            got_codes, got_errors = [], []
            for x in cut(vectors.filter(pa.array(same)), dimension, parts, scale):
                best, far = nearest(x, books)
                got_codes += ["".join(c) for c in names[best].tolist()]
                got_errors += [e if e <= LONG else None for e in (int(v) for v in far.sum(axis=1, dtype=object))]
            codes[same], errors[same] = got_codes, got_errors
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=["key", "label", "code", "error"])

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in as_is.fields)
    told = rows.select("key", "label", "vector", (F.size("vector") == dimension).alias("same"))
    return told.mapInArrow(run, f"{ddl}, code string, error long")


def compress(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, np.ndarray]:
    """((key, label, code, error) written to the shared folder, codebooks)."""
    rows = df.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).alias("vector")).where(sound("vector"))
    model = fit(rows.select("key", "vector"), parts, entries, rounds, scale)
    if model is None:
        return rows.select("key", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).limit(0), np.zeros((parts, 0, 0), dtype=object)
    return materialize(encode(rows, *model, scale), "codes"), model[1]


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` (key, label, code, error) with label_error: the sum of errors over equal labels, null labels together."""
    sums = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(20,0)")).alias("label_error"), F.count(F.lit(1)).alias("n"))
    return join_totals(coded, sums, "label").withColumn("label_error", F.expr("try_cast(label_error AS long)")).drop("n")


def digest(books: np.ndarray) -> str:
    """Digest of all entries' decimal components by part, entry and place."""
    return hashlib.sha256(",".join(str(v) for v in books.ravel()).encode()).hexdigest()
