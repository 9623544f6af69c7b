"""Near-duplicate lines across documents, with SQL functions only.

Distinct lines get a MinHash signature over character shingles. Lines that agree in a band are compared by exact
Jaccard similarity, first to two pivots of their bucket, then to each other where that can still join components;
there sketches of the sets rule out, without error, most pairs that are no link before their texts are brought together.
Verified links go through a distributed union-find, and one line per component stays: the first by (document, line number).
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerveil.llm.components import components
from ledgerveil.llm.text import bit_set, numbered, parted, with_bit, written

SHINGLE = 8
PERCENT = 75
BANDS, ROWS = 5, 3
#: Lines of a bucket that meet in one task.
BLOCK = 512
#: Longs of a line's sketch; a power of two.
WORDS = 16


def normal(line: Column) -> Column:
    """What counts as the same line: blanks at the ends do not matter."""
    return F.trim(line)


def shingles(line: Column) -> Column:
    """64-bit hashes of the distinct shingles of ``SHINGLE`` UTF-16 units; a shorter line is one shingle."""
    size = 2 * SHINGLE

    def of(p: Column) -> Column:
        at = F.sequence(F.lit(1), F.octet_length(p) - (size - 1), F.lit(2))
        cut = F.transform(at, lambda i: F.xxhash64(F.substring(p, i, F.lit(size))))
        return F.when(F.octet_length(p) < size, F.array(F.xxhash64(p))).otherwise(F.array_distinct(cut))

    # bound to a lambda variable, so that the line is encoded once
    return F.get(F.transform(F.array(F.encode(line, "UTF-16BE")), of), 0)


def _mask(j: int) -> int:
    """A fixed 64-bit mask per place."""
    x = (j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    x = (x ^ x >> 27) * 0x94D049BB133111EB & (1 << 64) - 1
    return (x ^ x >> 31) - (1 << 63)


def bands(lines: DataFrame) -> DataFrame:
    """(h, keys): band keys of the MinHash signature, for (h, line) of at least ``SHINGLE`` units.

    Signature shingles are taken over UTF-8 units, where cutting one out does not walk through the line. Each is hashed
    once; one mask per signature place turns the hash into that place's order, and the smallest is kept. Minima are
    combined row by row, so a very long line is no single work item.
    """
    coded = lines.where(F.octet_length("line") >= SHINGLE).select("h", F.col("line").cast("binary").alias("p"))
    at = F.explode(F.sequence(F.lit(1), F.octet_length("p") - (SHINGLE - 1)))
    hashed = coded.select("h", "p", at.alias("i")).select("h", F.xxhash64(F.expr(f"substring(p, i, {SHINGLE})")).alias("x"))
    signed = hashed.groupBy("h").agg(*[F.min(F.col("x").bitwiseXOR(F.lit(_mask(j)))).alias(f"s{j}") for j in range(BANDS * ROWS)])
    keys = [F.xxhash64(F.lit(b), *[f"s{b * ROWS + r}" for r in range(ROWS)]) for b in range(BANDS)]
    return signed.select("h", F.array(*keys).alias("keys"))


def _sketch(sets: Column) -> Column:
    """``WORDS`` longs: per cell of 64 * ``WORDS``, whether the number of shingles hashed to it is odd.

    The bits in which two lines differ are at most the shingles that one line has and the other has not.
    """
    def word(w: int) -> Column:
        bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))
        mine = F.filter(sets, lambda x: F.shiftright(x, 6).bitwiseAND(F.lit(WORDS - 1)) == w)
        return F.aggregate(mine, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(bit(x)))

    return F.array(*[word(w) for w in range(WORDS)])


def _sketched(lines: DataFrame, wanted: DataFrame, purpose: str) -> DataFrame:
    """(h, line, n: set size, bits: sketch) for the lines that may be in ``wanted`` (h)."""
    some = with_bit(lines, "h", bit_set(wanted, "h")).where("_in").select("h", "line")
    # nested lambdas, so that the set is made once a line and not once a mention
    told = F.transform(F.array(shingles(F.col("line"))), lambda s: F.struct(F.size(s).alias("n"), _sketch(s).alias("bits")))
    return written(some.select("h", "line", F.inline(told)), purpose)


def _may_link(x: str, y: str) -> str:
    """Whether two lines' sizes and sketches allow a link: linked sets differ in at most (x + y) (100 - P) / (100 + P) shingles."""
    odd = [f"bit_count({x}.bits[{w}] ^ {y}.bits[{w}])" for w in range(WORDS)]
    most = f"({100 - PERCENT} * ({x}.n + {y}.n))"
    sized = f"100 * {x}.n >= {PERCENT} * {y}.n AND 100 * {y}.n >= {PERCENT} * {x}.n"
    return f"{sized} AND " + " AND ".join(f"{100 + PERCENT} * ({' + '.join(odd[:k])}) <= {most}" for k in (WORDS // 4, WORDS))


def _links(pairs: DataFrame, lines: DataFrame, purpose: str) -> DataFrame:
    """The (a, b) of ``pairs`` whose whole shingle sets, of ``lines`` (h, line), reach the similarity of a link."""
    text = lines.select("h", "line")
    left = pairs.join(text, pairs["a"] == text["h"]).select("a", "b", F.col("line").alias("x"))
    both = left.join(text, left["b"] == text["h"]).select("a", "b", "x", F.col("line").alias("y"))
    # nested lambdas, so that each set and the intersection are made once a pair and not once a mention
    sets = F.array(F.struct(shingles(F.col("x")).alias("x"), shingles(F.col("y")).alias("y")))
    sized = F.transform(sets, lambda t: F.struct(F.size(F.array_intersect(t["x"], t["y"])).alias("i"), (F.size(t["x"]) + F.size(t["y"])).alias("s")))
    met = both.select("a", "b", F.explode(sized).alias("t")).where(100 * F.col("t.i") >= PERCENT * (F.col("t.s") - F.col("t.i")))
    return written(met.select("a", "b"), purpose)


def _renamed(links: DataFrame, roots: DataFrame, purpose: str) -> DataFrame:
    """``roots`` (node, root) after ``links`` (a, b), which may hold nodes that had none."""
    for c in ("a", "b"):
        links = links.join(roots.withColumnRenamed("node", c), c, "left").withColumn(c, F.coalesce("root", c)).drop("root")
    joined = components(links, purpose).select(F.col("node").alias("old"), F.col("root").alias("new"))
    both = roots.join(joined, roots["root"] == joined["old"], "full")
    return written(both.select(F.coalesce("node", "old").alias("node"), F.coalesce("new", "root").alias("root")), purpose)


def _mixed(rest: DataFrame, roots: DataFrame) -> DataFrame:
    """``rest`` (key, o, ...) with ``root``, less the buckets of one component, which have no more to say."""
    rest = rest.join(roots.withColumnRenamed("node", "o"), "o", "left").withColumn("root", F.coalesce("root", "o"))
    mixed = rest.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
    return rest.join(mixed, "key", "left_semi")


def _middles(rest: DataFrame) -> DataFrame:
    """Pairs (a, b) of a star around each bucket's line whose sketch is nearest to those of its two pivots."""
    ends = rest.where("o = p OR o = q").select("key", F.col("bits").alias("end"))
    odd = " + ".join(f"bit_count(bits[{w}] ^ end[{w}])" for w in range(WORDS))
    apart = rest.join(ends, "key").groupBy("key", "o").agg(F.sum(F.expr(odd)).alias("d"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    inner = apart.join(rest.where("o <> p AND o <> q").select("key", "o"), ["key", "o"], "left_semi")
    middle = inner.groupBy("key").agg(F.min_by(F.struct("o", "n", "bits"), F.struct("d", "o")).alias("m")).select("key", "m.*")
    x, y = middle.alias("x"), rest.alias("y")
    star = x.join(y, F.expr(f"x.key = y.key AND x.o <> y.o AND {_may_link('x', 'y')}"))
    return star.select(F.least("x.o", "y.o").alias("a"), F.greatest("x.o", "y.o").alias("b")).distinct()


def _others(rest: DataFrame) -> DataFrame:
    """Pairs (a, b) of a bucket's lines other than its pivots that may still be links of different components.

    Buckets are cut into blocks, and each two blocks meet in a task of their own; of the lines that meet there, those
    come out whose sizes and sketches allow a link.
    """
    rest = rest.where("o <> p AND o <> q").withColumn("nb", F.ceil(F.col("all") / BLOCK).cast("int"))
    rest = rest.withColumn("at", F.pmod(F.xxhash64("o"), F.col("nb")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda k: F.struct(F.least("at", k).alias("i"), F.greatest("at", k).alias("j")))
    placed = rest.select("key", "o", "n", "bits", "root", "at", F.explode(cells).alias("c")).select("key", "c.i", "c.j", "o", "n", "bits", "root", "at")
    x, y = placed.where("at = i").alias("x"), placed.where("at = j").alias("y")
    on = " AND ".join(f"x.{c} = y.{c}" for c in ("key", "i", "j")) + f" AND x.root <> y.root AND (x.i <> x.j OR x.o < y.o) AND {_may_link('x', 'y')}"
    return x.join(y, F.expr(on)).select(F.least("x.o", "y.o").alias("a"), F.greatest("x.o", "y.o").alias("b")).distinct()


def similar(lines: DataFrame, banded: DataFrame) -> DataFrame:
    """(node, root): components of the verified links between distinct lines (h, line) that agree in a band.

    First a bucket is a star around its first and last line in an order of the band's own: 2 n comparisons for n lines,
    and other pivots in other bands. Buckets of up to three lines are done then. In the others, if their lines are in
    different components by then, a third star stands around the line nearest to both pivots, and every two lines that
    are in different components after that, and that their sketches allow to be a link, are compared too: no
    candidate is left out, whatever a bucket's size.
    """
    keyed = banded.select("h", F.posexplode("keys").alias("band", "key"))
    mask = F.element_at(F.array(*[F.lit(_mask(100 + b)) for b in range(BANDS)]), F.col("band") + 1)
    keyed = keyed.select("key", F.col("h").bitwiseXOR(mask).alias("o"), mask.alias("mask"))
    ends = keyed.groupBy("key").agg(F.min("o").alias("p"), F.max("o").alias("q"), F.count(F.lit(1)).alias("all")).where("p <> q")
    met = keyed.join(ends.drop("all"), "key").select(F.col("o").bitwiseXOR(F.col("mask")).alias("a"), F.explode(F.array("p", "q")).alias("b"), "mask")
    pairs = met.select("a", F.col("b").bitwiseXOR(F.col("mask")).alias("b")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = written(pairs, "line-pairs")
    bits = bit_set(pairs.select(F.col("a").alias("h")).unionAll(pairs.select("b")), "h")
    few = written(with_bit(lines, "h", bits).where("_in").select("h", "line"), "line-few")
    roots = components(_links(pairs, few, "line-stars"), "line-links")

    wide = keyed.join(ends.where("all > 3"), "key").select("key", "all", *[F.col(c).bitwiseXOR(F.col("mask")).alias(c) for c in ("o", "p", "q")])
    rest = written(_mixed(wide, roots).drop("root"), "line-wide")
    if rest.isEmpty():
        return roots
    few = _sketched(few, rest.select(F.col("o").alias("h")), "line-sketches")
    rest = rest.join(few.select(F.col("h").alias("o"), "n", "bits"), "o")
    roots = _renamed(_links(written(_middles(rest), "line-middles"), few, "line-thirds"), roots, "line-roots")
    others = written(_others(_mixed(rest, roots)), "line-others")
    if others.isEmpty():
        return roots
    return _renamed(_links(others, few, "line-rest"), roots, "line-joined")


def repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, rid, gone): for documents that repeat lines, the numbers of the lines to take out; rid is a hash of the text.

    A line goes if an equal or similar line comes before it in the order of (key, rid, line number); blank lines stay.
    """
    split = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.xxhash64(text).alias("rid"), F.split(F.col(text), "\n").alias("lines"))
    rows = split.select("id", "rid", F.posexplode("lines").alias("at", "line")).select("id", "rid", "at", normal(F.col("line")).alias("line")).where("line <> ''")
    for salt in count():
        tagged = rows.withColumn("h", F.xxhash64("line", F.lit(salt)))
        seen = written(tagged.select("id", "rid", "at", "h", F.hash("line", F.lit(salt)).alias("h2")), "line-places")
        if seen.groupBy("h").agg(F.min("h2").alias("x"), F.max("h2").alias("y")).where("x <> y").isEmpty():  # no two lines share a hash
            break
    once = tagged.groupBy("h").agg(F.first("line").alias("line"))  # both sides of the join read one shuffle of it
    found = written(once.join(bands(once), "h", "left"), "lines")
    roots = similar(found.select("h", "line"), found.where("keys IS NOT NULL").select("h", "keys"))
    seen = seen.select("id", "rid", "at", "h").join(roots.withColumnRenamed("node", "h"), "h", "left")
    seen = seen.select("id", "rid", "at", F.coalesce("root", "h").alias("c"))
    first = seen.groupBy("c").agg(F.min(F.struct("id", "rid", "at")).alias("first"), F.max(F.struct("id", "rid", "at")).alias("last")).where("first <> last")
    gone = seen.join(first.select("c", "first"), "c").where(F.struct("id", "rid", "at") > F.col("first"))
    return written(gone.groupBy("id", "rid").agg(F.collect_set("at").alias("gone")), "lines-gone")


def dedup(docs: DataFrame, *, key: str = "doc_id", text: str = "text", removed: str = "n_removed") -> DataFrame:
    """``docs`` with ``text`` less its repeated lines and a count column ``removed``; all rows and other columns stay.

    Null texts stay null, empty texts empty. A document of repeated lines only is left with an empty text. Rows with
    equal key and text are one document and are treated alike; a null key is a key like any other, first in order. Other
    columns may have any names; one named ``removed`` gives way to the count.
    Lines are compared in full, whatever their length.
    """
    names = docs.columns
    docs, of = numbered(docs)
    key, text = of[key], of[text]
    gone = repeats(docs, key=key, text=text)
    gone = gone.select(F.col("id").alias("_gone_id"), F.col("rid").alias("_gone_rid"), F.col("gone").alias("_gone"))
    some, others = parted(docs, F.xxhash64(text), gone.select("_gone_rid"), "_gone_rid")
    on = some[key].eqNullSafe(gone["_gone_id"]) & (F.xxhash64(some[text]) == gone["_gone_rid"])
    kept = F.expr(f"array_join(filter(split(`{text}`, '\\n'), (l, i) -> NOT array_contains(_gone, i)), '\\n')")
    out = some.join(gone.hint("merge"), on, "left").withColumn(text, F.when(F.col("_gone").isNull(), F.col(text)).otherwise(kept))
    out = out.withColumn("removed", F.coalesce(F.size("_gone").cast("long"), F.lit(0).cast("long")))
    both = out.select(*docs.columns, "removed").unionAll(others.withColumn("removed", F.lit(0).cast("long")).select(*docs.columns, "removed"))
    return both.select(*[F.col(of[c]).alias(c) for c in names if c != removed], F.col("removed").alias(removed))
