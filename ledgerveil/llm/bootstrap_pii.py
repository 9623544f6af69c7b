"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Base spans of four kinds (e-mail address, IP address, card number, phone number) come from fixed patterns and are the
seeds. The words around seeds induce lexical patterns: the two words before, and the word before with the word after.
Every other token that holds a digit or an @ is a candidate and stands in the same kind of contexts. Patterns and
instances (folded values) form a bipartite graph, which Spark scores in rounds: a pattern's score for a kind is the mean
confidence of its distinct instances, an instance's confidence that of at least one of its accepted patterns being right.
Candidates of high confidence whose characters fit the kind are new identifiers, and their occurrences are added as spans.
Scores are whole millionths, so that results do not depend on the order of sums.

Null and empty texts have no spans. Rows that repeat, or share a key or a null key, count each for themselves as rows,
while graph scores count distinct values. Positions are code points. Only key and text are read, whatever else the
input holds. Texts are whole; the words around a span are taken from the WIDTH characters next to it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerveil.llm.text import join_totals
from ledgerveil.session import materialize

KINDS = ["email", "ip", "card", "phone"]

# The base patterns of the contract. Runs are taken whole and a search starts at a run's first character or
# where the last match ended; leftmost matches are the same, and time grows with the text's length only.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that every text with a match passes.
HINT = {"email": "@", "ip": ".", "card": None, "phone": "+"}
OCTETS = r"^0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9]|)(?:\.0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9]|)){3}$"

#: A token with a digit or an @, and the groups of digits that follow it after single blanks.
CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?:\x20[(]?[0-9][0-9().,-]*+(?!\S))*+"
EDGES = ".,;:!?)]}>\"'([{<"
WIDTH = 64
#: Characters a new identifier of a kind may have, and how many digits.
FITS = {
    "email": r"^[^@\s]{1,64}@[^@\s]{1,255}$",
    "ip": r"^[0-9a-fA-F]{1,4}(?:[.:][0-9a-fA-F]{0,4}){3,7}$",
    "card": r"^(?=(?:[^0-9]*[0-9]){12,19}[^0-9]*$)[0-9][0-9 .-]{10,40}$",
    "phone": r"^(?=(?:[^0-9]*[0-9]){7,15}[^0-9]*$)[+(]?[0-9][0-9 ().\-/]{5,40}$",
}

ROUNDS = 3
MILLION = 1_000_000
#: A pattern needs so many trusted distinct instances, and such a mean confidence over all its distinct instances.
LEAST_SUPPORT, LEAST_SCORE = 3, 600_000
#: An instance is trusted, and its occurrences are spans, from this confidence on.
LEAST_CONFIDENCE = 800_000
HIGHEST_SCORE = 950_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(lengths: Column) -> Column:
    """Sums of all earlier elements of an array of longs, in blocks, so that long arrays cost no square."""
    block = 256
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    of = lambda i: F.floor(i / block).cast("int")

    def sums(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), of(F.size(xs) - 1)), lambda b: total(F.slice(xs, b * block + 1, F.lit(block))))
        carried = F.aggregate(blocks, F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
        return let(carried, lambda c: F.transform(F.sequence(F.lit(0), F.size(xs) - 1), lambda i: F.element_at(c, of(i) + 1) + total(F.slice(xs, of(i) * block + 1, F.pmod(i, F.lit(block))))))

    return let(lengths, sums)


def found(text: Column, pattern: str, hint: Column) -> Column:
    """Matches as structs (start, value, before, after): ``before`` and ``after`` are the WIDTH characters between this match and its neighbours."""

    def spans(m: Column) -> Column:
        pieces, values = m["pieces"], m["values"]
        n = F.size(values)
        both = F.arrays_zip(F.slice(pieces, 1, n).alias("l"), values.alias("v"), F.slice(pieces, F.lit(2), n).alias("r"))
        starts = running(F.transform(both, lambda x: (F.length(x["l"]) + F.length(x["v"])).cast("long")))
        return F.zip_with(both, starts, lambda x, at: F.struct((at + F.length(x["l"])).alias("start"), x["v"].alias("value"), F.substring(x["l"], -WIDTH, WIDTH).alias("before"), F.substring(x["r"], 1, WIDTH).alias("after")))

    matched = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"))
    none = F.array().cast("array<struct<start:bigint,value:string,before:string,after:string>>")
    return F.when(hint, let(matched, lambda m: F.when(F.size(m["values"]) > 0, spans(m)).otherwise(none))).otherwise(none)


def luhn(value: Column) -> Column:
    """Whether the digits of a card match, from the right, pass the check."""
    digits = F.transform(F.split(F.reverse(value), ""), lambda c: c.try_cast("int"))
    doubled = lambda d, i: F.when(F.pmod(i, F.lit(2)) == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
    return F.pmod(F.aggregate(F.transform(F.filter(digits, lambda d: d.isNotNull()), doubled), F.lit(0), lambda a, x: a + x), F.lit(10)) == 0


def valid(kind: str, value: Column) -> Column:
    """What a base match must pass."""
    digits = F.regexp_replace(value, "[^0-9]+", "")
    if kind == "ip":
        return value.rlike(OCTETS)
    if kind == "card":
        return F.length(digits).between(16, 19) & F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """The array of (start, value, before, after) of a kind's passing matches."""
    hint = text.contains(HINT[kind]) if HINT[kind] else text.rlike("[0-9]")
    return F.filter(found(text, BASE[kind], hint), lambda s: valid(kind, s["value"]))


def candidates(text: Column) -> Column:
    """Tokens with a digit or an @, without the punctuation at their ends; tokens of punctuation only cannot occur."""
    edges = F.lit(EDGES)
    return F.transform(
        found(text, CANDIDATE, text.rlike("[0-9@]")),
        lambda s: F.struct(
            (s["start"] + F.length(s["value"]) - F.length(F.ltrim(s["value"], edges))).alias("start"), F.trim(s["value"], edges).alias("value"), s["before"].alias("before"), s["after"].alias("after")
        ),
    )


def folded(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), r"[^\p{L}\p{M}]+", "")


def contexts(before: Column, after: Column) -> Column:
    """Lexical patterns of an occurrence: two words before; word before and word after. Without a word before there are none."""
    blank = r"[\x20\x09-\x0D]+"
    words = lambda s: F.filter(F.transform(F.split(s, blank), folded), lambda w: w != "")
    left, right = F.slice(F.concat(F.array(F.lit(""), F.lit("")), words(before)), -2, 2), F.get(F.concat(words(after), F.array(F.lit(""))), F.lit(0))
    two = F.when((left[0] != "") & (left[1] != ""), F.concat(F.lit("l "), left[0], F.lit(" "), left[1]))
    around = F.when((left[1] != "") & (right != ""), F.concat(F.lit("a "), left[1], F.lit(" _ "), right))
    return F.array_compact(F.array(two, around))


def instance(value: Column) -> Column:
    """A value folded: blanks and punctuation that writers vary are dropped."""
    return F.lower(F.regexp_replace(value, r"[\x20()-]+", ""))


def scanned(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(row, key, base: array of (kind, start, value, before, after), candidates), written to the shared folder, without the texts."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    some = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), whole.alias("text"))

    def told(i: int, kind: str) -> Column:
        return F.transform(base_spans(F.col("text"), kind), lambda s: F.struct(F.lit(i).alias("kind"), *[s[c].alias(c) for c in ("start", "value", "before", "after")]))

    base = F.concat(*[told(i, k) for i, k in enumerate(KINDS)])
    return materialize(some.select("row", "key", base.alias("base"), candidates(F.col("text")).alias("candidates")), "pii-scan")


def occurrences(scan: DataFrame) -> DataFrame:
    """(row, kind, start, finish, instance, patterns, free): every base span and candidate; kind is null and free true for a candidate that meets no base span."""
    place = ["row", "kind", "start", "value", "before", "after"]
    seeds = scan.select("row", F.explode("base").alias("s")).select("row", "s.*").select(*place)
    others = scan.select("row", F.explode("candidates").alias("s")).select("row", F.lit(None).cast("int").alias("kind"), "s.*").select(*place)
    both = seeds.unionByName(others).withColumn("finish", F.col("start") + F.length("value"))
    # the spans of one text, from either end: the furthest end of base spans so far, and the start of the next one
    earlier = lambda *order: Window.partitionBy("row").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    is_base = F.col("kind").isNotNull()
    marked = both.withColumn("last_end", F.max(F.when(is_base, F.col("finish"))).over(earlier("start", F.col("kind").isNull())))
    marked = marked.withColumn("next_start", F.min(F.when(is_base, F.col("start"))).over(earlier(F.desc("start"), F.col("kind").isNotNull())))
    clear = (F.coalesce("last_end", F.lit(0)) <= F.col("start")) & (F.coalesce(F.col("next_start") >= F.col("finish"), F.lit(True)))
    return materialize(
        marked.where(is_base | clear).select("row", "kind", "start", "finish", F.col("value"), instance(F.col("value")).alias("instance"), contexts(F.col("before"), F.col("after")).alias("patterns")),
        "pii-occurrences",
    )


def fitting(kind: Column, value: Column) -> Column:
    """Whether a candidate's characters fit a kind."""
    return reduce(lambda a, b: a | b, [(kind == i) & value.rlike(FITS[k]) for i, k in enumerate(KINDS)])


def learned(spans: DataFrame) -> DataFrame:
    """(instance, kind, confidence) of new identifiers: rounds over the graph of patterns and instances."""
    edges = materialize(spans.select(F.explode("patterns").alias("pattern"), "instance").distinct(), "pii-edges")
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    degrees = materialize(edges.groupBy("instance").agg(F.count(F.lit(1)).alias("n")), "pii-degrees")
    seeds = spans.where("kind IS NOT NULL").select("instance", "kind").distinct().withColumn("confidence", F.lit(MILLION))
    unseen = materialize(
        spans.where("kind IS NULL").select("instance", "value").distinct().join(spans.where("kind IS NOT NULL").select("instance").distinct(), "instance", "left_anti")
        .select("instance", F.explode(F.array(*[F.lit(i) for i in range(len(KINDS))])).alias("kind"), "value").where(fitting(F.col("kind"), F.col("value"))).select("instance", "kind").distinct(),
        "pii-unseen",
    )
    seeds = materialize(seeds, "pii-seeds")
    trusted = seeds
    for _ in range(ROUNDS):
        # an instance has at most one trust a kind, folded to one row, so that joins meet unique keys
        votes = trusted.groupBy("instance").agg(F.map_from_entries(F.collect_list(F.struct("kind", "confidence"))).alias("votes")).join(degrees, "instance")
        met = join_totals(edges, votes, "instance").select("pattern", F.explode("votes").alias("kind", "confidence"))
        scores = met.groupBy("pattern", "kind").agg(F.sum("confidence").alias("total"), F.count(F.lit(1)).alias("support")).join(sizes, "pattern")
        score = F.least(F.expr("total div n"), F.lit(HIGHEST_SCORE))
        good = scores.where((F.col("support") >= LEAST_SUPPORT) & (score >= LEAST_SCORE)).select("pattern", "n", "kind", F.round(-MILLION * F.log(1 - score / MILLION)).cast("long").alias("weight"))
        rules = good.groupBy("pattern").agg(F.first("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("kind", "weight"))).alias("weights"))
        told = join_totals(edges, rules, "pattern").select("instance", F.explode("weights").alias("kind", "weight"))
        sums = told.groupBy("instance", "kind").agg(F.sum("weight").alias("weight"))
        sure = F.floor(MILLION * (1 - F.exp(-F.col("weight") / MILLION))).cast("int").alias("confidence")
        new = sums.join(unseen, ["instance", "kind"], "left_semi").select("instance", "kind", sure).where(F.col("confidence") >= LEAST_CONFIDENCE)
        new = materialize(new, "pii-new")
        trusted = seeds.unionByName(new)
    best = F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("kind")
    return new.groupBy("instance").agg(best, F.max("confidence").alias("confidence"))


def extract(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, key, base, added): arrays of spans (kind, start, finish, value), in order of kind and start.

    ``kind`` counts from 0 in KINDS, ``finish`` is exclusive. ``added`` holds the occurrences of learned identifiers.
    """
    scan = scanned(docs, key, text)
    spans = occurrences(scan)
    new = learned(spans)
    others = spans.where("kind IS NULL").drop("kind", "patterns")
    totals = others.groupBy("instance").agg(F.count(F.lit(1)).alias("n")).join(new, "instance")
    met = join_totals(others, totals, "instance").where(fitting(F.col("kind"), F.col("value")))
    added = met.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "finish", "value"))).alias("added"))
    base = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), (s["start"] + F.length(s["value"])).alias("finish"), s["value"].alias("value")))
    none = F.array().cast("array<struct<kind:int,start:bigint,finish:bigint,value:string>>")
    return scan.select("row", "key", base.alias("base")).join(added, "row", "left").withColumn("added", F.coalesce("added", none))


def listed(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["finish"].cast("string"))), ",")
