"""Quality rules with SQL functions only: counts, and the distance of a text's histograms to those of its language.

A text's character classes and common words are compared with the sums over all sound texts of its language by
Jensen-Shannon distance (base 2, 0 to 1). Short texts have rough histograms and are not judged by them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerveil.llm.text import written

MIN_WORDS = 50
MAX_REPEAT = 50
CHAR_GUARD = 200
WORD_GUARD = 100
MAX_CHAR_DISTANCE = 0.25
MAX_WORD_DISTANCE = 0.28

#: 24 frequent words of each language, and a pooled list for all others.
COMMON = {
    "en": "the of and a to in is that it for was on are as with be at from by not this an have or".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an einer".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se elle".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o".split(),
}
POOLED = [w for ws in COMMON.values() for w in ws[:6]]
SIZE = 24

_BLANK = r"[\x20\x09-\x0D]+"


def _without(text: Column, pattern: str) -> Column:
    """Characters of ``text`` that ``pattern`` matches."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def covered(at: Column) -> Column:
    """Words covered by three-word windows that start at the sorted positions ``at``."""
    steps = F.transform(F.sequence(F.lit(1), F.size(at) - 1), lambda j: F.least(F.lit(3), F.get(at, j) - F.get(at, j - 1)))
    inner = F.when(F.size(at) > 1, F.aggregate(steps, F.lit(0), lambda a, s: a + s)).otherwise(0)
    return F.when(F.size(at) > 0, inner + 3).otherwise(0)


def measures(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, chars, words) per row.

    ``chars`` are counts of lower and upper ASCII letters, digits, blanks, symbols, other ASCII, characters above it;
    ``words`` are counts of the language's common words and of all other words. Repeated windows are found by sorting
    window hashes within the text; texts with many repeated windows sort (hash, position) pairs.
    """
    d = docs.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    d = d.withColumn("w", F.regexp_extract_all("t", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    d = d.withColumn("h", F.transform("w", lambda w: F.xxhash64(w)))
    window = lambda i: F.xxhash64(F.get("h", i), F.get("h", i + 1), F.get("h", i + 2))
    d = d.withColumn("tri", F.when(F.size("h") >= 3, F.transform(F.sequence(F.lit(0), F.size("h") - 3), window)).otherwise(F.array().cast("array<bigint>")))
    d = d.withColumn("s", F.sort_array("tri"))
    d = d.withColumn("dup", F.array_distinct(F.filter("s", lambda x, i: (i > 0) & (x == F.get("s", i - 1)))))
    d = d.withColumn("pairs", F.when(F.size("dup") > 16, F.sort_array(F.transform("tri", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    few = F.filter(F.transform("tri", lambda x, i: F.when(F.array_contains("dup", x), i)), lambda i: i.isNotNull())
    same = lambda x, i: (F.get("pairs", i - 1)["x"] == x["x"]) | (F.get("pairs", i + 1)["x"] == x["x"])
    many = F.sort_array(F.transform(F.filter("pairs", lambda x, i: F.coalesce(same(x, i), (F.get("pairs", F.greatest(i - 1, F.lit(0)))["x"] == x["x"]) & (i > 0), F.lit(False))), lambda x: x["i"]))
    d = d.withColumn("at", F.when(F.size("dup") == 0, F.array().cast("array<int>")).when(F.col("pairs").isNull(), few).otherwise(many))
    listed = F.lit(None).cast("array<string>")
    for name, words in COMMON.items():
        listed = F.when(F.col("lang") == name, F.array(*map(F.lit, words))).otherwise(listed)
    d = d.withColumn("list", F.coalesce(listed, F.array(*map(F.lit, POOLED))))
    found = F.transform("w", lambda w: F.array_position("list", w).cast("int"))
    d = d.withColumn("p", F.sort_array(F.concat(found, F.sequence(F.lit(0), F.lit(SIZE + 1)))))
    place = [F.array_position("p", F.lit(v)) for v in range(SIZE + 2)]
    d = d.withColumn("place", F.array(*place))
    counts = [(F.get("place", F.lit(v + 1)) - F.get("place", F.lit(v)) - 1).cast("double") for v in [*range(1, SIZE + 1), 0]]
    lines = F.filter(F.split("t", "\n"), lambda x: F.length(F.regexp_replace(x, _BLANK, "")) > 0)
    d = d.withColumn("lines", lines)
    d = d.select(
        "key", "lang", F.size("w").cast("long").alias("n_words"), F.length("t").cast("long").alias("n"), _without(F.col("t"), _BLANK).alias("blank"),
        _without(F.col("t"), r"[#*$%&|<>]+").alias("n_symbols"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered(F.col("at")).cast("long").alias("n_repeat_words"), _without(F.col("t"), "[a-z]+").alias("lower"), _without(F.col("t"), "[A-Z]+").alias("upper"),
        _without(F.col("t"), "[0-9]+").alias("digit"), _without(F.col("t"), r"[^\x00-\x7F]+").alias("high"), F.array(*counts).alias("words"),
    )
    rest = F.col("n") - F.col("lower") - F.col("upper") - F.col("digit") - F.col("blank") - F.col("n_symbols") - F.col("high")
    chars = F.array(*[c.cast("double") for c in (F.col("lower"), F.col("upper"), F.col("digit"), F.col("blank"), F.col("n_symbols"), rest, F.col("high"))])
    return d.select("key", "lang", "n_words", (F.col("n") - F.col("blank")).alias("word_chars"), "n_symbols", "n_dup_lines", "n_repeat_words", "n", chars.alias("chars"), "words")


def shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.transform(counts, lambda x: x / F.greatest(total, F.lit(1e-300)))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two share arrays of one length."""
    def half(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    total = F.aggregate(F.zip_with(p, q, lambda a, b: (half(a, b) + half(b, a)) / 2), F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)))


def judge(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Per row: ``key``, the counts, base_failed, char_distance, word_distance, kept.

    base_failed: fewer than 50 words, or over half of them in repeated three-word windows. Sound texts that are long
    enough are kept if both distances to their language's reference are small; a distance is null below its length
    guard and then does not count. A null language is a language of its own, compared by the pooled word list. Null
    texts are empty and fail. Rows are judged one by one; repeated rows weigh in the references as often as they occur.
    """
    m = written(measures(docs, key=key, text=text, lang=lang), "quality")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    sums = lambda name, size: F.array(*[F.sum(F.get(name, F.lit(i))) for i in range(size)])
    reference = m.where(~failed).groupBy("lang").agg(sums("chars", 7).alias("all_chars"), sums("words", SIZE + 1).alias("all_words"))
    reference = reference.select(F.col("lang").alias("of"), shares(F.col("all_chars")).alias("rc"), shares(F.col("all_words")).alias("rw"))
    d = m.join(written(reference, "quality-references"), F.col("lang").eqNullSafe(F.col("of")), "left")
    dc = F.when(F.col("n") >= CHAR_GUARD, distance(shares(F.col("chars")), F.col("rc")))
    dw = F.when(F.col("n_words") >= WORD_GUARD, distance(shares(F.col("words")), F.col("rw")))
    d = d.select("*", failed.alias("base_failed"), dc.alias("char_distance"), dw.alias("word_distance"))
    close = (F.coalesce("char_distance", F.lit(0.0)) <= MAX_CHAR_DISTANCE) & (F.coalesce("word_distance", F.lit(0.0)) <= MAX_WORD_DISTANCE)
    return d.select(
        F.col("key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & close).alias("kept"),
        F.round("char_distance", 6).alias("char_distance"), F.round("word_distance", 6).alias("word_distance"),
    )
