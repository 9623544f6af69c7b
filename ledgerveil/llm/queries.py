"""The registered queries of this package, each over its whole table, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerveil.llm import alignment, bootstrap_pii, chat, cross_entropy, divergence, fuzzy_lines, hadamard, langid, ngram_join, pfair, toxicity, wrappers, wumanber
from ledgerveil.llm.text import bucket_of
from ledgerveil.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    """Component of every document under links of five-word shingles at Jaccard 0.75 or more."""
    return ngram_join.join(table(spark, sf, "documents"))


ORACLES["op1_ngram_join"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS t
  FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.t = y.t AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * common >= 75 * (x.n + y.n - common)),
r AS (SELECT doc_id, doc_id AS reach FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.reach = l.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(reach) AS component_id
FROM d JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id"""


@query
def op2_divergence(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of every document and its distance to its language's character classes and common words."""
    return divergence.judge(table(spark, sf, "documents"))


def _divergence_sql() -> str:
    listed = " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in divergence.COMMON.items())
    half = lambda a, b: f"CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0 END"
    without = lambda p: f"length(t) - length(regexp_replace(t, '{p}', '', 'g'))"
    apart = lambda p, q, n: (
        f"round(sqrt(least(greatest(list_sum([({half(f'{p}[i]', f'{q}[i]')} + {half(f'{q}[i]', f'{p}[i]')}) / 2 FOR i IN range(1, {n} + 1)]), 0), 1)), 6)"
    )
    parts = lambda c: f"[x / greatest(list_sum({c}), 1e-300) FOR x IN {c}]"
    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, CASE lang {listed} ELSE {divergence.POOLED!r} END AS l FROM d),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM w, unnest(range(1, len(w) - 1)) AS u(i)) QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
c AS (SELECT doc_id, count(DISTINCT j) AS n FROM r, unnest([i, i + 1, i + 2]) AS u(j) GROUP BY 1),
s AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM d, unnest(string_split(t, chr(10))) AS u(x) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY 1),
m AS (
  SELECT w.doc_id, lang, len(w) AS n_words, length(t) AS n, {without(r"[\x20\x09-\x0D]+")} AS blank, {without("[#*$%&|<>]+")} AS n_symbols, coalesce(s.n, 0) AS n_dup_lines,
    coalesce(c.n, 0) AS n_repeat_words, {without("[a-z]+")} AS lower, {without("[A-Z]+")} AS upper, {without("[0-9]+")} AS digit, {without(r"[^\x00-\x7F]+")} AS high,
    [len(list_filter(w, lambda x: coalesce(list_position(l, x), 0) = v))::DOUBLE FOR v IN list_concat(range(1, {divergence.SIZE} + 1), [0])] AS words
  FROM w LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)),
f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    [lower::DOUBLE, upper, digit, blank, n_symbols, n - lower - upper - digit - blank - n_symbols - high, high] AS chars FROM m),
rc AS (SELECT lang, list(v ORDER BY i) AS rc FROM (SELECT lang, i, sum(chars[i]) AS v FROM f, unnest(range(1, 8)) AS u(i) WHERE NOT base_failed GROUP BY ALL) GROUP BY lang),
rw AS (SELECT lang, list(v ORDER BY i) AS rw FROM (SELECT lang, i, sum(words[i]) AS v FROM f, unnest(range(1, {divergence.SIZE + 2})) AS u(i) WHERE NOT base_failed GROUP BY ALL) GROUP BY lang),
p AS (
  SELECT f.*, {parts("chars")} AS pc, {parts("words")} AS pw, {parts("rc")} AS qc, {parts("rw")} AS qw
  FROM f LEFT JOIN rc ON f.lang IS NOT DISTINCT FROM rc.lang LEFT JOIN rw ON f.lang IS NOT DISTINCT FROM rw.lang),
j AS (
  SELECT *, CASE WHEN n >= {divergence.CHAR_GUARD} THEN {apart("pc", "qc", 7)} END AS char_distance,
    CASE WHEN n_words >= {divergence.WORD_GUARD} THEN {apart("pw", "qw", divergence.SIZE + 1)} END AS word_distance FROM p)
SELECT doc_id, n_words::BIGINT AS n_words, (n - blank)::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND coalesce(char_distance, 0) <= {divergence.MAX_CHAR_DISTANCE} AND coalesce(word_distance, 0) <= {divergence.MAX_WORD_DISTANCE} AS kept, char_distance, word_distance
FROM j"""


ORACLES["op2_divergence"] = _divergence_sql()


@query
def op3_cross_entropy(spark: SparkSession, sf: str) -> DataFrame:
    """Cross-entropy difference of every document; the target corpus is the documents labelled as of good quality."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return cross_entropy.score(docs, table(spark, sf, "labels").where("quality = 1"))


@query
def op4_fuzzy_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with its repeated and near-repeated lines taken out, as counts and a digest of what is left."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return fuzzy_lines.dedup(docs).select(
        "doc_id", "n_removed", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")
    )


@query
def op5_wrappers(spark: SparkSession, sf: str) -> DataFrame:
    """Main text of every page."""
    out = wrappers.texts(table(spark, sf, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op6_langid(spark: SparkSession, sf: str) -> DataFrame:
    """Language of every document; the fold of remainder 2 is not learned from."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(bucket_of("doc_id", 4) != 2))
    out = langid.identify(docs, model)
    return out.select("doc_id", (bucket_of("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


PROBE = r"\### Assistant: </turn> ok"


@query
def op7_chat(spark: SparkSession, sf: str) -> DataFrame:
    """All conversations and the probe conversation -7, formatted and read back."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return chat.conversations(rows.unionByName(probe))


ORACLES["op7_chat"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, length(regexp_replace(role, '([\\#<:])', '\\\1', 'g')) + length(regexp_replace(text, '([\\#<:])', '\\\1', 'g')) + length('### : ')
    + length(' </turn>') + 1 AS written, lag(role, 1, '') OVER w AS before, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS last
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
f AS (
  SELECT *, CASE before WHEN '' THEN n = 1 AND role IN ('system', 'user') WHEN 'system' THEN role = 'user' WHEN 'user' THEN role = 'assistant'
    WHEN 'assistant' THEN role = 'user' ELSE false END AS fits FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(written)::BIGINT AS formatted_chars,
       coalesce(first('turn ' || n || ': ' || CASE role WHEN '' THEN 'no role' ELSE role END || ' after ' || CASE before WHEN '' THEN 'start' ELSE before END ORDER BY n) FILTER (NOT fits),
                CASE WHEN last(role ORDER BY n) <> 'assistant' THEN 'ends with ' || CASE last(role ORDER BY n) WHEN '' THEN 'nothing' ELSE last(role ORDER BY n) END END) AS fault
FROM f GROUP BY conv_id"""


@query
def op8_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Toxicity score of every document; labels are learned outside the held-out fold only."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf, "labels").where(bucket_of("doc_id", 5) != 0))
    out = toxicity.score(docs, model)
    return out.select("doc_id", (bucket_of("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_matches")


@query
def op9_pfair(spark: SparkSession, sf: str) -> DataFrame:
    """Place of every document in the mix; targets follow the square root of the sources' sizes."""
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return pfair.mix(docs, pfair.tempered(docs))


@query
def op10_wumanber(spark: SparkSession, sf: str) -> DataFrame:
    """Words of every document inside a benchmark window, and the items met."""
    found = wumanber.find(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLES["op10_wumanber"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM documents),
b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
s AS (
  SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS window
  FROM (SELECT item, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0), unnest(range(1, len(w) - k + 2)) AS t(i)),
p AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS window
  FROM d, (SELECT DISTINCT k FROM s), unnest(range(1, len(w) - k + 2)) AS t(i)),
o AS (SELECT doc_id, item, i, p.k AS k FROM p JOIN s ON p.window = s.window AND p.k = s.k),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM o, unnest(range(i, i + k)) AS t(j) GROUP BY doc_id),
f AS (SELECT doc_id, count(DISTINCT item) AS n_items, sha256(array_to_string(list_sort(list(DISTINCT item)), ',')) AS items_sha256 FROM o GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN f USING (doc_id)"""


@query
def op11_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """Personal data in every document: spans of the base patterns and of identifiers learned from their contexts."""
    out = bootstrap_pii.extract(table(spark, sf, "documents"))
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    return out.select(
        F.col("key").alias("doc_id"), *[count(i).alias(f"n_{k}") for i, k in enumerate(bootstrap_pii.KINDS)], F.sha2(bootstrap_pii.listed(F.col("base")), 256).alias("base_sha256"),
        bootstrap_pii.listed(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


@query
def op12_hadamard(spark: SparkSession, sf: str) -> DataFrame:
    """Codes of all vectors through integer Walsh-Hadamard spectra, with the errors summed by label."""
    coded, books = hadamard.compress(table(spark, sf, "embeddings"))
    out = hadamard.with_label_error(coded)
    return out.select(F.col("key").alias("vec_id"), "code", "error", "label_error", F.lit(hadamard.digest(books)).alias("codebooks_sha256"))


def _hadamard_sql() -> str:
    k, parts, scale = hadamard.ENTRIES, hadamard.PARTS, hadamard.SCALE
    near = lambda books: f"""
  SELECT vec_id, part, arg_min(entry, struct_pack(d, entry)) AS entry, min(d) AS d
  FROM (SELECT x.vec_id, x.part, b.entry, sum((x.v - b.v) * (x.v - b.v)) AS d FROM x JOIN {books} b USING (part, place) GROUP BY ALL) GROUP BY ALL"""  # noqa: E731
    steps = []
    for i in range(hadamard.ROUNDS):
        steps.append(f"""n{i} AS MATERIALIZED ({near(f"b{i}")}),
s{i} AS (SELECT part, entry, place, sum(v) AS s, count(*) AS c FROM x JOIN n{i} USING (vec_id, part) GROUP BY ALL),
b{i + 1} AS MATERIALIZED (
  SELECT part, entry, place, CASE WHEN c IS NULL THEN v ELSE ((s - ((s % c) + c) % c) // c)::BIGINT END AS v
  FROM b{i} LEFT JOIN s{i} USING (part, entry, place))""")
    last = hadamard.ROUNDS
    return f"""
WITH e AS (
  SELECT vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
x AS MATERIALIZED (
  SELECT vec_id, (i - 1) // (len(embedding) // {parts}) AS part, (i - 1) % (len(embedding) // {parts}) AS place, floor({scale} * embedding[i]::DOUBLE)::BIGINT AS v
  FROM e, unnest(range(1, len(embedding) + 1)) AS u(i)),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM e QUALIFY entry < {k}),
b0 AS MATERIALIZED (SELECT part, entry, place, v FROM x JOIN f USING (vec_id)),
{", ".join(steps)},
z AS ({near(f"b{last}")}),
r AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM z GROUP BY vec_id)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, place)) FROM b{last}) AS codebooks_sha256
FROM r JOIN e USING (vec_id)"""


ORACLES["op12_hadamard"] = _hadamard_sql()


#: Vocabulary files of public tokenizers; they stay outside the repository.
TOKENIZERS = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"


@query
def op13_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Token groups and links of two tokenizers over every document, with the corpus-wide counts of linked id pairs."""
    aligned = alignment.digests(table(spark, sf, "documents"), *TOKENIZERS)
    out = alignment.with_counts(aligned, alignment.pair_counts(aligned))
    return out.select(F.col("key").cast("long").alias("doc_id"), F.col("n_first").alias("n_a"), F.col("n_second").alias("n_b"), "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
