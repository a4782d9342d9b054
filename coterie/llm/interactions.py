"""Filter interaction audit (operator 12): what five filters remove, in every order.

Texts are exploded into words; (document, word) counts give each document's totals and distinct words. The
other flags are outer-joined to them, and a part's documents are summed in conditional-count columns, one for
each of the 32 sets of failed filters. Every order and step follows from those counts alone: the expansion
into 120 orders works on a row per part.

The texts are dealt by document once; both word aggregates then need no further exchange. Copies are found by
a strong digest whose first document comes from a grouped minimum, combined before the shuffle; the join that
brings it back is one whose large groups Spark splits.

Cases: a null text is empty: no words, fails A, never B, C or D, and copies any other empty text; a null
source counts as the empty string; a null doc_id has no labels, is nobody's first copy and copies nothing;
rows that share a doc_id are documents of their own and are no copies of each other; several labels of one
document count as good or toxic if any of them is; a text of any length is exploded whole; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import table

FILTERS = "ABCDE"

#: Fixed values of the filters: least words, least distinct words in a hundred, most capitals in a hundred
#: characters, and the symbols.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SYMBOLS = 200, 50, 2, "[#$%&*|]"

_SPACE = "[ \\t\\n\\x0B\\f\\r]+"
_ORDERS = ["".join(p) for p in permutations(FILTERS)]
_SETS = 1 << len(FILTERS)
_COUNTS = ("n", "good", "toxic")


def word_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, words, distinct_words): a row for each document and text.

    Every text ends in a null word, so that documents without words stay and rows that are repeated whole,
    which are one group, can be told from a longer text."""
    own = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").repartition("doc_id", "text_key")
    words = own.select("doc_id", "text_key", F.explode(F.concat(F.split("text", _SPACE), F.array(F.lit(None).cast("string")))).alias("word"))
    by_word = words.where("word is null or word <> ''").groupBy("doc_id", "text_key", "word").agg(F.count("*").alias("n"))
    rows = F.sum(F.when(F.col("word").isNull(), F.col("n")))
    total = F.coalesce(F.sum(F.when(F.col("word").isNotNull(), F.col("n"))), F.lit(0))
    return by_word.groupBy("doc_id", "text_key").agg((total / rows).cast("long").alias("words"), F.count("word").alias("distinct_words"))


def first_copies(docs: DataFrame) -> DataFrame:
    """(digest, first_id) of the texts that stand in more than one row."""
    return docs.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")


def flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, part, failed, good, toxic) for each row of docs; failed has the bit of each filter that the
    document fails, A's being 1."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    plain = docs.select(
        "doc_id", "part", F.xxhash64("text").alias("text_key"), F.unhex(F.sha2("text", 256)).alias("digest"),
        (100 * F.regexp_count("text", F.lit("[A-Z]")).cast("long") > MAX_CAPITALS * F.length("text").cast("long")).alias("c"), F.col("text").rlike(SYMBOLS).alias("d"),
    )
    firsts = first_copies(plain.select("doc_id", "digest"))
    copied = plain.join(firsts, "digest", "left").withColumn("e", F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)))
    told = labels.groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    words = word_counts(docs).select(F.col("doc_id").alias("w_id"), F.col("text_key").alias("w_key"), "words", "distinct_words")
    out = copied.join(words, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("text_key") == F.col("w_key")), "left")
    out = out.join(told, F.col("doc_id") == F.col("l_id"), "left")
    a, b = F.col("words") < MIN_WORDS, 100 * F.col("distinct_words") < MIN_DISTINCT * F.col("words")
    failed = sum((x.cast("int") * (1 << k) for k, x in enumerate((a, b, F.col("c"), F.col("d"), F.col("e")))), F.lit(0))
    return out.select("doc_id", "part", failed.alias("failed"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def conditional_counts(flagged: DataFrame) -> DataFrame:
    """A row per part: n0 to n31, documents by the set of failed filters, and the same of good and toxic ones."""
    value = {"n": F.lit(1), "good": F.col("good"), "toxic": F.col("toxic")}
    return flagged.groupBy("part").agg(*[F.coalesce(F.sum(F.when(F.col("failed") == s, value[c])), F.lit(0)).cast("long").alias(f"{c}{s}") for c in _COUNTS for s in range(_SETS)])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step."""
    counts = conditional_counts(flags(docs, labels))
    rows = counts.select("part", *[F.array(*[f"{c}{s}" for s in range(_SETS)]).alias(c) for c in _COUNTS], F.explode(F.sequence(F.lit(0), F.lit(len(_ORDERS) * len(FILTERS) - 1))).alias("i"))
    bits = [1 << FILTERS.index(f) for order in _ORDERS for f in order]
    before = [sum(1 << FILTERS.index(f) for f in order[:k]) for order in _ORDERS for k in range(len(FILTERS))]
    at = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("i") + 1)
    rows = rows.withColumns({"filter_order": F.element_at(F.array(*map(F.lit, _ORDERS)), F.expr(f"i div {len(FILTERS)} + 1").cast("int")), "step": (F.col("i") % len(FILTERS) + 1).cast("int"), "own": at(bits), "before": at(before)})

    def total(counts: str, condition: str, each: str = "c") -> F.Column:
        """Sum of a counts array over the sets s that meet a condition."""
        return F.expr(f"aggregate(transform({counts}, (c, s) -> if({condition}, {each}, 0L)), 0L, (a, x) -> a + x)")

    here = "(s & own) <> 0 and (s & before) = 0"
    return rows.select(
        "part", "filter_order", "step",
        total("n", "(s & (own | before)) = 0").alias("kept"), total("n", here).alias("removed"), total("n", "(s & own) <> 0 and (s & before) <> 0").alias("redundant"),
        total("n", "s = own").alias("unique_fails"), total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"),
        # of 120 orders, each of the m filters that a document fails comes first of them in 120 / m
        total("n", "(s & own) <> 0", f"c * ({len(_ORDERS)}L div greatest(bit_count(s), 1))").alias("shapley"),
    )


def op12_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_ORACLE = r"""
WITH docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
  split AS (SELECT doc_id, part, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM docs),
  told AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY 1),
  bits AS (SELECT s.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, len(words) < 200 AS a, 100 * list_unique(words) < 50 * len(words) AS b,
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d, coalesce(s.doc_id > min(s.doc_id) OVER (PARTITION BY md5(text), text), FALSE) AS e
    FROM split s LEFT JOIN told t ON s.doc_id = t.doc_id),
  failed AS (SELECT part, good, toxic, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS fails FROM bits),
  sets AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY 1, 2),
  f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
  orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
  steps AS (SELECT filter_order, step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS earlier FROM orders, range(1, 6) r(step)),
  j AS (SELECT s.*, o.*, contains(fails, own) AS hit, earlier <> '' AND regexp_matches(fails, '[' || CASE WHEN earlier = '' THEN '-' ELSE earlier END || ']') AS gone FROM sets s, steps o),
  r AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, own, coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (hit AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (hit AND gone), 0) AS redundant,
    coalesce(sum(n) FILTER (fails = own), 0) AS unique_fails, coalesce(sum(good) FILTER (hit AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (hit AND NOT gone), 0) AS toxic_lost FROM j GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
"""
