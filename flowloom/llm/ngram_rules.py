"""Quality rules in column expressions, and a hashed n-gram likelihood ratio.

Two multinomials over hashed unigrams and bigrams, one of trusted target texts and one of the raw
corpus, give each bucket a log-ratio in thousandths. A document's verdict is the sum over its n-grams
divided by their number, held against a threshold: whole numbers only, so it does not depend on order
or machine. The raw counts and every verdict cover all texts whole. The target counts and the threshold (the
0.2 % quantile of the trusted texts' means, less a slack) cover all trusted texts whole.

Tokens are runs of letters and digits, or of punctuation. Everything is DataFrame expressions: arrays
stay inside their row. Bucket counts are shuffled, and once the texts of trusted documents, which a bitmap of their ids picks
out (with few others); all other texts stay where they are.

Cases: a null text has no words and fails the base rules, as an empty one does; no labels or no trusted
documents: every log-ratio is 0 and the base rules decide; repeated rows each get a row; an empty table
gives an empty result; extra columns are ignored by ``judge`` and kept by ``keep``.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.bitmaps import marked
from flowloom.llm.inputs import columns, written

BUCKETS = 8_192
SMOOTHING = 0.05
DEAD_ZONE = 0.5
QUANTILE, SLACK = 0.002, 100
WINDOW = 8
LEAST_WORDS = 20
# What splits words, and what counts as a symbol.
BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
TOKENS = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS), "")


def _with_repeats(df: DataFrame, window: int = WINDOW) -> DataFrame:
    """Adds ``n_repeat_words`` to a table with ``_words``: those in a window that occurs more than once.

    Texts without a repeated window are told by the count of distinct ones. In the others windows are
    sorted with their places: equal ones are neighbours, and the places in order cover the words.
    Each step is a column of its own that the next one names more than once: the optimizer then keeps it
    apart, and no array is computed again for each element of another.
    """
    starts = F.size("_words") - window + 1
    hashed = F.transform(F.sequence(F.lit(1), starts), lambda i: F.xxhash64(F.slice("_words", i, window)))
    df = df.withColumn("_windows", F.when(starts >= 2, hashed))
    placed = F.array_sort(F.transform("_windows", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    df = df.withColumn("_places", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), placed))

    def same(i: Column, step: int) -> Column:
        return F.coalesce(F.get("_places", i)["h"] == F.get("_places", i + step)["h"], F.lit(False))

    twice = F.transform(F.filter("_places", lambda x, i: same(i, 1) | same(i, -1)), lambda x: x["i"])
    df = df.withColumn("_twice", F.array_sort(twice))
    pairs = F.size("_twice") - 1
    gaps = F.zip_with(F.slice("_twice", 2, pairs), F.slice("_twice", 1, pairs), lambda b, a: F.least(b - a, F.lit(window)))
    covered = F.aggregate(gaps, F.lit(window), lambda total, x: total + x)
    covered = F.when(F.col("_twice").isNotNull(), covered)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_windows", "_places", "_twice")


def base_columns(df: DataFrame) -> DataFrame:
    """Adds the base figures to a table with ``text``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    out = df.withColumns({"_words": words_of(text), "_lines": lines})
    out = out.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        }
    )
    out = _with_repeats(out).drop("_words", "_lines")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def with_ngrams(df: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Adds ``_grams`` to a table with ``text``: the buckets of all runs of one and two tokens."""
    tokens = F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(TOKENS), F.lit(0))
    df = df.withColumn("_hashes", F.transform(tokens, lambda t: F.xxhash64(t)))
    pairs = F.greatest(F.size("_hashes") - 1, F.lit(0))
    joined = F.zip_with(F.slice("_hashes", 1, pairs), F.slice("_hashes", 2, pairs), lambda a, b: F.xxhash64(a, b))
    grams = F.transform(F.concat("_hashes", joined), lambda h: F.pmod(h, F.lit(buckets)).cast("int"))
    return df.withColumn("_grams", grams).drop("_hashes")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The documents labelled good and not toxic."""
    good = F.coalesce((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), F.lit(False))
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("trusted_id")).agg(F.min(good).alias("good"))
    return known.where("good").select("trusted_id")


def maybe_trusted(narrow: DataFrame, trusted: DataFrame) -> DataFrame:
    """``narrow`` with ``maybe``: true for all rows whose doc_id is trusted, and for few others."""
    # As text, the numbers of both tables hash alike whatever their types.
    keys = trusted.select(F.xxhash64(F.col("trusted_id").cast("string")).alias("_key"))
    keyed = narrow.withColumn("_key", F.xxhash64(F.col("doc_id").cast("string")))
    return marked(keyed, keys, trusted.count(), key="_key", flag="maybe").drop("_key")


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> tuple[list[int], int]:
    """Log-ratio of each bucket in thousandths, and the least mean that passes."""
    narrow = columns(docs, doc_id=id_col, text=text_col)
    trusted = written(trusted_ids(labels), "trusted")
    maybe = maybe_trusted(narrow, trusted)
    # Only texts of documents that may be trusted are shuffled.
    told = maybe.where("maybe").join(trusted, F.col("doc_id") == F.col("trusted_id"), "left").select("text", F.col("trusted_id").isNotNull().alias("target"))
    told = told.unionByName(maybe.where("not maybe").select("text", F.lit(False).alias("target")))
    # The outer form, as the plain one would test the array's size first and so compute it twice.
    grams = with_ngrams(told, buckets).select("target", F.explode_outer("_grams").alias("bucket"))
    counts = grams.where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("raw"), F.count(F.when(F.col("target"), 1)).alias("goal"))
    raw, goal = [0] * buckets, [0] * buckets
    for row in counts.collect():
        raw[row["bucket"]], goal[row["bucket"]] = row["raw"], row["goal"]
    scores = bucket_scores(raw, goal)
    if not any(goal):
        return scores, 0
    means = with_mean_score(maybe.where("maybe"), scores).select("doc_id", "mean_score")
    passed = means.join(trusted, F.col("doc_id") == F.col("trusted_id"), "left_semi")
    cut = passed.agg(F.percentile("mean_score", F.lit(QUANTILE))).first()[0]
    return scores, math.floor(cut or 0) - SLACK


def bucket_scores(raw: list[int], goal: list[int]) -> list[int]:
    """Log-ratios in thousandths, drawn towards 0 by a fixed zone and two standard errors."""
    total, target = sum(raw) + len(raw), sum(goal)
    if not target:
        return [0] * len(raw)
    scores = []
    for r, g in zip(raw, goal):
        share = (r + 1) / total
        ratio = math.log((g + SMOOTHING * target * share) / (target * (1 + SMOOTHING)) / share)
        scores.append(round(1000 * math.copysign(max(abs(ratio) - DEAD_ZONE - 2 / math.sqrt(g + 1), 0), ratio)))
    return scores


def with_mean_score(df: DataFrame, scores: list[int]) -> DataFrame:
    """Adds ``mean_score``: the mean log-ratio of the n-grams in thousandths, rounded down; null without n-grams."""
    # A constant of a few kilobytes, folded once by the optimizer.
    table = F.split(F.lit(",".join(map(str, scores))), ",").cast("array<int>")
    total = F.aggregate("_grams", F.lit(0).cast("long"), lambda acc, g: acc + F.get(table, g))
    mean = F.floor(total / F.nullif(F.size("_grams"), F.lit(0))).cast("long")
    return with_ngrams(df, len(scores)).withColumn("mean_score", mean).drop("_grams")


def judged(df: DataFrame, scores: list[int], least: int) -> DataFrame:
    """Adds the base figures, ``mean_score`` and ``kept`` to a table with ``text``."""
    out = with_mean_score(base_columns(df), scores)
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce("mean_score", F.lit(0)) >= least))


def judge(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base figures, base_failed, mean_score and kept of every document."""
    scores, least = fit(docs, labels, id_col=id_col, text_col=text_col)
    return judged(columns(docs, doc_id=id_col, text=text_col), scores, least).drop("text")


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) that pass, with their columns as they are."""
    scores, least = fit(docs, labels)
    # The row is carried whole, so no column of it can clash with the figures.
    held = docs.select(F.struct("*").alias("row")).select("row", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"))
    # A filter is pushed below deterministic columns, which would copy their expressions into each other; not below this one.
    found = judged(held, scores, least).select("row", "kept", F.monotonically_increasing_id().alias("_at"))
    return found.where("kept and _at >= 0").select("row.*")
