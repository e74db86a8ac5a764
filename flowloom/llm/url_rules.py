"""URL filters: fixed host and path rules, and mined association rules for the rest.

FP-growth finds token combinations of labelled URLs; those that imply a label with enough support and
confidence are kept, and of these only the ones that no rule with fewer tokens makes useless. Tokens that always
occur together are one item to it, so URLs of many words that come in many copies stay cheap. An inverted index from item to
rule finds the rules whose items a URL has all of; the most confident rule decides. Tokens are the host's
suffixes, the words of host and path, and the words of the query string: one per place, so ``host:net`` is
not ``path:net``.

Everything is DataFrame operations and Spark's own FP-growth.

Cases: a null URL, or one without ``://``, has an empty host and path, fits no rule and has no tokens; it and a URL that no mined
rule fits get the default verdict; repeated rows each get a row, and equal ids with one URL
share it; ties between rules go to more support, then fewer tokens, then the verdict and the tokens in
order; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.inputs import columns, written

# Fixed values: (rule, verdict); a rule is a host and a path that begins with "/".
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
SUPPORT = 0.01
CONFIDENCE = 0.8
BROADCAST_RULES = 50_000
DEFAULT = "allow"


def split_url(url: Column) -> dict[str, Column]:
    """Host (A-Z lower-cased) and path of a URL; empty where there is none."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return {
        "host": F.coalesce(F.translate(host, upper, upper.lower()), F.lit("")),
        "path": F.coalesce(F.regexp_extract(tail, r"^[^?#]*", 0), F.lit("")),
    }


def fixed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null without one."""
    rule = verdict = F.lit(None).cast("string")
    for text, outcome in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, begin = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + begin)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, outcome).otherwise(verdict)
    return rule, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)

    def named(kind: str, words: Column) -> Column:
        return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.concat(F.lit(kind + ":"), w))

    words = [named("host", suffixes), named("path", F.split(path, r"[^\p{L}\p{N}]+")), named("query", F.split(query, r"[^\p{L}\p{N}=]+"))]
    return F.when(host != "", F.array_distinct(F.concat(*words))).otherwise(F.array().cast("array<string>"))


RULES_SCHEMA = "classes array<string>, outcome string, confidence double, support double, rule_id long"


def token_classes(baskets: DataFrame, least: float) -> DataFrame:
    """(token, class) of the tokens that ``least`` rows of (row, token) hold; a class is named by its smallest token.

    Tokens of one class stand in the same rows, told by 128 bits of sums of row hashes. Itemsets of a class are all
    alike, so mining classes gives what mining tokens would, without an itemset for each choice of tokens.
    """
    wide = "decimal(38,0)"
    sums = [F.sum(F.xxhash64(*own).cast(wide)).alias(n) for own, n in ((["row"], "one"), ([F.lit(1), "row"], "two"))]
    frequent = baskets.groupBy("token").agg(F.count("*").alias("n"), *sums).where(F.col("n") >= least)
    names = frequent.groupBy("n", "one", "two").agg(F.min("token").alias("class"))
    return written(frequent.join(names, ["n", "one", "two"]).select("token", "class"), "url-classes")


def mine(labelled: DataFrame, *, support: float = SUPPORT, confidence: float = CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """Rules (classes, outcome, confidence, support, rule_id) of a table (items: tokens, outcome), and the token classes.

    Rare tokens are left out before mining by the same support, so no task meets an unpruned item.
    """
    labelled = written(labelled.where("outcome is not null").withColumn("row", F.monotonically_increasing_id()), "url-labelled")
    rows, spark = labelled.count(), labelled.sparkSession
    if not rows:
        return spark.createDataFrame([], RULES_SCHEMA), spark.createDataFrame([], "token string, class string")
    held = labelled.select("row", F.explode("items").alias("token"))
    classes = token_classes(held, support * rows)
    own = held.join(classes, "token").groupBy("row").agg(F.collect_set("class").alias("classes"))
    label = F.array(F.concat(F.lit("label:"), "outcome"))
    baskets = labelled.select("row", "outcome").join(own, "row", "left")
    baskets = written(baskets.select(F.concat(F.coalesce("classes", F.array().cast("array<string>")), label).alias("items")), "url-baskets")
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    known = ~F.exists("antecedent", lambda t: t.startswith("label:"))
    found = model.associationRules.where(F.element_at("consequent", 1).startswith("label:") & known)
    outcome = F.substring(F.element_at("consequent", 1), 7, 1 << 20).alias("outcome")
    rules = found.select(F.array_sort("antecedent").alias("classes"), outcome, F.round("confidence", 9).alias("confidence"), F.round("support", 9).alias("support"))
    sets = model.freqItemsets.where(~F.exists("items", lambda t: t.startswith("label:"))).select(F.array_sort("items").alias("classes"))
    rules = written(rules.withColumn("rule_id", F.xxhash64("classes", "outcome")), "url-rules")
    return pruned(rules, written(sets, "url-sets")), classes


def pruned(rules: DataFrame, sets: DataFrame) -> DataFrame:
    """Rules without those that a rule with fewer of their classes equals or betters in confidence.

    ``sets`` are all frequent sets of classes, so each set finds the best confidence inside it with the sets of one class
    less, level by level; no rule meets another by a shared class.
    """
    # At most 1 / support labels have rules.
    outcomes = [r["outcome"] for r in rules.select("outcome").distinct().collect()]
    if not outcomes:
        return rules
    every = sets.select("classes", F.explode(F.array(*[F.lit(o) for o in outcomes])).alias("outcome")).join(rules.select("classes", "outcome", "confidence"), ["classes", "outcome"], "left")
    every = written(every.withColumn("n", F.size("classes")), "url-levels")
    levels = every.agg(F.max("n")).first()[0] or 0
    best, kept = None, []
    for n in range(1, levels + 1):
        level = every.where(F.col("n") == n)
        if best is None:
            level = level.withColumn("inside", F.lit(None).cast("double"))
        else:
            parts = F.explode(F.transform("classes", lambda c: F.array_except("classes", F.array(c)))).alias("part")
            inside = level.select("classes", "outcome", parts).join(best.select(F.col("classes").alias("part"), "outcome", F.col("best").alias("of_part")), ["part", "outcome"])
            level = level.join(inside.groupBy("classes", "outcome").agg(F.max("of_part").alias("inside")), ["classes", "outcome"], "left")
        best = written(level.withColumn("best", F.greatest("confidence", "inside")), "url-best")
        kept.append(best.where(F.col("confidence").isNotNull() & ~F.coalesce(F.col("inside") >= F.col("confidence"), F.lit(False))).select("classes", "outcome"))
    return rules if not kept else written(rules.join(reduce(DataFrame.unionByName, kept), ["classes", "outcome"], "left_semi").select(*rules.columns), "url-rules-kept")


def matched(urls: DataFrame, rules: DataFrame, classes: DataFrame) -> DataFrame:
    """The mined outcome for each distinct ``url`` of (url, items): inverted index, then the best complete rule.

    A URL has a class if it holds any of its tokens: rules of single tokens of a class say the same.
    """
    index = rules.select("rule_id", "outcome", "confidence", "support", F.size("classes").alias("n"), F.explode("classes").alias("class"))
    index = written(index, "url-index")
    if index.count() <= BROADCAST_RULES:
        index = F.broadcast(index)
    held = urls.select("url", F.explode("items").alias("token")).join(classes, "token").select("url", "class").distinct()
    hits = held.join(index, "class")
    whole = hits.groupBy("url", "rule_id", "outcome", "confidence", "support", "n").agg(F.count("*").alias("met")).where("met = n")
    best = F.max(F.struct("confidence", "support", (-F.col("n")).alias("less"), "outcome", "rule_id")).alias("best")
    return whole.groupBy("url").agg(best).select("url", F.col("best.outcome").alias("mined"), F.col("best.rule_id").alias("mined_rule"), F.col("best.confidence").alias("mined_confidence"))


def judge(
    pages: DataFrame,
    labels: DataFrame | None = None,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: Sequence[tuple[str, str]] = RULES,
    support: float = SUPPORT,
    confidence: float = CONFIDENCE,
    default: str = DEFAULT,
) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rule and mined_confidence of each row.

    ``labels`` (url, outcome) teach the mined rules; without them the URLs that the fixed rules decide do,
    so that the mined rules carry the fixed ones on to URLs of the same make.
    """
    narrow = columns(pages, page_id=id_col, url=url_col)
    narrow = narrow.withColumns(split_url(F.col("url")))
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    narrow = written(narrow.withColumns({"rule": rule, "fixed": verdict}), "url-fixed")
    if labels is None:
        taught = narrow.where("fixed is not null").select(tokens(F.col("url"), F.col("host"), F.col("path")).alias("items"), F.col("fixed").alias("outcome"))
    else:
        parts = columns(labels, url="url", outcome="outcome").withColumns(split_url(F.col("url")))
        taught = parts.select(tokens(F.col("url"), F.col("host"), F.col("path")).alias("items"), "outcome")
    open_ = narrow.where("fixed is null and host <> ''").select("url", "host", "path").distinct()
    open_ = open_.select("url", tokens(F.col("url"), F.col("host"), F.col("path")).alias("items"))
    found = matched(open_, *mine(taught, support=support, confidence=confidence))
    undecided = narrow.where("fixed is null").join(found, "url", "left")
    decided = narrow.where("fixed is not null").withColumns({"mined": F.lit(None).cast("string"), "mined_rule": F.lit(None).cast("long"), "mined_confidence": F.lit(None).cast("double")})
    both = decided.unionByName(undecided.select(*decided.columns))
    return both.select("page_id", "host", "path", "rule", F.coalesce("fixed", "mined", F.lit(default)).alias("verdict"), "mined_rule", "mined_confidence")
