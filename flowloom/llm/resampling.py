"""Quality classifier by importance resampling.

Two generative models of hashed n-grams (runs of one and two tokens), one of trusted target texts and
one of all raw texts, give each document the log of their likelihood ratio. Documents are drawn by
Gumbel top-k: each gets its log-ratio plus Gumbel noise from a keyed hash, and the k largest stay.
k is the number of documents whose log-ratio is not below that of the trusted ones: their 0.5 %
quantile less 5. The raw model, k and the k-th largest key cover every document; the target model and
the quantile are fitted on at most ``target_rows`` labelled ones. A bucket's log-ratio is drawn
towards 0, by 1 and two standard errors, so that sampling noise and the mix of languages among the
labelled do not add up over long texts.

A sum over a long text hides a few telling n-grams, so labelled good documents are also held against labelled
bad ones (quality 0 or toxic), by the number of documents that have an n-gram: if it is surely at least e
times as common among the bad, it is a mark, and weighs the lower bound (two standard errors) of that
log-ratio. Marks are whole n-grams, not buckets; words said over and over count as an n-gram
too. A document whose marks exceed those of 99.5 % of the trusted ones, and ``LEAST_HOLD``, is held back: it is
not drawn, and its log-ratio is at most 0, less its marks.

Tokens are runs of letters, digits and non-ASCII characters, or of punctuation.

Cases: a null text is an empty one with log-ratio 0; repeated rows have equal keys and share their
fate; rows that tie with the k-th largest key all stay; no labels or no target documents: all ratios
are 0 and all stay; an empty table gives an empty result; extra columns are kept by ``select``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.inputs import in_slices, texts, tidied, written
from flowloom.llm.tokens import POWERS, text_bytes
from flowloom.session import ship_package

BUCKETS = 1 << 14
TARGET_ROWS = 20_000
# Weight of the raw model in the target model, share of trusted documents below the cut, and its slack.
SMOOTHING, DEAD_ZONE = 0.05, 1.0
QUANTILE, SLACK = 0.005, 5.0
# Bad documents that a mark is in at least, the most marks tried (the most frequent), the least log-ratio of a
# mark, standard errors, and the weight of marks that never holds a document back.
LEAST_BAD, LEAST_MARK, ERRORS, LEAST_HOLD = 5, 1.0, 2.0, 2.0
# A run of so many tokens, each of them equal to the one two before, is one more n-gram.
RUN = 8
HELD_KEY = -(1 << 62)
TEMPERATURE = 0.25
SEED = 17
# Fixed rule: 0 white space, 1 letters, digits and bytes of other scripts, 2 punctuation.
_KIND = np.array([0 if b <= 32 else 1 if b >= 128 or chr(b).isalnum() else 2 for b in range(256)], np.int8)
_CODE = np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Ngrams:
    """Buckets of all n-grams of a batch of texts at once, by their UTF-8 bytes."""

    def __init__(self, buckets: int = BUCKETS) -> None:
        self.buckets, self.tokens = np.uint64(buckets), 0

    def __call__(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bucket of each n-gram, and the text it is from; the first ``tokens`` are the single ones, in order."""
        data, bounds = text_bytes(array)
        POWERS.reach(len(data) + 1)
        kind = _KIND[data]
        begins = np.ones(len(data), bool)
        begins[1:] = kind[1:] != kind[:-1]
        begins[bounds[:-1][bounds[:-1] < len(data)]] = True
        begin = np.flatnonzero(begins)
        end = np.append(begin[1:], len(data))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CODE[data] * POWERS.up[: len(data)], dtype=np.uint64)])
        key = _mix((sums[end] - sums[begin]) * POWERS.down[begin])
        real = kind[begin] > 0
        begin, key = begin[real], key[real]
        text = np.searchsorted(bounds, begin, side="right") - 1
        pair = _mix(key[:-1] * np.uint64(3) + key[1:] * np.uint64(5))[text[1:] == text[:-1]]
        of_pair = text[1:][text[1:] == text[:-1]]
        self.tokens = len(key)
        return (np.concatenate([key, pair]) % self.buckets).astype(np.int64), np.concatenate([text, of_pair])


def distinct_ngrams(ngrams: Ngrams, array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of each text, each once, and the text; with n-gram 0 for a run. ``ngrams`` has 2 ** 62 buckets."""
    key, text = ngrams(array)
    single, of = key[: ngrams.tokens], text[: ngrams.tokens]
    same = (single[2:] == single[:-2]) & (of[2:] == of[:-2])
    before = np.concatenate([[0], np.cumsum(same)])
    runs = np.unique(of[2:][RUN - 1 :][before[RUN:] - before[:-RUN] == RUN]) if len(same) >= RUN else np.zeros(0, text.dtype)
    key, text = np.concatenate([key, np.zeros(len(runs), np.int64)]), np.concatenate([text, runs])
    order = np.lexsort((key, text))
    key, text = key[order], text[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
    return key[new], text[new]


def mark_weights(bad: np.ndarray, good: np.ndarray, n_bad: int, n_good: int) -> np.ndarray:
    """Weights of n-grams by how many bad and good documents have them; 0 where it is no mark."""
    ratio = np.log((bad + 0.5) / (n_bad + 1)) - np.log((good + 0.5) / (n_good + 1))
    least = ratio - ERRORS * np.sqrt(1 / (bad + 0.5) + 1 / (good + 0.5))
    return np.where((bad >= LEAST_BAD) & (least >= LEAST_MARK), least, 0.0)


def mark_sums(ngrams: Ngrams, marks: np.ndarray, weights: np.ndarray, array: pa.Array) -> np.ndarray:
    """The weight of all marks of each text; ``marks`` are sorted."""
    if not len(marks):
        return np.zeros(len(array))
    key, text = distinct_ngrams(ngrams, array)
    at = np.minimum(np.searchsorted(marks, key), len(marks) - 1)
    return np.bincount(text, np.where(marks[at] == key, weights[at], 0.0), len(array)).astype(np.float64)


@dataclass
class Resampler:
    """The fitted models, the marks (sorted) with their weights and limit, and the smallest key that stays."""

    ratio: np.ndarray
    least_key: int
    temperature: float
    seed: int
    marks: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    limit: float = np.inf

    def ngrams(self) -> tuple[Ngrams, Ngrams]:
        return Ngrams(len(self.ratio)), Ngrams(1 << 62)

    def judge(self, ngrams: tuple[Ngrams, Ngrams], array: pa.Array, ids: np.ndarray) -> tuple[np.ndarray, ...]:
        """Log-ratio, n-grams, key and weight of marks of each text."""
        log_ratio, n = log_ratios(ngrams[0], self.ratio, array)
        marked = mark_sums(ngrams[1], self.marks, self.weights, array)
        held = marked > self.limit
        log_ratio = np.where(held, np.minimum(log_ratio, 0) - marked, log_ratio)
        return log_ratio, n, np.where(held, HELD_KEY, keys(log_ratio, ids, self.temperature, self.seed)), marked


def gumbel(ids: np.ndarray, seed: int) -> np.ndarray:
    """Gumbel noise by keyed hash of the ids."""
    h = _mix(ids.astype(np.int64).view(np.uint64) ^ _mix(np.full(1, seed + 1, np.uint64)))
    uniform = ((h >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
    return -np.log(-np.log(uniform))


def log_ratios(ngrams: Ngrams, ratio: np.ndarray, array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    bucket, text = ngrams(array)
    return np.bincount(text, ratio[bucket], len(array)).astype(np.float64), np.bincount(text, minlength=len(array))


def keys(log_ratio: np.ndarray, ids: np.ndarray, temperature: float, seed: int) -> np.ndarray:
    """Log-ratio over temperature plus noise, in millionths."""
    return np.rint(1e6 * (np.clip(log_ratio / temperature, -1e11, 1e11) + gumbel(ids, seed))).astype(np.int64)


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(-1).to_numpy()


def kth_largest(scores: DataFrame, column: str, k: int) -> int:
    """The k-th largest value of a whole column of longs: four counts over 16 bits each, none of them by row."""
    prefix, left = None, k
    value = F.col(column).bitwiseXOR(F.lit(-(1 << 63)))
    for shift in (48, 32, 16, 0):
        own = scores if prefix is None else scores.where(F.shiftrightunsigned(value, shift + 16) == prefix)
        digit = F.shiftrightunsigned(value, shift).bitwiseAND(F.lit(0xFFFF))
        for row in sorted(own.groupBy(digit.alias("digit")).count().collect(), key=lambda r: -r["digit"]):
            if row["count"] >= left:
                prefix = row["digit"] if prefix is None else (prefix << 16) | row["digit"]
                break
            left -= row["count"]
    return prefix - (1 << 63)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_rows: int = TARGET_ROWS,
    temperature: float = TEMPERATURE,
    seed: int = SEED,
    buckets: int = BUCKETS,
) -> Resampler:
    """Both models, k and the smallest key that stays. ``labels`` has doc_id, quality (1 good) and toxic (1 toxic)."""
    good = F.coalesce((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), F.lit(False))
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(good).alias("good"))
    known = written(known, "resample-labels")
    narrow = texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    marks, weights = find_marks(narrow, known, target_rows)
    some = known.where("good").orderBy(F.xxhash64("doc_id"), "doc_id").limit(target_rows).select("doc_id").collect()
    trusted = np.sort(np.array([r["doc_id"] for r in some], np.int64))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ngrams, raw, target = Ngrams(buckets), np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in in_slices(batches, "text"):
            bucket, text = ngrams(batch.column("text"))
            raw += np.bincount(bucket, minlength=buckets)
            is_target = np.isin(_ids(batch.column("doc_id")), trusted)
            target += np.bincount(bucket[is_target[text]], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(raw), pa.array(target)], ["bucket", "raw", "target"])

    counted = narrow.mapInArrow(tidied(count, POWERS.forget), "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, goal = np.zeros(buckets), np.zeros(buckets)
    for r in counted.collect():
        raw[r["bucket"]], goal[r["bucket"]] = r["raw"], r["target"]
    model = Resampler(bucket_ratios(raw, goal), -(1 << 63), temperature, seed)
    if not goal.sum():
        return model
    model.marks, model.weights = marks, weights
    scored = _scores(docs, model, trusted, id_col=id_col, text_col=text_col)
    millionths = [F.round(F.col(c) * 1_000_000).cast("long").alias(name) for c, name in (("log_ratio", "ratio"), ("marked", "marked"))]
    scored = written(scored.select("key", "trusted", *millionths), "resample-keys")
    rows, sure = scored.agg(F.count("*"), F.count(F.when(F.col("trusted"), 1))).first()
    if len(marks):
        limit = max(int(LEAST_HOLD * 1_000_000), kth_largest(scored.where("trusted"), "marked", 1 + int(QUANTILE * sure)))
        # Between two millionths, so that rounding does not part the same sum.
        model.limit = (limit + 0.5) / 1_000_000
        held = F.col("marked") > limit
        scored = scored.select(F.when(held, F.lit(HELD_KEY)).otherwise(F.col("key")).alias("key"), F.col("trusted") & ~held, F.when(~held, F.col("ratio")).alias("ratio")).toDF("key", "trusted", "ratio")
        sure = scored.where("trusted").count()
    floor = kth_largest(scored.where("trusted"), "ratio", sure - int(QUANTILE * sure)) - int(SLACK * 1_000_000)
    k = scored.where(F.col("ratio") >= floor).count()
    if k < rows:
        model.least_key = kth_largest(scored, "key", k)
    return model


def find_marks(narrow: DataFrame, known: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Marks (sorted) and their weights, from at most ``rows`` good and as many bad documents.

    N-grams of bad documents are counted first, and those that enough of them have in good ones; each one that
    qualifies becomes a mark.
    """

    def some(good: bool) -> DataFrame:
        ids = known.where(F.col("good") == good).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("doc_id")
        return narrow.join(F.broadcast(ids), "doc_id", "left_semi")

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ngrams = Ngrams(1 << 62)
        for batch in in_slices(batches, "text"):
            found, often = np.unique(distinct_ngrams(ngrams, batch.column("text"))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(often.astype(np.int64))], ["ngram", "n"])

    def counted(docs: DataFrame) -> DataFrame:
        return docs.mapInArrow(tidied(bags, POWERS.forget), "ngram long, n long")

    tried = counted(some(False)).groupBy("ngram").agg(F.sum("n").alias("bad")).where(F.col("bad") >= LEAST_BAD)
    tried = written(tried, "marks-tried")
    good = counted(some(True)).join(tried.select("ngram"), "ngram", "left_semi").groupBy("ngram").agg(F.sum("n").alias("good"))
    both = tried.join(good, "ngram", "left").fillna(0, ["good"])
    n_bad, n_good = some(False).count(), some(True).count()
    bad_, good_ = F.col("bad") + 0.5, F.col("good") + 0.5
    surely = F.log(bad_ / (n_bad + 1)) - F.log(good_ / (n_good + 1)) - ERRORS * F.sqrt(1 / bad_ + 1 / good_)
    # The sample bounds how many there are; the last digit is left to mark_weights.
    marks = both.where(surely >= LEAST_MARK - 1e-6).orderBy("ngram").toArrow()
    names, bad, good = (marks.column(c).to_numpy() for c in ("ngram", "bad", "good"))
    weights = mark_weights(bad, good, n_bad, n_good)
    return names[weights > 0].copy(), weights[weights > 0]


def bucket_ratios(raw: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """Log of target over raw probability of each bucket, drawn towards 0; all 0 without a target."""
    if not goal.sum():
        return np.zeros(len(raw))
    share = (raw + 1) / (raw + 1).sum()
    ratio = np.log((goal + SMOOTHING * goal.sum() * share) / (goal.sum() * (1 + SMOOTHING))) - np.log(share)
    return np.sign(ratio) * np.maximum(np.abs(ratio) - DEAD_ZONE - 2 / np.sqrt(goal + 1), 0)


def score(docs: DataFrame, model: Resampler, trusted: np.ndarray | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_ngrams, log_ratio, key, trusted (its id is among those given) and kept of each document."""
    return _scores(docs, model, trusted, id_col=id_col, text_col=text_col).drop("marked")


def _scores(docs: DataFrame, model: Resampler, trusted: np.ndarray | None, *, id_col: str, text_col: str) -> DataFrame:
    known = np.zeros(0, np.int64) if trusted is None else trusted
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ngrams = shared.value, shared.value.ngrams()
        for batch in in_slices(batches, "text"):
            ids = _ids(batch.column("doc_id"))
            log_ratio, n, key, marked = own.judge(ngrams, batch.column("text"), ids)
            arrays = [batch.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(log_ratio), pa.array(key), pa.array(np.isin(ids, known)), pa.array(key >= own.least_key), pa.array(marked)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_ngrams", "log_ratio", "key", "trusted", "kept", "marked"])

    narrow = texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return narrow.mapInArrow(tidied(each, POWERS.forget), "doc_id long, n_ngrams long, log_ratio double, key long, trusted boolean, kept boolean, marked double")


def select(docs: DataFrame, model: Resampler, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns; the texts do not move."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ngrams = shared.value, shared.value.ngrams()
        for batch in in_slices(batches, text_col):
            key = own.judge(ngrams, batch.column(text_col).fill_null(""), _ids(batch.column(id_col)))[2]
            yield batch.filter(pa.array(key >= own.least_key))

    return docs.mapInArrow(tidied(each, POWERS.forget), docs.schema)
