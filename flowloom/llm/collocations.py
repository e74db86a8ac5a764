"""Phrase collocation mining over a prefix-free parse of the corpus.

A text is lower-cased (A-Z) and cut at punctuation and line breaks into pieces, and these at blanks into words. Each
piece is cut again into chunks where the content says so: a chunk ends before three words whose hash
meets a condition, and carries these three words as overlap, so that every run of up to four words lies
whole in the chunk in which it begins. Equal contents are cut alike wherever they stand: copies, boilerplate
and repeated passages give the same chunks, and the corpus becomes a dictionary of distinct chunks with
their frequencies. All counting is done inside distinct chunks, weighed by frequency; runs that begin in
the overlap belong to the next chunk and are counted there only.

Runs of one to four words are counted level by level. Per level, 64-bit hashes of the runs are summed; those that
reach the least frequency are set in a bitmap, which the next level asks about the two shorter runs inside a
longer one. Different runs with one hash, and the bitmap's bounded size, can only let more pass: the runs that
pass are then counted by their words, and these exact counts decide.

Cases: a null text is an empty one; a null language is ``und``; ids play no role, so repeated rows count again; equal
scores go by frequency, then by phrase in UTF-8 byte order; texts without blanks or punctuation are one word of any
length; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.inputs import columns, written
from flowloom.llm.tokens import Numbered, text_bytes
from flowloom.session import ship_package

WORDS = 4
OVERLAP = WORDS - 1
TRIGGER = 32
GATHER_BYTES = 8 << 20
GATHER_WORDS = 1 << 20
MOST_BITS = 1 << 28
# Phrases that a task adds up before it hands them on.
MOST_HELD = 1 << 19
# Fixed rule: A-Z lower-cased, tab to blank, what ends a piece to a full stop.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 46 if b in b".,;:!?" or 10 <= b <= 13 else 32 if b == 9 else b for b in range(256))
BREAK = b"."
DICTIONARY = "lang string, chunk string, goes_on boolean, frequency long, hashes binary"


class Words:
    """Words of one batch by number; number 0 is the full stop, which ends a piece."""

    def __init__(self, words: list[bytes]) -> None:
        self.words = words
        known = Numbered()
        known[BREAK] = 0
        self.number = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        self.known = list(known)

    def hash(self) -> np.ndarray:
        """32 bits of each word."""
        return np.fromiter((xxhash.xxh32_intdigest(w) for w in self.known), np.uint32, len(self.known))[self.number]


def left_in_piece(stops: np.ndarray) -> np.ndarray:
    """For each place, the words from it to the end of its piece, itself included; 0 at a stop."""
    ends = np.append(np.flatnonzero(stops), len(stops))
    return ends[np.cumsum(stops) - stops] - np.arange(len(stops))


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of pairs, order counting."""
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ b
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def chunk_bounds(words: Words, trigger: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end (overlap included) of each chunk, and whether it has an overlap."""
    count, stops = len(words.number), words.number == 0
    left, hashed = left_in_piece(stops), words.hash().astype(np.uint64)
    cut = np.zeros(count, bool)
    window = np.flatnonzero(left >= OVERLAP)
    shape = hashed[window]
    for j in range(1, OVERLAP):
        shape = mixed(shape, hashed[window + j])
    cut[window] = shape % np.uint64(trigger) == 0
    first = np.concatenate([[True], stops[:-1]]) if count else stops
    begin = np.flatnonzero(~stops & (first | cut))
    after = np.append(begin[1:], count)
    goes_on = np.zeros(len(begin), bool)
    goes_on[:-1] = ~first[begin[1:]]
    return begin, np.where(goes_on, after + OVERLAP, begin + left[begin]), goes_on


def parse(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", trigger: int = TRIGGER) -> DataFrame:
    """The dictionary, written: distinct chunks of all documents with their frequencies.

    A chunk is its words with a blank behind each, and a full stop. ``hashes`` has 32 bits of each word.
    """
    ship_package(docs.sparkSession)
    narrow = columns(docs, text=text_col, lang=lang_col)
    narrow = narrow.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, texts in held.items():
                words = Words(BREAK.join(texts).translate(_FOLD).replace(BREAK, b" . ").split())
                own, join = words.words, b" ".join
                begin, end, goes_on = chunk_bounds(words, trigger)
                for on in (False, True):
                    counts = Counter(join(own[a:b]) for a, b in zip(begin[goes_on == on].tolist(), end[goes_on == on].tolist()))
                    chunk = pa.array(counts.keys(), pa.binary()).cast(pa.string())
                    arrays = [pa.array([lang] * len(counts), pa.string()), chunk, pa.array(np.full(len(counts), on)), pa.array(counts.values(), pa.int64())]
                    yield pa.RecordBatch.from_arrays(arrays, ["lang", "chunk", "goes_on", "frequency"])

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                held.setdefault(lang, []).append(raw := text.encode())
                size += len(raw)
                if size > GATHER_BYTES:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(_raw(batch.column("chunk")).split())
            stops = words.number == 0
            ends = np.concatenate([[0], 4 * np.cumsum(~stops)[stops]]).astype(np.int32)
            hashes = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(words.hash()[~stops].tobytes())])
            yield pa.RecordBatch.from_arrays([*batch.columns, hashes], [*batch.schema.names, "hashes"])

    parts = narrow.mapInArrow(run, "lang string, chunk string, goes_on boolean, frequency long")
    parts = parts.groupBy("lang", "chunk", "goes_on").agg(F.sum("frequency").alias("frequency"))
    return written(parts.withColumn("chunk", F.concat("chunk", F.lit(" . "))).select("lang", "chunk", "goes_on", "frequency").mapInArrow(hashed, DICTIONARY), "chunks")


def _raw(array: pa.Array) -> bytes:
    """All strings of an array, one behind the other."""
    return text_bytes(array)[0].tobytes()


class Bitmap:
    """Hashes of frequent runs of one length; may say yes to others."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits, self.mask = bits, np.uint64(8 * len(bits) - 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & self.mask
        return self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 > 0


def bitmap(hashes: DataFrame) -> Bitmap:
    """A bitmap of the column ``h``, 32 bits a row up to ``MOST_BITS`` (32 MB), which bounds what the driver gets."""
    bits = min(MOST_BITS, max(1 << 15, 1 << (32 * hashes.count() - 1).bit_length()))
    at = F.col("h").bitwiseAND(F.lit(bits - 1)) + 1
    parts = hashes.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = np.zeros((bits >> 15, 4096), np.uint8)
    for part in parts.toLocalIterator():
        out[part["bucket"] - 1] = np.frombuffer(part["bits"], np.uint8)
    return Bitmap(out.ravel())


class Chunks:
    """Rows of the dictionary as one array of words: hash of each, row, and whether a run may begin there."""

    def __init__(self, batches: list[pa.RecordBatch]) -> None:
        table = pa.Table.from_batches(batches)
        self.table = table
        binary = table.column("hashes").combine_chunks()
        bounds = np.frombuffer(binary.buffers()[1], np.int32, len(binary) + 1, 4 * binary.offset)
        words = np.frombuffer(binary.buffers()[2], np.uint32, (bounds[-1] - bounds[0]) // 4, bounds[0])
        size = np.diff(bounds) // 4
        langs = table.column("lang").combine_chunks().dictionary_encode()
        self.langs, self.lang = langs.dictionary.to_pylist(), langs.indices.to_numpy()
        salt = np.array([xxhash.xxh3_64_intdigest(lang) for lang in self.langs], np.uint64)
        self.row = np.repeat(np.arange(len(size)), size)
        self.hash = mixed(np.repeat(salt[self.lang], size), words.astype(np.uint64))
        ends = np.cumsum(size)
        self.left = ends[self.row] - np.arange(len(words))
        on = table.column("goes_on").to_numpy()
        # Runs that begin in the overlap are the next chunk's.
        self.own = self.left > np.where(on, OVERLAP, 0)[self.row]
        self.weight = table.column("frequency").to_numpy()[self.row]

    def runs(self, frequent: list[Bitmap], length: int) -> tuple[np.ndarray, np.ndarray]:
        """Begin and hash of the runs of ``length`` words whose shorter runs pass, as far as these are known."""
        at = np.flatnonzero(self.own & (self.left >= length))
        hashed = self.hash[at]
        for n in range(1, length):
            if n <= len(frequent):
                passes = frequent[n - 1].has(hashed)
                at, hashed = at[passes], hashed[passes]
            hashed = mixed(hashed, self.hash[at + n])
        if 1 < length <= len(frequent) + 1:
            # The run without its first word.
            tail = self.hash[at + 1]
            for n in range(2, length):
                tail = mixed(tail, self.hash[at + n])
            passes = frequent[length - 2].has(tail)
            at, hashed = at[passes], hashed[passes]
        return at, hashed


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, a place of each, and the sums of their weights."""
    order = np.argsort(keys)
    keys = keys[order]
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[begin], order[begin], np.add.reduceat(weights[order], begin) if len(begin) else weights[:0]


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunks]:
    """Chunks with some million words at a time."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column("hashes").nbytes // 4
        if size > GATHER_WORDS:
            yield Chunks(held)
            held, size = [], 0
    if held:
        yield Chunks(held)


def hash_counts(dictionary: DataFrame, frequent: list[Bitmap], length: int) -> DataFrame:
    """(h, n, word): occurrences of the runs of one length, by hash.

    The pass that knows frequent pairs first gives the words of these as well, marked by ``word`` and without a count.
    """
    spread = dictionary.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunks in _gathered(batches):
            at, hashed = chunks.runs(spread.value, length)
            keys, _, sums = _summed(hashed, chunks.weight[at])
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(sums), pa.array(np.zeros(len(keys), bool))], ["h", "n", "word"])
            if length == 3:
                pairs, own = chunks.runs(spread.value[:1], 2)
                pairs = pairs[spread.value[1].has(own)]
                words = np.unique(chunks.hash[np.concatenate([pairs, pairs + 1])]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(np.zeros(len(words), np.int64)), pa.array(np.ones(len(words), bool))], ["h", "n", "word"])

    narrow = dictionary.select("lang", "goes_on", "frequency", "hashes")
    return narrow.mapInArrow(run, "h long, n long, word boolean").groupBy("h", "word").agg(F.sum("n").alias("n"))


def phrase_counts(dictionary: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, words, f): the runs of two to four words that occur ``least`` times or more, and their words, written."""
    frequent: list[Bitmap] = []
    for length in range(1, WORDS):
        reached = written(hash_counts(dictionary, frequent, length).where(F.col("word") | (F.col("n") >= least)).select("h", "word"), "frequent-runs")
        frequent.append(bitmap(reached.where("not word").select("h")))
    # Of single words only those of frequent pairs are part of a phrase.
    wanted = bitmap(reached.where("word").select("h"))
    spread = dictionary.sparkSession.sparkContext.broadcast((frequent, wanted))

    def told(held: dict[tuple[str, bytes], int]) -> pa.RecordBatch:
        langs, phrases = zip(*held) if held else ((), ())
        lengths = pa.array([p.count(b" ") + 1 for p in phrases], pa.int32())
        arrays = [pa.array(langs, pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), lengths, pa.array(held.values(), pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, ["lang", "phrase", "words", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, bytes], int] = {}
        for chunks in _gathered(batches):
            words = Words(_raw(chunks.table.column("chunk").combine_chunks()).split())
            real = np.flatnonzero(words.number)
            exact_word, own, join, many = words.number[real], words.words, b" ".join, len(words.known)
            # Numbered exactly: a word by its language and itself, a longer run by that without its last word, and this one.
            number = chunks.lang[chunks.row].astype(np.int64) * many + exact_word
            frequent, wanted = spread.value
            for length in range(1, WORDS + 1):
                at, hashed = chunks.runs(frequent, length)
                passes = number[at] >= 0
                if length <= len(frequent):
                    passes &= (frequent[length - 1] if length > 1 else wanted).has(hashed)
                at = at[passes]
                if length == 1:
                    sums = np.bincount(number[at], chunks.weight[at], len(chunks.langs) * many)
                    keys = np.flatnonzero(sums)
                    sums, lang = sums[keys].astype(np.int64), keys // many
                    phrases = [words.known[i] for i in (keys % many).tolist()]
                    passing = np.full(len(number), -1)
                    passing[at] = number[at]
                else:
                    exact = number[at] * many + exact_word[at + length - 1]
                    keys, place, sums = _summed(exact, chunks.weight[at])
                    phrases = [join(own[i : i + length]) for i in real[at[place]].tolist()]
                    lang, passing = chunks.lang[chunks.row[at[place]]], np.full(len(number), -1)
                    passing[at] = np.searchsorted(keys, exact)
                number = passing
                for key, n in zip(zip(map(chunks.langs.__getitem__, lang.tolist()), phrases), sums.tolist()):
                    held[key] = held.get(key, 0) + n
            if len(held) > MOST_HELD:
                yield told(held)
                held = {}
        yield told(held)

    # A few long tasks for each core, as each gives a row for every phrase that it meets.
    few = dictionary.coalesce(3 * dictionary.sparkSession.sparkContext.defaultParallelism)
    parts = few.mapInArrow(run, "lang string, phrase string, words int, f long")
    counted = parts.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return written(counted, "phrases")


def _part(words: Column, begin: int, count: int) -> Column:
    return F.array_join(F.slice(words, begin, count), " ")


def mine(
    docs: DataFrame,
    *,
    least: int = 30,
    covered: int = 80,
    first: int = 2000,
    text_col: str = "text",
    lang_col: str = "lang",
    trigger: int = TRIGGER,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: each language's best phrases of two to four words.

    a, l and r are the frequencies of a phrase and of its two parts at the cut where 2000000 a / (l + r) is least, and n
    the language's words. A phrase goes if a longer frequent one around it has ``covered`` percent of
    its frequency.
    """
    dictionary = parse(docs, text_col=text_col, lang_col=lang_col, trigger=trigger)
    counts = phrase_counts(dictionary, least)
    in_chunk = F.expr("length(hashes) div 4") - F.when(F.col("goes_on"), OVERLAP).otherwise(0)
    totals = dictionary.groupBy("lang").agg(F.sum(in_chunk * F.col("frequency")).alias("n"))
    long_ = counts.where("words > 1").withColumn("w", F.split("phrase", " "))

    inner = [(i, n) for n in range(2, WORDS) for i in range(1, WORDS - n + 2)]
    within = F.explode(F.filter(F.array(*[F.when(F.size("w") >= F.lit(i + n - 1), F.when(F.size("w") > n, _part(F.col("w"), i, n))) for i, n in inner]), lambda p: p.isNotNull()))
    around = long_.where("words > 2").select("lang", within.alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("around"))
    alone = long_.join(around, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("around") < covered * F.col("f"), F.lit(True)))

    cuts = F.array(*[F.when(F.size("w") > k, F.struct(F.lit(k).alias("k"), _part(F.col("w"), 1, k).alias("left"), F.expr(f"array_join(slice(w, {k + 1}, size(w) - {k}), ' ')").alias("right"))) for k in range(1, WORDS)])
    cut = alone.select("lang", "phrase", F.col("f").alias("a"), F.inline(F.filter(cuts, lambda c: c.isNotNull())))
    for side, name in (("left", "l"), ("right", "r")):
        cut = cut.join(counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    score = F.expr("cast(cast(a as decimal(19, 0)) * 2000000 div (cast(l as decimal(19, 0)) + r) as bigint)")
    worst = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("worst")
    scored = cut.groupBy("lang", "phrase", "a").agg(worst).select("lang", "phrase", "a", "worst.l", "worst.r", "worst.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
