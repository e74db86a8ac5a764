"""Document fingerprints: SimHash of weighted terms, and exact search by permuted block tables.

A term is a run of two words; its weight is 16 (1 + ln f), rounded, for f occurrences. Each term's hash
votes with its weight for or against each of 128 bits. A search cuts the bits into blocks: fingerprints
within ``radius`` bits agree in all but ``radius`` of them, so for each choice of blocks that must
agree there is a table keyed by these blocks first. Fewer blocks may be asked to agree: tables are fewer
and groups larger, and none is missed. A pair is found in the first table where it meets.

One changed word in a text of 200 moves some six bits, so near copies are looked for within ``REACH`` bits. The report
gives the fingerprints found with their distances; the documents that have them are those rows of the report.

Cases: a null text is an empty one; a text of one word has that word as its term, and one without words the
fingerprint 0; repeated rows each get a row, and equal ids follow each other in the order of the
hashes of their texts; null ids come first; a lone document is its own next one; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.inputs import in_order, in_slices, task_count, texts, written

WORDS = 2
RADIUS = 3
BLOCKS = 4
REACH, REACH_BLOCKS = 14, 16
GROUP_POINTS = 16_384
DIGEST_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, high long, low long, edited_high long, edited_low long, next_high long, next_low long"
EDGE_SCHEMA = DIGEST_SCHEMA + ", edge int, text string"


def term_votes(text: str, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct term hashes and their integer weights."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashed, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) < size:
        return np.array([hashed(join(words))], np.uint64), np.array([16])
    runs = zip(*[words[i:] for i in range(size)])
    terms, often = np.unique(np.fromiter((hashed(join(r)) for r in runs), np.uint64, len(words) - size + 1), return_counts=True)
    return terms, np.rint(16 * (1 + np.log(often))).astype(np.int64)


def simhash(text: str) -> tuple[int, int]:
    """High and low 64 bits, as signed numbers."""
    terms, weights = term_votes(text)
    if not len(terms):
        return 0, 0
    second = (terms ^ (terms >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    second ^= second >> np.uint64(29)
    bits = np.unpackbits(np.stack([terms, second], 1).astype(">u8").view(np.uint8), axis=1)
    once = weights == 16
    votes = np.zeros(128, np.int64)
    single = bits[once]
    for begin in range(0, len(single), 255):
        votes += single[begin : begin + 255].sum(axis=0, dtype=np.uint8)
    votes = 16 * votes + weights[~once] @ bits[~once].astype(np.int64)
    high, low = np.packbits(2 * votes > weights.sum()).view(">i8").tolist()
    return high, low


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by the first as many characters of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _digest(doc: int | None, text: str, own: tuple[int, int], following: str, theirs: tuple[int, int]) -> tuple:
    changed = edited(text, following)
    return (doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), *own, *simhash(changed), *theirs, 0, None)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32()}
    fields = [c.split() for c in EDGE_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k]) for c, (_, k) in zip(zip(*rows), fields)], [n for n, _ in fields])


def digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text and of the next document's text; a durable table.

    The texts move once, into ranges of ids. Inside a range the next document is the next row; only the
    first and last texts of the ranges are carried on and matched.
    """
    narrow = texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        # Edge rows have the number of their range in place of the edited fingerprint.
        part, last = TaskContext.get().partitionId(), None
        for batch in in_slices(batches, "text"):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                own = simhash(text)
                if last is None:
                    rows.append((doc, len(text), None, *own, part, None, None, None, 1, text))
                else:
                    rows.append(_digest(*last, text, own))
                last = (doc, text, own)
            yield _batch(rows)
        if last is not None:
            yield _batch([(last[0], len(last[1]), None, *last[2], part, None, None, None, 2, last[1])])

    table = written(in_order(narrow).mapInArrow(each, EDGE_SCHEMA), "digests")
    inside = table.where("edge = 0").select(*[c.split()[0] for c in DIGEST_SCHEMA.split(", ")])
    # One first and one last row for each range: their number is that of the tasks.
    parts = sorted(r["edited_high"] for r in table.where("edge = 1").select("edited_high").collect())
    # Ranges do not overlap, so the last row of a range is followed by the first row of the next.
    turns = [(p, parts[(i + 1) % len(parts)]) for i, p in enumerate(parts)]
    turn = docs.sparkSession.createDataFrame(turns or [(0, 0)], "tail long, head long").limit(len(turns))
    first = table.where("edge = 1").select(F.col("edited_high").alias("head"), F.struct("text", "high", "low").alias("following"))
    last = table.where("edge = 2").select(F.col("edited_high").alias("part"), F.col("doc_id").alias("tail"), "text", "high", "low")
    met = last.join(turn.withColumnRenamed("tail", "part"), "part")
    met = met.join(first, "head")
    met = met.select("tail", "text", "high", "low", F.col("following.text").alias("next_text"), F.col("following.high").alias("next_high"), F.col("following.low").alias("next_low"))

    def bridge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_digest(r["tail"], r["text"], (r["high"], r["low"]), r["next_text"], (r["next_high"], r["next_low"])) for r in batch.to_pylist()]
            if rows:
                yield _batch(rows)

    bridged = met.mapInArrow(bridge, EDGE_SCHEMA).select(*inside.columns)
    return inside.union(bridged)


def likeness(high, low, other_high, other_low):
    """Share of equal bits, 0 to 1."""
    apart = F.bit_count(F.col(high).bitwiseXOR(F.col(other_high))) + F.bit_count(F.col(low).bitwiseXOR(F.col(other_low)))
    return (F.lit(1.0) - apart / F.lit(128.0)).cast("double")


def hex_digits(high, low):
    return F.lower(F.concat(F.lpad(F.hex(high), 16, "0"), F.lpad(F.hex(low), 16, "0")))


def _block(number: int, blocks: int) -> F.Column:
    width = 128 // blocks
    word, at = ("high", number * width) if number * width < 64 else ("low", number * width - 64)
    mask = (1 << width) - 1
    return F.shiftrightunsigned(F.col(word), 64 - width - at).bitwiseAND(F.lit(mask))


def within(points: DataFrame, asked: DataFrame, *, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """For each distinct fingerprint (high, low) of ``asked``: ``found``, the documents of ``points``
    (high, low, docs) within ``radius`` bits. Exact: each choice of ``blocks - radius`` blocks has its table."""
    met = neighbours(points, asked, radius=radius, blocks=blocks)
    counted = met.groupBy("high", "low").agg(F.sum("docs").alias("found"))
    return asked.select("high", "low").distinct().join(counted, ["high", "low"], "left").fillna(0, ["found"])


def neighbours(points: DataFrame, asked: DataFrame, *, radius: int, blocks: int, agree: int | None = None) -> DataFrame:
    """Pairs (high, low, other_high, other_low, docs, distance) of each distinct fingerprint of ``asked`` and those
    of ``points`` within ``radius`` bits. Each choice of ``agree`` blocks, ``blocks - radius`` at most, has its table."""
    if blocks not in (4, 8, 16) or radius >= blocks or not 1 <= (agree or 1) <= blocks - radius:
        raise ValueError("blocks are 4, 8 or 16 and more than the radius; as many as are left over may agree")
    choices = list(combinations(range(blocks), agree or blocks - radius))
    spark = points.sparkSession

    def tables(df: DataFrame) -> DataFrame:
        rows = [F.struct(F.lit(t).alias("t"), F.xxhash64(*[_block(b, blocks) for b in kept]).alias("key")) for t, kept in enumerate(choices)]
        return df.withColumn("row", F.explode(F.array(*rows))).select("row.t", "row.key", *df.columns)

    all_rows, asked_rows = tables(points), tables(asked.select("high", "low").distinct())
    # Only keys that are asked for meet anyone.
    all_rows = all_rows.join(asked_rows.select(F.col("t").alias("at"), F.col("key").alias("ak")).distinct(), (F.col("t") == F.col("at")) & (F.col("key") == F.col("ak")), "left_semi")
    # Keys shared by very many fingerprints are dealt over several tasks; the asked ones visit each.
    many = all_rows.groupBy("t", "key").count().where(F.col("count") > GROUP_POINTS)
    many = many.select("t", "key", F.ceil(F.col("count") / GROUP_POINTS).cast("int").alias("shares"))
    all_rows = all_rows.join(many, ["t", "key"], "left").withColumn("share", F.pmod(F.xxhash64("high", "low"), F.coalesce("shares", F.lit(1))).cast("int")).drop("shares")
    asked_rows = asked_rows.join(many, ["t", "key"], "left").withColumn("share", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1))).drop("shares")
    width = 128 // blocks

    def cut(array: np.ndarray) -> np.ndarray:
        """Blocks of fingerprints: (n, blocks)."""
        spans = array.astype(">u8").view(np.uint8).reshape(len(array), blocks, width // 8)
        return reduce(lambda a, b: (a << np.uint64(8)) | b, np.moveaxis(spans.astype(np.uint64), 2, 0))

    def search(key: tuple, asked_part: pa.Table, part: pa.Table) -> pa.Table:
        part = part.rename_columns([c.rstrip("_") for c in part.column_names])
        queries, points_ = (np.stack([x.column(c).to_numpy() for c in ("high", "low")], 1).view(np.uint64) for x in (asked_part, part))
        docs = part.column("docs").to_numpy()
        pairs = [np.zeros((0, 2), np.int64)]
        earlier, step = choices[: key[0].as_py()], max(1, (1 << 21) // max(1, len(points_)))
        theirs = cut(points_)
        for begin in range(0, len(queries) if len(points_) else 0, step):
            q = queries[begin : begin + step]
            near = np.bitwise_count(q[:, None, :] ^ points_[None, :, :]).sum(2) <= radius
            a, b = np.nonzero(near)
            own = cut(q)[a] == theirs[b]
            new = ~np.any([own[:, list(kept)].all(1) for kept in earlier], axis=0) if earlier else np.ones(len(a), bool)
            pairs.append(np.stack([begin + a[new], b[new]], 1))
        a, b = np.concatenate(pairs).T
        own, other = queries[a], points_[b]
        columns = [*own.view(np.int64).T, *other.view(np.int64).T, docs[b], np.bitwise_count(own ^ other).sum(1).astype(np.int64)]
        return pa.table([pa.array(c) for c in columns], ["high", "low", "other_high", "other_low", "docs", "distance"])

    partitions, by = task_count(spark), ["t", "key", "share"]
    left = asked_rows.select(*by, "high", "low").repartition(partitions, *by).groupBy(*by)
    # Both sides may come from one table: names of their own tell their columns apart.
    right = all_rows.select(*[F.col(c).alias(f"{c}_") for c in (*by, "high", "low", "docs")]).repartition(partitions, *[f"{c}_" for c in by]).groupBy(*[f"{c}_" for c in by])
    return left.cogroup(right).applyInArrow(search, "high long, low long, other_high long, other_low long, docs long, distance long")


def fingerprint_report(docs: DataFrame, *, every: int = 50, radius: int = RADIUS, reach: int = REACH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints and likenesses of all documents; ``n_within``: for ids divisible by ``every``, the other
    documents within ``radius`` bits, else null; ``near``: for these ids the fingerprints of other documents within
    ``reach`` bits (at least ``radius``), with their distance and number of documents, nearest first."""
    if reach < radius:
        raise ValueError("the reach is the radius at least")
    found = written(digests(docs, id_col=id_col, text_col=text_col), "fingerprints")
    points = found.groupBy("high", "low").agg(F.count("*").alias("docs"))
    is_asked = F.coalesce(F.col("doc_id") % every == 0, F.lit(False))
    pairs = neighbours(points, found.where(is_asked), radius=reach, blocks=REACH_BLOCKS, agree=1)
    # A document is no neighbour of its own; its fingerprint is listed if others have it.
    is_own = F.col("distance") == 0
    pairs = pairs.withColumn("others", F.col("docs") - F.when(is_own, 1).otherwise(0))
    entry = F.struct("distance", hex_digits("other_high", "other_low").alias("fingerprint"), F.col("others").alias("docs"))
    listed = F.array_sort(F.collect_list(F.when(F.col("others") > 0, entry)))
    counted = pairs.groupBy("high", "low").agg(F.sum(F.when(F.col("distance") <= radius, F.col("others")).otherwise(0)).alias("n_within"), listed.alias("near"))
    asked = found.where(is_asked).join(counted, ["high", "low"])
    rest = found.where(~is_asked).withColumns({c: F.lit(None).cast(counted.schema[c].dataType) for c in ("n_within", "near")})
    return rest.unionByName(asked).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        hex_digits("high", "low").alias("fingerprint"),
        hex_digits("edited_high", "edited_low").alias("edited_fingerprint"),
        likeness("high", "low", "edited_high", "edited_low").alias("near_edited"),
        likeness("high", "low", "next_high", "next_low").alias("near_next"),
        "n_within",
        "near",
    )
