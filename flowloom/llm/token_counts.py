"""Token counts of documents without their ids.

Each text becomes a bag of pre-tokens. A pre-token's number of pieces is counted once and joined to
the frequencies: frequent ones (a bounded head) are joined where the text is, the rest is shuffled by
pre-token to the one task that counts it; the products are summed per document. The head is picked
from a documented sample of rows; it decides where a pre-token is counted, never whether.

Cases: a null text is an empty one with zero tokens; repeated rows each get a row with the same
count; special strings inside a text count as the library counts them; extra columns are ignored.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.inputs import in_slices, task_count, texts
from flowloom.llm.tokens import encoder

HEAD_ENTRIES = 250_000
HEAD_SAMPLE_ROWS = 20_000
BAG_SCHEMA = "doc_id long, text_high long, text_low long, n_bytes long, pretoken string, frequency long"


def pre_tokens(tokens, text: str) -> list[str]:
    """Pre-tokens of a text; special strings are pre-tokens of their own."""
    if not tokens.special(text):
        return tokens.parts(tokens._normal([text])[0]) if text else []
    found, at = [], 0
    for match in tokens.special_all(text):
        found += tokens.parts(text[at : match.start()]) + [match[0]]
        at = match.end()
    return found + tokens.parts(text[at:])


def piece_count(tokens, pre_token: str) -> int:
    return 1 if tokens.special(pre_token) else len(tokens.piece(pre_token))


def frequent(docs: DataFrame, path: str, entries: int = HEAD_ENTRIES, rows: int = HEAD_SAMPLE_ROWS) -> dict[str, int]:
    """The most frequent pre-tokens of about ``rows`` rows, at most ``entries``, with their numbers of pieces."""
    total = docs.count()
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, total // rows))) == 0)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, bag = encoder(path), Counter()
        for batch in in_slices(batches, "text"):
            for text in batch.column("text").to_pylist():
                bag.update(pre_tokens(tokens, text))
        yield pa.RecordBatch.from_arrays([pa.array(bag.keys(), pa.string()), pa.array(bag.values(), pa.int64())], ["pretoken", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path)
        for batch in batches:
            pieces = [piece_count(tokens, p) for p in batch.column("pretoken").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("pretoken"), pa.array(pieces, pa.int32())], ["pretoken", "pieces"])

    counted = some.mapInArrow(bags, "pretoken string, n long").where("length(pretoken) <= 48").groupBy("pretoken").agg(F.sum("n").alias("n"))
    top = counted.where("n > 1").orderBy(F.desc("n"), "pretoken").limit(entries).select("pretoken")
    return {r["pretoken"]: r["pieces"] for r in top.mapInArrow(count, "pretoken string, pieces int").collect()}


def count_tokens(docs: DataFrame, path: str, *, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row for each row of ``docs``."""
    narrow = texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    spark = docs.sparkSession
    head = spark.sparkContext.broadcast(frequent(narrow, path))

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, known = encoder(path), head.value
        for batch in in_slices(batches, "text"):
            ids, highs, lows, sizes, rest, counts = [], [], [], [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                raw = text.encode()
                # Rows of one id, or of none, are told apart by their texts: 128 bits, so that no two texts share a key.
                high, low = struct.unpack(">qq", xxhash.xxh3_128_digest(raw))
                done, tail = 0, []
                for pre_token, n in Counter(pre_tokens(tokens, text)).items():
                    if (count := known.get(pre_token)) is None:
                        tail.append((pre_token, n))
                    else:
                        done += n * count
                # The row that carries the document's own figures has no pre-token; its frequency is the pieces counted here.
                ids += [doc] * (len(tail) + 1)
                highs += [high] * (len(tail) + 1)
                lows += [low] * (len(tail) + 1)
                sizes += [len(raw)] + [None] * len(tail)
                rest += [None] + [t for t, _ in tail]
                counts += [done] + [n for _, n in tail]
            arrays = [pa.array(ids, pa.int64()), pa.array(highs, pa.int64()), pa.array(lows, pa.int64()), pa.array(sizes, pa.int64()), pa.array(rest, pa.string()), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text_high", "text_low", "n_bytes", "pretoken", "frequency"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, last, last_count = encoder(path), None, 0
        for batch in batches:
            table = batch.column("pretoken").dictionary_encode()
            # Rows are sorted: a pre-token that goes on from the batch before is known.
            per = np.array([last_count if t == last else piece_count(tokens, t) for t in table.dictionary.to_pylist()], np.int64)
            place = table.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            frequency = batch.column("frequency").to_numpy()
            total = np.where(place >= 0, frequency * per[place], frequency) if len(per) else frequency
            if len(per) and place[-1] >= 0:
                last, last_count = table.dictionary[int(place[-1])].as_py(), int(per[place[-1]])
            arrays = [batch.column("doc_id"), batch.column("text_high"), batch.column("text_low"), batch.column("n_bytes"), pa.array(total), pa.array((place < 0).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text_high", "text_low", "n_bytes", "tokens", "copies"])

    rows = narrow.mapInArrow(bags, BAG_SCHEMA)
    # Rows without a pre-token need no common task; they are dealt by document.
    target = F.when(F.col("pretoken").isNull(), F.xxhash64("doc_id", "text_low")).otherwise(F.xxhash64("pretoken"))
    dealt = rows.repartition(task_count(spark), target)
    summed = dealt.sortWithinPartitions("pretoken").mapInArrow(joined, "doc_id long, text_high long, text_low long, n_bytes long, tokens long, copies int")
    totals = summed.groupBy("doc_id", "text_high", "text_low").agg(F.max("n_bytes").alias("n_bytes"), F.sum("tokens").alias("tokens"), F.sum("copies").alias("copies"))
    each = totals.withColumn("n_tokens", (F.col("tokens") / F.col("copies")).cast("long"))
    each = each.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return each.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
