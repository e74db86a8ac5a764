"""Ranked lexical search: an inverted index of documents and Block-Max MaxScore over it.

``build_index`` cuts the documents, as they are read, into shards of bounded size. A shard has one row per
term: postings (document, occurrences) in blocks of 128, each compressed on its own, and per block its
last document and the pairs (occurrences, length) of which one scores highest whatever the statistics of
the corpus are. So the index needs no second pass, and block maxima are exact for any collection it is part of.

``search`` sends each shard the asked terms' rows and all queries. A query's terms are sorted by the most
they can score in the shard. Those that together stay below the k-th best score so far are
non-essential: documents come from the other lists only. A non-essential list is looked up for
candidates whose score so far, plus the maximum of the block they would be in, plus the bounds of
the lists still to come, reaches the k-th best; blocks that no candidate needs are never decompressed. Shards
give their best k, and these are merged.

Scores are whole numbers: with N documents that have a term, L occurrences in all, n in the document, df
documents of the term and tf occurrences, a term gives floor(1000 ln((2N+2)/(2df+1))) times
(1000000000 tf) div (1000 tf + 8 m), where m = 10 + (90 n N) div L.

Cases: a null text, or one without terms, is in no result and in no statistic; repeated rows and ids are
documents of their own; equal scores go by smaller id, null ids last; a query without known terms has
no rows; each query row gets its own answer; scores of 0 are left out; an empty table on either side gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.llm.inputs import columns, task_count, texts, written
from flowloom.llm.tokens import Numbered

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
BLOCK = 128
SHARD_BYTES = 16 << 20
SHARD_DOCS = 16_384
SHARDS_PER_TASK = 4
QUERIES_PER_TASK = 4096
WINDOW_DOCS = 4096
INDEX_SCHEMA = "shard long, term string, df long, head binary, body binary, doc_ids array<long>, lengths array<int>"


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as bytes of seven bits each, lowest first, and where each begins (with the end)."""
    size = np.ones(len(values), np.int64)
    for bits in (7, 14, 21, 28):
        size += values >= 1 << bits
    at = np.concatenate([[0], np.cumsum(size)])
    data = np.zeros(at[-1], np.uint8)
    for j in range(5):
        on = size > j
        data[at[:-1][on] + j] = (values[on] >> (7 * j) & 127) | ((size[on] > j + 1) << 7)
    return data, at


def unpacked(data: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(data < 128)
    begin = np.concatenate([[0], last[:-1] + 1])
    values = np.zeros(len(last), np.int64)
    for j in range(int((last - begin).max(initial=-1)) + 1):
        on = last - begin >= j
        values[on] |= (data[begin[on] + j].astype(np.int64) & 127) << (7 * j)
    return values


def skyline(block: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Positions, in order of block, of the postings that no other of their block beats in both numbers."""
    order = np.lexsort((-tf, length, block))
    rising = block[order] * (int(tf.max(initial=0)) + 1) + tf[order]
    top = np.maximum.accumulate(rising)
    return order[np.concatenate([[True], top[1:] > top[:-1]])] if len(order) else order


def _binaries(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def shard_rows(number: int, docs: list[tuple[int | None, str]]) -> Iterator[pa.RecordBatch]:
    """Index rows of one shard, documents in order of id."""
    schema = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("df", pa.int64()), ("head", pa.binary()), ("body", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32()))])
    known, ids, words = Numbered(), [], []
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0)):
        if own := text.encode().translate(_FOLD).split():
            ids.append(doc_id)
            words.append(np.fromiter(map(known.__getitem__, own), np.int64, len(own)))
    if not ids:
        return
    length = np.fromiter(map(len, words), np.int64, len(words))
    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip([number, None, None, None, None, ids, length], schema)], schema=schema)
    pairs, tf = np.unique(np.concatenate(words) * len(ids) + np.repeat(np.arange(len(ids)), length), return_counts=True)
    term, doc = np.divmod(pairs, len(ids))
    df = np.bincount(term, minlength=len(known))
    first = np.cumsum(df) - df
    begins = (np.arange(len(term)) - first[term]) % BLOCK == 0
    block = np.cumsum(begins) - 1
    heads = np.flatnonzero(begins)
    step = np.diff(doc, prepend=0)
    step[heads] = doc[heads]
    body, at = packed(np.stack([step, tf], 1).ravel())
    body_bounds = at[2 * np.concatenate([first, [len(term)]])]
    # Head: last document, place and size of the skyline of each block, then the skylines.
    many = -(-df // BLOCK)
    best = skyline(block, tf, length[doc])
    in_block, in_term = np.bincount(block[best], minlength=len(heads)), np.bincount(term[best], minlength=len(df))
    ints = 3 * many + 2 * in_term
    base = np.concatenate([[0], np.cumsum(ints)])
    head = np.zeros(base[-1], "<i4")
    of = term[heads]
    spot = base[of] + np.arange(len(heads)) - (np.cumsum(many) - many)[of]
    head[spot] = doc[np.append(heads[1:], len(term)) - 1]
    head[spot + many[of]] = at[2 * heads] - body_bounds[of]
    head[spot + 2 * many[of]] = in_block
    of = term[best]
    spot = base[of] + 3 * many[of] + np.arange(len(best)) - (np.cumsum(in_term) - in_term)[of]
    head[spot], head[spot + in_term[of]] = tf[best], length[doc[best]]
    names = pa.array(known.fresh, pa.binary()).cast(pa.string())
    nothing = [pa.nulls(len(df), schema.field(c).type) for c in ("doc_ids", "lengths")]
    arrays = [pa.array(np.full(len(df), number)), names, pa.array(df), _binaries(head.view(np.uint8), 4 * base), _binaries(body, body_bounds), *nothing]
    batch = pa.RecordBatch.from_arrays(arrays, schema=schema)
    for begin in range(0, len(df), 16_384):
        yield batch.slice(begin, 16_384)


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """The index of all documents, as a table in the shared folder; texts are not shuffled.

    A row with ``term`` has a shard's postings of it; the row without one has the shard's documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for doc in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                held.append(doc)
                size += len(doc[1])
                if size >= shard_bytes or len(held) >= shard_docs:
                    yield from shard_rows(number, held)
                    number, held, size = number + 1, [], 0
        yield from shard_rows(number, held)

    narrow = texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return written(narrow.mapInArrow(run, INDEX_SCHEMA), "lexical-index")


class Postings:
    """One term's list in a shard: block maxima at once, postings when asked for."""

    def __init__(self, df: int, head: bytes, body: bytes, norm) -> None:
        self.df, self.norm = df, norm
        head, many = np.frombuffer(head, "<i4").astype(np.int64), -(-df // BLOCK)
        self.body = np.frombuffer(body, np.uint8)
        self.last, at, size = head[:many], head[many : 2 * many], head[2 * many : 3 * many]
        self.bounds = np.append(at, len(self.body))
        tf, length = head[3 * many :].reshape(2, -1)
        self.tops = np.maximum.reduceat(impact(tf, norm(length)), np.cumsum(size) - size)
        self.top = int(self.tops.max())
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def blocks(self, wanted: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of some blocks, in order; only those not seen before are decompressed."""
        for b in wanted.tolist():
            if b not in self.known:
                pairs = unpacked(self.body[self.bounds[b] : self.bounds[b + 1]])
                doc = np.cumsum(pairs[0::2])
                self.known[b] = doc, impact(pairs[1::2], self.norm(lengths[doc]))
        parts = [self.known[b] for b in wanted.tolist()]
        return parts[0] if len(parts) == 1 else tuple(np.concatenate(p) for p in zip(*parts))


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term gives a document, before its weight."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Best:
    """The k best documents so far."""

    def __init__(self, k: int) -> None:
        self.k, self.rows, self.floor = k, [], 0

    def add(self, scores: np.ndarray, ids: list[int | None]) -> None:
        self.rows += [(-s, i is None, i or 0) for s, i in zip(scores.tolist(), ids)]
        self.rows = sorted(self.rows)[: self.k]
        # Later shards may hold smaller ids, so equal scores still count.
        self.floor = -self.rows[-1][0] if len(self.rows) == self.k else 0


def search_shard(query: list[tuple[int, Postings]], ids: list[int | None], lengths: np.ndarray, best: Best) -> int:
    """Adds a shard's documents to ``best``; gives the number of candidates that were looked at."""
    query = sorted(query, key=lambda q: q[0] * q[1].top)
    # below[j]: what the first j lists can give at most.
    below = np.concatenate([[0], np.cumsum([w * p.top for w, p in query])]).tolist()
    looked = 0
    for begin in range(0, len(ids), WINDOW_DOCS):
        essential = sum(b < best.floor for b in below[1:])
        if essential == len(query):
            break
        end = min(begin + WINDOW_DOCS, len(ids))
        score = np.zeros(end - begin, np.int64)
        for weight, postings in query[essential:]:
            low, high = np.searchsorted(postings.last, [begin, end - 1])
            if low < len(postings.last):
                doc, gain = postings.blocks(np.arange(low, min(high + 1, len(postings.last))), lengths)
                inside = slice(*np.searchsorted(doc, [begin, end]))
                score[doc[inside] - begin] += weight * gain[inside]
        met = np.flatnonzero(score)
        looked += len(met)
        for j in range(essential - 1, -1, -1):
            weight, postings = query[j]
            met = met[score[met] + below[j + 1] >= best.floor]
            block = np.searchsorted(postings.last, met + begin)
            may = block < len(postings.last)
            top = np.where(may, postings.tops[np.minimum(block, len(postings.last) - 1)], 0)
            hopeful = score[met] + weight * top + below[j] >= best.floor
            met, block = met[hopeful], block[hopeful & may]
            if not len(met):
                break
            if len(block):
                doc, gain = postings.blocks(np.unique(block), lengths)
                at = np.searchsorted(doc, met + begin)
                hit = at < len(doc)
                hit[hit] = doc[at[hit]] == met[hit] + begin
                score[met[hit]] += weight * gain[at[hit]]
        met = met[score[met] >= max(1, best.floor)]
        if len(met):
            best.add(score[met], [ids[i] for i in (met + begin).tolist()])
    return looked


def search(
    index: DataFrame,
    queries: DataFrame,
    *,
    k: int = 10,
    id_col: str = "item_id",
    text_col: str = "text",
    shards_per_task: int = SHARDS_PER_TASK,
    queries_per_task: int = QUERIES_PER_TASK,
) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the ``k`` best documents of each row of ``queries``."""
    spark = index.sparkSession
    words = F.array_distinct(F.regexp_extract_all(F.translate(F.col("text").cast("string"), UPPER, UPPER.lower()), F.lit(TERM), F.lit(0)))
    items = columns(queries, item_id=id_col, text=text_col).select(
        F.monotonically_increasing_id().alias("row"), F.col("item_id").cast("long").alias("item_id"), words.alias("terms")
    )
    items = written(items.where(F.size("terms") > 0), "lexical-queries")
    asked = items.select("row", "item_id", F.explode("terms").alias("term"))
    documents = index.where("term is null")
    lengths = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n)
    total = documents.agg(F.count("*").alias("shards"), F.sum(F.size("doc_ids")).alias("docs"), F.sum(lengths).alias("terms")).first()
    docs, terms = total["docs"] or 0, total["terms"] or 1
    groups, blocks = -(-total["shards"] // shards_per_task) or 1, -(-items.count() // queries_per_task) or 1

    # The index in the form of a search: only rows of asked terms, which have one row per shard.
    part = index.join(asked.select("term").distinct(), "term", "left_semi")
    known = index.where("term is not null").select("term", "df").join(asked.select("term").distinct(), "term", "left_semi")
    weight = F.floor(1000 * F.log(F.lit(2.0 * docs + 2) / (2 * F.col("df") + 1))).alias("weight")
    weights = known.groupBy("term").agg(F.sum("df").alias("df")).select("term", weight)
    weighed = asked.join(weights, "term").groupBy("row", "item_id").agg(F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights"))

    group = F.pmod(F.xxhash64("shard"), F.lit(groups)).cast("int").alias("group")
    in_blocks = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block")
    in_groups = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group")
    held = part.unionByName(documents).select(group, in_blocks, *documents.columns)
    asking = weighed.select(in_groups, block, "row", "item_id", "terms", "weights")
    key = ["group", "block"]
    sides = [f.repartition(task_count(spark), *key).groupBy(*key) for f in (held, asking)]

    def run(held: pa.Table, asking: pa.Table) -> pa.Table:
        best = [Best(k) for _ in range(asking.num_rows)]
        weighed = [dict(zip(t, w)) for t, w in zip(asking.column("terms").to_pylist(), asking.column("weights").to_pylist())]
        for number in np.unique(held.column("shard").to_numpy()).tolist():
            shard = held.filter(pa.compute.equal(held.column("shard"), number))
            about = shard.filter(pa.compute.is_null(shard.column("term"))).slice(0, 1)
            ids, lengths = about.column("doc_ids")[0].as_py(), np.array(about.column("lengths")[0].as_py(), np.int64)
            lists = shard.filter(pa.compute.is_valid(shard.column("term")))
            postings = {
                t: Postings(df, head, body, lambda n: 10 + 90 * n * docs // terms)
                for t, df, head, body in zip(*[lists.column(c).to_pylist() for c in ("term", "df", "head", "body")])
            }
            for weights, found in zip(weighed, best):
                query = [(w, postings[t]) for t, w in weights.items() if t in postings]
                if query:
                    search_shard(query, ids, lengths, found)
        rows = [(r, i, None if lost else doc, -s) for r, i, b in zip(asking.column("row").to_pylist(), asking.column("item_id").to_pylist(), best) for s, lost, doc in b.rows]
        taken = list(zip(*rows)) or [[]] * 4
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(["row", "item_id", "doc_id", "score"], taken)})

    found = sides[0].cogroup(sides[1]).applyInArrow(run, "row long, item_id long, doc_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
