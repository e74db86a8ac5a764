"""Best-fit packing of token sequences with large-item matching.

Only the number of pieces of each length matters for the plan, and there are at most
``capacity`` lengths: the driver sees that histogram, never a row. Pieces above one third of
the capacity are matched first, at most two in a sequence: each, from the longest down, with
the longest other one that still fits. Smaller pieces then go, from the longest down, to the
fullest sequence with room for them, or open a new one. Sequences of one make are handled as a
group, so planning costs steps per length, not per piece. A piece finds its place by its rank
among the pieces of its length.

Cases: a null text is an empty one and holds the end id alone; repeated rows are packed as
often as they come; ties among pieces of a length are free, as any order gives an equal
number of sequences; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.inputs import in_slices, texts, tidied, written
from flowloom.llm.tokens import POWERS, encoder

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
IDS_SCHEMA = PIECE_SCHEMA + ", ids binary"


def with_end_id(ids: np.ndarray, sizes: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` behind each document, and the new sizes."""
    return np.insert(ids, np.cumsum(sizes), np.uint32(end_id)).astype("<u4"), sizes + 1


def cut_pieces(
    docs: DataFrame, path: str, *, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, keep_memo: bool = True
) -> DataFrame:
    """Pieces of at most ``capacity`` ids; of a longer document the first one takes the odd rest.

    ``keep_memo``: workers keep the ids of known words for the next task, some 100 MB; else they forget them, for
    jobs that go on with other work.

    ``part`` and ``nth`` number the pieces of one length: the task that cut them, and a count in it.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        encode = encoder(path).encode_all
        for batch in in_slices(batches, "text"):
            ids, sizes = with_end_id(*encode(batch.column("text")), end_id)
            counts = -(-sizes // capacity)
            doc = np.repeat(np.arange(len(sizes)), counts)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
            first = sizes - (counts - 1) * capacity
            length = np.where(piece == 0, first[doc], capacity)
            start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
            ends, raw = np.cumsum(length), memoryview(ids.tobytes())
            spans = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), length.tolist())]
            order = np.argsort(length, kind="stable")
            lengths, begin, count = np.unique(length[order], return_index=True, return_counts=True)
            nth = np.empty(len(doc), np.int64)
            nth[order] = np.arange(len(doc)) - np.repeat(begin - seen[lengths], count)
            seen[lengths] += count
            out = [batch.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), start, length]
            out += [pa.array([zlib.crc32(s) for s in spans], pa.int64()), pa.array(np.full(len(doc), part), pa.int32()), nth]
            out += [pa.array([bytes(s) for s in spans], pa.binary())] if with_ids else []
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"] + ["ids"] * with_ids
            yield pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a, pa.int64()) for a in out], names)

    narrow = texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return narrow.mapInArrow(tidied(cut, POWERS.forget if keep_memo else lambda: encoder(path).forget()), IDS_SCHEMA if with_ids else PIECE_SCHEMA)


class _Sequences:
    """Groups of equal sequences by their free room."""

    def __init__(self) -> None:
        self.by_room: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
        self.rooms: list[int] = []

    def put(self, room: int, count: int, lengths: tuple[int, ...]) -> None:
        if count:
            if room not in self.by_room:
                bisect.insort(self.rooms, room)
            self.by_room.setdefault(room, []).append((count, lengths))

    def best(self, length: int) -> int | None:
        """The smallest room that takes ``length``."""
        at = bisect.bisect_left(self.rooms, length)
        return self.rooms[at] if at < len(self.rooms) else None

    def take(self, room: int) -> tuple[int, tuple[int, ...]]:
        group = self.by_room[room].pop()
        if not self.by_room[room]:
            del self.by_room[room]
            self.rooms.remove(room)
        return group


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(number of sequences, lengths in each) for a histogram of piece lengths."""
    sequences, left = _Sequences(), dict(histogram)
    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        longest = large[-1]
        at = bisect.bisect_right(large, capacity - longest) - 1
        mate = large[at] if at >= 0 else None
        if mate == longest and left[longest] == 1:
            mate = large[at - 1] if at else None
        if mate is None:
            sequences.put(capacity - longest, left[longest], (longest,))
            left[longest] = 0
        else:
            pairs = left[longest] // 2 if mate == longest else min(left[longest], left[mate])
            sequences.put(capacity - longest - mate, pairs, (longest, mate))
            left[longest] -= pairs
            left[mate] -= pairs
        large = [n for n in large if left[n]]
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        count = left[length]
        while count:
            room = sequences.best(length)
            if room is None:
                sequences.put(capacity, -(-count // (capacity // length)), ())
                continue
            many, held = sequences.take(room)
            fit = room // length
            full = min(many, count // fit)
            sequences.put(room - fit * length, full, held + (length,) * fit)
            count -= full * fit
            rest = min(count, fit) if full < many else 0
            sequences.put(room - rest * length, int(rest > 0), held + (length,) * rest)
            sequences.put(room, many - full - (rest > 0), held)
            count -= rest
    return [group for groups in sequences.by_room.values() for group in groups if group[1]]


def _slots(groups: list[tuple[int, tuple[int, ...]]]) -> tuple[np.ndarray, ...]:
    """Places by (length, first rank): the sequence of that rank and the offset in it."""
    rows, first, used = [], 0, {}
    for count, lengths in groups:
        offset = 0
        for n in lengths:
            rows.append((n, used.get(n, 0), first, offset))
            used[n] = used.get(n, 0) + count
            offset += n
        first += count
    return tuple(np.array(sorted(rows), np.int64).reshape(-1, 4).T)


def place(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a durable table of pieces.

    Tasks and lengths bound the table of ranks; it is joined by hash, so its size is free.
    """
    counts = pieces.groupBy("length", "part").agg((F.max("nth") + 1).alias("many"))
    from pyspark.sql import Window

    ranks = counts.withColumn("before", F.sum("many").over(Window.partitionBy("length").orderBy("part")) - F.col("many"))
    ranks = written(ranks, "pack-ranks")
    histogram = {r["length"]: r["n"] for r in ranks.groupBy("length").agg(F.sum("many").alias("n")).collect()}
    lengths, firsts, sequences, offsets = _slots(plan(histogram, capacity))
    # One sorted number for (length, rank): ranks stay below 2**48.
    starts = (lengths << 48) + firsts

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(starts, (batch.column("length").to_numpy() << 48) + rank, side="right") - 1
            kept = [batch.column(c) for c in batch.schema.names if c != "rank"]
            names = [c for c in batch.schema.names if c != "rank"] + ["sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays(kept + [pa.array(sequences[at] + rank - firsts[at]), pa.array(offsets[at])], names)

    ranked = pieces.join(ranks.select("length", "part", "before"), ["length", "part"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("nth")).drop("before", "part", "nth")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInArrow(put, schema + ", sequence_id long, offset long")


def pack(docs: DataFrame, path: str, *, capacity: int = 1024, end_id: int = 2, with_ids: bool = False, keep_memo: bool = True, **names: str) -> DataFrame:
    """Packed pieces of all documents: where each lies, and on request its ids (little-endian 32 bit)."""
    cut = cut_pieces(docs, path, capacity=capacity, end_id=end_id, with_ids=with_ids, keep_memo=keep_memo, **names)
    return place(written(cut, "pack-pieces"), capacity)
