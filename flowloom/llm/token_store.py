"""Token-id files with a minimal perfect hash index over document keys.

Documents are sorted by key and written as shards of raw little-endian ids (16 bit where the
vocabulary allows, else 32). Each shard has an index: a minimal perfect hash by bucket
displacement that gives each of its keys a slot of its own, and per slot a 16-bit fingerprint
of the key, the offset and the number of ids. A lookup hashes the key, reads one displacement and
one slot, and compares the fingerprint: constant time, whatever the size. The container is a
Parquet table with a row for each shard, so that Spark's writers commit it and any store holds it.

Cases: a null text is an empty one and holds the end id alone; rows with one key are all kept, in the
order of the hashes of their texts: the index leads to the first and says how many follow in its shard, and
they go on in the next shard, which has an entry of its own, if that begins with the key; a null key is kept
before all others, and is found by scan only; an empty table gives no shard; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowloom.llm.inputs import in_order, in_slices, texts
from flowloom.llm.packing import with_end_id
from flowloom.llm.tokens import encoder

SHARD_BYTES = 8 << 20
BUCKET_KEYS = 4
MAGIC = b"MPHIDS01"
SHARD_SCHEMA = "part int, shard int, first_key long, last_key long, n_ids long, n_docs long, width int, payload binary, doc_keys binary, doc_sizes binary, index binary"
_SEED = np.uint64(0x9E3779B97F4A7C15)


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of 64-bit keys."""
    h = keys.astype(np.int64).view(np.uint64) + np.uint64((seed + 1) * int(_SEED) % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


DIRECT = np.uint32(1 << 31)


def _trial(keys: np.ndarray, trial: np.ndarray, count: int) -> np.ndarray:
    """Slots of keys for displacements; every slot is within reach of every key."""
    h = mixed(keys, 1) + trial * (mixed(keys, 2) | np.uint64(1))
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((h ^ (h >> np.uint64(29))) % np.uint64(count)).astype(np.int64)


def _slots(keys: np.ndarray, displaced: np.ndarray, count: int) -> np.ndarray:
    """Slots of keys by the displacements of their buckets."""
    direct = displaced >= DIRECT
    return np.where(direct, displaced & ~DIRECT, _trial(keys, displaced.astype(np.uint64), count)).astype(np.int64)


def build_hash(keys: np.ndarray) -> np.ndarray:
    """Displacements that send ``keys`` (distinct) to slots 0..n-1 without a clash.

    Buckets of several keys come first, the largest before the others, and try displacements in turn; a
    bucket of one key then gets a free slot outright.
    """
    n = len(keys)
    buckets = max(1, -(-n // BUCKET_KEYS))
    bucket = (mixed(keys, 3) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=buckets)
    ends = np.cumsum(sizes)
    free, displaced = np.ones(n, bool), np.zeros(buckets, np.uint32)
    for b in np.flatnonzero(sizes > 1)[np.argsort(-sizes[sizes > 1], kind="stable")].tolist():
        own = keys[order[ends[b] - sizes[b] : ends[b]]]
        tried, width = 0, 64
        while True:
            slots = _trial(own[None, :], np.arange(tried, tried + width, dtype=np.uint64)[:, None], n)
            in_order = np.sort(slots, 1)
            hit = np.flatnonzero(free[slots].all(1) & (in_order[:, 1:] != in_order[:, :-1]).all(1))
            if len(hit):
                displaced[b] = tried + hit[0]
                free[slots[hit[0]]] = False
                break
            tried, width = tried + width, min(width * 2, 1 << 12)
            if tried >= 1 << 30:
                raise ValueError("no displacement found")
    alone = np.flatnonzero(sizes == 1)
    displaced[alone] = DIRECT | np.flatnonzero(free)[: len(alone)].astype(np.uint32)
    return displaced


def pack_index(keys: np.ndarray, starts: np.ndarray, sizes: np.ndarray, copies: np.ndarray) -> bytes:
    """The index of a shard: header, displacements, then per slot fingerprint, copies, start, size."""
    displaced = build_hash(keys)
    bucket = (mixed(keys, 3) % np.uint64(len(displaced))).astype(np.int64)
    slot = _slots(keys, displaced[bucket], len(keys))
    rows = np.zeros(len(keys), np.dtype([("fp", "<u2"), ("copies", "<u4"), ("start", "<u8"), ("size", "<u4")]))
    rows["fp"][slot], rows["copies"][slot] = (mixed(keys, 4) & np.uint64(0xFFFF)).astype(np.uint16), copies
    rows["start"][slot], rows["size"][slot] = starts, sizes
    return MAGIC + struct.pack("<II", len(keys), len(displaced)) + displaced.astype("<u4").tobytes() + rows.tobytes()


class ShardIndex:
    """Reads an index: keyed access to the ids of a shard."""

    def __init__(self, index: bytes) -> None:
        if index[:8] != MAGIC:
            raise ValueError("not an index of token ids")
        self.keys, buckets = struct.unpack_from("<II", index, 8)
        self.displaced = np.frombuffer(index, "<u4", buckets, 16)
        self.rows = np.frombuffer(index, np.dtype([("fp", "<u2"), ("copies", "<u4"), ("start", "<u8"), ("size", "<u4")]), self.keys, 16 + 4 * buckets)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot rows of the keys; ``copies`` is 0 where the fingerprint says the key is not there."""
        if not self.keys:
            return np.zeros(len(keys), self.rows.dtype)
        bucket = (mixed(keys, 3) % np.uint64(len(self.displaced))).astype(np.int64)
        rows = self.rows[_slots(keys, self.displaced[bucket], self.keys)].copy()
        rows["copies"][rows["fp"] != (mixed(keys, 4) & np.uint64(0xFFFF)).astype(np.uint16)] = 0
        return rows


def _shard(part: int, number: int, keys: list, sizes: np.ndarray, ids: np.ndarray, width: int) -> dict:
    known = np.array([k is not None for k in keys], bool)
    plain = np.array([k or 0 for k in keys], np.int64)
    starts = np.cumsum(sizes) - sizes
    distinct, first, copies = np.unique(plain[known], return_index=True, return_counts=True)
    at = np.flatnonzero(known)[first]
    kept = plain[known]
    return {
        "part": part, "shard": number, "first_key": int(kept[0]) if len(kept) else None, "last_key": int(kept[-1]) if len(kept) else None,
        "n_ids": len(ids), "n_docs": len(keys), "width": width, "payload": ids.astype(f"<u{width}").tobytes(),
        "doc_keys": np.packbits(known).tobytes() + plain.astype("<i8").tobytes(), "doc_sizes": sizes.astype("<u4").tobytes(),
        "index": pack_index(distinct, starts[at], sizes[at], copies),
    }


def write_store(
    docs: DataFrame, path: str, folder: str, *, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES
) -> None:
    """Encodes all documents and writes the shards in ascending key order below ``folder``."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        tokens = encoder(path)
        width = 2 if max(tokens.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        schema = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (c.split() for c in SHARD_SCHEMA.split(", "))])
        keys, sizes, ids, held = [], [], [], 0

        def flush():
            nonlocal keys, sizes, ids, held, number
            row = _shard(part, number, keys, np.concatenate(sizes), np.concatenate(ids), width)
            keys, sizes, ids, held, number = [], [], [], 0, number + 1
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in in_slices(batches, "text"):
            own = batch.column("doc_id").to_pylist()
            # Closed by size alone: the copies of a key may fill any number of shards.
            if held >= shard_bytes:
                yield flush()
            more, counts = with_end_id(*tokens.encode_all(batch.column("text")), end_id)
            keys += own
            sizes.append(counts)
            ids.append(more)
            held += width * len(more)
        if keys:
            yield flush()

    ordered = texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    out = in_order(ordered).mapInArrow(shards, SHARD_SCHEMA)
    out.write.option("compression", "zstd").parquet(folder)


def shard_starts(shards: DataFrame) -> DataFrame:
    """``start`` of each shard: ids of all shards before it. One small row for each shard."""
    narrow = shards.select("part", "shard", "n_ids")
    parts = narrow.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = parts.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("before"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_ids")
    return narrow.withColumn("inside", inside).join(before, "part").select("part", "shard", (F.col("before") + F.col("inside")).alias("start"))


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each stored document, read through the index: doc_id, start, n_tokens, ids_crc32.

    Every key is looked up in its shard; the ids come from the raw payload at the offset found.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = row["n_docs"]
                mask = (n + 7) // 8
                known = np.unpackbits(np.frombuffer(row["doc_keys"], np.uint8, mask), count=n).astype(bool)
                keys = np.frombuffer(row["doc_keys"], "<i8", n, mask)
                sizes = np.frombuffer(row["doc_sizes"], "<u4", n).astype(np.int64)
                starts = np.cumsum(sizes) - sizes
                distinct, first, copies = np.unique(keys[known], return_index=True, return_counts=True)
                found, at = ShardIndex(row["index"]).find(distinct), np.flatnonzero(known)[first]
                if (found["copies"] != copies).any():
                    raise ValueError("a stored key is not in its index")
                sizes[at], starts[at] = found["size"], found["start"]
                ids = np.frombuffer(row["payload"], f"<u{row['width']}").astype("<u4")
                crc = [zlib.crc32(ids[s : s + c]) for s, c in zip(starts.tolist(), sizes.tolist())]
                out = [pa.array([k if i else None for k, i in zip(keys.tolist(), known.tolist())], pa.int64()), pa.array(starts + row["start"]), pa.array(sizes), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "start", "n_tokens", "ids_crc32"])

    shards = spark.read.schema(SHARD_SCHEMA).parquet(folder)
    joined = shards.join(F.broadcast(shard_starts(shards)), ["part", "shard"])
    return joined.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(spark: SparkSession, folder: str, keys: list[int]) -> dict[int, np.ndarray]:
    """The ids of a few keys: the first shard of each by its key range, then one slot each. Absent keys are left out.

    A key on several rows gives those of its first row; shards that only go on with its copies are not read.
    """
    shards = spark.read.schema(SHARD_SCHEMA).parquet(folder)
    wanted = F.lit(False)
    for key in keys:
        wanted |= F.lit(key).between(F.col("first_key"), F.col("last_key"))
    found, holders = {}, {}
    for row in sorted(shards.where(wanted).select("part", "shard", "first_key", "last_key").collect(), key=lambda r: (r["part"], r["shard"])):
        for key in keys:
            if row["first_key"] <= key <= row["last_key"]:
                holders.setdefault(key, (row["part"], row["shard"]))
    chosen = F.lit(False)
    for part, number in set(holders.values()):
        chosen |= (F.col("part") == part) & (F.col("shard") == number)
    for row in shards.where(chosen).select("part", "shard", "width", "payload", "index").collect():
        own = [k for k in holders if holders[k] == (row["part"], row["shard"])]
        ids = np.frombuffer(row["payload"], f"<u{row['width']}")
        for key, slot in zip(own, ShardIndex(bytes(row["index"])).find(np.array(own, np.int64))):
            if slot["copies"]:
                found[key] = ids[int(slot["start"]) : int(slot["start"]) + int(slot["size"])].astype(np.uint32)
    return found
