"""Packets of one conversation as packed chunks: what the stateful meter gets through its shuffle.

A task packs each conversation's packets of an Arrow batch into one row: fixed-width records of
what the meter counts, and the TCP payloads one after the other. So a conversation of millions of packets
is a few hundred rows, which are put in order by their first packet number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.operators import tuples
from flowloom.operators.meter import METER_COLUMNS
from flowloom.schema import TCP, TUPLE_KEY

FLAGS = ["src_is_lo", "syn", "ack", "fin", "rst", "psh"]
PACKET = np.dtype([("pkt_no", "<i8"), ("ts_ns", "<i8"), ("caplen", "<i8"), ("wirelen", "<i8"), ("flags", "u1")])
SEGMENT = np.dtype([("pkt_no", "<i8"), ("seq", "<i8"), ("size", "<i8"), ("src_is_lo", "?")])
KEY_SCHEMA = "capture_id string, lo_ip string, lo_port int, hi_ip string, hi_port int, proto int"
CHUNK_SCHEMA = KEY_SCHEMA + ", first_pkt long, last_pkt long, packets binary, segments binary, payload binary"
# Payload bytes that are packed together at most, but for a single larger packet.
PAYLOAD_BYTES = 4 << 20


def _codes(batch: pa.RecordBatch) -> np.ndarray:
    """A number for each row's conversation."""
    codes = np.zeros(batch.num_rows, np.int64)
    for name in TUPLE_KEY:
        index = batch.column(name).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        codes = np.unique(codes * (int(index.max(initial=0)) + 1) + index, return_inverse=True)[1]
    return codes


def _binaries(data: pa.Buffer | bytes, bounds: np.ndarray) -> pa.Array:
    offsets = pa.py_buffer(np.ascontiguousarray(bounds, np.int32))
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, offsets, data if isinstance(data, pa.Buffer) else pa.py_buffer(data)])


def pack(batch: pa.RecordBatch, with_tls: bool) -> pa.RecordBatch:
    """One row per conversation of the batch."""
    codes, number = _codes(batch), batch.column("pkt_no").to_numpy()
    order = np.lexsort((number, codes))
    codes = codes[order]
    begin = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    bounds = np.append(begin, len(order))

    def sorted_(name: str) -> np.ndarray:
        return batch.column(name).to_numpy(zero_copy_only=False)[order]

    packets = np.zeros(len(order), PACKET)
    for name in ("pkt_no", "ts_ns", "caplen", "wirelen"):
        packets[name] = sorted_(name)
    for bit, name in enumerate(FLAGS):
        packets["flags"] |= sorted_(name).astype(np.uint8) << bit
    carries = np.zeros(0, np.int64)
    if with_tls:
        full = batch.column("payload").is_valid().to_numpy(zero_copy_only=False)[order]
        carries = np.flatnonzero(full & (sorted_("proto") == TCP) & (sorted_("payload_len") > 0))
    segments = np.zeros(len(carries), SEGMENT)
    data, ends = pa.py_buffer(b""), np.zeros(1, np.int64)
    if len(carries):
        taken = batch.column("payload").take(pa.array(order[carries])).cast(pa.large_binary())
        ends = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1, 8 * taken.offset)
        data, ends = taken.buffers()[2].slice(ends[0], ends[-1] - ends[0]) if ends[-1] > ends[0] else data, ends - ends[0]
        segments["pkt_no"], segments["seq"] = packets["pkt_no"][carries], sorted_("seq")[carries]
        segments["size"], segments["src_is_lo"] = np.diff(ends), packets["flags"][carries] & 1
    split = np.searchsorted(carries, bounds)
    rows = batch.take(pa.array(order[begin]))
    arrays = [rows.column(c) for c in TUPLE_KEY] + [pa.array(packets["pkt_no"][begin]), pa.array(packets["pkt_no"][bounds[1:] - 1])]
    arrays += [_binaries(packets.tobytes(), bounds * PACKET.itemsize), _binaries(segments.tobytes(), split * SEGMENT.itemsize), _binaries(data, ends[split])]
    return pa.RecordBatch.from_arrays(arrays, [*TUPLE_KEY, "first_pkt", "last_pkt", "packets", "segments", "payload"])


def packed_chunks(packets: DataFrame, with_tls: bool) -> DataFrame:
    """Chunks (CHUNK_SCHEMA) of the TCP and UDP packets of a batch or a stream."""
    columns = METER_COLUMNS + (["seq", "payload", "payload_len"] if with_tls else [])
    keyed = tuples.with_tuple(tuples.parsed_packets(packets.select(*columns)))
    if with_tls:
        # What is no TCP segment with bytes need not travel.
        keyed = keyed.withColumn("payload", F.when(tuples.is_tcp() & (F.col("payload_len") > 0) & F.col("seq").isNotNull(), F.col("payload")))
        keyed = keyed.withColumn("seq", F.coalesce("seq", F.lit(0).cast("long")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("payload").nbytes if with_tls else 0
            step = max(1, batch.num_rows if size <= PAYLOAD_BYTES else batch.num_rows * PAYLOAD_BYTES // size)
            for begin in range(0, batch.num_rows, step):
                yield pack(batch.slice(begin, step), with_tls)

    return keyed.mapInArrow(run, CHUNK_SCHEMA)
