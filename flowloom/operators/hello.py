"""Reassemble client streams and find the first ClientHello of each flow.

Payloads stay out of the sessionization shuffle. A narrow index says which packets of which
flows matter: client payloads of flows in which some payload may begin a hello. The index
parts each flow's packets in batches of bounded size; payloads are joined to it by packet
number, and each batch of a flow is one group for the Python reassembler. A hello is nearly
always in the first, small batch; flows without one go on to the next batch with the state
carried in a durable table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from flowloom.functions import tls
from flowloom.functions.bitmaps import marked
from flowloom.functions.reassembly import ClientStream
from flowloom.operators import tuples
from flowloom.operators.meter import METER_COLUMNS, measure_flows
from flowloom.operators.sessionize import HOT_ROWS, LABEL_COLUMNS, Hot, assign_flows, find_hot
from flowloom.schema import ACTIVE_TIMEOUT_NS, FLOW_KEY, HELLO_TYPE, TUPLE_KEY
from flowloom.session import durable, scratch_folder

FLOW_ID = ["capture_id", "open_pkt"]
INDEX_COLUMNS = FLOW_ID + ["pkt_no", "seq", "payload_len", "batch", "talk"]
SEGMENT_COLUMNS = FLOW_ID + ["pkt_no", "seq", "payload", "held_seq", "held_data"]
FIRST_BATCH_BYTES = 1 << 20
BATCH_BYTES = 32 << 20
# Arrival-order range whose payloads of one flow stay together in a hot conversation.
CHUNK_PACKETS = 4096

STATE_SCHEMA = T.StructType(
    [
        T.StructField("capture_id", T.StringType()),
        T.StructField("open_pkt", T.LongType()),
        T.StructField("hello", HELLO_TYPE),
        T.StructField("next_seq", T.LongType()),
        T.StructField("tail", T.BinaryType()),
        T.StructField("held_seq", T.ArrayType(T.LongType())),
        T.StructField("held_data", T.ArrayType(T.BinaryType())),
    ]
)
# pkt_no of the row that carries the state of a flow into the next round.
STATE_ROW = -1


def client_payloads(labelled: DataFrame) -> DataFrame:
    return labelled.filter(tuples.is_tcp() & tuples.from_client() & (F.col("payload_len") > 0))


Sizes = tuple[int, int]


def _step(before: Column, sizes: Sizes | None) -> Column:
    """Batch of a packet by the payload bytes of its flow before it."""
    first, other = sizes or (FIRST_BATCH_BYTES, BATCH_BYTES)
    late = F.floor((before - first) / other).cast("long") + 1
    return F.when(before < first, F.lit(0).cast("long")).otherwise(late)


def _index_cold(payloads: DataFrame, sizes: Sizes | None) -> DataFrame:
    """Windows over flows, in the partitioning the labels already have."""
    order = Window.partitionBy(*FLOW_KEY).orderBy("pkt_no")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return (
        payloads.withColumns(
            {
                "begins": F.max("begins").over(whole),
                "before": F.coalesce(F.sum("payload_len").over(before), F.lit(0)),
            }
        )
        .filter("begins")
        .withColumn("step", _step(F.col("before"), sizes))
        .withColumn("turn", F.coalesce(F.col("step") != F.lag("step").over(order), F.lit(False)))
        # Numbered without gaps: the state a batch resumes from is that of the round before.
        .withColumn("batch", F.sum(F.col("turn").cast("long")).over(upto))
        .select(*INDEX_COLUMNS)
    )


def _index_hot(payloads: DataFrame, sizes: Sizes | None) -> DataFrame:
    """The same for flows of any length, from one summary row per flow and chunk."""
    found = payloads.withColumn("chunk", F.expr(f"pkt_no div {CHUNK_PACKETS}"))
    flow = Window.partitionBy(*FLOW_ID)
    before = flow.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        found.groupBy(*FLOW_ID, "chunk")
        .agg(F.sum("payload_len").alias("bytes"), F.max("begins").alias("begins"))
        .withColumn("before", F.coalesce(F.sum("bytes").over(before), F.lit(0)))
        .withColumn("begins", F.max("begins").over(flow))
        .filter("begins")
        .withColumn("step", _step(F.col("before"), sizes))
        .withColumn("batch", F.dense_rank().over(flow.orderBy("step")).cast("long") - 1)
        .select(*FLOW_ID, "chunk", "batch")
    )
    return found.join(sizes, FLOW_ID + ["chunk"]).select(*INDEX_COLUMNS)


def payload_index(packets: DataFrame, timeout_ns: int, hot: Hot | None, sizes: Sizes | None = None) -> DataFrame:
    """Client payload packets of flows that may hold a hello, with their batch number."""
    begins = F.coalesce(tls.may_begin_hello(F.col("payload")), F.lit(False)).alias("begins")
    narrow = packets.select(*LABEL_COLUMNS, "seq", "payload_len", begins)
    cold, large = assign_flows(narrow, timeout_ns, hot)
    columns = FLOW_KEY + ["pkt_no", "seq", "payload_len", "begins"]
    talk = F.xxhash64(*TUPLE_KEY).alias("talk")
    index = _index_cold(client_payloads(cold).select(*columns, talk), sizes)
    if large is not None:
        index = index.unionByName(_index_hot(client_payloads(large).select(*columns, talk), sizes))
    return index


def eligible_payloads(packets: DataFrame, index: DataFrame, talks: int) -> DataFrame:
    """Payloads (capture_id, pkt_no, payload) of the conversations in the index, and of few others.

    A bitmap of the conversations' hashes, ``talks`` of them, goes to all tasks, so that the payloads of the
    rest never enter a shuffle.
    """
    sent = packets.filter(tuples.is_tcp() & (F.col("payload_len") > 0))
    names = ["capture_id", "pkt_no", "src_ip", "dst_ip", "src_port", "dst_port", "proto", "payload"]
    sent = tuples.with_tuple(sent.select(*names)).select("capture_id", "pkt_no", "payload", F.xxhash64(*TUPLE_KEY).alias("talk"))
    return marked(sent, index, talks, key="talk", flag="met").filter("met").select("capture_id", "pkt_no", "payload")


def continuing(states: DataFrame, later: DataFrame) -> DataFrame:
    """States of flows whose stream still grows: a later segment covers its next byte.

    Without one the bytes held behind the gap never count, however many more there are.
    """
    spread = FLOW_ID + ["batch"]
    # One row per flow and batch, so that a flow with many segments is not one join key.
    ends = states.select(*FLOW_ID, "next_seq").join(later.select(*spread).distinct(), FLOW_ID)
    gap = F.col("next_seq") - F.col("seq")
    grows = (gap >= 0) & (gap < F.col("payload_len"))
    alive = later.join(ends, spread).filter(grows).select(*FLOW_ID).distinct()
    return states.join(alive, FLOW_ID, "left_semi")


class _Search:
    """First hello of one flow, from its segments in arrival order."""

    schema = STATE_SCHEMA

    def __init__(self) -> None:
        self.client = ClientStream()
        self.search = tls.HelloSearch()
        self.hello: tls.Fields | None = None

    def resume(self, next_seq: int, tail: bytes, held: dict[int, bytes]) -> None:
        self.client = ClientStream(next_seq, held)
        self.search.feed(tail)

    def add(self, seq: int, payload: bytes) -> None:
        if self.hello is None:
            fresh = self.client.feed(seq, payload)
            self.hello = self.search.feed(fresh) if fresh else None

    def result(self) -> tuple:
        if self.hello is not None:
            return self.hello._asdict(), None, None, None, None
        held = self.client.held
        return None, self.client.next_seq, self.search.tail(), list(held), list(held.values())


class _Stream:
    """All in-order bytes of one flow."""

    schema = T.StructType([*STATE_SCHEMA.fields[:2], T.StructField("stream", T.BinaryType())])

    def __init__(self) -> None:
        self.client = ClientStream()
        self.stream = bytearray()

    def add(self, seq: int, payload: bytes) -> None:
        self.stream += self.client.feed(seq, payload)

    def result(self) -> tuple:
        return (bytes(self.stream),)


def _per_flow(segments: DataFrame, kind: type) -> DataFrame:
    """Run ``kind`` over each flow's segments; a task streams through its sorted flows.

    Flows lie one after the other in a partition, so that a task holds one flow's state and
    one Arrow batch, however many flows or segments there are.
    """
    schema = to_arrow_schema(kind.schema)

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flow, worker, done = None, None, []
        for batch in batches:
            for *name, pkt_no, seq, payload, held_seq, held in zip(*[c.to_pylist() for c in batch.columns]):
                if name != flow:
                    if worker is not None:
                        done.append((*flow, *worker.result()))
                    flow, worker = name, kind()
                if pkt_no == STATE_ROW:
                    worker.resume(seq, payload, dict(zip(held_seq, held)))
                else:
                    worker.add(seq, payload)
            if done:
                yield emit(done)
                done = []
        if worker is not None:
            yield emit([(*flow, *worker.result())])

    placed = segments.select(*SEGMENT_COLUMNS).repartition(*FLOW_ID).sortWithinPartitions(*FLOW_ID, "pkt_no")
    return placed.mapInArrow(run, kind.schema)


def _without_state(segments: DataFrame) -> DataFrame:
    return segments.withColumns(
        {
            "held_seq": F.lit(None).cast("array<bigint>"),
            "held_data": F.lit(None).cast("array<binary>"),
        }
    )


def _state_rows(states: DataFrame) -> DataFrame:
    """Carried state as a first segment of the flow."""
    return states.select(
        *FLOW_ID,
        F.lit(STATE_ROW).cast("long").alias("pkt_no"),
        F.col("next_seq").alias("seq"),
        F.col("tail").alias("payload"),
        "held_seq",
        "held_data",
    )


def first_hellos(
    packets: DataFrame, timeout_ns: int = ACTIVE_TIMEOUT_NS, hot_rows: int | None = HOT_ROWS, sizes: Sizes | None = None
) -> DataFrame:
    """First ClientHello of each flow that has one: FLOW_ID and ``hello``.

    ``sizes`` are the bytes of a flow's first batch and of the others.
    """
    return _first_hellos(packets, timeout_ns, find_hot(packets, timeout_ns, hot_rows), sizes)


def _first_hellos(packets: DataFrame, timeout_ns: int, hot: Hot | None, sizes: Sizes | None = None) -> DataFrame:
    index = durable(payload_index(packets, timeout_ns, hot, sizes))
    last, talks = index.agg(F.max("batch"), F.approx_count_distinct("talk")).first()
    # The index grows with the flows; by the size of a small file behind it it would be broadcast from the driver.
    parts = index.drop("talk").hint("merge").join(eligible_payloads(packets, index, talks), ["capture_id", "pkt_no"])
    if last:
        # Payloads are fetched once for all rounds; each round reads the files of its own batch.
        folder = scratch_folder(packets.sparkSession, "payload-batches")
        parts.write.partitionBy("batch").parquet(folder)
        parts = packets.sparkSession.read.schema(parts.schema).parquet(folder)
    rounds: list[DataFrame] = []
    for batch in range(0 if last is None else last + 1):
        part = parts.filter(F.col("batch") == batch)
        if batch:
            open_flows = rounds[-1].filter(F.col("hello").isNull())
            open_flows = durable(continuing(open_flows, index.filter(F.col("batch") >= batch)))
            if open_flows.isEmpty():
                break
            part = part.join(open_flows.select(*FLOW_ID), FLOW_ID, "left_semi")
        segments = _without_state(part)
        if batch:
            segments = segments.select(*SEGMENT_COLUMNS).unionByName(_state_rows(open_flows))
        found = _per_flow(segments, _Search)
        # The last round need not be kept: nothing resumes from it.
        rounds.append(durable(found) if batch < last else found)
    if not rounds:
        empty = T.StructType([STATE_SCHEMA[n] for n in FLOW_ID + ["hello"]])
        return packets.sparkSession.createDataFrame([], empty)
    hits = [r.filter(F.col("hello").isNotNull()).select(*FLOW_ID, "hello") for r in rounds]
    return reduce(DataFrame.unionByName, hits)


def client_streams(segments: DataFrame) -> DataFrame:
    """Whole client stream of each flow from (FLOW_ID, pkt_no, seq, payload).

    A stream is one value, so this is for flows whose bytes fit in one; ``first_hellos``
    never builds whole streams.
    """
    return _per_flow(_without_state(segments), _Stream)


def open_searches(segments: DataFrame) -> DataFrame:
    """STATE_SCHEMA of each flow of (FLOW_ID, pkt_no, seq, payload): what a search needs to go on later."""
    return _per_flow(_without_state(segments), _Search)


def attach_hellos(flows: DataFrame, hellos: DataFrame) -> DataFrame:
    """Flows with their nullable ``hello``."""
    return flows.join(hellos, FLOW_ID, "left")


def hello_flag() -> Column:
    return F.col("hello").isNotNull().cast("long").alias("tls_client_hello_c2s")


def flow_table(
    packets: DataFrame,
    with_tls: bool = True,
    timeout_ns: int = ACTIVE_TIMEOUT_NS,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """One row per flow instance; with_tls=False leaves the ``hello`` column NULL."""
    hot = find_hot(packets, timeout_ns, hot_rows)
    flows = measure_flows(*assign_flows(packets.select(*METER_COLUMNS), timeout_ns, hot))
    if not with_tls:
        return flows.withColumn("hello", F.lit(None).cast(HELLO_TYPE))
    return attach_hellos(flows, _first_hellos(packets, timeout_ns, hot))
