"""Incremental flow meter: the same flows, with their hellos, from packets that arrive in micro-batches.

Packets are packed to chunks before the shuffle; the state in RocksDB has for each conversation its open flow with
counters and orientation, the two instance counters, the hello search of the open flow, and the segments that wait
for a gap to close. Conversations are dealt to ``buckets`` by hash; a bucket is the key of the state, its flows are one list, which is
read and written as a whole. A micro-batch of one conversation is walked chunk by chunk in capture order, so a task
holds narrow records of 33 bytes a packet and the payloads of one chunk; payloads beyond ``PARK_BYTES`` wait
in the state store until their turn. Packets must arrive in capture order across micro-batches (the state keeps
the last number, and an earlier one raises). The result equals the batch meter then. Nothing is dropped as
late: a timestamp that runs backwards just counts, as it does in a batch.

A flow is emitted with ``final`` once it is closed or replaced. A stream has no last packet, so flows may
still be open at its end: ``open_flows`` reads them from the state of a stopped query. On the way they are
emitted with ``final`` false, after every batch they change in (``emit_open``) or once when they have been
open for a while (``open_after_ms``); ``latest_flows`` keeps the newest version of each.

A stream can start from what a batch has metered: ``handover`` makes its initial state.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowloom.operators import hello as hello_search
from flowloom.operators import tuples
from flowloom.operators.meter import FLOW_COLUMNS, average_wirelen, duration_ns
from flowloom.operators.sessionize import HOT_ROWS, label_packets
from flowloom.schema import ACTIVE_TIMEOUT_NS, HELLO_TYPE, PACKET_SCHEMA, TUPLE_KEY
from flowloom.session import ship_package
from flowloom.streaming.chunks import KEY_SCHEMA, PACKET, SEGMENT, packed_chunks
from flowloom.streaming.conversation import HELLO_FIELDS, STATE_FIELDS, SUMS, Conversation, Search, is_tcp

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Payload bytes of one conversation and micro-batch that a task keeps in memory.
PARK_BYTES = 32 << 20
# Of a longer tail the state has an entry of its own.
INLINE_BYTES = 1 << 12
# Flow versions that are told together at most, but for one step's.
TOLD_ROWS = 1 << 14
# Conversations share this many states, and so tasks; it stays the same as long as a checkpoint is used.
BUCKETS = 1 << 10
STEP_PACKETS = 1 << 16
BATCH_BYTES = 32 << 20
HELLO_SCHEMA = "legacy_version int, cipher_suites array<int>, extensions array<int>, has_sni boolean, alpn_protocols array<binary>"
LONGS = ", ".join(f"{n} long" for n in STATE_FIELDS + SUMS)
FLOW_STATE = f"{LONGS}, timer long, {HELLO_SCHEMA}"
BUCKET_STATE = f"{KEY_SCHEMA}, {FLOW_STATE}, next_seq long, tail binary, held_seq array<long>"
TIMER_AT = len(TUPLE_KEY) + len(STATE_FIELDS + SUMS)
SEARCH_STATE = "open_pkt long, next_seq long, tail binary, held long"
EMITTED = ["client_is_lo", "open_pkt", "flow_instance", "first_ts_ns", "last_ts_ns"] + SUMS
OUTPUT_SCHEMA = KEY_SCHEMA + ", client_is_lo boolean, " + ", ".join(f"{n} long" for n in EMITTED[1:]) + f", {HELLO_SCHEMA}, final boolean"
CARRIED = ["next_seq", "tail", "held_seq", "held_data"]


Part = tuple[np.ndarray, np.ndarray, bytes]


class Payloads:
    """Payload bytes of chunks by number; those beyond ``PARK_BYTES`` wait in the state store."""

    def __init__(self, parked) -> None:
        self.parked, self.kept, self.size, self.count = parked, {}, 0, 0

    def put(self, payload: bytes) -> int:
        number, self.count, self.size = self.count, self.count + 1, self.size + len(payload)
        if self.size <= PARK_BYTES:
            self.kept[number] = payload
        else:
            self.parked.updateValue((number,), (payload,))
        return number

    def take(self, number: int) -> bytes:
        if number in self.kept:
            return self.kept.pop(number)
        data = bytes(self.parked.getValue((number,))[0])
        self.parked.removeKey((number,))
        return data


# First and last packet number, packet and segment records, number of the payload.
Chunk = tuple[int, int, bytes, bytes, int]
CHUNK_COLUMNS = ("first_pkt", "last_pkt", "packets", "segments", "payload")


class FlowProcessor:
    """The meter of one conversation, over its state variables."""

    def __init__(self, timeout_ns: int, emit_open: bool, open_after_ms: int | None) -> None:
        self.timeout_ns, self.emit_open, self.open_after_ms = timeout_ns, emit_open, open_after_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.flow = handle.getValueState("flow", FLOW_STATE)
        self.search = handle.getValueState("search", SEARCH_STATE)
        self.held = handle.getMapState("held", "seq long", "data binary")
        self.parked = handle.getMapState("parked", "chunk long", "payload binary")

    def _load(self, key: tuple) -> tuple[Conversation, int]:
        values = self.flow.get()
        if values is None:
            return Conversation(is_tcp(key), self.timeout_ns), 0
        names = STATE_FIELDS + SUMS
        was, timer, fields = dict(zip(names, values)), values[len(names)], values[len(names) + 1 :]
        search = Search()
        if fields[0] is not None:
            search.hello = {n: _plain(v) for n, v in zip(HELLO_FIELDS, fields)}
        elif was["is_open"] and (saved := self.search.get()) is not None:
            held = {k[0]: bytes(v[0]) for k, v in self.held.iterator()} if saved[3] else {}
            search = Search.resumed(saved[1], bytes(saved[2]), held)
        return Conversation(is_tcp(key), self.timeout_ns, was, search), timer

    def _save(self, talk: Conversation, timer: int, before: dict[int, bytes]) -> None:
        was, search = talk.was, talk.search
        fields = [None] * len(HELLO_FIELDS)
        if was["is_open"] and search.hello is not None:
            fields = [search.hello[n] for n in HELLO_FIELDS]
        self.flow.update(tuple(int(was[n]) for n in STATE_FIELDS + SUMS) + (timer, *fields))
        wanted = search.client.held if was["is_open"] and search.begun() else {}
        for seq in before.keys() - wanted.keys():
            self.held.removeKey((seq,))
        for seq, data in wanted.items():
            if before.get(seq) != data:
                self.held.updateValue((seq,), (data,))
        if was["is_open"] and search.begun():
            self.search.update((was["open_pkt"], search.client.next_seq, search.seeker.tail(), len(wanted)))
        elif self.search.exists():
            self.search.clear()

    def _chunks(self, found: list[Chunk], payloads: Payloads) -> Iterator[Part]:
        """Packets in capture order, a bounded number at a time, each with its segments and payload bytes."""
        # Chunks in order of their first packet. What lies before the next chunk is ready; chunks whose ranges
        # overlap are merged as far as they do.
        packets, segments, payload = np.zeros(0, PACKET), np.zeros(0, SEGMENT), b""
        for i in sorted(range(len(found)), key=lambda i: found[i][:2]):
            if len(packets):
                ready = np.searchsorted(packets["pkt_no"], found[i][0])
                split = np.searchsorted(segments["pkt_no"], found[i][0])
                size = int(segments["size"][:split].sum())
                yield from _steps(packets[:ready], segments[:split], payload[:size])
                packets, segments, payload = packets[ready:], segments[split:], payload[size:]
            own = np.frombuffer(found[i][2], PACKET), np.frombuffer(found[i][3], SEGMENT), payloads.take(found[i][4])
            found[i] = None
            packets, segments, payload = _merged((packets, segments, payload), own) if len(packets) else own
        yield from _steps(packets, segments, payload)

    def metered(self, key: tuple, found: list[Chunk], payloads: Payloads, timerValues) -> Iterator[tuple[list[dict], bool]]:
        """Flows that the chunks of a micro-batch end, and the open one where it is to be told; whether they are final."""
        talk, timer = self._load(key)
        before = dict(talk.search.client.held)
        opened = talk.was["open_pkt"] if talk.was["is_open"] else None
        for packets, segments, payload in self._chunks(found, payloads):
            ended = talk.step(packets, segments, payload)
            if ended:
                yield ended, True
        now = talk.open_flow()
        if self.open_after_ms is not None and now is not None and now["open_pkt"] != opened:
            timer = timerValues.getCurrentProcessingTimeInMs() + self.open_after_ms
            self.handle.registerTimer(timer)
        self._save(talk, timer, before)
        if self.emit_open and now is not None:
            yield [now], False

    def expired(self, key: tuple, at: int) -> list[dict]:
        talk, timer = self._load(key)
        # The timer of a flow that has ended since says nothing about the one after it.
        return [now] if (now := talk.open_flow()) is not None and timer == at else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        payloads, found = Payloads(self.parked), []
        for frame in rows:
            for *chunk, payload in zip(*[frame[c] for c in CHUNK_COLUMNS]):
                found.append((*chunk, payloads.put(payload)))
        for flows, final in self.metered(key, found, payloads, timerValues):
            yield _frame([(key, row, final) for row in flows])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if told := self.expired(key, expiredTimerInfo.getExpiryTimeInMs()):
            yield _frame([(key, row, False) for row in told])

    def begin(self, key: tuple, row: dict) -> None:
        """Make the state of a row of ``handover``."""
        search = Search()
        if row["legacy_version"] is not None and not pd.isna(row["legacy_version"]):
            search.hello = {n: _plain(row[n]) for n in HELLO_FIELDS}
        elif row["tail"] is not None:
            held = {} if row["held_seq"] is None else dict(zip(map(int, row["held_seq"]), map(bytes, row["held_data"])))
            search = Search.resumed(int(row["next_seq"]), bytes(row["tail"]), held)
        was = {n: int(row[n]) for n in STATE_FIELDS + SUMS}
        self._save(Conversation(is_tcp(key), self.timeout_ns, was, search), 0, {})


class Slot:
    """A state variable of one conversation, in memory."""

    def __init__(self, held: tuple | None = None) -> None:
        self.held = held

    def get(self) -> tuple | None:
        return self.held

    def exists(self) -> bool:
        return self.held is not None

    def update(self, value: tuple) -> None:
        self.held = value

    def clear(self) -> None:
        self.held = None


class Share:
    """One conversation's entries of a map state that a bucket's conversations share."""

    def __init__(self, state, key: tuple, seqs: Iterable[int] = ()) -> None:
        self.state, self.key, self.seqs = state, key, set(seqs)

    def iterator(self) -> Iterator[tuple[tuple, tuple]]:
        return (((seq,), self.state.getValue((*self.key, seq))) for seq in sorted(self.seqs))

    def updateValue(self, key: tuple, value: tuple) -> None:
        self.seqs.add(key[0])
        self.state.updateValue((*self.key, *key), value)

    def removeKey(self, key: tuple) -> None:
        self.seqs.discard(key[0])
        self.state.removeKey((*self.key, *key))


class BucketProcessor(StatefulProcessor):
    """Meters the conversations of a bucket, whose state is one list: a call and its rows cost much more than a conversation."""

    def __init__(self, timeout_ns: int, emit_open: bool, open_after_ms: int | None) -> None:
        self.own = FlowProcessor(timeout_ns, emit_open, open_after_ms)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.own.handle = handle
        self.flows = handle.getListState("flow", BUCKET_STATE)
        self.held = handle.getMapState("held", f"{KEY_SCHEMA}, seq long", "data binary")
        self.tails = handle.getMapState("tails", KEY_SCHEMA, "tail binary")
        self.parked = handle.getMapState("parked", "chunk long", "payload binary")

    def _opened(self, key: tuple, row: tuple | None) -> None:
        """Give the meter the state of a conversation."""
        own, self.large = self.own, False
        own.flow, own.search, own.held = Slot(), Slot(), Share(self.held, key)
        if row is None:
            return
        own.flow.held, (next_seq, tail, seqs) = row[len(TUPLE_KEY) : -3], row[-3:]
        if next_seq is not None:
            self.large = tail is None
            tail = self.tails.getValue(key)[0] if self.large else tail
            own.search.held = (None, next_seq, tail, len(seqs))
            own.held.seqs.update(seqs)

    def _closed(self, key: tuple) -> tuple:
        """The meter's state of a conversation as a row; a long tail has an entry of its own."""
        own = self.own
        next_seq, tail, seqs = None, None, None
        if own.search.held is not None:
            _, next_seq, tail, _ = own.search.held
            seqs = sorted(own.held.seqs)
        if tail is not None and len(tail) > INLINE_BYTES:
            self.tails.updateValue(key, (tail,))
            tail = None
        elif self.large:
            self.tails.removeKey(key)
        return (*key, *own.flow.held, next_seq, tail, seqs)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        payloads, found = Payloads(self.parked), {}
        for frame in rows:
            keys = zip(*[_whole(frame[c]) for c in TUPLE_KEY])
            for conversation, (*chunk, payload) in zip(keys, zip(*[frame[c] for c in CHUNK_COLUMNS])):
                found.setdefault(conversation, []).append((*chunk, payloads.put(payload)))
        if not found:
            return
        state = {row[: len(TUPLE_KEY)]: row for row in self.flows.get()}
        told = []
        for conversation in found:
            self._opened(conversation, state.get(conversation))
            for flows, final in self.own.metered(conversation, found[conversation], payloads, timerValues):
                told += [(conversation, row, final) for row in flows]
                if len(told) >= TOLD_ROWS:
                    yield _frame(told)
                    told = []
            state[conversation] = self._closed(conversation)
            found[conversation] = None
        self.flows.put(list(state.values()))
        if told:
            yield _frame(told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        told = []
        for row in self.flows.get():
            conversation = row[: len(TUPLE_KEY)]
            if row[TIMER_AT] == expiredTimerInfo.getExpiryTimeInMs():
                self._opened(conversation, row)
                told += [(conversation, flow, False) for flow in self.own.expired(conversation, row[TIMER_AT])]
        if told:
            yield _frame(told)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        rows = []
        keys = zip(*[_whole(initialState[c]) for c in TUPLE_KEY])
        for conversation, row in zip(keys, initialState.to_dict("records")):
            self._opened(conversation, None)
            self.own.begin(conversation, row)
            rows.append(self._closed(conversation))
        self.flows.appendList(rows)

    def close(self) -> None:
        pass


def _steps(packets: np.ndarray, segments: np.ndarray, payload: bytes) -> Iterator[Part]:
    """A bounded number of packets at a time, with their segments and payload bytes; all are in order."""
    at = 0
    for begin in range(0, len(packets), STEP_PACKETS):
        part = packets[begin : begin + STEP_PACKETS]
        low, high = np.searchsorted(segments["pkt_no"], [part["pkt_no"][0], part["pkt_no"][-1] + 1])
        size = int(segments["size"][low:high].sum())
        yield part, segments[low:high], payload[at : at + size]
        at += size


def _merged(one: Part, two: Part) -> Part:
    packets, segments, payload = np.concatenate([one[0], two[0]]), np.concatenate([one[1], two[1]]), one[2] + two[2]
    end = np.cumsum(segments["size"])
    order = np.argsort(segments["pkt_no"], kind="stable")
    parts = zip((end - segments["size"])[order].tolist(), end[order].tolist())
    return packets[np.argsort(packets["pkt_no"], kind="stable")], segments[order], b"".join(payload[a:b] for a, b in parts)


def _plain(value):
    """A state value in the types that rows take."""
    if isinstance(value, (bytearray, bytes)):
        return bytes(value)
    if isinstance(value, (list, tuple, np.ndarray)):
        return [_plain(v) for v in value]
    return value.item() if isinstance(value, np.generic) else value


def _whole(column: pd.Series) -> list:
    """Key values in the types of the state; whole numbers with nulls come as floats."""
    return [None if v != v else int(v) for v in column] if column.dtype.kind == "f" else column.tolist()


def _frame(told: list[tuple[tuple, dict, bool]]) -> pd.DataFrame:
    """Flow versions (conversation, row, final) as output rows."""
    keys, rows, final = zip(*told)
    out = pd.DataFrame(dict(zip(TUPLE_KEY, map(list, zip(*keys)))))
    for name in EMITTED:
        out[name] = [r[name] for r in rows]
    out["client_is_lo"] = out["client_is_lo"].astype(bool)
    hellos = [r["hello"] or dict.fromkeys(HELLO_FIELDS) for r in rows]
    for name in HELLO_FIELDS:
        out[name] = pd.Series([h[name] for h in hellos], dtype="Int32" if name == "legacy_version" else object)
    out["final"] = final
    return out


def stream_packets(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Packet files of a folder as a stream, oldest file first."""
    reader = spark.readStream.schema(PACKET_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def _flow_columns(rows: DataFrame) -> DataFrame:
    """Flow table columns and ``hello`` from the meter's own."""
    found = F.when(F.col("legacy_version").isNotNull(), F.struct(*HELLO_FIELDS)).cast(HELLO_TYPE)
    derived = {**tuples.endpoints(), "duration_ns": duration_ns(), "avg_wirelen_total": average_wirelen(), "hello": found}
    return rows.withColumns(derived)


def meter_stream(
    packets: DataFrame,
    timeout_ns: int = ACTIVE_TIMEOUT_NS,
    *,
    with_tls: bool = False,
    emit_open: bool = True,
    open_after_ms: int | None = None,
    initial: DataFrame | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Flow versions of a packet stream, with ``hello`` if ``with_tls``; write it in update mode.

    Sets the session's state store to RocksDB, which keeps state off the heap, and bounds its Arrow batches. ``initial`` is the table of
    ``handover``; it takes effect in the first batch of a new checkpoint.
    """
    spark = packets.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    # Chunks are large rows: a batch of them is bounded by its bytes.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    bucket = F.pmod(F.xxhash64(*TUPLE_KEY), F.lit(buckets)).cast("int").alias("bucket")
    versions = packed_chunks(packets, with_tls).select(bucket, "*").groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=BucketProcessor(timeout_ns, emit_open, open_after_ms),
        outputStructType=OUTPUT_SCHEMA,
        outputMode="Update",
        timeMode="None" if open_after_ms is None else "ProcessingTime",
        initialState=None if initial is None else initial.select(bucket, "*").groupBy("bucket"),
    )
    return _flow_columns(versions).select(*FLOW_COLUMNS, *["hello"] * with_tls, "final")


def open_flows(spark: SparkSession, checkpoint: str, *, with_tls: bool = False) -> DataFrame:
    """Flows that are open in the state of a stopped query."""
    state = spark.read.format("statestore").option("stateVarName", "flow").load(checkpoint)
    rows = state.select("list_element.*").filter("is_open = 1").withColumn("client_is_lo", F.col("client_is_lo") == 1)
    instance = F.when(F.col("client_is_lo"), F.col("lo_flows")).otherwise(F.col("hi_flows")) - 1
    return _flow_columns(rows.withColumn("flow_instance", instance)).select(*FLOW_COLUMNS, *["hello"] * with_tls)


def handover(packets: DataFrame, flows: DataFrame, timeout_ns: int = ACTIVE_TIMEOUT_NS, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Initial state of a stream that goes on behind ``packets``, whose flow table is ``flows``.

    One row per conversation: how many flows each side has opened, the last flow, and whether it is open.
    A conversation's last flow is open unless FIN or RST closed it. If ``flows`` has hellos, open
    flows without one carry on their search: their client payloads are read once more.
    """
    with_tls = "hello" in flows.columns
    keyed = tuples.with_tuple(
        flows.withColumns({"src_ip": F.col("client_ip"), "dst_ip": F.col("server_ip"), "src_port": F.col("client_port"), "dst_port": F.col("server_port")})
    ).withColumnRenamed("src_is_lo", "client_is_lo")
    side = F.col("client_is_lo")
    named = [c for c in STATE_FIELDS if c in ("open_pkt", "first_ts_ns", "last_ts_ns")] + ["client_is_lo"] + SUMS + ["hello"] * with_tls
    last = keyed.groupBy(*TUPLE_KEY).agg(
        F.count_if(side).alias("lo_flows"), F.count_if(~side).alias("hi_flows"), F.max_by(F.struct(*named), "open_pkt").alias("last")
    )
    parsed = tuples.with_tuple(tuples.parsed_packets(packets.select("capture_id", "pkt_no", "src_ip", "dst_ip", "src_port", "dst_port", "proto")))
    # All these tables grow with the conversations; by the size of a small file behind them they would be broadcast from the driver.
    last = last.join(parsed.groupBy(*TUPLE_KEY).agg(F.max("pkt_no").alias("last_pkt")).hint("merge"), TUPLE_KEY)
    rows = last.select(*TUPLE_KEY, "lo_flows", "hi_flows", "last_pkt", "last.*")
    closed = tuples.is_tcp() & ((F.col("tcp_fin_total") + F.col("tcp_rst_total")) > 0)
    rows = rows.withColumns({"is_open": (~closed).cast("long"), "client_is_lo": F.col("client_is_lo").cast("long")})
    search = {"next_seq": F.lit(None).cast("long"), "tail": F.lit(None).cast("binary"), "held_seq": F.lit(None).cast("array<long>"), "held_data": F.lit(None).cast("array<binary>")}
    if not with_tls:
        fields = {n: F.lit(None).cast(HELLO_TYPE[n].dataType) for n in HELLO_FIELDS}
        return rows.withColumns({**fields, **search}).select(*TUPLE_KEY, *STATE_FIELDS, *SUMS, *HELLO_FIELDS, *CARRIED)
    wanted = rows.filter((F.col("is_open") == 1) & F.col("hello").isNull() & tuples.is_tcp()).select("capture_id", "open_pkt")
    labels = label_packets(packets, timeout_ns, hot_rows).filter("c2s").select("capture_id", "open_pkt", "pkt_no")
    bytes_ = packets.filter(tuples.is_tcp() & (F.col("payload_len") > 0)).select("capture_id", "pkt_no", "seq", "payload")
    segments = labels.join(wanted.hint("merge"), ["capture_id", "open_pkt"], "left_semi").join(bytes_.hint("merge"), ["capture_id", "pkt_no"])
    searched = hello_search.open_searches(segments).withColumnRenamed("hello", "_hello")
    rows = rows.withColumns({n: F.col("hello")[n] for n in HELLO_FIELDS}).join(searched.hint("merge"), ["capture_id", "open_pkt"], "left")
    return rows.select(*TUPLE_KEY, *STATE_FIELDS, *SUMS, *HELLO_FIELDS, *CARRIED)


def latest_flows(versions: DataFrame) -> DataFrame:
    """The newest version of each flow: the one with most packets."""
    name = ["capture_id", "open_pkt"]
    rest = [c for c in versions.columns if c not in name]
    newest = F.max_by(F.struct(*rest), F.struct("packets_total", "final")).alias("newest")
    return versions.groupBy(*name).agg(newest).select(*name, "newest.*").select(*versions.columns)


def append_versions(versions: DataFrame, path: str, checkpoint: str):
    """Start writing flow versions to a table; each micro-batch replaces its own folder only.

    A batch that runs again after a failure writes the same rows to the same place.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        versions.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
    )
