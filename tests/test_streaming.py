"""The stream gives the flows of the batch, whatever the micro-batches are."""

import random
import types

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowloom.operators.hello import flow_table
from flowloom.operators.meter import FLOW_COLUMNS, meter_flows
from flowloom.schema import PACKET_SCHEMA, TUPLE_KEY
from flowloom.streaming import meter
from flowloom.streaming.chunks import FLAGS, SEGMENT, pack
from flowloom.streaming.conversation import STATE_FIELDS, SUMS
from flowloom.session import durable
from flowloom.streaming.meter import append_versions, handover, latest_flows, meter_stream, open_flows, stream_packets
from tests.test_sessionize import frame, random_packets
from tests.test_tls import HELLO


def full(df):
    missing = {"seq": F.lit(None), "payload": F.lit(None), "payload_len": F.lit(0)}
    wide = df.withColumns({n: c for n, c in missing.items() if n not in df.columns})
    return wide.select(*[F.col(f.name).cast(f.dataType) for f in PACKET_SCHEMA])


@pytest.mark.parametrize("batches, jitter", [(1, 0.1), (4, 0.0), (6, 0.2)])
def test_stream_equals_batch(spark, tmp_path, batches, jitter):
    rows = random_packets(7, 900, jitter)
    size = -(-len(rows) // batches)
    folder = str(tmp_path / "packets")
    for i in range(batches):
        part = full(frame(spark, rows[i * size : (i + 1) * size])).coalesce(1)
        part.write.mode("append").parquet(folder)
    versions = meter_stream(stream_packets(spark, folder, files_per_trigger=1))
    out = str(tmp_path / "flows")
    query = append_versions(versions, out, str(tmp_path / "checkpoint"))
    query.awaitTermination(120)
    query.stop()
    emitted = spark.read.option("basePath", out).parquet(out).drop("batch")
    assert emitted.filter("final").groupBy("capture_id", "open_pkt").count().filter("count > 1").count() == 0
    want = sorted(meter_flows(frame(spark, rows)).collect())
    assert sorted(latest_flows(emitted).select(*FLOW_COLUMNS).collect()) == want


def test_stream_out_of_order_is_an_error(spark, tmp_path):
    rows, folder = random_packets(7, 300, 0.0), str(tmp_path / "packets")
    for part in (rows[150:], rows[:150]):
        full(frame(spark, part)).coalesce(1).write.mode("append").parquet(folder)
    versions = meter_stream(stream_packets(spark, folder, files_per_trigger=1))
    query = append_versions(versions, str(tmp_path / "flows"), str(tmp_path / "checkpoint"))
    with pytest.raises(Exception, match="out of capture order"):
        query.awaitTermination(120)


KEY = ("c", "a", 1, "b", 2, 6)


class Store:
    """State variables of one key, as the meter sees them."""

    def __init__(self):
        self.variables, self.timers, self.most = {}, [], 0

    def getValueState(self, name, schema):
        return self.variables.setdefault(name, Value())

    def getMapState(self, name, key, value):
        return self.variables.setdefault(name, Map())

    def registerTimer(self, at):
        self.timers.append(at)


class Value:
    held = None

    def get(self):
        return self.held

    def exists(self):
        return self.held is not None

    def update(self, value):
        self.held = value

    def clear(self):
        self.held = None


class Map(dict):
    most = 0

    def updateValue(self, key, value):
        self[key] = value
        self.most = max(self.most, len(self))

    def getValue(self, key):
        return self.get(key)

    def removeKey(self, key):
        del self[key]

    def iterator(self):
        return iter(list(self.items()))


def clock(now=0):
    return types.SimpleNamespace(getCurrentProcessingTimeInMs=lambda: now, getExpiryTimeInMs=lambda: now)


def processor(store, **options):
    own = meter.FlowProcessor(options.pop("timeout_ns", 120_000_000_000), options.pop("emit_open", False), options.pop("open_after_ms", None))
    own.init(store)
    return own


def talk(count, hello, piece, loss=0.0, seed=1, syn_every=0):
    """Packets of one TCP conversation; the client sends ``hello`` behind other bytes, in pieces, some swapped."""
    rng, rows, sent = random.Random(seed), [], 0
    stream = b"x" * 37 + hello + b"y" * (count * piece)
    for i in range(count):
        client = i % 3 != 1
        data = stream[sent : sent + piece] if client and i else b"server bytes" * (i % 3 == 1)
        syn = i == 0 or bool(syn_every and i % syn_every == 0)
        if syn:
            sent, data = 0, b""
        rows.append([i, i * 1000, 60 + len(data), 70 + len(data), client, syn, not syn, False, False, bool(data), 1000 + sent if client else 0, data, len(data)])
        sent += len(data) if client else 0
    for i in range(2, count - 4, 7):
        if rng.random() < loss and rows[i][4] and rows[i + 2][4]:
            rows[i][10:], rows[i + 2][10:] = rows[i + 2][10:], rows[i][10:]
    return pd.DataFrame(rows, columns=["pkt_no", "ts_ns", "caplen", "wirelen", *FLAGS, "seq", "payload", "payload_len"])


def chunked(rows):
    keyed = rows.assign(**dict(zip(TUPLE_KEY, KEY)))
    return pack(pa.RecordBatch.from_pandas(keyed, preserve_index=False), True).to_pandas()


def test_a_micro_batch_is_walked_in_chunks(monkeypatch):
    """Chunks out of order and across each other, payloads parked in the store, few packets a step: all the same."""
    rows = talk(3000, HELLO, 29, loss=0.5, syn_every=900)
    whole, parts = Store(), Store()
    want = pd.concat(processor(whole).handleInputRows(KEY, iter([chunked(rows)]), clock()))
    monkeypatch.setattr(meter, "PARK_BYTES", 2000)
    monkeypatch.setattr(meter, "STEP_PACKETS", 100)
    pieces = [chunked(rows[i : i + 200]) for i in range(0, 2000, 200)] + [chunked(rows[2000:][k::2]) for k in (0, 1)]
    random.Random(3).shuffle(pieces)
    got = pd.concat(processor(parts).handleInputRows(KEY, iter([pd.concat(pieces)]), clock()), ignore_index=True)
    pd.testing.assert_frame_equal(got, want.reset_index(drop=True))
    assert parts.variables["flow"].held == whole.variables["flow"].held
    assert parts.variables["parked"].most > 5 and not parts.variables["parked"]
    assert got["legacy_version"].tolist() == [0x0303] * len(got) and len(got) == 3


def test_each_cut_into_micro_batches_gives_the_same(monkeypatch):
    rows = talk(120, HELLO, 11, loss=0.9)
    whole = Store()
    list(processor(whole).handleInputRows(KEY, iter([chunked(rows)]), clock()))
    waited = 0
    for size in (1, 2, 7, 50):
        store = Store()
        for begin in range(0, len(rows), size):
            list(processor(store).handleInputRows(KEY, iter([chunked(rows[begin : begin + size])]), clock()))
            waited = max(waited, len(store.variables["held"]))
        assert store.variables["flow"].held == whole.variables["flow"].held
    assert waited > 0 and whole.variables["flow"].held[len(STATE_FIELDS + SUMS) + 1] == 0x0303


class Bucket(Store):
    """State variables of a bucket, with the number of calls that its list takes."""

    def getListState(self, name, schema):
        return self.variables.setdefault(name, Rows())


class Rows:
    def __init__(self):
        self.held, self.calls = [], 0

    def get(self):
        self.calls += 1
        return iter(list(self.held))

    def put(self, rows):
        self.held, self.calls = list(rows), self.calls + 1


def test_a_bucket_takes_one_read_and_one_write_however_many_conversations(monkeypatch):
    """The flows are those of each conversation alone, with long tails and payloads in the store as well."""
    monkeypatch.setattr(meter, "INLINE_BYTES", 8)
    monkeypatch.setattr(meter, "PARK_BYTES", 500)
    keys = [("c", "a", port, "b", 2, 6) for port in range(40)]
    talks = {key: talk(60, HELLO, 11, loss=0.9, seed=i, syn_every=45) for i, key in enumerate(keys)}
    wide, stores, got, want = Bucket(), {key: Store() for key in keys}, [], []
    for begin in range(0, 60, 10):
        parts = []
        for key, rows in talks.items():
            part = rows[begin : begin + 10]
            parts.append(pack(pa.RecordBatch.from_pandas(part.assign(**dict(zip(TUPLE_KEY, key))), preserve_index=False), True).to_pandas())
            want += list(processor(stores[key]).handleInputRows(key, iter([chunked(part)]), clock()))
        own = meter.BucketProcessor(120_000_000_000, False, None)
        own.init(wide)
        frames = list(own.handleInputRows((3,), iter([pd.concat(parts[::2]), pd.concat(parts[1::2])]), clock()))
        assert len(frames) <= 1
        got += frames
    assert wide.variables["flow"].calls == 2 * 6
    order = ["lo_port", "open_pkt"]
    got, want = (pd.concat(x).sort_values(order, ignore_index=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want)
    states = {row[:6]: row[6:-3] for row in wide.variables["flow"].held}
    assert states == {key: store.variables["flow"].held for key, store in stores.items()} and not wide.variables["parked"]


def test_flows_that_stay_open_are_told_once():
    rows = talk(30, b"", 5)
    store = Store()
    own = processor(store, open_after_ms=120_000)
    assert list(own.handleInputRows(KEY, iter([chunked(rows[:10])]), clock(1000))) == []
    assert list(own.handleInputRows(KEY, iter([chunked(rows[10:])]), clock(5000))) == []
    assert store.timers == [121_000]
    (told,) = own.handleExpiredTimer(KEY, clock(121_000), clock(121_000))
    assert told["packets_total"].tolist() == [30] and told["final"].tolist() == [False]
    assert list(own.handleExpiredTimer(KEY, clock(99), clock(99))) == []


def test_packing_keeps_every_packet_and_byte():
    rows = talk(50, b"hello", 9, loss=0.3)
    two = pd.concat([rows.assign(**dict(zip(TUPLE_KEY, KEY))), rows.assign(**dict(zip(TUPLE_KEY, ("c", "a", 1, "b", 2, 17))))])
    two = two.sample(frac=1, random_state=2)
    packed = pack(pa.RecordBatch.from_pandas(two, preserve_index=False), True).to_pandas().sort_values("proto")
    assert packed[["first_pkt", "last_pkt"]].to_numpy().tolist() == [[0, 49], [0, 49]]
    tcp, udp = packed.to_dict("records")
    segments = np.frombuffer(tcp["segments"], SEGMENT)
    assert tcp["payload"] == b"".join(rows["payload"]) and udp["payload"] == b""
    assert segments["size"].tolist() == [len(p) for p in rows["payload"] if p]


def customers(spark, sf_dir):
    from flowloom.plans.fixtures import interleaved_conversations

    return full(interleaved_conversations(spark, sf_dir).filter("pkt_no % 1000000000 < 40"))


def test_stream_finds_the_hellos_of_the_batch(spark, sf_dir, tmp_path):
    packets, folder = customers(spark, sf_dir), str(tmp_path / "packets")
    for low in (0, 3, 4, 6):
        high = {0: 3, 3: 4, 4: 6, 6: 8}[low]
        part = packets.filter(F.expr("pkt_no div 1000000000").between(low, high - 1))
        part.coalesce(1).write.mode("append").parquet(folder)
    versions = meter_stream(stream_packets(spark, folder, 1), with_tls=True, emit_open=False)
    append_versions(versions, str(tmp_path / "flows"), str(tmp_path / "state")).awaitTermination(180)
    ended = spark.read.schema(versions.schema).parquet(str(tmp_path / "flows/*")).drop("final")
    got = ended.unionByName(open_flows(spark, str(tmp_path / "state"), with_tls=True))
    want = flow_table(packets)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("cut", [100, 450])
def test_stream_goes_on_behind_a_batch(spark, tmp_path, cut):
    rows = random_packets(11, 600, 0.1)
    early, late = frame(spark, rows[:cut]), full(frame(spark, rows[cut:]))
    late.coalesce(1).write.parquet(str(tmp_path / "packets"))
    flows = meter_flows(early)
    state = handover(early, flows)
    versions = meter_stream(stream_packets(spark, str(tmp_path / "packets")), emit_open=False, initial=state)
    append_versions(versions, str(tmp_path / "flows"), str(tmp_path / "state")).awaitTermination(180)
    ended = spark.read.schema(versions.schema).parquet(str(tmp_path / "flows/*")).drop("final")
    open_ = open_flows(spark, str(tmp_path / "state"))
    carried = state.filter("is_open = 1").select("capture_id", "open_pkt")
    got = ended.unionByName(open_).unionByName(flows.join(carried, ["capture_id", "open_pkt"], "left_anti"))
    assert sorted(got.select(*FLOW_COLUMNS).collect()) == sorted(meter_flows(frame(spark, rows)).collect())


def test_handover_broadcasts_no_table_of_conversations(spark, sf_dir):
    """The file behind a table may be small, the table is not: it would be built whole in the driver's memory."""
    early = customers(spark, sf_dir).filter(F.expr("pkt_no div 1000000000") < 4)
    state = handover(early, durable(flow_table(early)))
    assert "BroadcastHashJoin" not in state._jdf.queryExecution().sparkPlan().toString()
    assert state.count() == early.select("src_port").filter("src_port <> 443").distinct().count()
