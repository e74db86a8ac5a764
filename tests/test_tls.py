"""Hello bytes built from known fields, reassembly cases and the search rule."""

import random
import struct
import time

import pytest
from pyspark.sql import functions as F

from flowloom.functions import hexfmt, tls
from flowloom.functions.reassembly import ClientStream
from flowloom.operators import checks
from flowloom.operators import hello as hello_ops
from flowloom.operators.hello import client_streams, first_hellos, flow_table


def vec(size, data):
    return len(data).to_bytes(size, "big") + data


def body(version=0x0303, ciphers=(0xC02B, 0x1A1A), extensions=None, session=b""):
    out = version.to_bytes(2, "big") + bytes(32) + vec(1, session)
    out += vec(2, b"".join(c.to_bytes(2, "big") for c in ciphers)) + b"\x01\x00"
    if extensions is not None:
        out += vec(2, b"".join(t.to_bytes(2, "big") + vec(2, d) for t, d in extensions))
    return out


def handshake(data):
    return b"\x01" + vec(3, data)


def record(data):
    return b"\x16\x03\x01" + vec(2, data)


SNI = (0, vec(2, b"\x00" + vec(2, b"example.org")))
ALPN = (16, vec(2, vec(1, b"h2") + vec(1, b"http/1.1")))
HELLO = record(handshake(body(extensions=[SNI, ALPN, (0x2A2A, b""), (43, b"\x02\x03\x04")])))


def test_fields():
    got = tls.hello_at_start(HELLO)
    assert got == (0x0303, [0xC02B], [0, 16, 43], True, [b"h2", b"http/1.1"])


def test_no_extensions_is_valid():
    assert tls.hello_at_start(record(handshake(body()))).extensions == []


@pytest.mark.parametrize(
    "broken",
    [
        body()[:33],
        body() + b"\x00",
        body()[:35] + b"\x00\x03abc" + b"\x01\x00",
        body(extensions=[(5, b"abc")])[:-1],
    ],
)
def test_malformed_body(broken):
    assert tls.hello_at_start(record(handshake(broken))) is None


def test_tail_after_extensions_is_ignored():
    assert tls.hello_at_start(record(handshake(body(extensions=[]) + b"rest"))) is not None


def test_two_records_and_short_first_record():
    message = handshake(body(extensions=[SNI]))
    for cut in (2, 3, 40):
        assert tls.hello_at_start(record(message[:cut]) + record(message[cut:])).has_sni
    assert tls.hello_at_start(record(b"") + record(message)).has_sni


def test_junk_before_hello():
    assert tls.hello_at_start(b"EHLO x" + HELLO) is None
    assert tls.hello_in_stream(b"EHLO x" + HELLO).has_sni


def test_partial_extension_lists():
    alpn = (16, vec(2, vec(1, b"h2") + b"\x09abc"))
    assert tls.hello_at_start(record(handshake(body(extensions=[alpn])))).alpn_protocols == [b"h2"]
    empty_name = (0, vec(2, b"\x00" + vec(2, b"")))
    assert tls.hello_at_start(record(handshake(body(extensions=[empty_name])))).has_sni is False


def rescan(stream):
    """The plain search: try each offset of the stream known so far."""
    for at in range(len(stream) - 8):
        if stream[at : at + 2] == b"\x16\x03":
            found = tls.hello_at_start(stream[at:])
            if found is not None:
                return found
    return None


def noisy_stream(rng):
    parts = [HELLO, b"\x16\x03\x01\x00\x40\x01", b"\x16", b"\x16\x03\x01\x00\x00", bytes(rng.randrange(40))]
    parts.append(record(handshake(body(version=rng.randrange(65536)))))
    parts.append(b"\x16\x03\x03" + struct.pack(">H", rng.randrange(300)) + b"\x01\x00\x00")
    return b"".join(rng.choices(parts, k=rng.randrange(1, 7)))


def test_search_equals_rescan_of_every_prefix():
    rng = random.Random(5)
    hits = 0
    for _ in range(3000):
        stream, at, search = noisy_stream(rng), 0, tls.HelloSearch()
        while at < len(stream):
            step = rng.randrange(1, 60)
            got = search.feed(stream[at : at + step])
            at += step
            want = rescan(stream[:at])
            assert got == want
            if got is not None:
                hits += 1
                break
            # A resumed search sees only the part that is still open.
            if rng.random() < 0.3:
                tail, search = search.tail(), tls.HelloSearch()
                assert search.feed(tail) is None
    assert hits > 1000


def reassembled(*segments):
    stream = ClientStream()
    return b"".join(stream.feed(seq, data) for seq, data in segments)


@pytest.mark.parametrize(
    "segments, stream",
    [
        ([(10, b"ab"), (12, b"cd")], b"abcd"),
        ([(10, b"ab"), (14, b"ef"), (12, b"cd")], b"abcdef"),
        ([(10, b"ab"), (10, b"ab"), (12, b"c")], b"abc"),
        ([(10, b"abc"), (11, b"XYZd")], b"abcZd"),
        ([(10, b"a"), (12, b"c"), (12, b"CDE"), (11, b"b")], b"abCDE"),
        ([(10, b"a"), (12, b"cd"), (12, b"CD"), (11, b"b")], b"abcd"),
        ([(12, b"cd"), (10, b"ab"), (14, b"e")], b"cde"),
        ([(10, b"a"), (11, b""), (11, b"b")], b"ab"),
        # Past the wrap the stream goes on at 0, and what was held before it stays held.
        ([(2**32 - 1, b"ab"), (1, b"c")], b"abc"),
        ([(2**32 - 4, b"ab"), (2**32 - 1, b"z"), (2**32 - 2, b"cdef"), (2, b"g")], b"abcdefg"),
    ],
)
def test_reassembly(segments, stream):
    assert reassembled(*segments) == stream


def packets(spark, rows):
    """(pkt_no, from client, flags, seq, payload) rows of one conversation per port."""
    schema = (
        "capture_id string, pkt_no long, ts_ns long, caplen long, wirelen long, src_ip string, "
        "dst_ip string, src_port int, dst_port int, proto int, syn boolean, ack boolean, "
        "fin boolean, rst boolean, psh boolean, seq long, payload binary, payload_len long"
    )
    data = []
    for no, (port, client, flags, seq, payload) in enumerate(rows):
        ends = [("10.0.0.1", port), ("192.0.2.1", 443)]
        (src, sport), (dst, dport) = ends if client else ends[::-1]
        flag = [f in flags for f in "SAFRP"]
        data.append(("0", no, no, 60, 60, src, dst, sport, dport, 6, *flag, seq, payload, len(payload)))
    return spark.createDataFrame(data, schema)


def found(df):
    return {r["open_pkt"]: r["hello"] for r in df.collect()}


def test_hello_of_flows(spark):
    rows = [
        (1, True, "S", 100, b""),
        (2, True, "A", 5, b"GET /"),
        (1, True, "A", 101, HELLO[:20]),
        (3, True, "A", 9, b"\x16"),
        (1, False, "A", 7, HELLO),
        (3, True, "A", 10, HELLO[1:7]),
        (1, True, "A", 141, HELLO[40:]),
        (3, True, "FA", 16, HELLO[7:]),
        (1, True, "A", 121, HELLO[20:40]),
        (4, False, "A", 9, HELLO),
    ]
    df = packets(spark, rows)
    assert set(found(first_hellos(df))) == {0, 3, 9}
    flows = flow_table(df).select("open_pkt", hello_ops.hello_flag()).collect()
    assert {r[0]: r[1] for r in flows} == {0: 1, 1: 0, 3: 1, 9: 1}
    assert flow_table(df, with_tls=False).filter("hello is not null").count() == 0


@pytest.mark.parametrize("hot_rows", [None, 1])
def test_hello_across_batches(spark, monkeypatch, hot_rows):
    """Tiny batches: every packet is a round of its own."""
    monkeypatch.setattr(hello_ops, "FIRST_BATCH_BYTES", 1)
    monkeypatch.setattr(hello_ops, "BATCH_BYTES", 30)
    monkeypatch.setattr(hello_ops, "CHUNK_PACKETS", 1)
    cuts = [(0, 10), (10, 30), (50, len(HELLO)), (30, 50)]
    rows = [(1, True, "A", a, HELLO[a:b]) for a, b in cuts] + [(2, True, "A", 0, b"\x16\x03" * 40)]
    assert {k: v["has_sni"] for k, v in found(first_hellos(packets(spark, rows), hot_rows=hot_rows)).items()} == {0: True}


def test_gap_that_never_closes(spark, monkeypatch):
    """Held bytes are dropped with their flow once nothing can fill the gap."""
    monkeypatch.setattr(hello_ops, "FIRST_BATCH_BYTES", 1)
    monkeypatch.setattr(hello_ops, "BATCH_BYTES", 1)
    monkeypatch.setattr(hello_ops, "CHUNK_PACKETS", 1)
    rows = [(1, True, "A", 0, b"\x16"), (1, True, "A", 5, HELLO), (1, True, "A", 900, b"x")]
    rows += [(2, True, "A", 0, b"ab"), (2, True, "A", 3, HELLO), (2, True, "A", 900, b"x"), (2, True, "A", 1, b"bc")]
    assert set(found(first_hellos(packets(spark, rows)))) == {3}


def test_no_payload_at_all(spark):
    assert first_hellos(packets(spark, [(1, True, "S", 0, b"")])).count() == 0


def test_streams_and_columns(spark):
    rows = [("0", 1, 2, 12, b"cd"), ("0", 1, 1, 10, b"ab"), ("0", 7, 3, 1, HELLO)]
    segments = spark.createDataFrame(rows, "capture_id string, open_pkt long, pkt_no long, seq long, payload binary")
    streams = client_streams(segments)
    got = {r["open_pkt"]: bytes(r["stream"]) for r in streams.collect()}
    assert got == {1: b"abcd", 7: HELLO}
    hello = tls.client_hello(F.col("stream"))
    rows = streams.select("open_pkt", hello.alias("h")).orderBy("open_pkt").collect()
    assert rows[0]["h"] is None and rows[1]["h"]["extensions"] == [0, 16, 43]


def test_may_begin_is_never_wrong(spark):
    rng = random.Random(6)
    data = [noisy_stream(rng) for _ in range(300)]
    data += [HELLO[:n] for n in range(1, 10)]
    df = spark.createDataFrame([(d,) for d in data], "p binary")
    for p, may in df.select("p", tls.may_begin_hello(F.col("p"))).collect():
        if tls.hello_in_stream(bytes(p)) is not None:
            assert may
    heads = spark.createDataFrame([(HELLO[:n],) for n in range(1, 10)], "p binary")
    assert heads.filter(~tls.may_begin_hello(F.col("p"))).count() == 0
    other = spark.createDataFrame([(b"\x16\x03\x01\x00\x05\x02 server",), (b"GET / HTTP/1.1\r\n",)], "p binary")
    assert other.filter(tls.may_begin_hello(F.col("p"))).count() == 0


def test_hex_forms(spark):
    row = spark.sql("select array(10, 49195) a, cast(array() as array<int>) e, 0.0625D d").select(
        hexfmt.hex_list(F.col("a")), hexfmt.hex_list(F.col("e")), hexfmt.fixed3(F.col("d")),
        hexfmt.without_grease(F.array(F.lit(0x0A0A), F.lit(0x0A1A), F.lit(0x1301))),
    ).first()
    assert tuple(row) == ("000a;c02b", "-", 0.062, [0x0A1A, 0x1301])


def test_hello_in_a_hot_conversation(spark):
    rows = [(1, True, "S", 0, b""), (1, True, "A", 1, HELLO[:9]), (2, True, "A", 1, b"x")]
    rows += [(1, False, "A", 0, b"y")] * 20 + [(1, True, "A", 10, HELLO[9:])]
    flows = flow_table(packets(spark, rows), hot_rows=10).collect()
    assert {r["open_pkt"]: (r["packets_total"], r["hello"] is not None) for r in flows} == {0: (23, True), 2: (1, False)}


def test_many_hot_conversations_are_salted(spark, monkeypatch):
    from flowloom.operators import sessionize
    from tests import model
    from tests.test_sessionize import frame, labels, random_packets

    monkeypatch.setattr(sessionize, "BROADCAST_TUPLES", 0)
    rows = random_packets(8, 300, 0.1)
    assert labels(sessionize.label_packets(frame(spark, rows), hot_rows=60)) == model.label(rows)


def test_search_takes_linear_time():
    began = time.process_time()
    assert tls.hello_in_stream(b"\x16\x03\x01\x00\x00" * 200_000) is None
    search = tls.HelloSearch()
    for _ in range(20_000):
        assert search.feed(b"\x16\x03\x01\xff\xff\x01" + bytes(20)) is None
    # Generous: the former took minutes at a tenth of the size.
    assert time.process_time() - began < 20


def test_empty_records_count_from_the_first():
    rng = random.Random(8)
    parts = [b"\x16\x03\x01\x00\x00", HELLO, record(handshake(body(version=0x0301)))[:-1], b"\x16\x03\x01\x00\x00\x16"]
    for _ in range(2000):
        stream, at, search = b"".join(rng.choices(parts, k=rng.randrange(2, 9))), 0, tls.HelloSearch()
        while at < len(stream):
            step = rng.randrange(1, 50)
            got = search.feed(stream[at : at + step])
            at += step
            assert got == rescan(stream[:at])
            if got is not None:
                break


def walked(payload):
    """The rule of ``begins_hello``, record by record."""
    at = 0
    while at + 6 <= len(payload):
        if payload[at : at + 2] == b"\x16\x03" and payload[at + 5] == 1:
            return payload[:2] == b"\x16\x03"
        at += 5 + int.from_bytes(payload[at + 3 : at + 5], "big")
    return False


def test_hello_records_of_payloads(spark):
    rng = random.Random(12)
    payloads = [HELLO, HELLO[:5], HELLO[:6], b"", None, b"x" + HELLO, record(b"\x02ab") + HELLO, record(b"") + HELLO, b"\x17\x03\x03\x00\x01a" + HELLO]
    for _ in range(300):
        parts = [record(bytes([rng.choice([0, 1, 1, 2])]) * rng.randrange(4)), record(b""), rng.randbytes(rng.randrange(9)), HELLO]
        data = b"".join(rng.choices(parts, k=rng.randrange(1, 6)))
        payloads.append(data[: rng.randrange(len(data) + 1)])
    df = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "i int, payload binary")
    got = {r.i: r.found for r in df.select("i", checks.begins_hello(F.col("payload")).alias("found")).collect()}
    assert [got[i] for i in range(len(payloads))] == [walked(p or b"") for p in payloads]
    assert 20 < sum(got.values()) < 300


def test_only_payloads_of_asked_conversations_are_joined(spark, sf_dir):
    from flowloom.plans.fixtures import customer_conversations

    packets = customer_conversations(spark, sf_dir)
    own = packets.filter("pkt_no < 160 and payload_len > 0")
    index = hello_ops.payload_index(own, hello_ops.ACTIVE_TIMEOUT_NS, None)
    some = hello_ops.eligible_payloads(packets, index, 10)
    wanted = {r.pkt_no for r in packets.filter("payload_len > 0 and pkt_no < 160").collect()}
    found = {r.pkt_no for r in some.collect()}
    assert wanted <= found and len(found) < len(wanted) + 20
