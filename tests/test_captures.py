"""Capture files of both formats, written by hand, read whole and in small ranges."""

import random
import socket
import struct
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowloom.functions import frames as fr
from flowloom.operators.decode import decode_frames
from flowloom.operators.hello import flow_table
from flowloom.functions import capture_format as cf
from flowloom.sources import capture_source
from flowloom.sources.captures import capture_errors, capture_ranges, read_captures


def classic(packets, order="<", nano=False, linktype=1):
    magic = 0xA1B23C4D if nano else 0xA1B2C3D4
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, linktype)
    for ts, data, length in packets:
        fraction = ts % 10**9 if nano else ts % 10**9 // 1000
        out += struct.pack(order + "IIII", ts // 10**9, fraction, len(data), length) + data
    return out


def block(order, kind, body):
    body += b"\0" * (-len(body) % 4)
    size = struct.pack(order + "I", len(body) + 12)
    return struct.pack(order + "I", kind) + size + body + size


def section(order="<"):
    return block(order, 0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1))


def interface(order="<", linktype=1, resolution=None):
    options = b"" if resolution is None else struct.pack(order + "HHB3x", 9, 1, resolution) + b"\0\0\0\0"
    return block(order, 1, struct.pack(order + "HHI", linktype, 0, 0) + options)


def enhanced(ts, data, length, order="<", number=0):
    head = struct.pack(order + "IIIII", number, ts >> 32, ts & 0xFFFFFFFF, len(data), length)
    return block(order, 6, head + data)


def rows_of(frames):
    cols = ["pkt_no", "ts_ns", "caplen", "frame_len", "linktype", "frame"]
    return sorted((*r[:5], bytes(r[5])) for r in frames.select(*cols).collect())


def some_packets(count, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(count):
        data = rng.randbytes(rng.randrange(20, 200))
        if rng.random() < 0.1:
            # A packet that carries a capture file.
            data = classic([(5 * 10**9, b"inner", 5)] * 8) + section() + interface() + enhanced(1, b"x" * 9, 9)
        out.append((1_600_000_000 * 10**9 + i * 1000, data, len(data) + rng.randrange(3)))
    return out


def expected(packets, linktype=1):
    return [(i, ts, len(d), n, linktype, d) for i, (ts, d, n) in enumerate(packets)]


@pytest.mark.parametrize("order, nano", [("<", False), (">", False), ("<", True), (">", True)])
def test_classic(spark, tmp_path, order, nano):
    packets = some_packets(20)
    (tmp_path / "a.pcap").write_bytes(classic(packets, order, nano))
    assert rows_of(read_captures(spark, str(tmp_path))) == expected(packets)


def test_classic_in_small_ranges(spark, tmp_path):
    packets = some_packets(120)
    (tmp_path / "a.pcap").write_bytes(classic(packets))
    assert rows_of(read_captures(spark, str(tmp_path), range_bytes=700)) == expected(packets)


def test_sections_in_small_ranges(spark, tmp_path):
    """A second section in the other byte order, with an interface that counts in 2**-10 s."""
    packets = some_packets(60)
    data = section() + interface(resolution=9) + b"".join(enhanced(t, d, n) for t, d, n in packets[:30])
    data += section(">") + interface(">", 101) + interface(">", 1, 0x8A)
    data += b"".join(enhanced(512, d, n, ">", 1) for _, d, n in packets[30:])
    data += block(">", 3, struct.pack(">I", 3) + b"abc")
    (tmp_path / "b.pcapng").write_bytes(data)
    want = expected(packets[:30]) + [(i + 30, 500_000_000, len(d), n, 1, d) for i, (_, d, n) in enumerate(packets[30:])]
    want.append((60, 0, 3, 3, 101, b"abc"))
    assert rows_of(read_captures(spark, str(tmp_path), range_bytes=600)) == want


def test_broken_files(spark, tmp_path):
    packets = some_packets(30)
    (tmp_path / "cut.pcap").write_bytes(classic(packets)[:-7])
    (tmp_path / "junk.pcap").write_bytes(b"no capture at all, but long enough")
    (tmp_path / "empty.pcap").write_bytes(b"")
    located = capture_ranges(spark, str(tmp_path), range_bytes=500)
    told = {r["path"].rsplit("/", 1)[1]: r["offset"] for r in capture_errors(located).collect()}
    assert told == {"junk.pcap": 0, "cut.pcap": len(classic(packets[:-1]))}
    assert rows_of(read_captures(spark, str(tmp_path), range_bytes=500)) == expected(packets[:-1])


def ethernet(kind, body, tags=b""):
    return bytes(12) + tags + kind.to_bytes(2, "big") + body


def ipv4(proto, body, fragment=0, pad=b""):
    head = struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(body), 0, fragment, 64, proto, 0)
    return head + socket.inet_aton("10.0.0.1") + socket.inet_aton("192.0.2.1") + body + pad


def ipv6(header, body):
    ends = socket.inet_pton(socket.AF_INET6, "2001:db8::1") + socket.inet_pton(socket.AF_INET6, "::ffff:1.2.3.4")
    return struct.pack(">IHBB", 6 << 28, len(body), header, 64) + ends + body


def tcp(flags=0x18, data=b"", seq=7, options=b""):
    size = (20 + len(options)) // 4
    return struct.pack(">HHIIBBHHH", 1000, 443, seq, 0, size << 4, flags, 1, 0, 0) + options + data


UDP = struct.pack(">HHHH", 53, 5353, 11, 0) + b"abc"


def decoded(spark, frames):
    rows = [("c", i, i, len(f), length, link, f) for i, (link, f, length) in enumerate(frames)]
    df = spark.createDataFrame(rows, "capture_id string, pkt_no long, ts_ns long, caplen long, frame_len long, linktype int, frame binary")
    return {r["pkt_no"]: r for r in decode_frames(df).collect()}


def test_decode(spark):
    got = decoded(
        spark,
        [
            (1, ethernet(0x0800, ipv4(6, tcp(0x02, options=b"\1" * 8), pad=b"\0" * 6)), 90),
            (1, ethernet(0x0800, ipv4(17, UDP)), 0),
            (1, ethernet(0x86DD, ipv6(6, tcp(0x15, b"hello"))), 1),
            (1, ethernet(0x0800, ipv4(6, tcp(data=b"x", seq=2**32 - 1)), b"\x88\xa8\0\1\x81\0\0\2"), 1),
            (1, ethernet(0x0806, bytes(28)), 1),
            (1, ethernet(0x0800, ipv4(1, bytes(8))), 1),
            (1, ethernet(0x86DD, ipv6(0, bytes(8) + tcp())), 1),
            (1, ethernet(0x0800, ipv4(6, b"short")), 1),
            (1, ethernet(0x0800, ipv4(17, UDP, fragment=5)), 1),
            (1, ethernet(0x0800, ipv4(17, UDP, fragment=0x2000)), 1),
            (101, ipv4(17, UDP), 1),
            (101, ipv6(17, UDP), 1),
            (113, bytes(14) + b"\x08\x00" + ipv4(17, UDP), 1),
            (0, b"\2\0\0\0" + ipv4(17, UDP), 1),
            (147, ipv4(17, UDP), 1),
            (1, b"", 1),
        ],
    )
    assert set(got) == {0, 1, 2, 3, 9, 10, 11, 12, 13}
    first = got[0]
    assert (first["src_ip"], first["dst_ip"], first["src_port"], first["dst_port"]) == ("10.0.0.1", "192.0.2.1", 1000, 443)
    assert first["syn"] and not first["ack"] and first["payload_len"] == 0 and first["wirelen"] == 90
    assert got[1]["wirelen"] == got[1]["caplen"] and bytes(got[1]["payload"]) == b"abc" and got[1]["seq"] is None
    assert (got[2]["src_ip"], got[2]["dst_ip"]) == ("2001:db8::1", "::ffff:1.2.3.4")
    assert got[2]["fin"] and got[2]["rst"] and got[2]["ack"] and bytes(got[2]["payload"]) == b"hello"
    assert got[3]["seq"] == 2**32 - 1 and got[3]["psh"]


def test_decode_behind_other_headers(spark):
    labels = b"\x00\x06\x40\x40\x00\x03\xe1\x3f"
    session = b"\x11\x00\x00\x01\x00\x20"
    four, six = ipv4(17, UDP), ipv6(17, UDP)
    got = decoded(
        spark,
        [
            (1, ethernet(0x8864, session + b"\x00\x21" + four), 1),
            (1, ethernet(0x8864, session + b"\x00\x57" + six, b"\x81\0\0\2"), 1),
            (1, ethernet(0x8847, labels + four), 1),
            (1, ethernet(0x8848, labels[4:] + six), 1),
            (1, ethernet(0x86DD, ipv6(4, four)), 1),
            (1, ethernet(0x8864, session + b"\xc0\x21" + four), 1),
            (1, ethernet(0x8847, labels[:4]), 1),
            (1, ethernet(0x86DD, ipv6(4, six)), 1),
        ],
    )
    assert set(got) == {0, 1, 2, 3, 4}
    assert [got[i]["src_ip"] for i in range(5)] == ["10.0.0.1", "2001:db8::1", "10.0.0.1", "2001:db8::1", "10.0.0.1"]
    assert all(bytes(r["payload"]) == b"abc" and r["src_port"] == 53 for r in got.values())


def test_ipv6_text(spark):
    rng = random.Random(2)
    parts = [b"\0\0", b"\0\0", b"\0\1", b"\xff\xff", b"\x0a\x00", b"\x00\xb0"]
    names = [b"".join(rng.choices(parts, k=8)) for _ in range(800)]
    names += [bytes(16), bytes(15) + b"\1", bytes(12) + b"\1\2\3\4", bytes(10) + b"\xff\xff\1\2\3\4"]
    df = spark.createDataFrame([(n,) for n in names], "a binary")
    for name, text in df.select("a", fr.ipv6_text(F.col("a"))).collect():
        assert text == socket.inet_ntop(socket.AF_INET6, bytes(name))


def test_capture_to_flows(spark, tmp_path):
    from tests.test_tls import HELLO

    client = [
        (10**18, ethernet(0x0800, ipv4(6, tcp(0x02))), 60),
        (10**18 + 1000, ethernet(0x0800, ipv4(6, tcp(0x18, HELLO[:50], seq=8))), 60),
        (10**18 + 2000, ethernet(0x0800, ipv4(6, tcp(0x11, HELLO[50:], seq=58))), 60),
    ]
    (tmp_path / "a.pcap").write_bytes(classic(client))
    (flow,) = flow_table(decode_frames(read_captures(spark, str(tmp_path)))).collect()
    assert flow["packets_total"] == 3 and flow["tcp_fin_total"] == 1 and flow["hello"]["has_sni"]


def opened(data):
    file = cf.Bytes(pa.BufferReader(data), len(data))
    return cf.open_format(file), file


def tried(form, file, start, stop):
    """The rule of a guess, place by place."""
    for at in range(start + -start % form.step, stop, form.step):
        try:
            here = at
            for _ in range(cf.CHAIN):
                if here == file.length:
                    break
                here = form.plausible(file, here)
        except cf.Broken:
            continue
        return at
    return stop


def test_guesses_are_those_of_a_search_by_place(monkeypatch):
    packets = some_packets(150, seed=4)
    sections = section() + interface() + b"".join(enhanced(t, d, n) for t, d, n in packets[:70])
    sections += section(">") + interface(">") + b"".join(enhanced(t, d, n, ">") for t, d, n in packets[70:])
    for window in (64, 4096, 1 << 20):
        monkeypatch.setattr(cf, "WINDOW", window)
        monkeypatch.setattr(cf, "LOOK_AHEAD", 16 + window // 4 * 4)
        for data in (classic(packets), classic(packets, ">", True), sections):
            form, file = opened(data)
            for start in range(24, len(data), 397):
                first = form.order
                want = tried(form, file, start, min(start + 900, len(data)))
                form.order = first
                assert cf.guess(form, file, start, min(start + 900, len(data))) == want
                form.order = first


def test_a_huge_record_is_searched_in_seconds():
    body = random.Random(1).randbytes(1 << 20) * 100
    small = [(10**18 + i, b"x" * 60, 60) for i in range(20)]
    data = classic([(10**18, body, len(body)), *small])
    form, file = opened(data)
    began = time.perf_counter()
    assert cf.guess(form, file, 1000, len(data)) == 24 + 16 + len(body)
    assert time.perf_counter() - began < 10


def many_sections(packets):
    """A new section with two interfaces every ten packets."""
    data = b""
    for i in range(0, len(packets), 10):
        data += section() + interface(linktype=1, resolution=9) + interface(linktype=101 + i // 10, resolution=9)
        data += b"".join(enhanced(t, d, n, number=j % 2) for j, (t, d, n) in enumerate(packets[i : i + 10]))
    return data


@pytest.mark.parametrize("range_bytes", [300, 100_000])
def test_source_reads_what_the_job_reads(spark, tmp_path, range_bytes):
    packets = some_packets(90, seed=6)
    (tmp_path / "a.pcap").write_bytes(classic(packets))
    (tmp_path / "b.pcapng").write_bytes(many_sections(packets))
    (tmp_path / "c.pcap").write_bytes(b"no capture at all, but long enough")
    want = sorted(expected(packets) + [(i, t, len(d), n, 1 if i % 2 == 0 else 101 + i // 10, d) for i, (t, d, n) in enumerate(packets)])
    assert rows_of(read_captures(spark, str(tmp_path), range_bytes=range_bytes)) == want
    assert rows_of(capture_source.capture_frames(spark, str(tmp_path), range_bytes=range_bytes)) == want
    assert rows_of(spark.read.format("capture").load(str(tmp_path))) == want


def test_holes_are_told_and_passed(spark, tmp_path):
    packets = some_packets(40, seed=7)
    blocks = [enhanced(t, d, n, number=7 if i == 25 else 0) for i, (t, d, n) in enumerate(packets)]
    head = section() + interface(resolution=9)
    (tmp_path / "a.pcapng").write_bytes(head + b"".join(blocks)[:-10])
    (tmp_path / "b.pcap").write_bytes(b"no capture at all, but long enough")
    want = [r for r in expected(packets[:-1]) if r[0] != 25]
    for frames in (read_captures(spark, str(tmp_path), range_bytes=400), capture_source.capture_frames(spark, str(tmp_path), range_bytes=400)):
        assert rows_of(frames) == want
    told = {(r.path.rsplit("/", 1)[1], r.offset, r.error.split(":")[0]) for r in capture_source.capture_problems(spark, str(tmp_path)).collect()}
    hole, cut = (len(head + b"".join(blocks[:i])) for i in (25, 39))
    assert told == {("a.pcapng", hole, "unreadable block"), ("a.pcapng", cut, "breaks off"), ("b.pcap", 0, "unreadable")}


def test_conditions_reach_the_source(spark, tmp_path):
    packets = some_packets(30, seed=8)
    for name in "ab":
        (tmp_path / f"{name}.pcap").write_bytes(classic(packets, nano=True))
    capture_source.register(spark)
    frames = spark.read.format("capture").load(str(tmp_path))
    ts = packets[12][0]
    own = frames.filter((F.col("capture_id") == f"file:{tmp_path}/b.pcap") & (F.col("ts_ns") >= ts) & (F.col("ts_ns") < ts + 5000))
    assert rows_of(own) == expected(packets)[12:17] and own.rdd.getNumPartitions() == 1
    reader = capture_source.CaptureReader({"path": str(tmp_path)})
    kinds = [capture_source.GreaterThan(("ts_ns",), 5), capture_source.LessThanOrEqual(("ts_ns",), 9), capture_source.GreaterThan(("pkt_no",), 1)]
    assert list(reader.pushFilters(kinds)) == kinds[2:] and (reader.span.low, reader.span.high) == (6, 9)
    assert rows_of(frames.filter("ts_ns > 5 and ts_ns < 3")) == []


def test_growing_files_are_followed(spark, tmp_path):
    """Files grow inside a record, a new one comes, sections change; a restart goes on from its offset."""
    packets, folder = some_packets(60, seed=9), tmp_path / "in"
    folder.mkdir()
    whole = {"a.pcap": classic(packets), "b.pcapng": many_sections(packets)}
    cuts = {"a.pcap": [700, 701, 3000, len(whole["a.pcap"])], "b.pcapng": [0, 900, 4001, len(whole["b.pcapng"])]}

    def run():
        query = (
            capture_source.stream_captures(spark, str(folder), max_bytes=2000)
            .writeStream.format("parquet")
            .option("path", str(tmp_path / "out"))
            .option("checkpointLocation", str(tmp_path / "state"))
            .start()
        )
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    for turn in range(4):
        for name, data in whole.items():
            if cuts[name][turn]:
                (folder / name).write_bytes(data[: cuts[name][turn]])
        run()
    found = spark.read.parquet(str(tmp_path / "out"))
    want = sorted(expected(packets) + [(i, t, len(d), n, 1 if i % 2 == 0 else 101 + i // 10, d) for i, (t, d, n) in enumerate(packets)])
    assert rows_of(found) == want


def test_blobs_are_files(spark, tmp_path):
    capture_source.register(spark)
    rows = [(f"f{i}", bytes([i]) * i) for i in range(5)]
    spark.createDataFrame(rows, "name string, content binary").write.format("blobs").mode("append").save(str(tmp_path / "x"))
    assert {p.name: p.read_bytes() for p in (tmp_path / "x").iterdir()} == dict(rows)


def test_small_ranges_share_tasks():
    """Each range is read once, by few tasks; large ones have a task each."""
    from flowloom.sources.capture_source import Range, _dealt

    small = [Range(f"f{i // 15}", 61_440, 4096 * (i % 15), 4096 * (i % 15 + 1)) for i in range(60_000)]
    dealt = _dealt(small)
    assert [r for part in dealt for r in part.listed] == small
    assert len(dealt) < 600
    large = [Range(f"g{i}", 128 << 20, None, 128 << 20) for i in range(5)]
    assert [len(part.listed) for part in _dealt(large)] == [1] * 5
    assert _dealt([]) == []
