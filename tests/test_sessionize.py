"""Flow labels against hand cases, the published totals and a packet-at-a-time model."""

import random

import pytest
from pyspark.sql import functions as F

from flowloom.operators import sessionize
from flowloom.operators.meter import meter_flows
from flowloom.operators.sessionize import label_packets
from flowloom.plans.fixtures import event_packets
from tests import model

SEC = 1_000_000_000
META = (
    "capture_id string, pkt_no long, ts_ns long, caplen long, wirelen long, src_ip string, "
    "dst_ip string, src_port int, dst_port int, proto int, syn boolean, ack boolean, "
    "fin boolean, rst boolean, psh boolean"
)
FIELDS = [f.split()[0] for f in META.split(", ")]
C, S = ("10.0.0.1", 40000), ("192.0.2.1", 443)


def packet(no, ts, flags="A", src=C, dst=S, proto=6, capture="0", size=60):
    return dict(
        capture_id=capture, pkt_no=no, ts_ns=ts, caplen=size, wirelen=size + 4,
        src_ip=src[0], dst_ip=dst[0], src_port=src[1], dst_port=dst[1], proto=proto,
        syn="S" in flags, ack="A" in flags, fin="F" in flags, rst="R" in flags, psh="P" in flags,
    )


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[f] for f in FIELDS) for r in rows], META)


def labels(df):
    picked = df.select("capture_id", "pkt_no", "client_ip", "client_port", "flow_instance", "open_pkt", "c2s")
    return {(r[0], r[1]): tuple(r[2:]) for r in picked.collect()}


def flow_rows(spark, rows):
    flows = meter_flows(frame(spark, rows)).orderBy("capture_id", "open_pkt").collect()
    return [r.asDict() for r in flows]


def random_packets(seed, count, jitter, captures=2):
    """Few hosts, so that tuples are long; some timestamps run backwards."""
    rng = random.Random(seed)
    hosts = [("10.0.0.1", 1), ("10.0.0.1", 2), ("10.0.0.2", 1)]
    now, rows = 0, []
    for no in range(count):
        now += rng.choice([1, 5, 20, 40, 119, 121]) * SEC // rng.choice([1, 1, 3, 10])
        src, dst = rng.choice(hosts[:2]), hosts[2]
        if rng.random() < 0.4:
            src, dst = dst, src
        if rng.random() < 0.03:
            dst = src
        flags = rng.choices(["A", "S", "SA", "FA", "RA", "PA", "SF"], [60, 4, 3, 2, 1, 10, 1])[0]
        ts = max(0, now - rng.randrange(200) * SEC) if rng.random() < jitter else now
        rows.append(
            packet(no * 3, ts, flags, src, dst, rng.choice([6, 6, 17, 1]), str(rng.randrange(captures)))
        )
    return rows


def test_close_starts_new_flows(spark):
    rows = [
        packet(0, 0, "S"), packet(1, 1, "SA", S, C), packet(2, 2), packet(3, 3, "FA"),
        packet(4, 4, "FA", S, C), packet(5, 5),
    ]
    got = flow_rows(spark, rows)
    assert [(f["client_port"], f["flow_instance"], f["packets_total"], f["tcp_fin_total"]) for f in got] == [
        (40000, 0, 4, 1), (443, 0, 1, 1), (40000, 1, 1, 0),
    ]
    assert got[0]["tcp_syn_c2s"] == 1 and got[0]["tcp_synack_s2c"] == 1


def test_repeated_and_reversed_syn(spark):
    got = flow_rows(spark, [packet(0, 0, "S"), packet(1, 1, "S"), packet(2, 2, "S", S, C), packet(3, 3)])
    assert [(f["client_port"], f["flow_instance"], f["packets_total"]) for f in got] == [
        (40000, 0, 1), (40000, 1, 1), (443, 0, 2),
    ]


@pytest.mark.parametrize("extra, flows", [(0, 1), (1, 2)])
def test_timeout_is_strict(spark, extra, flows):
    assert len(flow_rows(spark, [packet(0, 5), packet(1, 5 + 120 * SEC + extra)])) == flows


def test_timeout_keeps_client(spark):
    got = flow_rows(spark, [packet(0, 0, "S"), packet(1, 200 * SEC, "A", S, C)])
    assert [(f["client_port"], f["flow_instance"], f["packets_s2c"]) for f in got] == [
        (40000, 0, 0), (40000, 1, 1),
    ]


def test_time_running_backwards(spark):
    (flow,) = flow_rows(spark, [packet(0, 50), packet(1, 20)])
    assert (flow["first_ts_ns"], flow["last_ts_ns"], flow["duration_ns"]) == (50, 20, 0)


def test_first_sender_is_client(spark):
    (flow,) = flow_rows(spark, [packet(0, 0, "SA", S, C), packet(1, 1)])
    assert flow["client_port"] == 443 and flow["tcp_synack_s2c"] == 0 and flow["packets_s2c"] == 1


def test_syn_fin_in_one_packet(spark):
    assert [f["packets_total"] for f in flow_rows(spark, [packet(0, 0, "SF"), packet(1, 1)])] == [1, 1]


def test_udp_ignores_flags(spark):
    (flow,) = flow_rows(spark, [packet(0, 0, "SF", proto=17), packet(1, 1, "R", proto=17)])
    assert flow["packets_total"] == 2
    assert all(flow[c] == 0 for c in flow if c.startswith("tcp_"))


def test_captures_are_independent(spark):
    got = flow_rows(spark, [packet(0, 0), packet(0, 0, capture="1")])
    assert [f["flow_instance"] for f in got] == [0, 0]


def test_same_endpoint_on_both_sides(spark):
    (flow,) = flow_rows(spark, [packet(0, 0, src=C, dst=C), packet(1, 1, src=C, dst=C)])
    assert flow["packets_c2s"] == 2


@pytest.mark.parametrize("jitter", [0.0, 0.2])
def test_labels_match_model(spark, jitter):
    rows = random_packets(1, 1500, jitter)
    assert labels(label_packets(frame(spark, rows))) == model.label(rows)


@pytest.mark.parametrize("jitter, limit", [(0.0, 60), (0.2, 60)])
def test_hot_conversations_match_model(spark, jitter, limit):
    """With a tiny task limit all conversations take the chunked way."""
    rows = random_packets(2, 500, jitter)
    assert labels(label_packets(frame(spark, rows), hot_rows=limit)) == model.label(rows)


def test_hot_conversation_in_many_rounds(spark):
    """One endless segment: only timeouts cut it, and the slices are thin."""
    rng = random.Random(3)
    now, rows = 0, []
    for no in range(300):
        now += rng.randrange(1, 9) * SEC
        rows.append(packet(no, now, "A"))
    assert labels(label_packets(frame(spark, rows), hot_rows=90)) == model.label(rows)


def test_hot_meter_equals_plain_meter(spark):
    packets = frame(spark, random_packets(4, 300, 0.1))
    plain, chunked = meter_flows(packets), meter_flows(packets, hot_rows=30)
    assert sorted(plain.collect()) == sorted(chunked.collect())


def test_event_totals(spark, sf_dir):
    flows = meter_flows(event_packets(spark, sf_dir))
    sums = flows.agg(
        F.count("*"), F.sum("packets_c2s"), F.sum("bytes_wire_total"), F.sum("bytes_cap_total"),
        F.sum("duration_ns"), F.sum("tcp_syn_total"), F.sum("tcp_syn_c2s"), F.sum("tcp_synack_s2c"),
        F.max("flow_instance"), F.sum("flow_instance"), F.sum("open_pkt"),
    ).first()
    assert tuple(sums) == (290, 654, 259080, 108480, 19504833792277, 153, 61, 36, 19, 1805, 145586)


def test_order_is_required(spark):
    with pytest.raises(ValueError, match="pkt_no"):
        label_packets(frame(spark, [packet(0, 0)]).drop("pkt_no"))


def test_short_conversations_are_walked_once(spark):
    """Only a conversation that lasts longer than the timeout can have a tail, which takes a second pass."""
    limit = 120 * SEC
    rows = [packet(no, no * limit // 20, "AF" if no % 7 == 0 else "A") for no in range(21)]
    found = sessionize.find_hot(frame(spark, rows), limit, 1000)
    assert found is not None and not found.tails and found.labels is None
    assert labels(label_packets(frame(spark, rows))) == model.label(rows)
    plan = label_packets(frame(spark, rows))._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan
    # A nanosecond more, in a segment without a hard cut, and there is one.
    rows = [packet(no, no * (limit // 20) + (no == 20), "A") for no in range(21)]
    assert sessionize.find_hot(frame(spark, rows), limit, 1000) is None
    assert labels(label_packets(frame(spark, rows))) == model.label(rows)


def test_short_hot_conversations_match_model(spark):
    rows = [packet(no, no * SEC, "AF" if no % 7 == 0 else "A") for no in range(60)]
    assert not sessionize.find_hot(frame(spark, rows), 120 * SEC, 30).tails
    assert labels(label_packets(frame(spark, rows), hot_rows=30)) == model.label(rows)


@pytest.mark.parametrize("most", [5, 1000])
def test_long_list_of_hot_conversations(spark, monkeypatch, most):
    """A list too long to broadcast is joined by key, or by key and salt if a conversation has more rows than a task should hold."""
    monkeypatch.setattr(sessionize, "BROADCAST_TUPLES", 0)
    monkeypatch.setattr(sessionize, "HOT_ROWS", most)
    rows = random_packets(8, 300, 0.1)
    found = sessionize.find_hot(frame(spark, rows), 120 * SEC, 10)
    assert found.labels is not None and (found.salts > 1) == (most == 5)
    assert labels(label_packets(frame(spark, rows), hot_rows=10)) == model.label(rows)
