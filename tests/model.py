"""A packet-at-a-time model of the meter, used only to check the Spark jobs."""

from __future__ import annotations

from dataclasses import dataclass, field

TIMEOUT = 120_000_000_000


@dataclass
class Flow:
    client: tuple
    server: tuple
    proto: int
    instance: int
    open_pkt: int
    first_ts: int
    packets: list = field(default_factory=list)


def label(packets: list[dict], timeout: int = TIMEOUT) -> dict[tuple, tuple]:
    """(capture, pkt_no) -> (client ip, client port, instance, opening packet, c2s)."""
    current: dict[tuple, Flow] = {}
    counts: dict[tuple, int] = {}
    out = {}
    for p in sorted(packets, key=lambda p: (p["capture_id"], p["pkt_no"])):
        if p["proto"] not in (6, 17):
            continue
        src, dst = (p["src_ip"], p["src_port"]), (p["dst_ip"], p["dst_port"])
        talk = (p["capture_id"], p["proto"], frozenset((src, dst)))
        tcp = p["proto"] == 6
        flow = current.get(talk)
        if flow is None or (tcp and p["syn"] and not p["ack"]):
            sides = (src, dst)
        elif p["ts_ns"] - flow.first_ts > timeout:
            sides = (flow.client, flow.server)
        else:
            sides = None
        if sides is not None:
            directed = (p["capture_id"], p["proto"], *sides)
            number = counts.get(directed, 0)
            counts[directed] = number + 1
            flow = Flow(*sides, p["proto"], number, p["pkt_no"], p["ts_ns"])
            current[talk] = flow
        out[(p["capture_id"], p["pkt_no"])] = (
            *flow.client,
            flow.instance,
            flow.open_pkt,
            src == flow.client,
        )
        if tcp and (p["fin"] or p["rst"]):
            del current[talk]
    return out
