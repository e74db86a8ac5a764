"""One conversation, stepped through its packets in order: open flow, counters and hello search.

The steps take numpy records of bounded size, so it does not matter how many packets a
micro-batch has. ``Conversation`` is the state of the stateful meter in memory.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from flowloom.functions import tls
from flowloom.functions.reassembly import ClientStream
from flowloom.schema import COUNTERS, HELLO_TYPE, TCP, TCP_COUNTS
from flowloom.streaming.chunks import FLAGS

SUMS = COUNTERS + TCP_COUNTS
STATE_FIELDS = ["lo_flows", "hi_flows", "is_open", "client_is_lo", "open_pkt", "first_ts_ns", "last_ts_ns", "last_pkt"]
HELLO_FIELDS = HELLO_TYPE.fieldNames()
# Bytes of a stream without a hello that are kept before it is cut.
KEPT_BYTES = 1 << 20


def flow_starts(ts: np.ndarray, hard: np.ndarray, first_ts: int | None, timeout_ns: int) -> np.ndarray:
    """Positions at which a flow begins; ``first_ts`` is that of the flow open before."""
    bounds = np.flatnonzero(hard)
    edges = [(None, 0, bounds[0] if len(bounds) else len(ts))] if first_ts is not None else []
    edges += [(a, a, b) for a, b in zip(bounds, [*bounds[1:], len(ts)])]
    starts: list[int] = []
    for opening, begin, end in edges:
        # Only running maxima can exceed the timeout first.
        peaks = np.maximum.accumulate(ts[begin:end])
        if opening is not None:
            starts.append(opening)
            first_ts = int(ts[opening])
        while (at := int(np.searchsorted(peaks, first_ts + timeout_ns, side="right"))) < len(peaks):
            starts.append(begin + at)
            first_ts = int(peaks[at])
    return np.array(starts, dtype=np.int64)


@dataclass
class Search:
    """Client stream of a flow and the hello in it, if there is one so far."""

    client: ClientStream = field(default_factory=ClientStream)
    seeker: tls.HelloSearch = field(default_factory=tls.HelloSearch)
    hello: dict | None = None
    room: int = KEPT_BYTES

    @classmethod
    def resumed(cls, next_seq: int | None, tail: bytes, held: dict[int, bytes]) -> Search:
        search = cls(ClientStream(next_seq, held))
        search.seeker.feed(tail)
        return search

    def add(self, seq: int, payload: bytes) -> None:
        fresh = self.client.feed(seq, payload)
        found = self.seeker.feed(fresh) if fresh else None
        if found is not None:
            self.hello = found._asdict()
        elif len(self.seeker.stream) > self.room:
            # Only what later bytes can complete is kept; where that is much, it is cut again at twice its size.
            tail, self.seeker = self.seeker.tail(), tls.HelloSearch()
            self.seeker.feed(tail)
            self.room = max(KEPT_BYTES, 2 * len(tail))

    def begun(self) -> bool:
        return self.hello is None and self.client.next_seq is not None


class Conversation:
    def __init__(self, tcp: bool, timeout_ns: int, was: dict | None = None, search: Search | None = None) -> None:
        self.tcp, self.timeout_ns = tcp, timeout_ns
        self.was = was or dict.fromkeys(STATE_FIELDS + SUMS, 0)
        self.fresh = was is None
        self.search = search or Search()

    def _measures(self, flags: dict[str, np.ndarray], packets: np.ndarray, client_is_lo: np.ndarray) -> np.ndarray:
        """One column per entry of SUMS, one row per packet."""
        c2s = flags["src_is_lo"] == client_is_lo
        syn, ack, fin, rst, psh = (flags[f] for f in FLAGS[1:])
        columns = []
        for size in (np.ones(len(packets), np.int64), packets["caplen"], packets["wirelen"]):
            columns += [size, size * c2s, size * ~c2s]
        columns += [syn, c2s & syn & ~ack, ~c2s & syn & ack, ack, fin, rst, psh]
        return np.column_stack(columns).astype(np.int64)

    def step(self, packets: np.ndarray, segments: np.ndarray, payload: bytes) -> list[dict]:
        """Count packets (in order) and give the flows that ended with them.

        ``segments`` are the records of the payloads that lie one after the other in ``payload``.
        """
        was, numbers, ts = self.was, packets["pkt_no"], packets["ts_ns"]
        if not self.fresh and numbers[0] <= was["last_pkt"]:
            raise ValueError(f"packet {numbers[0]} came after {was['last_pkt']}: micro-batches are out of capture order")
        flags = {f: (packets["flags"] >> bit & 1).astype(bool) for bit, f in enumerate(FLAGS)}
        for name in FLAGS[1:]:
            flags[name] &= self.tcp
        closes = flags["fin"] | flags["rst"]
        hard = flags["syn"] & ~flags["ack"]
        hard[1:] |= closes[:-1]
        hard[0] |= not was["is_open"]
        starts = flow_starts(ts, hard, was["first_ts_ns"] if was["is_open"] else None, self.timeout_ns)

        # Flow of each packet; -1 is the flow carried in.
        flow_of = np.searchsorted(starts, np.arange(len(ts)), side="right") - 1
        side = flags["src_is_lo"]
        hard_at = np.maximum.accumulate(np.where(hard, np.arange(len(ts)), -1))
        client_is_lo = np.where(hard_at >= 0, side[hard_at], bool(was["client_is_lo"]))
        edges = np.unique(np.concatenate([[0], starts])).astype(np.int64)
        sums = np.add.reduceat(self._measures(flags, packets, client_is_lo), edges, axis=0)
        last = np.append(edges[1:], len(ts)) - 1
        at = np.searchsorted(numbers, segments["pkt_no"])
        mine = np.flatnonzero(segments["src_is_lo"] == client_is_lo[at]) if len(at) else at
        of_flow, ends = flow_of[at], np.cumsum(segments["size"])
        places = list(zip(segments["seq"].tolist(), (ends - segments["size"]).tolist(), ends.tolist()))

        ended = []
        if was["is_open"] and flow_of[0] >= 0:
            ended.append(self._row(was))
        for begin, end, total in zip(edges.tolist(), last.tolist(), sums):
            row = dict(zip(SUMS, total.tolist()))
            if flow_of[begin] < 0:
                row = {**was, **{n: row[n] + was[n] for n in SUMS}}
            else:
                lo = bool(client_is_lo[begin])
                row.update(lo_flows=was["lo_flows"] + lo, hi_flows=was["hi_flows"] + (not lo), client_is_lo=int(lo))
                row.update(open_pkt=int(numbers[begin]), first_ts_ns=int(ts[begin]))
                self.search = Search()
            row.update(last_ts_ns=int(ts[end]), last_pkt=int(numbers[end]), is_open=int(not closes[end]))
            # Nothing behind the hello of a flow is looked at.
            for i in mine[of_flow[mine] == flow_of[begin]].tolist():
                if self.search.hello is not None:
                    break
                seq, low, high = places[i]
                self.search.add(seq, payload[low:high])
            if end < len(ts) - 1 or closes[end]:
                ended.append(self._row(row))
            was = row
        self.was, self.fresh = was, False
        return ended

    def _row(self, row: dict) -> dict:
        return {**row, "flow_instance": row["lo_flows" if row["client_is_lo"] else "hi_flows"] - 1, "hello": self.search.hello}

    def open_flow(self) -> dict | None:
        return self._row(self.was) if self.was["is_open"] else None


def is_tcp(key: tuple) -> bool:
    return key[-1] == TCP
