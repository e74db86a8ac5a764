"""In-order bytes of one sender from TCP segments in arrival order.

The first segment that arrives anchors the stream. Sequence numbers are compared as plain
unsigned numbers and counted modulo 2**32, so a stream that wraps is not followed past the
wrap; results must agree with that.
"""

from __future__ import annotations

import heapq

# Fixed value: width of the sequence number.
SEQUENCE_SPACE = 1 << 32


class ClientStream:
    def __init__(self, next_seq: int | None = None, held: dict[int, bytes] | None = None):
        self.next_seq = next_seq
        self.held = dict(held or {})
        self._order = sorted(self.held)

    def feed(self, seq: int, data: bytes) -> bytes:
        """Bytes that become contiguous with this segment."""
        if not data:
            return b""
        if self.next_seq is None:
            self.next_seq = seq
        if seq > self.next_seq:
            self._hold(seq, data)
            return b""
        out = bytearray(self._advance(seq, data))
        while self._order and self._order[0] <= self.next_seq:
            early = heapq.heappop(self._order)
            out += self._advance(early, self.held.pop(early))
        return bytes(out)

    def _hold(self, seq: int, data: bytes) -> None:
        known = self.held.get(seq)
        if known is None:
            heapq.heappush(self._order, seq)
        if known is None or len(known) < len(data):
            self.held[seq] = data

    def _advance(self, seq: int, data: bytes) -> bytes:
        fresh = data[self.next_seq - seq :]
        self.next_seq = (self.next_seq + len(fresh)) % SEQUENCE_SPACE
        return fresh
