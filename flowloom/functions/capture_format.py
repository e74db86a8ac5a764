"""Record boundaries of classic and next-generation capture files.

Small helpers for the tasks that read byte ranges of capture files; they see a file only
through ``Bytes`` and never hold more than one window of it.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

# --- Fixed values: file formats -----------------------------------------------------------
# First four bytes of a classic file -> (byte order, nanoseconds per fraction tick).
CLASSIC_MAGIC = {
    b"\xd4\xc3\xb2\xa1": ("<", 1000),
    b"\xa1\xb2\xc3\xd4": (">", 1000),
    b"\x4d\x3c\xb2\xa1": ("<", 1),
    b"\xa1\xb2\x3c\x4d": (">", 1),
}
CLASSIC_HEADER = 24
SECTION_MAGIC = b"\x0a\x0d\x0d\x0a"
BYTE_ORDERS = {b"\x4d\x3c\x2b\x1a": "<", b"\x1a\x2b\x3c\x4d": ">"}
SECTION, INTERFACE, OLD_PACKET, SIMPLE_PACKET, PACKET = 0x0A0D0D0A, 1, 2, 3, 6
TIME_RESOLUTION, TIME_OFFSET = 9, 14
# Records in a row that must look right before a guessed boundary is tried.
CHAIN = 5
# Bytes searched together, and bytes behind them that records may reach into.
WINDOW = 1 << 20
LOOK_AHEAD = 1 << 16
SECOND_NS = 1_000_000_000


class Broken(Exception):
    """The file ends or makes no sense here; nothing after this point is read."""


class Frame(NamedTuple):
    ts_ns: int
    caplen: int
    frame_len: int
    linktype: int
    data: bytes


class Bytes:
    """Random access to an open file through one read-ahead window."""

    def __init__(self, source, length: int, window: int = 4 << 20):
        self.source, self.length, self.size = source, length, window
        self.base, self.window = 0, b""

    def get(self, at: int, count: int) -> bytes:
        if at + count > self.length:
            raise Broken
        start = at - self.base
        if start < 0 or start + count > len(self.window):
            self.source.seek(at)
            self.base, self.window = at, self.source.read(max(count, self.size))
            start = 0
        return self.window[start : start + count]


class Classic:
    """Records of a classic capture."""

    first = CLASSIC_HEADER
    step = 1

    def __init__(self, head: bytes):
        self.order, self.tick = CLASSIC_MAGIC[head[:4]]
        longest, linktype = struct.unpack(self.order + "II", head[16:24])
        self.linktype, self.longest = linktype & 0x0FFFFFFF, max(longest, 1 << 18)

    def record(self, file: Bytes, at: int) -> tuple[int, tuple]:
        header = struct.unpack(self.order + "IIII", file.get(at, 16))
        if at + 16 + header[2] > file.length:
            raise Broken
        return at + 16 + header[2], header

    def plausible(self, file: Bytes, at: int) -> int:
        # Only for guesses: a frame may lack its length, but zeros all through are filling.
        end, (seconds, fraction, caplen, frame_len) = self.record(file, at)
        if fraction * self.tick >= SECOND_NS or caplen > self.longest or not (seconds or frame_len):
            raise Broken
        if frame_len and frame_len < caplen:
            raise Broken
        return end

    def likely(self, data: bytes, at: int, size: int, length: int) -> np.ndarray:
        """Places among the first ``size`` of a window at which records may begin."""
        count = max(0, len(data) - 15)
        seconds, fraction, caplen, frame_len = (_words(data, 4 * i, self.order, 1, count) for i in range(4))
        after = np.arange(count) + 16 + caplen
        right = (fraction * self.tick < SECOND_NS) & (caplen <= self.longest) & ((seconds > 0) | (frame_len > 0))
        right &= ((frame_len == 0) | (frame_len >= caplen)) & (at + after <= length)
        found = _chained(right, after)
        return found[found < size]

    def note(self, file: Bytes, at: int, end: int) -> bytes | None:
        return None

    def counts(self, file: Bytes, at: int) -> bool:
        return True

    def frame(self, file: Bytes, at: int) -> Frame | None:
        _, (seconds, fraction, caplen, frame_len) = self.record(file, at)
        ts = seconds * SECOND_NS + fraction * self.tick
        return Frame(ts, caplen, frame_len, self.linktype, file.get(at + 16, caplen))


class Sections:
    """Blocks of a next-generation capture; byte order and interfaces change on the way."""

    first = 0
    step = 4

    def __init__(self, head: bytes):
        self.order = BYTE_ORDERS[head[8:12]]
        self.interfaces: list[tuple[int, int, int]] = []

    def _block(self, file: Bytes, at: int) -> tuple[int, int]:
        head = file.get(at, 12)
        if head[:4] == SECTION_MAGIC:
            order = BYTE_ORDERS.get(head[8:12])
            if order is None:
                raise Broken
            self.order = order
        kind, size = struct.unpack(self.order + "II", head[:8])
        if size < 12 or size % 4 or at + size > file.length:
            raise Broken
        return kind, size

    def record(self, file: Bytes, at: int) -> tuple[int, int]:
        kind, size = self._block(file, at)
        return at + size, kind

    def plausible(self, file: Bytes, at: int) -> int:
        end, _ = self.record(file, at)
        if file.get(at + 4, 4) != file.get(end - 4, 4):
            raise Broken
        return end

    def likely(self, data: bytes, at: int, size: int, length: int) -> np.ndarray:
        """Places among the first ``size`` of a window at which blocks may begin."""
        count = max(0, (len(data) - 8) // 4)
        sizes = _words(data, 4, self.order, 4, count)
        after, place = np.arange(count) + sizes // 4, 4 * np.arange(count)
        right = (sizes >= 12) & (sizes % 4 == 0) & (at + place + sizes <= length)
        # The size stands at the end of a block once more.
        ends = np.where(right & (after - 2 < count), after - 2, -1)
        right &= (ends < 0) | (sizes[ends] == sizes)
        # A section may change the byte order, and all behind it.
        section = _words(data, 0, ">", 4, count) == SECTION
        found = np.union1d(4 * _chained(right | section, np.where(section, count, after)), 4 * np.flatnonzero(section))
        return found[found < size]

    def note(self, file: Bytes, at: int, end: int) -> bytes | None:
        """Blocks that later ranges need to know."""
        kind = self.record(file, at)[1]
        return file.get(at, end - at) if kind in (SECTION, INTERFACE) else None

    def counts(self, file: Bytes, at: int) -> bool:
        return self.record(file, at)[1] in (OLD_PACKET, SIMPLE_PACKET, PACKET)

    def _options(self, data: bytes) -> Iterator[tuple[int, bytes]]:
        at = 0
        while at + 4 <= len(data):
            code, size = struct.unpack_from(self.order + "HH", data, at)
            if code == 0:
                return
            yield code, data[at + 4 : at + 4 + size]
            at += 4 + size + -size % 4

    def _interface(self, block: bytes) -> None:
        linktype = struct.unpack_from(self.order + "H", block, 8)[0]
        units, offset = 10**6, 0
        for code, value in self._options(block[16:-4]):
            if code == TIME_RESOLUTION and value:
                base = 2 if value[0] & 0x80 else 10
                units = base ** (value[0] & 0x7F)
            elif code == TIME_OFFSET and len(value) == 8:
                offset = struct.unpack(self.order + "q", value)[0]
        self.interfaces.append((linktype, units, offset))

    def frame(self, file: Bytes, at: int) -> Frame | None:
        kind, size = self._block(file, at)
        block = file.get(at, size)
        if kind == SECTION:
            self.interfaces = []
        elif kind == INTERFACE:
            self._interface(block)
        elif kind == SIMPLE_PACKET:
            frame_len = struct.unpack_from(self.order + "I", block, 8)[0]
            data = block[12 : min(12 + frame_len, size - 4)]
            return Frame(0, len(data), frame_len, self._of(0)[0], data)
        elif kind in (PACKET, OLD_PACKET):
            form = "IIIII" if kind == PACKET else "HHIIII"
            number, *_, high, low, caplen, frame_len = struct.unpack_from(self.order + form, block, 8)
            linktype, units, offset = self._of(number)
            if 28 + caplen > size - 4:
                raise Broken
            ts = ((high << 32) | low) * SECOND_NS // units + offset * SECOND_NS
            return Frame(ts, caplen, frame_len, linktype, block[28 : 28 + caplen])
        return None

    def _of(self, number: int) -> tuple[int, int, int]:
        if number >= len(self.interfaces):
            raise Broken
        return self.interfaces[number]


def open_format(file: Bytes) -> Classic | Sections:
    """The format by content; Broken if it is none of the two."""
    head = file.get(0, CLASSIC_HEADER)
    if head[:4] in CLASSIC_MAGIC:
        return Classic(head)
    if head[:4] == SECTION_MAGIC and head[8:12] in BYTE_ORDERS:
        return Sections(head)
    raise Broken


def _words(data: bytes, at: int, order: str, step: int, count: int) -> np.ndarray:
    """The 32-bit number ``at`` bytes behind each ``step``-th place."""
    return np.ndarray((count,), order + "u4", data, at if count else 0, (step,)).astype(np.int64)


def _chained(looks_right: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Places from which records look right, nearly ``CHAIN`` of them, by pointer doubling.

    ``after`` is the place of the next record; one outside the window counts as right.
    """
    count = len(looks_right)
    right = np.append(looks_right, True)
    after = np.append(np.where(looks_right & (after < count), after, count), count)
    records = 1
    while 2 * records <= CHAIN:
        right &= right[after]
        after = after[after]
        records *= 2
    return np.flatnonzero(right[:-1])


def guess(form: Classic | Sections, file: Bytes, start: int, stop: int) -> int:
    """First place in the range from which a chain of records looks right, or ``stop``.

    Windows are searched as arrays; only places from which all records inside the window look right are
    followed one by one.
    """
    at = start + -start % form.step
    while at < stop:
        data = file.get(at, min(WINDOW + LOOK_AHEAD, file.length - at))
        for place in form.likely(data, at, min(WINDOW, stop - at), file.length).tolist():
            try:
                here = at + place
                for _ in range(CHAIN):
                    if here == file.length:
                        break
                    here = form.plausible(file, here)
            except Broken:
                continue
            return at + place
        at += WINDOW
    return stop
