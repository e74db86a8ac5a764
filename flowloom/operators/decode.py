"""Captured frames to packets, with built-in byte expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions import frames as fr
from flowloom.schema import PACKET_SCHEMA, TCP, UDP


def wire_length():
    """Length on the wire; the captured length where the capture does not say."""
    return F.when(F.col("frame_len") > 0, F.col("frame_len")).otherwise(F.col("caplen"))


def _fields(frames: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """Add columns that later expressions use many times.

    ``inline`` keeps them apart from the next step: as plain projections the optimizer would
    write the whole expression of each field into every place that uses it.
    """
    row = F.struct(*[column.alias(name) for name, column in fields.items()])
    return frames.select("*", F.inline(F.array(row)))


def _network(frames: DataFrame) -> DataFrame:
    frame, at, v4 = F.col("frame"), F.col("net_at"), F.col("version") == 4
    outer, outer_version = F.col("outer_at"), F.col("outer_version")
    found = _fields(frames, {"outer_at": fr.network_offset(frame, F.col("linktype"))})
    found = _fields(found, {"outer_version": fr.network_version(frame, F.col("linktype"), outer)})
    # A packet of version 4 inside one of version 6 is the one that counts.
    inside = (outer_version == 6) & (fr.number(frame, outer + 6, 1) == fr.IPV4_IN_IPV6)
    inside = F.coalesce(inside & (F.shiftright(fr.number(frame, outer + 40, 1), 4) == 4), F.lit(False))
    found = _fields(
        found,
        {
            "net_at": F.when(inside, outer + 40).otherwise(outer),
            "version": F.when(inside, F.lit(4)).otherwise(outer_version),
        },
    )
    header = F.when(v4, fr.number(frame, at, 1).bitwiseAND(15) * 4).otherwise(F.lit(40))
    fragment = F.when(v4, fr.number(frame, at + 6, 2).bitwiseAND(8191)).otherwise(F.lit(0))
    said = F.when(v4, fr.number(frame, at + 2, 2)).otherwise(fr.number(frame, at + 4, 2) + 40)
    fields = {
        "proto": F.when(v4, fr.number(frame, at + 9, 1)).otherwise(fr.number(frame, at + 6, 1)),
        "l4_at": (at + header).cast("int"),
        "said": said,
        "first": (header >= 20) & (fragment == 0),
    }
    found = _fields(found.filter(F.col("version").isNotNull()), fields)
    return found.filter(F.col("proto").isin(TCP, UDP) & F.col("first"))


def decode_frames(frames: DataFrame) -> DataFrame:
    """TCP and UDP packets of IPv4 and IPv6 frames; all other frames are dropped.

    Headers may stand behind VLAN tags, a PPPoE session, MPLS labels, or IPv4 inside IPv6.
    """
    frame, at, l4 = F.col("frame"), F.col("net_at"), F.col("l4_at")
    tcp = F.col("proto") == TCP
    v4 = F.col("version") == 4
    captured = F.length(frame)
    # Padding behind the packet is not payload; a length of 0 means that it is not known.
    end = F.when(F.col("said") > 0, F.least(at + F.col("said"), captured)).otherwise(captured)
    tcp_header = F.shiftright(fr.number(frame, l4 + 12, 1), 4) * 4
    shortest = F.when(tcp, F.lit(20)).otherwise(F.lit(8))
    fields = {
        "end": end.cast("int"),
        "header": F.when(tcp, tcp_header).otherwise(F.lit(8)).cast("int"),
        "bits": F.when(tcp, fr.number(frame, l4 + 13, 1)).otherwise(F.lit(0)),
    }
    found = _fields(_network(frames), fields)
    found = found.filter((F.col("header") >= shortest) & (l4 + F.col("header") <= F.col("end")))
    data_at = l4 + F.col("header")

    def address(v4_at: int, v6_at: int):
        four = fr.ipv4_text(fr.chunk(frame, at + v4_at, 4))
        return F.when(v4, four).otherwise(fr.ipv6_text(fr.chunk(frame, at + v6_at, 16)))

    size = F.col("end") - data_at
    columns = {
        "wirelen": wire_length(),
        "src_ip": address(12, 8),
        "dst_ip": address(16, 24),
        "src_port": fr.number(frame, l4, 2),
        "dst_port": fr.number(frame, l4 + 2, 2),
        **{flag: F.col("bits").bitwiseAND(bit) != 0 for flag, bit in fr.FLAG_BITS.items()},
        "seq": F.when(tcp, fr.number(frame, l4 + 4, 4)),
        "payload": fr.chunk(frame, data_at, size),
        "payload_len": size,
    }
    decoded = found.withColumns(columns)
    return decoded.select(*[F.col(f.name).cast(f.dataType) for f in PACKET_SCHEMA])
