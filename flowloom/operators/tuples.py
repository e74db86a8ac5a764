"""Packet normalisation and the conversation key both directions share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.schema import TCP, UDP


def require_order(packets: DataFrame) -> None:
    missing = sorted({"capture_id", "pkt_no", "ts_ns"} - set(packets.columns))
    if missing:
        raise ValueError(f"packets need an arrival order; missing columns: {missing}")


def parsed_packets(packets: DataFrame) -> DataFrame:
    """Keep TCP and UDP packets."""
    return packets.filter(F.col("proto").isin(TCP, UDP))


def source_is_lo() -> Column:
    src_ip, dst_ip = F.col("src_ip"), F.col("dst_ip")
    return (src_ip < dst_ip) | ((src_ip == dst_ip) & (F.col("src_port") <= F.col("dst_port")))


def with_tuple(packets: DataFrame) -> DataFrame:
    """Replace the two endpoints of each packet by the ordered pair and the sender's side."""
    side = F.col("src_is_lo")
    pair = {
        "lo_ip": F.when(side, F.col("src_ip")).otherwise(F.col("dst_ip")),
        "lo_port": F.when(side, F.col("src_port")).otherwise(F.col("dst_port")),
        "hi_ip": F.when(side, F.col("dst_ip")).otherwise(F.col("src_ip")),
        "hi_port": F.when(side, F.col("dst_port")).otherwise(F.col("src_port")),
    }
    return (
        packets.withColumn("src_is_lo", source_is_lo())
        .withColumns(pair)
        .drop("src_ip", "dst_ip", "src_port", "dst_port")
    )


def endpoints() -> dict[str, Column]:
    """Client and server columns of a flow from its ordered pair."""
    side = F.col("client_is_lo")
    return {
        "client_ip": F.when(side, F.col("lo_ip")).otherwise(F.col("hi_ip")),
        "server_ip": F.when(side, F.col("hi_ip")).otherwise(F.col("lo_ip")),
        "client_port": F.when(side, F.col("lo_port")).otherwise(F.col("hi_port")),
        "server_port": F.when(side, F.col("hi_port")).otherwise(F.col("lo_port")),
    }


def is_tcp() -> Column:
    return F.col("proto") == TCP


def opens_by_syn() -> Column:
    return is_tcp() & F.col("syn") & ~F.col("ack")


def closes() -> Column:
    return is_tcp() & (F.col("fin") | F.col("rst"))


def from_client() -> Column:
    return F.col("src_is_lo") == F.col("client_is_lo")
