"""Aggregate labelled packets to one row per flow instance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.operators import tuples
from flowloom.operators.sessionize import HOT_ROWS, assign_flows, find_hot
from flowloom.schema import (
    ACTIVE_TIMEOUT_NS,
    COUNTERS,
    ENDPOINT_COLUMNS,
    FLOW_KEY,
    TCP_COUNTS,
    TUPLE_KEY,
)

# What the meter reads of a packet; payloads stay out of its shuffle.
METER_COLUMNS = (
    ["capture_id", "pkt_no", "ts_ns", "caplen", "wirelen"]
    + ["src_ip", "dst_ip", "src_port", "dst_port", "proto"]
    + ["syn", "ack", "fin", "rst", "psh"]
)

FLOW_COLUMNS = (
    ["capture_id"]
    + ENDPOINT_COLUMNS
    + ["flow_instance", "open_pkt"]
    + COUNTERS
    + ["first_ts_ns", "last_ts_ns", "duration_ns"]
    + TCP_COUNTS
    + ["avg_wirelen_total"]
)


def _total(value: Column, where: Column | None = None) -> Column:
    kept = value if where is None else F.when(where, value).otherwise(F.lit(0))
    return F.sum(kept.cast("long"))


def flow_measures() -> list[Column]:
    """Counters of a flow as aggregates over its packets; all combine map-side."""
    c2s = tuples.from_client()
    tcp = tuples.is_tcp()
    one = F.lit(1)
    syn, ack = F.col("syn"), F.col("ack")
    measures = {
        "packets_total": _total(one),
        "packets_c2s": _total(one, c2s),
        "packets_s2c": _total(one, ~c2s),
        "first_ts_ns": F.min_by("ts_ns", "pkt_no"),
        "last_ts_ns": F.max_by("ts_ns", "pkt_no"),
        "tcp_syn_total": _total(one, tcp & syn),
        "tcp_syn_c2s": _total(one, tcp & c2s & syn & ~ack),
        "tcp_synack_s2c": _total(one, tcp & ~c2s & syn & ack),
        "tcp_ack_total": _total(one, tcp & ack),
        "tcp_fin_total": _total(one, tcp & F.col("fin")),
        "tcp_rst_total": _total(one, tcp & F.col("rst")),
        "tcp_psh_total": _total(one, tcp & F.col("psh")),
    }
    for name, length in (("cap", F.col("caplen")), ("wire", F.col("wirelen"))):
        measures[f"bytes_{name}_total"] = _total(length)
        measures[f"bytes_{name}_c2s"] = _total(length, c2s)
        measures[f"bytes_{name}_s2c"] = _total(length, ~c2s)
    return [column.alias(name) for name, column in measures.items()]


def duration_ns() -> Column:
    return F.greatest(F.col("last_ts_ns") - F.col("first_ts_ns"), F.lit(0))


def average_wirelen() -> Column:
    packets = F.col("packets_total")
    return F.when(packets > 0, F.col("bytes_wire_total") / packets).otherwise(F.lit(0.0))


def measure_flows(cold: DataFrame, hot: DataFrame | None) -> DataFrame:
    """One row per flow from the two frames of ``assign_flows``."""
    by_opening = Window.partitionBy(*TUPLE_KEY, "client_is_lo").orderBy("open_pkt")
    flows = (
        cold.groupBy(*FLOW_KEY)
        .agg(*flow_measures())
        .withColumn("flow_instance", F.row_number().over(by_opening).cast("long") - 1)
    )
    if hot is not None:
        numbered = F.max("flow_instance").alias("flow_instance")
        flows = flows.unionByName(hot.groupBy(*FLOW_KEY).agg(*flow_measures(), numbered))
    return flows.withColumns(
        {**tuples.endpoints(), "duration_ns": duration_ns(), "avg_wirelen_total": average_wirelen()}
    ).select(*FLOW_COLUMNS)


def meter_flows(
    packets: DataFrame, timeout_ns: int = ACTIVE_TIMEOUT_NS, hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """Flow table without TLS fields."""
    hot = find_hot(packets, timeout_ns, hot_rows)
    return measure_flows(*assign_flows(packets.select(*METER_COLUMNS), timeout_ns, hot))


def capture_summary(packets: DataFrame, flows: DataFrame) -> DataFrame:
    """Packets read, packets parsed and flows of each capture."""
    parsed = F.count_if(F.col("proto").isin(tuples.TCP, tuples.UDP))
    seen = packets.groupBy("capture_id").agg(
        F.count(F.lit(1)).alias("total_packets"), parsed.alias("parsed_packets")
    )
    made = flows.groupBy("capture_id").agg(F.count(F.lit(1)).alias("flows"))
    return seen.join(made, "capture_id", "left").fillna(0, ["flows"])
