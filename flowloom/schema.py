"""Column lists and Spark types of the tables the engine reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

TCP = 6
UDP = 17

# Fixed value: a flow is cut when a packet is more than 120 s younger than its first packet.
ACTIVE_TIMEOUT_NS = 120_000_000_000

# One row per captured frame, before decoding.
FRAME_SCHEMA = T.StructType(
    [
        T.StructField("capture_id", T.StringType(), False),
        T.StructField("pkt_no", T.LongType(), False),
        T.StructField("ts_ns", T.LongType(), False),
        T.StructField("caplen", T.LongType(), False),
        T.StructField("frame_len", T.LongType(), False),
        T.StructField("linktype", T.IntegerType(), False),
        T.StructField("frame", T.BinaryType(), True),
    ]
)

# One row per decoded packet. pkt_no is the arrival order inside one capture.
PACKET_SCHEMA = T.StructType(
    [
        T.StructField("capture_id", T.StringType(), False),
        T.StructField("pkt_no", T.LongType(), False),
        T.StructField("ts_ns", T.LongType(), False),
        T.StructField("caplen", T.LongType(), False),
        T.StructField("wirelen", T.LongType(), False),
        T.StructField("src_ip", T.StringType(), False),
        T.StructField("dst_ip", T.StringType(), False),
        T.StructField("src_port", T.IntegerType(), False),
        T.StructField("dst_port", T.IntegerType(), False),
        T.StructField("proto", T.IntegerType(), False),
        T.StructField("syn", T.BooleanType(), False),
        T.StructField("ack", T.BooleanType(), False),
        T.StructField("fin", T.BooleanType(), False),
        T.StructField("rst", T.BooleanType(), False),
        T.StructField("psh", T.BooleanType(), False),
        T.StructField("seq", T.LongType(), True),
        T.StructField("payload", T.BinaryType(), True),
        T.StructField("payload_len", T.LongType(), False),
    ]
)

HELLO_TYPE = T.StructType(
    [
        T.StructField("legacy_version", T.IntegerType()),
        T.StructField("cipher_suites", T.ArrayType(T.IntegerType())),
        T.StructField("extensions", T.ArrayType(T.IntegerType())),
        T.StructField("has_sni", T.BooleanType()),
        T.StructField("alpn_protocols", T.ArrayType(T.BinaryType())),
    ]
)

# The conversation both directions of a tuple share: (lo, hi) are the two ordered endpoints.
TUPLE_KEY = ["capture_id", "lo_ip", "lo_port", "hi_ip", "hi_port", "proto"]
# A flow instance; open_pkt is the pkt_no of its first packet.
FLOW_KEY = TUPLE_KEY + ["client_is_lo", "open_pkt"]

# --- Fixed values: names and order of the exported columns -------------------------------
ENDPOINT_COLUMNS = ["client_ip", "server_ip", "client_port", "server_port", "proto"]
PACKET_COUNTS = ["packets_total", "packets_c2s", "packets_s2c"]
CAP_BYTES = ["bytes_cap_total", "bytes_cap_c2s", "bytes_cap_s2c"]
WIRE_BYTES = ["bytes_wire_total", "bytes_wire_c2s", "bytes_wire_s2c"]
TCP_COUNTS = [
    "tcp_syn_total",
    "tcp_syn_c2s",
    "tcp_synack_s2c",
    "tcp_ack_total",
    "tcp_fin_total",
    "tcp_rst_total",
    "tcp_psh_total",
]
HELLO_SCALARS = [
    "ja4_legacy_version",
    "ja4_cipher_suites_count",
    "ja4_extensions_count",
    "ja4_has_sni",
    "ja4_alpn",
]
HELLO_LISTS = ["ja4_cipher_suites", "ja4_extensions"]

COUNTERS = PACKET_COUNTS + CAP_BYTES + WIRE_BYTES

# The 33 columns of a flow CSV file.
FLOW_CSV_COLUMNS = (
    ENDPOINT_COLUMNS
    + COUNTERS
    + ["first_ts_ns", "last_ts_ns", "duration_ns"]
    + TCP_COUNTS
    + ["tls_client_hello_c2s"]
    + HELLO_SCALARS
    + HELLO_LISTS
    + ["avg_wirelen_total"]
)

# The 31 columns the dataset builder needs.
BUILDER_COLUMNS = [c for c in FLOW_CSV_COLUMNS if c not in ("first_ts_ns", "last_ts_ns")]
BUILDER_STRINGS = ["client_ip", "server_ip", "ja4_legacy_version", "ja4_alpn"] + HELLO_LISTS
BUILDER_NUMBERS = [c for c in BUILDER_COLUMNS if c not in BUILDER_STRINGS]
BUILDER_FLOATS = ["duration_ns", "avg_wirelen_total"]
BUILDER_INTEGERS = [c for c in BUILDER_NUMBERS if c not in BUILDER_FLOATS]

DERIVED_FLOATS = [
    "duration_ms",
    "bytes_ratio_c2s_s2c",
    "packets_ratio_c2s_s2c",
    "pps_total",
    "bps_total",
]

# The three datasets: 25, 32 and 26 columns.
FLOW_ONLY_COLUMNS = (
    ["proto"]
    + COUNTERS
    + ["duration_ms"]
    + TCP_COUNTS
    + ["avg_wirelen_total"]
    + ["bytes_ratio_c2s_s2c", "packets_ratio_c2s_s2c", "pps_total", "bps_total"]
    + ["is_tcp", "is_udp"]
)
FLOW_PLUS_COLUMNS = FLOW_ONLY_COLUMNS + ["tls_client_hello_c2s", "ja4_present"] + HELLO_SCALARS
CATEGORICAL_COLUMNS = ["ja4_legacy_version", "ja4_alpn"]
REPORT_COLUMNS = (
    ENDPOINT_COLUMNS
    + PACKET_COUNTS
    + WIRE_BYTES
    + ["duration_ms"]
    + [c for c in TCP_COUNTS if c.endswith("_total")]
    + ["tls_client_hello_c2s", "ja4_present"]
    + HELLO_SCALARS
    + HELLO_LISTS
)
