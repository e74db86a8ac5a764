"""Checks of a flow table: row invariants, a validation sample and a recount from packets."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.text import stripped
from flowloom.operators import tuples
from flowloom.operators.datasets import coerce_numbers
from flowloom.schema import BUILDER_COLUMNS, BUILDER_INTEGERS, BUILDER_NUMBERS, TUPLE_KEY

# --- Fixed values -------------------------------------------------------------------------
AVERAGE_TOLERANCE = 1e-3
PLACEHOLDERS = ["", "-", "none", "nan"]
SAMPLE_SEED = 42
SAMPLE_SIZES = {"tcp_plain": 4, "tcp_hello": 4, "udp": 2, "reset_or_fin": 2}
SAMPLE_TOP = 2
# Name of the stratum of the largest flows.
LARGEST = "largest"


def typed_rows(rows: DataFrame) -> DataFrame:
    """Number columns of a raw flow file as numbers; a flow table passes unchanged."""
    kinds = dict(rows.dtypes)
    if all(kinds.get(c) != "string" for c in BUILDER_NUMBERS):
        return rows
    whole = {c: F.col(c).cast("long") for c in BUILDER_INTEGERS + ["duration_ns"]}
    return coerce_numbers(rows).withColumns(whole)


def violations() -> dict[str, Column]:
    """Six predicates that no flow row may satisfy."""

    def split_mismatch(measure: str) -> Column:
        parts = F.col(f"{measure}_c2s") + F.col(f"{measure}_s2c")
        return F.coalesce(F.col(f"{measure}_total") != parts, F.lit(True))

    def filled(name: str) -> Column:
        return ~F.lower(stripped(F.coalesce(F.col(name).cast("string"), F.lit("")))).isin(PLACEHOLDERS)

    def positive(name: str) -> Column:
        return F.coalesce(F.col(name).try_cast("double"), F.lit(0.0)) > 0

    average = F.try_divide(F.col("bytes_wire_total"), F.col("packets_total"))
    leftovers = (
        filled("ja4_legacy_version")
        | filled("ja4_alpn")
        | positive("ja4_cipher_suites_count")
        | positive("ja4_extensions_count")
        | positive("ja4_has_sni")
    )
    return {
        "bad_packets_sum": split_mismatch("packets"),
        "bad_wire_bytes_sum": split_mismatch("bytes_wire"),
        "bad_cap_bytes_sum": split_mismatch("bytes_cap"),
        "negative_duration": F.col("duration_ns") < 0,
        "avg_wirelen_mismatch": F.abs(F.col("avg_wirelen_total") - average) > AVERAGE_TOLERANCE,
        "ja4_without_client_hello": (F.col("tls_client_hello_c2s") == 0) & leftovers,
    }


def check_flows(rows: DataFrame) -> DataFrame:
    """Number of violations of each invariant, in one pass."""
    rows = typed_rows(rows)
    return rows.agg(*[F.count_if(bad).alias(name) for name, bad in violations().items()])


def violating_flows(rows: DataFrame) -> DataFrame:
    """The rows behind the counts, with the names of the invariants they break."""
    names = F.array_compact(F.array(*[F.when(bad, F.lit(n)) for n, bad in violations().items()]))
    return typed_rows(rows).withColumn("violations", names).filter(F.size("violations") > 0)


def strata() -> dict[str, Column]:
    tcp, hello = F.col("proto") == tuples.TCP, F.col("tls_client_hello_c2s")
    return {
        "tcp_plain": tcp & (hello == 0),
        "tcp_hello": tcp & (hello == 1),
        "udp": F.col("proto") == tuples.UDP,
        "reset_or_fin": (F.col("tcp_rst_total") > 0) | (F.col("tcp_fin_total") > 0),
    }


def top_flows(rows: DataFrame, k: int = SAMPLE_TOP, tie_break: list[str] | None = None) -> DataFrame:
    """The k flows with most packets; ties fall by the remaining columns."""
    order = [F.desc("packets_total")] + [F.asc(c) for c in tie_break or BUILDER_COLUMNS]
    return typed_rows(rows).orderBy(*order).limit(k)


def _smallest(table: pa.Table, order: list[tuple[str, str]], k: int) -> pa.Table:
    if table.num_rows <= 1:
        return table.slice(0, k)
    return table.take(pa.compute.sort_indices(table, sort_keys=order, null_placement="at_start")[:k])


def _bottom(orders: dict[str, tuple[list[tuple[str, str]], int]], final: bool):
    """A pass over Arrow batches that keeps the first rows of each stratum in its order; mergeable.

    ``strata`` of a row names those that it is in. The ``final`` pass drops strata with fewer rows than asked for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, pa.Table] = {}
        for batch in batches:
            table, member = pa.Table.from_batches([batch]), batch.column("strata").to_pylist()
            for name, (order, k) in orders.items():
                own = table.take(pa.array([i for i, names in enumerate(member) if name in names], pa.int64()))
                if own.num_rows:
                    own = own.set_column(own.schema.get_field_index("strata"), table.schema.field("strata"), pa.array([[name]] * own.num_rows, table.schema.field("strata").type))
                    kept[name] = _smallest(pa.concat_tables([kept[name], own]) if name in kept else own, order, k)
        for name, table in kept.items():
            if not final or name == LARGEST or table.num_rows == orders[name][1]:
                yield from table.combine_chunks().to_batches()

    return run


def stratified_sample(rows: DataFrame, seed: int = SAMPLE_SEED, sizes: dict[str, int] | None = None) -> DataFrame:
    """A few flows of each kind and the largest ones, as distinct rows, in one pass over the table.

    The draw orders a stratum by a seeded digest of the row. Each task keeps the first few rows of every
    stratum, and only these are shuffled and merged, so a stratum may be any share of the table and nothing
    is sorted but batches. A stratum with fewer rows than asked for gives none.
    """
    sizes = sizes or SAMPLE_SIZES
    flows = typed_rows(rows).select(*BUILDER_COLUMNS)
    # Fractions have no common text form, so the digest goes without them.
    whole = [c for c in BUILDER_COLUMNS if c != "avg_wirelen_total"]
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in whole]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *text))
    kinds = F.array_compact(F.array(*[F.when(strata()[n], F.lit(n)) for n in sizes], F.lit(LARGEST)))
    members = flows.withColumns({"digest": digest, "strata": kinds})
    columns = [(c, "ascending") for c in BUILDER_COLUMNS]
    orders = {n: ([("digest", "ascending"), *columns], k) for n, k in sizes.items()}
    orders[LARGEST] = ([("packets_total", "descending"), *columns], SAMPLE_TOP)
    part = members.mapInArrow(_bottom(orders, final=False), members.schema)
    merged = part.repartition(len(orders), F.element_at("strata", 1)).mapInArrow(_bottom(orders, final=True), members.schema)
    return merged.select(*BUILDER_COLUMNS).dropDuplicates()


def endpoint_filter(client: tuple[str, int], server: tuple[str, int], proto: int) -> tuple[Column, Column, Column]:
    """(client to server, server to client, either) predicates on packets."""

    def one_way(a: tuple[str, int], b: tuple[str, int]) -> Column:
        return (
            (F.col("src_ip") == a[0])
            & (F.col("src_port") == a[1])
            & (F.col("dst_ip") == b[0])
            & (F.col("dst_port") == b[1])
            & (F.col("proto") == proto)
        )

    there, back = one_way(client, server), one_way(server, client)
    return there, back, there | back


def _count(where: Column) -> Column:
    return F.sum(where.cast("long"))


def begins_hello(payload: Column) -> Column:
    """True if one of the TLS records that follow each other from the first byte on is a ClientHello.

    The walk is one expression: a position in the hex text of the payload, carried from record to record.
    Payloads that begin with no handshake record are not walked.
    """
    text = F.hex(payload)

    def number(at: Column, digits: int) -> Column:
        return F.conv(F.substring(text, at, F.lit(digits)), 16, 10).cast("int")

    def step(state: Column, _: Column) -> Column:
        at = state["at"]
        # A record has its kind, two bytes of version and two of length before its data.
        whole = at + 10 <= F.length(text)
        hello = whole & (F.substring(text, at, F.lit(4)) == "1603") & (F.substring(text, at + 10, F.lit(2)) == "01")
        onward = F.when(whole & ~hello, at + 10 + 2 * number(at + 6, 4)).otherwise(F.length(text) + 1)
        return F.struct(onward.cast("int").alias("at"), (state["found"] | hello).alias("found"))

    places = F.sequence(F.lit(1), F.greatest(F.expr("1"), (F.length(payload) / 5).cast("int")))
    start = F.struct(F.lit(1).alias("at"), F.lit(False).alias("found"))
    walked = F.aggregate(places, start, step, lambda state: state["found"])
    return F.coalesce(F.when(F.substring(text, 1, 4) == "1603", walked), F.lit(False))


def tuple_recount(packets: DataFrame) -> DataFrame:
    """Counters of every conversation straight from its packets.

    Directions are those of the ordered endpoint pair: ``lo`` sends to ``hi``. Packets with payloads give
    ``hello_records`` as well: packets in which a ClientHello begins.
    """
    keyed = tuples.with_tuple(tuples.parsed_packets(packets))
    cap = F.col("caplen").cast("long")
    hellos = {}
    if "payload" in packets.columns:
        begins = tuples.is_tcp() & begins_hello(F.col("payload"))
        hellos = {"hello_records_lo": _count(begins & F.col("src_is_lo")), "hello_records_hi": _count(begins & ~F.col("src_is_lo"))}
    lo, tcp = F.col("src_is_lo"), tuples.is_tcp()
    syn, ack = F.col("syn"), F.col("ack")
    wire = F.col("wirelen").cast("long")
    return (
        keyed.groupBy(*TUPLE_KEY)
        .agg(
            F.count(F.lit(1)).alias("packets_total"),
            _count(lo).alias("packets_lo"),
            _count(~lo).alias("packets_hi"),
            F.sum(wire).alias("bytes_wire_total"),
            F.sum(F.when(lo, wire).otherwise(0)).alias("bytes_wire_lo"),
            F.sum(F.when(~lo, wire).otherwise(0)).alias("bytes_wire_hi"),
            F.sum(cap).alias("bytes_cap_total"),
            F.sum(F.when(lo, cap).otherwise(0)).alias("bytes_cap_lo"),
            F.sum(F.when(~lo, cap).otherwise(0)).alias("bytes_cap_hi"),
            F.min_by("ts_ns", "pkt_no").alias("first_ts_ns"),
            F.max_by("ts_ns", "pkt_no").alias("last_ts_ns"),
            _count(tcp & syn).alias("tcp_syn_total"),
            _count(tcp & lo & syn & ~ack).alias("tcp_syn_lo"),
            _count(tcp & ~lo & syn & ~ack).alias("tcp_syn_hi"),
            _count(tcp & lo & syn & ack).alias("tcp_synack_lo"),
            _count(tcp & ~lo & syn & ack).alias("tcp_synack_hi"),
            _count(tcp & ack).alias("tcp_ack_total"),
            _count(tcp & F.col("fin")).alias("tcp_fin_total"),
            _count(tcp & F.col("rst")).alias("tcp_rst_total"),
            _count(tcp & F.col("psh")).alias("tcp_psh_total"),
            *[column.alias(name) for name, column in hellos.items()],
        )
        .withColumn("duration_ms", (F.col("last_ts_ns") - F.col("first_ts_ns")) / 1e6)
    )


RECONCILED = [
    "packets_total",
    "packets_lo",
    "packets_hi",
    "bytes_wire_total",
    "bytes_wire_lo",
    "bytes_wire_hi",
    "first_ts_ns",
    "last_ts_ns",
    "tcp_syn_total",
    "tcp_ack_total",
    "tcp_fin_total",
    "tcp_rst_total",
    "tcp_psh_total",
]


# With captured bytes, and SYN packets by sender.
RECONCILED_IN_FULL = RECONCILED + ["bytes_cap_total", "bytes_cap_lo", "bytes_cap_hi", "tcp_syn_lo", "tcp_syn_hi"]


def flows_per_tuple(flows: DataFrame) -> DataFrame:
    """Flows of a conversation summed up, with directions turned to the ordered pair."""
    client = (F.col("client_ip"), F.col("client_port"))
    server = (F.col("server_ip"), F.col("server_port"))
    side = (client[0] < server[0]) | ((client[0] == server[0]) & (client[1] <= server[1]))

    def ordered(a: Column, b: Column) -> tuple[Column, Column]:
        return F.when(F.col("side"), a).otherwise(b), F.when(F.col("side"), b).otherwise(a)

    (lo_ip, hi_ip), (lo_port, hi_port) = ordered(client[0], server[0]), ordered(client[1], server[1])
    turned = flows.withColumn("side", side).withColumns(
        {"lo_ip": lo_ip, "lo_port": lo_port, "hi_ip": hi_ip, "hi_port": hi_port}
    )
    sums = {}
    for measure in ("packets", "bytes_wire", "bytes_cap"):
        lo, hi = ordered(F.col(f"{measure}_c2s"), F.col(f"{measure}_s2c"))
        sums[f"{measure}_total"] = F.sum(f"{measure}_total")
        sums[f"{measure}_lo"], sums[f"{measure}_hi"] = F.sum(lo), F.sum(hi)
    sums["first_ts_ns"] = F.min_by("first_ts_ns", "open_pkt")
    sums["last_ts_ns"] = F.max_by("last_ts_ns", "open_pkt")
    # Whoever sends a SYN alone is the client of the flow that it opens.
    lo, hi = ordered(F.col("tcp_syn_c2s"), F.lit(0).cast("long"))
    sums["tcp_syn_lo"], sums["tcp_syn_hi"] = F.sum(lo), F.sum(hi)
    for flag in ("syn", "ack", "fin", "rst", "psh"):
        sums[f"tcp_{flag}_total"] = F.sum(f"tcp_{flag}_total")
    return turned.groupBy(*TUPLE_KEY).agg(*[c.alias(n) for n, c in sums.items()])


def reconcile(flows: DataFrame, packets: DataFrame, measures: Sequence[str] = RECONCILED) -> DataFrame:
    """Every conversation with those of the measures in which flow table and packets differ."""
    made, seen = flows_per_tuple(flows), tuple_recount(packets)
    both = made.alias("made").join(seen.alias("seen"), TUPLE_KEY, "full_outer")
    differs = [
        F.when(~F.col(f"made.{m}").eqNullSafe(F.col(f"seen.{m}")), F.lit(m)) for m in measures
    ]
    return both.select(
        *TUPLE_KEY,
        F.col("made.packets_total").alias("flow_packets"),
        F.col("seen.packets_total").alias("seen_packets"),
        F.col("made.bytes_wire_total").alias("flow_bytes"),
        F.col("seen.bytes_wire_total").alias("seen_bytes"),
        F.col("seen.duration_ms").alias("seen_duration_ms"),
        F.array_join(F.array_compact(F.array(*differs)), ";").alias("differing"),
    )
