"""Cut each conversation into flow instances and label every packet with its flow.

A conversation is cut where

* a TCP packet carries SYN without ACK, or the packet before it carried FIN or RST
  (``hard`` cuts: the sender of the packet becomes the client), and
* the active timeout runs out (the client stays the client).

Timeout cuts are greedy: each one depends on the one before. Three facts keep the work in
plain windows over one sort of the data:

* a packet that is more than the timeout younger than *everything* before it in its segment
  is a cut whatever happened before, so it starts an independent ``piece``;
* a packet before the first overdue one of its piece belongs to the piece's first flow;
* only the packets after that (the ``tail``) need the greedy walk, and a tail is short-lived:
  it ends at the next hard or certain cut.

Conversations with more rows than one task should hold go to :mod:`flowloom.operators.hot`.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.operators import hot as hot_path
from flowloom.operators import tuples
from flowloom.schema import ACTIVE_TIMEOUT_NS, TUPLE_KEY

# Rows of one conversation a single task may sort and hold.
HOT_ROWS = 1_000_000
# Hot conversations are listed in a broadcast up to this many (about 100 bytes each).
BROADCAST_TUPLES = 200_000
SALTS = 256
SALT = "salt"
# What deciding on flows needs of a packet.
LABEL_COLUMNS = (
    ["capture_id", "pkt_no", "ts_ns", "src_ip", "dst_ip", "src_port", "dst_port", "proto"]
    + ["syn", "ack", "fin", "rst"]
)


def mark_pieces(packets: DataFrame, timeout_ns: int) -> DataFrame:
    """Window pass over tuple-keyed packets: client side, piece start and tail flag.

    A segment is named by how many packets closed a flow before it and by its last SYN. Both
    only grow along a conversation, so the maximum of (segment, timestamp) over the packets
    before gives the segment of the packet before and the youngest timestamp in it. Inside a
    piece that timestamp is the piece's own, since a piece starts with a new maximum.
    """
    order = Window.partitionBy(*TUPLE_KEY).orderBy("pkt_no")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    pkt, ts, peak = F.col("pkt_no"), F.col("ts_ns"), F.col("peak")
    hard, starts = F.col("fresh"), F.col("starts")
    same = (peak["closed"] == F.col("closed")) & (peak["syn_pkt"] == F.col("syn_pkt"))
    return (
        packets.withColumns(
            {
                "closed": F.coalesce(F.sum(tuples.closes().cast("int")).over(before), F.lit(0)),
                "syn_pkt": F.coalesce(F.max(F.when(tuples.opens_by_syn(), pkt)).over(upto), F.lit(-1)),
            }
        )
        .withColumn("peak", F.max(F.struct("closed", "syn_pkt", "ts_ns")).over(before))
        .withColumn("fresh", ~F.coalesce(same, F.lit(False)))
        .withColumn("starts", hard | ((ts - peak["ts_ns"]) > timeout_ns))
        .withColumns(
            {
                "client_is_lo": F.last(F.when(hard, F.col("src_is_lo")), ignorenulls=True).over(upto),
                "piece": F.max(F.when(starts, pkt)).over(upto),
                "piece_ts": F.last(F.when(starts, ts), ignorenulls=True).over(upto),
            }
        )
        .withColumn(
            "tail", ~starts & (F.greatest(ts, peak["ts_ns"]) - F.col("piece_ts") > timeout_ns)
        )
        .drop("closed", "syn_pkt", "peak", "starts", "piece_ts")
    )


def greedy_cuts(rows: Column, timeout_ns: int) -> Column:
    """Positions (from 1) in a pkt_no-ordered array at which a flow begins; the first does."""

    def step(acc: Column, row: Column) -> Column:
        here = acc["at"] + 1
        late = (row["ts_ns"] - acc["first_ts"]) > timeout_ns
        return F.struct(
            F.when(late, row["ts_ns"]).otherwise(acc["first_ts"]).alias("first_ts"),
            here.alias("at"),
            F.when(late, F.concat(acc["cuts"], F.array(here))).otherwise(acc["cuts"]).alias("cuts"),
        )

    start = F.struct(
        F.element_at(rows, 1)["ts_ns"].alias("first_ts"),
        F.lit(0).alias("at"),
        F.array(F.lit(1)).alias("cuts"),
    )
    return F.aggregate(rows, start, step, lambda acc: acc["cuts"])


def split_tails(tails: DataFrame, timeout_ns: int) -> DataFrame:
    """Walk each tail and give its packets the flow they belong to."""
    group = TUPLE_KEY + ["client_is_lo", "piece"]
    # Nothing but timeouts cuts inside a tail.
    carried = [c for c in tails.columns if c not in group + ["pkt_no", "tail", "fresh"]]
    cuts, rows = F.col("cuts"), F.col("rows")
    stops = F.slice(F.concat(cuts, F.array(F.size(rows) + 1)), 2, F.size(cuts))
    return (
        tails.groupBy(*group)
        .agg(F.array_sort(F.collect_list(F.struct("pkt_no", *carried))).alias("rows"))
        .withColumn("cuts", greedy_cuts(rows, timeout_ns))
        .select(*group, "rows", F.explode(F.arrays_zip(cuts.alias("a"), stops.alias("b"))).alias("run"))
        .select(*group, F.expr("slice(rows, run.a, run.b - run.a)").alias("rows"))
        .select(*group, F.element_at(rows, 1)["pkt_no"].alias("open_pkt"), F.inline(rows))
        .withColumn("fresh", F.lit(False))
        .drop("piece")
    )


def _cold_flows(packets: DataFrame, timeout_ns: int, tails: bool = True) -> DataFrame:
    marked = mark_pieces(packets, timeout_ns)
    heads = marked.filter(~F.col("tail")).withColumnRenamed("piece", "open_pkt").drop("tail")
    if not tails:
        return heads
    tails = split_tails(marked.filter(F.col("tail")), timeout_ns)
    return heads.unionByName(tails)


def number_packets(labelled: DataFrame) -> DataFrame:
    """Count flow openings of each direction along the conversation (bounded conversations)."""
    upto = (
        Window.partitionBy(*TUPLE_KEY)
        .orderBy("pkt_no")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    opened = F.col("pkt_no") == F.col("open_pkt")
    side = F.col("client_is_lo")
    lo = F.sum((opened & side).cast("long")).over(upto)
    hi = F.sum((opened & ~side).cast("long")).over(upto)
    return labelled.withColumn("flow_instance", F.when(side, lo).otherwise(hi) - 1)


@dataclass(frozen=True)
class Hot:
    """Conversations with more rows than a task should hold, and the labels of their packets.

    ``tails`` is false if no conversation lasts longer than the timeout, so that none has a tail.
    ``salts`` is over 1 if ``tuples`` has a row of each conversation and salt.
    """

    tuples: DataFrame | None
    salts: int
    labels: DataFrame | None
    tails: bool = True


def _matched(keyed: DataFrame, tuples_: DataFrame, salts: int, how: str) -> DataFrame:
    if salts == 1:
        return keyed.join(tuples_, TUPLE_KEY, how)
    return keyed.withColumn(SALT, F.pmod("pkt_no", F.lit(salts))).join(tuples_, [*TUPLE_KEY, SALT], how).drop(SALT)


def find_hot(packets: DataFrame, timeout_ns: int, hot_rows: int | None) -> Hot | None:
    """Look for conversations with more than ``hot_rows`` packets and label them.

    One narrow aggregate with map-side combine decides, and tells whether any conversation lasts
    longer than the timeout; ``hot_rows=None`` skips it when the caller knows that no conversation is large.
    """
    tuples.require_order(packets)
    if hot_rows is None:
        return None
    keyed = tuples.with_tuple(tuples.parsed_packets(packets.select(*LABEL_COLUMNS)))
    span = F.coalesce(F.try_subtract(F.max("ts_ns"), F.min("ts_ns")), F.lit(2**63 - 1))
    seen = keyed.groupBy(*TUPLE_KEY).agg(F.count(F.lit(1)).alias("count"), span.alias("span"))
    most, longest = seen.agg(F.max("count"), F.max("span")).first()
    tails = longest is not None and longest > timeout_ns
    if most is None or most <= hot_rows:
        return None if tails else Hot(None, 1, None, tails)
    found = seen.filter(F.col("count") > hot_rows).select(*TUPLE_KEY).persist()
    size = found.count()
    salts = 1
    if size <= BROADCAST_TUPLES:
        found = F.broadcast(found)
    elif most > HOT_ROWS:
        # Spread each key over as many join keys as the largest conversation needs tasks.
        salts = min(SALTS, -(-most // HOT_ROWS))
        found = found.withColumn(SALT, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    labels = hot_path.label_hot(_matched(keyed, found, salts, "left_semi"), timeout_ns, hot_rows)
    return Hot(found, salts, labels, tails)


def assign_flows(packets: DataFrame, timeout_ns: int, hot: Hot | None) -> tuple[DataFrame, DataFrame | None]:
    """Packets with FLOW_KEY; the second frame holds hot conversations and has flow_instance.

    Select the columns you need beforehand: all of them take part in the shuffle.
    """
    keyed = tuples.with_tuple(tuples.parsed_packets(packets))
    if hot is None or hot.tuples is None:
        return _cold_flows(keyed, timeout_ns, hot is None or hot.tails), None
    cold = _cold_flows(_matched(keyed, hot.tuples, hot.salts, "left_anti"), timeout_ns, hot.tails)
    return cold, _matched(keyed, hot.tuples, hot.salts, "left_semi").join(hot.labels, ["capture_id", "pkt_no"])


def label_packets(
    packets: DataFrame, timeout_ns: int = ACTIVE_TIMEOUT_NS, hot_rows: int | None = HOT_ROWS, carry: Sequence[str] = ()
) -> DataFrame:
    """Every TCP and UDP packet with its flow, direction and flow instance number.

    ``fresh`` marks packets that open a flow for another reason than the timeout. Only what the labels
    need takes part in the shuffle, and the columns of ``carry``; join others, such as payloads, back by
    ``capture_id`` and ``pkt_no``.
    """
    tuples.require_order(packets)
    packets = packets.select(*LABEL_COLUMNS, *[c for c in carry if c not in LABEL_COLUMNS])
    cold, hot = assign_flows(packets, timeout_ns, find_hot(packets, timeout_ns, hot_rows))
    labelled = number_packets(cold)
    if hot is not None:
        labelled = labelled.unionByName(hot)
    return labelled.withColumns({**tuples.endpoints(), "c2s": tuples.from_client()})
