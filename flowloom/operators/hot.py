"""Flow labels for conversations too large for one task.

Every step works on groups bounded by ``rows``: a conversation is cut in chunks of arrival
order (``pkt_no div rows``; pkt_no is unique in a capture, so no chunk holds more than
``rows`` packets). What a chunk needs from the packets before it is carried over from one
summary row per chunk, by a window over those summaries.

The greedy timeout cuts of a piece are all running maxima of the timestamp ("records"), so
the walk is over increasing timestamps. A piece with many records is walked in rounds. From
a flow start ``at``, cut number n falls shortly after ``at + n * timeout``, so a thin slice of
every lap of length ``timeout`` is enough for many steps. The slice width comes from counts,
so that no task gets more than ``rows`` candidates, and a step that would leave the slice
ends the round. The first step of a round is an exact minimum over all records.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.operators import tuples
from flowloom.schema import TUPLE_KEY
from flowloom.session import durable

CHUNK_KEY = TUPLE_KEY + ["chunk"]
PIECE_KEY = TUPLE_KEY + ["piece"]
# Slice width of a piece whose remaining records all fit in one task.
NO_LIMIT = 1 << 62
CUT_SCHEMA = (
    "capture_id string, lo_ip string, lo_port int, hi_ip string, hi_port int, proto int, "
    "piece long, pkt_no long, ts_ns long"
)


def _in_chunk() -> tuple[Window, Window, Window]:
    order = Window.partitionBy(*CHUNK_KEY).orderBy("pkt_no")
    return (
        order,
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow),
        order.rowsBetween(Window.unboundedPreceding, -1),
    )


def _over_chunks() -> tuple[Window, Window, Window]:
    order = Window.partitionBy(*TUPLE_KEY).orderBy("chunk")
    return (
        order,
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow),
        order.rowsBetween(Window.unboundedPreceding, -1),
    )


def segment_carries(rows: DataFrame) -> DataFrame:
    """Per chunk: is its first packet a hard cut, and the open segment and peak before it."""
    order, upto, _ = _in_chunk()
    hard = F.coalesce(F.col("after_close") | F.col("opens"), F.lit(False))
    local = (
        rows.withColumn("after_close", F.lag("closes").over(order))
        # The first packet of a chunk is settled below, from the chunk before.
        .withColumn("hard", F.when(F.col("after_close").isNotNull(), hard).otherwise(F.lit(False)))
        .withColumn("run", F.coalesce(F.max(F.when(F.col("hard"), F.col("pkt_no"))).over(upto), F.lit(-1)))
    )
    per_chunk = local.groupBy(*CHUNK_KEY).agg(
        F.min(F.struct("pkt_no", "src_is_lo", "opens")).alias("first"),
        F.max_by("closes", "pkt_no").alias("last_closes"),
        F.max(F.when(F.col("hard"), F.struct("pkt_no", "src_is_lo"))).alias("last_hard"),
        F.max(F.struct("run", "ts_ns"))["ts_ns"].alias("last_run_peak"),
    )
    order, upto, _ = _over_chunks()
    opening = F.struct(F.col("first.pkt_no").alias("pkt_no"), F.col("first.src_is_lo").alias("src_is_lo"))
    return (
        per_chunk.withColumn(
            "first_hard", F.coalesce(F.lag("last_closes").over(order), F.lit(True)) | F.col("first.opens")
        )
        .withColumn("last_hard", F.coalesce("last_hard", F.when(F.col("first_hard"), opening)))
        .withColumn("segment", F.last("last_hard", ignorenulls=True).over(upto))
        .withColumn("peak", F.max(F.struct(F.col("segment.pkt_no"), "last_run_peak")).over(upto))
        .select(
            *CHUNK_KEY,
            "first_hard",
            F.lag("segment").over(order).alias("segment_before"),
            F.lag("peak").over(order).alias("peak_before"),
        )
    )


def mark_starts(rows: DataFrame, timeout_ns: int) -> DataFrame:
    """Client side of each packet, and whether it starts a piece or is a record of one."""
    order, upto, before = _in_chunk()
    hard, pkt, ts = F.col("hard"), F.col("pkt_no"), F.col("ts_ns")
    carried = F.when(
        F.col("peak_before").isNotNull(),
        F.struct(
            F.col("peak_before.pkt_no").alias("segment"),
            F.col("peak_before.last_run_peak").alias("ts_ns"),
        ),
    )
    peak = F.greatest(F.max(F.struct("segment", "ts_ns")).over(before), carried)
    return (
        rows.join(segment_carries(rows), CHUNK_KEY)
        .withColumn("after_close", F.lag("closes").over(order))
        .withColumn(
            "hard",
            F.when(F.col("after_close").isNull(), F.col("first_hard")).otherwise(
                F.col("after_close") | F.col("opens")
            ),
        )
        .withColumns(
            {
                "segment": F.coalesce(
                    F.max(F.when(hard, pkt)).over(upto), F.col("segment_before.pkt_no")
                ),
                "client_is_lo": F.coalesce(
                    F.last(F.when(hard, F.col("src_is_lo")), ignorenulls=True).over(upto),
                    F.col("segment_before.src_is_lo"),
                ),
            }
        )
        .withColumn("peak", peak["ts_ns"])
        .withColumn("starts", hard | ((ts - F.col("peak")) > timeout_ns))
        .withColumn("record", F.col("starts") | (ts > F.col("peak")))
        .select(*CHUNK_KEY, "pkt_no", "ts_ns", "client_is_lo", "hard", "starts", "record")
    )


def with_pieces(marked: DataFrame) -> DataFrame:
    """Records with the piece they are in."""
    _, upto, _ = _in_chunk()
    start = F.max(F.when(F.col("starts"), F.struct("pkt_no", "ts_ns")))
    last = marked.groupBy(*CHUNK_KEY).agg(start.alias("last_start"))
    carries = last.select(
        *CHUNK_KEY,
        F.last("last_start", ignorenulls=True).over(_over_chunks()[2]).alias("start_before"),
    )
    return (
        marked.filter("record")
        .join(carries, CHUNK_KEY)
        .withColumn("start", F.coalesce(start.over(upto), F.col("start_before")))
        .select(
            *CHUNK_KEY,
            F.col("start.pkt_no").alias("piece"),
            F.col("start.ts_ns").alias("piece_ts"),
            "pkt_no",
            "ts_ns",
        )
    )


def walk_slices(
    ts: np.ndarray, at: int, first: int, timeout_ns: int, width: int
) -> list[int]:
    """Indices of the cuts that follow from ``first`` within the slices ``[0, width)`` of each lap."""
    cuts: list[int] = []
    here = first
    while True:
        due = here + timeout_ns
        slice_end = at + (due - at) // timeout_ns * timeout_ns + width
        i = int(np.searchsorted(ts, due, side="right"))
        if i == len(ts) or ts[i] >= slice_end:
            return cuts
        cuts.append(i)
        here = int(ts[i])


def _codes(column: pa.Array) -> np.ndarray:
    """Numbers that tell the values of a column apart."""
    return column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)


def _begins(batch: pa.RecordBatch) -> np.ndarray:
    """Rows of a sorted batch at which another piece begins, the first row included."""
    keys = [_codes(batch.column(c)) for c in PIECE_KEY]
    changed = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.concatenate([[0], np.flatnonzero(changed) + 1])


def _walker(timeout_ns: int):
    """Walks the pieces of a partition that is sorted by PIECE_KEY and ts_ns, one after the other."""

    def walk(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        ts, at, next_ts, width = (whole.column(c).to_numpy() for c in ("ts_ns", "at", "next_ts", "width"))
        begins = _begins(whole)
        picked = []
        for begin, end in zip(begins.tolist(), [*begins[1:].tolist(), len(ts)]):
            cuts = walk_slices(ts[begin:end], int(at[begin]), int(next_ts[begin]), timeout_ns, int(width[begin]))
            picked.extend(begin + i for i in cuts)
        return whole.select(PIECE_KEY + ["pkt_no", "ts_ns"]).take(pa.array(picked, pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A piece may span batches: its rows are held, at most as many as one round gives a task.
        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            begins, keys = _begins(batch), batch.select(PIECE_KEY)
            if held and list(keys.slice(0, 1).to_pylist()[0].values()) != last:
                yield walk(held)
                held = []
            if begins[-1]:
                yield walk([*held, batch.slice(0, begins[-1])])
                held = []
            held.append(batch.slice(begins[-1]))
            last = list(keys.slice(batch.num_rows - 1).to_pylist()[0].values())
        if held:
            yield walk(held)

    return run


def _phase_bucket(phase: Column) -> Column:
    """Number of binary digits of the phase: bucket b holds phases below 2**b."""
    return F.when(phase == 0, F.lit(0)).otherwise(F.floor(F.log2(phase.cast("double"))).cast("int") + 1)


def walk_round(records: DataFrame, active: DataFrame, timeout_ns: int, rows: int) -> DataFrame:
    """Cuts that one round finds for the active pieces (PIECE_KEY, chunk, at).

    Joins go by piece and chunk: there is no key with more than ``rows`` records.
    """
    spread = PIECE_KEY + ["chunk"]
    phase = (F.col("ts_ns") - F.col("at")) % timeout_ns
    ahead = records.join(active, spread).filter(F.col("ts_ns") - F.col("at") > timeout_ns)
    counts = ahead.groupBy(*PIECE_KEY, "at", _phase_bucket(phase).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("ts_ns", "pkt_no")).alias("next")
    )
    by_bucket = Window.partitionBy(*PIECE_KEY).orderBy("bucket")
    upto = by_bucket.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    plan = (
        counts.withColumn("fits", F.sum("n").over(upto) <= rows)
        .groupBy(*PIECE_KEY, "at")
        .agg(
            F.min("next").alias("next"),
            F.bool_and("fits").alias("all_fit"),
            F.max(F.when(F.col("fits"), F.pow(F.lit(2.0), "bucket").cast("long"))).alias("width"),
        )
        .select(
            *PIECE_KEY,
            F.col("next.pkt_no").alias("next_pkt"),
            F.col("next.ts_ns").alias("next_ts"),
            F.when(F.col("all_fit"), F.lit(NO_LIMIT))
            .otherwise(F.coalesce("width", F.lit(0)))
            .alias("width"),
        )
    )
    plan = durable(plan)
    first = plan.select(*PIECE_KEY, F.col("next_pkt").alias("pkt_no"), F.col("next_ts").alias("ts_ns"))
    more = (
        records.join(active.join(plan, PIECE_KEY), spread)
        .filter((F.col("ts_ns") > F.col("next_ts")) & (phase < F.col("width")))
        .select(*PIECE_KEY, "pkt_no", "ts_ns", "at", "next_ts", "width")
        .repartition(*PIECE_KEY)
        .sortWithinPartitions(*PIECE_KEY, "ts_ns")
        .mapInArrow(_walker(timeout_ns), CUT_SCHEMA)
    )
    return durable(first.unionByName(more))


def timeout_cuts(records: DataFrame, timeout_ns: int, rows: int) -> DataFrame | None:
    """All greedy cuts (CUT_SCHEMA) of the pieces that outlast the timeout."""
    chunks = durable(
        records.groupBy(*PIECE_KEY, "chunk", "piece_ts").agg(F.max("ts_ns").alias("last_ts"))
    )
    active = chunks.groupBy(*PIECE_KEY).agg(
        F.min("piece_ts").alias("at"), F.max("last_ts").alias("last_ts")
    )
    active = active.filter(F.col("last_ts") - F.col("at") > timeout_ns).drop("last_ts")
    found: list[DataFrame] = []
    while True:
        # One row per piece and chunk that still lies ahead: the join below has no hot key.
        spread = durable(
            chunks.join(active, PIECE_KEY)
            .filter(F.col("last_ts") - F.col("at") > timeout_ns)
            .select(*PIECE_KEY, "chunk", "at")
        )
        if spread.isEmpty():
            break
        cuts = walk_round(records, spread, timeout_ns, rows)
        found.append(cuts)
        active = cuts.groupBy(*PIECE_KEY).agg(F.max("ts_ns").alias("at"))
    return reduce(DataFrame.unionByName, found) if found else None


def number_chunks(marked: DataFrame) -> DataFrame:
    """Flow start and instance number of each packet from ``opened`` flags."""
    _, upto, _ = _in_chunk()
    opened, lo = F.col("opened"), F.col("client_is_lo")
    tally = {
        "open_pkt": F.max(F.when(opened, F.col("pkt_no"))),
        "lo_opens": F.sum((opened & lo).cast("long")),
        "hi_opens": F.sum((opened & ~lo).cast("long")),
    }
    per_chunk = marked.groupBy(*CHUNK_KEY).agg(*[c.alias(n) for n, c in tally.items()])
    before = _over_chunks()[2]
    carries = per_chunk.select(
        *CHUNK_KEY,
        F.max("open_pkt").over(before).alias("open_before"),
        F.coalesce(F.sum("lo_opens").over(before), F.lit(0)).alias("lo_before"),
        F.coalesce(F.sum("hi_opens").over(before), F.lit(0)).alias("hi_before"),
    )
    numbered = marked.join(carries, CHUNK_KEY).withColumns({n: c.over(upto) for n, c in tally.items()})
    count = F.when(lo, F.col("lo_opens") + F.col("lo_before")).otherwise(
        F.col("hi_opens") + F.col("hi_before")
    )
    return numbered.select(
        "capture_id",
        "pkt_no",
        "client_is_lo",
        F.col("hard").alias("fresh"),
        F.coalesce("open_pkt", "open_before").alias("open_pkt"),
        (count - 1).alias("flow_instance"),
    )


def label_hot(packets: DataFrame, timeout_ns: int, rows: int) -> DataFrame:
    """Labels by (capture_id, pkt_no) of tuple-keyed packets of large conversations."""
    narrow = durable(
        packets.select(
            *TUPLE_KEY,
            F.expr(f"pkt_no div {rows}").alias("chunk"),
            "pkt_no",
            "ts_ns",
            "src_is_lo",
            tuples.opens_by_syn().alias("opens"),
            tuples.closes().alias("closes"),
        )
    )
    marked = durable(mark_starts(narrow, timeout_ns))
    cuts = timeout_cuts(durable(with_pieces(marked)), timeout_ns, rows)
    if cuts is None:
        opened = marked.withColumn("opened", F.col("starts"))
    else:
        at = cuts.select(*TUPLE_KEY, "pkt_no", F.lit(True).alias("cut"))
        opened = marked.join(at, TUPLE_KEY + ["pkt_no"], "left").withColumn(
            "opened", F.col("starts") | F.coalesce("cut", F.lit(False))
        )
    return durable(number_chunks(opened.drop("starts", "record", "cut")))
