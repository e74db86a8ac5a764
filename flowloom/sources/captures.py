"""Read capture files as a distributed job.

A capture has no index, so record boundaries inside a file are not known. Files are cut in
byte ranges all the same, and each range is located in parallel: a task guesses the first
boundary of its range, walks the record headers from there and reports where it ended. A
guess is right exactly if the range before ended there; ranges with a wrong guess are walked
again from the right place until all agree. So one huge capture is read by many tasks, and
packet numbers are the exact positions in the file.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from flowloom.functions import capture_format as cf
from flowloom.schema import FRAME_SCHEMA
from flowloom.session import durable

RANGE_BYTES = 128 << 20
BATCH_BYTES = 16 << 20
MAX_TASKS = 50_000
# Small ranges share tasks: at least this many tasks, and opening a file counts as so many bytes.
LEAST_TASKS = 256
OPEN_BYTES = 64 << 10
# Where a file that breaks off "continues": behind all of its ranges.
NOWHERE = 1 << 62
BREAKS_OFF = "breaks off: the record does not fit the file"
UNREADABLE_BLOCK = "unreadable block: its interface or its size is wrong"

RANGE_COLUMNS = ["path", "length", "range_no", "start", "stop", "begin", "order"]
LOCATED = (
    "path string, length long, range_no int, start long, stop long, begin long, order string, "
    "landing long, landing_order string, packets long, notes array<struct<at: long, block: binary>>, "
    "error string, broken_at long"
)


def _open(path: str, length: int) -> cf.Bytes:
    uri = path.replace("file:/", "file:///", 1) if path.startswith("file:/") else path
    system, name = fs.FileSystem.from_uri(uri)
    return cf.Bytes(system.open_input_file(name), length)


def _locate_one(row: dict) -> dict:
    out = {**row, "landing": NOWHERE, "landing_order": None, "packets": 0, "notes": [], "error": None, "broken_at": None}
    try:
        file = _open(row["path"], row["length"])
        form = cf.open_format(file)
    except (cf.Broken, OSError) as problem:
        return {**out, "begin": NOWHERE, "error": f"unreadable: {problem or 'unknown format'}"}
    if row["order"]:
        form.order = row["order"]
    if row["begin"] is not None:
        at = row["begin"]
    elif row["range_no"] == 0:
        at = form.first
    else:
        at = cf.guess(form, file, row["start"], row["stop"])
    out.update(begin=at, order=form.order)
    try:
        while at < row["stop"]:
            end, _ = form.record(file, at)
            note = form.note(file, at, end)
            if note is not None:
                out["notes"].append({"at": at, "block": note})
            out["packets"] += form.counts(file, at)
            at = end
    except cf.Broken:
        out.update(error=BREAKS_OFF, broken_at=at)
        at = NOWHERE
    return {**out, "landing": at, "landing_order": form.order}


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_locate_one(row) for row in batch.to_pylist()]
        if found:
            yield pa.RecordBatch.from_pylist(found, schema=_located_schema())


def _located_schema() -> pa.Schema:
    note = pa.struct([("at", pa.int64()), ("block", pa.binary())])
    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    fields = [f.split(" ")[:2] for f in LOCATED.replace("struct<at: long, block: binary>", "note").split(", ")]
    return pa.schema([(n, types.get(t, pa.list_(note))) for n, t in fields])


def task_bytes(count: int, size: int) -> int:
    """What a task reads of ``count`` ranges of ``size`` bytes in all, each with ``OPEN_BYTES`` on top."""
    return max(1, min(RANGE_BYTES, (size + count * OPEN_BYTES) // LEAST_TASKS))


def spread(ranges: DataFrame) -> DataFrame:
    """Ranges in tasks of about 128 MB, and in many tasks where they are less; the rows are tiny, but the work is not."""
    count, size = ranges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.greatest(F.col("stop") - F.coalesce(*[F.col(c) for c in ("start", "begin") if c in ranges.columns]), F.lit(0))), F.lit(0))).first()
    wanted = -(-(size + count * OPEN_BYTES) // task_bytes(count, size))
    return ranges.repartition(max(1, min(count, wanted, MAX_TASKS)), "path", "range_no")


def capture_ranges(spark: SparkSession, *paths: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Located ranges of all files, each with the boundary of its first record."""
    files = spark.read.format("binaryFile").load(list(paths)).select("path", "length")
    starts = F.sequence(F.lit(0), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(range_bytes))
    ranges = files.select("path", "length", F.posexplode(starts).alias("range_no", "start")).select(
        "path",
        "length",
        "range_no",
        F.col("start").cast("long"),
        F.least(F.col("start") + range_bytes, "length").alias("stop"),
        F.lit(None).cast("long").alias("begin"),
        F.lit(None).cast("string").alias("order"),
    )
    ranges = durable(ranges)
    located = durable(spread(ranges).mapInArrow(_locate, LOCATED))
    along = Window.partitionBy("path").orderBy("range_no")
    while True:
        expected = F.coalesce(F.lag("landing").over(along), F.col("begin"))
        order = F.coalesce(F.lag("landing_order").over(along), F.col("order"))
        checked = located.withColumns({"expected": expected, "expected_order": order})
        # A range the record before reaches across is empty and passes the boundary on.
        checked = checked.withColumn(
            "wrong", (F.col("expected") != F.col("begin")) | ~F.col("expected_order").eqNullSafe(F.col("order"))
        )
        checked = durable(checked)
        wrong = checked.filter("wrong")
        if wrong.isEmpty():
            return located
        again = wrong.withColumns({"begin": F.col("expected"), "order": F.col("expected_order")})
        again = spread(again.select(*RANGE_COLUMNS)).mapInArrow(_locate, LOCATED)
        kept = checked.filter("not wrong").select(*located.columns)
        located = durable(kept.unionByName(again))


def capture_errors(located: DataFrame) -> DataFrame:
    """Files that are no capture, and where files break off: path, offset and reason.

    The former yield no packets, the latter those before the offset.
    """
    told = F.col("error").isNotNull() & ((F.col("range_no") == 0) | F.col("broken_at").isNotNull())
    return located.filter(told).select("path", F.coalesce("broken_at", F.lit(0)).alias("offset"), "error")


class Problem(NamedTuple):
    """A place in a file that yields no packet."""

    offset: int
    error: str


def frames_of(row: dict, wanted: Callable[[int], bool] | None = None) -> Iterator[tuple | Problem]:
    """Frames (FRAME_SCHEMA) of a located range, and its problems.

    A block that is whole but cannot be read (its interface is not known, or its packet is larger than it) is a
    problem of its own; the range goes on behind it, and packet numbers count it. ``wanted`` is asked about
    timestamps; frames it turns down are left out.
    """
    file = _open(row["path"], row["length"])
    form = cf.open_format(file)
    for note in sorted(row["context"] or [], key=lambda n: n["at"]):
        form.frame(cf.Bytes(pa.BufferReader(note["block"]), len(note["block"])), 0)
    at, number = row["begin"], row["first_no"]
    while at < row["stop"]:
        try:
            end, _ = form.record(file, at)
        except cf.Broken:
            yield Problem(at, BREAKS_OFF)
            return
        try:
            frame = form.frame(file, at)
            if frame is not None and (wanted is None or wanted(frame.ts_ns)):
                yield (row["path"], number, frame.ts_ns, frame.caplen, frame.frame_len, frame.linktype, frame.data)
        except cf.Broken:
            yield Problem(at, UNREADABLE_BLOCK)
        number += form.counts(file, at)
        at = end


def frame_batches(rows: Iterator[tuple | Problem]) -> Iterator[pa.RecordBatch]:
    """Frames in batches of bounded size; problems are left out."""
    schema, held, size = to_arrow_schema(FRAME_SCHEMA), [], 0

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    for frame in rows:
        if isinstance(frame, Problem):
            continue
        held.append(frame)
        size += len(frame[-1]) + 64
        if size >= BATCH_BYTES:
            yield batch_of(held)
            held, size = [], 0
    if held:
        yield batch_of(held)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            yield from frame_batches(frames_of(row))


def numbered_ranges(located: DataFrame) -> DataFrame:
    """Ranges that hold packets, each with its first packet number and the blocks before it that its packets need.

    Interfaces belong to a section, so these are the section block before the range and what follows it.
    """
    before = Window.partitionBy("path").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    # Per range the notes from its own last section on, and whether it has one.
    cut = F.expr("filter(notes, (n, i) -> i >= coalesce(array_max(transform(notes, (m, j) -> if(substring(m.block, 1, 4) = unhex('0a0d0d0a'), j, null))), 0))")
    ranges = located.withColumns(
        {
            "first_no": F.coalesce(F.sum("packets").over(before), F.lit(0)),
            "has_section": F.exists("notes", lambda n: F.substring(n["block"], 1, 4) == F.unhex(F.lit(cf.SECTION_MAGIC.hex()))),
            "tail": cut,
        }
    )
    # The ranges since the last section before this one: the section's own range gives its tail, the others all they have.
    epoch = F.sum(F.col("has_section").cast("int")).over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranges = ranges.withColumn("epoch", epoch)
    shared = ranges.filter(F.size("tail") > 0).select("path", "epoch", F.col("range_no").alias("from_no"), F.explode("tail").alias("note"))
    held = ranges.filter(F.col("packets") > 0).drop("notes", "tail")
    # Inside a range that begins a section the packets before it belong to the epoch before.
    opened = F.col("epoch") - F.col("has_section").cast("int")
    context = (
        held.select("path", "range_no", opened.alias("epoch"))
        .join(shared, ["path", "epoch"])
        .filter(F.col("from_no") < F.col("range_no"))
        .groupBy("path", "range_no")
        .agg(F.collect_list("note").alias("context"))
    )
    return held.join(context, ["path", "range_no"], "left").select("path", "length", "range_no", "begin", "stop", "first_no", "context")


def read_captures(spark: SparkSession, *paths: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Frames (FRAME_SCHEMA) of all captures; capture_id is the file, pkt_no the position."""
    tasks = durable(numbered_ranges(capture_ranges(spark, *paths, range_bytes=range_bytes)))
    return spread(tasks).mapInArrow(_read, FRAME_SCHEMA)
