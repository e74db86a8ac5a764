"""Captures as Spark data sources, for batch and stream, and files as a sink.

``spark.read.format("capture")`` gives frames (FRAME_SCHEMA) of a folder's captures or, with the option
``report = problems``, the places that yield none. A file is read by one task, unless ``located`` names
a table of ``capture_frames``, which cuts large files in ranges; a task reads a file of that table. Small files and ranges share tasks. Conditions on ``capture_id`` leave out files,
and those on ``ts_ns`` frames, before rows are made of them.

``spark.readStream.format("capture")`` follows the captures of a folder as they grow. An offset is, per file, the
byte position behind the last whole record; a record that is not whole yet waits for a later trigger. ``max_bytes`` is
about what a range of a file has.

``df.write.format("blobs")`` writes rows (name, content) as files, the reverse of Spark's ``binaryFile``: each
under a hidden name first, and under its own when all tasks are done.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    DataSourceWriter,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from flowloom.functions import capture_format as cf
from flowloom.schema import FRAME_SCHEMA
from flowloom.session import durable, scratch_folder, ship_package
from flowloom.sources.captures import OPEN_BYTES, RANGE_BYTES, Problem, _open, capture_ranges, frame_batches, frames_of, numbered_ranges, spread, task_bytes

PROBLEM_SCHEMA = "path string, offset long, error string"
MAX_BYTES = 256 << 20


def _system(path: str) -> tuple[fs.FileSystem, str]:
    uri = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path
    return fs.FileSystem.from_uri(uri)


def _files(path: str) -> list[tuple[str, int]]:
    """Files of a folder, or the file itself, as Spark names them, and their sizes; hidden ones are left out."""
    system, name = _system(path)
    about = system.get_file_info(name)
    found = [about] if about.type == fs.FileType.File else system.get_file_info(fs.FileSelector(name, allow_not_found=True))
    prefix = "file:" if system.type_name == "local" else path[: len(path) - len(name)] if path.endswith(name) else ""
    return sorted((prefix + f.path, f.size) for f in found if f.type == fs.FileType.File and f.size and not f.base_name.startswith((".", "_")))


@dataclass
class Range:
    path: str
    length: int
    begin: int | None
    stop: int
    first_no: int = 0
    context: list[dict] | None = None
    error: str | None = None

    def row(self) -> dict:
        begin = cf.open_format(_open(self.path, self.length)).first if self.begin is None else self.begin
        return {"path": self.path, "length": self.length, "begin": begin, "stop": self.stop, "first_no": self.first_no, "context": self.context}


@dataclass
class Ranges(InputPartition):
    """What a task reads: ranges, or a file of located ones."""

    listed: list[Range]
    located: str | None = None

    def each(self) -> Iterator[Range]:
        if self.located is None:
            return iter(self.listed)
        system, name = _system(self.located)
        rows = ds.dataset(name, format="parquet", filesystem=system).to_table().to_pylist()
        return (Range(r["path"], r["length"], r["begin"], r["stop"], r["first_no"], r["context"], r.get("error")) for r in rows)


def _dealt(ranges: list[Range]) -> list[Ranges]:
    """Neighbouring ranges to tasks of about the same size."""
    sizes = [r.stop - (r.begin or 0) + OPEN_BYTES for r in ranges]
    most = task_bytes(len(ranges), sum(sizes) - len(ranges) * OPEN_BYTES)
    found, held = [], 0
    for r, size in zip(ranges, sizes):
        if not found or held + size > most:
            found.append(Ranges([]))
            held = 0
        found[-1].listed.append(r)
        held += size
    return found


@dataclass
class Span:
    """Timestamps that conditions leave."""

    low: int = -(1 << 63)
    high: int = (1 << 63) - 1

    def has(self, ts_ns: int) -> bool:
        return self.low <= ts_ns <= self.high


class CaptureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self):
        return PROBLEM_SCHEMA if self.options.get("report") == "problems" else FRAME_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return CaptureReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return CaptureStreamReader(self.options["path"], int(self.options.get("max_bytes", MAX_BYTES)))


class CaptureReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options, self.span, self.only = options, Span(), None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        problems = self.options.get("report") == "problems"
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if not problems and column == "capture_id" and isinstance(f, (EqualTo, In)):
                own = set(f.value if isinstance(f, In) else [f.value])
                self.only = own if self.only is None else self.only & own
            elif not problems and column == "ts_ns" and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.span.low = max(self.span.low, f.value + isinstance(f, GreaterThan))
            elif not problems and column == "ts_ns" and isinstance(f, (LessThan, LessThanOrEqual)):
                self.span.high = min(self.span.high, f.value - isinstance(f, LessThan))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        if "located" in self.options:
            return [Ranges([], path) for path, _ in _files(self.options["located"])]
        found = [Range(path, size, None, size) for path, size in _files(self.options["path"])]
        return _dealt([r for r in found if self.only is None or r.path in self.only])

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        ranges = (r for r in partition.each() if self.only is None or r.path in self.only)
        if self.options.get("report") == "problems":
            for r in ranges:
                yield self._told(r.path, self._problems(r))
            return
        yield from frame_batches(frame for r in ranges for frame in self._frames(r))

    def _frames(self, r: Range) -> Iterator[tuple | Problem]:
        try:
            row = r.row()
        except (cf.Broken, OSError):
            return
        yield from frames_of(row, self.span.has)

    def _problems(self, r: Range) -> list[Problem]:
        try:
            row = r.row()
        except (cf.Broken, OSError) as problem:
            return [Problem(0, f"unreadable: {problem or 'unknown format'}")]
        # A file's own break-off is told by the range it lies in.
        return [p for p in frames_of(row, lambda _: False) if isinstance(p, Problem)]

    def _told(self, path: str, problems: list[Problem]) -> pa.RecordBatch:
        arrays = [pa.array([path] * len(problems), pa.string()), pa.array([p.offset for p in problems], pa.int64()), pa.array([p.error for p in problems], pa.string())]
        return pa.RecordBatch.from_arrays(arrays, ["path", "offset", "error"])


@dataclass
class Mark:
    """A place between records: the packets before it, and the blocks that those behind it need."""

    at: int
    number: int
    notes: list[dict]


@dataclass
class Walk:
    """How far a growing file has been walked: behind its last whole record."""

    every: int
    order: str | None = None
    marks: list[Mark] = field(default_factory=list)

    def go_on(self, path: str, length: int, stops: Sequence[int] = ()) -> None:
        """Walk whole records up to the first that is not; marks lie at ``stops``, at every so many bytes and at the end."""
        try:
            file = _open(path, length)
            form = cf.open_format(file)
        except cf.Broken:
            return
        form.order = self.order or form.order
        here = self.marks[-1] if self.marks else Mark(form.first, 0, [])
        at, number, notes = here.at, here.number, here.notes
        self.marks = self.marks or [here]
        try:
            while at < length:
                end, _ = form.record(file, at)
                note = form.note(file, at, end)
                if note is not None:
                    notes = ([] if note[:4] == cf.SECTION_MAGIC else notes) + [{"at": at, "block": note}]
                number += form.counts(file, at)
                at, self.order = end, form.order
                if at in stops or at - self.marks[-1].at >= self.every:
                    self.marks.append(Mark(at, number, notes))
        except cf.Broken:
            pass
        if at > self.marks[-1].at:
            self.marks.append(Mark(at, number, notes))


class CaptureStreamReader(DataSourceStreamReader):
    def __init__(self, path: str, max_bytes: int) -> None:
        self.path, self.max_bytes = path, max_bytes
        self.walks: dict[str, Walk] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        for path, size in _files(self.path):
            walk = self.walks.setdefault(path, Walk(self.max_bytes))
            if not walk.marks or walk.marks[-1].at < size:
                walk.go_on(path, size)
        return {path: w.marks[-1].at for path, w in self.walks.items() if w.marks}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        found = []
        for path, to in end.items():
            since = start.get(path, 0)
            if since >= to:
                continue
            walk = self.walks.get(path)
            known = {m.at for m in walk.marks} if walk else set()
            if to not in known or (since and since not in known):
                # After a restart the walk has no marks where triggers ended.
                walk = Walk(self.max_bytes)
                walk.go_on(path, to, (since,))
            marks = [m for m in walk.marks if since <= m.at <= to]
            found += [Range(path, to, a.at, b.at, a.number, a.notes) for a, b in zip(marks, marks[1:])]
        return _dealt(found)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        yield from frame_batches(frame for r in partition.each() for frame in frames_of(r.row()))


class BlobSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "blobs"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return BlobWriter(self.options["path"])


@dataclass
class Written(WriterCommitMessage):
    names: list[tuple[str, str]]


class BlobWriter(DataSourceWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator) -> Written:
        system, folder = _system(self.path)
        system.create_dir(folder, recursive=True)
        names = []
        for row in iterator:
            # Tries of one task write to names of their own.
            hidden = f".{uuid.uuid4().hex}"
            with system.open_output_stream(f"{folder}/{hidden}") as out:
                out.write(row["content"])
            names.append((hidden, row["name"]))
        return Written(names)

    def commit(self, messages) -> None:
        system, folder = _system(self.path)
        for message in messages:
            for hidden, name in message.names if message else ():
                system.move(f"{folder}/{hidden}", f"{folder}/{name}")

    def abort(self, messages) -> None:
        system, folder = _system(self.path)
        for message in messages:
            for hidden, _ in message.names if message else ():
                system.delete_file(f"{folder}/{hidden}")


def register(spark: SparkSession) -> None:
    """Make the formats known to the session; conditions are pushed down from then on."""
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (CaptureSource, BlobSink):
        spark.dataSource.register(source)


def _located(spark: SparkSession, paths: Sequence[str], range_bytes: int) -> str:
    folder = scratch_folder(spark, "capture-ranges")
    spread(durable(numbered_ranges(capture_ranges(spark, *paths, range_bytes=range_bytes)))).write.parquet(folder)
    return folder


def capture_frames(spark: SparkSession, *paths: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Frames of captures through the data source, large files in located ranges."""
    register(spark)
    return spark.read.format("capture").option("located", _located(spark, paths, range_bytes)).load()


def capture_problems(spark: SparkSession, path: str) -> DataFrame:
    """Path, offset and error of every place in the captures of a folder that yields no packet."""
    register(spark)
    return spark.read.format("capture").option("report", "problems").load(path)


def stream_captures(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Frames of a folder's captures as they grow."""
    register(spark)
    return spark.readStream.format("capture").option("max_bytes", max_bytes).load(path)
