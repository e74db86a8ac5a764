"""The registered queries: each runs an operator over packets or rows from whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom import schema
from flowloom.functions import hexfmt, text, tls
from flowloom.operators import checks, datasets, export, hello
from flowloom.operators.decode import decode_frames
from flowloom.operators.meter import capture_summary as summarize
from flowloom.operators.meter import meter_flows
from flowloom.operators.sessionize import label_packets
from flowloom.operators.tuples import parsed_packets
from flowloom.plans import fixtures as fx
from flowloom.session import durable, scratch_folder
from flowloom.sources import capture_source, tables
from flowloom.streaming.meter import append_versions, handover, latest_flows, meter_stream, open_flows, stream_packets

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

FLOW_NAME = ["capture_id"] + schema.ENDPOINT_COLUMNS + ["flow_instance", "open_pkt"]


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def _flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meter_flows(fx.event_packets(spark, sf_dir))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.with_hello_columns(_flows(spark, sf_dir))


def _hello_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.with_hello_columns(hello.flow_table(fx.customer_conversations(spark, sf_dir)))


# --- Packets and flows ---------------------------------------------------------------------


@query
def packets_parsed(spark, sf_dir):
    columns = ["capture_id", "pkt_no", "ts_ns", "caplen", "wirelen", "src_ip", "dst_ip"]
    columns += ["src_port", "dst_port", "proto", "syn", "ack", "fin", "rst", "psh", "payload_len"]
    return parsed_packets(fx.event_packets(spark, sf_dir)).select(*columns)


@query
def capture_summary(spark, sf_dir):
    packets = fx.event_packets(spark, sf_dir)
    return summarize(packets, meter_flows(packets))


def _labels(spark, sf_dir, **options) -> DataFrame:
    labelled = label_packets(fx.event_packets(spark, sf_dir), **options)
    return labelled.select(*FLOW_NAME, "pkt_no", "c2s")


@query
def packet_labels(spark, sf_dir):
    return _labels(spark, sf_dir)


@query
def packet_labels_chunked(spark, sf_dir):
    """The way of conversations that exceed a task, with a limit that many of them exceed."""
    return _labels(spark, sf_dir, hot_rows=64)


@query
def flows_basic(spark, sf_dir):
    columns = schema.COUNTERS + ["first_ts_ns", "last_ts_ns", "duration_ns"]
    return _flows(spark, sf_dir).select(*FLOW_NAME, *columns)


@query
def flows_tcp_flags(spark, sf_dir):
    return _flows(spark, sf_dir).select(*FLOW_NAME, *schema.TCP_COUNTS)


@query
def flow_instances(spark, sf_dir):
    return (
        _flows(spark, sf_dir)
        .groupBy("capture_id", *schema.ENDPOINT_COLUMNS)
        .agg(F.count(F.lit(1)).alias("flows"), F.max("flow_instance").alias("last_instance"))
    )


@query
def flows_full(spark, sf_dir):
    return _rows(spark, sf_dir).select("capture_id", *schema.FLOW_CSV_COLUMNS)


@query
def flows_export(spark, sf_dir):
    return export.export_rows(_flows(spark, sf_dir))


@query
def timeout_splits(spark, sf_dir):
    """Timeout cuts of each conversation, and those whose first packet the server sent."""
    labelled = label_packets(fx.event_packets(spark, sf_dir))
    split = labelled.filter((F.col("pkt_no") == F.col("open_pkt")) & ~F.col("fresh"))
    return split.groupBy(*schema.TUPLE_KEY).agg(
        F.count(F.lit(1)).alias("splits"), F.count_if(~F.col("c2s")).alias("server_splits")
    )


@query
def streamed_flows(spark, sf_dir):
    """The flow table from micro-batches, with flows still open at the end."""
    folder = scratch_folder(spark, "streamed-flows")
    versions = meter_stream(fx.packets_of_events(fx.event_stream(spark, sf_dir)))
    append_versions(versions, f"{folder}/flows", f"{folder}/state").awaitTermination()
    return latest_flows(spark.read.parquet(f"{folder}/flows").drop("batch")).drop("final")


@query
def streamed_hellos(spark, sf_dir):
    """Flows with their hellos from eight micro-batches, each with one packet of every conversation."""
    folder, files = scratch_folder(spark, "streamed-hellos"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    turns = [fx.STEP * step for step in range(1, 9)]
    fx.write_in_turns(fx.interleaved_conversations(spark, sf_dir), f"{folder}/packets", turns, files)
    versions = meter_stream(stream_packets(spark, f"{folder}/packets", files), with_tls=True, emit_open=False)
    return _streamed_hello_rows(_metered(versions, folder, with_tls=True))


@query
def resumed_hellos(spark, sf_dir):
    """The same, the first four turns by batch and the others streamed behind them."""
    folder, files = scratch_folder(spark, "resumed-hellos"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    packets = fx.interleaved_conversations(spark, sf_dir)
    early, late = (packets.filter(c) for c in (F.col("pkt_no") < 4 * fx.STEP, F.col("pkt_no") >= 4 * fx.STEP))
    fx.write_in_turns(late, f"{folder}/packets", [fx.STEP * step for step in (6, 8)], files)
    stream = stream_packets(spark, f"{folder}/packets", files)
    return _streamed_hello_rows(_resumed(early, hello.flow_table(early), stream, folder, with_tls=True))


@query
def resumed_flows(spark, sf_dir):
    """The flow table of all events, the first half of them metered by batch and the others streamed."""
    packets = fx.event_packets(spark, sf_dir)
    half = packets.agg(F.max("pkt_no")).first()[0] // 2
    early = packets.filter(F.col("pkt_no") <= half)
    stream = fx.packets_of_events(fx.event_stream(spark, sf_dir)).filter(F.col("pkt_no") > half)
    return _resumed(early, meter_flows(early), stream, scratch_folder(spark, "resumed-flows"), with_tls=False)


def _metered(versions: DataFrame, folder: str, with_tls: bool) -> DataFrame:
    """Flows that ended in the stream, and those open in its state at the end."""
    spark = versions.sparkSession
    append_versions(versions, f"{folder}/flows", f"{folder}/state").awaitTermination()
    ended = spark.read.schema(versions.schema).parquet(f"{folder}/flows/*").drop("final")
    return ended.unionByName(open_flows(spark, f"{folder}/state", with_tls=with_tls))


def _resumed(early: DataFrame, flows: DataFrame, stream: DataFrame, folder: str, with_tls: bool) -> DataFrame:
    flows = durable(flows)
    state = durable(handover(early, flows))
    versions = meter_stream(stream, with_tls=with_tls, emit_open=False, initial=state)
    carried = state.filter("is_open = 1").select("capture_id", "open_pkt").hint("merge")
    done = flows.join(carried, ["capture_id", "open_pkt"], "left_anti")
    return done.unionByName(_metered(versions, folder, with_tls))


def _streamed_hello_rows(flows: DataFrame) -> DataFrame:
    columns = ["client_ip", "client_port", "open_pkt", "packets_total", "packets_c2s", "bytes_wire_c2s", "tcp_fin_total"]
    return flows.select(*columns, hello.hello_flag(), *_hello_text(F.col("hello")))


# --- Checks --------------------------------------------------------------------------------


@query
def flow_invariants(spark, sf_dir):
    return checks.check_flows(_rows(spark, sf_dir))


def _damaged(rows: DataFrame) -> DataFrame:
    """Break a known part of the rows, one way each."""
    at = F.col("open_pkt")

    def when(rest: int, changed: Column, name: str) -> Column:
        return F.when(at % 10 == rest, changed).otherwise(F.col(name))

    return rows.withColumns(
        {
            "packets_total": when(0, F.col("packets_total") + 1, "packets_total"),
            "bytes_wire_s2c": when(1, F.col("bytes_wire_s2c") + 1, "bytes_wire_s2c"),
            "bytes_cap_c2s": when(2, F.col("bytes_cap_c2s") + 1, "bytes_cap_c2s"),
            "duration_ns": when(3, F.lit(-1), "duration_ns"),
            "avg_wirelen_total": when(4, F.col("avg_wirelen_total") + 0.01, "avg_wirelen_total"),
            "ja4_alpn": when(5, F.lit(" H2 "), "ja4_alpn"),
        }
    )


@query
def damaged_flow_invariants(spark, sf_dir):
    return checks.check_flows(_damaged(_rows(spark, sf_dir)))


@query
def violating_flows(spark, sf_dir):
    bad = checks.violating_flows(_damaged(_rows(spark, sf_dir)))
    return bad.select("capture_id", "open_pkt", F.array_join("violations", ";").alias("violations"))


@query
def top_flows(spark, sf_dir):
    rows = _flows(spark, sf_dir)
    top = checks.top_flows(rows, 10, ["capture_id", "open_pkt"])
    return top.select(*FLOW_NAME, "packets_total", "bytes_wire_total")


@query
def tuple_recount(spark, sf_dir):
    return checks.tuple_recount(fx.event_packets(spark, sf_dir))


@query
def reconcile(spark, sf_dir):
    packets = fx.event_packets(spark, sf_dir)
    return checks.reconcile(meter_flows(packets), packets)


@query
def reconcile_damaged(spark, sf_dir):
    """Conversations in which a damaged flow table and the packets differ, and where."""
    packets = fx.event_packets(spark, sf_dir)
    damaged = _damaged(export.with_hello_columns(meter_flows(packets)))
    return checks.reconcile(damaged, packets, checks.RECONCILED_IN_FULL).filter("differing <> ''")


@query
def hello_recount(spark, sf_dir):
    """Packets in which a ClientHello begins, SYN and SYN-ACK packets and captured bytes of each conversation."""
    counted = checks.tuple_recount(fx.customer_conversations(spark, sf_dir))
    names = ["lo_ip", "lo_port", "hello_records_lo", "hello_records_hi", "tcp_syn_lo", "tcp_synack_hi", "bytes_cap_lo", "bytes_cap_hi"]
    return counted.select(*names)


@query
def endpoint_packets(spark, sf_dir):
    """Packets between one client and its server, by direction."""
    packets = fx.event_packets(spark, sf_dir)
    there, back, either = checks.endpoint_filter(("10.0.0.2", 40001), ("192.0.2.2", 443), schema.TCP)
    side = F.when(there, F.lit("c2s")).when(back, F.lit("s2c"))
    return (
        packets.filter(either)
        .groupBy(side.alias("direction"))
        .agg(F.count(F.lit(1)).alias("packets"), F.sum("wirelen").alias("bytes_wire"))
    )


@query
def stratified_sample(spark, sf_dir):
    return checks.stratified_sample(_rows(spark, sf_dir))


@query
def hello_sample(spark, sf_dir):
    return checks.stratified_sample(_hello_rows(spark, sf_dir))


# --- Dataset builder -----------------------------------------------------------------------


def _labelled(rows: DataFrame) -> DataFrame:
    """A label column in many spellings."""
    words = ["0", "1", " Benign", "NORMAL ", "legitimate", "Anomalous", "anomaly", "Malicious", "attack", "true", "FALSE"]
    picked = F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("open_pkt") % len(words) + 1).cast("int"))
    return rows.withColumn("is_anomalous", picked)


@query
def features_flow_only(spark, sf_dir):
    built = datasets.build_datasets(_labelled(_rows(spark, sf_dir)), "is_anomalous", check=False)
    return built.flow_only


@query
def features_flow_plus(spark, sf_dir):
    return datasets.build_datasets(_rows(spark, sf_dir), check=False).flow_plus


@query
def features_with_hellos(spark, sf_dir):
    return datasets.build_datasets(_hello_rows(spark, sf_dir), check=False).flow_plus


@query
def report_view(spark, sf_dir):
    return datasets.build_datasets(_hello_rows(spark, sf_dir), check=False).report


@query
def label_distribution(spark, sf_dir):
    built = datasets.build_datasets(_labelled(_rows(spark, sf_dir)), "is_anomalous", check=False)
    return datasets.label_distribution(built.flow_plus)


@query
def ja4_present(spark, sf_dir):
    return datasets.hello_share(datasets.build_datasets(_hello_rows(spark, sf_dir), check=False).flow_plus)


@query
def dataset_shapes(spark, sf_dir):
    return datasets.dataset_shapes(datasets.build_datasets(_rows(spark, sf_dir), check=False))


@query
def feature_nulls(spark, sf_dir):
    rows = datasets.feature_rows(_rows(spark, sf_dir))
    return datasets.missing_counts(rows, schema.FLOW_PLUS_COLUMNS)


@query
def flow_csv_roundtrip(spark, sf_dir):
    folder = scratch_folder(spark, "flow-csv")
    tables.write_flow_csv(_flows(spark, sf_dir), folder)
    return tables.read_flow_csv(spark, folder)


ODD_NAMES = ["h2", "a\nb", "c,d", 'say "x"', " lead and trail ", "\\n", "two\\\r\n", "'"]


@query
def names_in_files(spark, sf_dir):
    """Names with line breaks, quotes, commas and blanks, written to a text file and read again."""
    listed = F.element_at(F.array(*[F.lit(n) for n in ODD_NAMES]), (F.col("event_id") % len(ODD_NAMES) + 1).cast("int"))
    folder = scratch_folder(spark, "names")
    held = fx.table(spark, sf_dir, "events").select("event_id", hexfmt.on_one_line(listed).alias("name"))
    held.write.options(**tables.EXACT).csv(folder)
    back = spark.read.options(**tables.EXACT).options(mode="FAILFAST", columnPruning=False).csv(folder)
    return back.select(F.col("event_id").cast("long"), hexfmt.from_one_line(F.col("name")).alias("name"))


@query
def datasets_written(spark, sf_dir):
    """Rows and labels of the three datasets, built with validation, written and read again."""
    built = datasets.build_datasets(_labelled(_rows(spark, sf_dir)), "is_anomalous", hold=True)
    folder = scratch_folder(spark, "datasets")
    tables.write_datasets(built, folder, fmt="parquet")
    parts = []
    for name in tables.DATASET_NAMES:
        rows = spark.read.parquet(f"{folder}/{name}")
        parts.append(rows.groupBy("label").agg(F.count(F.lit(1)).alias("rows")).withColumn("dataset", F.lit(name)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _published(spark, sf_dir) -> dict[str, DataFrame]:
    """Two versions of the outputs, of which the first has half of the flows; the second is read."""
    rows, folder = durable(_rows(spark, sf_dir)), scratch_folder(spark, "published")
    for part in (rows.filter("open_pkt % 2 = 0"), rows):
        tables.publish(datasets.build_datasets(_labelled(part), "is_anomalous", hold=True), part, folder)
    return tables.published(spark, folder)


@query
def datasets_manifest(spark, sf_dir):
    """Rows and columns of every output of the newest version."""
    parts = []
    for name, rows in _published(spark, sf_dir).items():
        parts.append(rows.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("output"), "rows", F.lit(len(rows.columns)).alias("columns")))
    return reduce(DataFrame.unionByName, parts)


@query
def schema_document(spark, sf_dir):
    """Columns that the description names, as it is read back, and how many of each dataset's values are set."""
    outputs = _published(spark, sf_dir)
    kinds = ", ".join(f"{k}: array<string>" for k in ("flow_only_features", "flow_plus_ja4_features", "report_fields"))
    told = outputs[tables.SCHEMA_NAME].select(F.from_json("value", f"struct<{kinds}>").alias("told"))
    parts = []
    for key, name in zip(("flow_only_features", "flow_plus_ja4_features", "report_fields"), tables.DATASET_NAMES):
        rows = outputs[name]
        counted = rows.agg(*[F.count(c).alias(c) for c in rows.columns])
        long_ = counted.select(F.explode(F.create_map(*[x for c in rows.columns for x in (F.lit(c), F.col(c))])).alias("name", "values"))
        named = told.select(F.posexplode(f"told.{key}").alias("place", "name"))
        parts.append(named.join(long_, "name").select(F.lit(key).alias("list"), "place", "name", "values"))
    return reduce(DataFrame.unionByName, parts)


@query
def sample_written(spark, sf_dir):
    """The validation sample as it is read back from its file."""
    sample = _published(spark, sf_dir)[tables.SAMPLE_NAME]
    kinds = {c: "double" if c == "avg_wirelen_total" else "long" for c in schema.BUILDER_NUMBERS}
    return sample.select(*[F.col(c).cast(kinds.get(c, "string")).alias(c) for c in schema.BUILDER_COLUMNS])


@query
def column_names(spark, sf_dir):
    """Sums over flow rows whose column names came with blanks and byte-order marks."""
    rows = _rows(spark, sf_dir)
    odd = [["\ufeff" + c, f" {c} ", c + "\t", c][i % 4] for i, c in enumerate(rows.columns)]
    read = datasets.normalize_columns(rows.toDF(*odd))
    datasets.require_columns(read)
    return read.groupBy("proto").agg(*[F.sum(c).cast("long").alias(c) for c in schema.COUNTERS + schema.TCP_COUNTS])


@query
def packet_table(spark, sf_dir):
    folder = scratch_folder(spark, "packets")
    fx.event_packets(spark, sf_dir).write.parquet(folder)
    read = tables.read_packets(spark, folder)
    return read.groupBy("capture_id", "proto").agg(F.count(F.lit(1)).alias("packets"), F.sum("wirelen").cast("long").alias("bytes_wire"))


@query
def unusable_labels(spark, sf_dir):
    at = F.col("event_id") % 5
    words = F.when(at == 0, "benign").when(at == 1, "odd").when(at == 2, "2").when(at == 3, "1").otherwise("unknown")
    rows = fx.table(spark, sf_dir, "events").select(words.alias("label_text"))
    return datasets.unusable_labels(rows, "label_text")


DIRTY_TEXT = ["NaN", " None ", "null", "", "303", "0303", "FEFD", "12345", "-", " H2;HTTP/1.1 ", "none-such", "7"]
DIRTY_NUMBERS = ["abc", " 12 ", "1.7", "", "inf", "-Infinity", "1e3", "0x1A", "True", "1_0", "1d", "nan", "+5", ".5", "5.", "-0.25"]


def _dirty(spark, sf_dir, values: list[str]) -> DataFrame:
    """Event numbers with one of the given texts; every other one gets text of its own."""
    at = F.col("event_id")
    listed = F.element_at(F.array(*[F.lit(v) for v in values]), (at % len(values) + 1).cast("int"))
    own = F.when(at % 2 == 0, listed).otherwise(F.concat(F.lit(" "), at.cast("string")))
    chosen = F.when(F.expr(f"event_id div {len(values)}") % 2 == 0, listed).otherwise(own)
    return fx.table(spark, sf_dir, "events").select("event_id", chosen.alias("raw"))


@query
def clean_strings(spark, sf_dir):
    return _dirty(spark, sf_dir, DIRTY_TEXT).select("event_id", text.clean_text(F.col("raw")).alias("cleaned"))


@query
def legacy_version(spark, sf_dir):
    return _dirty(spark, sf_dir, DIRTY_TEXT).select("event_id", text.legacy_version(F.col("raw")).alias("version"))


@query
def alpn_norm(spark, sf_dir):
    return _dirty(spark, sf_dir, DIRTY_TEXT).select("event_id", text.alpn_names(F.col("raw")).alias("alpn"))


@query
def numeric_coerce(spark, sf_dir):
    number = text.to_number(F.col("raw"))
    return _dirty(spark, sf_dir, DIRTY_NUMBERS).select(
        "event_id",
        F.when(~text.is_infinite(number), number).alias("number"),
        F.when(text.is_infinite(number), F.signum(number).cast("int")).alias("infinity"),
    )


@query
def label_normalize(spark, sf_dir):
    rows = _labelled(fx.table(spark, sf_dir, "events").select("event_id", F.col("event_id").alias("open_pkt")))
    return datasets.attach_label(rows, "is_anomalous").select("event_id", "label")


# --- TLS and frames ------------------------------------------------------------------------


def _hello_text(column: Column) -> list[Column]:
    return [
        hexfmt.hex4(column["legacy_version"]).alias("legacy_version"),
        hexfmt.hex_list(column["cipher_suites"]).alias("cipher_suites"),
        hexfmt.hex_list(column["extensions"]).alias("extensions"),
        column["has_sni"].cast("int").alias("has_sni"),
        hexfmt.join_or_dash(hexfmt.bytes_as_text(column["alpn_protocols"])).alias("alpn"),
    ]


def _hello_fields(spark, sf_dir, scan: bool) -> DataFrame:
    found = fx.customer_hellos(spark, sf_dir).select(
        "c_custkey", tls.client_hello(F.col("hello"), scan).alias("found")
    )
    return found.filter(F.col("found").isNotNull()).select("c_custkey", *_hello_text(F.col("found")))


@query
def client_hello_fields(spark, sf_dir):
    return _hello_fields(spark, sf_dir, scan=True)


@query
def client_hello_at_start(spark, sf_dir):
    return _hello_fields(spark, sf_dir, scan=False)


@query
def stream_reassembly(spark, sf_dir):
    streams = hello.client_streams(fx.customer_segments(spark, sf_dir))
    return streams.select("open_pkt", F.decode("stream", "UTF-8").alias("stream"))


@query
def flow_hellos(spark, sf_dir):
    flows = hello.flow_table(fx.customer_conversations(spark, sf_dir))
    columns = ["client_ip", "client_port", "open_pkt", "packets_total", "packets_c2s", "tcp_fin_total"]
    return flows.select(*columns, hello.hello_flag(), *_hello_text(F.col("hello")))


@query
def hellos_in_rounds(spark, sf_dir):
    """The hellos once more, a few bytes of each stream a round."""
    hellos = hello.first_hellos(fx.customer_conversations(spark, sf_dir), sizes=(16, 32))
    return hellos.select("open_pkt", *_hello_text(F.col("hello")))


@query
def flows_without_tls(spark, sf_dir):
    flows = hello.flow_table(fx.customer_conversations(spark, sf_dir), with_tls=False)
    return export.with_hello_columns(flows).select("open_pkt", "packets_total", "tls_client_hello_c2s", "ja4_alpn")


@query
def grease_filter(spark, sf_dir):
    """Code points of each order that are not reserved."""
    points = F.transform(
        F.sequence(F.lit(0), F.lit(7)), lambda i: ((F.col("o_orderkey") * 13 + i * 4112) % 65536).cast("int")
    )
    return fx.table(spark, sf_dir, "orders").select(
        "o_orderkey", hexfmt.hex_list(hexfmt.without_grease(points)).alias("code_points")
    )


CAPTURED = ["ts_ns", "src_ip", "dst_ip", "src_port", "dst_port", "proto", "syn", "ack", "fin", "rst", "psh", "seq", "payload_len"]


def _captures(spark, sf_dir) -> str:
    """A folder with the capture files of the events."""
    capture_source.register(spark)
    folder = scratch_folder(spark, "captures")
    fx.event_captures(spark, sf_dir).write.format("blobs").mode("append").save(folder)
    return folder


def _captured(frames: DataFrame) -> DataFrame:
    return decode_frames(frames).select(*CAPTURED, F.hex("payload").alias("payload"))


@query
def capture_frames(spark, sf_dir):
    """Packets of capture files, cut in ranges of 4 kB, some of them damaged."""
    return _captured(capture_source.capture_frames(spark, _captures(spark, sf_dir), range_bytes=4096))


@query
def capture_problems(spark, sf_dir):
    told = capture_source.capture_problems(spark, _captures(spark, sf_dir))
    return told.select(F.substring_index("path", "/", -1).alias("name"), "offset", "error")


@query
def capture_window(spark, sf_dir):
    """Packets of two files and a stretch of time; both conditions reach the source."""
    folder = _captures(spark, sf_dir)
    frames = spark.read.format("capture").load(folder)
    names = [f"file:{folder.removeprefix('file:').replace('///', '/')}/events-{i}.pcap" for i in (0, 2)]
    first = fx.event_packets(spark, sf_dir).agg(F.min("ts_ns")).first()[0]
    return _captured(frames.filter(F.col("capture_id").isin(names) & (F.col("ts_ns") >= first + 1_000_000)))


@query
def streamed_captures(spark, sf_dir):
    """Packets of the same files, followed as a stream."""
    folder = _captures(spark, sf_dir)
    out = scratch_folder(spark, "streamed-captures")
    frames = capture_source.stream_captures(spark, folder, max_bytes=8192)
    written = _captured(frames).writeStream.format("parquet").option("checkpointLocation", f"{out}/state").option("path", f"{out}/packets")
    running = written.start()
    running.processAllAvailable()
    running.stop()
    return spark.read.schema(_captured(frames).schema).parquet(f"{out}/packets")


@query
def frames_encapsulated(spark, sf_dir):
    packets = decode_frames(fx.event_frames(spark, sf_dir, wrapped=True))
    return packets.withColumn("payload", F.hex("payload"))


@query
def frames_decoded(spark, sf_dir):
    packets = decode_frames(fx.event_frames(spark, sf_dir))
    return packets.withColumn("payload", F.hex("payload"))
