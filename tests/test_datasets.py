"""The dataset builder on hand-written rows, files and label columns."""

import json

import pytest
from pyspark.sql import functions as F

from flowloom import schema
from flowloom.operators import checks, datasets
from flowloom.operators.hello import flow_table
from flowloom.schema import BUILDER_COLUMNS
from flowloom.sources import tables
from tests.test_sessionize import packet
from tests.test_tls import HELLO, packets

GOLDEN = {
    "client_ip": "10.0.0.1", "server_ip": "10.0.0.2", "client_port": "1", "server_port": "2", "proto": "6",
    "packets_total": "38", "packets_c2s": "18", "packets_s2c": "20",
    "bytes_cap_total": "7156", "bytes_cap_c2s": "2643", "bytes_cap_s2c": "4513",
    "bytes_wire_total": "7156", "bytes_wire_c2s": "2643", "bytes_wire_s2c": "4513",
    "duration_ns": "59019837680", "tcp_syn_total": "2", "tcp_syn_c2s": "1", "tcp_synack_s2c": "1",
    "tcp_ack_total": "37", "tcp_fin_total": "1", "tcp_rst_total": "0", "tcp_psh_total": "9",
    "tls_client_hello_c2s": "1", "ja4_legacy_version": "303", "ja4_cipher_suites_count": "2",
    "ja4_extensions_count": "3", "ja4_has_sni": "1", "ja4_alpn": "H2;http/1.1",
    "ja4_cipher_suites": "c02b;c02f", "ja4_extensions": "-", "avg_wirelen_total": "188.316",
}


def raw(spark, *changes, **columns):
    rows = [{**GOLDEN, **change} for change in changes or [{}]]
    names = list(rows[0])
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ", ".join(f"`{n}` string" for n in names))
    return df.withColumns({n: F.lit(v) for n, v in columns.items()})


def test_golden_features(spark):
    row = datasets.build_datasets(raw(spark)).flow_plus.first()
    assert row["bytes_ratio_c2s_s2c"] == 0.5856414801684023
    assert row["packets_ratio_c2s_s2c"] == 0.9
    assert row["pps_total"] == pytest.approx(0.6438513132827036, rel=1e-15)
    assert row["bps_total"] == pytest.approx(121.24736836450073, rel=1e-15)
    assert row["duration_ms"] == 59019.83768
    assert (row["ja4_legacy_version"], row["ja4_alpn"], row["is_tcp"], row["is_udp"]) == ("0303", "h2;http/1.1", 1, 0)


def test_column_lists(spark):
    built = datasets.build_datasets(raw(spark))
    assert [len(f.columns) for f in built] == [25, 32, 26]
    assert [len(f) for f in (schema.FLOW_CSV_COLUMNS, schema.BUILDER_COLUMNS, schema.BUILDER_INTEGERS)] == [33, 31, 23]
    labelled = datasets.build_datasets(raw(spark, label="1"), "label")
    assert all(f.columns[-1] == "label" for f in labelled)


def test_dirty_values(spark):
    dirty = {
        "packets_total": " 12 ", "packets_c2s": "1.7", "packets_s2c": "abc", "bytes_cap_total": "",
        "duration_ns": "0", "ja4_extensions": "NaN", "ja4_cipher_suites": "-", "client_ip": " None ",
        "ja4_legacy_version": "FEFD", "ja4_alpn": "-",
    }
    row = datasets.feature_rows(raw(spark, dirty)).first()
    assert (row["packets_total"], row["packets_c2s"], row["packets_s2c"], row["bytes_cap_total"]) == (12, 1, 0, 0)
    assert row["packets_ratio_c2s_s2c"] == 1.0
    assert row["pps_total"] == pytest.approx(12e9)
    assert (row["ja4_cipher_suites"], row["ja4_extensions"], row["client_ip"]) == ("-", "", "")
    assert (row["ja4_legacy_version"], row["ja4_alpn"]) == ("fefd", "none")


def test_leftovers_without_hello(spark):
    row = datasets.feature_rows(raw(spark, {"tls_client_hello_c2s": "0"})).first()
    assert row["ja4_present"] == 0 and row["ja4_has_sni"] == 0 and row["ja4_extensions_count"] == 0
    assert (row["ja4_legacy_version"], row["ja4_alpn"], row["ja4_cipher_suites"]) == ("none", "none", "")


def test_infinite_values(spark):
    with pytest.raises(ValueError, match="avg_wirelen_total"):
        datasets.build_datasets(raw(spark, {"avg_wirelen_total": "inf"}))
    assert datasets.build_datasets(raw(spark, {"duration_ns": "inf"})).flow_only.first()["duration_ms"] == 0.0
    with pytest.raises(Exception, match="packets_total"):
        datasets.build_datasets(raw(spark, {"packets_total": "inf"})).flow_only.collect()


def test_header_names_and_missing_columns(spark):
    renamed = raw(spark).withColumnRenamed("proto", " pproto ").withColumnRenamed("client_ip", "﻿client_ip")
    assert datasets.build_datasets(renamed).flow_only.first()["proto"] == 6
    with pytest.raises(ValueError, match=r"\['ja4_alpn', 'target'\]"):
        datasets.build_datasets(raw(spark).drop("ja4_alpn"), "target")


def labels_of(spark, values, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"is_anomalous {kind}")
    out = datasets.attach_label(df, "is_anomalous")
    assert out.columns == ["label"]
    return [r[0] for r in out.collect()]


def test_label_spellings(spark):
    words = ["0", "1", " Benign", "normal", "Legitimate ", "anomalous", "anomaly", "malicious", "ATTACK", "true", "False"]
    assert labels_of(spark, words) == [0, 1, 0, 0, 0, 1, 1, 1, 1, 1, 0]
    assert labels_of(spark, ["1.7", "0.0", " 1 "]) == [1, 0, 1]
    assert labels_of(spark, ["true", "false"]) == [1, 0]
    assert labels_of(spark, [True, False], "boolean") == [1, 0]
    assert labels_of(spark, [1.0, 0.9], "double") == [1, 0]


@pytest.mark.parametrize("values", [["1.0", "benign"], ["2", "0"], ["", "1"], ["odd", "benign"], [], ["inf", "1"], [None, "1"]])
def test_label_errors(spark, values):
    with pytest.raises(ValueError, match="abel"):
        labels_of(spark, values)


def test_flow_file_round_trip(spark, tmp_path):
    rows = [(1, True, "S", 0, b""), (1, True, "A", 1, HELLO), (2, True, "A", 1, b"x")]
    flows = flow_table(packets(spark, rows))
    tables.write_flow_csv(flows, str(tmp_path / "flows"))
    text = spark.read.text(str(tmp_path / "flows")).filter("value like 'client_ip%'").first()[0]
    assert text.split(",") == schema.FLOW_CSV_COLUMNS
    back = tables.read_flow_csv(spark, str(tmp_path / "flows"))
    assert set(checks.check_flows(back).first()) == {0}
    top = checks.top_flows(back, 1).first()
    assert (top["packets_total"], top["ja4_alpn"], top["avg_wirelen_total"]) == (2, "h2;http/1.1", 60.0)
    built = datasets.build_datasets(back)
    tables.write_datasets(built, str(tmp_path / "out"))
    described = spark.read.text(str(tmp_path / "out" / "feature_schema"), wholetext=True).first()[0]
    assert json.loads(described)["label_column"] is None
    assert len(json.loads(described)["report_fields"]) == 26
    report = spark.read.option("header", True).csv(str(tmp_path / "out" / "report_view"))
    assert report.columns == schema.REPORT_COLUMNS and report.count() == 2
    tables.write_sample(back, str(tmp_path / "sample"))
    assert spark.read.option("header", True).csv(str(tmp_path / "sample")).count() == 2


def test_byte_order_mark_in_file(spark, tmp_path):
    line = ",".join(GOLDEN)
    (tmp_path / "f.csv").write_text("﻿" + line + "\n" + ",".join(GOLDEN.values()) + "\n", encoding="utf-8")
    back = tables.read_flow_csv(spark, str(tmp_path / "f.csv"))
    assert back.columns == list(GOLDEN)
    assert back.first()["ja4_legacy_version"] == "303"


def test_checks_find_damage(spark):
    bad = [{"packets_total": "39"}, {"duration_ns": "-1"}, {"tls_client_hello_c2s": "0"}, {"packets_total": "0"}]
    counts = checks.check_flows(raw(spark, {}, *bad)).first().asDict()
    assert counts == {
        "bad_packets_sum": 2, "bad_wire_bytes_sum": 0, "bad_cap_bytes_sum": 0, "negative_duration": 1,
        "avg_wirelen_mismatch": 1, "ja4_without_client_hello": 1,
    }


def test_reconcile_reports_differences(spark):
    from flowloom.operators.meter import meter_flows
    from tests.test_sessionize import frame

    seen = frame(spark, [packet(i, i, "S" if i % 3 == 0 else "A") for i in range(9)])
    flows = meter_flows(seen)
    assert [r["differing"] for r in checks.reconcile(flows, seen).collect()] == [""]
    (row,) = checks.reconcile(flows, seen.filter("pkt_no < 8")).collect()
    assert row["differing"] == "packets_total;packets_lo;bytes_wire_total;bytes_wire_lo;last_ts_ns;tcp_ack_total"
    other = frame(spark, [packet(0, 0, proto=17)])
    assert checks.reconcile(flows, other).filter("differing <> ''").count() == 2


def test_shapes_and_shares(spark):
    built = datasets.build_datasets(raw(spark, {}, {"tls_client_hello_c2s": "0"}))
    assert tuple(datasets.hello_share(built.flow_plus).first()) == (1, 2)
    assert {r[0]: (r[1], r[2]) for r in datasets.dataset_shapes(built).collect()} == {
        "flow_only": (2, 25), "flow_plus_ja4": (2, 32), "report_view": (2, 26),
    }


def test_outputs_appear_together(spark, tmp_path, monkeypatch):
    rows = raw(spark, {}, {"proto": "17"}, {"packets_total": "40", "packets_c2s": "20"})
    built, out = datasets.build_datasets(rows), str(tmp_path)
    with pytest.raises(FileNotFoundError):
        tables.published(spark, out)
    tables.publish(built, rows, out, fmt="csv")
    first = {n: d.collect() for n, d in tables.published(spark, out).items()}
    assert len(first["dataset_flow_only"]) == rows.count()
    assert json.loads(first["feature_schema"][0]["value"]) == datasets.feature_schema(False)

    def stopped(*_, **__):
        raise OSError("no more room")

    half = rows.limit(1)
    with monkeypatch.context() as patch:
        patch.setattr(tables, "write_sample", stopped)
        with pytest.raises(OSError):
            tables.publish(datasets.build_datasets(half), half, out)
    assert {n: d.collect() for n, d in tables.published(spark, out).items()} == first
    tables.publish(datasets.build_datasets(half), half, out)
    assert tables.published(spark, out)["report_view"].count() == 1


def test_sample_is_that_of_a_sort(spark):
    """Many equal digests, small batches and strata of all sizes, against sorting each stratum."""
    kinds = [{"proto": p, "tls_client_hello_c2s": h, "tcp_fin_total": f} for p in ("6", "17") for h in "01" for f in "01"]
    changes = [{**kind, "client_port": str(n % 9), "packets_total": str(n % 7), "avg_wirelen_total": f"{n}.5"} for n in range(40) for kind in kinds]
    many = checks.typed_rows(raw(spark, *changes)).select(*BUILDER_COLUMNS)
    sizes = {"tcp_plain": 5, "tcp_hello": 3, "udp": 10_000, "reset_or_fin": 1}
    got = checks.stratified_sample(many.repartition(5), sizes=sizes)
    columns = [c for c in BUILDER_COLUMNS if c != "avg_wirelen_total"]
    digest = F.md5(F.concat_ws("|", F.lit("42"), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))
    want = set()
    for name, k in sizes.items():
        own = many.filter(checks.strata()[name]).withColumn("digest", digest).orderBy("digest", *BUILDER_COLUMNS).limit(k).select(*BUILDER_COLUMNS).collect()
        want |= set(own) if len(own) == k else set()
    want |= set(many.orderBy(F.desc("packets_total"), *BUILDER_COLUMNS).limit(2).select(*BUILDER_COLUMNS).collect())
    assert set(got.collect()) == want and "Window" not in got._jdf.queryExecution().toString()
