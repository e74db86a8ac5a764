"""SQL for the registered queries, written against the same tables.

Flow labels come from a recursive walk that looks at one packet per conversation and step,
so it shares no idea with the windows of the engine.
"""

from __future__ import annotations

from flowloom import schema
from flowloom.plans.queries import DIRTY_NUMBERS, DIRTY_TEXT, ODD_NAMES

PACKETS = """
pk as (
  select '0' as capture_id, event_id as pkt_no, epoch_us(ts) as ts_ns,
    60 + size as caplen, 60 + size + (k % 4) * 100 as wirelen,
    case when k % 3 = 0 then sip else cip end as src_ip,
    case when k % 3 = 0 then cip else sip end as dst_ip,
    cast(case when k % 3 = 0 then 443 else 40000 + user_id end as integer) as src_port,
    cast(case when k % 3 = 0 then 40000 + user_id else 443 end as integer) as dst_port,
    case when event_id % 97 = 0 then 1 when user_id % 5 = 0 then 17 else 6 end as proto,
    event_type = 'signup' as syn,
    not (event_type = 'signup' and k % 2 = 0) as ack,
    (event_type = 'error' and k % 10 = 0) as fin,
    (event_type = 'error' and k % 10 = 1) as rst,
    event_type = 'click' as psh,
    case when event_type in ('click', 'purchase') then size else 0 end as payload_len
  from (
    select *, cast(props->>'$.k' as bigint) as k, cast(floor(value) as bigint) as size,
      '10.0.' || (user_id // 250) || '.' || (user_id % 250 + 1) as cip,
      '192.0.2.' || (user_id % 7 + 1) as sip
    from events))"""

KEYED = """,
sided as (
  select *, src_ip < dst_ip or (src_ip = dst_ip and src_port <= dst_port) as src_is_lo
  from pk where proto in (6, 17)),
keyed as (
  select *,
    case when src_is_lo then src_ip else dst_ip end as lo_ip,
    case when src_is_lo then src_port else dst_port end as lo_port,
    case when src_is_lo then dst_ip else src_ip end as hi_ip,
    case when src_is_lo then dst_port else src_port end as hi_port
  from sided)"""

WALK = """,
p as (
  select *, row_number() over (
    partition by capture_id, lo_ip, lo_port, hi_ip, hi_port, proto order by pkt_no) as rn
  from keyed),
walk as (
  select p.*, src_is_lo as client_is_lo, pkt_no as open_pkt, ts_ns as first_ts, true as fresh,
    case when src_is_lo then 1 else 0 end as lo_flows, case when src_is_lo then 0 else 1 end as hi_flows
  from p where rn = 1
  union all
  select n.* exclude (was_lo, was_open, was_first, was_lo_flows, was_hi_flows, hard, late),
    case when hard then src_is_lo else was_lo end,
    case when hard or late then pkt_no else was_open end,
    case when hard or late then ts_ns else was_first end,
    hard,
    was_lo_flows + case when (hard and src_is_lo) or (late and not hard and was_lo) then 1 else 0 end,
    was_hi_flows + case when (hard and not src_is_lo) or (late and not hard and not was_lo) then 1 else 0 end
  from (
    select p.*, walk.client_is_lo as was_lo, walk.open_pkt as was_open, walk.first_ts as was_first,
      walk.lo_flows as was_lo_flows, walk.hi_flows as was_hi_flows,
      p.proto = 6 and ((p.syn and not p.ack) or walk.fin or walk.rst) as hard,
      p.ts_ns - walk.first_ts > 120000000000 as late
    from walk join p on p.capture_id = walk.capture_id and p.lo_ip = walk.lo_ip and p.lo_port = walk.lo_port
      and p.hi_ip = walk.hi_ip and p.hi_port = walk.hi_port and p.proto = walk.proto and p.rn = walk.rn + 1) n),
labels as (
  select *, src_is_lo = client_is_lo as c2s,
    case when client_is_lo then lo_ip else hi_ip end as client_ip,
    case when client_is_lo then hi_ip else lo_ip end as server_ip,
    case when client_is_lo then lo_port else hi_port end as client_port,
    case when client_is_lo then hi_port else lo_port end as server_port,
    cast(case when client_is_lo then lo_flows else hi_flows end - 1 as bigint) as flow_instance
  from walk)"""

FLOWS = """,
flows as (
  select capture_id, client_ip, server_ip, client_port, server_port, proto, flow_instance, open_pkt,
    count(*) as packets_total,
    count(*) filter (c2s) as packets_c2s,
    count(*) filter (not c2s) as packets_s2c,
    cast(sum(caplen) as bigint) as bytes_cap_total,
    cast(coalesce(sum(caplen) filter (c2s), 0) as bigint) as bytes_cap_c2s,
    cast(coalesce(sum(caplen) filter (not c2s), 0) as bigint) as bytes_cap_s2c,
    cast(sum(wirelen) as bigint) as bytes_wire_total,
    cast(coalesce(sum(wirelen) filter (c2s), 0) as bigint) as bytes_wire_c2s,
    cast(coalesce(sum(wirelen) filter (not c2s), 0) as bigint) as bytes_wire_s2c,
    arg_min(ts_ns, pkt_no) as first_ts_ns,
    arg_max(ts_ns, pkt_no) as last_ts_ns,
    greatest(arg_max(ts_ns, pkt_no) - arg_min(ts_ns, pkt_no), 0) as duration_ns,
    count(*) filter (proto = 6 and syn) as tcp_syn_total,
    count(*) filter (proto = 6 and c2s and syn and not ack) as tcp_syn_c2s,
    count(*) filter (proto = 6 and not c2s and syn and ack) as tcp_synack_s2c,
    count(*) filter (proto = 6 and ack) as tcp_ack_total,
    count(*) filter (proto = 6 and fin) as tcp_fin_total,
    count(*) filter (proto = 6 and rst) as tcp_rst_total,
    count(*) filter (proto = 6 and psh) as tcp_psh_total,
    sum(wirelen) / count(*) as avg_wirelen_total
  from labels group by all),
rows_ as (
  select *, cast(0 as bigint) as tls_client_hello_c2s, '-' as ja4_legacy_version,
    cast(0 as bigint) as ja4_cipher_suites_count, cast(0 as bigint) as ja4_extensions_count,
    cast(0 as bigint) as ja4_has_sni, '-' as ja4_alpn, '-' as ja4_cipher_suites, '-' as ja4_extensions
  from flows)"""

# The fields the customer hellos were made from; NULL version where there is no hello.
HELLOS = """
made as (
  select c_custkey, c_custkey % 17 <> 0 as ok,
    list_transform(range(c_custkey % 5 + 1), lambda i: 49152 + (c_custkey * 7 + i * 13) % 256) as suites,
    list_filter([case when c_custkey % 3 = 0 then 0 end, case when c_custkey % 4 = 0 then 16 end],
      lambda e: e is not null and c_custkey % 7 <> 0) as exts,
    c_custkey % 3 = 0 and c_custkey % 7 <> 0 as sni,
    c_custkey % 4 = 0 and c_custkey % 7 <> 0 as alpn
  from customer),
hellos as (
  select c_custkey, ok,
    case when ok then '0303' end as legacy_version,
    case when ok then array_to_string(list_transform(suites, lambda x: printf('%04x', x)), ';') end as cipher_suites,
    case when ok then case when len(exts) = 0 then '-'
      else array_to_string(list_transform(exts, lambda x: printf('%04x', x)), ';') end end as extensions,
    case when ok then cast(sni as integer) end as has_sni,
    case when ok then case when alpn then 'h2;http/1.1' else '-' end end as alpn,
    len(suites) as suites_count, len(exts) as exts_count
  from made)"""

# One flow per customer: eight packets, the server answers twice with 60 bytes each.
HELLO_ROWS = """,
sized as (
  select *, 1 + 2 + 32 + 1 + 2 + 2 * suites_count + case when c_custkey % 2 = 0 then 2 else 0 end
      + case when c_custkey % 17 = 0 then 1 else 0 end + 2
      + case when c_custkey % 7 = 0 then 0 else 2
        + case when c_custkey % 3 = 0 then 9 + length('c' || c_custkey || '.example') else 0 end
        + case when c_custkey % 4 = 0 then 18 else 0 end
        + case when c_custkey % 5 = 0 then 4 else 0 end end
      + 3 + 5 + case when c_custkey % 13 = 0 then 5 else 0 end
      + case when c_custkey % 11 = 0 then 6 else 0 end - 0 as hello_bytes
  from hellos),
rows_ as (
  select '0' as capture_id, '10.1.' || (c_custkey // 10000) || '.1' as client_ip, '192.0.2.9' as server_ip,
    cast(20000 + c_custkey % 10000 as integer) as client_port, 443 as server_port, 6 as proto,
    c_custkey * 16 as open_pkt,
    cast(8 as bigint) as packets_total, cast(6 as bigint) as packets_c2s, cast(2 as bigint) as packets_s2c,
    480 + hello_bytes as bytes_cap_total, 360 + hello_bytes as bytes_cap_c2s, cast(120 as bigint) as bytes_cap_s2c,
    480 + hello_bytes as bytes_wire_total, 360 + hello_bytes as bytes_wire_c2s, cast(120 as bigint) as bytes_wire_s2c,
    cast(7 as bigint) as duration_ns,
    cast(2 as bigint) as tcp_syn_total, cast(1 as bigint) as tcp_syn_c2s, cast(1 as bigint) as tcp_synack_s2c,
    cast(7 as bigint) as tcp_ack_total, cast(1 as bigint) as tcp_fin_total, cast(0 as bigint) as tcp_rst_total,
    cast(1 as bigint) as tcp_psh_total,
    cast(ok as bigint) as tls_client_hello_c2s,
    coalesce(legacy_version, '-') as ja4_legacy_version,
    cast(case when ok then suites_count else 0 end as bigint) as ja4_cipher_suites_count,
    cast(case when ok then exts_count else 0 end as bigint) as ja4_extensions_count,
    cast(coalesce(has_sni, 0) as bigint) as ja4_has_sni,
    coalesce(alpn, '-') as ja4_alpn,
    coalesce(cipher_suites, '-') as ja4_cipher_suites,
    coalesce(extensions, '-') as ja4_extensions,
    (480 + hello_bytes) / 8 as avg_wirelen_total
  from sized)"""

FEATURES = """,
features as (
  select * replace (
      case when tls_client_hello_c2s > 0 and ja4_legacy_version <> '-' then lower(ja4_legacy_version) else 'none' end as ja4_legacy_version,
      case when tls_client_hello_c2s > 0 and ja4_alpn <> '-' then lower(ja4_alpn) else 'none' end as ja4_alpn,
      case when tls_client_hello_c2s > 0 then ja4_cipher_suites else '' end as ja4_cipher_suites,
      case when tls_client_hello_c2s > 0 then ja4_extensions else '' end as ja4_extensions,
      cast(proto as bigint) as proto, cast(client_port as bigint) as client_port, cast(server_port as bigint) as server_port),
    cast(tls_client_hello_c2s > 0 as bigint) as ja4_present,
    duration_ns / 1e6 as duration_ms,
    bytes_wire_c2s / greatest(bytes_wire_s2c, 1) as bytes_ratio_c2s_s2c,
    packets_c2s / greatest(packets_s2c, 1) as packets_ratio_c2s_s2c,
    packets_total / greatest(duration_ns / 1e9, 1e-9) as pps_total,
    bytes_wire_total / greatest(duration_ns / 1e9, 1e-9) as bps_total,
    cast(proto = 6 as bigint) as is_tcp, cast(proto = 17 as bigint) as is_udp,
    case when open_pkt % 11 in (1, 5, 6, 7, 8, 9) then cast(1 as bigint) else 0 end as label
  from rows_)"""

FLOW_NAME = "capture_id, client_ip, server_ip, client_port, server_port, proto, flow_instance, open_pkt"
TUPLE = ", ".join(schema.TUPLE_KEY)


def _from(ctes: str, select: str) -> str:
    recursive = "recursive " if "walk as" in ctes else ""
    return f"with {recursive}{ctes.strip()}\n{select.strip()}"


LABELS = PACKETS + KEYED + WALK
METERED = LABELS + FLOWS


def _names(columns: list[str]) -> str:
    return ", ".join(columns)


def _violations(table: str) -> str:
    return f"""
select count(*) filter (packets_total <> packets_c2s + packets_s2c) as bad_packets_sum,
  count(*) filter (bytes_wire_total <> bytes_wire_c2s + bytes_wire_s2c) as bad_wire_bytes_sum,
  count(*) filter (bytes_cap_total <> bytes_cap_c2s + bytes_cap_s2c) as bad_cap_bytes_sum,
  count(*) filter (duration_ns < 0) as negative_duration,
  count(*) filter (abs(avg_wirelen_total - bytes_wire_total / packets_total) > 0.001) as avg_wirelen_mismatch,
  count(*) filter (tls_client_hello_c2s = 0 and (ja4_legacy_version not in ('', '-', 'none', 'nan')
    or lower(trim(ja4_alpn)) not in ('', '-', 'none', 'nan') or ja4_cipher_suites_count > 0
    or ja4_extensions_count > 0 or ja4_has_sni > 0)) as ja4_without_client_hello
from {table}"""


DAMAGED = """,
damaged as (
  select * replace (
    packets_total + case when open_pkt % 10 = 0 then 1 else 0 end as packets_total,
    bytes_wire_s2c + case when open_pkt % 10 = 1 then 1 else 0 end as bytes_wire_s2c,
    bytes_cap_c2s + case when open_pkt % 10 = 2 then 1 else 0 end as bytes_cap_c2s,
    case when open_pkt % 10 = 3 then -1 else duration_ns end as duration_ns,
    avg_wirelen_total + case when open_pkt % 10 = 4 then 0.01 else 0 end as avg_wirelen_total,
    case when open_pkt % 10 = 5 then ' H2 ' else ja4_alpn end as ja4_alpn)
  from rows_)"""

RECOUNT = """,
recount as (
  select capture_id, lo_ip, lo_port, hi_ip, hi_port, proto,
    count(*) as packets_total, count(*) filter (src_is_lo) as packets_lo, count(*) filter (not src_is_lo) as packets_hi,
    cast(sum(wirelen) as bigint) as bytes_wire_total,
    cast(coalesce(sum(wirelen) filter (src_is_lo), 0) as bigint) as bytes_wire_lo,
    cast(coalesce(sum(wirelen) filter (not src_is_lo), 0) as bigint) as bytes_wire_hi,
    cast(sum(caplen) as bigint) as bytes_cap_total,
    cast(coalesce(sum(caplen) filter (src_is_lo), 0) as bigint) as bytes_cap_lo,
    cast(coalesce(sum(caplen) filter (not src_is_lo), 0) as bigint) as bytes_cap_hi,
    arg_min(ts_ns, pkt_no) as first_ts_ns, arg_max(ts_ns, pkt_no) as last_ts_ns,
    count(*) filter (proto = 6 and syn) as tcp_syn_total,
    count(*) filter (proto = 6 and src_is_lo and syn and not ack) as tcp_syn_lo,
    count(*) filter (proto = 6 and not src_is_lo and syn and not ack) as tcp_syn_hi,
    count(*) filter (proto = 6 and src_is_lo and syn and ack) as tcp_synack_lo,
    count(*) filter (proto = 6 and not src_is_lo and syn and ack) as tcp_synack_hi,
    count(*) filter (proto = 6 and ack) as tcp_ack_total, count(*) filter (proto = 6 and fin) as tcp_fin_total,
    count(*) filter (proto = 6 and rst) as tcp_rst_total, count(*) filter (proto = 6 and psh) as tcp_psh_total,
    (arg_max(ts_ns, pkt_no) - arg_min(ts_ns, pkt_no)) / 1e6 as duration_ms
  from keyed group by all)"""


def _sample() -> str:
    columns = _names(schema.BUILDER_COLUMNS)
    digest = ", ".join(f"cast({c} as varchar)" for c in schema.BUILDER_COLUMNS if c != "avg_wirelen_total")
    strata = {
        "tcp_plain": ("proto = 6 and tls_client_hello_c2s = 0", 4),
        "tcp_hello": ("proto = 6 and tls_client_hello_c2s = 1", 4),
        "udp": ("proto = 17", 2),
        "reset_or_fin": ("tcp_rst_total > 0 or tcp_fin_total > 0", 2),
    }
    parts = [
        f"select {columns} from (select *, row_number() over (order by digest, {columns}) as rn, "
        f"count(*) over () as n from digested where {where}) where rn <= {size} and n >= {size}"
        for where, size in strata.values()
    ]
    parts.append(f"select {columns} from (select * from digested order by packets_total desc, {columns} limit 2)")
    union = "\nunion all\n".join(parts)
    return f"""
select distinct * from (
{union})"""


DIGESTED = """,
digested as (select *, md5(concat_ws('|', '42', %s)) as digest from rows_)""" % ", ".join(
    f"cast({c} as varchar)" for c in schema.BUILDER_COLUMNS if c != "avg_wirelen_total"
)


def _dirty(values: list[str], select: str) -> str:
    listed = ", ".join("'" + v + "'" for v in values)
    n = len(values)
    return f"""
with picked as (select event_id, ([{listed}])[event_id % {n} + 1] as listed from events),
dirty as (
  select event_id, trim(case when (event_id // {n}) % 2 = 0 or event_id % 2 = 0 then listed
    else ' ' || event_id end) as raw
  from picked),
cleaned as (select event_id, raw, case when lower(raw) in ('nan', 'none', 'null') then '' else raw end as cleaned from dirty)
{select}"""


HELLO_COLUMNS = "c_custkey, legacy_version, cipher_suites, extensions, has_sni, alpn"

# Everyone's first packet has step 0, so a flow is named by its customer.
STREAMED = _from(
    HELLOS + HELLO_ROWS,
    """select client_ip, client_port, c_custkey as open_pkt, packets_total, packets_c2s, bytes_wire_c2s, tcp_fin_total,
  tls_client_hello_c2s, legacy_version, cipher_suites, extensions, has_sni, alpn
from rows_ join hellos on open_pkt = c_custkey * 16""",
)

ORACLES: dict[str, str] = {
    "packets_parsed": _from(PACKETS, "select * from pk where proto in (6, 17)"),
    "capture_summary": _from(
        METERED,
        """select capture_id, count(*) as total_packets, count(*) filter (proto in (6, 17)) as parsed_packets,
  (select count(*) from flows) as flows from pk group by capture_id""",
    ),
    "packet_labels": _from(LABELS, f"select {FLOW_NAME}, pkt_no, c2s from labels"),
    "packet_labels_chunked": _from(LABELS, f"select {FLOW_NAME}, pkt_no, c2s from labels"),
    "flows_basic": _from(
        METERED, f"select {FLOW_NAME}, {_names(schema.COUNTERS)}, first_ts_ns, last_ts_ns, duration_ns from flows"
    ),
    "flows_tcp_flags": _from(METERED, f"select {FLOW_NAME}, {_names(schema.TCP_COUNTS)} from flows"),
    "flow_instances": _from(
        METERED,
        f"""select capture_id, {_names(schema.ENDPOINT_COLUMNS)}, count(*) as flows,
  cast(count(*) - 1 as bigint) as last_instance from flows group by all""",
    ),
    "flows_full": _from(METERED, f"select capture_id, {_names(schema.FLOW_CSV_COLUMNS)} from rows_"),
    "flows_export": _from(
        METERED,
        f"""select {_names(schema.FLOW_CSV_COLUMNS[:-1])},
  printf('%.3f', avg_wirelen_total) as avg_wirelen_total from rows_""",
    ),
    "flow_csv_roundtrip": _from(
        METERED,
        "select " + ", ".join(f"cast({c} as varchar) as {c}" for c in schema.FLOW_CSV_COLUMNS if c != "avg_wirelen_total")
        + ", printf('%.3f', avg_wirelen_total) as avg_wirelen_total from rows_",
    ),
    "names_in_files": f"""
select event_id, list_extract([{", ".join("'" + n.replace("'", "''") + "'" for n in ODD_NAMES)}], cast(event_id % {len(ODD_NAMES)} + 1 as integer)) as name
from events""",
    "datasets_written": _from(
        METERED + FEATURES,
        """select dataset, label, count(*) as rows
from features, (values ('dataset_flow_only'), ('dataset_flow_plus_ja4'), ('report_view')) d(dataset) group by all""",
    ),
    "datasets_manifest": _from(
        METERED + DIGESTED,
        f"""select output, case output when 'validation_sample' then (select count(*) from ({_sample()}))
    when 'feature_schema' then 1 else (select count(*) from flows) end as rows, columns
from (values ('dataset_flow_only', 26), ('dataset_flow_plus_ja4', 33), ('report_view', 27), ('feature_schema', 1),
  ('validation_sample', {len(schema.BUILDER_COLUMNS)})) o(output, columns)""",
    ),
    "schema_document": _from(
        METERED,
        "select list, cast(place as integer) as place, name, (select count(*) from flows) as values from (values "
        + ", ".join(
            f"('{key}', {i}, '{c}')"
            for key, columns in (
                ("flow_only_features", schema.FLOW_ONLY_COLUMNS),
                ("flow_plus_ja4_features", schema.FLOW_PLUS_COLUMNS),
                ("report_fields", [*schema.REPORT_COLUMNS, "label"]),
            )
            for i, c in enumerate(columns)
        )
        + ") t(list, place, name)",
    ),
    "sample_written": _from(
        METERED + DIGESTED,
        "select * replace (" + ", ".join(f"cast({c} as bigint) as {c}" for c in schema.BUILDER_NUMBERS if c != "avg_wirelen_total") + f") from ({_sample()})",
    ),
    "column_names": _from(
        METERED,
        "select proto, " + ", ".join(f"cast(sum({c}) as bigint) as {c}" for c in schema.COUNTERS + schema.TCP_COUNTS) + " from flows group by proto",
    ),
    "packet_table": _from(
        PACKETS, "select capture_id, proto, count(*) as packets, cast(sum(wirelen) as bigint) as bytes_wire from pk group by all"
    ),
    "unusable_labels": """
select case event_id % 5 when 1 then 'odd' when 2 then '2' else 'unknown' end as value, count(*) as rows
from events where event_id % 5 in (1, 2, 4) group by all""",
    "timeout_splits": _from(
        LABELS,
        f"""select {TUPLE}, count(*) as splits, count(*) filter (not c2s) as server_splits
from labels where pkt_no = open_pkt and not fresh group by all""",
    ),
    "streamed_flows": _from(METERED, "select * from flows"),
    "resumed_flows": _from(METERED, "select * from flows"),
    "flow_invariants": _from(METERED, _violations("rows_")),
    "damaged_flow_invariants": _from(METERED + DAMAGED, _violations("damaged")),
    "violating_flows": _from(
        METERED,
        """select capture_id, open_pkt, (['bad_packets_sum;avg_wirelen_mismatch', 'bad_wire_bytes_sum',
  'bad_cap_bytes_sum', 'negative_duration', 'avg_wirelen_mismatch', 'ja4_without_client_hello'])[open_pkt % 10 + 1] as violations
from flows where open_pkt % 10 < 6""",
    ),
    "top_flows": _from(
        METERED,
        f"select {FLOW_NAME}, packets_total, bytes_wire_total from flows order by packets_total desc, capture_id, open_pkt limit 10",
    ),
    "tuple_recount": _from(PACKETS + KEYED + RECOUNT, "select * from recount"),
    "reconcile": _from(
        PACKETS + KEYED + RECOUNT,
        f"""select {TUPLE}, packets_total as flow_packets, packets_total as seen_packets,
  bytes_wire_total as flow_bytes, bytes_wire_total as seen_bytes, duration_ms as seen_duration_ms, '' as differing
from recount""",
    ),
    "reconcile_damaged": _from(
        METERED + DAMAGED + RECOUNT + """,
summed as (
  select capture_id, case when side then client_ip else server_ip end as lo_ip, case when side then client_port else server_port end as lo_port,
    case when side then server_ip else client_ip end as hi_ip, case when side then server_port else client_port end as hi_port, proto,
    cast(sum(packets_total) as bigint) as packets, cast(sum(bytes_wire_total) as bigint) as wire, cast(sum(bytes_cap_total) as bigint) as cap,
    sum(case when side then bytes_wire_c2s else bytes_wire_s2c end) as wire_lo, sum(case when side then bytes_wire_s2c else bytes_wire_c2s end) as wire_hi,
    sum(case when side then bytes_cap_c2s else bytes_cap_s2c end) as cap_lo, sum(case when side then bytes_cap_s2c else bytes_cap_c2s end) as cap_hi
  from (select *, client_ip < server_ip or (client_ip = server_ip and client_port <= server_port) as side from damaged) group by all)""",
        f"""select * from (
  select {TUPLE}, s.packets as flow_packets, r.packets_total as seen_packets, s.wire as flow_bytes, r.bytes_wire_total as seen_bytes,
    r.duration_ms as seen_duration_ms, array_to_string(list_filter([
      case when s.packets <> r.packets_total then 'packets_total' end,
      case when s.wire_lo <> r.bytes_wire_lo then 'bytes_wire_lo' end, case when s.wire_hi <> r.bytes_wire_hi then 'bytes_wire_hi' end,
      case when s.cap_lo <> r.bytes_cap_lo then 'bytes_cap_lo' end, case when s.cap_hi <> r.bytes_cap_hi then 'bytes_cap_hi' end],
      lambda x: x is not null), ';') as differing
  from summed s join recount r using ({TUPLE})) where differing <> ''""",
    ),
    "hello_recount": _from(
        HELLOS + HELLO_ROWS,
        """select client_ip as lo_ip, client_port as lo_port, cast(c_custkey % 11 <> 0 as bigint) as hello_records_lo,
  cast(0 as bigint) as hello_records_hi, tcp_syn_c2s as tcp_syn_lo, tcp_synack_s2c as tcp_synack_hi,
  bytes_cap_c2s as bytes_cap_lo, bytes_cap_s2c as bytes_cap_hi
from rows_ join hellos on open_pkt = c_custkey * 16""",
    ),
    "endpoint_packets": _from(
        PACKETS,
        """select case when src_ip = '10.0.0.2' then 'c2s' else 's2c' end as direction, count(*) as packets,
  cast(sum(wirelen) as bigint) as bytes_wire
from pk where proto = 6 and ((src_ip = '10.0.0.2' and src_port = 40001 and dst_ip = '192.0.2.2' and dst_port = 443)
  or (dst_ip = '10.0.0.2' and dst_port = 40001 and src_ip = '192.0.2.2' and src_port = 443)) group by 1""",
    ),
    "stratified_sample": _from(METERED + DIGESTED, _sample()),
    "hello_sample": _from(HELLOS + HELLO_ROWS + DIGESTED, _sample()),
    "features_flow_only": _from(METERED + FEATURES, f"select {_names(schema.FLOW_ONLY_COLUMNS)}, label from features"),
    "features_flow_plus": _from(METERED + FEATURES, f"select {_names(schema.FLOW_PLUS_COLUMNS)} from features"),
    "features_with_hellos": _from(
        HELLOS + HELLO_ROWS + FEATURES, f"select {_names(schema.FLOW_PLUS_COLUMNS)} from features"
    ),
    "report_view": _from(HELLOS + HELLO_ROWS + FEATURES, f"select {_names(schema.REPORT_COLUMNS)} from features"),
    "label_distribution": _from(METERED + FEATURES, "select label, count(*) as rows from features group by label"),
    "ja4_present": _from(
        HELLOS, "select count(*) filter (ok) as ja4_present_rows, count(*) as total_rows from hellos"
    ),
    "dataset_shapes": _from(
        METERED,
        """select dataset, (select count(*) from flows) as rows, columns
from (values ('flow_only', 25), ('flow_plus_ja4', 32), ('report_view', 26)) t(dataset, columns)""",
    ),
    "feature_nulls": _from(
        METERED + FEATURES,
        "select " + ", ".join(f"count(*) - count({c}) as {c}" for c in schema.FLOW_PLUS_COLUMNS) + " from features",
    ),
    "clean_strings": _dirty(DIRTY_TEXT, "select event_id, cleaned from cleaned"),
    "legacy_version": _dirty(
        DIRTY_TEXT,
        """select event_id, case when cleaned in ('', '-') then 'none'
  when regexp_full_match(cleaned, '[0-9]+') then repeat('0', greatest(4 - length(cleaned), 0)) || cleaned
  else lower(cleaned) end as version from cleaned""",
    ),
    "alpn_norm": _dirty(
        DIRTY_TEXT,
        "select event_id, case when cleaned in ('', '-') then 'none' else lower(cleaned) end as alpn from cleaned",
    ),
    "numeric_coerce": _dirty(
        DIRTY_NUMBERS,
        """select event_id,
  case when regexp_full_match(raw, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') then cast(raw as double) end as number,
  case raw when 'inf' then 1 when '-Infinity' then -1 end as infinity from dirty""",
    ),
    "label_normalize": """
select event_id, case when event_id % 11 in (1, 5, 6, 7, 8, 9) then cast(1 as bigint) else 0 end as label from events""",
    "client_hello_fields": _from(HELLOS, f"select {HELLO_COLUMNS} from hellos where ok"),
    "client_hello_at_start": _from(HELLOS, f"select {HELLO_COLUMNS} from hellos where ok and c_custkey % 11 <> 0"),
    "stream_reassembly": """
select c_custkey as open_pkt,
  case when c_custkey % 4 = 3 then substring(line, cast(5 + c_custkey % 5 + 1 as integer)) else line end as stream
from (select c_custkey, c_name || '|' || c_mktsegment || '|0123456789' as line from customer)""",
    "flow_hellos": _from(
        HELLOS + HELLO_ROWS,
        """select client_ip, client_port, open_pkt, packets_total, packets_c2s, tcp_fin_total, tls_client_hello_c2s,
  legacy_version, cipher_suites, extensions, has_sni, alpn
from rows_ join hellos on open_pkt = c_custkey * 16""",
    ),
    "hellos_in_rounds": _from(
        HELLOS, "select c_custkey * 16 as open_pkt, legacy_version, cipher_suites, extensions, has_sni, alpn from hellos where ok"
    ),
    "streamed_hellos": STREAMED,
    "resumed_hellos": STREAMED,
    "flows_without_tls": _from(
        HELLOS + HELLO_ROWS,
        "select open_pkt, packets_total, cast(0 as bigint) as tls_client_hello_c2s, '-' as ja4_alpn from rows_",
    ),
    "grease_filter": """
select o_orderkey, case when len(kept) = 0 then '-'
  else array_to_string(list_transform(kept, lambda x: printf('%04x', x)), ';') end as code_points
from (select o_orderkey, list_filter(list_transform(range(8), lambda i: (o_orderkey * 13 + i * 4112) % 65536),
    lambda x: not (x // 256 = x % 256 and x % 16 = 10)) as kept from orders)""",
    "frames_decoded": _from(
        PACKETS,
        """select capture_id, pkt_no, ts_ns, caplen, case when pkt_no % 9 = 0 then caplen else wirelen end as wirelen,
  case when pkt_no % 11 = 0 then six(src_ip) else src_ip end as src_ip,
  case when pkt_no % 11 = 0 then six(dst_ip) else dst_ip end as dst_ip,
  src_port, dst_port, proto, syn and proto = 6 as syn, ack and proto = 6 as ack, fin and proto = 6 as fin,
  rst and proto = 6 as rst, psh and proto = 6 as psh,
  case when proto = 6 then pkt_no * 1000 end as seq, repeat('16', cast(payload_len as integer)) as payload, payload_len
from pk where proto in (6, 17)""",
    ),
}


def _six(name: str) -> str:
    """An address below 2001:db8:: whose last four bytes are those of an IPv4 address."""
    part = [f"cast(split_part({name}, '.', {i}) as integer)" for i in range(1, 5)]
    pair = [f"printf('%x', {part[i]} * 256 + {part[i + 1]})" for i in (0, 2)]
    return f"'2001:db8::' || {pair[0]} || ':' || {pair[1]}"


ORACLES["frames_decoded"] = (
    ORACLES["frames_decoded"].replace("six(src_ip)", _six("src_ip")).replace("six(dst_ip)", _six("dst_ip"))
)
# Whatever stands around them, the packets are the same.
ORACLES["frames_encapsulated"] = ORACLES["frames_decoded"]

CAPTURED = """,
framed as (
  select *, pkt_no // 250 as file, pkt_no % 250 as nth, pkt_no = max(pkt_no) over (partition by pkt_no // 250) as is_last,
    14 + case when pkt_no % 4 = 1 then 4 else 0 end + case when pkt_no % 11 = 0 then 40 else 20 end
      + case proto when 6 then 20 + payload_len when 17 then 8 + payload_len else 8 end
      + case when pkt_no % 5 = 0 then 6 else 0 end as size
  from pk),
placed as (
  select *, (file % 4 = 1 and is_last) or (file % 4 = 3 and nth = 100) as lost,
    case when file % 4 < 2 then 24 else 60 end + coalesce(sum(case when file % 4 < 2 then 16 + size else 32 + (size + 3) // 4 * 4 end)
      over (partition by file order by pkt_no rows between unbounded preceding and 1 preceding), 0) as place
  from framed)"""
_FRAME = f"""select ts_ns, case when pkt_no % 11 = 0 then {_six('src_ip')} else src_ip end as src_ip,
  case when pkt_no % 11 = 0 then {_six('dst_ip')} else dst_ip end as dst_ip, src_port, dst_port, proto,
  syn and proto = 6 as syn, ack and proto = 6 as ack, fin and proto = 6 as fin, rst and proto = 6 as rst, psh and proto = 6 as psh,
  case when proto = 6 then pkt_no * 1000 end as seq, payload_len, repeat('16', cast(payload_len as integer)) as payload
from placed where proto in (6, 17) and not lost"""
ORACLES["capture_frames"] = ORACLES["streamed_captures"] = _from(PACKETS + CAPTURED, _FRAME)
ORACLES["capture_window"] = _from(PACKETS + CAPTURED, _FRAME + " and file in (0, 2) and ts_ns >= (select min(ts_ns) from pk) + 1000000")
ORACLES["capture_problems"] = _from(
    PACKETS + CAPTURED,
    """select 'events-' || file || '.pcap' as name, cast(place as bigint) as "offset",
  case file % 4 when 1 then 'breaks off: the record does not fit the file'
    else 'unreadable block: its interface or its size is wrong' end as error
from placed where lost""",
)
