"""The registered queries as SQL for an independent engine, written from the definitions.

Lambda syntax is that of the checking engine (``lambda x: ...``).
"""

from __future__ import annotations

BASE = 1_704_067_200_000_000

ORACLE: dict[str, str] = {}


def _with(ctes: list[str], body: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + body


# --- inputs -----------------------------------------------------------------------------------

_EV = """ev AS (SELECT *, event_id // 400 AS b, event_id % 400 AS p, user_id % 20 AS u,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS pk FROM events),
evk AS (SELECT *, CASE WHEN b % 5 = 3 AND p % 10 <> 0 THEN 0 ELSE b % 5 END AS kind,
  list_element(['FPU', '', 'FS', 'R', 'RA', 'SA'], CAST(p % 6 + 1 AS INT)) AS flag6 FROM ev)"""


def _traffic(jitter: bool = False) -> list[str]:
    ts = f"{BASE} + event_id * 50000" + (" + (user_id * 7919) % 40000" if jitter else "")
    return [_EV, f"""t AS (SELECT event_id, {ts} AS ts_us,
  CASE kind WHEN 0 THEN '10.0.0.' || (u + 1) WHEN 1 THEN '203.0.113.' || (b % 250) WHEN 2 THEN '203.0.114.' || (b % 250)
    WHEN 3 THEN '10.0.0.55' ELSE '10.0.3.' || (CASE WHEN flag6 LIKE 'R%' THEN 1 ELSE u END) END AS src_ip,
  CASE kind WHEN 0 THEN '10.0.0.100' WHEN 1 THEN '10.0.1.1' WHEN 2 THEN '10.0.2.' || (p % 200)
    WHEN 3 THEN '198.51.100.4' ELSE '10.0.0.' || (p % 5) END AS dst_ip,
  CASE kind WHEN 0 THEN 40000 + u WHEN 1 THEN 50000 + p WHEN 2 THEN 50000 + p WHEN 3 THEN 55000 ELSE 40000 + p END AS src_port,
  CASE kind WHEN 0 THEN 502 WHEN 1 THEN 20 + p WHEN 2 THEN 445 WHEN 3 THEN 4444
    ELSE list_element([53, 80, 443, 23, 22, 3389, 8080, 19001], CAST(p % 8 + 1 AS INT)) END AS dst_port,
  CASE WHEN kind = 4 AND p % 4 = 0 THEN 'UDP' ELSE 'TCP' END AS protocol,
  CASE kind WHEN 0 THEN 'PA' WHEN 1 THEN 'S' WHEN 2 THEN 'S' WHEN 3 THEN 'PA'
    ELSE CASE WHEN p % 4 = 0 THEN NULL ELSE flag6 END END AS tcp_flags,
  CAST(CASE kind WHEN 1 THEN 64 WHEN 2 THEN 64 WHEN 3 THEN 128 ELSE 60 + floor(value) END AS BIGINT) AS packet_len,
  CASE kind WHEN 4 THEN 32 + p % 5 ELSE 64 END AS ttl,
  event_id % 257 AS ip_id, CASE WHEN event_id % 3 > 0 THEN 2 ELSE 0 END AS ip_flags, user_id % 4 * 8 AS dscp,
  CASE WHEN kind = 0 THEN CASE WHEN p % 50 = 0 THEN '00010000000601050001ff00'
    ELSE '000100000006010300000002' END END AS payload_hex,
  'events_table' AS data_source, 'asset-' || (user_id % 10) AS asset_id, pk = 0 AS altered, pk = 1 AS spoofed
  FROM evk)"""]


T = _traffic()
J = _traffic(True)

_CONV = [f"""c AS (SELECT event_id, {BASE} + event_id * 400000 + (user_id * 7919) % 300000 AS ts_us,
  '10.9.0.' || (user_id % 120) AS a_ip, '10.9.1.' || (user_id % 3) AS b_ip, 40000 + user_id % 5 AS a_port, 443 AS b_port,
  (event_id // 3) % 2 = 1 AS reply, CASE WHEN user_id % 11 = 0 THEN 'UDP' ELSE 'TCP' END AS proto,
  CASE WHEN user_id % 11 <> 0 THEN list_element(['S','SA','A','PA','A','PA','FA','A','S','SA','A','','PA','A','PA','A','R'],
    CAST(event_id % 17 + 1 AS INT)) END AS flags, CAST(60 + floor(value) AS BIGINT) AS len,
  CASE WHEN event_id % 4 = 0 THEN event_type END AS app,
  CASE WHEN event_id % 9 = 0 THEN 'host-' || (user_id % 7) END AS sni,
  CASE WHEN event_id % 10 = 0 THEN '' WHEN event_id % 5 = 0 THEN 'q' || (event_id % 13) END AS dns FROM events)""",
         """co AS (SELECT *, CASE WHEN proto = 'TCP' AND flags <> '' THEN CASE
    WHEN flags LIKE '%S%' AND flags NOT LIKE '%A%' THEN 'SYN_SENT' WHEN flags LIKE '%S%' THEN 'SYN_RCVD'
    WHEN flags LIKE '%R%' THEN 'RESET' WHEN flags LIKE '%F%' THEN 'FIN_WAIT' WHEN flags LIKE '%A%' THEN 'ACK' END END AS op
  FROM c)""",
         """cb AS (SELECT *, ts_us // 5000000 AS pane, lag(ts_us) OVER k AS prev_us, lag(op) OVER k AS prev_op FROM co
  WINDOW k AS (PARTITION BY a_ip, a_port, b_ip, proto ORDER BY ts_us, event_id))""",
         """cs AS (SELECT *, sum(CASE WHEN prev_us IS NULL OR ts_us - prev_us > 60000000 OR coalesce(prev_op, '') = 'RESET' THEN 1 ELSE 0 END)
  OVER (PARTITION BY a_ip, a_port, b_ip, proto ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING) AS base FROM cb)""",
         """panes AS (SELECT DISTINCT a_ip, a_port, b_ip, proto, base, pane FROM cs)""",
         """nxt AS (SELECT x.a_ip, x.a_port, x.b_ip, x.proto, x.base, x.pane, min(y.pane) AS nx FROM panes x JOIN panes y
  ON x.a_ip = y.a_ip AND x.a_port = y.a_port AND x.b_ip = y.b_ip AND x.proto = y.proto AND x.base = y.base AND y.pane >= x.pane + 61
  GROUP BY ALL)""",
         """starts AS (SELECT a_ip, a_port, b_ip, proto, base, min(pane) AS pane FROM panes GROUP BY ALL
  UNION ALL SELECT s.a_ip, s.a_port, s.b_ip, s.proto, s.base, n.nx FROM starts s JOIN nxt n ON s.a_ip = n.a_ip
  AND s.a_port = n.a_port AND s.b_ip = n.b_ip AND s.proto = n.proto AND s.base = n.base AND s.pane = n.pane)""",
         """cf AS (SELECT c.*, s.pane AS fpane FROM cs c ASOF JOIN starts s ON c.a_ip = s.a_ip AND c.a_port = s.a_port
  AND c.b_ip = s.b_ip AND c.proto = s.proto AND c.base = s.base AND c.pane >= s.pane)""",
         """cg AS (SELECT *, first_value(reply) OVER f AS open_reply, row_number() OVER f AS rn, ts_us - lag(ts_us) OVER f AS gap,
  row_number() OVER (PARTITION BY a_ip, a_port, b_ip, proto, base, fpane, reply ORDER BY ts_us, event_id) AS dn,
  last_value(op IGNORE NULLS) OVER (PARTITION BY a_ip, a_port, b_ip, proto, base, fpane ORDER BY ts_us, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_op
  FROM cf WINDOW f AS (PARTITION BY a_ip, a_port, b_ip, proto, base, fpane ORDER BY ts_us, event_id))""",
         """fl AS (SELECT a_ip, a_port, b_ip, proto, base, fpane, open_reply, min(ts_us) AS start_us, max(ts_us) AS last_us,
  count(*) AS n, CAST(sum(len) AS BIGINT) AS bytes, count(*) FILTER (reply = open_reply) AS fwd_packets,
  count(*) FILTER (reply <> open_reply) AS bwd_packets,
  CAST(coalesce(sum(len) FILTER (reply = open_reply), 0) AS BIGINT) AS fwd_bytes,
  CAST(coalesce(sum(len) FILTER (reply <> open_reply), 0) AS BIGINT) AS bwd_bytes,
  count(*) FILTER (op IN ('SYN_SENT', 'SYN_RCVD')) AS syn_count, count(*) FILTER (op = 'RESET') AS rst_count,
  count(*) FILTER (op = 'FIN_WAIT') AS fin_count,
  count(*) FILTER (op = 'SYN_RCVD' OR (op = 'ACK' AND coalesce(before_op, 'SYN_RCVD') = 'SYN_RCVD')) AS ack_count,
  arg_max(op, ts_us) FILTER (op IS NOT NULL AND op <> 'ACK') AS set_op,
  max(ts_us) FILTER (op IS NOT NULL AND op <> 'ACK') AS set_at, max(ts_us) FILTER (op = 'ACK') AS ack_at,
  array_to_string(list_sort(list_distinct(flatten(list(string_split(flags, '')) FILTER (proto = 'TCP' AND flags <> '')))), '') AS flags,
  arg_max(app, ts_us) FILTER (app <> '') AS app_protocol, arg_max(sni, ts_us) FILTER (sni <> '') AS tls_sni,
  arg_max(dns, ts_us) FILTER (dns <> '') AS dns_query,
  array_to_string(list(coalesce(gap, 0) ORDER BY rn) FILTER (rn <= 5), ',') AS iats_us,
  coalesce(array_to_string(list(len ORDER BY dn) FILTER (dn <= 4 AND reply = open_reply), ','), '') AS fwd_lengths,
  coalesce(array_to_string(list(len ORDER BY dn) FILTER (dn <= 4 AND reply <> open_reply), ','), '') AS bwd_lengths
  FROM cg GROUP BY ALL)""",
         """flows AS (SELECT *, CASE WHEN open_reply THEN b_ip ELSE a_ip END AS src_ip, CASE WHEN open_reply THEN a_ip ELSE b_ip END AS dst_ip,
  CASE WHEN open_reply THEN 443 ELSE a_port END AS src_port, CASE WHEN open_reply THEN a_port ELSE 443 END AS dst_port,
  (last_us - start_us) / 1e6 AS duration,
  CASE WHEN set_op IS NULL THEN CASE WHEN ack_at IS NULL THEN 'UNKNOWN' ELSE 'ESTABLISHED' END
    WHEN set_op = 'SYN_RCVD' AND ack_at > set_at THEN 'ESTABLISHED' ELSE set_op END AS tcp_state FROM fl)"""]

_FLOW_ID = "'flow_' || (start_us // 1000) || '_' || src_port || '_' || dst_port"

# Verdict table of the literal indicators, and the addresses no feed is asked about.
_INTEL = """iv(indicator, is_malicious, reputation_score, source, attribution) AS (VALUES
  ('203.0.113.1', true, 0.85, 'TorProject-ExitDirectory', 'Active Tor Exit Node'),
  ('198.51.100.4', true, 0.72, 'AbuseIPDB', 'AbuseIPDB Score 72% (9 reports)'),
  ('10.0.0.55', true, 0.85, 'TorProject-ExitDirectory', 'Active Tor Exit Node'))"""


def _local(c: str) -> str:
    return f"({c} IN ('127.0.0.1', '0.0.0.0', '::1') OR {c} LIKE '10.%' OR {c} LIKE '192.168.%')"


# --- behaviours and signals -------------------------------------------------------------------

_BEHAVIOUR = [
    """bh AS (SELECT *, len(list_distinct(list(dst_port) OVER (PARTITION BY src_ip, dst_ip ORDER BY ts_us
    RANGE BETWEEN 2000000 PRECEDING AND CURRENT ROW))) AS port_count,
  len(list_distinct(list(dst_ip) OVER (PARTITION BY src_ip, dst_port ORDER BY ts_us
    RANGE BETWEEN 2000000 PRECEDING AND CURRENT ROW))) AS host_count,
  CAST(sum(CASE WHEN tcp_flags LIKE '%R%' THEN 1 ELSE 0 END) OVER (PARTITION BY src_ip ORDER BY ts_us
    RANGE BETWEEN 10000000 PRECEDING AND CURRENT ROW) AS BIGINT) AS rst_count,
  list(ts_us) OVER (PARTITION BY src_ip, dst_ip, dst_port ORDER BY ts_us
    RANGE BETWEEN 10000000 PRECEDING AND CURRENT ROW) AS times FROM t)""",
    """bg AS (SELECT event_id, unnest(list_transform(generate_series(2, len(times)), lambda i: times[i] - times[i - 1])) AS g
  FROM bh WHERE len(times) >= 5)""",
    """bc AS (SELECT event_id, count(*) AS intervals, avg(g) AS mean_us, stddev_pop(g) / avg(g) AS cv FROM bg GROUP BY 1
  HAVING avg(g) > 200000 AND stddev_pop(g) / avg(g) < 0.15)"""]

_RULES = """rules(rule_id, name, severity, category, mitre_technique, seq) AS (VALUES
  ('SIG-SCAN-001', 'TCP Xmas Scan Detected', 'HIGH', 'RECONNAISSANCE', 'T1046', 0),
  ('SIG-SCAN-002', 'TCP Null Scan Detected', 'MEDIUM', 'RECONNAISSANCE', 'T1046', 1),
  ('SIG-SCAN-003', 'TCP SYN-FIN Scan Probe', 'HIGH', 'RECONNAISSANCE', 'T1046', 2),
  ('SIG-DOS-001', 'TCP SYN-Flood Pattern', 'HIGH', 'DENIAL_OF_SERVICE', 'T1498', 99),
  ('SIG-OT-001', 'Unauthorized Modbus Coil Modification', 'CRITICAL', 'OT_INTEGRITY_VIOLATION', 'T0855', 3),
  ('SIG-OT-002', 'Industrial Protocol Stop Command (S7comm)', 'CRITICAL', 'OT_INTEGRITY_VIOLATION', 'T0816', 4),
  ('SIG-NET-001', 'Cleartext Telnet Administration Detected', 'MEDIUM', 'INSECURE_PROTOCOL', 'T1021', 5))"""
_HITS = """hits AS (
  SELECT event_id, 'SIG-SCAN-001' AS rule_id, 'TCP flags: ' || tcp_flags AS evidence FROM t
    WHERE protocol = 'TCP' AND tcp_flags LIKE '%F%' AND tcp_flags LIKE '%P%' AND tcp_flags LIKE '%U%'
  UNION SELECT event_id, 'SIG-SCAN-002', 'TCP packet has zero flags' FROM t
    WHERE protocol = 'TCP' AND coalesce(tcp_flags, '') = '' AND packet_len > 0
  UNION SELECT event_id, 'SIG-SCAN-003', 'Illegal TCP flag combination: ' || tcp_flags FROM t
    WHERE protocol = 'TCP' AND tcp_flags LIKE '%S%' AND tcp_flags LIKE '%F%'
  UNION SELECT event_id, 'SIG-OT-001', 'Modbus Write Function Code 0x' || upper(substr(payload_hex, 15, 2)) FROM t
    WHERE (dst_port = 502 OR src_port = 502) AND length(payload_hex) >= 16 AND upper(substr(payload_hex, 15, 2)) IN ('05', '06', '0F', '10')
  UNION SELECT event_id, 'SIG-NET-001', 'Cleartext telnet connection ' || src_ip || ' -> ' || dst_ip || ':23' FROM t
    WHERE dst_port = 23 OR src_port = 23)"""
_SIGSIG = """sigs AS (SELECT h.event_id, t.ts_us, r.category, 'Signature Detection' AS method, r.severity, t.src_ip, t.dst_ip,
  t.src_port, t.dst_port, t.protocol, 'Rule ' || h.rule_id || ' (' || r.name || '): ' || h.evidence AS evidence,
  CASE WHEN r.severity IN ('CRITICAL', 'HIGH') THEN 0.9 ELSE 0.6 END AS score, r.seq
  FROM hits h JOIN rules r USING (rule_id) JOIN t USING (event_id))"""
_INTELSIG = f"""isig AS (SELECT t.event_id, ts_us, 'KNOWN_MALICIOUS_INFRASTRUCTURE' AS category, 'Threat Intelligence' AS method,
  CASE WHEN reputation_score >= 0.8 THEN 'CRITICAL' ELSE 'HIGH' END AS severity, src_ip, dst_ip, src_port, dst_port, protocol,
  'Threat Intelligence Match via ' || source || ': ' || attribution AS evidence, reputation_score AS score, 20 AS seq
  FROM t JOIN iv ON src_ip = indicator WHERE NOT {_local('src_ip')})"""
_BSIG = """bsig AS (
  SELECT event_id, ts_us, 'PORT_SCAN' AS category, 'HIGH' AS severity, src_ip, dst_ip, NULL AS dst_port, protocol,
    'Host probed ' || port_count || ' unique destination ports on ' || dst_ip || ' within 2.0s (Threshold: 20)' AS evidence,
    0.85 AS score, 10 AS seq FROM bh WHERE port_count >= 20
  UNION ALL BY NAME SELECT event_id, ts_us, 'NETWORK_SWEEP' AS category, 'HIGH' AS severity, src_ip, 'multiple' AS dst_ip, dst_port, protocol,
    'Host swept ' || host_count || ' distinct IP addresses on port ' || dst_port || ' within 2.0s' AS evidence,
    0.80 AS score, 11 AS seq FROM bh WHERE host_count >= 15
  UNION ALL BY NAME SELECT event_id, ts_us, 'BEACONING' AS category, 'HIGH' AS severity, src_ip, dst_ip, dst_port, protocol,
    printf('Regular periodic communication detected (%d intervals, mean=%.2fs, jitter_cv=%.3f < 0.15)', intervals, mean_us / 1e6, cv) AS evidence,
    0.88 AS score, 12 AS seq FROM bh JOIN bc USING (event_id)
  UNION ALL BY NAME SELECT event_id, ts_us, 'CONNECTION_ANOMALY' AS category, 'MEDIUM' AS severity, src_ip, dst_ip, NULL AS dst_port, 'TCP' AS protocol,
    'Excessive connection resets (' || rst_count || ' TCP RST packets in < 10s)' AS evidence,
    0.65 AS score, 13 AS seq FROM bh WHERE rst_count >= 25)"""
_SIGNALS = [*T, _INTEL, *_BEHAVIOUR, _RULES, _HITS, _SIGSIG, _INTELSIG, _BSIG, """s AS (
  SELECT event_id, ts_us, category, method, severity, src_ip, dst_ip, src_port, dst_port, protocol, evidence, score, seq FROM sigs
  UNION ALL SELECT event_id, ts_us, category, method, severity, src_ip, dst_ip, src_port, dst_port, protocol, evidence, score, seq FROM isig
  UNION ALL SELECT event_id, ts_us, category, 'Behavioral Detection', severity, src_ip, dst_ip, NULL, dst_port, protocol, evidence, score, seq FROM bsig)"""]


def _sessions(src: str = "s") -> list[str]:
    return [f"""sg AS (SELECT *, lag(ts_us) OVER (PARTITION BY src_ip, dst_ip, category ORDER BY ts_us, event_id, seq) AS pv FROM {src})""",
            """si AS (SELECT *, max(CASE WHEN pv IS NULL OR ts_us - pv > 10000000 THEN ts_us END)
  OVER (PARTITION BY src_ip, dst_ip, category ORDER BY ts_us, event_id, seq ROWS UNBOUNDED PRECEDING) AS start_us FROM sg)""",
            """inc AS (SELECT 'inc_' || substr(sha256(src_ip || '|' || dst_ip || '|' || category || '|' || start_us), 1, 12) AS incident_id,
  src_ip, dst_ip, category, start_us AS first_us, max(ts_us) AS last_us, count(*) AS event_count,
  max(list_position(['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], severity)) AS rk, list_sort(list(DISTINCT method)) AS methods,
  arg_min({'severity': severity, 'method': method, 'evidence': evidence, 'protocol': protocol, 'src_port': src_port, 'dst_port': dst_port},
    {'a': ts_us, 'b': event_id, 'c': seq}) AS f FROM si GROUP BY src_ip, dst_ip, category, start_us)"""]


_INC = [*_SIGNALS, *_sessions()]
_ACTION = """CASE WHEN contains(category, 'SCAN') OR contains(category, 'SWEEP')
  THEN 'Verify authorization for scanning activity; block source IP if unapproved.'
  WHEN contains(category, 'BEACON') THEN 'Inspect endpoint processes for active C2 communication or reverse shells.'
  WHEN contains(category, 'OT') THEN 'CRITICAL: Check physical plant state immediately; verify PLC programming access.'
  WHEN contains(category, 'MALICIOUS') THEN 'Block source IP at perimeter firewall and review external connection logs.'
  ELSE 'Inspect source host and isolate network interface.' END"""
_ALERTS = [*_INC, f"""alerts AS (SELECT 'alt_' || substr(sha256('alert|' || incident_id), 1, 12) AS alert_id, incident_id, first_us AS ts_us,
  src_ip, dst_ip, f.protocol AS protocol, f.src_port AS src_port, f.dst_port AS dst_port, category AS attack_category,
  f.severity AS risk_level, CASE WHEN f.severity IN ('CRITICAL', 'HIGH') THEN 0.85 ELSE 0.6 END AS risk_score,
  0.75 AS confidence, f.method AS detection_method, {_ACTION} AS recommended_action, event_count, rk, methods FROM inc)"""]

_FINAL_CONF = "round(CASE WHEN event_count = 1 THEN 0.75 ELSE least(0.99, 0.7 + 0.08 * len(methods)) END, 6)"
_LEVEL = "list_element(['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], rk)"

# --- windows ----------------------------------------------------------------------------------


def _windows(src: list[str], partial: bool = False) -> list[str]:
    due = "" if partial else "WHERE window_end <= (SELECT max(ts_us) FROM t)"
    return [*src, """wx AS (SELECT t.*, ((ts_us - 1) // 1000000 + 1 + i) * 1000000 AS window_end FROM t, range(5) r(i))""",
            f"""w AS (SELECT *, lag(ts_us) OVER (PARTITION BY window_end ORDER BY ts_us, event_id) AS prev_us FROM wx {due})"""]


W = _windows(J)


def _entropy(col: str, name: str, where: str = "IS NOT NULL") -> str:
    return f"""{name} AS (SELECT window_end, greatest(0.0, -sum(c / tot * log2(c / tot))) AS e FROM (SELECT window_end, c,
  sum(c) OVER (PARTITION BY window_end) AS tot FROM (SELECT window_end, {col}, CAST(count(*) AS DOUBLE) AS c FROM w
  WHERE {col} {where} GROUP BY 1, 2)) GROUP BY 1)"""


_AGG = """wa AS (SELECT window_end, count(*) AS n, CAST(sum(packet_len) AS DOUBLE) AS bytes, min(ts_us) AS first_us, max(ts_us) AS last_us,
  greatest((max(ts_us) - min(ts_us)) / 1e6, 1.0) AS dur, avg(packet_len) AS lm, stddev_pop(packet_len) AS ls, avg(ttl) AS ttl_mean,
  max(ttl) - min(ttl) AS ttl_delta, count(DISTINCT ttl) AS ttl_n, count(DISTINCT {'a': src_ip, 'b': dst_ip, 'c': src_port, 'd': dst_port, 'e': protocol}) AS flow_count,
  count(DISTINCT dst_port) AS ports, count(DISTINCT dst_ip) AS dsts, count(DISTINCT src_ip) AS srcs,
  count(DISTINCT regexp_extract(dst_ip, '^(.*)\\.[^.]*$', 1)) AS subnets, avg(CASE WHEN protocol = 'UDP' THEN 1.0 ELSE 0.0 END) AS udp_ratio,
  avg(CASE WHEN altered THEN 1.0 ELSE 0.0 END) AS altered, avg(CASE WHEN spoofed THEN 1.0 ELSE 0.0 END) AS spoofed,
  bool_or(dst_port IN (502, 102, 20000, 44818, 4840)) AS has_ot,
  bool_or(dst_port IN (4444, 1337, 8443, 9001) OR (dst_port NOT IN (502, 102, 20000, 44818, 4840) AND dst_port > 1024)) AS has_cmd,
  arg_min(src_ip, event_id) AS src_ip, arg_min(dst_ip, event_id) AS dst_ip, arg_min(src_port, event_id) AS src_port,
  arg_min(dst_port, event_id) AS dst_port, arg_min(asset_id, event_id) AS asset_id,
  arg_min(payload_hex, event_id) FILTER (payload_hex IS NOT NULL AND (src_port = 502 OR dst_port = 502)) AS modbus,
  count(*) FILTER (tcp_flags LIKE '%S%') AS syn_n, count(*) FILTER (tcp_flags LIKE '%R%') AS rst_n,
  count(*) FILTER (protocol = 'TCP') AS tcp_n, count(*) FILTER (protocol = 'UDP') AS udp_n FROM w GROUP BY 1)"""
_PROTO = """wp AS (SELECT window_end, arg_max(protocol, {'c': c, 'f': -f}) AS protocol FROM (SELECT window_end, protocol, count(*) AS c,
  min(event_id) AS f FROM w GROUP BY 1, 2) GROUP BY 1)"""
_IAT = """wi0 AS (SELECT window_end, CAST(ts_us - prev_us AS DOUBLE) AS g FROM w WHERE prev_us IS NOT NULL),
wi1 AS (SELECT window_end, count(*) AS k, avg(g) AS m, var_pop(g) AS v FROM wi0 GROUP BY 1),
wi2 AS (SELECT window_end, k, m, v, avg((g - m) * (g - m) * (g - m)) AS m3, avg((g - m) * (g - m) * (g - m) * (g - m)) AS m4
  FROM wi0 JOIN wi1 USING (window_end) GROUP BY 1, 2, 3, 4),
wi AS (SELECT a.window_end, coalesce(m, 0) / 1e6 AS iat_mean, coalesce(v, 0) / 1e12 AS iat_variance, sqrt(coalesce(v, 0)) / 1e6 AS iat_std,
  CASE WHEN k >= 3 AND v > 0 THEN m3 / pow(v, 1.5) ELSE 0.0 END AS iat_skewness,
  CASE WHEN k >= 4 AND v > 0 THEN m4 / (v * v) - 3 ELSE 0.0 END AS iat_kurtosis,
  sqrt(coalesce(v, 0)) / 1e6 / (coalesce(m, 0) / 1e6 + 1e-9) AS iat_cv FROM wa a LEFT JOIN wi2 USING (window_end))"""
# Direct Fourier sums over the arrival gaps of each window.
_DFT = """sx AS (SELECT window_end, (g - m) / 1e6 AS x, k AS n, m / 1e6 AS mean, row_number() OVER (PARTITION BY window_end ORDER BY ts_us, event_id) - 1 AS j
  FROM (SELECT window_end, ts_us, event_id, CAST(ts_us - prev_us AS DOUBLE) AS g FROM w WHERE prev_us IS NOT NULL) JOIN wi1 USING (window_end)
  WHERE k >= 4),
sm AS (SELECT window_end, n, mean, f.f AS f, sqrt(pow(sum(x * cos(2 * pi() * ((f.f * j) % n) / n)), 2) + pow(sum(x * sin(2 * pi() * ((f.f * j) % n) / n)), 2)) AS mag
  FROM sx, LATERAL (SELECT unnest(generate_series(1, n // 2)) AS f) f GROUP BY 1, 2, 3, 4),
sp0 AS (SELECT window_end, arg_max(f, mag) / (n * greatest(mean, 1e-6)) AS dominant_frequency, exp(avg(ln(mag + 1e-12))) / (avg(mag) + 1e-12) AS spectral_flatness,
  max(mag) / (sum(mag) + 1e-12) AS harmonic_ratio, sum(mag * f) / (n * greatest(mean, 1e-6)) / (sum(mag) + 1e-12) AS spectral_centroid,
  max(mag) / (avg(mag) + 1e-12) AS periodicity FROM sm GROUP BY window_end, n, mean),
sp AS (SELECT a.window_end, coalesce(dominant_frequency, 0) AS dominant_frequency, coalesce(spectral_flatness, 0) AS spectral_flatness,
  coalesce(harmonic_ratio, 0) AS harmonic_ratio, coalesce(spectral_centroid, 0) AS spectral_centroid, coalesce(periodicity, 0) AS periodicity
  FROM wa a LEFT JOIN sp0 USING (window_end))"""
_FEAT = [*W, _AGG, _PROTO, _IAT, _entropy("ip_id", "e1"), _entropy("ip_flags", "e2"), _entropy("tcp_flags", "e3", "<> ''"),
         _entropy("dscp", "e4"), _DFT, """f0 AS (SELECT wa.*, wp.protocol, iat_mean, iat_variance, iat_std, iat_skewness, iat_kurtosis, iat_cv,
  coalesce(e1.e, 0) AS ip_id_entropy, coalesce(e2.e, 0) AS ip_flags_entropy, coalesce(e3.e, 0) AS tcp_flags_entropy, coalesce(e4.e, 0) AS dscp_entropy,
  dominant_frequency, spectral_flatness, harmonic_ratio, spectral_centroid, periodicity,
  CASE WHEN n >= 4 AND iat_mean > 0 THEN greatest(0.0, least(1.0, 1 - iat_cv / 0.2)) ELSE 0.0 END AS reg,
  least(1.0, udp_ratio * greatest(n / dur / 100.0, bytes / dur / 100000.0)) AS udp_burst, least(1.0, greatest(0, ttl_n - 1) / 4.0) AS ttl_anom
  FROM wa JOIN wp USING (window_end) JOIN wi USING (window_end) JOIN sp USING (window_end) LEFT JOIN e1 USING (window_end)
  LEFT JOIN e2 USING (window_end) LEFT JOIN e3 USING (window_end) LEFT JOIN e4 USING (window_end))""",
         """f1 AS (SELECT *, greatest(periodicity, reg * 4) AS periodicity_score, CASE WHEN has_ot AND NOT has_cmd THEN 0.0
  ELSE least(1.0, 0.6 * reg + 0.4 * CASE WHEN has_cmd THEN 1.0 ELSE 0.5 END) END AS beacon FROM f0)""",
         """f AS (SELECT *, least(1.0, 0.35 * least(1.0, dsts / 10.0) + 0.15 * least(1.0, ports / 10.0) + 0.15 * udp_burst
  + 0.10 * least(1.0, periodicity_score / 10.0) + 0.15 * beacon) AS behavior FROM f1)"""]


def _n(x: str, s: float) -> str:
    return f"least(1.0, abs({x}) / ({s} + 1e-9))"


def _b(x: str) -> str:
    return f"greatest(0.0, least(1.0, {x}))"


# Decayed means of all numeric features, window by window.
_NUMERIC = {
    "packets": "n", "bytes": "bytes", "pps": "n / dur", "bps": "bytes / dur", "flows": "flow_count", "ports": "ports", "dsts": "dsts",
    "srcs": "srcs", "fan_out": "dsts", "fan_in": "srcs", "nir": "dsts / n", "subnets": "subnets", "lm": "lm", "ls": "ls", "ttl_mean": "ttl_mean",
    "ttl_delta": "ttl_delta", "e1": "ip_id_entropy", "e2": "ip_flags_entropy", "e3": "tcp_flags_entropy", "e4": "dscp_entropy",
    "i1": "iat_mean", "i2": "iat_variance", "i3": "iat_std", "i4": "iat_skewness", "i5": "iat_kurtosis", "i6": "iat_cv", "bd": "0.0",
    "s1": "dominant_frequency", "s2": "spectral_flatness", "s3": "harmonic_ratio", "s4": "spectral_centroid", "s5": "periodicity_score",
    "auth": "1.0", "lat": "least(1.0, dsts / 10.0)", "udp": "udp_ratio", "ub": "udp_burst", "ta": "ttl_anom", "pi": "altered", "pal": "altered",
    "sp": "spoofed", "id": "spoofed", "be": "beacon", "bh": "behavior", "ps": "lm", "it": "iat_mean", "pc": "n", "mp": "lm",
    "se": "spectral_flatness", "fb": "harmonic_ratio", "pt": "CAST(protocol = 'TCP' AS DOUBLE)", "pu": "CAST(protocol = 'UDP' AS DOUBLE)",
    "sport": "src_port", "dport": "dst_port", "z1": "0.0", "z2": "0.0", "z3": "0.0", "z4": "0.0", "z5": "0.0", "z6": "0.0", "z7": "0.0"}
_KITSUNE = [
    "kw AS (SELECT *, row_number() OVER (ORDER BY window_end) AS obs FROM f)",
    "kl AS (" + " UNION ".join(f"SELECT window_end, obs, '{k}' AS feature, CAST({e} AS DOUBLE) AS x FROM kw" for k, e in _NUMERIC.items()) + ")",
    """kr AS (SELECT feature, obs, window_end, x, x AS mean, 0.0::DOUBLE AS d FROM kl WHERE obs = 1 UNION ALL
  SELECT l.feature, l.obs, l.window_end, l.x, kr.mean * 0.95 + l.x * 0.05, abs(l.x - kr.mean) / (abs(kr.mean) + 1)
  FROM kr JOIN kl l ON l.feature = kr.feature AND l.obs = kr.obs + 1)""",
    "ks AS (SELECT window_end, greatest(0.0, least(1.0, avg(d))) AS kitsune FROM kr GROUP BY 1)"]

_SCORE = [*_FEAT, *_KITSUNE, f"""sc0 AS (SELECT f.*, kitsune,
  {_b(f"0.25 * {_n('dsts', 10)} + 0.15 * {_n('bytes / dur', 5000)} + 0.15 * {_n('least(1.0, dsts / 10.0)', 1)} + 0.05 * udp_burst + 0.1 * spoofed + 0.1 * altered")} AS xgboost,
  {_b(f"0.4 * beacon + 0.25 * {_n('iat_cv', 1)} + 0.15 * {_n('periodicity_score', 5)} + 0.15 * {_n('behavior', 1)}")} AS lstm,
  {_b(f"0.5 * greatest({_n('periodicity_score', 5)}, beacon) + 0.25 * {_n('dsts / n', 0.5)} + 0.25 * {_n('dsts', 10)}")} AS fft,
  {_b(f"0.2 * {_n('dsts', 10)} + 0.2 * udp_burst + 0.15 * spoofed + 0.15 * altered")} AS isolation_forest FROM f JOIN ks USING (window_end))"""]


def _risk(src: str = "sc0") -> list[str]:
    return [f"""sc1 AS (SELECT *, (0.4 * xgboost + 0.2 * lstm + 0.15 * fft + 0.15 * kitsune + 0.1 * isolation_forest) / 1.0 AS fused,
  (xgboost + lstm + fft + kitsune + isolation_forest) / 5 AS mean_score FROM {src})""",
            """sc2 AS (SELECT *, (pow(xgboost - mean_score, 2) + pow(lstm - mean_score, 2) + pow(fft - mean_score, 2) + pow(kitsune - mean_score, 2)
  + pow(isolation_forest - mean_score, 2)) / 5 AS variance,
  CASE WHEN modbus IS NULL THEN 0.0 ELSE 0.7 * CAST(modbus = '00010000000601050001ff00' AS INT) END AS pa FROM sc1)""",
            """sc3 AS (SELECT *, least(1.0, variance * 4) AS disagreement, least(1.0, fused * 0.75 + pa * 0.45 + udp_burst * 0.45 + ttl_anom * 0.35 + altered * 0.35
  + spoofed * 0.45 + altered * 0.45 + beacon * 0.5 + behavior * 0.25 + least(1.0, dsts / 10.0) * 0.3 + least(1.0, ports / 10.0) * 0.15 + 0.5 * 0.05) AS risk_score,
  len(list_filter([xgboost, lstm, fft, kitsune, isolation_forest], lambda x: x >= 0.9)) AS high FROM sc2)""",
            """r AS (SELECT *, CASE WHEN risk_score >= 0.85 OR high >= 2 THEN 'CRITICAL' WHEN risk_score >= 0.6 THEN 'WARNING'
  WHEN risk_score >= 0.35 THEN 'INFO' ELSE 'LOW' END AS risk_level,
  CASE WHEN spoofed > 0 THEN 'IP_SPOOFING' WHEN altered > 0 THEN 'PACKET_ALTERATION' WHEN udp_burst >= 0.5 THEN 'ABNORMAL_TRAFFIC_VOLUME'
   WHEN beacon >= 0.4 THEN 'BEACONING' WHEN ttl_anom >= 0.5 THEN 'TTL_ANOMALY' WHEN pa > 0 THEN 'PROTOCOL_ANOMALY'
   WHEN dsts > 5 THEN 'FAN_OUT_ANOMALY' WHEN behavior >= 0.5 THEN 'ABNORMAL_BEHAVIOR' ELSE 'NOVEL_BEHAVIOR' END AS attack_category FROM sc3)"""]


_RISK = [*_SCORE, *_risk()]

# Second feature set.
_EXTRACT = [*W, _AGG, _IAT, _entropy("dst_port", "ep"),
            """xb AS (SELECT w.window_end, max(c) AS peak, count(*) AS bins FROM (SELECT w.window_end, (ts_us - first_us) // 100000 AS bin, count(*) AS c
  FROM w JOIN wa USING (window_end) GROUP BY 1, 2) w GROUP BY 1)""",
            """x AS (SELECT wa.*, greatest(0.001, (wa.last_us - wa.first_us) / 1e6) AS d, iat_mean, iat_std, coalesce(ep.e, 0) AS port_entropy,
  peak / greatest(1.0, n / greatest(1, bins)) AS burst FROM wa JOIN wi USING (window_end) JOIN xb USING (window_end) LEFT JOIN ep USING (window_end))"""]
_METRICS = {"pps": (0, "n / d"), "bps": (1, "bytes * 8 / d"), "unique_dst_ports": (2, "ports"), "syn_ratio": (3, "syn_n / greatest(1, tcp_n)"),
            "rst_ratio": (4, "rst_n / greatest(1, tcp_n)"), "burst_ratio": (5, "burst")}
_EWMA = [*_EXTRACT, "xo AS (SELECT *, row_number() OVER (ORDER BY window_end) AS obs FROM x)",
         "xl AS (" + " UNION ".join(f"SELECT window_end, obs, '{m}' AS metric, {p} AS pos, CAST({e} AS DOUBLE) AS x FROM xo"
                                    for m, (p, e) in _METRICS.items()) + ")",
         """er AS (SELECT metric, pos, obs, window_end, x, x AS mean, 1.0::DOUBLE AS variance FROM xl WHERE obs = 1 UNION ALL
  SELECT l.metric, l.pos, l.obs, l.window_end, l.x, er.mean + 0.1 * (l.x - er.mean),
  0.9 * (er.variance + (l.x - er.mean) * (0.1 * (l.x - er.mean))) FROM er JOIN xl l ON l.metric = er.metric AND l.obs = er.obs + 1)""",
         """ez AS (SELECT *, CASE WHEN obs = 1 THEN 0.0 ELSE (x - mean) / sqrt(greatest(0.0001, variance)) END AS z FROM er)""",
         """ew AS (SELECT *, CASE WHEN obs >= 20 THEN round(z, 2) ELSE z END AS zscore,
  CASE WHEN obs >= 20 AND z > 0 THEN round(1 / (1 + exp(-0.8 * (z - 3))), 4) ELSE 0.0 END AS anomaly_score FROM ez)"""]

# --- labelled rows ----------------------------------------------------------------------------

_SCORED = """sd AS (SELECT doc_id AS row_id, quality AS label, round(n_chars / (n_chars + 1000.0), 2) AS score FROM labels JOIN documents USING (doc_id))"""
_EMB = "em AS (SELECT CAST(vec_id AS BIGINT) AS row_id, CAST(label < 2 AS INT) AS label, " + ", ".join(
    f"CAST(embedding[{i + 1}] AS DOUBLE) AS f{i}" for i in range(64)) + " FROM embeddings)"
_CHAIN_IN = """ch AS (SELECT o_orderkey AS pos, 'a-' || o_orderkey AS alert_id, min(o_orderpriority) AS risk_level, min(o_orderstatus) AS attack_category,
  '10.0.0.' || min(o_custkey) AS src_ip, '10.1.0.1' AS dst_ip, 't' || o_orderkey AS ts, CAST(min(o_custkey) % 40 AS BIGINT) AS sensor FROM orders GROUP BY 1),
cn AS (SELECT *, row_number() OVER (PARTITION BY sensor ORDER BY pos) AS seq FROM ch)"""
_PAYLOAD = "alert_id || '|' || risk_level || '|' || src_ip"
_COMPACT = """'{"alert_id":"' || alert_id || '","category":"' || attack_category || '","dst_ip":"' || dst_ip || '","risk_level":"' || risk_level || '","src_ip":"' || src_ip || '","timestamp":"' || ts || '"}'"""


def _chain(payload: str, sep: str, tail: str) -> list[str]:
    zero = "0" * 64
    pay = f"cp AS (SELECT *, {payload} AS pay, {tail} AS tl FROM cn)"
    return [_CHAIN_IN, pay, f"""cc AS (SELECT sensor, seq, '{zero}' AS previous_hash, sha256('{zero}{sep}' || pay || tl) AS evidence_hash FROM cp
  WHERE seq = 1 UNION ALL SELECT p.sensor, p.seq, cc.evidence_hash, sha256(cc.evidence_hash || '{sep}' || p.pay || p.tl)
  FROM cc JOIN cp p ON p.sensor = cc.sensor AND p.seq = cc.seq + 1)"""]


_CHAIN = _chain(_PAYLOAD, "", "ts")


def _build() -> None:
    o = ORACLE
    fields = ("event_id, ts_us, src_ip, dst_ip, CAST(src_port AS BIGINT) AS src_port, CAST(dst_port AS BIGINT) AS dst_port, protocol, tcp_flags, packet_len, "
              "CAST(ttl AS BIGINT) AS ttl, ip_id, CAST(ip_flags AS BIGINT) AS ip_flags, dscp, payload_hex, data_source, asset_id")
    o["traffic_view"] = _with(T, f"SELECT {fields} FROM t")
    o["jsonl_events"] = _with(T, """SELECT src_ip, CAST(dst_port AS BIGINT) AS dst_port, protocol, 'live_capture' AS data_source, count(*) AS n,
      CAST(sum(packet_len) AS BIGINT) AS bytes, min(ts_us) AS first_us, max(ts_us) AS last_us FROM t WHERE event_id % 50 > 3 GROUP BY 1, 2, 3""")
    o["tshark_fields"] = _with(T, """SELECT src_ip, protocol, 'tshark_live' AS data_source, count(*) AS n, CAST(sum(packet_len) AS BIGINT) AS bytes,
      CAST(sum(dst_port) AS BIGINT) AS ports, count(*) FILTER (event_id % 3 <> 0) AS ids, CAST(sum(ts_us) AS VARCHAR) AS times
      FROM t WHERE event_id % 20 <> 0 GROUP BY 1, 2""")
    o["tshark_rows"] = _with(T, """SELECT src_ip, 'TCP' AS protocol, event_id % 40 = 0 AS altered, false AS leaked, count(*) AS n,
      CAST(sum(packet_len) AS BIGINT) AS bytes, max(ts_us) AS last_us FROM t GROUP BY 1, 3""")
    o["zeek_conn"] = _with(T, """SELECT src_ip, dst_ip, lower(protocol) AS protocol, count(*) AS n,
      CAST(sum(CASE WHEN event_id % 11 = 0 THEN 0 ELSE packet_len END + event_id % 7) AS BIGINT) AS bytes, count(*) FILTER (event_id % 9 <> 0) AS ports,
      CAST(sum(event_id % 7) AS BIGINT) AS resp_bytes, min(ts_us) AS first_us FROM t WHERE event_id % 100 <> 0 GROUP BY 1, 2, 3""")
    o["zeek_folder"] = _with(T, """SELECT src_ip, dst_ip, lower(protocol) AS protocol, packet_len + event_id % 7 AS packet_len, ts_us,
      CASE WHEN event_id % 2 = 0 THEN 'C' || event_id ELSE '' END AS uid, CAST(coalesce(src_port, 0) AS BIGINT) AS src_port,
      CAST(coalesce(dst_port, 0) AS BIGINT) AS dst_port FROM t""")
    o["indicator_feed"] = _with(T, "SELECT DISTINCT src_ip AS indicator FROM t WHERE event_id % 50 > 1")
    o["dataset_gates"] = """WITH x AS (SELECT CASE WHEN c_custkey % 97 = 0 THEN 'x' WHEN c_custkey % 89 = 0 THEN '2' ELSE CAST(c_nationkey % 2 AS VARCHAR) END AS l,
      c_custkey % 31 = 0 AS inf, c_custkey % 3 <> 0 AND c_custkey % 53 = 0 AS bad FROM customer)
      SELECT count(*) AS rows, count(*) FILTER (l = 'x') AS label_not_numeric, count(*) FILTER (l = '2') AS label_not_binary,
      count(*) FILTER (bad) AS feature_not_numeric, count(*) FILTER (inf) AS feature_not_finite, count(*) FILTER (l = '1') AS positives,
      count(*) FILTER (l = '0') AS negatives FROM x"""
    bits = " || ".join(f"CASE WHEN (event_id % 64) & {b} <> 0 THEN '{c}' ELSE '' END" for c, b in
                       [("F", 1), ("S", 2), ("R", 4), ("P", 8), ("A", 16), ("U", 32)])
    text = " || ".join(f"CASE WHEN contains(upper(event_type), '{c}') THEN '{c}' ELSE '' END" for c in "FSRPAU")
    o["tcp_flag_letters"] = f"SELECT event_id, {bits} AS from_bits, {text} AS from_text FROM events"
    loc = "('10.0.0.1', '10.0.0.2', '10.0.0.3', '10.0.0.100', '10.0.3.1')"
    o["traffic_direction"] = _with(T, f"""SELECT CASE WHEN src_ip IN {loc} AND dst_ip IN {loc} THEN 'LOCAL' WHEN src_ip IN {loc} THEN 'OUTBOUND'
      WHEN dst_ip IN {loc} THEN 'INBOUND' ELSE 'TRANSIT' END AS direction, count(*) AS n FROM t GROUP BY 1""")
    app = """CASE WHEN protocol = 'TCP' THEN CASE WHEN 502 IN (dst_port, src_port) THEN 'MODBUS_TCP' WHEN 20000 IN (dst_port, src_port) THEN 'DNP3'
      WHEN 2404 IN (dst_port, src_port) THEN 'IEC104' WHEN 102 IN (dst_port, src_port) THEN 'S7COMM'
      WHEN 80 IN (dst_port, src_port) OR 8080 IN (dst_port, src_port) THEN 'HTTP' WHEN 443 IN (dst_port, src_port) OR 8443 IN (dst_port, src_port) THEN 'HTTPS'
      WHEN 22 IN (dst_port, src_port) THEN 'SSH' WHEN 3389 IN (dst_port, src_port) THEN 'RDP' END
      ELSE CASE WHEN 53 IN (dst_port, src_port) THEN 'DNS' WHEN dst_port = 123 THEN 'NTP' WHEN dst_port = 161 THEN 'SNMP'
      WHEN dst_port = 162 THEN 'SNMP-TRAP' WHEN dst_port = 514 THEN 'SYSLOG' END END"""
    o["app_protocol"] = _with(T, f"SELECT event_id, {app} AS app FROM t")
    o["ot_observable"] = _with(T, f"""SELECT p AS protocol, CASE WHEN p IN ('DNP3', 'IEC104', 'S7COMM') THEN 'metadata_only' ELSE 'generic' END AS visibility_status,
      count(*) AS n, 0.0::DOUBLE AS anomaly FROM (SELECT CASE WHEN event_id % 5 = 0 THEN 'DNP3' ELSE upper(coalesce({app}, 'other')) END AS p FROM t) GROUP BY 1""")
    o["metadata_evidence"] = """SELECT event_id, event_id % 12 IN (1, 3, 4, 7) AS altered,
      event_id % 12 IN (8, 10) OR (event_id % 12 = 9 AND user_id % 2 = 1) AS spoofed FROM events"""
    # Expected decoding of each frame shape, stated by hand.
    o["modbus_decode"] = """WITH m(k, transaction_id, protocol_id, mbap_length, unit_id, function_code, operation, starting_address, quantity,
      malformed_message_score, unexpected_function_score, write_operation_risk_score, protocol_anomaly_score) AS (VALUES
      (0, 1, 0, 6, 1, 3, 'read', 0, 2, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE),
      (1, 1, 0, 6, 1, 5, 'write', 1, 65280, 0.7, 0.0, 0.7, 0.7),
      (2, 1, 0, 1, 1, 90, 'read', NULL, NULL, 0.8, 1.0, 0.0, 1.0),
      (3, 1, 0, 1, 1, 127, 'read', NULL, NULL, 0.8, 0.0, 0.0, 0.8),
      (4, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 1.0, NULL, NULL, 0.9),
      (5, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 1.0, NULL, NULL, 0.9),
      (6, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 0.2, NULL, NULL, 0.2),
      (7, 1, 1, 6, 1, 3, 'read', 0, 2, 0.8, 0.0, 0.0, 0.8),
      (8, 1, 0, 6, 1, 3, 'read', NULL, NULL, 0.0, 0.0, 0.0, 0.0),
      (9, 2, 0, 6, 1, 15, 'write', 16, 0, 0.7, 0.0, 0.7, 0.7),
      (10, 3, 0, 6, 1, 6, 'write', 1, 10, 0.0, 0.0, 0.7, 0.0),
      (11, 4, 0, 6, 1, 8, 'read', NULL, NULL, 0.0, 1.0, 0.0, 1.0))
      SELECT event_id, CAST(transaction_id AS BIGINT) AS transaction_id, CAST(protocol_id AS BIGINT) AS protocol_id, CAST(mbap_length AS BIGINT) AS mbap_length,
      CAST(unit_id AS BIGINT) AS unit_id, CAST(function_code AS BIGINT) AS function_code, operation, CAST(starting_address AS BIGINT) AS starting_address,
      CAST(quantity AS BIGINT) AS quantity, malformed_message_score, unexpected_function_score, write_operation_risk_score, protocol_anomaly_score
      FROM events JOIN m ON event_id % 12 = k"""
    o["tls_server_name"] = "SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN 'host' || user_id || '.example' END AS sni FROM events"
    o["dedup_events"] = _with(T, """SELECT min(event_id) AS event_id, ts_us, src_ip, dst_ip, protocol, packet_len,
      CAST(arg_min(src_port, event_id) AS BIGINT) AS src_port FROM t GROUP BY ts_us, src_ip, dst_ip, protocol, packet_len""")
    rule = lambda ids: _with([*T, _RULES, _HITS], f"SELECT event_id, rule_id, severity, evidence FROM hits JOIN rules USING (rule_id) WHERE rule_id IN ({ids})")
    o["sig_xmas_null_synfin"] = rule("'SIG-SCAN-001', 'SIG-SCAN-002', 'SIG-SCAN-003'")
    o["sig_modbus_write"] = rule("'SIG-OT-001'")
    o["sig_telnet"] = rule("'SIG-NET-001'")
    o["sig_s7_stop"] = _with(T, """SELECT event_id, 'SIG-OT-002' AS rule_id, 'CRITICAL' AS severity, 'S7comm Stop CPU command sequence' AS evidence
      FROM t WHERE event_id % 4 = 0 AND (event_id % 8 = 0 OR event_id % 12 = 0)""")
    o["rule_catalogue_hits"] = _with([*T, _RULES, _HITS], """SELECT rule_id, severity, category, mitre_technique, count(event_id) AS hits
      FROM rules LEFT JOIN hits USING (rule_id) GROUP BY 1, 2, 3, 4""")
    o["signature_signals"] = _with([*T, _RULES, _HITS, _SIGSIG], "SELECT event_id, category, severity, evidence, CAST(score AS DOUBLE) AS score FROM sigs")
    o["syn_flood"] = _with(T, """SELECT event_id, dst_ip, n AS syn_count FROM (SELECT event_id, dst_ip, count(*) OVER (PARTITION BY dst_ip ORDER BY ts_us
      RANGE BETWEEN 1000000 PRECEDING AND CURRENT ROW) AS n FROM t WHERE protocol = 'TCP' AND tcp_flags LIKE '%S%' AND tcp_flags NOT LIKE '%A%') WHERE n >= 20""")
    chk = _with([*T, _INTEL], f"""SELECT event_id, src_ip, coalesce(is_malicious, false) AS is_malicious, CAST(coalesce(reputation_score, 0) AS DOUBLE) AS reputation_score,
      coalesce(source, CASE WHEN {_local('src_ip')} THEN 'LocalSubnetFilter' ELSE 'LiveThreatIntelFeeds' END) AS source,
      coalesce(attribution, CASE WHEN {_local('src_ip')} THEN 'Private / Local Loopback IP' ELSE 'Not listed on active threat feeds' END) AS attribution
      FROM t LEFT JOIN iv ON src_ip = indicator AND NOT {_local('src_ip')}""")
    o["intel_join"] = o["intel_join_shuffled"] = chk
    o["intel_signals"] = _with([*T, _INTEL, _INTELSIG], "SELECT event_id, severity, evidence, CAST(score AS DOUBLE) AS score FROM isig")
    o["abuse_scores"] = """SELECT '198.51.100.' || s_suppkey AS indicator, s_suppkey * 7 % 101 >= 40 AS is_malicious, round(s_suppkey * 7 % 101 / 100.0, 2)::DOUBLE AS reputation_score,
      'AbuseIPDB' AS source, 'AbuseIPDB Score ' || (s_suppkey * 7 % 101) || '% (' || s_nationkey || ' reports)' AS attribution FROM supplier"""
    o["ioc_store_lookup"] = _with(T, """SELECT dst_ip, dst_ip IN (SELECT dst_ip FROM t WHERE dst_port = 445) AS match, count(*) AS n FROM t GROUP BY 1, 2""")
    o["endpoint_enrichment"] = _with([*T, _INTEL], f"""SELECT event_id, CASE WHEN coalesce(a.indicator, b.indicator) IS NULL THEN 'clean' ELSE 'match' END AS status,
      coalesce(a.indicator, b.indicator) AS ip, coalesce(a.source, b.source) AS source FROM t LEFT JOIN iv a ON src_ip = a.indicator AND NOT {_local('src_ip')}
      LEFT JOIN iv b ON dst_ip = b.indicator AND NOT {_local('dst_ip')}""")
    o["intel_as_of"] = _with([*T, """lk AS (SELECT src_ip AS indicator, min(ts_us) AS seen, (ts_us // 60000000 + length(src_ip)) % 3 = 0 AS is_malicious FROM t GROUP BY src_ip, ts_us // 60000000)""",
                              """lv AS (SELECT indicator, is_malicious, seen AS valid_from, least(seen + CASE WHEN is_malicious THEN 45000000 ELSE 20000000 END,
      coalesce(lead(seen) OVER (PARTITION BY indicator ORDER BY seen), 9000000000000000000)) AS valid_to FROM lk)"""],
                             """SELECT event_id, is_malicious, valid_from, valid_to FROM t LEFT JOIN lv ON src_ip = indicator AND ts_us >= valid_from AND ts_us < valid_to""")
    beh = [*T, *_BEHAVIOUR, _BSIG]
    o["port_scan"] = _with(beh, "SELECT event_id, ts_us, src_ip, dst_ip, severity, CAST(score AS DOUBLE) AS score, evidence FROM bsig WHERE category = 'PORT_SCAN'")
    o["host_sweep"] = _with(beh, "SELECT event_id, ts_us, src_ip, dst_ip, CAST(dst_port AS BIGINT) AS dst_port, evidence FROM bsig WHERE category = 'NETWORK_SWEEP'")
    o["rst_storm"] = _with(beh, "SELECT event_id, ts_us, src_ip, dst_ip, evidence FROM bsig WHERE category = 'CONNECTION_ANOMALY'")
    o["beacon"] = _with([*T, *_BEHAVIOUR], """SELECT event_id, src_ip, dst_ip, CAST(dst_port AS BIGINT) AS dst_port, intervals AS beacon_intervals,
      round(mean_us / 1e6, 6) AS beacon_mean_s, round(cv, 6) AS beacon_cv FROM bc JOIN t USING (event_id)""")
    o["stream_signals_late"] = _with(beh, "SELECT event_id, ts_us, category, src_ip, dst_ip, evidence FROM bsig")
    o["behaviour_counts"] = _with([*T, *_BEHAVIOUR], "SELECT event_id, port_count, host_count, rst_count FROM bh")
    o["all_signals"] = _with(_SIGNALS, """SELECT method AS detection_method, category, severity, count(*) AS n, count(DISTINCT src_ip) AS sources,
      round(sum(CAST(score AS DOUBLE)), 6) AS score FROM s GROUP BY 1, 2, 3""")
    o["incidents"] = _with(_INC, f"""SELECT incident_id, src_ip, dst_ip, category, first_us, last_us, {_LEVEL} AS max_severity, {_FINAL_CONF}::DOUBLE AS confidence,
      event_count, array_to_string(methods, '+') AS methods FROM inc""")
    o["incidents_first_state"] = _with(_INC, """SELECT incident_id, category, first_us, f.severity AS max_severity, 0.75::DOUBLE AS confidence, 1::BIGINT AS event_count,
      f.method AS methods, f.evidence AS first_evidence FROM inc""")
    o["incident_evidence"] = _with([*T, _RULES, _HITS, _SIGSIG, *_sessions("sigs")], """SELECT incident_id, array_to_string(list(evidence ORDER BY rn), ' / ') AS evidence FROM (
      SELECT 'inc_' || substr(sha256(src_ip || '|' || dst_ip || '|' || category || '|' || start_us), 1, 12) AS incident_id, evidence,
      row_number() OVER (PARTITION BY src_ip, dst_ip, category, start_us ORDER BY min({'a': ts_us, 'b': event_id, 'c': seq}), evidence) AS rn
      FROM si GROUP BY src_ip, dst_ip, category, start_us, evidence) WHERE rn <= 10 GROUP BY 1""")
    o["incident_alerts"] = _with(_ALERTS, """SELECT alert_id, incident_id, ts_us, src_ip, dst_ip, protocol, CAST(src_port AS BIGINT) AS src_port,
      CAST(dst_port AS BIGINT) AS dst_port, attack_category, risk_level, CAST(risk_score AS DOUBLE) AS risk_score, CAST(confidence AS DOUBLE) AS confidence,
      detection_method, recommended_action FROM alerts""")
    o["flow_sessions"] = _with(_CONV, f"""SELECT {_FLOW_ID} AS flow_id, src_ip, dst_ip, CAST(src_port AS BIGINT) AS src_port, CAST(dst_port AS BIGINT) AS dst_port,
      proto AS protocol, start_us, last_us, round(duration, 6) AS duration, fwd_packets, bwd_packets, fwd_bytes, bwd_bytes,
      round(CASE WHEN duration > 0 THEN n / duration ELSE n END, 6) AS pps, round(CASE WHEN duration > 0 THEN bytes / duration ELSE bytes END, 6) AS bps FROM flows""")
    o["flow_tcp_state"] = _with(_CONV, """SELECT start_us, src_ip, CAST(src_port AS BIGINT) AS src_port, tcp_state, coalesce(flags, '') AS flags, syn_count, ack_count,
      rst_count, fin_count FROM flows""")
    o["flow_application_fields"] = _with(_CONV, "SELECT start_us, src_ip, CAST(src_port AS BIGINT) AS src_port, app_protocol, tls_sni, dns_query FROM flows")
    o["flow_packet_lists"] = _with(_CONV, "SELECT start_us, src_ip, CAST(src_port AS BIGINT) AS src_port, iats_us, fwd_lengths, bwd_lengths FROM flows")
    act = "(mx - last_us <= 60000000 AND mx - start_us <= 300000000 AND tcp_state <> 'RESET')"
    o["flow_stats"] = _with(_CONV, f"""SELECT count(*) FILTER ({act}) AS active_flow_count, count(*) FILTER (NOT {act}) AS completed_flow_count
      FROM flows, (SELECT max(last_us) AS mx FROM flows)""")
    o["active_flows"] = _with(_CONV, f"""SELECT {_FLOW_ID} AS flow_id, src_ip, last_us, n AS total_packets FROM flows, (SELECT max(last_us) AS mx FROM flows)
      WHERE {act} ORDER BY last_us DESC, flow_id LIMIT 25""")
    o["newest_flows"] = _with(_CONV, f"SELECT {_FLOW_ID} AS flow_id, src_ip, last_us, n AS total_packets FROM flows ORDER BY last_us DESC, flow_id LIMIT 80")
    o["newest_incidents"] = _with(_INC, "SELECT incident_id, src_ip, category, last_us, event_count FROM inc ORDER BY last_us DESC, incident_id LIMIT 60")
    o["evidence_chain_newest"] = _with(_CHAIN, """SELECT cc.seq AS chain_sequence, alert_id, risk_level, previous_hash, evidence_hash
      FROM cc JOIN cn ON cn.seq = cc.seq AND cn.sensor = cc.sensor WHERE cc.sensor = 0 ORDER BY cc.seq DESC LIMIT 100""")
    o["evidence_chains_newest"] = _with(_CHAIN, """SELECT cc.sensor, row_number() OVER (PARTITION BY cc.sensor ORDER BY cc.seq DESC) AS newest, cc.seq AS chain_sequence,
      alert_id, risk_level, previous_hash, evidence_hash FROM cc JOIN cn ON cn.seq = cc.seq AND cn.sensor = cc.sensor QUALIFY newest <= 10""")
    o["signal_rows"] = _with(_SIGNALS, """SELECT event_id, ts_us, category, method AS detection_method, severity, src_ip, dst_ip,
      CAST(score AS DOUBLE) AS score, evidence FROM s""")
    o["direction_rows"] = _with(T, f"""SELECT event_id, CASE WHEN src_ip IN {loc} AND dst_ip IN {loc} THEN 'LOCAL' WHEN src_ip IN {loc} THEN 'OUTBOUND'
      WHEN dst_ip IN {loc} THEN 'INBOUND' ELSE 'TRANSIT' END AS direction FROM t""")
    o["rate_1s"] = _with(J, """SELECT ts_us - ts_us % 1000000 AS interval_us, round(count(*), 2)::DOUBLE AS current_pps, round(sum(packet_len) * 8, 2)::DOUBLE AS current_bps
      FROM t GROUP BY 1""")
    R = lambda e, a: f"round({e}, 6)::DOUBLE AS {a}"
    feat = lambda cols: _with(_FEAT, f"SELECT window_end, {cols} FROM f")
    o["window_volume"] = feat(", ".join([R("n", "packets"), R("bytes", "bytes"), R("n / dur", "packets_per_sec"), R("bytes / dur", "bytes_per_sec"),
                                         R("lm", "packet_len_mean"), R("ls", "packet_len_std"), R("ttl_mean", "ttl_mean"), R("ttl_delta", "ttl_delta"),
                                         "src_ip", R("src_port", "src_port"), R("dst_port", "dst_port")]))
    o["window_distinct"] = feat(", ".join([R("flow_count", "flow_count"), R("ports", "port_diversity"), R("dsts", "destination_diversity"),
                                           R("srcs", "source_diversity"), R("dsts", "fan_out"), R("srcs", "fan_in"), R("dsts / n", "new_ip_ratio"),
                                           R("subnets", "subnet_diversity"), "protocol"]))
    o["window_entropy"] = feat(", ".join(R(f"{c}_entropy", f"{c}_entropy") for c in ("ip_id", "ip_flags", "tcp_flags", "dscp")))
    o["window_iat_stats"] = feat(", ".join(R(c, c) for c in ("iat_mean", "iat_variance", "iat_std", "iat_skewness", "iat_kurtosis", "iat_cv")))
    o["window_indicators"] = feat(", ".join([R("udp_ratio", "udp_ratio"), R("udp_burst", "udp_burst_score"), R("ttl_anom", "ttl_anomaly_score"),
                                             R("altered", "payload_integrity_anomaly"), R("spoofed", "ip_spoofing_score"),
                                             R("least(1.0, dsts / 10.0)", "lateral_movement_score"), R("CAST(protocol = 'TCP' AS INT)", "protocol_type_TCP"),
                                             R("CAST(protocol = 'UDP' AS INT)", "protocol_type_UDP"), "0.0::DOUBLE AS tcp_flags_SYN"]))
    o["window_spectrum"] = feat(", ".join(R(c, c) for c in ("dominant_frequency", "spectral_flatness", "harmonic_ratio", "spectral_centroid", "periodicity_score")))
    o["window_beacon_behaviour"] = feat(", ".join([R("periodicity_score", "periodicity_score"), R("beacon", "beacon_score"), R("behavior", "behavior_anomaly_score")]))
    o["window_baseline_deviation"] = feat(R("(abs(n - 90) / 91 + abs(bytes - 9000) / 9001 + abs(dsts - 3) / 4 + abs(iat_mean - 0.06) / 1.06) / 26", "baseline_deviation")
                                          + ", 0.0::DOUBLE AS authorized_peer_status")
    o["window_per_asset"] = _with(J, """SELECT asset_id, window_end, round(count(*), 6)::DOUBLE AS packets, round(sum(packet_len), 6)::DOUBLE AS bytes,
      count(DISTINCT dst_ip)::DOUBLE AS fan_out, round(coalesce(avg(ts_us - pv), 0), 3) AS iat_mean_us FROM (
      SELECT *, lag(ts_us) OVER (PARTITION BY asset_id, window_end ORDER BY ts_us, event_id) AS pv FROM (
      SELECT t.*, ((ts_us - 1) // 1000000 + 1 + i) * 1000000 AS window_end FROM t, range(5) r(i)) WHERE window_end <= (SELECT max(ts_us) FROM t)) GROUP BY 1, 2""")
    cut = [J[0], J[1].replace("FROM evk)", "FROM evk WHERE event_id % 1000 < 600)")]
    o["window_empty_rows"] = _with([*_windows(cut), """g AS (SELECT window_end, count(*)::DOUBLE AS packets,
      count(DISTINCT {'a': src_ip, 'b': dst_ip, 'c': src_port, 'd': dst_port, 'e': protocol})::DOUBLE AS flow_count FROM w GROUP BY 1)"""],
                                   """SELECT s.window_end, coalesce(packets, 0) AS packets, coalesce(flow_count, 0) AS flow_count,
      CASE WHEN g.window_end IS NULL THEN 1.0::DOUBLE ELSE 0.0 END AS empty_window
      FROM (SELECT unnest(generate_series((SELECT min(window_end) FROM g), (SELECT max(window_end) FROM g), 1000000)) AS window_end) s LEFT JOIN g USING (window_end)""")
    o["window_partial_tail"] = _with(_windows(J, True), "SELECT window_end, count(*)::DOUBLE AS packets FROM w GROUP BY 1")
    o["arrival_spectrum"] = _with([*_EXTRACT, """hb AS (SELECT window_end, bins, d, least(bins - 1, ((ts_us - f_us) * bins) // span) AS bin, count(*) AS c
      FROM (SELECT w.window_end, ts_us, x.first_us AS f_us, x.last_us - x.first_us AS span, x.d,
        least(256, greatest(16, (x.last_us - x.first_us) // 20000)) AS bins FROM w JOIN x USING (window_end) WHERE x.n >= 8 AND x.last_us > x.first_us)
      GROUP BY 1, 2, 3, 4)""",
      """hm AS (SELECT window_end, d, k, round(sqrt(pow(sum(c * cos(2 * pi() * ((k * bin) % bins) / bins)), 2) + pow(sum(c * sin(2 * pi() * ((k * bin) % bins) / bins)), 2)), 6) AS mag
      FROM hb, generate_series(1, 128) AS g(k) WHERE k <= bins // 2 GROUP BY 1, 2, 3)""",
      "hp AS (SELECT window_end, max(mag) AS top FROM hm GROUP BY 1)",
      "hk AS (SELECT hm.window_end, min(k) AS k, any_value(hm.d) AS d FROM hm JOIN hp USING (window_end) WHERE hm.mag = hp.top GROUP BY 1)"],
      f"SELECT x.window_end, {R('coalesce(hk.k / hk.d, 0)', 'dominant_frequency')} FROM x LEFT JOIN hk USING (window_end)")
    o["burst_ratio"] = _with(_EXTRACT, f"SELECT window_end, {R('burst', 'burst_ratio')} FROM x")
    o["extracted_features"] = _with(_EXTRACT, "SELECT window_end, n AS packets, CAST(bytes AS BIGINT) AS bytes, " + ", ".join([
        R("d", "duration"), R("n / d", "pps"), R("bytes * 8 / d", "bps"), "srcs AS unique_src_ips", "dsts AS unique_dst_ips", "ports AS unique_dst_ports",
        R("tcp_n / n", "tcp_ratio"), R("udp_n / n", "udp_ratio"), "0.0::DOUBLE AS icmp_ratio", R("syn_n / greatest(1, tcp_n)", "syn_ratio"),
        R("rst_n / greatest(1, tcp_n)", "rst_ratio"), R("lm", "mean_len"), R("ls", "std_len"), R("iat_mean", "iat_mean"), R("iat_std", "iat_std"),
        R("CASE WHEN iat_mean > 0 THEN iat_std / iat_mean ELSE 0 END", "beacon_jitter_cv"), R("port_entropy", "port_entropy"), R("burst", "burst_ratio"),
        "CASE WHEN srcs = 1 THEN src_ip ELSE 'multiple' END AS src_ip", "CASE WHEN dsts = 1 THEN dst_ip ELSE 'multiple' END AS dst_ip",
        "CASE WHEN tcp_n = n THEN 'TCP' WHEN udp_n = n THEN 'UDP' ELSE 'MIXED' END AS protocol"]) + " FROM x")
    o["scores_by_model"] = _with(_SCORE, "SELECT window_end, " + ", ".join(R(m, m) for m in ("xgboost", "lstm", "fft", "kitsune", "isolation_forest")) + " FROM sc0")
    o["scores_fused"] = _with(_RISK, "SELECT window_end, " + ", ".join([
        R("fused", "score"), R("mean_score", "mean_score"), R("variance", "variance"), R("greatest(xgboost, lstm, fft, kitsune, isolation_forest)", "max_score"),
        R("least(xgboost, lstm, fft, kitsune, isolation_forest)", "min_score"), R("disagreement", "model_disagreement"),
        R("greatest(0, mean_score * (1 - disagreement))", "consensus_score")]) + " FROM r")
    o["window_modbus_evidence"] = _with(_FEAT, """SELECT window_end, CASE WHEN modbus IS NOT NULL THEN CASE WHEN modbus LIKE '%0105%' THEN 5::BIGINT ELSE 3 END END AS function_code,
      CASE WHEN modbus IS NOT NULL THEN CASE WHEN modbus LIKE '%0105%' THEN 'write' ELSE 'read' END END AS operation,
      CASE WHEN modbus IS NOT NULL THEN CASE WHEN modbus LIKE '%0105%' THEN 0.7::DOUBLE ELSE 0.0 END END AS malformed_message_score,
      CASE WHEN modbus LIKE '%0105%' THEN 0.7::DOUBLE ELSE 0.0 END AS protocol_anomaly_score FROM f""")
    reasons = [("dsts > 5", "unusual destination fan-out"), ("pa > 0", "protocol anomaly observed"), ("udp_burst >= 0.5", "high-rate UDP burst observed"),
               ("ttl_anom >= 0.5", "unexpected TTL variation observed"), ("altered > 0", "payload integrity mismatch metadata observed"),
               ("spoofed > 0", "source identity mismatch metadata observed"), ("altered > 0", "packet alteration or checksum mismatch metadata observed"),
               ("beacon >= 0.4", "periodic beaconing behavior observed"), ("behavior >= 0.5", "packet behavior differs from the receive-side baseline")]
    texts = ", ".join(f"CASE WHEN {c} THEN '{x}' END" for c, x in reasons)
    o["risk_levels"] = _with(_RISK, f"""SELECT window_end, {R('risk_score', 'risk_score')}, risk_level, {R('greatest(0, 1 - disagreement)', 'confidence')}, attack_category,
      array_to_string(list_filter([{texts}], lambda x: x IS NOT NULL), '; ') AS reasons FROM r""")
    o["fixed_profile_distance"] = _with([*_FEAT, *_KITSUNE], f"""SELECT window_end, {R('greatest(0.0, least(1.0, avg(abs(x - 2.5) / 3.5)))', 'distance')}
      FROM kl GROUP BY 1""")
    o["kitsune_online"] = _with([*_FEAT, *_KITSUNE], f"SELECT window_end, {R('kitsune', 'kitsune')} FROM ks")
    o["flow_summary"] = _with(_RISK, f"""SELECT last_us AS ts_us, src_ip, dst_ip, protocol, n::DOUBLE AS packets, bytes, {R('risk_score', 'anomaly_score')}, asset_id FROM r""")
    streak = """st AS (SELECT *, sum(CASE WHEN risk_score < 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY src_ip ORDER BY window_end ROWS UNBOUNDED PRECEDING) AS isl FROM r),
      sn AS (SELECT *, CAST(sum(CASE WHEN risk_score >= 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY src_ip, isl ORDER BY window_end ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM st)"""
    o["persistence_islands"] = _with([*_RISK, streak], f"SELECT src_ip, window_end, {R('risk_score', 'risk_score')}, run AS consecutive FROM sn")
    o["persistent_windows"] = _with([*_RISK, streak], "SELECT src_ip, window_end, run >= 3 AS hit_run FROM sn")
    o["cooldown"] = _with([*_RISK, "ra AS (SELECT * REPLACE ('all' AS src_ip) FROM r)", streak.replace("FROM r)", "FROM ra)"),
                           "hh AS (SELECT src_ip, window_end FROM sn WHERE run >= 3)", _cool("hh", 7_000_000)], "SELECT src_ip, window_end FROM ce")
    gate = [*_RISK, streak, "hh AS (SELECT src_ip, window_end FROM sn WHERE run >= 3)", _cool("hh", 30_000_000),
            """gt AS (SELECT r.*, ce.window_end IS NOT NULL AS persistent FROM r LEFT JOIN ce ON ce.src_ip = r.src_ip AND ce.window_end = r.window_end)"""]
    o["emission_gate"] = _with(gate, "SELECT window_end, src_ip, risk_level, persistent FROM gt WHERE risk_level NOT IN ('INFO', 'LOW', 'MEDIUM') OR persistent")
    expl = [("fan_out", "least(1.0, dsts / 10.0)", [0.25, 0.25, 0.20]), ("bytes_per_sec", "least(1.0, bytes / dur / 5000.0)", [0.15]),
            ("lateral_movement_score", "least(1.0, dsts / 10.0)", [0.15]), ("udp_burst_score", "udp_burst", [0.05, 0.20]),
            ("ip_spoofing_score", "spoofed", [0.20]), ("packet_alteration_score", "altered", [0.20]), ("iat_cv", "least(1.0, iat_cv)", [0.55]),
            ("periodicity_score", "least(1.0, periodicity_score / 10.0)", [0.20, 0.45]), ("behavior_anomaly_score", "least(1.0, behavior)", [0.20, 0.50]),
            ("new_ip_ratio", "least(1.0, dsts / n / 0.5)", [0.30])]
    order = ["fan_out", "baseline_deviation", "protocol_anomaly_score", "bytes_per_sec", "lateral_movement_score", "udp_burst_score", "ip_spoofing_score",
             "packet_alteration_score", "iat_cv", "periodicity_score", "behavior_anomaly_score", "new_ip_ratio"]
    contrib = "xc AS (" + " UNION ALL BY NAME ".join(
        f"SELECT window_end, '{f}' AS feature, {order.index(f)} AS pos, round(" + " + ".join(f"round(({e}) * {w}, 6)" for w in ws) + ", 6)::DOUBLE AS contribution FROM f"
        for f, e, ws in expl) + ")"
    o["explain_topk"] = _with([*_FEAT, contrib], """SELECT window_end, feature, contribution, 'positive' AS direction, position FROM (SELECT *,
      row_number() OVER (PARTITION BY window_end ORDER BY contribution DESC, feature) AS position FROM xc WHERE contribution > 0) WHERE position <= 10""")
    o["explain_nested"] = _with([*_FEAT, contrib], """SELECT window_end, position, feature, contribution FROM (SELECT *,
      row_number() OVER (PARTITION BY window_end ORDER BY contribution DESC, pos) AS position FROM xc WHERE contribution > 0) WHERE position <= 10""")
    kit = _RISK
    o["window_alerts_report"] = _with([*kit, streak, "hh AS (SELECT src_ip, window_end FROM sn WHERE run >= 3)", _cool("hh", 30_000_000),
                                       "gt AS (SELECT r.*, ce.window_end IS NOT NULL AS persistent FROM r LEFT JOIN ce ON ce.src_ip = r.src_ip AND ce.window_end = r.window_end)",
                                       _INTEL, contrib, "xt AS (SELECT window_end, arg_max(feature, {'c': contribution, 'p': -pos}) AS top_feature FROM xc WHERE contribution > 0 GROUP BY 1)"],
                                      f"""SELECT 'win_' || substr(sha256('window|' || gt.window_end || '|' || src_ip), 1, 12) AS alert_id, last_us AS ts_us, src_ip, dst_ip, protocol, attack_category,
      risk_level, {R('risk_score', 'risk_score')}, CASE WHEN (NOT {_local('src_ip')} AND src_ip IN (SELECT indicator FROM iv)) OR (NOT {_local('dst_ip')} AND dst_ip IN (SELECT indicator FROM iv))
      THEN 'match' ELSE 'clean' END AS status, top_feature FROM gt LEFT JOIN xt ON xt.window_end = gt.window_end WHERE risk_level NOT IN ('INFO', 'LOW', 'MEDIUM') OR persistent""")
    o["ewma_zscore"] = _with(_EWMA, "SELECT metric, window_end, " + ", ".join([R("x", "x"), "obs", R("mean", "mean"), "round(sqrt(variance), 3) AS std", R("zscore", "zscore"),
                                                                            R("anomaly_score", "anomaly_score")]) + " FROM ew")
    verdict = """ev2 AS (SELECT window_end, max(anomaly_score) AS comp, count(*) FILTER (zscore >= 2.0) AS flags FROM ew GROUP BY 1)"""
    o["ewma_verdicts"] = _with([*_EWMA, verdict], f"SELECT window_end, {R('comp', 'composite_anomaly_score')}, flags, comp >= 0.65 OR flags > 0 AS is_anomaly FROM ev2")
    o["volume_signals"] = _with([*_EWMA, verdict], f"""SELECT last_us AS ts_us, CASE WHEN comp >= 0.85 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
      CASE WHEN srcs = 1 THEN src_ip ELSE 'multiple' END AS src_ip, CASE WHEN dsts = 1 THEN dst_ip ELSE 'multiple' END AS dst_ip,
      CASE WHEN tcp_n = n THEN 'TCP' WHEN udp_n = n THEN 'UDP' ELSE 'MIXED' END AS protocol, {R('comp', 'score')} FROM ev2 JOIN x USING (window_end)
      WHERE comp >= 0.65 OR flags > 0""")
    o["baseline_summary"] = _with(_EWMA, """SELECT 'global:' || metric AS baseline, max(obs) AS count, round(arg_max(mean, obs), 3) AS mean,
      round(sqrt(greatest(0.0001, arg_max(variance, obs))), 3) AS std, 6::BIGINT AS active_metric_trackers FROM ew GROUP BY metric""")
    dash = lambda src: f"""SELECT 'total' AS section, 'alerts' AS name, count(*) AS count FROM {src}
      UNION ALL SELECT 'level', risk_level, count(*) FROM {src} GROUP BY 2 UNION ALL SELECT 'category', attack_category, count(*) FROM {src} GROUP BY 2
      UNION ALL SELECT 'hour', strftime(make_timestamp(ts_us), '%Y-%m-%dT%H'), count(*) FROM {src} GROUP BY 2
      UNION ALL (SELECT 'source', src_ip, count(*) AS c FROM {src} GROUP BY 2 ORDER BY c DESC, src_ip LIMIT 10)
      UNION ALL (SELECT 'destination', dst_ip, count(*) AS c FROM {src} GROUP BY 2 ORDER BY c DESC, dst_ip LIMIT 10)"""  # noqa: E731
    o["dashboard_grouping_sets"] = _with(_ALERTS, dash("alerts"))
    o["dashboard_newest"] = _with([*_ALERTS, "an AS (SELECT * FROM alerts ORDER BY ts_us DESC, alert_id LIMIT 100)"], dash("an"))
    o["heatmap"] = _with(_ALERTS, """SELECT strftime(make_timestamp(ts_us), '%Y-%m-%d') AS day, strftime(make_timestamp(ts_us), '%H') AS hour, attack_category,
      count(*) AS count FROM alerts GROUP BY 1, 2, 3""")
    o["report_counts"] = _with([*_ALERTS, f"ar AS (SELECT * FROM alerts WHERE ts_us >= {BASE + 10_000_000})"], """SELECT 'category' AS section, attack_category AS name, count(*) AS count
      FROM ar GROUP BY 2 UNION ALL SELECT 'level', l, (SELECT count(*) FROM ar WHERE risk_level = l) FROM (VALUES ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW'), ('INFO')) v(l)
      UNION ALL SELECT 'total', 'alerts', count(*) FROM ar""")
    o["kpis"] = _with([*_ALERTS, *_CONV], """SELECT a.*, b.* FROM (SELECT count(*) AS alerts, count(*) FILTER (risk_level = 'CRITICAL') AS critical,
      count(*) FILTER (risk_level = 'HIGH') AS high FROM alerts) a, (SELECT count(*) AS flows, CAST(sum(n) AS BIGINT) AS packets, CAST(sum(bytes) AS BIGINT) AS bytes FROM flows) b""")
    o["top_categories"] = _with(_ALERTS, "SELECT attack_category AS category, count(*) AS count FROM alerts GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
    o["level_counts"] = _with(_ALERTS, "SELECT risk_level, count(*) AS count FROM alerts GROUP BY 1")
    o["alert_filter"] = _with(_ALERTS, f"""SELECT alert_id, ts_us, src_ip FROM alerts WHERE risk_level = 'HIGH' AND ts_us BETWEEN {BASE + 20_000_000} AND {BASE + 400_000_000}""")
    o["alert_lookup"] = _with(_ALERTS, "SELECT alert_id, attack_category, risk_level FROM alerts WHERE alert_id = (SELECT min(alert_id) FROM alerts)")
    o["newest_alerts"] = _with(_ALERTS, "SELECT alert_id, ts_us FROM alerts ORDER BY ts_us DESC, alert_id LIMIT 50")
    o["retention_topn"] = _with(_ALERTS, "SELECT alert_id, ts_us FROM alerts ORDER BY ts_us DESC, alert_id LIMIT 40")
    o["assets_latest"] = _with(T, "SELECT asset_id, arg_max(src_ip, event_id) AS src_ip, arg_max(protocol, event_id) AS protocol FROM t GROUP BY 1")
    o["alerts_stored_latest"] = _with(_ALERTS, f"SELECT alert_id, event_count, {_LEVEL} AS risk_level, 2::BIGINT AS versions, len(methods)::BIGINT AS methods FROM alerts")
    o["feedback_split"] = """SELECT label, label IN ('TRUE_POSITIVE', 'FALSE_POSITIVE', 'BENIGN', 'UNKNOWN') AS accepted, count(*) AS n, '' AS comment FROM (
      SELECT CASE event_type WHEN 'click' THEN 'TRUE_POSITIVE' WHEN 'view' THEN 'BENIGN' WHEN 'error' THEN 'UNKNOWN' ELSE upper(event_type) END AS label FROM events) GROUP BY 1"""
    o["audit_log"] = _with(T, "SELECT 'packet' AS event, src_ip, count(*) AS n, max(ts_us) AS last_us FROM t GROUP BY 2")
    of = "FROM cc JOIN cn ON cn.seq = cc.seq AND cn.sensor = cc.sensor"
    o["chain_append"] = _with(_CHAIN, f"SELECT alert_id, cc.sensor, cc.seq AS chain_sequence, previous_hash, evidence_hash {of}")
    again = """ORDER BY NOT (pos % 4 < 2 AND pos < 30000 OR pos < 9000), pos"""  # the first part, then the second
    o["chain_continued"] = _with([x.replace("PARTITION BY sensor ORDER BY pos", f"PARTITION BY sensor {again}") for x in _CHAIN],
                                 f"SELECT alert_id, cc.sensor, cc.seq AS chain_sequence, evidence_hash {of}")
    o["chain_compact"] = _with(_chain(_COMPACT, ":", "''"), f"SELECT alert_id, cc.sensor, cc.seq AS chain_sequence, evidence_hash {of}")
    zero = "0" * 64
    o["chain_heads"] = _with([*_CHAIN, """hd AS (SELECT sensor, count(*) AS rows, max(seq) AS head_sequence, arg_max(evidence_hash, seq) AS head_hash FROM cc GROUP BY 1)""",
      """hn AS (SELECT *, row_number() OVER (ORDER BY CAST(sensor AS VARCHAR)) AS seq, sensor || '|' || rows || '|' || head_sequence || '|' || head_hash AS pay FROM hd)""",
      f"""hc AS (SELECT seq, sha256('{zero}' || pay) AS evidence_hash FROM hn WHERE seq = 1 UNION ALL
      SELECT p.seq, sha256(hc.evidence_hash || p.pay) FROM hc JOIN hn p ON p.seq = hc.seq + 1)"""],
      "SELECT sensor, rows, head_sequence, head_hash, hc.seq AS chain_sequence, hc.evidence_hash FROM hc JOIN hn ON hn.seq = hc.seq")
    o["chain_segment_heads"] = _with(_CHAIN, "SELECT sensor, arg_max(evidence_hash, seq) AS head_hash, max(seq) AS head_sequence FROM cc GROUP BY 1")
    o["chain_links"] = _with([_CHAIN_IN], "SELECT alert_id, pos % 103 <> 5 AS link_ok, pos % 101 <> 7 AND pos % 103 <> 5 AS payload_ok FROM cn")
    o["chain_first_break"] = _with([_CHAIN_IN], """SELECT sensor, NOT hit AS valid, n AS count, CASE WHEN hit THEN 11 END::BIGINT AS broken_index,
      CASE WHEN hit THEN 12 END::BIGINT AS broken_sequence, CASE WHEN hit THEN a END AS broken_alert_id,
      CASE WHEN hit THEN 'Tampered alert payload detected at sequence 12 (alert_id: ' || a || ')' ELSE 'verified' END AS reason,
      CASE WHEN NOT hit THEN n END AS head_sequence FROM (SELECT sensor, count(*) AS n, max(alert_id) FILTER (seq = 12) AS a,
        sensor % 3 = 0 AND count(*) >= 12 AS hit FROM cn GROUP BY 1)""")
    o["chain_removed_rows"] = _with([_CHAIN_IN], """SELECT sensor, sensor <> 2 AND k > 1 AS valid,
      CASE WHEN sensor = 2 THEN 0 WHEN k = 0 THEN n - 1 WHEN k = 1 THEN n - 3 ELSE n END AS count, CASE WHEN k = 0 THEN 4 END::BIGINT AS broken_index,
      CASE WHEN k = 0 THEN 6 END::BIGINT AS broken_sequence, CASE WHEN k = 0 THEN a END AS broken_alert_id,
      CASE WHEN sensor = 2 OR k = 1 THEN 'Chain ends before its head at sequence ' || n
           WHEN k = 0 THEN 'Hash chain broken at sequence 6: previous_hash does not match preceding evidence_hash' ELSE 'verified' END AS reason,
      CASE WHEN sensor <> 2 AND k > 1 THEN n END AS head_sequence
      FROM (SELECT sensor, sensor % 4 AS k, count(*) AS n, max(alert_id) FILTER (seq = 6) AS a FROM cn GROUP BY 1)""")
    o["alert_verdict_view"] = _with(_ALERTS, "SELECT alert_id, attack_category AS category, risk_level, src_ip AS source, dst_ip AS destination FROM alerts")
    o["roc_auc"] = _with([_SCORED], """SELECT round((SELECT avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0.0 END) FROM sd p, sd n
      WHERE p.label = 1 AND n.label <> 1), 6)::DOUBLE AS roc_auc""")
    o["pr_auc"] = _with([_SCORED], """SELECT round(sum(CASE WHEN label = 1 THEN tp / k ELSE 0 END) / sum(CASE WHEN label = 1 THEN 1 ELSE 0 END), 6)::DOUBLE AS pr_auc FROM (
      SELECT label, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) OVER q AS tp, row_number() OVER q AS k FROM sd WINDOW q AS (ORDER BY score DESC, row_id ROWS UNBOUNDED PRECEDING))""")
    f1 = """SELECT t, round(2 * pr * rc / greatest(pr + rc, 1e-12), 6) AS f1 FROM (SELECT t, tp / greatest(tp + fp, 1) AS pr, tp / greatest(tp + fn, 1) AS rc FROM (
      SELECT t, count(*) FILTER (score >= t AND label = 1) AS tp, count(*) FILTER (score >= t AND label <> 1) AS fp, count(*) FILTER (score < t AND label = 1) AS fn
      FROM sd, (SELECT 0.05::DOUBLE AS t UNION SELECT 0.5 UNION SELECT 0.95 UNION SELECT round(score, 4) FROM sd) GROUP BY t))"""
    o["best_threshold"] = _with([_SCORED], f"SELECT t AS threshold, f1 FROM ({f1}) ORDER BY f1 DESC, t LIMIT 1")
    o["classification"] = _with([_SCORED, """k AS (SELECT count(*) FILTER (score >= 0.4 AND label = 1) AS tp, count(*) FILTER (score >= 0.4 AND label <> 1) AS fp,
      count(*) FILTER (score < 0.4 AND label = 1) AS fn FROM sd)"""], """SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
      round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1 FROM k""")
    o["latency_percentiles"] = """SELECT q, round(v, 6) AS value FROM (SELECT 0.5::DOUBLE AS q, quantile_cont(l_extendedprice, 0.5) AS v FROM lineitem
      UNION ALL SELECT 0.95, quantile_cont(l_extendedprice, 0.95) FROM lineitem)"""
    o["temporal_split"] = """SELECT event_id, CASE WHEN r < floor(n * 0.6) THEN 'train' WHEN r < floor(n * 0.8) THEN 'calibration' ELSE 'test' END AS split
      FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS r, count(*) OVER () AS n FROM events)"""
    o["group_split"] = """WITH g AS (SELECT 'g' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS g, count(*) AS n FROM customer GROUP BY 1),
      i AS (SELECT *, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS gs, sum(n) OVER () AS tot FROM g),
      p AS (SELECT *, sum(n) OVER (ORDER BY (i - 42 % gs + gs) % gs) - n AS pos FROM i)
      SELECT g, CASE WHEN pos < floor(tot * 0.6) THEN 'train' WHEN pos < floor(tot * 0.8) THEN 'calibration' ELSE 'test' END AS split, n FROM p"""
    o["stratified_split"] = _with([_EMB], """SELECT label::BIGINT AS label, split, CAST(CASE split WHEN 'train' THEN floor(n * 0.6) WHEN 'calibration' THEN floor(n * 0.8) - floor(n * 0.6)
      ELSE n - floor(n * 0.8) END AS BIGINT) AS n FROM (SELECT label, count(*) AS n FROM em GROUP BY 1), (VALUES ('train'), ('calibration'), ('test')) v(split)""")
    o["profile_fit"] = _with([_EMB], "SELECT " + ", ".join([R(f"avg(f{i})", f"mean_{i}") for i in range(64)] + [R(f"stddev_pop(f{i}) + 1e-9", f"std_{i}") for i in range(64)])
                             + " FROM em WHERE label = 0")
    dist = " + ".join(f"abs(f{i} - m{i}) / s{i}" for i in range(64))
    o["profile_score"] = _with([_EMB, "pm AS (SELECT " + ", ".join(f"avg(f{i}) AS m{i}, stddev_pop(f{i}) + 1e-9 AS s{i}" for i in range(64)) + " FROM em WHERE label = 0)"],
                               f"SELECT row_id, round(least(1.0, ({dist}) / 64 / 5), 6) AS score FROM em, pm")
    o["row_robust_score"] = _with([_EMB, "lo AS (SELECT row_id, unnest([" + ", ".join(f"f{i}" for i in range(64)) + "]) AS x FROM em)",
                                   "md AS (SELECT row_id, median(x) AS md, stddev_pop(x) AS sd FROM lo GROUP BY 1)",
                                   "ce AS (SELECT row_id, abs(x - md) AS c, sd FROM lo JOIN md USING (row_id))",
                                   "sl AS (SELECT row_id, median(c) + any_value(sd) + 1e-9 AS s FROM ce GROUP BY 1)"],
                                  "SELECT row_id, round(least(1.0, avg(c / s) / 3), 6) AS score FROM ce JOIN sl USING (row_id) GROUP BY 1")
    o["calibrated_probability"] = _with([_SCORED], "SELECT row_id, round(1 / (1 + exp(-(0.97 * score - 0.17))), 6) AS probability FROM sd")
    o["calibration_steps"] = _with([_SCORED, "ct AS (SELECT score AS x, CAST(count(*) AS DOUBLE) AS n, CAST(sum(label) AS DOUBLE) AS pos FROM sd GROUP BY 1)",
                                    "cl AS (SELECT list(x) AS xs, list(n) AS ns, list(pos) AS ps, sum(n) AS tot FROM ct)",
                                    """gd AS (SELECT 0 AS i, 1.0::DOUBLE AS w, 0.0::DOUBLE AS b UNION ALL SELECT i + 1,
      w - 0.1 * list_sum(list_transform(generate_series(1, len(xs)), lambda k: (ns[k] / (1 + exp(-(w * xs[k] + b))) - ps[k]) * xs[k])) / tot,
      b - 0.1 * list_sum(list_transform(generate_series(1, len(xs)), lambda k: ns[k] / (1 + exp(-(w * xs[k] + b))) - ps[k])) / tot FROM gd, cl WHERE i < 300)"""],
                                   "SELECT (SELECT count(*) FROM sd) AS rows, round(w, 6) AS weight, round(b, 6) AS bias FROM gd WHERE i = 300")
    scen = f"'k' || (((window_end - {BASE}) // 20000000) % 5)"
    models = ["xgboost", "lstm", "fft", "kitsune", "isolation_forest"]
    o["window_score_profile"] = _with([*_RISK, "lg AS (" + " UNION ALL ".join(
        f"SELECT {scen} AS scenario, '{n}' AS model, {c} AS s FROM r" for n, c in [(m, m) for m in models] + [("fused", "fused")]) + ")"],
        """SELECT scenario, model, round(avg(s), 4) AS mean, round(stddev_pop(s), 4) AS std, round(min(s), 4) AS min, round(max(s), 4) AS max, count(*) AS samples FROM lg GROUP BY 1, 2""")
    o["evaluation_harness"] = _with([*_RISK, "lg AS (" + " UNION ALL ".join(
        f"SELECT '{n}' AS model, {c} >= 0.5 AS p, ((window_end - {BASE}) // 20000000) % 5 IN (1, 2, 3) AS y FROM r"
        for n, c in [(m, m) for m in models] + [("fusion", "fused")]) + ")",
        """kk AS (SELECT model, count(*) FILTER (p AND y) AS tp, count(*) FILTER (p AND NOT y) AS fp, count(*) FILTER (NOT p AND y) AS fn FROM lg GROUP BY 1)""",
        "pq AS (SELECT *, tp / greatest(tp + fp, 1) AS pr, tp / greatest(tp + fn, 1) AS rc FROM kk)"],
        """SELECT model, tp, fp, fn, round(pr, 4) AS precision, round(rc, 4) AS recall, round(2 * pr * rc / greatest(pr + rc, 1e-12), 4) AS f1, tp + fp AS predicted_positive FROM pq""")
    # Streams emit what the watermark has closed: six seconds behind the newest event.
    closed = "WHERE window_end <= (SELECT max(ts_us) - 6000000 FROM t)"
    o["stream_window_volume"] = _with([*W, _AGG], "SELECT window_end, n AS packets, CAST(bytes AS BIGINT) AS bytes, " + ", ".join([
        R("n / dur", "packets_per_sec"), R("bytes / dur", "bytes_per_sec"), R("lm", "packet_len_mean"), R("ls", "packet_len_std"), R("udp_ratio", "udp_ratio")])
        + f" FROM wa {closed}")
    o["stream_window_values"] = _with([*W, _AGG, _entropy("tcp_flags", "e3", "<> ''")], f"""SELECT window_end, ports AS port_diversity, dsts AS destination_diversity,
      srcs AS source_diversity, {R('coalesce(e, 0)', 'tcp_flags_entropy')} FROM wa LEFT JOIN e3 USING (window_end) {closed}""")
    o["stream_dedup"] = _with(T, "SELECT ts_us, src_ip, dst_ip, packet_len FROM t")
    moved = [J[0], J[1].replace("event_id * 50000", "event_id * 50000 + (event_id // 1000) * 90000000")]
    o["window_silences"] = o["window_empty_rows"].replace(cut[1], moved[1])
    o["behaviour_counts_slots"] = o["behaviour_counts"]
    o["assets_upserted"] = o["assets_latest"]
    o["incidents_upserted"] = o["incidents"]
    o["flows_stored"] = o["flow_summary"]
    o["newest_model_scores"] = _with(_SCORE, "SELECT window_end, " + ", ".join(R(m, m) for m in (
        "xgboost", "lstm", "fft", "kitsune", "isolation_forest")) + " FROM sc0 ORDER BY last_us DESC, window_end LIMIT 100")
    o["tshark_export"] = _with(T, """SELECT src_ip, 'TCP' AS protocol, event_id % 40 = 0 AS altered, count(*) AS n,
      CAST(sum(packet_len) AS BIGINT) AS bytes, max(ts_us) AS last_us FROM t GROUP BY 1, 3""")
    o["dataset_checksums"] = """SELECT CAST(c_nationkey AS BIGINT) AS nation, CAST(strlen(f) AS BIGINT) AS bytes, sha256(f) AS sha256 FROM (
      SELECT c_nationkey, string_agg(concat_ws(',', c_custkey::VARCHAR, c_name, c_mktsegment) || chr(10), '' ORDER BY c_custkey) AS f FROM customer GROUP BY 1)"""
    o["stream_published"] = _with(T, """SELECT protocol, count(*) AS n, CAST(sum(packet_len) AS BIGINT) AS bytes, count(DISTINCT src_ip) AS sources FROM t GROUP BY 1""")
    o["stream_health"] = _with(T, "SELECT count(*) AS packets, max(ts_us) AS last_us FROM t")
    o["calibration_newton"] = _with([_SCORED, "ct AS (SELECT score AS x, CAST(count(*) AS DOUBLE) AS n, CAST(sum(label) AS DOUBLE) AS pos FROM sd GROUP BY 1)",
                                     "cl AS (SELECT list(x) AS xs, list(n) AS ns, list(pos) AS ps FROM ct)",
                                     """nw AS (SELECT 0 AS i, 0.0::DOUBLE AS w, 0.0::DOUBLE AS b UNION ALL
      SELECT i + 1, w - (gw * hbb - gb * hwb) / (hww * hbb - hwb * hwb), b - (gb * hww - gw * hwb) / (hww * hbb - hwb * hwb) FROM (
        SELECT i, w, b, list_sum(list_transform(k, lambda j: (ns[j] * q[j] - ps[j]) * xs[j])) AS gw, list_sum(list_transform(k, lambda j: ns[j] * q[j] - ps[j])) AS gb,
          list_sum(list_transform(k, lambda j: ns[j] * q[j] * (1 - q[j]) * xs[j] * xs[j])) AS hww, list_sum(list_transform(k, lambda j: ns[j] * q[j] * (1 - q[j]) * xs[j])) AS hwb,
          list_sum(list_transform(k, lambda j: ns[j] * q[j] * (1 - q[j]))) AS hbb
        FROM (SELECT i, w, b, xs, ns, ps, generate_series(1, len(xs)) AS k, list_transform(xs, lambda x: 1 / (1 + exp(-(w * x + b)))) AS q FROM nw, cl WHERE i < 12)))"""],
                                    "SELECT (SELECT count(*) FROM sd) AS rows, round(w, 6) AS weight, round(b, 6) AS bias FROM nw WHERE i = 12")
    o["stream_flow_sessions"] = _with(_CONV, f"""SELECT {_FLOW_ID} AS flow_id, src_ip, dst_ip, CAST(src_port AS BIGINT) AS src_port, CAST(dst_port AS BIGINT) AS dst_port,
      proto AS protocol, start_us, last_us, round(duration, 6) AS duration, fwd_packets, bwd_packets, fwd_bytes, bwd_bytes,
      round(CASE WHEN duration > 0 THEN n / duration ELSE n END, 6) AS pps, round(CASE WHEN duration > 0 THEN bytes / duration ELSE bytes END, 6) AS bps,
      tcp_state, coalesce(flags, '') AS flags, syn_count, ack_count, rst_count, fin_count, app_protocol, tls_sni, dns_query FROM flows""")
    o["stream_window_alerts"] = o["window_alerts_report"]
    o["stream_window_tail"] = o["window_partial_tail"]
    o["stream_signals"] = o["all_signals"]
    o["stream_incidents_closed"] = _with(_INC, f"""SELECT src_ip, dst_ip, category, first_us, last_us, event_count, {_LEVEL} AS max_severity, array_to_string(methods, '+') AS methods,
      {_FINAL_CONF}::DOUBLE AS confidence FROM inc WHERE last_us + 10000000 < (SELECT max(ts_us) - 6000000 FROM s)""")
    o["stream_flows_closed"] = _with([*_CONV, """fo AS (SELECT *, lead(start_us) OVER (PARTITION BY a_ip, a_port, b_ip, proto ORDER BY start_us) AS follow FROM flows)"""],
                                     """SELECT src_ip, dst_ip, CAST(src_port AS BIGINT) AS src_port, CAST(dst_port AS BIGINT) AS dst_port, proto AS protocol, start_us, last_us,
      fwd_packets, bwd_packets, fwd_bytes, bwd_bytes, tcp_state FROM fo WHERE follow IS NOT NULL
      OR (last_us + 60000000) // 1000 + 1 <= (SELECT max(ts_us) // 1000 - 6000 FROM c)""")


def _cool(src: str, us: int) -> str:
    return f"""hn AS (SELECT x.src_ip, x.window_end, min(y.window_end) AS nx FROM {src} x JOIN {src} y ON x.src_ip = y.src_ip AND y.window_end >= x.window_end + {us}
  GROUP BY 1, 2),
ce AS (SELECT src_ip, min(window_end) AS window_end FROM {src} GROUP BY 1 UNION ALL SELECT hn.src_ip, hn.nx FROM ce JOIN hn ON hn.src_ip = ce.src_ip
  AND hn.window_end = ce.window_end)"""


_build()
