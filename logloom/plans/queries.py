"""The registered queries of the event engine, each with the SQL that gives the same rows from the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import classify, parse
from logloom.functions import tables as T
from logloom.operators import attack, evidence, findings, indicators, normalize, profile, results, scoring, views
from logloom.plans.bindings import EVIDENCE, FILES, FORMAT_CASES, ORDERS, SYSLOG_CASES, TIMELINE, YEAR, cases_of, doc_events, files, host_digests, lines, parsed, syslog_lines, table, text, timeline, with_files, written
from logloom.sources.stored import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")  # as the SQL has it
            return f(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return f

    return add


def when(column: str = "ts", out: str | None = None):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(out or column)


WHEN = "strftime({}, '%Y-%m-%d %H:%M:%S')"
EV, FS, BOTH = f"with {TIMELINE}", f"with {FILES}", f"with {TIMELINE}, {FILES}"


def values(rows: list[tuple], names: str) -> str:
    return f"(values {', '.join(str(r) if len(r) > 1 else f'({r[0]!r})' for r in rows)}) {names}"


TECH = values(T.TECHNIQUES, "tech(et, id, name, tactic)")
SCORES = values(list(T.TYPE_SCORES.items()), "sc(et, s)")


# --- scans and formats -------------------------------------------------------------------------------------------------


@query("S19_format_sniffing", f"""
with kinds(kind) as (values ('syslog'), ('apache_combined'), ('firewall_simple'), ('audit'), ('journal_json'), ('apt'), ('yum'), ('mysql_error'), ('mysql_general'), ('openvpn'), ('pipe_delimited'), ('iso_timestamp'), ('iptables'))
select kind as expected, kind as format, (select count(*) from orders) as n from kinds""")
def s19(spark, sf_dir):
    kinds = {"syslog_5424": "syslog", "access": "apache_combined", "firewall": "firewall_simple", "audit": "audit", "journal": "journal_json", "apt": "apt", "yum": "yum", "mysql_error": "mysql_error", "mysql_general": "mysql_general", "openvpn": "openvpn", "pipe": "pipe_delimited", "iso": "iso_timestamp", "iptables": "iptables"}
    parts = [lines(spark, sf_dir, k).select(F.lit(v).alias("expected"), parse.line_format(F.col("line")).alias("format")) for k, v in kinds.items()]
    return normalize.united(*parts).groupBy("expected", "format").agg(F.count(F.lit(1)).alias("n"))


@query("S20_dispatch", f"with {ORDERS} select k, case when k % 2 = 0 then 'auth_success' else 'log_entry' end as event_type, case when k % 2 = 0 then 'syslog' else 'text_log' end as source from o")
def s20(spark, sf_dir):
    own = lines(spark, sf_dir, "syslog_5424").withColumn("line", F.when(F.col("k") % 2 == 0, F.col("line")).otherwise(text("odd line ", F.col("k"))))
    return parse.with_events(own.withColumn("format", F.lit("syslog")), parse.any_format(F.col("format")), year=YEAR).select("k", "e.event_type", "e.source")


@query("S16_input_type", """
select doc_id, case doc_id % 5 when 0 then 'disk_image' when 1 then 'evtx' when 2 then 'audit_log' when 3 then 'archive' else 'logs' end as kind from documents""")
def s16(spark, sf_dir):
    from logloom.sources.logs import input_type

    names = F.array(*map(F.lit, (".dd", ".evtx", "_audit.log", ".zip", ".log")))
    name = F.concat(F.lit("F"), F.col("doc_id").cast("string"), F.element_at(names, (F.col("doc_id") % 5 + 1).cast("int")))
    return table(spark, sf_dir, "documents").select("doc_id", input_type(name).alias("kind"))


@query("S10_file_system_names", "select l_orderkey, l_linenumber, case l_linenumber when 1 then 'ntfs' when 2 then 'fat12' when 4 then 'fat16' else 'unbekannt(' || l_linenumber || ')' end as fs from lineitem")
def s10(spark, sf_dir):
    from logloom.sources.logs import file_system

    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", file_system(F.col("l_linenumber")).alias("fs"))


# --- parsers ------------------------------------------------------------------------------------------------------------


@query("P1_syslog_5424", f"with {ORDERS} select k, {WHEN.format('t')} as ts, 'host' || (c % 5) as hostname, 'sshd' as process, cast(k as varchar) as pid, 'Accepted password for user' || (c % 50) || ' from 10.1.1.' || (c % 250) || ' port 22' as message, 'auth_success' as event_type from o")
def p1(spark, sf_dir):
    return parsed(spark, sf_dir, "syslog_5424", parse.syslog_5424).select("k", when(), "hostname", "process", "pid", "message", "event_type")


@query("P2_syslog_3164", f"{EV} select seq, {WHEN.format('ts')} as ts, hostname, process, description as message, event_type from ev")
def p2(spark, sf_dir):
    own = parse.with_events(syslog_lines(spark, sf_dir), parse.syslog_3164, year=YEAR).select("seq", "e.*")
    return own.select("seq", when(), "hostname", "process", "message", "event_type")


@query("P3_access_log", f"""with {ORDERS} select k, {WHEN.format('t')} as ts, '10.0.0.' || (c % 250) as src_ip, case k % 2 when 0 then null else 'admin' end as "user",
  'GET' as method, ['/index', '/admin/x', '/a?id=1''--', '/../etc', '/p'][k % 5 + 1] || '/' || k as path, [200, 404, 500, 403, 200, 200, 301][k % 7 + 1] as status,
  case when k % 3 = 0 then 0 else k end as size from o""")
def p3(spark, sf_dir):
    return parsed(spark, sf_dir, "access", parse.apache).select("k", when(), "src_ip", "user", "method", "path", "status", "size")


@query("P4_iptables", f"""with {ORDERS} select k, ['IPTABLES-DROP', 'IPT-ACCEPT', 'IPT-FORWARD', 'IPT-LOG'][k % 4 + 1] as action, 'gw' as hostname, '10.0.0.' || (c % 250) as src_ip,
  '8.8.8.8' as dst_ip, cast(k % 60000 as varchar) as src_port, '22' as dst_port, 'eth0' as in_if, 'TCP' as proto from o""")
def p4(spark, sf_dir):
    return parsed(spark, sf_dir, "iptables", parse.iptables).select("k", "action", "hostname", "src_ip", "dst_ip", "src_port", "dst_port", F.col("extra")["in"].alias("in_if"), F.col("extra")["proto"].alias("proto"))


@query("P5_firewall", f"""with {ORDERS} select k, {WHEN.format('t')} as ts, ['firewall_allow', 'firewall_block', 'firewall_deny'][k % 3 + 1] as event_type, '10.0.0.' || (c % 250) as src_ip,
  cast(k % 60000 as varchar) as src_port, '8.8.4.4' as dst_ip, '443' as dst_port, k as size from o""")
def p5(spark, sf_dir):
    return parsed(spark, sf_dir, "firewall", parse.firewall).select("k", when(), "event_type", "src_ip", "src_port", "dst_ip", "dst_port", "size")


@query("P6_audit", f"""with {ORDERS} select k, {WHEN.format('t')} as ts, 'user' || (c % 9) as "user", ['59', '2', '41', '999'][k % 4 + 1] as syscall, cast(c as varchar) as uid from o""")
def p6(spark, sf_dir):
    return parsed(spark, sf_dir, "audit", parse.audit).select("k", when(), "user", F.col("extra")["syscall"].alias("syscall"), F.col("extra")["uid"].alias("uid"))


@query("P7_journal_json", f"""with {ORDERS} select k, {WHEN.format('t')} as ts, 'host' || (c % 5) as hostname, ['systemd', 'kernel'][k % 2 + 1] as process, ['Started unit', 'out of memory', 'plain'][k % 3 + 1] as message,
  case when k % 2 = 0 then case when k % 3 = 0 then 'service_event' when k % 5 <= 2 then 'system_alert' else 'system_event' end
    else case when k % 3 = 1 then 'system_alert' else 'kernel_event' end end as event_type from o""")
def p7(spark, sf_dir):
    return parsed(spark, sf_dir, "journal", parse.journal).select("k", when(), "hostname", "process", "message", "event_type")


@query("P8_apt", f"""with {ORDERS} select k, {WHEN.format('t')} as ts, ['install', 'upgrade', 'remove', 'status'][k % 4 + 1] as action, ['nmap', 'vim', 'libc'][k % 3 + 1] || '-' || k || ':amd64' as package,
  case k % 4 when 2 then 'package_remove' when 3 then 'package_event' else case when k % 3 = 0 then 'suspicious_tool_installed' else 'package_install' end end as event_type from o""")
def p8(spark, sf_dir):
    return parsed(spark, sf_dir, "apt", parse.apt).select("k", when(), "action", "package", "event_type")


@query("P9_yum", f"""with {ORDERS} select k, {WHEN.format('t')} as ts, ['Installed', 'Erased', 'log_entry'][k % 3 + 1] as action, case when k % 3 = 2 then 'refreshing pkg-' || k else 'pkg-' || k end as package,
  case when k % 3 = 0 then 'package_install' else 'package_event' end as event_type from o""")
def p9(spark, sf_dir):
    return parsed(spark, sf_dir, "yum", parse.yum).select("k", when(), "action", "package", "event_type")


@query("P10_mysql_error", f"""with {ORDERS} select k, {WHEN.format('t')} as ts, ['note', 'warning', 'error'][k % 3 + 1] as action, ['Access denied for x', 'disk full', 'ready', 'done'][k % 4 + 1] as message,
  case k % 4 when 0 then 'auth_failure' when 1 then 'system_alert' else ['db_event', 'db_warning', 'db_error'][k % 3 + 1] end as event_type from o""")
def p10(spark, sf_dir):
    return parsed(spark, sf_dir, "mysql_error", parse.mysql_error).select("k", when(), "action", "message", "event_type")


@query("P11_mysql_general", f"""with {ORDERS} select k, {WHEN.format('t')} as ts, ['Query', 'Connect', 'Quit'][k % 3 + 1] as action,
  case k % 3 when 1 then 'db_connect' when 2 then 'db_disconnect' else ['db_query', 'credential_access', 'sqli_attempt', 'db_query'][k % 4 + 1] end as event_type from o""")
def p11(spark, sf_dir):
    return parsed(spark, sf_dir, "mysql_general", parse.mysql_general).select("k", when(), "action", "event_type")


@query("P12_openvpn", f"""with {ORDERS} select k, {WHEN.format('t')} as ts, '10.8.0.' || (c % 250) as src_ip, '1194' as src_port,
  ['vpn_connection', 'vpn_disconnect', 'auth_failure', 'vpn_tls_error', 'vpn_event'][k % 5 + 1] as event_type from o""")
def p12(spark, sf_dir):
    return parsed(spark, sf_dir, "openvpn", parse.openvpn).select("k", when(), "src_ip", "src_port", "event_type")


@query("P14_sysmon", """
select event_id, cast([1, 3, 5, 22][event_id % 4 + 1] as varchar) as sysmon_id, '/bin/p' || user_id as image,
  case event_id % 4 when 0 then case when event_id % 3 = 0 then 'reverse_shell_attempt' else 'process_create' end when 1 then 'network_connect' when 2 then 'process_terminate' else 'dns_query' end as event_type
from events where event_id % 11 <> 0 union all select event_id, null, null, 'sysmon_event' from events where event_id % 11 = 0""")
def p14(spark, sf_dir):
    from logloom.sources.logs import sysmon_events

    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    n = F.element_at(F.array(*map(F.lit, ("1", "3", "5", "22"))), (F.col("event_id") % 4 + 1).cast("int"))
    xml = text('<Event xmlns="x"><System><EventID>', n, '</EventID></System><EventData><Data Name="Image">/bin/p', F.col("user_id"), '</Data><Data Name="CommandLine">', F.when(F.col("event_id") % 3 == 0, "nc -e x").otherwise("ls"), '</Data><Data Name="DestinationPort">22</Data></EventData></Event>')
    broken = F.when(F.col("event_id") % 11 == 0, F.lit("<Event><a></Event>")).otherwise(xml)
    out = sysmon_events(e.select("event_id", broken.alias("line")).withColumnRenamed("event_id", "nr"))
    return out.select(F.col("nr").alias("event_id"), F.col("event_id").alias("sysmon_id"), F.col("Image").alias("image"), "event_type")


@query("P15_pipe", f"""with {ORDERS} select k, {WHEN.format('t')} as ts, ['auth', 'web', 'c2'][k % 3 + 1] as event_type, 'src' || (c % 3) as source, 'event ' || k as message, 'host' || (c % 5) as hostname, 'user' || (c % 50) as "user" from o""")
def p15(spark, sf_dir):
    return parsed(spark, sf_dir, "pipe", parse.pipe).select("k", when(), "event_type", "source", "message", "hostname", "user")


@query("P16_iso_key_values", f"""with {ORDERS} select k, {WHEN.format('t')} as ts, 'windows_event_' || ['4624', '4625', '4688'][k % 3 + 1] as event_type, 'v' || (k % 5) as account from o""")
def p16(spark, sf_dir):
    return parsed(spark, sf_dir, "iso", parse.iso_line).select("k", when(), "event_type", F.col("extra")["User"].alias("account"))


@query("P17_generic", "select doc_id, 'log_entry' as event_type, length(text) as n from documents where length(text) >= 5")
def p17(spark, sf_dir):
    own = parse.with_events(table(spark, sf_dir, "documents").select("doc_id", "text"), parse.generic, "text").filter("e is not null")
    return own.select("doc_id", "e.event_type", F.length("e.message").cast("long").alias("n"))


# --- classifiers ---------------------------------------------------------------------------------------------------------


@query("C1_syslog_types", f"{EV} select event_type, count(*) as n from ev group by event_type")
def c1(spark, sf_dir):
    return views.counts_by(timeline(spark, sf_dir), "event_type")


def case_counts(cases: list[tuple]) -> str:
    """SQL of how many events there are of each expected type, when events go through the cases in turn."""
    return f"select event_type, count(*) as n from (select event_id from events) e join {values([(i, c[-1]) for i, c in enumerate(cases)], 'x(i, event_type)')} on event_id % {len(cases)} = i group by event_type"


@query("C1_syslog_types_of_all_rules", case_counts(SYSLOG_CASES))
def c1a(spark, sf_dir):
    own = parse.with_events(cases_of(spark, sf_dir, SYSLOG_CASES), parse.syslog, year=YEAR)
    return views.counts_by(own.select("e.*"), "event_type")


def _case_query(kind: str) -> None:
    def run(spark, sf_dir):
        return views.counts_by(parse.with_events(cases_of(spark, sf_dir, FORMAT_CASES[kind]), parse.PARSERS[kind], year=YEAR).select("e.*"), "event_type")

    query(f"C_rules_of_{kind}", case_counts(FORMAT_CASES[kind]))(run)


for _kind in FORMAT_CASES:
    _case_query(_kind)


#: Events of sysmon (number, image, command line, port) and the type of each.
SYSMON_CASES = [(3, "/bin/bash", "", "4444", "c2_beacon"), (3, "/bin/nginx", "", "443", "network_connect"), (1, "/bin/sh", "bash -i", "", "reverse_shell_attempt"), (8, "/x", "", "", "remote_thread_create"), (11, "/x", "", "", "file_create"), (23, "/x", "", "", "file_delete"), (99, "/x", "", "", "sysmon_event")]


@query("C10_sysmon_rules", case_counts(SYSMON_CASES))
def c10(spark, sf_dir):
    from logloom.sources.logs import sysmon_events

    xml = [f'<Event xmlns="x"><System><EventID>{n}</EventID></System><EventData><Data Name="Image">{image}</Data><Data Name="CommandLine">{command}</Data><Data Name="DestinationPort">{port}</Data></EventData></Event>' for n, image, command, port, _ in SYSMON_CASES]
    return views.counts_by(sysmon_events(cases_of(spark, sf_dir, [(x, "") for x in xml])), "event_type")


@query("C6_packages", f"select package, count(*) as n from (select c_custkey, ['{"', '".join(T.ATTACK_PACKAGES)}'][c_custkey % {len(T.ATTACK_PACKAGES)} + 1] as package from customer) group by package")
def c6(spark, sf_dir):
    """Every name of an attack tool, within a longer name and in capitals."""
    names = F.array(*map(F.lit, T.ATTACK_PACKAGES))
    own = table(spark, sf_dir, "customer").select(F.element_at(names, (F.col("c_custkey") % len(T.ATTACK_PACKAGES) + 1).cast("int")).alias("package"))
    kind = classify.package_action(F.lit("install"), F.concat(F.lit("lib"), F.upper("package"), F.lit("-dev")))
    return views.counts_by(own.filter(kind == "suspicious_tool_installed"), "package")


@query("C3_web_requests", f"""with {ORDERS}, p as (select k, ['http', 'suspicious_request', 'sqli_attempt', 'path_traversal', 'http'][k % 5 + 1] as a, [200, 404, 500, 403, 200, 200, 301][k % 7 + 1] as status from o)
select case when a <> 'http' then a when status = 404 then 'http_error' when status >= 500 then 'http_server_error' when status >= 400 then 'http_error' else 'http_request' end as event_type, count(*) as n from p group by 1""")
def c3(spark, sf_dir):
    return views.counts_by(parsed(spark, sf_dir, "access", parse.apache), "event_type")


@query("C4_iptables_verdict", f"with {ORDERS} select ['firewall_drop', 'firewall_allow', 'firewall_forward', 'firewall_event'][k % 4 + 1] as event_type, count(*) as n from o group by 1")
def c4(spark, sf_dir):
    return views.counts_by(parsed(spark, sf_dir, "iptables", parse.iptables), "event_type")


@query("C5_audit_types", f"""with {ORDERS} select case k % 3 when 0 then case when k % 2 = 0 then 'auth_success' else 'auth_failure' end when 1 then ['code_execution', 'file_access', 'network_activity', 'system_call'][k % 4 + 1]
  else case k % 5 when 0 then 'credential_access' when 1 then 'ssh_key_modified' else 'file_access' end end as event_type, count(*) as n from o group by 1""")
def c5(spark, sf_dir):
    return views.counts_by(parsed(spark, sf_dir, "audit", parse.audit), "event_type")


WORDS = " or ".join(f"contains(lower(description), '{w}')" for w in T.SUSPICIOUS_WORDS)


@query("C11_suspicious", f"{EV} select seq, event_type in {tuple(T.SUSPICIOUS_TYPES)} or is_anomaly or anomaly_score > 0.5 or {WORDS} as suspicious from ev")
def c11(spark, sf_dir):
    return timeline(spark, sf_dir).select("seq", classify.suspicious(F.col("event_type"), F.col("is_anomaly"), F.col("anomaly_score"), F.col("description")).alias("suspicious"))


@query("C11_suspicious_documents", f"select doc_id, {WORDS.replace('description', 'text')} as suspicious from documents")
def c11d(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", classify.suspicious(F.lit(""), F.lit(False), F.lit(0.0), F.col("text")).alias("suspicious"))


@query("C12_C13_risk_levels", f"""{EV} select case when anomaly_score >= 0.8 then 'critical' when anomaly_score >= 0.6 then 'high' when anomaly_score >= 0.4 then 'medium' else 'low' end as risk,
  case when anomaly_score >= 0.8 then 'critical' when anomaly_score >= 0.6 then 'high' when anomaly_score >= 0.4 then 'medium' when anomaly_score >= 0.2 then 'low' else 'info' end as risk5, count(*) as n from ev group by 1, 2""")
def c12(spark, sf_dir):
    return timeline(spark, sf_dir).groupBy(classify.risk_level(F.col("anomaly_score")).alias("risk"), classify.risk_level5(F.col("anomaly_score")).alias("risk5")).agg(F.count(F.lit(1)).alias("n"))


@query("C14_job_risk", f"{EV} select hostname, case when max(anomaly_score) >= 0.8 then 'critical' when max(anomaly_score) >= 0.6 then 'high' when max(anomaly_score) >= 0.4 then 'medium' else 'low' end as risk from ev where is_anomaly group by hostname")
def c14(spark, sf_dir):
    return timeline(spark, sf_dir).filter("is_anomaly").groupBy("hostname").agg(F.max("anomaly_score").alias("m")).select("hostname", classify.risk_level(F.col("m")).alias("risk"))


@query("C14_job_risk_of_all", f"{EV} select description, case when max(anomaly_score) filter (where is_anomaly) is null then 'info' when max(anomaly_score) filter (where is_anomaly) >= 0.8 then 'critical' when max(anomaly_score) filter (where is_anomaly) >= 0.6 then 'high' else 'low' end as risk from ev group by description")
def c14a(spark, sf_dir):
    """What has no anomaly counts as info."""
    return timeline(spark, sf_dir).groupBy("description").agg(classify.job_risk(F.col("is_anomaly"), F.col("anomaly_score")).alias("risk"))


@query("C15_C16_addresses", """
with ip as (select event_id, (user_id % 256) || '.' || (event_id % 40) || '.1.1' as ip from events)
select event_id, ip, regexp_matches(ip, '^(10\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.|192\\.168\\.|127\\.)') as private, not (starts_with(ip, '10.') or starts_with(ip, '192.168.') or starts_with(ip, '172.') or starts_with(ip, '127.')) as external from ip""")
def c15(spark, sf_dir):
    own = table(spark, sf_dir, "events").select("event_id", text(F.col("user_id") % 256, ".", F.col("event_id") % 40, ".1.1").alias("ip"))
    return own.select("event_id", "ip", classify.is_private(F.col("ip")).alias("private"), classify.is_external(F.col("ip")).alias("external"))


SIGNATURES = [("Root login", r"sshd.*root.*from", "medium"), ("Failed password", r"Failed password.*from 45\.", "high"), ("Firewall block", r"UFW BLOCK", "low")]


@query("C18_signatures", f"{EV} select seq, s.name, s.severity from ev join (values ('Root login', 'sshd.*root.*from', 'medium'), ('Failed password', 'Failed password.*from 45\\.', 'high'), ('Firewall block', 'UFW BLOCK', 'low')) s(name, pattern, severity) on regexp_matches(description, s.pattern)")
def c18(spark, sf_dir):
    return indicators.signature_matches(timeline(spark, sf_dir), SIGNATURES)


# --- normalization -------------------------------------------------------------------------------------------------------


@query("N1_N4_normalized", f"{EV} select seq, event_type, 'syslog' as source, description, false as ts_synthetic from ev")
def n1(spark, sf_dir):
    return timeline(spark, sf_dir).select("seq", "event_type", "source", "description", "ts_synthetic")


@query("N2_event_time", f"select doc_id, case when doc_id % 2 = 0 then {WHEN.format('to_timestamp(doc_id * 1000)')} else '2024-03-01 00:00:00' end as ts from documents")
def n2(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id", normalize.event_time(F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") * 1000), F.lit("2024-03-01T00:00:00")).alias("ts"))
    return own.select("doc_id", when())


@query("N3_inferred_type", "select doc_id, case doc_id % 4 when 0 then 'x' when 1 then 'windows_event' when 2 then 'file_system' else 'unknown' end as kind from documents")
def n3(spark, sf_dir):
    k = F.col("doc_id") % 4
    given = F.when(k == 0, "x").when(k == 1, "log_entry").when(k == 2, "unknown")
    return table(spark, sf_dir, "documents").select("doc_id", normalize.inferred_type(given, F.when(k == 1, F.lit(1)), F.when(k == 2, F.lit(1)), F.lit(None)).alias("kind"))


@query("N5_N6_united", f"{BOTH} select source, count(*) as n, count(description) as n_described from (select 'syslog' as source, description from ev union all select 'files', null from fs) group by source")
def n5(spark, sf_dir):
    both = normalize.united(timeline(spark, sf_dir).select("seq", "source", "description"), files(spark, sf_dir).select("seq", "path", F.lit("files").alias("source")))
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("description").alias("n_described"))


@query("N7_deduplicated", f"{EV} select min(seq) as seq, {WHEN.format('ts')} as ts, event_type from ev group by ts, event_type")
def n7(spark, sf_dir):
    return normalize.deduplicated(timeline(spark, sf_dir), ("ts", "event_type")).select("seq", when(), "event_type")


@query("N8_context", f"{EV} select seq, 'c-1' as case_id, 'x' as analyst from ev")
def n8(spark, sf_dir):
    return normalize.with_context(timeline(spark, sf_dir).select("seq"), case_id="c-1", analyst="x")


@query("N11_partition_summary", f"{FS} select partition, arg_min(filesystem, seq) as filesystem, count(*) as n_events from fs group by partition")
def n11(spark, sf_dir):
    return normalize.partition_summary(files(spark, sf_dir))


# --- features and scores ---------------------------------------------------------------------------------------------------

KEYWORDS = " + ".join(f"cast(contains(m, '{w}') as int)" for w in T.KEYWORDS)


@query("A1_A7_features", f"""{EV}, x as (select *, lower(description) as m from ev)
select seq, cast(hour(ts) as double) as hour, cast(isodow(ts) - 1 as double) as day_of_week, cast(hour(ts) >= 22 or hour(ts) < 6 as double) as is_off_hours, cast(coalesce(s, 1) as double) as event_type_score,
  least(length(m) / 200.0, 5.0)::double as message_length, cast({KEYWORDS} as double) as suspicious_keyword_count, cast(event_type = 'auth_failure' as double) as has_external_ip, 0.0::double as file_size_log
from x left join {SCORES} on et = event_type""")
def a1(spark, sf_dir):
    return scoring.features(timeline(spark, sf_dir)).select("seq", *scoring.FEATURES)


@query("A8_scaling", f"""{EV} select 'hour' as feature, round(avg(hour(ts)), 6) as mean, round(stddev_pop(hour(ts)), 6) as deviation from ev
  union all select 'day_of_week', round(avg(isodow(ts) - 1), 6), round(stddev_pop(isodow(ts) - 1), 6) from ev""")
def a8(spark, sf_dir):
    mean, deviation = scoring.scaling(scoring.features(timeline(spark, sf_dir)))
    rows = [(f, round(m, 6), round(d, 6)) for f, m, d in zip(scoring.FEATURES, mean, deviation, strict=True) if f in ("hour", "day_of_week")]
    return spark.createDataFrame(rows, "feature string, mean double, deviation double")


@query("A9_A10_isolation_forest")
def a9(spark, sf_dir):
    rows = scoring.features(timeline(spark, sf_dir).drop("anomaly_score", "is_anomaly"))
    return scoring.isolation_scores(rows).select("seq", "event_type", F.round("anomaly_score", 6).alias("anomaly_score"), "is_anomaly")


@query("A11_min_max", "select event_id, round((max(value) over () - value) / (max(value) over () - min(value) over ()), 9) as score from events")
def a11(spark, sf_dir):
    return scoring.min_max(table(spark, sf_dir, "events"), "value", "score").select("event_id", F.round("score", 9).alias("score"))


@query("A12_top_anomalies", f"{EV} select seq, anomaly_score::double as anomaly_score from ev order by anomaly_score desc, seq limit 10")
def a12(spark, sf_dir):
    return views.top_by_score(timeline(spark, sf_dir), 10).select("seq", "anomaly_score")


@query("A13_explanations", f"""{EV}, x as (select *, lower(description) as m from ev)
select seq, coalesce(nullif(concat_ws(' | ', case when hour(ts) >= 22 or hour(ts) < 6 then 'off hours (' || lpad(hour(ts)::varchar, 2, '0') || ':00)' end,
  case when event_type in ('auth_failure', 'privilege_escalation') then 'highly suspicious type: ' || event_type when event_type = 'firewall_drop' then 'suspicious type: ' || event_type end,
  case when event_type = 'auth_failure' then 'keywords: failed' end), ''), 'statistical deviation') as why from x""")
def a13(spark, sf_dir):
    return timeline(spark, sf_dir).select("seq", scoring.explanation().alias("why"))


@query("A14_anomalies", f"{EV} select seq, event_type from ev where is_anomaly")
def a14(spark, sf_dir):
    return timeline(spark, sf_dir).filter("is_anomaly").select("seq", "event_type")


# --- ATT&CK ------------------------------------------------------------------------------------------------------------------


@query("M1_techniques", f"{EV} select seq, id, name, tactic from ev join {TECH} on et = event_type")
def m1(spark, sf_dir):
    return timeline(spark, sf_dir).select("seq", F.explode(attack.techniques_of(F.col("event_type"))).alias("t")).select("seq", "t.*")


@query("M2_mode_filter", f"{EV} select seq, id from ev join {TECH} on et = event_type where tactic in {tuple(T.ATTACKER_TACTICS)}")
def m2(spark, sf_dir):
    return timeline(spark, sf_dir).select("seq", F.explode(attack.techniques_of(F.col("event_type"), mode="attacker_infra")).alias("t")).select("seq", "t.id")


@query("M3_enriched", f"""{EV} select seq, count(id) as n_techniques, count(distinct tactic) as n_tactics, coalesce(bool_or(tactic in {tuple(T.ATTACKER_TACTICS)}), false) as is_attacker_infra
  from ev left join {TECH} on et = event_type group by seq""")
def m3(spark, sf_dir):
    out = attack.enriched(timeline(spark, sf_dir))
    return out.select("seq", F.size("mitre_techniques").cast("long").alias("n_techniques"), F.size("mitre_tactics").cast("long").alias("n_tactics"), "is_attacker_infra")


@query("M4_tactic_counts", f"{EV} select tactic, count(*) as n from ev join {TECH} on et = event_type group by tactic")
def m4(spark, sf_dir):
    return attack.tactic_counts(timeline(spark, sf_dir))


@query("M5_technique_counts", f"{EV} select id, min(name) as name, min(tactic) as tactic, count(*) as n from ev join {TECH} on et = event_type group by id")
def m5(spark, sf_dir):
    return attack.technique_counts(timeline(spark, sf_dir))


#: Types of the engine for those of the benchmark's events.
ENGINE_TYPES = {"view": "c2_beacon", "click": "file_download", "purchase": "vpn_connection", "signup": "auth_success", "error": "data_exfiltration"}


@query("M6_infra_buckets", f"with e as (select case event_type {' '.join(f"when '{k}' then '{v}'" for k, v in ENGINE_TYPES.items())} end as t from events) " + " union all ".join(f"select '{b}' as bucket, count(*) as n from e where t in {tuple(t)}" for b, t in T.INFRA_BUCKETS.items()))
def m6(spark, sf_dir):
    own = table(spark, sf_dir, "events").withColumn("event_type", classify.first_of([(F.col("event_type") == k, v) for k, v in ENGINE_TYPES.items()], F.lit(None).cast("string")))
    return attack.infra_buckets(own)


CHAIN = values([(i, t) for i, t in enumerate(T.KILL_CHAIN)], "kc(phase, tactic)")
GRAPH = values([(i, t) for i, t in enumerate(T.GRAPH_PHASES)], "kc(phase, tactic)")


@query("M7_kill_chain", f"""{EV} select phase, kc.tactic, kc.tactic in (select tech.tactic from ev join {TECH} on et = event_type) as detected, kc.tactic in {tuple(T.ATTACKER_TACTICS)} as is_infra_tactic from {CHAIN}""")
def m7(spark, sf_dir):
    return attack.kill_chain(timeline(spark, sf_dir))


# --- tampering -----------------------------------------------------------------------------------------------------------------


def _short(df: DataFrame) -> DataFrame:
    return df.select("category", "severity", "n_hits", F.size("evidence").cast("long").alias("n_evidence"))


@query("F1_timestomping", f"{FS} select 'timestomping' as category, case when count(*) >= 5 then 'high' else 'medium' end as severity, count(*) as n_hits, least(10, count(*)) as n_evidence from fs where ctime - mtime > 86400 having count(*) > 0")
def f1(spark, sf_dir):
    return _short(findings.timestomping(files(spark, sf_dir)))


@query("F2_log_gaps", f"""{EV}, g as (select hostname, event_type, ts, lag(ts) over (partition by hostname, event_type order by ts) as p, count(*) over (partition by hostname, event_type) as k from ev)
select hostname, event_type, {WHEN.format('p')} as gap_start, {WHEN.format('ts')} as gap_end, epoch(ts) - epoch(p) as seconds from g where k >= 10 and epoch(ts) - epoch(p) >= 3600""")
def f2(spark, sf_dir):
    gaps = findings.log_gaps(timeline(spark, sf_dir), hours=1, by=("hostname", "event_type"))
    return gaps.select("hostname", "event_type", when("gap_start"), when("gap_end"), "seconds")


@query("F2_log_gaps_of_all", f"{EV}, g as (select ts, lag(ts) over (order by ts) as p from ev) select {WHEN.format('p')} as gap_start, {WHEN.format('ts')} as gap_end, epoch(ts) - epoch(p) as seconds from g where epoch(ts) - epoch(p) >= 21600")
def f2a(spark, sf_dir):
    return findings.log_gaps(timeline(spark, sf_dir)).select(when("gap_start"), when("gap_end"), "seconds")


@query("F3_identical_seconds", f"select {WHEN.format("date_trunc('month', o_orderdate)")} as second, count(*) as n from orders group by 1 having count(*) >= 20")
def f3(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select(F.date_trunc("MONTH", F.col("o_orderdate").cast("timestamp")).alias("ts"))
    return findings.identical_seconds(own).select(when("second"), "n")


TOOLS = ["shred -u x", "dd if=/dev/zero of=/x", "cat /dev/null > /var/log/a", "journalctl --vacuum", "date", "hwclock -w", "insmod /tmp/x.ko", "rm -rf /tmp/x", "ls"]


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that run a fixed set of commands in turn."""
    own = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.element_at(F.array(*map(F.lit, TOOLS)), (F.col("event_id") % len(TOOLS) + 1).cast("int")).alias("description"))
    return own.withColumn("path", F.lit(""))


def _tools(category: str, severity: str, *which: int, k: int = 10) -> str:
    return f"select '{category}' as category, '{severity}' as severity, count(*) as n_hits, least({k}, count(*)) as n_evidence from events where event_id % {len(TOOLS)} in ({', '.join(map(str, which))}) having count(*) > 0"


@query("F3_identical_seconds_of_events", f"with s as (select date_trunc('hour', ts) as second from events) select {WHEN.format('second')} as second, count(*) as n from s group by 1 having count(*) >= 20")
def f3e(spark, sf_dir):
    """Events whose clock stood still for an hour each."""
    t = F.col("ts").cast("timestamp")
    own = table(spark, sf_dir, "events").select((F.unix_seconds(t) - F.unix_seconds(t) % 3600).alias("s"))
    return findings.identical_seconds(own.select(F.timestamp_seconds("s").alias("ts"))).select(when("second"), "n")


@query("F13_timestamps", """
with f as (select event_id, event_id % 7 as k, ts from events)
select event_id, case when k in (0, 3) then strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') when k = 1 then strftime(date_trunc('second', ts) - interval 2 hour, '%Y-%m-%d %H:%M:%S') when k = 2 then strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S')
  when k = 4 then strftime(ts, '%Y-%m-%d 00:00:00') end as ts from f""")
def f13(spark, sf_dir):
    """Times in forms that are taken (a date, two with a time, one with a zone, one with a fraction and a zone) and two that aren't."""
    t, k = F.date_trunc("SECOND", F.col("ts").cast("timestamp")), F.col("event_id") % 7
    at = lambda p: F.date_format(t, p)
    raw = classify.first_of([(k == 0, at("yyyy-MM-dd'T'HH:mm:ss")), (k == 1, text(at("yyyy-MM-dd'T'HH:mm:ss"), "+0200")), (k == 2, text(at("yyyy-MM-dd'T'HH:mm:ss"), ".5Z")), (k == 3, at("yyyy-MM-dd HH:mm:ss")), (k == 4, at("yyyy-MM-dd")), (k == 5, text(at("yyyy-MM-dd'T'HH:mm:ss"), ".123456+00:00"))], "nan")
    own = table(spark, sf_dir, "events").select("event_id", parse.any_time(raw).alias("ts"))
    return own.select("event_id", when())


@query("F4_wipe_tools", _tools("wipe_tools", "high", 0, 1))
def f4(spark, sf_dir):
    return _short(findings.wipe_tools(commands(spark, sf_dir)))


@query("F5_log_clearing", _tools("log_clearing", "high", 2, 3))
def f5(spark, sf_dir):
    return _short(findings.log_clearing(commands(spark, sf_dir)))


@query("F6_time_tools", _tools("time_manipulation", "medium", 4, 5))
def f6(spark, sf_dir):
    return _short(findings.time_tools(commands(spark, sf_dir)))


@query("F7_rootkits", _tools("rootkit", "high", 6))
def f7(spark, sf_dir):
    return _short(findings.rootkits(commands(spark, sf_dir)))


@query("F8_truncated_logs", f"{FS} select 'truncated_logs' as category, 'medium' as severity, count(*) as n_hits, least(15, count(*)) as n_evidence from fs where size = 0 having count(*) > 0")
def f8(spark, sf_dir):
    return _short(findings.truncated_logs(files(spark, sf_dir)))


@query("F9_deletions", _tools("suspicious_deletions", "high", 7))
def f9(spark, sf_dir):
    return _short(findings.deletions(commands(spark, sf_dir)))


_FOUND = " union all ".join([_tools("wipe_tools", "high", 0, 1), _tools("log_clearing", "high", 2, 3), _tools("time_manipulation", "medium", 4, 5), _tools("rootkit", "high", 6), _tools("suspicious_deletions", "high", 7), "select 'truncated_logs', 'medium', count(*), least(15, count(*)) from fs where size = 0 having count(*) > 0"])


#: What the checks find in the timeline and the files.
_FOUND_IN_EVENTS = """select 'timestomping' as category, case when count(*) >= 5 then 'high' else 'medium' end as severity, count(*) as n_hits from fs where ctime - mtime > 86400 having count(*) > 0
  union all select 'truncated_logs', 'medium', count(*) from fs where size = 0 having count(*) > 0
  union all select 'identical_timestamps', 'medium', count(*) from (select ts from ev group by ts having count(*) >= 20) having count(*) > 0
  union all select 'log_gap', case when count(*) > 1 then 'high' else 'medium' end, count(*) from (select ts, lag(ts) over (order by ts) as p from ev) where epoch(ts) - epoch(p) >= 21600 having count(*) > 0"""


@query("F10_F12_risk", f"""{FS}, f as ({_FOUND}), r as (select cast(least(100, sum(case severity when 'high' then 20 when 'medium' then 10 else 5 end)) as bigint) as risk_score, count(*) as n_findings, string_agg(category, ',' order by category) as categories from f)
select risk_score, n_findings, case when risk_score >= 60 then 'critical' when risk_score >= 40 then 'high' when risk_score >= 20 then 'medium' when risk_score > 0 then 'low' else 'none' end as risk_level, categories from r""")
def f10(spark, sf_dir):
    e = commands(spark, sf_dir)
    parts = [findings.wipe_tools(e), findings.log_clearing(e), findings.time_tools(e), findings.rootkits(e), findings.deletions(e), findings.truncated_logs(files(spark, sf_dir))]
    return findings.risk(normalize.united(*parts)).select("risk_score", "n_findings", "risk_level", F.array_join("categories", ",").alias("categories"))


@query("F0_all_findings", f"""{FS}, c as ({_FOUND} union all select 'timestomping', case when count(*) >= 5 then 'high' else 'medium' end, count(*), least(10, count(*)) from fs where ctime - mtime > 86400 having count(*) > 0),
sec as (select date_trunc('second', ts) as s, count(*) as n from events group by 1 having count(*) >= 20), g as (select ts, lag(ts) over (order by ts) as p from events),
t as (select 'log_gap' as category, case when count(*) > 1 then 'high' else 'medium' end as severity, count(*) as n_hits, least(5, count(*)) as n_evidence from g where epoch(ts) - epoch(p) >= 21600 having count(*) > 0
  union all select 'identical_timestamps', 'medium', count(*), least(5, count(*)) from sec having count(*) > 0)
select * from c union all select * from t where (select count(*) from events) >= 20""")
def f0(spark, sf_dir):
    own = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"))
    return _short(findings.all_findings(commands(spark, sf_dir).join(own, "seq"), files(spark, sf_dir)))


_LEVELS = [("none", 0, "none", 0), ("truncated_logs", 10, "low", 1), ("wipe_tools", 20, "medium", 1), ("time_manipulation,wipe_tools,truncated_logs", 40, "high", 3), ("rootkit,wipe_tools,log_clearing", 60, "critical", 3)]


@query("F10_levels", f"with l(checks, risk_score, risk_level, n_findings) as {values(_LEVELS, '')} select checks, cast(risk_score as bigint) as risk_score, risk_level, cast(n_findings as bigint) as n_findings from l where (select count(*) from events) >= 9 and exists (select 1 from lineitem where l_orderkey % 97 = 0)")
def f10l(spark, sf_dir):
    """All levels of risk, each from the checks named."""
    e = commands(spark, sf_dir)
    made = {"truncated_logs": findings.truncated_logs(files(spark, sf_dir)), "wipe_tools": findings.wipe_tools(e), "time_manipulation": findings.time_tools(e), "rootkit": findings.rootkits(e), "log_clearing": findings.log_clearing(e)}
    parts = []
    for names, *_ in _LEVELS:
        own = [made[n] for n in names.split(",") if n in made] or [made["rootkit"].filter("n_hits < 0")]
        parts.append(findings.risk(normalize.united(*own)).select(F.lit(names).alias("checks"), "risk_score", "risk_level", "n_findings"))
    return normalize.united(*parts)


@query("Y2_Y10_profile_of_a_host", """with e as (select event_id, user_id from events), u as (select 'user' || (user_id % 50) as u, count(*) as n from e group by 1 order by n desc, u limit 20)
select 'linux' as os_type, (select 'host' || (user_id % 3) as h from e group by 1 order by count(*) desc, h limit 1) as hostname, (select '6.1.' || user_id from e where event_id % 50 = 7 order by event_id limit 1) as kernel, (select count(*) from u) as n_users, 'high' as confidence""")
def y10h(spark, sf_dir):
    """A system whose paths, kernel line, packages and users are known."""
    s, u = F.col("event_id"), F.col("user_id")
    own = table(spark, sf_dir, "events").select(s.alias("seq"), F.when(s % 50 == 7, text("Linux version 6.1.", u, " (x)")).otherwise("plain").alias("description"), text("host", u % 3).alias("hostname"), text("user", u % 50).alias("user"), text("pkg", u % 9).alias("package"), F.lit("install").alias("action"), F.lit("/usr/bin/bash").alias("path"), F.lit(None).cast("string").alias("src_ip"))
    on_disk = own.select("seq", text("/x/bin/bash", F.col("seq")).alias("path"))
    return profile.system_profile(own, on_disk).select("os_type", "hostname", "kernel", F.size("users").cast("long").alias("n_users"), "confidence")


# --- system profile --------------------------------------------------------------------------------------------------------------


@query("Y1_os_vote", "select cast(count(distinct case when event_id % 3 = 0 then user_id end) as bigint) as linux, cast(count(distinct case when event_id % 3 = 1 then user_id end) as bigint) as windows, cast(0 as bigint) as macos, case when count(distinct case when event_id % 3 = 0 then user_id end) >= count(distinct case when event_id % 3 = 1 then user_id end) then 'linux' else 'windows' end as os_type from events")
def y1(spark, sf_dir):
    own = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 3 == 0, text("/x/bin/bash", F.col("user_id"))).when(F.col("event_id") % 3 == 1, text("C:\\Windows\\System32\\", F.col("user_id"))).otherwise("/opt").alias("path"))
    return profile.os_vote(own)


@query("Y3_hostname", f"{EV} select hostname, count(*) as n from ev group by hostname order by n desc, hostname limit 1")
def y3(spark, sf_dir):
    return profile.hostname(timeline(spark, sf_dir))


@query("Y4_kernel", "select '6.1.' || user_id as kernel from events where event_id % 50 = 7 order by event_id limit 1")
def y4(spark, sf_dir):
    own = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 50 == 7, text("Linux version 6.1.", F.col("user_id"), " (x)")).otherwise("plain").alias("description"))
    return profile.kernel(own)


@query("Y5_users", f'with {ORDERS} select \'user\' || (c % 50) as "user", count(*) as n from o group by 1 order by n desc, 1 limit 20')
def y5(spark, sf_dir):
    return profile.users(parsed(spark, sf_dir, "pipe", parse.pipe))


@query("Y6_packages", f"""with {ORDERS}, p as (select k, ['install', 'upgrade', 'remove', 'status'][k % 4 + 1] as action, ['nmap', 'vim', 'libc'][k % 3 + 1] || '-' || k || ':amd64' as package from o)
select package, arg_max(action, k) as action, min(k) as first_seq from p group by package order by first_seq limit 100""")
def y6(spark, sf_dir):
    return profile.packages(parsed(spark, sf_dir, "apt", parse.apt).withColumnRenamed("k", "seq"))


@query("Y7_services", "select 'unit' || (user_id % 70) || '.service' as unit, 'service_event' as event_type, min(event_id) as first_seq from events where event_type = 'view' group by 1 order by first_seq limit 50")
def y7(spark, sf_dir):
    own = table(spark, sf_dir, "events").filter("event_type = 'view'").select(F.col("event_id").alias("seq"), F.lit("service_event").alias("event_type"), text("unit", F.col("user_id") % 70, ".service").alias("unit"))
    return profile.services(own)


@query("Y8_addresses", f"{EV}, i as (select unnest(regexp_extract_all(description, '\\b(?:[0-9]{{1,3}}\\.){{3}}[0-9]{{1,3}}\\b')) as ip from ev) select ip, count(*) as n from i where not starts_with(ip, '127.') and not starts_with(ip, '0.') group by ip order by n desc, ip limit 20")
def y8(spark, sf_dir):
    return profile.addresses(timeline(spark, sf_dir))


@query("Y9_suspicious_dirs", "select distinct '/tmp/x' || user_id as path from events where event_id % 7 = 0 order by path limit 30")
def y9(spark, sf_dir):
    own = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 7 == 0, text("/tmp/x", F.col("user_id"))).otherwise("/opt/y").alias("path"))
    return profile.suspicious_dirs(own)


@query("Y2_Y10_profile", f"""{EV}, h as (select hostname from ev group by hostname order by count(*) desc, hostname limit 1)
select 'unknown' as os_type, cast(null as varchar) as distribution, (select hostname from h) as hostname, cast(null as varchar) as kernel, 'low' as confidence""")
def y10(spark, sf_dir):
    return profile.system_profile(timeline(spark, sf_dir), files(spark, sf_dir)).select("os_type", "distribution", "hostname", "kernel", "confidence")


# --- indicators ---------------------------------------------------------------------------------------------------------------------

IOC = f"""{EV}, raw as (
  select 'ips' as category, unnest(regexp_extract_all(description, '\\b(?:[0-9]{{1,3}}\\.){{3}}[0-9]{{1,3}}\\b')) as value, hostname from ev
  union all select 'hostnames', hostname, hostname from ev union all select 'processes', process, hostname from ev
  union all select 'users', 'user' || user_id, hostname from ev where event_type = 'auth_failure'
  union all select 'users', 'name', hostname from ev where event_type = 'user_created'), ioc as (select distinct category, value, hostname from raw)"""


@query("I1_selected", f"{EV} select seq, {WHEN.format('ts')} as ts, event_type as type, description from ev where event_type in {tuple(T.SUSPICIOUS_TYPES)} or is_anomaly or anomaly_score > 0.5 or {WORDS} order by seq limit 1000")
def i1(spark, sf_dir):
    own = timeline(spark, sf_dir).filter(classify.suspicious(F.col("event_type"), F.col("is_anomaly"), F.col("anomaly_score"), F.col("description")))
    return own.orderBy("seq").limit(1000).select("seq", when(), F.col("event_type").alias("type"), "description")


@query("I2_indicators", f"{IOC} select distinct category, value from ioc")
def i2(spark, sf_dir):
    return indicators.extracted(timeline(spark, sf_dir))


@query("I2_document_indicators", """
with raw as (select 'ips' as category, unnest(regexp_extract_all(text, '\\b(?:[0-9]{1,3}\\.){3}[0-9]{1,3}\\b')) as value from documents
  union all select 'domains', unnest(regexp_extract_all(text, '\\b(?:[a-zA-Z0-9-]+\\.)+(?:com|net|org|io|de|ru|cn|info|biz|xyz)\\b')) from documents)
select category, value, count(*) as n from raw where value not in ('127.0.0.1', '0.0.0.0') group by category, value""")
def i2d(spark, sf_dir):
    none = F.lit(None).cast("string")
    found = indicators.indicator_values(F.col("description"), none, none, none, none, none)
    own = doc_events(spark, sf_dir).select(F.explode(found).alias("i")).select("i.*").filter(F.col("category").isin("ips", "domains"))
    return own.groupBy("category", "value").agg(F.count(F.lit(1)).alias("n"))


@query("I3_context_summary", f"{EV} select count(*) as n, count(distinct event_type) as n_types, {WHEN.format('min(ts)')} as first_ts, {WHEN.format('max(ts)')} as last_ts from ev")
def i3(spark, sf_dir):
    return timeline(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_type").alias("n_types"), F.min("ts").alias("a"), F.max("ts").alias("b")).select("n", "n_types", when("a", "first_ts"), when("b", "last_ts"))


@query("I4_prompt_lines", f"""{EV}, l as (select seq, {WHEN.format('ts')} || ' | ' || event_type || ' | ' || description as line from ev), u as (select *, sum(length(line) + 1) over (order by seq) as used from l)
select seq, line, cast(used as bigint) as used from u where used <= 10000""")
def i4(spark, sf_dir):
    return indicators.prompt_lines(timeline(spark, sf_dir))


@query("I5_indicator_count", f"{IOC} select count(distinct value) as n from ioc where category in ('ips', 'domains')")
def i5(spark, sf_dir):
    return indicators.extracted(timeline(spark, sf_dir)).filter(F.col("category").isin("ips", "domains")).agg(F.count(F.lit(1)).alias("n"))


KB = [(1, " 45.155.1.2 ", "Known scanner", "high"), (2, "45.155.1.2", "Later entry", "low"), (3, "45.155.2.3", "Proxy", "medium"), (4, "HOST1", "Owned host", "high"), (5, "192.168.1.1", "Gateway", "low")]


def kb(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KB, "nr int, value string, threat string, confidence string")


@query("I6_I9_lookup", f"""{IOC}, k as (select lower(trim(value)) as v, arg_min(threat, nr) as threat, arg_min(confidence, nr) as confidence from {values(KB, 'kb(nr, value, threat, confidence)')} group by 1), d as (select distinct category, value from ioc)
select category, value, threat, coalesce(confidence, 'unknown') as confidence, case when confidence = 'high' then 'malicious' when confidence is not null then 'suspicious' else 'unknown' end as verdict from d left join k on lower(trim(value)) = v""")
def i6(spark, sf_dir):
    return indicators.looked_up(indicators.extracted(timeline(spark, sf_dir)), kb(spark))


@query("I10_context_matches", f"{EV} select seq, v.value from ev join (values ('45.155.1.2'), ('45.155.2.3'), ('192.168.1.1')) v(value) on contains(lower(description), lower(v.value))")
def i10(spark, sf_dir):
    return indicators.context_matches(timeline(spark, sf_dir), kb(spark).withColumn("value", F.trim("value")).dropDuplicates(["value"]).filter("value <> 'HOST1'"))


_LINE = "'[' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '] ' || event_type || ' (score=' || printf('%.2f', round(anomaly_score, 2)) || ')'"


_IDS: dict[str, list[str]] = {}
for _kind, _id, *_ in T.TECHNIQUES:
    _IDS.setdefault(_kind, []).append(_id)


@query("I12_long_lines", f"""{EV}, m as (select * from {values([(k, ', '.join(v[:3])) for k, v in _IDS.items()], 'm(et, ids)')})
select seq, '[' || seq || '] ' || {_LINE} || ' | host=' || hostname || ' | ' || left(description, 200) || coalesce(' | MITRE: ' || ids, '') as line from ev left join m on et = event_type where is_anomaly""")
def i12l(spark, sf_dir):
    own = timeline(spark, sf_dir).filter("is_anomaly").drop("src_ip", "user")
    return own.select("seq", views.compact_line(own, long=True).alias("line"))


@query("I12_short_lines", f"{EV} select seq, {_LINE} || ' | host=' || hostname || ' | ' || left(description, 150) as line from ev where is_anomaly")
def i12s(spark, sf_dir):
    own = timeline(spark, sf_dir).filter("is_anomaly").drop("src_ip")
    return own.select("seq", views.compact_line(own).alias("line"))


@query("I10_values_of_a_table", f"{EV} select seq, v.value from ev join (select distinct 'User' || c_custkey as value from customer) v on contains(lower(description), lower(v.value))")
def i10t(spark, sf_dir):
    """Values as many as customers, of which one may hold another."""
    own = table(spark, sf_dir, "customer").select(text("User", F.col("c_custkey")).alias("value"))
    return indicators.context_matches(timeline(spark, sf_dir), own)


@query("I12_compact_lines", f"{EV} select seq, event_type || ' | ' || hostname || ' | ' || left(description, 60) as line from ev where is_anomaly")
def i12(spark, sf_dir):
    return timeline(spark, sf_dir).filter("is_anomaly").select("seq", F.concat_ws(" | ", "event_type", "hostname", F.left("description", F.lit(60))).alias("line"))


@query("X1_shared_indicators", f"{IOC} select category, value, count(distinct hostname) as n_sources, string_agg(distinct hostname, ',' order by hostname) as sources from ioc group by category, value having count(distinct hostname) >= 2")
def x1(spark, sf_dir):
    own = timeline(spark, sf_dir).withColumn("job", F.col("hostname"))
    return indicators.shared(indicators.extracted(own, "job"), "job").withColumn("sources", F.array_join("sources", ","))


@query("X2_X5_combined_techniques", f"{EV} select id, count(*) as n, count(distinct hostname) as n_sources from ev join {TECH} on et = event_type where is_anomaly group by id order by n desc, id limit 20")
def x5(spark, sf_dir):
    own = timeline(spark, sf_dir).filter("is_anomaly").select("hostname", F.explode(attack.techniques_of(F.col("event_type"))).alias("t"))
    return own.groupBy("t.id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("hostname").alias("n_sources")).orderBy(F.desc("n"), "id").limit(20)


@query("X2_technique_list", f"{EV}, s as (select distinct hostname from ev where is_anomaly), i as (select hostname, row_number() over (order by hostname) - 1 as source_idx from s) select source_idx, id as technique_id, name as technique_name, tactic, {WHEN.format('ts')} as ts, event_type, seq from ev join i using (hostname) join {TECH} on et = event_type where is_anomaly")
def x2(spark, sf_dir):
    own = views.technique_list(timeline(spark, sf_dir).filter("is_anomaly"), "hostname")
    return own.select(F.col("source_idx").cast("long").alias("source_idx"), "technique_id", "technique_name", "tactic", when(), "event_type", "seq")


@query("X3_X6_source_summary", f"{EV} select hostname, count(*) as n_events, count(*) filter (where is_anomaly) as n_anomalies, round(max(anomaly_score), 3)::double as top_score from ev group by hostname")
def x6(spark, sf_dir):
    return timeline(spark, sf_dir).groupBy("hostname").agg(F.count(F.lit(1)).alias("n_events"), F.count_if("is_anomaly").alias("n_anomalies"), F.round(F.max("anomaly_score"), 3).alias("top_score"))


@query("X4_top_per_source", f"{EV} select hostname, seq, row_number() over (partition by hostname order by anomaly_score desc, seq) as nr from ev qualify nr <= 5")
def x4(spark, sf_dir):
    return views.top_per_source(timeline(spark, sf_dir), "hostname").select("hostname", "seq", F.col("nr").cast("long").alias("nr"))


def cases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    own = o.filter("o_custkey % 2 = 0").groupBy(F.col("o_custkey").alias("case_id")).agg(F.collect_list("o_orderkey").alias("job_ids"))
    jobs = o.select(F.col("o_orderkey").alias("job_id"), text("log", F.col("o_orderkey") % 100, ".txt").alias("filename"))
    return own.select("case_id", text("Case ", F.col("case_id")).alias("name"), text("N-", F.col("case_id") % 10).alias("case_number"), "job_ids"), jobs


@query("X7_case_jobs", "select o_custkey as case_id, o_orderkey as job_id from orders where o_custkey % 2 = 0")
def x7(spark, sf_dir):
    return indicators.case_jobs(*cases(spark, sf_dir))


@query("X7_unassigned_jobs", "select o_orderkey as job_id, 'log' || (o_orderkey % 100) || '.txt' as filename from orders where o_custkey % 2 <> 0")
def x7u(spark, sf_dir):
    return indicators.unassigned(*cases(spark, sf_dir))


@query("X8_find_cases", "select o_custkey as case_id from orders where o_custkey % 2 = 0 group by o_custkey having bool_or(contains('log' || (o_orderkey % 100) || '.txt', 'log42')) or contains('case ' || o_custkey, 'log42')")
def x8(spark, sf_dir):
    return indicators.find_cases(*cases(spark, sf_dir), "LOG42").select("case_id")


@query("X9_case_with_job", "select o_custkey as case_id, count(*) + case when o_custkey = 2 then 1 else 0 end as n_jobs from orders where o_custkey % 2 = 0 group by o_custkey")
def x9(spark, sf_dir):
    own, _ = cases(spark, sf_dir)
    once = indicators.with_job(indicators.with_job(own, 2, -1), 2, -1)
    return once.select("case_id", F.size("job_ids").cast("long").alias("n_jobs"))


@query("X10_near_in_time", f"""{EV}, x as (select seq, ts, process as source, hostname || user_id as value from ev where event_type in ('auth_failure', 'user_created'))
select a.seq as seq_a, b.seq as seq_b, a.value from x a join x b on a.value = b.value and a.source < b.source and abs(epoch(a.ts) - epoch(b.ts)) <= 3600""")
def x10(spark, sf_dir):
    own = timeline(spark, sf_dir).filter("event_type in ('auth_failure', 'user_created')").withColumn("value", F.concat("hostname", F.regexp_extract("description", r"user(\d+)", 1)))
    return indicators.near_in_time(own, "value", "process", 3600)


# --- provenance -----------------------------------------------------------------------------------------------------------------------


@query("V1_V2_provenance", f"""{EV}, {EVIDENCE} select row_number() over (order by seq) as nr, seq, hostname || '.log' as evidence_file, left(sha256, 16) || '...' as sha256_short, left(md5, 16) || '...' as md5_short, hostname || '.log' as found_in_file,
  'Zeile: ' || seq || ' | Host: ' || hostname as location_detail, 'Log-Parser' as extracted_by, round(anomaly_score, 3)::double as anomaly_score, event_type, left(description, 120) as description from ev join hashed using (hostname) where is_anomaly""")
def v1(spark, sf_dir):
    return evidence.provenance(with_files(timeline(spark, sf_dir).filter("is_anomaly")), host_digests(spark, sf_dir))


@query("V3_file_digests", f"with {EVIDENCE} select hostname || '.log' as file, size, md5, sha256 from hashed")
def v3f(spark, sf_dir):
    return host_digests(spark, sf_dir)


@query("V3_dual_hash", "select doc_id, md5(text) as md5, sha256(text) as sha256 from documents")
def v3(spark, sf_dir):
    return evidence.dual_hash(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").drop("text")


@query("V4_V5_verified", "select doc_id, doc_id % 3 <> 0 as md5_match, doc_id % 5 <> 0 as sha256_match, doc_id % 3 <> 0 and doc_id % 5 <> 0 as intact from documents")
def v4(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = evidence.dual_hash(d, "text").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "x").otherwise(F.col("md5")).alias("md5"), F.when(F.col("doc_id") % 5 == 0, "x").otherwise(F.upper("sha256")).alias("sha256"))
    return evidence.verified(d, stored, "doc_id", "text")


@query("V6_audit_entries", "select event_type as event, count(*) as n, sum(user_id)::bigint as users from events group by event_type")
def v6(spark, sf_dir):
    entry = evidence.audit_entry(F.col("ts"), F.col("event_type"), user=F.col("user_id"))
    own = table(spark, sf_dir, "events").select(entry.alias("e"))
    return own.groupBy("e.event").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("e.details")["user"].cast("long")).alias("users"))


# --- views -------------------------------------------------------------------------------------------------------------------------------


@query("Q1_hourly", f"{EV} select {WHEN.format("date_trunc('hour', ts)")} as hour, count(*) as n, count(*) filter (where is_anomaly) as n_anomalies from ev group by 1")
def q1(spark, sf_dir):
    return views.hourly(timeline(spark, sf_dir)).select(when("hour"), "n", "n_anomalies")


@query("Q1_hourly_by_type_and_host", f"{EV} select {WHEN.format("date_trunc('hour', ts)")} as hour, event_type, hostname, count(*) as n from ev group by 1, 2, 3")
def q1b(spark, sf_dir):
    return timeline(spark, sf_dir).groupBy(F.date_trunc("HOUR", "ts").alias("hour"), "event_type", "hostname").agg(F.count(F.lit(1)).alias("n")).select(when("hour"), "event_type", "hostname", "n")


@query("Q2_scatter", f"{EV}, h as (select date_trunc('hour', ts) as hour, count(*) as n from ev group by 1) select seq, n as n_hour, round(anomaly_score * 100, 1)::double as percent from ev join h on h.hour = date_trunc('hour', ts) where is_anomaly")
def q2(spark, sf_dir):
    return views.scatter(timeline(spark, sf_dir))


@query("Q3_phases", f"with {ORDERS}, t as (select distinct ['auth_failure', 'c2_beacon', 'data_exfiltration', 'scheduled_task', 'account', 'web_admin'][k % 6 + 1] as event_type from o), p(event_type, phase) as (values {', '.join(map(str, [(k.lower(), v) for k, v in T.PHASES.items()]))}) select distinct phase from t join p using (event_type)")
def q3(spark, sf_dir):
    kinds = F.array(*map(F.lit, ("auth_failure", "c2_beacon", "data_exfiltration", "scheduled_task", "account", "web_admin")))
    return views.phases(lines(spark, sf_dir, "pipe").select(F.element_at(kinds, (F.col("k") % 6 + 1).cast("int")).alias("event_type")))


IPS = f"{EV}, i as (select regexp_extract(description, '(?:from|to)\\s+(\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}})', 1) as ip, * from ev)"


@query("Q4_external_ips", f"{IPS} select ip, count(*) as n, max(anomaly_score)::double as max_score from i where ip <> '' group by ip order by max_score desc, n desc, ip limit 8")
def q4(spark, sf_dir):
    return views.external_ips(timeline(spark, sf_dir))


@query("Q5_summary_bar", f"""{IPS} select count(*) as n, count(distinct nullif(ip, '')) as n_external, count(*) filter (where anomaly_score >= 0.8) as n_critical, max(anomaly_score)::double as top_score,
  (select {WHEN.format("date_trunc('hour', ts)")} from ev order by anomaly_score desc, seq limit 1) as top_hour from i""")
def q5(spark, sf_dir):
    return views.summary_bar(timeline(spark, sf_dir)).select("n", "n_external", "n_critical", "top_score", when("top_hour"))


@query("Q6_critical_pins", f"{EV} select seq, event_type from ev where anomaly_score >= 0.8 order by anomaly_score desc, seq limit 3")
def q6(spark, sf_dir):
    return views.top_by_score(timeline(spark, sf_dir), 3, 0.8).select("seq", "event_type")


@query("Q7_event_page", f"{EV} select seq, event_type, description from ev where contains(lower(description), 'user1') or contains(event_type, 'user1') order by description desc, seq limit 25 offset 25")
def q7(spark, sf_dir):
    return views.event_page(timeline(spark, sf_dir), "user1", "description", True, 1).select("seq", "event_type", "description")


@query("Q8_partitions", f"{FS} select partition, count(*) as n from fs group by partition")
def q8(spark, sf_dir):
    return views.counts_by(files(spark, sf_dir), "partition")


@query("Q9_types", f"{EV} select event_type, count(*) as n from ev group by event_type")
def q9(spark, sf_dir):
    return views.counts_by(timeline(spark, sf_dir), "event_type")


@query("Q10_kill_chain_rollup", f"""{EV}, t as (select tech.tactic, count(*) as n, count(distinct id) as n_techniques from ev join {TECH} on et = event_type where is_anomaly group by 1),
r as (select phase, kc.tactic, coalesce(n, 0) as n, coalesce(n_techniques, 0) as n_techniques from {GRAPH} left join t on t.tactic = kc.tactic)
select phase, tactic, n, n_techniques, round(case when n > 0 then greatest(0.3, n / max(n) over ()) else 0.0 end, 9)::double as intensity from r""")
def q10(spark, sf_dir):
    return attack.kill_chain_rollup(timeline(spark, sf_dir).filter("is_anomaly")).withColumn("intensity", F.round("intensity", 9))


@query("Q11_tactic_split", f"{EV} select tactic, count(*) as n, case when tactic in {tuple(T.ATTACKER_TACTICS)} then 'attacker' else 'victim' end as side from ev join {TECH} on et = event_type where is_anomaly group by tactic")
def q11(spark, sf_dir):
    return views.tactic_split(timeline(spark, sf_dir).filter("is_anomaly"))


@query("Q12_infra_anomalies", f"{EV} select seq, event_type from ev where is_anomaly and event_type = 'firewall_drop' order by seq limit 50")
def q12(spark, sf_dir):
    return attack.enriched(timeline(spark, sf_dir).filter("is_anomaly")).filter("is_attacker_infra").orderBy("seq").limit(50).select("seq", "event_type")


@query("Q12_infra_anomalies_by_type", f"""with o as (select o_orderkey as k, ['vpn_connection', 'vpn_disconnect', 'auth_failure', 'vpn_tls_error', 'vpn_event'][o_orderkey % 5 + 1] as t from orders),
a as (select o.k, o.t, coalesce(bool_or(tactic in {tuple(T.ATTACKER_TACTICS)}), false) as infra from o left join {TECH} on et = o.t where o.k % 3 = 0 group by 1, 2)
select k as seq, t as event_type from a where t in {tuple(views.INFRA_VIEW_TYPES)} or infra order by seq limit 50""")
def q12t(spark, sf_dir):
    own = parsed(spark, sf_dir, "openvpn", parse.openvpn).withColumnRenamed("k", "seq").filter("seq % 3 = 0")
    return views.infra_anomalies(own).select("seq", "event_type")


@query("Q13_anomaly_list", f"{EV} select seq, anomaly_score::double as anomaly_score from ev where is_anomaly and event_type in (select et from {TECH} where tactic = 'Credential Access')")
def q13(spark, sf_dir):
    own = attack.enriched(timeline(spark, sf_dir).filter("is_anomaly")).filter(F.array_contains("mitre_tactics", "Credential Access"))
    return own.select("seq", "anomaly_score")


@query("Q14_top_findings", f"{EV} select seq, event_type from ev where is_anomaly order by anomaly_score desc, seq limit 6")
def q14(spark, sf_dir):
    return views.top_by_score(timeline(spark, sf_dir).filter("is_anomaly"), 6).select("seq", "event_type")


@query("Q15_report_table", f"{EV} select seq, event_type, left(description, 80) as description, 'critical' as risk from ev where is_anomaly order by anomaly_score desc, seq limit 30")
def q15(spark, sf_dir):
    return views.report_table(timeline(spark, sf_dir))


@query("Q15_remainder", f"{EV} select greatest(count(*) - 30, 0) as n_more from ev where is_anomaly")
def q15r(spark, sf_dir):
    return views.report_remainder(timeline(spark, sf_dir))


@query("Q16_callouts", f"{EV} select seq, anomaly_score::double as anomaly_score from ev where is_anomaly order by anomaly_score desc, seq limit 3")
def q16(spark, sf_dir):
    return views.top_by_score(timeline(spark, sf_dir).filter("is_anomaly"), 3).select("seq", "anomaly_score")


@query("Q17_technique_table", f"{EV} select id, min(name) as name, min(tactic) as tactic, count(*) as n from ev join {TECH} on et = event_type where is_anomaly group by id")
def q17(spark, sf_dir):
    return attack.technique_counts(timeline(spark, sf_dir).filter("is_anomaly"))


@query("Q18_indicator_list", f"{IOC}, d as (select distinct category, value from ioc) select category, left(value, 80) as value, row_number() over (partition by category order by value) as nr from d qualify nr <= 20")
def q18(spark, sf_dir):
    return views.indicator_list(indicators.extracted(timeline(spark, sf_dir))).withColumn("nr", F.col("nr").cast("long"))


@query("Q19_provenance_table", f"{EV} select seq, hostname || '.log' as evidence_file from ev where is_anomaly order by seq limit 40")
def q19(spark, sf_dir):
    return v1(spark, sf_dir).orderBy("seq").limit(40).select("seq", "evidence_file")


@query("Q20_formatters", """
with d as (select doc_id, n_chars, text, (doc_id % 7) * 700 * (case when doc_id % 3 = 0 then 100 else 1 end) as ms, case when n_chars >= 1024 then 1024 else 1 end as unit from documents)
select doc_id, case when coalesce(n_chars, 0) = 0 then '0 B' else format('{:.1f}', floor(n_chars * 10 / unit::double + 0.5) / 10) || case when unit = 1 then ' B' else ' KB' end end as size,
  (doc_id % 101) || '%' as percent, case when length(text) > 20 then left(text, 20) || '…' else coalesce(text, '') end as short,
  case when ms < 1000 then ms || 'ms' when ms < 60000 then format('{:.1f}s', floor(ms / 100.0 + 0.5) / 10) else (ms // 60000) || 'm ' || (ms % 60000 // 1000) || 's' end as took,
  strftime(to_timestamp(doc_id * 86400), '%d.%m.%Y') as day from d""")
def q20(spark, sf_dir):
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    ms = k % 7 * 700 * F.when(k % 3 == 0, 100).otherwise(1)
    return d.select("doc_id", views.file_size(F.col("n_chars")).alias("size"), views.percent(k % 101 / 100.0).alias("percent"), views.truncated(F.col("text"), 20).alias("short"), views.duration(ms).alias("took"), views.german_date(F.timestamp_seconds(k * 86400)).alias("day"))


# --- results that are written and read back ----------------------------------------------------------------------------------------------


@query("K1_K14_written_results", f"""{BOTH} select 'normalized' as output, count(*) as n from ev union all select 'timeline.csv', count(*) from ev union all select 'files.csv', count(*) from fs
  union all select 'anomalies', count(*) from ev where is_anomaly union all select 'provenance', count(*) from ev where is_anomaly union all select 'system_profile', 1 union all select 'summary', 1 union all select 'jobs', 1 union all select 'stage_times', 10""")
def k1(spark, sf_dir):
    out, n = written(spark, sf_dir), F.count(F.lit(1)).alias("n")
    read = {"normalized": spark.read.parquet, "timeline.csv": spark.read.option("header", True).csv, "files.csv": spark.read.option("header", True).csv}
    return normalize.united(*(read.get(name, spark.read.json)(f"{out}/{name}").agg(n).select(F.lit(name).alias("output"), "n") for name in ("normalized", "timeline.csv", "files.csv", "anomalies", "provenance", "system_profile", "summary", "jobs", "stage_times")))


@query("S13_job_outputs", f"{EV} select 'job-1' as job_id, seq, event_type, description, anomaly_score::double as anomaly_score from ev where is_anomaly")
def s13(spark, sf_dir):
    _, anomalies, _ = results.read_jobs(spark, written(spark, sf_dir), ["job-1", "job-2"])
    return anomalies.select("job_id", "seq", "event_type", "description", "anomaly_score")


@query("K_written_contents", f"""{BOTH}, {EVIDENCE},
f as (select * from ({_FOUND_IN_EVENTS}) where category is not null),
r as (select cast(least(100, coalesce(sum(case severity when 'high' then 20 when 'medium' then 10 else 5 end), 0)) as bigint) as risk, count(*) as n from f)
select 'normalized' as output, 'seq' as item, cast(sum(seq) as varchar) as held from ev
union all select 'normalized', 'metadata', cast(count(distinct process || hostname) as varchar) from ev
union all select 'timeline.csv', 'description', cast(sum(length(description)) as varchar) from ev
union all select 'files.csv', 'size', cast(sum(size) as varchar) from fs
union all select 'findings', category, n_hits || ' ' || severity from f
union all select 'tampering', 'risk', risk || ' ' || n from r
union all select 'summary', 'risk', cast(risk as varchar) from r
union all select 'summary', 'n_anomalies', cast(count(*) as varchar) from ev where is_anomaly
union all select 'anomalies', 'seq', cast(sum(seq) as varchar) from ev where is_anomaly
union all select 'provenance', 'nr', cast(sum(nr * seq) as varchar) from (select seq, row_number() over (order by seq) as nr from ev where is_anomaly)
union all select 'selection', 'seq', cast(sum(seq) as varchar) from (select seq from ev where event_type in {tuple(T.SUSPICIOUS_TYPES)} or is_anomaly or anomaly_score > 0.5 or {WORDS} order by seq limit 1000)
union all select 'indicators', 'ips', cast(count(distinct ip) as varchar) from (select unnest(regexp_extract_all(description, '\\b(?:[0-9]{{1,3}}\\.){{3}}[0-9]{{1,3}}\\b')) as ip from ev)
union all select 'audit', 'analysis_completed', '1'""")
def k_contents(spark, sf_dir):
    """What an analysis has written, read back: sums and values of each output."""
    # places times numbers add up to the cube of the events: beyond 64 bits from about 14 million of them
    out, total = written(spark, sf_dir), lambda c: F.sum((F.col(c) if isinstance(c, str) else c).cast("decimal(38,0)")).cast("string")
    json, csv = spark.read.json, spark.read.option("header", True).csv
    item = lambda df, output, name, value: df.select(F.lit(output).alias("output"), name.alias("item"), value.alias("held"))
    one = lambda df, output, name, value: item(df.agg(value.alias("v")), output, F.lit(name), F.col("v").cast("string"))
    own = spark.read.parquet(f"{out}/normalized")
    found = spark.read.parquet(f"{out}/findings")
    meta = F.concat(F.variant_get("metadata", "$.process", "string"), F.variant_get("metadata", "$.hostname", "string"))
    return normalize.united(
        one(own, "normalized", "seq", total("seq")), one(own, "normalized", "metadata", F.count_distinct(meta)), one(csv(f"{out}/timeline.csv"), "timeline.csv", "description", F.sum(F.length("description"))),
        one(csv(f"{out}/files.csv"), "files.csv", "size", F.sum(F.col("size").cast("long"))), item(found, "findings", F.col("category"), F.concat_ws(" ", F.col("n_hits").cast("string"), "severity")),
        item(json(f"{out}/tampering"), "tampering", F.lit("risk"), F.concat_ws(" ", F.col("risk_score").cast("string"), F.size("findings").cast("string"))), item(json(f"{out}/summary"), "summary", F.lit("risk"), F.col("risk_score").cast("string")),
        item(json(f"{out}/summary"), "summary", F.lit("n_anomalies"), F.col("n_anomalies").cast("string")), one(json(f"{out}/anomalies"), "anomalies", "seq", total("seq")), one(json(f"{out}/provenance"), "provenance", "nr", total(F.col("nr").cast("decimal(19,0)") * F.col("seq").cast("decimal(19,0)"))),
        one(json(f"{out}/selection"), "selection", "seq", total("seq")), one(json(f"{out}/indicators").filter("category = 'ips'"), "indicators", "ips", F.count_distinct("value")), item(json(f"{out}/audit").groupBy("event").count().filter("event = 'analysis_completed'"), "audit", F.col("event"), F.col("count").cast("string")),
    )


@query("N1_metadata", f"{EV} select seq, process, hostname, 'syslog' as source, description as message from ev")
def n1m(spark, sf_dir):
    """Fields that only metadata hold, after a union with a table that has none, a removal of repeats and a write."""
    own = timeline(spark, sf_dir, metadata=True).select("seq", "ts", "description", "metadata")
    both = normalize.united(own.unionByName(own), files(spark, sf_dir).select((-F.col("seq")).alias("seq"), "path"))
    back = stored(normalize.deduplicated(both, ("seq",)), "metadata").filter("seq >= 0")
    return back.select("seq", *(normalize.field(back, c).alias(c) for c in ("process", "hostname", "source", "message")))


@query("I2_indicators_of_metadata", f"{IOC} select distinct category, value from ioc")
def i2m(spark, sf_dir):
    own = timeline(spark, sf_dir, metadata=True).select("description", "metadata")
    return indicators.extracted(own)


REPUTED = "rep as (select '45.155.' || (c_custkey % 200) || '.' || (c_custkey % 250 + 1) as value, c_custkey % 101 as score, cast('2024-01-01' as timestamp) + to_days(cast(c_custkey % 400 as int)) - to_days(200) as at from customer)"


@query("I6_I9_reputations", f"""{EV}, {REPUTED}, i as (select distinct unnest(regexp_extract_all(description, '\\b(?:[0-9]{{1,3}}\\.){{3}}[0-9]{{1,3}}\\b')) as value, ts from ev),
k as (select lower(trim(value)) as v, arg_min(threat, nr) as threat, arg_min(confidence, nr) as confidence from {values(KB, 'kb(nr, value, threat, confidence)')} group by 1),
s as (select i.value, i.ts, arg_max(score, (r.at, score)) as score from i left join rep r on r.value = i.value and r.at <= i.ts and r.at >= i.ts - to_days(90) group by 1, 2)
select value, {WHEN.format('ts')} as ts, threat, cast(score as int) as abuse_score,
  case when confidence = 'high' or score >= 75 then 'high' when confidence = 'medium' or score >= 25 then 'medium' when confidence is not null or score is not null then 'low' else 'unknown' end as confidence,
  case when confidence = 'high' then 'malicious' when confidence is not null then 'suspicious' when score >= 50 then 'malicious' when score >= 25 then 'suspicious' when score is not null then 'clean' else 'unknown' end as verdict
from s left join k on lower(trim(value)) = v""")
def i6r(spark, sf_dir):
    """Addresses with the reputation that held when they were seen."""
    c = F.col("c_custkey")
    rep = table(spark, sf_dir, "customer").select(text("45.155.", c % 200, ".", c % 250 + 1).alias("value"), (c % 101).alias("score"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(c.cast("int") % 400 - 200)).alias("at"))
    seen = indicators.extracted(timeline(spark, sf_dir), "ts").filter("category = 'ips'")
    return indicators.looked_up(seen, kb(spark), rep).select("value", when(), "threat", "abuse_score", "confidence", "verdict")


@query("I1_recent", f"{EV} select seq, {WHEN.format('ts')} as ts, event_type as type, description from ev order by ev.ts desc, seq limit 1000")
def i1r(spark, sf_dir):
    return results.selected(timeline(spark, sf_dir), "recent").select("seq", when(), "type", "description")


@query("I11_infra_indicators", f"""{EV}, a as (select * from ev where is_anomaly and event_type = 'firewall_drop'), i as (select 'ips' as category, unnest(regexp_extract_all(description, '\\b(?:[0-9]{{1,3}}\\.){{3}}[0-9]{{1,3}}\\b')) as value from a union select 'processes', process from a),
r as (select category, value, row_number() over (partition by category order by value) as nr from (select distinct category, value from i)) select category, value from r where nr <= 30 and (category = 'ips' or nr <= 20)""")
def i11(spark, sf_dir):
    return results.infra_indicators(timeline(spark, sf_dir).filter("is_anomaly"))


@query("I11_infra_panel", f"""with {ORDERS}, d as (select '10.8.0.' || (c % 250) as value, min(k) as p from o where k % 5 = 0 group by 1)
select 'ips' as category, row_number() over (order by p) as nr, value from d qualify nr <= 30""")
def i11p(spark, sf_dir):
    return results.infra_panel(parsed(spark, sf_dir, "openvpn", parse.openvpn).withColumnRenamed("k", "seq").filter("event_type = 'vpn_connection'"))


@query("I14_infra_sections", f"""{IOC}, d as (select distinct category, value from ioc), r as (select category, left(value, 80) as value, row_number() over (partition by category order by value) as nr from d qualify nr <= 20),
e as (select seq, {WHEN.format('ts')} || ' | ' || event_type || ' | ' || description as line from ev where event_type in {tuple(T.SUSPICIOUS_TYPES)} or is_anomaly or anomaly_score > 0.5 or {WORDS} order by seq limit 80)
select 'events' as section, seq as nr, line from e union all select category, nr, value from r""")
def i14i(spark, sf_dir):
    return results.prompt_sections(timeline(spark, sf_dir), 80, 20)


@query("I13_infra_or_all", f"{EV} select seq from ev where is_anomaly and event_type = 'scheduled_task'")
def i13(spark, sf_dir):
    # no anomaly of this kind tells of infrastructure, so all are taken
    return results.infra_or_all(timeline(spark, sf_dir).filter("is_anomaly and event_type = 'scheduled_task'")).select("seq")


@query("I14_prompt_sections", f"""{IOC}, d as (select distinct category, value from ioc), r as (select category, left(value, 80) as value, row_number() over (partition by category order by value) as nr from d qualify nr <= 10),
e as (select seq, {WHEN.format('ts')} || ' | ' || event_type || ' | ' || description as line from ev where event_type in {tuple(T.SUSPICIOUS_TYPES)} or is_anomaly or anomaly_score > 0.5 or {WORDS} order by seq limit 100)
select 'events' as section, seq as nr, line from e union all select category, nr, value from r""")
def i14(spark, sf_dir):
    return results.prompt_sections(timeline(spark, sf_dir))


@query("C17_keyword_techniques", "select doc_id, t.id from documents join (values ('password', 'T1110'), ('server', 'T1190'), ('data', 'T1005')) t(word, id) on contains(lower(text), t.word)")
def c17(spark, sf_dir):
    words = {"password": ("T1110", "Brute Force", "Credential Access"), "server": ("T1190", "Exploit Public-Facing Application", "Initial Access"), "data": ("T1005", "Data from Local System", "Collection")}
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(results.keyword_techniques(F.col("text"), words)).alias("t")).select("doc_id", "t.id")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each type an hour on each host."""
    return q1b(spark, sf_dir)
