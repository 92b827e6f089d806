"""Log lines, timelines and file records rendered from the benchmark tables, so that every operator has an input to run on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import parse
from logloom.operators import results
from logloom.operators.evidence import digests
from logloom.operators.normalize import normalized
from logloom.sources.stored import new_folder

#: Syslog lines carry no year.
YEAR = 2024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def syslog_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, line) of events as syslog."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("t"), F.col("user_id").alias("u"), "event_type")
    u, s = F.col("u"), F.col("seq")
    ip = lambda head: text(head, u % 200, ".", s % 250 + 1)
    said = (
        F.when(F.col("event_type") == "error", text("sshd[", s, "]: Failed password for user", u, " from ", ip("45.155."), " port 22 ssh2"))
        .when(F.col("event_type") == "view", text("kernel: [UFW BLOCK] IN=eth0 OUT= SRC=", ip("10.0."), " DST=192.168.1.1 PROTO=TCP"))
        .when(F.col("event_type") == "purchase", text("sudo: user", u, " : COMMAND=/bin/ls"))
        .when(F.col("event_type") == "click", text("CRON[", s, "]: (user", u, ") CMD (run-parts)"))
        .otherwise(text("useradd: useradd new user name=user", u))
    )
    return e.select("seq", text(F.date_format("t", "MMM d HH:mm:ss"), " host", u % 5, " ", said).alias("line"))


def timeline(spark: SparkSession, sf_dir: str, metadata: bool = False) -> DataFrame:
    """Normalized events of the syslog lines, with a given score; with ``metadata`` their further fields too."""
    lines = parse.with_events(syslog_lines(spark, sf_dir), parse.syslog, year=YEAR).filter("e is not null")
    out = normalized(lines.select("seq", F.col("line").alias("raw_line"), "e.*"), metadata=metadata)
    score = (F.col("seq") * 37 % 1000) / F.lit(1000.0)
    return out.withColumn("anomaly_score", score).withColumn("is_anomaly", score >= 0.9)


#: The same timeline in SQL, straight from the table.
TIMELINE = """
ev as (select event_id as seq, date_trunc('second', ts) as ts, 'host' || (user_id % 5) as hostname, user_id,
  case event_type when 'error' then 'auth_failure' when 'view' then 'firewall_drop' when 'purchase' then 'privilege_escalation'
    when 'click' then 'scheduled_task' else 'user_created' end as event_type,
  case event_type when 'error' then 'sshd' when 'view' then 'kernel' when 'purchase' then 'sudo' when 'click' then 'CRON' else 'useradd' end as process,
  case event_type when 'error' then 'Failed password for user' || user_id || ' from 45.155.' || (user_id % 200) || '.' || (event_id % 250 + 1) || ' port 22 ssh2'
    when 'view' then '[UFW BLOCK] IN=eth0 OUT= SRC=10.0.' || (user_id % 200) || '.' || (event_id % 250 + 1) || ' DST=192.168.1.1 PROTO=TCP'
    when 'purchase' then 'user' || user_id || ' : COMMAND=/bin/ls' when 'click' then '(user' || user_id || ') CMD (run-parts)'
    else 'useradd new user name=user' || user_id end as description,
  (event_id * 37 % 1000) / 1000.0 as anomaly_score, (event_id * 37 % 1000) / 1000.0 >= 0.9 as is_anomaly from events)
"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File records: (seq, path, mtime, ctime, size, partition, filesystem)."""
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    own = l.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    second = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    size = F.when(F.col("l_orderkey") % 97 == 0, 0).otherwise(F.col("l_quantity").cast("long"))
    return own.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), text("/var/log/", F.col("l_orderkey")).alias("path"), second("o_orderdate").alias("mtime"), second("l_shipdate").alias("ctime"), size.cast("long").alias("size"), text("p", F.col("l_linenumber") % 4).alias("partition"), text("fs", F.col("l_linenumber") % 4).alias("filesystem"))


FILES = """
fs as (select l_orderkey * 10 + l_linenumber as seq, '/var/log/' || l_orderkey as path, cast(epoch(o_orderdate) as bigint) as mtime,
  cast(epoch(l_shipdate) as bigint) as ctime, case when l_orderkey % 97 = 0 then 0 else cast(l_quantity as bigint) end as size,
  'p' || (l_linenumber % 4) as partition, 'fs' || (l_linenumber % 4) as filesystem
  from lineitem join orders on l_orderkey = o_orderkey)
"""


#: Syslog lines of every rule (process, message, event type): one for each type and for most ways to it.
SYSLOG_CASES = [
    ("sshd", "Accepted publickey for a", "auth_success"), ("sshd", "Invalid user b from 1.2.3.4", "auth_failure"), ("sshd", "Received disconnect from 1.2.3.4", "ssh_disconnect"), ("sshd", "Server listening on port 22", "ssh_event"),
    ("sudo", "a : 3 incorrect password attempts", "sudo_failure"), ("sudo", "a : user NOT in sudoers", "sudo_denied"), ("sudo", "a : COMMAND=/bin/id", "privilege_escalation"),
    ("su", "FAILED su for root by a", "auth_failure"), ("su", "Successful su for root", "privilege_escalation"), ("cron", "new job in crontab", "scheduled_task_created"), ("crond", "run-parts", "scheduled_task"),
    ("systemd", "Started Session 1", "service_event"), ("systemd", "Reached target", "system_event"), ("kernel", "iptables: REJECT", "firewall_drop"), ("kernel", "[UFW ALLOW] SRC=1.1.1.1", "firewall_allow"), ("kernel", "ufw audit", "firewall_event"),
    ("kernel", "Out of memory: killed", "system_alert"), ("kernel", "possible SYN flood", "network_attack"), ("kernel", "app segfault at 0", "process_crash"), ("kernel", "usb 1-1 new device", "kernel_event"),
    ("dpkg", "upgrade libc", "package_install"), ("rpm", "erase libc", "package_remove"), ("yum", "clean all", "package_event"), ("bash", "wget http://x", "file_download"), ("bash", "chmod 777 /x", "permission_change"),
    ("bash", "cat /etc/shadow", "credential_access"), ("bash", "scp a b", "data_exfiltration"), ("bash", "nmap -sS x", "network_tool"), ("bash", "socat tcp x", "c2_tool"), ("bash", "history -c", "anti_forensics"), ("bash", "rm -rf /var/log", "log_cleared"),
    ("bash", "adduser c", "user_created"), ("bash", "usermod -G x c", "account_modification"), ("bash", "deluser c", "user_deleted"), ("bash", "vi .ssh/x", "ssh_key_modified"), ("bash", "crontab -e", "crontab_modified"),
    ("bash", "vi /etc/rc.local", "persistence_mechanism"), ("pam_unix", "authentication failure", "auth_failure"), ("pam_unix", "session opened for a", "auth_success"), ("pam_unix", "session closed for a", "session_closed"), ("pam_unix", "check pass", "pam_event"),
    ("bash", "bash -i", "reverse_shell_attempt"), ("bash", "base64 -d x", "code_execution"), ("app", "all is well", "system_event"),
]
#: Lines of other formats and the event type each is: of rules that the tables' own lines don't reach.
FORMAT_CASES = {
    "apache_combined": [('9.9.9.9 - - [15/Jan/2025:08:00:01 +0000] "GET %s HTTP/1.1" %s 5' % (path, status), kind) for path, status, kind in (("/?q=<script>", 200, "xss_attempt"), ("/x.php?cmd=id", 200, "webshell_access"), ("/%2e%2e/x", 200, "path_traversal"), ("/a?union+x", 404, "sqli_attempt"), ("/.env", 200, "suspicious_request"), ("/a", 404, "http_error"), ("/a", 503, "http_server_error"), ("/a", 403, "http_error"), ("/a", 200, "http_request"))],
    "audit": [(f"type={kind} msg=audit(1700000000.000:1): {rest}", event) for kind, rest, event in (("EXECVE", 'argc=2 a0="bash" a1="/dev/tcp"', "reverse_shell_attempt"), ("EXECVE", 'argc=2 a0="base64" a1="-d"', "code_execution"), ("EXECVE", 'argc=2 a0="history" a1="-c"', "anti_forensics"), ("EXECVE", 'argc=2 a0="useradd" a1="x"', "account_modification"), ("EXECVE", 'argc=1 a0="crontab"', "persistence_mechanism"), ("EXECVE", 'argc=1 a0="ls"', "code_execution"), ("SYSCALL", 'syscall=59 exe="/usr/bin/nmap"', "network_tool"), ("SYSCALL", 'syscall=59 exe="/usr/bin/curl"', "file_download"), ("SYSCALL", 'syscall=2 exe="/usr/bin/scp"', "data_exfiltration"), ("SYSCALL", 'syscall=59 exe="/usr/bin/sudo"', "privilege_escalation"), ("SYSCALL", "syscall=87", "file_deleted"), ("SYSCALL", "syscall=82", "file_modified"), ("SYSCALL", "syscall=90", "permission_change"), ("SYSCALL", "syscall=105", "privilege_change"), ("USER_LOGIN", "res=failed", "auth_failure"), ("USER_LOGIN", "res=success", "auth_success"), ("USER_LOGOUT", "res=success", "session_closed"), ("USER_CMD", "cmd=x", "privilege_escalation"), ("SOCKADDR", "saddr=1", "network_activity"), ("PATH", 'name="/var/log/x" nametype=DELETE', "log_cleared"), ("CONFIG_CHANGE", "op=set", "audit_config_change"), ("SERVICE_START", "unit=x", "service_event"), ("PROCTITLE", "proctitle=1", "process_event"), ("CWD", "cwd=1", "audit_event"))],
    "apt": [(f"2025-01-15 08:00:01 {action} {package}:amd64 1 2", kind) for action, package, kind in (("install", "masscan", "suspicious_tool_installed"), ("purge", "nmap", "package_remove"), ("configure", "nmap", "package_event"), ("upgrade", "vim", "package_install"))],
    "yum": [(f"Jan 15 08:00:01 {action}: pkg", kind) for action, kind in (("Installed", "package_install"), ("Dep-Installed", "package_install"), ("Erased", "package_remove"), ("Obsoleted", "package_remove"))],
    "mysql_error": [(f"2025-01-15T08:00:01.000000Z {level} {said}", kind) for level, said, kind in (("Warning", "Aborted connection 5", "db_connection_error"), ("Note", "IP address could not be resolved", "dns_lookup_failure"), ("ERROR", "broken", "db_error"), ("Warning", "old", "db_warning"), ("Note", "ready", "db_event"))],
    "openvpn": [(f"Wed Jan 15 08:00:01 2025 10.8.0.1:1194 {said}", kind) for said, kind in (("TLS: Initial packet from x", "vpn_connection"), ("Connection reset, restarting", "vpn_disconnect"), ("cannot load certificate", "vpn_tls_error"), ("PUSHED ifconfig 10.8.0.2", "vpn_ip_assigned"))],
}


def cases_of(spark: SparkSession, sf_dir: str, cases: list[tuple]) -> DataFrame:
    """(seq, line): events as the given lines, in turn; a case is a line, or a process and message, and what is expected of it."""
    made = [c[0] if len(c) == 2 else f"Jan  5 10:00:00 gw {c[0]}[7]: {c[1]}" for c in cases]
    s = F.col("event_id")
    return table(spark, sf_dir, "events").select(s.alias("seq"), F.element_at(F.array(*map(F.lit, made)), (s % len(made) + 1).cast("int")).alias("line"))


def lines(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """(k, line): orders as lines of a log format."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_orderdate").cast("timestamp").alias("d"))
    k, c = F.col("k"), F.col("c")
    o = o.withColumn("t", F.timestamp_seconds(F.unix_seconds("d") + k % 86400))
    at = lambda p: F.date_format("t", p)
    pick = lambda n, *values: F.element_at(F.array(*map(F.lit, values)), (k % n + 1).cast("int"))
    zulu, plain = text(at("yyyy-MM-dd'T'HH:mm:ss"), "Z"), at("yyyy-MM-dd HH:mm:ss")
    micro = text(at("yyyy-MM-dd'T'HH:mm:ss"), ".000000Z")
    made = {
        "syslog_5424": text(zulu, " host", c % 5, " sshd[", k, "]: Accepted password for user", c % 50, " from 10.1.1.", c % 250, " port 22"),
        "access": text("10.0.0.", c % 250, " - ", pick(2, "-", "admin"), " [", at("dd/MMM/yyyy:HH:mm:ss"), ' +0000] "GET ', pick(5, "/index", "/admin/x", "/a?id=1'--", "/../etc", "/p"), "/", k, ' HTTP/1.1" ', pick(7, "200", "404", "500", "403", "200", "200", "301"), " ", F.when(k % 3 == 0, "-").otherwise(k.cast("string")), ' "-" "agent"'),
        "iptables": text(F.lit("Jan 5 10:00:00 gw kernel: [1.5] "), pick(4, "IPTABLES-DROP", "IPT-ACCEPT", "IPT-FORWARD", "IPT-LOG"), ": IN=eth0 OUT= SRC=10.0.0.", c % 250, " DST=8.8.8.8 LEN=60 PROTO=TCP SPT=", k % 60000, " DPT=22 WINDOW=1"),
        "firewall": text(plain, " ", pick(3, "ALLOW", "BLOCK", "DENY"), " TCP 10.0.0.", c % 250, ":", k % 60000, " 8.8.4.4:443 size=", k, " flags=S"),
        "audit": text("type=", pick(3, "USER_AUTH", "SYSCALL", "PATH"), " msg=audit(", F.unix_seconds("t"), ".000:", k, '): uid=', c, ' acct="user', c % 9, '" syscall=', pick(4, "59", "2", "41", "999"), ' name="', pick(5, "/etc/shadow", "/home/a/.ssh/x", "/var/log/a", "/b", "/c"), '" res=', pick(2, "success", "failed"), " uid=0"),
        "journal": F.to_json(F.struct((F.unix_micros("t")).cast("string").alias("__REALTIME_TIMESTAMP"), pick(3, "Started unit", "out of memory", "plain").alias("MESSAGE"), text("host", c % 5).alias("_HOSTNAME"), pick(2, "systemd", "kernel").alias("_COMM"), k.cast("string").alias("_PID"), pick(5, "0", "1", "2", "3", "6").alias("PRIORITY"))),
        "apt": text(plain, " ", pick(4, "install", "upgrade", "remove", "status"), " ", pick(3, "nmap", "vim", "libc"), "-", k, ":amd64 1.", c, " 2.", c),
        "yum": text(zulu, " INFO ", pick(3, "Installed: ", "Erased: ", "refreshing "), "pkg-", k),
        "mysql_error": text(micro, " ", k % 90, " [", pick(3, "Note", "Warning", "Error"), "] [MY-", c, "] [Server] ", pick(4, "Access denied for x", "disk full", "ready", "done")),
        "mysql_general": text(micro, "    ", c, " ", pick(3, "Query", "Connect", "Quit"), " ", pick(4, "select 1", "select password from t", "x' or 1=1", "update t")),
        "openvpn": text(at("EEE MMM d HH:mm:ss yyyy"), " 10.8.0.", c % 250, ":1194 ", pick(5, "Peer Connection Initiated", "client-instance exiting", "AUTH_FAILED", "TLS Error: x", "hello")),
        "pipe": text(plain, "|", pick(3, "AUTH", "WEB", "C2"), "|src", c % 3, "|event ", k, "|host", c % 5, "|user", c % 50),
        "iso": text(zulu, " EventID=", pick(3, "4624", "4625", "4688"), " User=u", c, " User=v", k % 5),
    }
    return o.select("k", "c", "t", made[kind].alias("line"))


ORDERS = "o as (select o_orderkey as k, o_custkey as c, o_orderdate + to_seconds(o_orderkey % 86400) as t from orders)"


def parsed(spark: SparkSession, sf_dir: str, kind: str, parser) -> DataFrame:
    """(k, all fields) of the lines of a format."""
    return parse.with_events(lines(spark, sf_dir, kind), parser, year=YEAR).select("k", "e.*")


def doc_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as free-text events: the source is the job."""
    d = table(spark, sf_dir, "documents")
    none = F.lit(None).cast("string")
    return d.select(F.col("doc_id").alias("seq"), F.col("text").alias("description"), F.col("source").alias("job"), *(none.alias(c) for c in ("user", "process", "hostname", "path", "src_ip")))


def evidence_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder with the syslog lines of each host, in their order, as one file (hostname=.../...)."""
    out = new_folder(spark, "evidence")
    own = syslog_lines(spark, sf_dir).withColumn("hostname", F.regexp_extract("line", " (host[0-9]+) ", 1))
    own.repartition("hostname").sortWithinPartitions("hostname", "seq").select("hostname", "line").write.partitionBy("hostname").text(out)
    return out


#: The same files in SQL: a row for each host with its digests.
EVIDENCE = """
lines as (select event_id as seq, 'host' || (user_id % 5) as hostname, strftime(ts, '%b %-d %H:%M:%S') || ' host' || (user_id % 5) || ' ' ||
  case event_type when 'error' then 'sshd[' || event_id || ']: Failed password for user' || user_id || ' from 45.155.' || (user_id % 200) || '.' || (event_id % 250 + 1) || ' port 22 ssh2'
    when 'view' then 'kernel: [UFW BLOCK] IN=eth0 OUT= SRC=10.0.' || (user_id % 200) || '.' || (event_id % 250 + 1) || ' DST=192.168.1.1 PROTO=TCP'
    when 'purchase' then 'sudo: user' || user_id || ' : COMMAND=/bin/ls' when 'click' then 'CRON[' || event_id || ']: (user' || user_id || ') CMD (run-parts)'
    else 'useradd: useradd new user name=user' || user_id end as line from events),
hashed as (select hostname, md5(t) as md5, sha256(t) as sha256, strlen(t) as size from (select hostname, string_agg(line || chr(10), '' order by seq) as t from lines group by hostname))
"""


def with_files(events: DataFrame) -> DataFrame:
    """Events that name the evidence file of their host and the line in it."""
    return events.withColumn("source_file", F.concat("hostname", F.lit(".log"))).withColumn("line_number", F.col("seq"))


def host_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, size, md5, sha256) of the evidence files, by the names of ``with_files``."""
    own = digests(spark, evidence_files(spark, sf_dir)).filter(F.col("file").contains("hostname=") & (F.col("size") > 0) & ~F.col("file").endswith(".crc"))
    return own.select(F.concat(F.regexp_extract("file", "hostname=([^/]+)/", 1), F.lit(".log")).alias("file"), "size", "md5", "sha256")


def written(spark: SparkSession, sf_dir: str) -> str:
    """The folder in which an analysis of the timeline, by its given scores, has left its results."""
    out = new_folder(spark, "results")
    results.analyse(spark, timeline(spark, sf_dir, metadata=True), files(spark, sf_dir), out, "job-1", score=False)
    return out
