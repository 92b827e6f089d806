"""Ordered rules that name an event: the first that holds wins. Each is one CASE expression.

Texts that rules search (``m`` a message, ``p`` a process or path) come lower-cased, so that they are lower-cased once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions import tables as T


def has(text: Column, *words: str) -> Column:
    """Whether the text holds any of the words."""
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def first_of(rules: list[tuple[Column, str | Column]], otherwise: str | Column) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    out = None
    for when, label in rules:
        out = F.when(when, lit(label)) if out is None else out.when(when, lit(label))
    return lit(otherwise) if out is None else out.otherwise(lit(otherwise))


def firewall_verdict(m: Column) -> Column:
    return first_of([(has(m, "drop", "block", "reject", "deny"), "firewall_drop"), (has(m, "allow", "accept"), "firewall_allow")], "firewall_event")


def syslog(p: Column, m: Column, message: Column) -> Column:
    """Type of a syslog message by its process and text (about 40 types); ``message``: the text as it is."""
    sshd = first_of([(has(m, "accepted"), "auth_success"), (has(m, "failed", "invalid user", "invalid password", "no matching key", "connection closed by invalid"), "auth_failure"), (has(m, "disconnect"), "ssh_disconnect")], "ssh_event")
    sudo = first_of([(has(m, "incorrect password", "authentication failure"), "sudo_failure"), (has(m, "command not allowed", "user not in sudoers"), "sudo_denied")], "privilege_escalation")
    su = first_of([(has(m, "failed", "incorrect"), "auth_failure")], "privilege_escalation")
    cron = first_of([(has(m, "new") & has(m, "job", "crontab"), "scheduled_task_created")], "scheduled_task")
    systemd = first_of([(has(m, "started", "stopping", "stopped"), "service_event")], "system_event")
    firewall = has(m, "ufw", "iptables") | F.coalesce(message, F.lit("")).contains("SRC=")
    kernel = first_of([(firewall, firewall_verdict(m)), (has(m, "oom", "out of memory"), "system_alert"), (has(m, "syn flood"), "network_attack"), (has(m, "segfault"), "process_crash")], "kernel_event")
    package = first_of([(has(m, "install", "upgrade", "update"), "package_install"), (has(m, "remove", "purge", "erase"), "package_remove")], "package_event")
    pam = first_of([(has(m, "authentication failure", "auth could not"), "auth_failure"), (has(m, "session opened"), "auth_success"), (has(m, "session closed"), "session_closed")], "pam_event")
    return first_of(
        [
            (has(p, "sshd"), sshd),
            (has(p, "sudo"), sudo),
            ((p == "su") | p.startswith("su[") | p.startswith("su "), su),
            (p.isin("cron", "crond", "anacron", "atd"), cron),
            (p.isin("systemd", "systemd[1]"), systemd),
            (has(p, "kernel"), kernel),
            (p.isin("apt", "apt-get", "dpkg", "yum", "dnf", "rpm"), package),
            (has(m, "wget ", "curl ", "/usr/bin/curl", "/usr/bin/wget"), "file_download"),
            (has(m, "chmod ", "chown ", "chgrp "), "permission_change"),
            (has(m, "/etc/shadow", "/etc/passwd", "/etc/sudoers", "cat /etc/", "less /etc/", "more /etc/"), "credential_access"),
            (has(m, "scp ", "rsync ", "sftp ", "ftp ", "exfil"), "data_exfiltration"),
            (has(m, "nc ", "ncat ", "netcat", "nmap ", "masscan"), "network_tool"),
            (has(m, "socat", "proxychains", "tor ", "proxytunnel"), "c2_tool"),
            (has(m, "history -c", 'echo "" >', "truncate", "shred ", "wipe ", "srm ", "unlink"), "anti_forensics"),
            (has(m, "rm -rf /var/log", "rm -rf /tmp", "> /var/log", "rm /var/log"), "log_cleared"),
            (has(m, "useradd", "adduser"), "user_created"),
            (has(m, "usermod", "passwd", "chpasswd"), "account_modification"),
            (has(m, "userdel", "deluser"), "user_deleted"),
            (has(m, "authorized_keys", "id_rsa", ".ssh/"), "ssh_key_modified"),
            (has(m, "crontab -e", "/etc/cron", "/var/spool/cron"), "crontab_modified"),
            (has(m, "/etc/rc.local", "/etc/init.d/", "systemctl enable"), "persistence_mechanism"),
            (has(p, "pam"), pam),
            (has(m, "bash -i", "/dev/tcp/", "/dev/udp/", "mkfifo", "mknod"), "reverse_shell_attempt"),
            (has(m, "base64 -d", "base64 --decode", "python -c", "perl -e", "ruby -e", "php -r"), "code_execution"),
        ],
        "system_event",
    )


def web_request(p: Column, status: Column) -> Column:
    return first_of(
        [
            (has(p, "'", '"', " or ", "union+", "union%20", "select%20", "--", "1=1", "1%3d1"), "sqli_attempt"),
            (has(p, "<script", "%3cscript", "onerror=", "javascript:", "alert("), "xss_attempt"),
            (has(p, "../", "..%2f", "%2e%2e", "..../"), "path_traversal"),
            (has(p, ".php?", "cmd=", "exec=", "system(", "passthru", "shell.php", "webshell"), "webshell_access"),
            (has(p, "/admin", "/login", "/wp-admin", "/.env", "/config", "/passwd", "/shadow", "/etc/", "/.git"), "suspicious_request"),
            (status == 404, "http_error"),
            (status >= 500, "http_server_error"),
            (status >= 400, "http_error"),
        ],
        "http_request",
    )


def iptables_prefix(prefix: Column) -> Column:
    p = F.upper(prefix)
    return first_of([(has(p, "DROP", "REJECT", "DENY", "BLOCK"), "firewall_drop"), (has(p, "ACCEPT", "ALLOW"), "firewall_allow"), (has(p, "FORWARD"), "firewall_forward")], "firewall_event")


#: Numbers of system calls and the event they are.
SYSCALLS = {
    "59": "code_execution", "322": "code_execution", "41": "network_activity", "42": "network_activity", "43": "network_activity",
    "105": "privilege_change", "117": "privilege_change", "2": "file_access", "257": "file_access", "87": "file_deleted", "263": "file_deleted",
    "82": "file_modified", "90": "permission_change", "92": "permission_change", "161": "permission_change",
}


def audit(kind: Column, kv: Column, cmd: Column, exe: Column, result: Column) -> Column:
    """Type of an audit record by its kind and its fields; lower-cased: the command of an EXECVE record, program and result."""
    field = lambda k: F.coalesce(F.try_element_at(kv, F.lit(k)), F.lit(""))
    name = field("name")
    ok = has(result, "success") | (result == "yes")
    call = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in SYSCALLS.items() for x in kv)), field("syscall")), F.lit("system_call"))
    syscall = first_of([(has(exe, "nmap", "masscan", "ncat", "nc "), "network_tool"), (has(exe, "wget", "curl"), "file_download"), (has(exe, "scp", "rsync", "sftp"), "data_exfiltration"), (has(exe, "sudo", "su "), "privilege_escalation")], call)
    execve = first_of(
        [
            (has(cmd, "/bin/bash -i", "/dev/tcp", "/dev/udp", "python -c", "perl -e", "ruby -e"), "reverse_shell_attempt"),
            (has(cmd, "base64 -d", "base64 --decode"), "code_execution"),
            (has(cmd, "history -c", "rm /var/log", "shred "), "anti_forensics"),
            (has(cmd, "useradd", "adduser", "usermod"), "account_modification"),
            (has(cmd, "crontab", "at ", "systemctl enable"), "persistence_mechanism"),
        ],
        "code_execution",
    )
    path = first_of([(has(name, "/etc/shadow", "/etc/passwd"), "credential_access"), (has(name, "/var/log") & has(F.upper(field("nametype")), "DELETE"), "log_cleared"), (has(name, ".ssh"), "ssh_key_modified")], "file_access")
    # a login whose result is a failure is one
    failed = has(result, "fail") | (result == "no")
    return first_of(
        [
            (kind == "SYSCALL", syscall),
            (kind == "EXECVE", execve),
            (kind.isin("USER_AUTH", "USER_ACCT"), first_of([(ok, "auth_success")], "auth_failure")),
            (kind == "USER_LOGIN", first_of([(failed, "auth_failure")], "auth_success")),
            (kind == "USER_LOGOUT", "session_closed"),
            (kind == "USER_CMD", "privilege_escalation"),
            (kind == "SOCKADDR", "network_activity"),
            (kind == "PATH", path),
            (kind == "CONFIG_CHANGE", "audit_config_change"),
            (kind.isin("SERVICE_START", "SERVICE_STOP"), "service_event"),
            (kind == "PROCTITLE", "process_event"),
        ],
        "audit_event",
    )


def attack_package(package: Column) -> Column:
    return has(F.lower(package), *T.ATTACK_PACKAGES)


def package_action(action: Column, package: Column) -> Column:
    put = action.isin("install", "upgrade")
    return first_of([(action.isin("remove", "purge"), "package_remove"), (put & attack_package(package), "suspicious_tool_installed"), (put, "package_install")], "package_event")


def mysql_error(v: Column, m: Column) -> Column:
    """``v``: the level, lower-cased."""
    return first_of(
        [
            (has(m, "access denied"), "auth_failure"),
            (has(m, "aborted connection", "got an error"), "db_connection_error"),
            (has(m, "could not be resolved"), "dns_lookup_failure"),
            (has(m, "table is full", "disk full", "no space"), "system_alert"),
            (v.isin("error", "err"), "db_error"),
            (v == "warning", "db_warning"),
        ],
        "db_event",
    )


def mysql_query(command: Column, m: Column) -> Column:
    query = command == "Query"
    return first_of(
        [
            (query & has(m, "' or ", "' and ", "1=1", "1='1", "drop table", "union select", "information_schema", "sleep(", "benchmark(", "load_file"), "sqli_attempt"),
            (query & has(m, "select * from users", "select password", "select user", "from mysql.user"), "credential_access"),
            (command == "Connect", "db_connect"),
            (command == "Quit", "db_disconnect"),
        ],
        "db_query",
    )


def openvpn(m: Column) -> Column:
    return first_of(
        [
            (has(m, "peer connection initiated", "client connected", "tls: initial packet from"), "vpn_connection"),
            (has(m, "peer connection closed", "connection reset", "client-instance exiting", "connection shutdown"), "vpn_disconnect"),
            (has(m, "auth_failed", "authentication failed"), "auth_failure"),
            (has(m, "tls error", "tls_error", "cannot load certificate"), "vpn_tls_error"),
            (has(m, "ifconfig", "pushed", "ip pool"), "vpn_ip_assigned"),
        ],
        "vpn_event",
    )


def sysmon(event_id: Column, image: Column, command: Column, port: Column) -> Column:
    kinds = {1: "process_create", 3: "network_connect", 5: "process_terminate", 8: "remote_thread_create", 11: "file_create", 22: "dns_query", 23: "file_delete"}  # fixed values
    beacon = (event_id == 3) & port.isin("4444", "4443", "8080", "443", "80") & has(F.lower(image), "bash", "sh", "python", "perl")
    shell = (event_id == 1) & has(F.lower(F.coalesce(command, F.lit(""))), "/dev/tcp", "bash -i", "nc -e", "mkfifo")
    return first_of([(beacon, "c2_beacon"), (shell, "reverse_shell_attempt"), *((event_id == i, k) for i, k in kinds.items())], "sysmon_event")


def suspicious(event_type: Column, is_anomaly: Column, score: Column, text: Column) -> Column:
    """Whether an event is one to look at."""
    return event_type.isin(T.SUSPICIOUS_TYPES) | F.coalesce(is_anomaly, F.lit(False)) | (F.coalesce(score, F.lit(0.0)) > 0.5) | has(F.lower(F.coalesce(text, F.lit(""))), *T.SUSPICIOUS_WORDS)


def risk_level(score: Column) -> Column:
    return first_of([(score >= 0.8, "critical"), (score >= 0.6, "high"), (score >= 0.4, "medium")], "low")


def risk_level5(score: Column) -> Column:
    return first_of([(score >= 0.8, "critical"), (score >= 0.6, "high"), (score >= 0.4, "medium"), (score >= 0.2, "low")], "info")


def job_risk(is_anomaly: Column, score: Column) -> Column:
    """Aggregate: the level of the highest score of anomalies, ``info`` where there are none."""
    top = F.max(F.when(is_anomaly, score))
    return F.when(top.isNull(), "info").otherwise(risk_level(top))


def is_private(ip: Column) -> Column:
    return ip.rlike(T.PRIVATE_IP)


def is_external(ip: Column) -> Column:
    """As in the view: any 172.* counts as internal."""
    return ~(ip.startswith("10.") | ip.startswith("192.168.") | ip.startswith("172.") | ip.startswith("127."))
