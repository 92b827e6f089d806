"""Parsers of log lines: each gives a struct of the common event fields, or null.

A parser works in steps. It yields columns that later steps take as they are (the groups of a pattern, fields of a record,
lower-cased text) and at last returns the event. ``with_events`` computes the columns of each step once a line; ``event_of``
puts all steps into one expression, for use where a single column is needed.
"""

from __future__ import annotations

from collections.abc import Callable, Generator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions import classify

#: Fields of a parsed event, with their types.
FIELDS = {
    "ts": "timestamp", "event_type": "string", "source": "string", "message": "string", "hostname": "string", "process": "string",
    "pid": "string", "user": "string", "src_ip": "string", "dst_ip": "string", "src_port": "string", "dst_port": "string",
    "method": "string", "path": "string", "status": "int", "size": "bigint", "action": "string", "package": "string",
    "extra": "map<string,string>",
}
EVENT = ", ".join(f"{k}: {v}" for k, v in FIELDS.items())

Steps = Generator[tuple[Column, ...], tuple[Column, ...], Column]
Parser = Callable[[Column, int], Steps]

_SEP = "\x01"


def groups(line: Column, pattern: str, n: int) -> Column:
    """The n groups of a pattern that spans the line, or null; groups that took no part are empty.

    They are taken in one pass of the pattern: the match is rewritten with a separator between groups, then split.
    """
    whole = F.regexp_replace(line, f"^(?:{pattern})$", _SEP.join(f"${i}" for i in range(1, n + 1)))
    parts = F.split(whole, _SEP, -1)
    return F.when(F.size(parts) == n, parts) if n > 1 else F.when(line.rlike(f"^(?:{pattern})$"), parts)


def event(**given: Column) -> Column:
    """A struct of all fields; those that aren't given are null."""
    return F.struct(*((given[k] if k in given else F.lit(None)).cast(v).alias(k) for k, v in FIELDS.items()))


def some(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def stamp(text: Column, pattern: str) -> Column:
    return F.try_to_timestamp(text, F.lit(pattern))


#: A time as text: a date, with a time of day after T or a blank, the former with a fraction and a zone if both are there, or a zone.
TIME_TEXT = r"(\d{4})-(\d{1,2})-(\d{1,2})(?:T(\d{1,2}):(\d{1,2}):(\d{1,2})(?:(?:\.(\d{1,6}))?(Z|[+-]\d{2}:?\d{2}))?|\s+(\d{1,2}):(\d{1,2}):(\d{1,2}))?"


def any_time(raw: Column) -> Column:
    """A time from text in one of five forms, of which the first 26 characters count; without a zone it is UTC, anything else null.

    So a fraction of six digits leaves no room for a zone, and such a time is null.
    """
    cut = F.left(F.trim(raw.cast("string")), F.lit(26))
    part = lambda i: F.regexp_extract(cut, f"^(?:{TIME_TEXT})$", i)
    two = lambda *i: F.lpad(F.coalesce(*(F.nullif(part(j), F.lit("")) for j in i), F.lit("00")), 2, "0")
    zone = F.regexp_replace(F.coalesce(F.nullif(part(8), F.lit("")), F.lit("Z")), r"^([+-]\d{2}):?(\d{2})$", "$1:$2")
    fraction = F.coalesce(F.nullif(part(7), F.lit("")), F.lit("0"))
    return F.concat(part(1), F.lit("-"), two(2), F.lit("-"), two(3), F.lit("T"), two(4, 9), F.lit(":"), two(5, 10), F.lit(":"), two(6, 11), F.lit("."), fraction, zone).try_cast("timestamp")


def iso(text: Column) -> Column:
    return text.try_cast("timestamp")


def lowered(x: Column) -> Column:
    return F.lower(F.coalesce(x, F.lit("")))


def _when(g: Column, out: Column) -> Column:
    return F.when(g.isNotNull(), out)


# The lines that each format accepts.
SYSLOG_3164 = r"(\w{3})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})\s+(\S+)\s+([^\[:]+)(?:\[(\d+)\])?:\s*(.+)"
SYSLOG_5424 = r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:[+-]\d{2}:\d{2}|Z)?)\s+(\S+)\s+([^\[:]+)(?:\[(\d+)\])?:\s*(.+)"
APACHE = r'(\S+)\s+\S+\s+(\S+)\s+\[([^\]]+)\]\s+"([A-Z]+)\s+(\S+)\s+\S+"\s+(\d+)\s+(\d+|-).*'
IPTABLES_HEAD = r"(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+.*"
IPTABLES = r".*?([A-Z0-9_-]+(?:ACCEPT|DROP|REJECT|DENY|BLOCK|LOG|FORWARD|INPUT|OUTPUT)[A-Z0-9_-]*):\s+(?:IN=(\S*)\s+)?(?:OUT=(\S*)\s+)?(?:MAC=\S+\s+)?(?:SRC=(\S+)\s+)?(?:DST=(\S+)\s+)?(?:LEN=(\d+)\s+)?(?:PROTO=(\S+)\s*)?(?:SPT=(\d+)\s*)?(?:DPT=(\d+)\s*)?.*"
FIREWALL = r"(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2})\s+(ALLOW|BLOCK|DROP|DENY|REJECT)\s+(\S+)\s+(.+)"
AUDIT = r"type=(\S+)\s+msg=audit\(([\d.]+):(\d+)\):\s*(.+)"
ISO_LINE = r"(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?)\s+(.+)"
APT = r"(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2})\s+(startup|install|upgrade|remove|purge|error|status|trigproc|configure)\s+(\S+)(?:\s+(\S+)\s+(\S+))?.*"
YUM = r"(\w{3})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})\s+(Installed|Updated|Erased|Obsoleted|Dep-Installed|Reinstalled):\s+(.+)"
DNF = r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z)\s+(DEBUG|INFO|WARNING|ERROR)\s+(.+)"
DNF_DONE = r"(Installed|Updated|Erased|Removed):\s+(.+)"
MYSQL_8 = r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+Z)\s+(\d+)\s+\[([^\]]+)\]\s+\[([^\]]*)\]\s+\[([^\]]*)\]\s+(.+)"
MYSQL_57 = r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+Z)\s+(Note|Warning|Error|ERROR)\s+(.+)"
MYSQL_GENERAL = r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+Z)\s+(\d+)\s+(Connect|Query|Quit|Init\s+DB|Field\s+List|Change\s+user|Ping|Statistics|Debug|Refresh|Shutdown|Processlist|Kill|Create\s+DB|Drop\s+DB|Reload)\b\s*(.*)"
OPENVPN = r"(\w{3})\s+(\w{3})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})\s+(\d{4})\s+(?:(\d+\.\d+\.\d+\.\d+)(?::(\d+))?\s+)?(.+)"


def syslog_5424(line: Column, year: int) -> Steps:
    (g,) = yield (groups(line, SYSLOG_5424, 5),)
    process, message = F.trim(g[2]), g[4]
    p, m = yield lowered(process), lowered(message)
    return _when(g, event(ts=iso(g[0]), event_type=classify.syslog(p, m, message), source=F.lit("syslog"), message=message, hostname=g[1], process=process, pid=some(g[3])))


def syslog_3164(line: Column, year: int) -> Steps:
    (g,) = yield (groups(line, SYSLOG_3164, 7),)
    process, message = F.trim(g[4]), g[6]
    p, m = yield lowered(process), lowered(message)
    ts = stamp(F.concat_ws(" ", F.lit(str(year)), g[0], g[1], g[2]), "yyyy MMM d HH:mm:ss")
    return _when(g, event(ts=ts, event_type=classify.syslog(p, m, message), source=F.lit("syslog"), message=message, hostname=g[3], process=process, pid=some(g[5])))


def syslog(line: Column, year: int) -> Steps:
    """The newer form where a line has it, else the older one."""
    n, o = yield groups(line, SYSLOG_5424, 5), groups(line, SYSLOG_3164, 7)
    (g,) = yield (
        F.when(n.isNotNull(), F.array(F.lit(None).cast("string"), n[0], n[1], F.trim(n[2]), n[3], n[4]))
        .when(o.isNotNull(), F.array(F.concat_ws(" ", F.lit(str(year)), o[0], o[1], o[2]), F.lit(None).cast("string"), o[3], F.trim(o[4]), o[5], o[6])),
    )
    p, m = yield lowered(g[3]), lowered(g[5])
    ts = F.coalesce(iso(g[1]), stamp(g[0], "yyyy MMM d HH:mm:ss"))
    return _when(g, event(ts=ts, event_type=classify.syslog(p, m, g[5]), source=F.lit("syslog"), message=g[5], hostname=g[2], process=g[3], pid=some(g[4])))


def apache(line: Column, year: int) -> Steps:
    """The zone is ignored; '-' as a size is 0."""
    (g,) = yield (groups(line, APACHE, 7),)
    status, p = yield g[5].try_cast("int"), F.lower(g[4])
    message = F.concat(g[3], F.lit(" "), g[4], F.lit(" → "), g[5], F.lit(" (von "), g[0], F.lit(")"))
    ts = stamp(F.split(g[2], " ")[0], "dd/MMM/yyyy:HH:mm:ss")
    return _when(g, event(ts=ts, event_type=classify.web_request(p, status), source=F.lit("webserver"), message=message, src_ip=g[0], user=F.nullif(g[1], F.lit("-")), method=g[3], path=g[4], status=status, size=F.coalesce(g[6].try_cast("bigint"), F.lit(0))))


def iptables(line: Column, year: int) -> Steps:
    head, g = yield groups(line, IPTABLES_HEAD, 2), groups(line, IPTABLES, 9)
    ts = stamp(F.concat_ws(" ", F.lit(str(year)), F.regexp_replace(head[0], r"\s+", " ")), "yyyy MMM d HH:mm:ss")
    extra = F.create_map(F.lit("in"), g[1], F.lit("out"), g[2], F.lit("proto"), g[6])
    message = F.concat_ws(" ", g[0], g[6], F.concat(g[3], F.lit(" → "), g[4]))
    return _when(g, event(ts=ts, event_type=classify.iptables_prefix(g[0]), source=F.lit("iptables"), message=message, hostname=head[1], src_ip=some(g[3]), dst_ip=some(g[4]), src_port=some(g[7]), dst_port=some(g[8]), action=g[0], extra=extra))


def firewall(line: Column, year: int) -> Steps:
    """The rest of the line gives addresses and ports where it holds them."""
    (g,) = yield (groups(line, FIREWALL, 4),)
    (ends,) = yield (groups(F.concat(g[3], F.lit(" ")), r"(\d+\.\d+\.\d+\.\d+):(\d+)\s+(\d+\.\d+\.\d+\.\d+):(\d+)\s.*", 4),)
    size = F.regexp_extract(g[3], r"\bsize=(\d+)", 1).try_cast("bigint")
    end = lambda i: F.when(ends.isNotNull(), ends[i])
    return _when(g, event(ts=stamp(F.regexp_replace(g[0], r"\s+", " "), "yyyy-MM-dd HH:mm:ss"), event_type=F.concat(F.lit("firewall_"), F.lower(g[1])), source=F.lit("firewall"), message=F.concat_ws(" ", g[1], g[2], g[3]), action=g[1], src_ip=end(0), src_port=end(1), dst_ip=end(2), dst_port=end(3), size=size, extra=F.create_map(F.lit("proto"), g[2])))


def key_values(text: Column) -> Column:
    """key=value pairs: quoted ones first, of which the last wins; then, of other keys, the first bare one, which may begin with a quote."""
    entries = lambda pattern: F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("k"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("v"))
    empty = F.create_map().cast("map<string,string>")
    put = lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["k"]), F.create_map(e["k"], e["v"]))
    quoted = F.aggregate(entries(r'(\w+)="([^"]*)"'), empty, put)
    return F.aggregate(entries(r'(\w+)=(\S+)'), quoted, lambda m, e: F.when(F.map_contains_key(m, e["k"]), m).otherwise(put(m, e)))


def audit(line: Column, year: int) -> Steps:
    """The command of an EXECVE record is its arguments a0, a1, ...: as many as argc says and the record can hold."""
    (g,) = yield (groups(line, AUDIT, 4),)
    (kv,) = yield (key_values(g[3]),)
    field = lambda k: F.try_element_at(kv, F.lit(k))
    # an argument that isn't there counts as empty, so none beyond the last field can add anything but blanks
    argc = F.least(F.coalesce(field("argc").try_cast("int"), F.lit(0)), F.length(g[3]))
    names = F.when(argc > 0, F.sequence(F.lit(0), argc - 1)).otherwise(F.array().cast("array<int>"))
    args = F.array_join(F.transform(names, lambda i: F.coalesce(F.try_element_at(kv, F.concat(F.lit("a"), i.cast("string"))), F.lit(""))), " ")
    command, exe, result = yield F.when(argc > 0, args).otherwise(g[3]), lowered(field("exe")), lowered(F.coalesce(some(field("res")), field("success")))
    (cmd,) = yield (F.lower(command),)
    message = F.when(g[0] == "EXECVE", F.concat(F.lit("EXECVE: "), F.left(command, F.lit(150)))).otherwise(F.concat(F.lit("Audit ["), g[0], F.lit("]: "), F.left(g[3], F.lit(120))))
    ts = F.timestamp_seconds(g[1].try_cast("double"))
    return _when(g, event(ts=ts, event_type=classify.audit(g[0], kv, cmd, exe, result), source=F.lit("audit"), message=message, user=F.coalesce(field("acct"), field("uid")), process=F.coalesce(field("comm"), field("exe")), path=field("name"), extra=kv))


def journal(line: Column, year: int) -> Steps:
    (j,) = yield (F.from_json(line, "map<string,string>"),)
    field = lambda k: F.try_element_at(j, F.lit(k))
    process, message = yield F.coalesce(some(field("_COMM")), some(field("_SYSTEMD_UNIT"))), field("MESSAGE")
    p, m = yield lowered(process), lowered(message)
    (kind,) = yield (classify.syslog(p, m, message),)
    urgent = field("PRIORITY").try_cast("int") <= 2
    kind = F.when(urgent & (kind == "system_event"), "system_alert").otherwise(kind)
    return F.when(j.isNotNull() & (F.size(j) > 0), event(ts=F.timestamp_micros(field("__REALTIME_TIMESTAMP").try_cast("bigint")), event_type=kind, source=F.lit("journal"), message=message, hostname=field("_HOSTNAME"), process=process, pid=field("_PID"), user=field("_UID"), extra=F.map_filter(j, lambda k, _: k.isin("_SYSTEMD_UNIT", "PRIORITY"))))


def apt(line: Column, year: int) -> Steps:
    (g,) = yield (groups(line, APT, 5),)
    message = F.concat(F.lit("APT "), g[1], F.lit(": "), g[2], F.when((g[3] != "") & (g[4] != ""), F.concat(F.lit(" ("), g[3], F.lit(" → "), g[4], F.lit(")"))).otherwise(""))
    return _when(g, event(ts=stamp(F.regexp_replace(g[0], r"\s+", " "), "yyyy-MM-dd HH:mm:ss"), event_type=classify.package_action(g[1], g[2]), source=F.lit("apt"), message=message, action=g[1], package=g[2], extra=F.create_map(F.lit("from_version"), g[3], F.lit("to_version"), g[4])))


def yum(line: Column, year: int) -> Steps:
    g, d = yield groups(line, YUM, 5), groups(line, DNF, 3)
    (done,) = yield (groups(d[2], DNF_DONE, 2),)
    put = g[3].isin("Installed", "Updated", "Dep-Installed")
    ts = stamp(F.concat_ws(" ", F.lit(str(year)), g[0], g[1], g[2]), "yyyy MMM d HH:mm:ss")
    classic = event(ts=ts, event_type=F.when(put, "package_install").otherwise("package_remove"), source=F.lit("yum"), message=F.concat(F.lit("YUM "), g[3], F.lit(": "), F.trim(g[4])), action=g[3], package=F.trim(g[4]))
    action, package = F.coalesce(done[0], F.lit("log_entry")), F.coalesce(done[1], d[2])
    modern = event(ts=iso(d[0]), event_type=F.when(action.isin("Installed", "Updated"), "package_install").otherwise("package_event"), source=F.lit("dnf"), message=F.concat(F.lit("DNF "), action, F.lit(": "), package), action=action, package=package)
    return F.coalesce(_when(d, modern), _when(g, classic))


def mysql_error(line: Column, year: int) -> Steps:
    a, b = yield groups(line, MYSQL_8, 6), groups(line, MYSQL_57, 3)
    level, message = F.coalesce(a[2], b[1]), F.coalesce(a[5], b[2])
    v, m = yield F.lower(level), F.lower(message)
    extra = _when(a, F.create_map(F.lit("code"), a[3], F.lit("subsystem"), a[4], F.lit("thread"), a[1]))
    return F.when(a.isNotNull() | b.isNotNull(), event(ts=iso(F.coalesce(a[0], b[0])), event_type=classify.mysql_error(v, m), source=F.lit("mysql_error"), message=message, action=v, extra=extra))


def mysql_general(line: Column, year: int) -> Steps:
    (g,) = yield (groups(line, MYSQL_GENERAL, 4),)
    (m,) = yield (F.lower(g[3]),)
    return _when(g, event(ts=iso(g[0]), event_type=classify.mysql_query(g[2], m), source=F.lit("mysql_general"), message=F.concat(g[2], F.lit(": "), F.left(g[3], F.lit(200))), action=g[2], extra=F.create_map(F.lit("thread"), g[1])))


def openvpn(line: Column, year: int) -> Steps:
    (g,) = yield (groups(line, OPENVPN, 8),)
    (m,) = yield (F.lower(g[7]),)
    ts = stamp(F.concat_ws(" ", g[4], g[1], g[2], g[3]), "yyyy MMM d HH:mm:ss")
    return _when(g, event(ts=ts, event_type=classify.openvpn(m), source=F.lit("openvpn"), message=g[7], src_ip=some(g[5]), src_port=some(g[6])))


def pipe(line: Column, year: int) -> Steps:
    (p,) = yield (F.split(line, r"\|", -1),)
    at = lambda i: some(F.trim(F.try_element_at(p, F.lit(i))))
    return F.when(F.size(p) >= 4, event(ts=iso(at(1)), event_type=F.lower(at(2)), source=at(3), message=at(4), hostname=at(5), user=at(6)))


def iso_line(line: Column, year: int) -> Steps:
    """A timestamp and key=value pairs; of repeated keys the last wins."""
    (g,) = yield (groups(line, ISO_LINE, 2),)
    pairs = F.arrays_zip(F.regexp_extract_all(g[1], F.lit(r"(\w+)=(\S+)"), F.lit(1)).alias("k"), F.regexp_extract_all(g[1], F.lit(r"(\w+)=(\S+)"), F.lit(2)).alias("v"))
    put = lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["k"]), F.create_map(e["k"], e["v"]))
    (kv,) = yield (F.aggregate(pairs, F.create_map().cast("map<string,string>"), put),)
    number = F.try_element_at(kv, F.lit("EventID"))
    return _when(g, event(ts=iso(g[0]), event_type=F.when(number.isNotNull(), F.concat(F.lit("windows_event_"), number)).otherwise("log_entry"), source=F.lit("event_log"), message=g[1], extra=kv))


def generic(line: Column, year: int) -> Steps:
    """What no format explains: without a time of its own."""
    return F.when(F.length(line) >= 5, event(event_type=F.lit("log_entry"), source=F.lit("text_log"), message=line))
    yield  # no step before the event


PARSERS: dict[str, Parser] = {
    "journal_json": journal, "pipe_delimited": pipe, "apache_combined": apache, "audit": audit, "apt": apt, "yum": yum,
    "mysql_error": mysql_error, "mysql_general": mysql_general, "openvpn": openvpn, "iptables": iptables,
    "firewall_simple": firewall, "syslog": syslog, "iso_timestamp": iso_line, "generic": generic,
}


def any_format(fmt: Column) -> Parser:
    """The parser of lines whose format a column names; a line that doesn't match its format is generic.

    All formats take their steps together, and each step is computed only for lines of its format.
    """

    def parser(line: Column, year: int) -> Steps:
        running = {name: p(line, year) for name, p in PARSERS.items() if name != "generic"}
        events, given = {}, dict.fromkeys(running)
        while running:
            asked = {}
            for name, steps in list(running.items()):
                try:
                    asked[name] = steps.send(given[name])
                except StopIteration as end:
                    events[name] = end.value
                    del running[name]
            if asked:
                got = iter((yield tuple(F.when(fmt == name, c) for name, columns in asked.items() for c in columns)))
                given = {name: tuple(next(got) for _ in columns) for name, columns in asked.items()}
        rules = [(fmt == name, events[name]) for name in PARSERS if name in events]
        (found,) = yield (classify.first_of(rules, F.lit(None).cast(f"struct<{EVENT}>")),)
        return F.coalesce(found, event_of(generic, line, year))

    return parser


def event_of(parser: Parser, line: Column, year: int = 1970) -> Column:
    """The event of a line as one expression, in which each use of a step's column repeats its expression."""
    steps = parser(line, year)
    given = None
    while True:
        try:
            given = steps.send(given)
        except StopIteration as end:
            return end.value


def bound(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that stay what they are: neither their expressions nor filters on them are moved or repeated.

    The optimizer merges projections and pushes filters through them, and so repeats an expression wherever its column is
    used. It does neither across a generator, here one that makes one row of each.
    """
    one = F.explode(F.array(F.struct(*(v.alias(k) for k, v in columns.items())))).alias("__bound")
    return rows.select("*", one).select(*(F.col(f"`{c}`") for c in rows.columns), *(F.col(f"__bound.{k}").alias(k) for k in columns))


def with_events(rows: DataFrame, parser: Parser, line: str = "line", year: int = 1970, out: str = "e") -> DataFrame:
    """``rows`` with the event (a struct, or null) of each line in column ``out``; every step is computed once a line."""
    steps, own, given, n = parser(F.col(line), year), rows, None, 0
    while True:
        try:
            columns = steps.send(given)
        except StopIteration as end:
            return bound(own, **{out: end.value}).select(*(F.col(f"`{c}`") for c in rows.columns), out)
        names = [f"__step{n + i}" for i in range(len(columns))]
        n += len(names)
        own, given = bound(own, **dict(zip(names, columns, strict=True))), tuple(map(F.col, names))


def line_format(line: Column) -> Column:
    """Format of one line: the first pattern in a fixed order that it matches, or null."""
    ipt = line.rlike(r"(IN=\S*\s+OUT=|SRC=\S+\s+DST=)") & line.rlike(f"^(?:{IPTABLES})$")
    matches = lambda p: line.rlike(f"^(?:{p})$")
    order = [
        (line.startswith("{") & F.from_json(line, "map<string,string>").isNotNull(), "journal_json"),
        (F.regexp_count(line, F.lit(r"\|")) >= 4, "pipe_delimited"),
        (matches(APACHE), "apache_combined"),
        (matches(AUDIT), "audit"),
        (matches(APT), "apt"),
        (matches(YUM) | matches(DNF), "yum"),
        (matches(MYSQL_8) | matches(MYSQL_57), "mysql_error"),
        (matches(MYSQL_GENERAL), "mysql_general"),
        (matches(OPENVPN), "openvpn"),
        (ipt, "iptables"),
        (matches(FIREWALL), "firewall_simple"),
        (matches(SYSLOG_5424) | matches(SYSLOG_3164), "syslog"),
        (matches(ISO_LINE), "iso_timestamp"),
    ]
    out = F.when(*[order[0][0], F.lit(order[0][1])])
    for when, name in order[1:]:
        out = out.when(when, F.lit(name))
    return out
