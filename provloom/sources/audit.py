"""Linux audit logs: records to events, events to graph rows, host choice.

``lines`` has (value, file, line_no) plus any path columns; an event is all records of one id in one
file, so groups are as small as the kernel makes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provloom.functions.timeid import decimal_seconds_to_ns, uuid5
from provloom.operators import build, ordered
from provloom.session import cut_lineage

# Record families, host preference, loader path.
PAM = ("USER_ACCT", "CRED_ACQ", "USER_START", "USER_END", "CRED_REFR", "CRED_DISP")
AUTH = ("USER_AUTH", "USER_LOGIN", "LOGIN")
ACCOUNT = ("ADD_USER", "ADD_GROUP")
SERVICE = ("SERVICE_START", "SERVICE_STOP")
COMMAND, BPF, AVC, ERROR = ("USER_CMD",), ("BPF",), ("AVC",), ("USER_ERR",)
ABEND, PROMISC, NETFILTER, SHUTDOWN = ("ANOM_ABEND",), ("ANOM_PROMISCUOUS",), ("NETFILTER_CFG",), ("SYSTEM_SHUTDOWN",)
SYSCALL = ("SYSCALL",)
TYPED = PAM + AUTH + ACCOUNT + SERVICE + COMMAND + BPF + AVC + ERROR + ABEND + PROMISC + NETFILTER + SHUTDOWN
HOST_PRIORITY = ("videoserver", "client", "linuxshare", "docker", "reposerver", "inetfw")
MIN_HOST_EVENTS = 5
LOADER = "/lib64/ld-linux-x86-64.so.2"

_TIME = r"msg=audit\(([\d.]+):\d+\)"
_PID, _COMM, _EXE, _RES = r"\bpid=(\d+)", r'comm="([^"]+)"', r'exe="([^"]+)"', r"res=(\w+)"
_OP = r"op=([^\s']+)"
_ACCT = r'acct="([^"]+)"'
_TOKEN = r'((?:"[^"]*")|(?:[0-9A-Fa-f]+))'

# Fixed values: (event field, record families, pattern) of the plain fields.
FIELDS = (
    ("timestamp", SYSCALL + TYPED, _TIME),
    ("success", SYSCALL, r"success=(\w+)"),
    ("exit", SYSCALL, r"\bexit=(-?\d+)"),
    ("a0", SYSCALL, r"\ba0=(\S+)"),
    ("ppid", SYSCALL, r"ppid=(\d+)"),
    ("key", SYSCALL, r'key="([^"]+)"'),
    ("subj", SYSCALL + PAM + AUTH, r"\bsubj=(\S+)"),
    ("pid", SYSCALL + PAM + AUTH + ACCOUNT + SERVICE + COMMAND + AVC + ABEND + NETFILTER + SHUTDOWN, _PID),
    ("comm", SYSCALL + SERVICE + AVC + ABEND + NETFILTER + SHUTDOWN, _COMM),
    ("exe", SYSCALL + PAM + AUTH + ACCOUNT + SERVICE + COMMAND + ERROR + ABEND + SHUTDOWN, _EXE),
    ("pam_op", PAM, _OP),
    ("pam_acct", PAM, _ACCT),
    ("pam_res", PAM, _RES),
    ("res", AUTH + ACCOUNT + SERVICE + COMMAND + ERROR + ABEND + SHUTDOWN, _RES),
    ("unit", SERVICE, r"unit=(\S+)"),
    ("bpf_progid", BPF, r"prog-id=(\d+)"),
    ("bpf_op", BPF, r"\bop=(\w+)"),
    ("avc_result", AVC, r'apparmor="(\w+)"'),
    ("avc_op", AVC, r'operation="(\w+)"'),
    ("avc_profile", AVC, r'profile="([^"]+)"'),
    ("avc_name", AVC, r'name="([^"]+)"'),
    ("sig", ABEND, r"\bsig=(\d+)"),
    ("dev", PROMISC, r"\bdev=(\S+)"),
    ("prom", PROMISC, r"\bprom=(\d+)"),
    ("nf_table", NETFILTER, r"\btable=(\S+)"),
    ("nf_op", NETFILTER, r"\bop=(\S+)"),
    ("mmap_flags", ("MMAP",), r"\bflags=(\S+)"),
)


def _get(rx: str, c: str = "value") -> Column:
    return F.nullif(F.regexp_extract(c, rx, 1), F.lit(""))


def _known(rx: str) -> Column:
    return F.nullif(_get(rx), F.lit("?"))


def decode_argument(v: Column) -> Column:
    """Quoted text, or hex bytes as UTF-8 (broken sequences replaced); anything else as it is."""
    quoted = v.startswith('"') & v.endswith('"')
    hexed = v.rlike(r"^(?:[0-9A-Fa-f]{2})+$")
    text = F.make_valid_utf8(F.unhex(v).cast("string"))
    return F.when(quoted, F.substring(v, F.lit(2), F.length(v) - 2)).when(hexed, text).otherwise(v)


def select_path(paths: Column) -> Column:
    """Last path that is no parent, else the last; ``paths`` is array<struct(name, nametype)>."""
    own = F.filter(paths, lambda p: F.coalesce(p["nametype"] != "PARENT", F.lit(True)))
    return F.coalesce(F.try_element_at(own, F.lit(-1))["name"], F.try_element_at(paths, F.lit(-1))["name"])


def records(lines: DataFrame) -> DataFrame:
    """Lines that belong to an event, with event id and record type."""
    return (
        lines.withColumn("value", F.trim("value"))
        .withColumn("event_id", _get(r"msg=audit\([\d.]+:(\d+)\)"))
        .filter(F.col("event_id").isNotNull())
        .withColumn("rec", F.when(F.col("value").startswith("type="), F.regexp_extract("value", r"^type=(\S*)", 1)))
    )


def parse_events(lines: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Events with their fields, kept by family, with source and target names. ``keys`` names one log
    (default: the file); ``event_no`` orders the events of a log by first sight."""
    keys = keys or ["file"]
    r = records(lines)
    rec = F.col("rec")
    vals: dict[str, Column] = {name: F.when(rec.isin(*fams), _get(rx)) for name, fams, rx in FIELDS}
    vals["type"] = F.when(rec.isin(*TYPED), rec)
    vals["syscall"] = F.when(
        rec == "SYSCALL", F.nullif(F.regexp_extract(F.substring_index("value", "ARCH=", -1), r"SYSCALL=(\w+)", 1), F.lit(""))
    )
    args = F.regexp_extract_all("value", F.lit(r"a\d+=" + _TOKEN), F.lit(1))
    vals["command"] = F.when(rec == "EXECVE", F.array_join(F.transform(args, decode_argument), " "))
    laddr, lport = _get(r"laddr=([\d.]+)"), _get(r"lport=(\d+)")
    vals["sock"] = F.when(rec == "SOCKADDR", F.coalesce(F.concat(laddr, F.lit(":"), lport), _get(r"path=([^\s}]+)")))
    vals["op"] = (
        F.when(rec.isin(*AUTH, *ERROR), _get(_OP))
        .when(rec.isin(*ACCOUNT), _get(r"op=([^\s']+ ?[^\s']*)"))
        .when(rec.isin(*COMMAND), F.concat(F.lit("cwd="), _get(r'cwd="([^"]+)"')))
    )
    vals["hostname"] = F.when(rec.isin(*AUTH, *ACCOUNT), _known(r"hostname=(\S+)"))
    vals["addr"] = F.when(rec.isin(*AUTH), _known(r"\baddr=(\S+)"))
    vals["cmd"] = F.when(rec.isin(*COMMAND), decode_argument(_get("cmd=" + _TOKEN)))
    uid = F.lit("uid:")
    vals["acct"] = (
        F.when(rec.isin(*AUTH), F.coalesce(_get(_ACCT), decode_argument(_get(r"acct=([0-9A-Fa-f]{6,})\b")), _get(r'\bUID="([^"]+)"')))
        .when(rec.isin(*ACCOUNT), F.coalesce(_get(_ACCT), F.concat(uid, _get(r"\bid=(\d+)")), _get(r'\bID="([^"]+)"')))
        .when(rec.isin(*COMMAND), _get(r'\bUID="([^"]+)"'))
        .when(rec.isin(*ERROR), _get(_ACCT))
        .when(rec.isin(*PROMISC), F.concat(uid, _get(r"\buid=(\d+)")))
    )
    vals["fcaps"] = F.when(rec == "BPRM_FCAPS", "yes")
    name = _get(r'name="([^"]+)"')
    path = F.when(
        (rec == "PATH") & name.isNotNull(),
        F.struct("line_no", name.alias("name"), _get(r"\bnametype=(\w+)").alias("nametype")),
    )
    wide = r.select(*keys, "event_id", "line_no", rec, path.alias("path"), *[c.alias(n) for n, c in vals.items()])
    last = [F.max_by(n, F.when(F.col(n).isNotNull(), F.col("line_no"))).alias(n) for n in vals]
    ev = wide.groupBy(*keys, "event_id").agg(
        F.min("line_no").alias("event_no"),
        F.max(F.coalesce(F.col("rec") == "SYSCALL", F.lit(False))).alias("has_syscall"),
        F.transform(
            F.array_sort(F.collect_list("path")), lambda p: F.struct(p["name"].alias("name"), p["nametype"].alias("nametype"))
        ).alias("paths"),
        *last,
    )
    ev = ev.withColumn("type", F.coalesce("type", F.lit("SYSCALL")))
    # the naming joins the events with themselves; the lines are parsed once
    return _named(cut_lineage(_kept(ev)), keys)


def _kept(ev: DataFrame) -> DataFrame:
    t, sc, ok = F.col("type"), F.col("syscall"), F.col("success")
    some = F.coalesce("acct", "op", "unit", "cmd", "avc_result", "bpf_op").isNotNull()
    keep = (
        F.when(F.col("has_syscall"), sc.isNotNull())
        .when(t.isin(*PAM), F.col("exe").isNotNull() & F.col("pam_acct").isNotNull())
        .when(t.isin(*ABEND, *SHUTDOWN), F.col("pid").isNotNull())
        .when(t.isin(*PROMISC), F.col("dev").isNotNull())
        .when(t.isin(*NETFILTER), F.col("nf_op").isNotNull())
        .when(t.isin(*TYPED), some)
        .otherwise(False)
    )
    chosen = select_path(F.col("paths"))
    has_paths = F.size("paths") > 0
    dest = (
        F.when((sc == "execve") & (ok == "yes"), F.col("exe"))
        .when((sc == "execve") & (ok == "no") & has_paths, F.concat(chosen, F.lit(" [not found]")))
        .when((sc == "execve") & (ok == "no"), F.col("sock"))
        .when((sc != "connect") & has_paths & (chosen != LOADER), chosen)
        .otherwise(F.col("sock"))
    )
    return ev.filter(keep).withColumn("dest", F.when(F.col("has_syscall"), dest).otherwise(F.col("sock"))).drop("sock")


def _or_pid(*names: str) -> Column:
    return F.coalesce(*names, F.concat(F.lit("pid:"), F.coalesce("pid", F.lit("None"))))


def _tag(prefix: str, c: str) -> Column:
    return F.concat(F.lit(prefix), F.coalesce(c, F.lit("None")))


def executables(ev: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pid, exe): executable of each process id of a log, the last event wins."""
    return (
        ev.filter("pid is not null and exe is not null")
        .groupBy(*keys, F.col("pid").alias("ppid"))
        .agg(F.max_by("exe", "event_no").alias("parent_exe"))
    )


def _named(ev: DataFrame, keys: list[str]) -> DataFrame:
    e = ev.join(executables(ev, keys), [*keys, "ppid"], "left")
    t = F.col("type")
    acct = F.concat(_tag("acct:", "acct"), F.lit(":"), t)
    ran = (F.col("syscall") == "execve") & (F.col("success") == "yes")
    src = (
        F.when(t.isin(*PAM, *ACCOUNT, *ERROR), _or_pid("exe"))
        .when(t.isin(*AUTH), _or_pid("addr", "hostname", "exe", "comm"))
        .when(t.isin(*SERVICE, *ABEND, *SHUTDOWN), _or_pid("exe", "comm"))
        .when(t.isin(*COMMAND), F.coalesce(F.concat(F.lit("acct:"), F.col("acct")), _or_pid()))
        .when(t.isin(*BPF), _tag("bpf:", "bpf_progid"))
        .when(t.isin(*AVC, *NETFILTER), _or_pid("comm"))
        .when(t.isin(*PROMISC), F.coalesce("acct", F.lit("unknown")))
        .when(ran, F.coalesce("parent_exe", _tag("pid:", "ppid")))
        .otherwise(_or_pid("exe", "comm"))
    )
    dest = (
        F.when(t.isin(*PAM), F.concat(_tag("pam:", "pam_acct"), F.lit(":"), t))
        .when(t.isin(*AUTH, *ACCOUNT, *ERROR), acct)
        .when(t.isin(*SERVICE), _tag("unit:", "unit"))
        .when(t.isin(*COMMAND), F.coalesce("cmd", "exe"))
        .when(t.isin(*BPF), F.col("bpf_op"))
        .when(t.isin(*AVC), F.coalesce("avc_name", "avc_profile"))
        .when(t.isin(*ABEND), _tag("crash:sig=", "sig"))
        .when(t.isin(*PROMISC), _tag("iface:", "dev"))
        .when(t.isin(*NETFILTER), _tag("netfilter:", "nf_table"))
        .when(t.isin(*SHUTDOWN), F.lit("system:shutdown"))
        .otherwise(F.col("dest"))
    )
    # the graph rows need the target as it was before naming
    return e.withColumn("raw_dest", F.col("dest")).withColumn("src", src).withColumn("dest", dest)


def event_edges(ev: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One graph edge per event: keys, names and types of both ends, edge type, time and event id.
    Node uuids are deterministic in the node key."""
    keys = keys or ["file"]
    t = F.col("type")
    lit = F.lit

    def node(key: Column, name: Column, kind: str | Column) -> Column:
        return F.struct(key.alias("key"), name.alias("name"), (lit(kind) if isinstance(kind, str) else kind).alias("type"))

    def proc(name: Column, pid: str = "pid") -> Column:
        shown = F.coalesce(name, F.concat(lit("pid:"), F.col(pid)), lit("unknown"))
        return node(F.coalesce(F.concat(lit("pid:"), F.col(pid), lit(":"), shown), shown), shown, "SUBJECT_PROCESS")

    def same(c: Column, kind: str | Column) -> Column:
        return node(c, c, kind)

    exe, comm = F.col("exe"), F.col("comm")
    either = F.coalesce("exe", "comm")
    peer = F.coalesce("addr", "hostname")
    principal = same(_tag("acct:", "acct"), "PRINCIPAL_LOCAL")
    sc, ran = F.col("syscall"), F.col("success") == "yes"
    execve, connect = sc == "execve", (sc == "connect") & F.col("raw_dest").isNotNull()
    first_path = F.get("paths", lit(0))["name"]
    missing = F.when(F.size("paths") > 0, F.concat(first_path, lit(" [not found]"))).otherwise("unknown")
    src = (
        F.when(t.isin(*AUTH) & peer.isNotNull(), same(peer, "NetFlowObject"))
        .when(t.isin(*PAM, *AUTH, *ACCOUNT, *ERROR), proc(exe))
        .when(t.isin(*SERVICE, *ABEND, *SHUTDOWN), proc(either))
        .when(t.isin(*COMMAND) & F.col("acct").isNotNull(), principal)
        .when(t.isin(*COMMAND), proc(lit(None).cast("string")))
        .when(t.isin(*BPF), same(lit("kernel"), "SUBJECT_PROCESS"))
        .when(t.isin(*AVC, *NETFILTER), proc(comm))
        .when(t.isin(*PROMISC), same(F.coalesce("acct", lit("unknown")), "PRINCIPAL_LOCAL"))
        .when(execve & ran, proc(F.col("parent_exe"), "ppid"))
        .otherwise(proc(exe))
    )
    dst = (
        F.when(t.isin(*PAM), same(_tag("acct:", "pam_acct"), "PRINCIPAL_LOCAL"))
        .when(t.isin(*AUTH, *ACCOUNT), principal)
        .when(t.isin(*SERVICE), same(_tag("unit:", "unit"), "SUBJECT_PROCESS"))
        .when(t.isin(*COMMAND), proc(F.coalesce("cmd", "exe", lit("unknown"))))
        .when(t.isin(*BPF), same(_tag("bpf-prog:", "bpf_progid"), "SUBJECT_PROCESS"))
        .when(t.isin(*AVC), same(F.coalesce("avc_name", "avc_profile", lit("unknown")), "FileObject"))
        .when(t.isin(*ERROR) & F.col("acct").isNotNull(), principal)
        .when(t.isin(*ERROR), same(F.concat(lit("error:"), F.coalesce("op", lit("unknown"))), "FileObject"))
        .when(t.isin(*ABEND), same(_tag("crash:sig=", "sig"), "FileObject"))
        .when(t.isin(*PROMISC), same(_tag("iface:", "dev"), "NetFlowObject"))
        .when(t.isin(*NETFILTER), same(_tag("netfilter:", "nf_table"), "FileObject"))
        .when(t.isin(*SHUTDOWN), same(lit("system:shutdown"), "FileObject"))
        .when(execve & ran, proc(either))
        .when(execve, same(missing, "FileObject"))
        .when(connect, same(F.col("raw_dest"), F.when(F.col("raw_dest").contains(":"), "NetFlowObject").otherwise("FileObject")))
        .when(F.col("raw_dest").isNotNull(), same(F.col("raw_dest"), "FileObject"))
        .otherwise(same(F.concat(lit("syscall:"), sc), "SUBJECT_PROCESS"))
    )
    event = lambda c: F.concat(lit("EVENT_"), c)
    edge_type = (
        F.when(t.isin(*PAM, *AUTH, *ACCOUNT, *SERVICE, *ERROR, *ABEND, *PROMISC, *SHUTDOWN), event(t))
        .when(t.isin(*COMMAND), "EVENT_SUDO_CMD")
        .when(t.isin(*BPF), event(_tag("BPF_", "bpf_op")))
        .when(t.isin(*AVC), event(_tag("AVC_", "avc_result")))
        .when(t.isin(*NETFILTER), event(_tag("NETFILTER_", "nf_op")))
        .when(execve & ran, "EVENT_EXECVE")
        .when(execve, "EVENT_EXECVE_FAIL")
        .when(connect | F.col("raw_dest").isNotNull() | ran, event(F.upper(sc)))
        .otherwise(F.concat(event(F.upper(sc)), lit("_FAIL")))
    )
    ts = F.coalesce(decimal_seconds_to_ns(F.col("timestamp")), lit(0))
    out = ev.filter(t.isin(*TYPED) | sc.isNotNull()).select(
        *keys, "event_id", F.col("event_no").alias("line_no"), ts.alias("ts_ns"), edge_type.alias("edge_type"),
        src.alias("s"), dst.alias("d"), "pam_op", "fcaps", "mmap_flags",
        F.when(t.isin(*PAM), F.col("pam_res")).when(t.isin(*AUTH, *ERROR, *ABEND, *SHUTDOWN), F.col("res")).alias("result"),
    )
    return out.select(
        *keys, "event_id", "line_no", "ts_ns", "edge_type", "result", "pam_op", "fcaps", "mmap_flags",
        uuid5(F.col("s.key")).alias("src"), F.col("s.name").alias("src_name"), F.col("s.type").alias("src_type"),
        uuid5(F.col("d.key")).alias("dst"), F.col("d.name").alias("dst_name"), F.col("d.type").alias("dst_type"),
    )


def event_nodes(edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Nodes numbered in event order; type, name and time of the first sighting."""
    cols = ("name", "type")
    return build.first_appearance(
        edges,
        keys or ["file"],
        ["line_no"],
        {"uuid": "src", **{c: f"src_{c}" for c in cols}, "ts_ns": "ts_ns"},
        {"uuid": "dst", **{c: f"dst_{c}" for c in cols}, "ts_ns": "ts_ns"},
    )


def path_columns(lines: DataFrame) -> DataFrame:
    """tactic / technique / step / host / logdir out of '<tactic>/<technique>/<step>/<host>/logs/<logdir>/audit.log'."""
    parts = F.split("file", "/")
    n = F.size(parts)
    logs = F.array_position(parts, "logs")
    at = logs - 1  # 0-based place of 'logs'
    base = F.when(logs > 0, at).otherwise(n - 2)
    return (
        lines.withColumn("host", F.get(parts, (base - 1).cast("int")))
        .withColumn("step", F.get(parts, (base - 2).cast("int")))
        .withColumn("technique", F.get(parts, (base - 3).cast("int")))
        .withColumn("tactic", F.get(parts, (base - 4).cast("int")))
        .withColumn("logdir", F.when((logs > 0) & (n > logs + 1), F.get(parts, logs.cast("int"))).otherwise("log"))
    )


def host_tags(files: DataFrame) -> DataFrame:
    """Add ``host_tag``: the host, with its log folder when a (step, host) has several logs."""
    k = ["tactic", "technique", "step", "host"]
    n = files.groupBy(*k).agg(F.count(F.lit(1)).alias("_n"))
    tag = F.when(F.col("_n") > 1, F.concat_ws("-", "host", "logdir")).otherwise(F.col("host"))
    return files.join(n, k).withColumn("host_tag", tag).drop("_n")


def primary_hosts(host_events: DataFrame) -> DataFrame:
    """(tactic, technique, step, host_tag) to read: the preferred host; when that has fewer than five
    events and another has more, the richest. Steps with one host keep it; steps where no host is on
    the list keep none. ``host_events``: step keys, host_tag, n_events, first (order of discovery)."""
    k = ["tactic", "technique", "step"]
    rank = F.lit(None).cast("int")
    for i, p in reversed(list(enumerate(HOST_PRIORITY))):
        rank = F.when((F.col("host_tag") == p) | F.col("host_tag").startswith(p + "-"), i).otherwise(rank)
    h = host_events.withColumn("_p", rank)
    best = h.groupBy(*k).agg(
        F.countDistinct("host_tag").alias("_hosts"),
        F.min(F.when(F.col("_p").isNotNull(), F.struct("_p", "host_tag", "n_events"))).alias("_pick"),
        F.min(F.struct((-F.col("n_events")).alias("m"), "first", "host_tag")).alias("_rich"),
        F.min("host_tag").alias("_only"),
    )
    poor = (F.col("_pick.n_events") < MIN_HOST_EVENTS) & (-F.col("_rich.m") > F.col("_pick.n_events"))
    chosen = (
        F.when(F.col("_hosts") == 1, F.col("_only")).when(poor, F.col("_rich.host_tag")).otherwise(F.col("_pick.host_tag"))
    )
    return best.select(*k, chosen.alias("host_tag")).filter("host_tag is not null")


def type_breakdown(ev: DataFrame) -> DataFrame:
    return ev.groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "type")


def infer_type(name: Column, is_source: Column) -> Column:
    """Node type from its name and roles."""
    return (
        F.when(name.startswith("pam:") | name.startswith("acct:"), "PRINCIPAL_LOCAL")
        .when(name.startswith("unit:") | name.startswith("bpf:") | name.startswith("pid:") | is_source, "SUBJECT_PROCESS")
        .when(name.contains("/"), "FileObject")
        .when(name.rlike(r":\d+$"), "NetFlowObject")
        .otherwise("SUBJECT_PROCESS")
    )


def _graph_rows(ev: DataFrame, keys: list[str]) -> DataFrame:
    """Events with both ends, their operation and their time (null where it is missing)."""
    op = F.upper(F.when(F.col("syscall").isNotNull(), F.col("syscall")).otherwise(F.col("type")))
    ts = F.coalesce(decimal_seconds_to_ns(F.col("timestamp")), F.lit(0))
    return ev.filter("src is not null and dest is not null").select(
        *keys, F.col("src").alias("src_name"), F.col("dest").alias("dst_name"), op.alias("edge_type"),
        F.nullif(ts, F.lit(0)).alias("ts"), "event_no", "event_id",
    )


def merged_event_ids(ev: DataFrame, keys: list[str]) -> DataFrame:
    """Event ids of every merged edge, comma-joined in the order of the log."""
    ids = F.array_sort(F.collect_list(F.struct("event_no", F.col("event_id").cast("string").alias("id"))))
    return _graph_rows(ev, keys).groupBy(*keys, "src_name", "dst_name", "edge_type").agg(
        F.array_join(F.transform(ids, lambda x: x["id"]), ",").alias("event_ids")
    )


def triplets(edges: DataFrame, keys: list[str], target_rows: int | None = None) -> DataFrame:
    """(keys, pos, source, operation, target) of the merged edges in time order, ties by their first line."""
    order = ["ts_ns", "line_no", "src_name", "edge_type", "dst_name"]
    return ordered.scan(edges, keys, order, index="pos", target_rows=target_rows).select(*keys, "pos", "src_name", "edge_type", "dst_name")


def batch_counters(graphs: DataFrame, sentences: DataFrame, keys: list[str]) -> DataFrame:
    """Graphs that gave sentences, graphs that gave none, and sentences in all."""
    n = sentences.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    every = graphs.select(*keys).distinct().join(n, keys, "left").fillna(0, ["n"])
    return every.agg(F.count_if(F.col("n") > 0).alias("n_ok"), F.count_if(F.col("n") == 0).alias("n_empty"), F.sum("n").alias("n_triples"))


def merged_graph(ev: DataFrame, keys: list[str], id_parts: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(graphs, nodes, edges) with repeats of (src, operation, dst) as one edge with a count.

    Edge time is the earliest of its events, node time the earliest non-zero time of its edges; the
    graph spans its node times. Node uuids come from the graph path and the name."""
    rows = _graph_rows(ev, keys)
    edges = rows.groupBy(*keys, "src_name", "dst_name", "edge_type").agg(
        F.coalesce(F.min("ts"), F.lit(0)).alias("ts_ns"), F.count(F.lit(1)).alias("n_events"), F.min("event_no").alias("line_no")
    )
    ends = edges.select(
        *keys,
        F.nullif("ts_ns", F.lit(0)).alias("ts"),
        F.explode(
            F.array(
                F.struct(F.col("src_name").alias("name"), F.lit(True).alias("is_src")),
                F.struct(F.col("dst_name").alias("name"), F.lit(False).alias("is_src")),
            )
        ).alias("e"),
    )
    nodes = ends.groupBy(*keys, F.col("e.name").alias("name")).agg(
        F.coalesce(F.min("ts"), F.lit(0)).alias("ts_ns"), F.bool_or("e.is_src").alias("_src")
    )
    nodes = nodes.withColumn("type", infer_type(F.col("name"), F.col("_src"))).drop("_src")
    nodes = nodes.withColumn("uuid", uuid5(F.concat_ws("/", *id_parts, "name")))
    spans = nodes.groupBy(*keys).agg(
        F.coalesce(F.min(F.nullif("ts_ns", F.lit(0))), F.lit(0)).alias("start_ts"),
        F.max("ts_ns").alias("end_ts"),
        F.count(F.lit(1)).alias("n_nodes"),
    )
    n_edges = edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_edges"))
    return spans.join(n_edges, keys), nodes, edges


def primary_events(lines: DataFrame) -> DataFrame:
    """Events of the logs chosen per step, with the path columns and host tag. One parse serves the
    choice of hosts and the result."""
    ev = parse_events(lines)
    counts = ev.groupBy("file").agg(F.count(F.lit(1)).alias("n_events"), F.min("event_no").alias("first"))
    tagged = host_tags(path_columns(counts))
    chosen = tagged.join(primary_hosts(tagged), ["tactic", "technique", "step", "host_tag"], "left_semi")
    return ev.join(chosen.select("file", "tactic", "technique", "step", "host", "host_tag"), "file")


def write_events(ev: DataFrame, path: str) -> None:
    """Events as JSON lines by tactic and technique; nulls and empty path lists are left out."""
    out = ev.withColumn("paths", F.when(F.size("paths") > 0, F.col("paths")))
    out.write.mode("overwrite").partitionBy("tactic", "technique").json(path)
