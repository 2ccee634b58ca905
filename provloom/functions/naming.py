"""Node-name abstraction: two vocabularies for processes, files and network flows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from provloom.functions import network as net
from provloom.functions import paths

# First vocabulary. Every entry is matched as a substring.
EMAIL_DIRS = ("thunderbird", "mozilla-thunderbird", "outlook", "evolution", "mutt", ".mail")
LIBRARY_MARKS = (".dll", ".exe", ".lib", ".so", ".a")
SYSTEM_DIRS = ("/dev/", "/sys/", "/boot", "/bin", "/sbin", "/etc/", "/var/", "/root", "/run")
TEMP_DIRS = ("/tmp", "/temp")
USER_DIRS = ("/home/", "/usr/", "/opt/", "/.cache")
REGISTRY_HIVES = ("hkey", "hkcu", "hkcr", "hklm", "hku", "hkcc")
WEB_PROCESSES = ("firefox", "chrome")
EMAIL_PROCESSES = ("mail", "thunderbird", "outlook", "evolution", "mutt")
SERVICE_PROCESSES = (
    "cron", "crond", "sshd", "rsyslogd", "ntpd", "httpd", "mysqld", "postgres", "postgresql", "apache",
    "apache2", "nginx", "salt-minion", "dhclient", "dhclient3", "xvnc4", "xvnc", "x11vnc", "vncserver",
    "apt-config",
)
DESKTOP_PROCESSES = ("metacity", "nautilus", "unity", "fluxbox")
SYSTEM_COMMANDS = (  # matched as whole names
    "bash", "sh", "dash", "zsh", "ksh", "sed", "awk", "grep", "sort", "date", "ls", "cat", "mv", "rm", "uname",
    "lesspipe", "sudo", "su", "mount", "groups", "chmod",
)
UTILITY_PATHS = ("/bin/", "/usr/bin/", "/usr/sbin/", "/usr/local/bin/", "/usr/local/sbin/", "/snap/bin/")
SYSTEM_PATHS = ("/bin", "/sbin", "/etc/", "/var", "/sys", "/run", "/lib/systemd")

# Second vocabulary.
USER_PROCESS_PATHS = ("/home/", "/root/", "/tmp/", "/temp/", "/var/tmp/")
PROCESS_CLASSES = {
    "browser_process": ("firefox",),
    "mail_process": ("thunderbird",),
    "service_process": ("sshd", "cron"),
    "shell_process": ("bash", "sh"),
    "ui_process": ("gnome-terminal",),
    "window_manager": ("fluxbox",),
}
UTILITY_BIN_PATHS = (
    "/usr/bin/", "/usr/sbin/", "/bin/", "/sbin/", "/usr/local/bin/", "/usr/local/sbin/", "/snap/bin/",
)
TOP_DIRECTORIES = ("/", "/etc", "/root", "/usr")


def _holds(c: Column, marks) -> Column:
    hit = c.contains(marks[0])
    for m in marks[1:]:
        hit = hit | c.contains(m)
    return hit


def _clean_stem(lowered: Column) -> Column:
    return F.btrim(paths.stem(lowered), F.lit("._- "))


def file_role(lowered: Column, library_marks=LIBRARY_MARKS) -> Column:
    return (
        F.when(_holds(lowered, EMAIL_DIRS), "email_file")
        .when(_holds(lowered, library_marks + ("/lib",)), "library_file")
        .when(lowered.contains("/proc"), "process_file")
        .when(_holds(lowered, SYSTEM_DIRS), "system_file")
        .when(_holds(lowered, TEMP_DIRS), "temp_file")
        .when(_holds(lowered, USER_DIRS), "user_file")
    )


def file_label(name: Column) -> Column:
    low = F.lower(name)
    role, bare = file_role(low), _clean_stem(low)
    hive = F.lit(False)
    for h in REGISTRY_HIVES:
        hive = hive | low.startswith(h)
    return (
        F.when(hive, "registry run key")
        .when(role.isNull(), name)
        .when(bare != "", F.concat_ws(" ", role, bare))
        .otherwise(role)
    )


def flow_label(name: Column) -> Column:
    n = net.strip(name)
    ip = net.flow_destination(n)
    return (
        F.when(_holds(n, ("NA_null", "NA_0")), "network_failure")
        .when(n.startswith("NETLINK"), "kernel_socket")
        .when(ip.isNull() | (net.octet(ip, 0) == 127), "local_connection")
        .when(net.is_private(ip), "private_netflow")
        .otherwise("public_netflow")
    )


def process_label(name: Column) -> Column:
    n = net.strip(name)
    low = F.lower(n)
    cmd = F.regexp_replace(F.regexp_extract(n, r"^(\S*)", 1), r"^-", "")
    bare = F.regexp_replace(F.lower(paths.basename(cmd)), r":+$", "")

    def tag(kind: str) -> Column:
        return F.concat(F.lit(kind + " "), bare)

    return (
        F.when(n == "", name)
        .when(_holds(bare, WEB_PROCESSES), tag("web_process"))
        .when(_holds(bare, EMAIL_PROCESSES), tag("email_process"))
        .when(_holds(bare, SERVICE_PROCESSES), tag("service_process"))
        .when(_holds(bare, DESKTOP_PROCESSES), tag("user_process"))
        .when(bare.isin(*SYSTEM_COMMANDS), tag("system_process"))
        .when(_holds(low, UTILITY_PATHS), tag("util_process"))
        .when(_holds(low, SYSTEM_PATHS), tag("system_process"))
        .when(_holds(low, ("/tmp/", "/temp/")), tag("temp_process"))
        .when(_holds(low, ("/home/", "/usr/", "/opt/")), tag("user_process"))
        .otherwise(name)
    )


def is_flow_type(node_type: Column) -> Column:
    return F.lower(node_type).contains("flow")


def node_label(name: Column, node_type: Column, numbered_flow: Column | None = None) -> Column:
    """Label by node type. ``numbered_flow`` is the per-subgraph label of a public address."""
    t = F.lower(node_type)
    flow = flow_label(name) if numbered_flow is None else F.coalesce(numbered_flow, flow_label(name))
    return (
        F.when((F.coalesce(name, F.lit("")) == "") | (F.coalesce(node_type, F.lit("")) == ""), name)
        .when(t.contains("file"), file_label(name))
        .when(t.contains("flow"), flow)
        .when(t.contains("subject"), process_label(name))
        .otherwise(name)
    )


def host_class(name: Column) -> Column:
    """Second vocabulary for flows: class, address and port."""
    parts = F.split(name, "_")
    local_port = F.get(parts, F.lit(1))
    ip, port = F.get(parts, F.lit(2)), F.try_element_at(parts, F.lit(-1))
    a, b = net.octet(ip, 0), net.octet(ip, 1)
    four = F.size(F.split(ip, r"\.")) == 4
    inside = four & (net.is_private(ip) | (a == 127) | ((a == 128) & (b == 55)))
    return (
        F.when(
            F.get(parts, F.lit(0)) == "LOCAL",
            F.concat(F.lit("unreachable_host local:"), F.coalesce(local_port, F.lit("0"))),
        )
        .when(F.size(parts) < 4, name)
        .when((ip == "NA") | port.isin("null", "0"), F.concat(F.lit("unreachable_host NA:"), local_port))
        .when(inside, F.concat(F.lit("internal_host "), ip, F.lit(":"), port))
        .otherwise(F.concat(F.lit("external_host "), ip, F.lit(":"), port))
    )


def process_class(name: Column) -> Column:
    full = net.strip(name)
    token = F.regexp_extract(full, r"^(\S*)", 1)
    low = F.lower(token)
    bare = F.lower(paths.basename(token))
    expr = F.when(F.coalesce(name, F.lit("")) == "", name).when(
        token.startswith("./") | _holds(low, USER_PROCESS_PATHS), F.concat(F.lit("user_process "), full)
    )
    for kind, names in PROCESS_CLASSES.items():
        expr = expr.when(bare.isin(*names), F.concat(F.lit(kind + " "), full))
    return expr.when(_holds(low, UTILITY_BIN_PATHS), F.concat(F.lit("utility_process "), full)).otherwise(
        F.concat(F.lit("process_"), full)
    )


def file_class(path: Column) -> Column:
    low = F.lower(path)
    base = F.lower(paths.basename(path))

    def tag(kind: str) -> Column:
        return F.concat(F.lit(kind + " "), path)

    return (
        F.when(F.coalesce(path, F.lit("")) == "", path)
        .when(path.isin(*TOP_DIRECTORIES), tag("directory"))
        .when(low.contains(".mozilla") & low.contains("/home/"), tag("browser_data"))
        .when(low.contains(".thunderbird"), tag("mail_data"))
        .when(_holds(low, ("/tmp/", "/var/tmp/")), tag("temporary_file"))
        .when(base.endswith(".cache"), tag("cache_file"))
        .when(base.contains(".so") | low.contains("/lib/"), tag("library_file"))
        .when(low.contains("/var/log/"), tag("log_file"))
        .when(low.startswith("/etc/"), tag("configuration_file"))
        .when(low.startswith("/dev/"), tag("device_file"))
        .when(low.startswith("/sys/"), tag("system_file"))
        .when(
            low.startswith("/bin/") | low.startswith("/sbin/") | base.endswith(".bin") | low.contains("/downloads/"),
            tag("bin_file"),
        )
        .when(low.contains("/home/"), tag("user_file"))
        .otherwise(tag("directory"))
    )


def node_class(name: Column, node_type: Column) -> Column:
    return (
        F.when(node_type.contains("SUBJECT"), process_class(name))
        .when(node_type.contains("NetFlow"), host_class(name))
        .when(node_type.contains("FILE") | node_type.contains("BLOCK"), file_class(name))
        .otherwise(name)
    )


def verb(edge_type: Column) -> Column:
    return F.lower(F.replace(edge_type, F.lit("EVENT_"), F.lit("")))


def tactic_verb(edge_type: Column) -> Column:
    bare = F.replace(edge_type, F.lit("EVENT_"), F.lit(""))
    return F.lower(F.replace(bare, F.lit("RECVFROM"), F.lit("receivefrom")))


def sentence(src: Column, op: Column, dst: Column) -> Column:
    return F.concat(src, F.lit(" "), op, F.lit(" "), dst, F.lit("."))
