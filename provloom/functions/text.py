"""Sentence, triple, template and report-text expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words that make a sentence relevant; 2 points for a verb or noun, 1 for a term.
ATTACK_VERBS = (
    "execute executed run ran download downloaded upload uploaded connect connected send sent receive received "
    "write wrote read inject injected exploit exploited install installed drop dropped persist escalate steal "
    "stole exfiltrate bypass evade launch launched deploy deployed load loaded open opened click clicked access "
    "accessed compromise compromised infect infected modify modified delete deleted create created spawn spawned "
    "browse browsed establish established initiate initiated perform performed attempt attempted trigger "
    "triggered gain gained maintain maintained"
).split()
ATTACK_NOUNS = (
    "malware implant backdoor dropper exploit payload shellcode credential password attacker adversary victim "
    "target c2 command control attack malicious phishing ransomware trojan virus worm rootkit keylogger spyware "
    "botnet privilege escalation persistence lateral movement exfiltration"
).split()
TECH_TERMS = (
    "browser email attachment link url domain ip network file registry process memory shell script executable "
    "binary disk socket port server client extension plugin macro powershell bash cmd"
).split()

# Sentence grammar.
PROCESS_KINDS = (
    "user_process", "util_process", "web_process", "email_process", "service_process", "system_process",
    "temp_process",
)
FILE_KINDS = ("user_file", "library_file", "system_file", "process_file", "email_file", "temp_file")
NETWORK_KINDS = ("public_netflow", "private_netflow", "local_connection", "network_failure", "kernel_socket")
OPERATION_PHRASES = {"connect": "connect to"}  # every other operation reads as itself
OPERATION_SYNONYMS = {
    "write": ("wrote", "write", "written", "writes"),
    "read": ("read", "reads", "reading"),
    "unlink": ("unlink", "unlinked", "unlinks"),
    "sendto": ("sent", "send", "sendto", "transmitted", "sends"),
    "clone": ("cloned", "clone", "spawned", "clones"),
    "execute": ("executed", "execute", "executes", "executing"),
    "recvfrom": ("received", "receive", "recvfrom", "receives"),
    "connect": ("connected", "connect", "connects"),
    "delete": ("deleted", "delete", "deletes"),
    "modify": ("modified", "modify", "modifies"),
    "open": ("opened", "open", "opens"),
}
NARRATIVE_REPLACEMENTS = (
    ("was cloned", "cloned itself"),
    ("were cloned", "cloned themselves"),
    ("has been cloned", "cloned itself"),
    ("got cloned", "cloned itself"),
    ("those files", "the specified files"),
    ("the above files", "the specified files"),
    ("these files", "the specified files"),
)

# Vocabulary of (subject, verb, object) triples; the first key contained in a word wins.
SUBJECT_VOCABULARY = (
    ("browser", "web_process"), ("firefox", "web_process"), ("chrome", "web_process"),
    ("extension", "web_process"), ("email", "email_process"), ("thunderbird", "email_process"),
    ("outlook", "email_process"), ("attacker", "user_process"), ("implant", "user_process"),
    ("malware", "user_process"), ("dropper", "user_process"), ("apt", "user_process"),
    ("shell", "system_process"), ("bash", "system_process"), ("cmd", "system_process"),
)
OBJECT_VOCABULARY = (
    ("executable", "user_file"), ("binary", "user_file"), ("disk", "user_file"), ("file", "user_file"),
    ("drakon", "user_file"), ("implant", "user_file"), ("memory", "process_file"), ("process", "process_file"),
    ("registry", "system_file"), ("config", "system_file"), ("library", "library_file"), ("dll", "library_file"),
    ("website", "public_netflow"), ("server", "public_netflow"), ("network", "public_netflow"),
    ("ip", "public_netflow"), ("target", "user_file"), ("host", "user_file"),
)
VERB_VOCABULARY = {
    "load": "execute", "inject": "execute", "launch": "execute", "run": "execute", "start": "execute",
    "spawn": "execute", "write": "write", "drop": "write", "place": "write", "install": "write", "read": "read",
    "steal": "read", "collect": "read", "gather": "read", "connect": "connect", "browse": "connect",
    "navigate": "connect", "send": "send", "receive": "receive", "download": "receive", "delete": "delete",
    "remove": "delete", "clone": "clone", "exploit": "execute", "execute": "execute",
}

_WS = r"(?U)\s+"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _stripped_non_empty(parts: Column) -> Column:
    return F.filter(F.transform(parts, _strip), lambda s: s != "")


def split_period(text: Column) -> Column:
    """Sentences of a sequence text, cut at '. '."""
    return _stripped_non_empty(F.split(text, r"\. "))


def split_sentences(text: Column) -> Column:
    """Sentences cut at white space that follows '.', '!' or '?'."""
    return _stripped_non_empty(F.split(_strip(text), r"(?U)(?<=[.!?])\s+"))


def split_report(text: Column) -> Column:
    """Report sentences: line wraps joined, cut at a period in front of a capital letter (but not
    at the period that ends a www name), fragments of ten characters or less dropped."""
    t = F.regexp_replace(text, r"\n(?![A-Z])", " ")
    t = _strip(F.regexp_replace(t, _WS, " "))
    t = F.regexp_replace(t, r"(?U)(www\.\S*)\.(?=\s|$)", "$1\u0001")
    parts = F.transform(
        F.split(t, r"(?U)\.\s+(?=[A-Z])"),
        lambda p: F.replace(F.regexp_replace(_strip(p), r"\.+$", ""), F.lit("\u0001"), F.lit(".")),
    )
    return F.filter(parts, lambda p: F.length(p) > 10)


def split_paragraphs(text: Column) -> Column:
    """Template paragraphs: rules removed, headers and short fragments dropped, lines joined."""
    parts = F.transform(
        _stripped_non_empty(F.split(text, r"\n\n")),
        lambda p: _strip(F.regexp_replace(p, r"[=\-]{4,}", "")),
    )
    keep = F.filter(
        parts,
        lambda p: (F.length(p) > 20) & ~p.contains("MITRE") & ~p.contains("ID ") & ~p.contains("NAME"),
    )
    return F.transform(keep, lambda p: _strip(F.replace(p, F.lit("\n"), F.lit(" "))))


def attack_score(sentence: Column) -> Column:
    words = F.regexp_extract_all(F.lower(sentence), F.lit(r"(?U)(\w+)"), F.lit(1))
    points = F.transform(
        words,
        lambda w: F.when(w.isin(*ATTACK_VERBS, *ATTACK_NOUNS), 2).when(w.isin(*TECH_TERMS), 1).otherwise(0),
    )
    return F.aggregate(points, F.lit(0), lambda a, x: a + x)


def parse_triple(sentence: Column) -> Column:
    """struct(src_type, src_name, operation, dst_type, dst_name), null for other sentences."""
    parts = F.filter(F.split(F.regexp_replace(sentence, r"[. \n]+$", ""), _WS), lambda s: s != "")
    ok = (F.size(parts) >= 4) & F.get(parts, F.lit(0)).isin(*PROCESS_KINDS)
    return F.when(
        ok,
        F.struct(
            F.get(parts, F.lit(0)).alias("src_type"),
            F.get(parts, F.lit(1)).alias("src_name"),
            F.get(parts, F.lit(2)).alias("operation"),
            F.get(parts, F.lit(3)).alias("dst_type"),
            F.coalesce(F.get(parts, F.lit(4)), F.lit("")).alias("dst_name"),
        ),
    )


def template_sentence(triple: Column) -> Column:
    op = triple["operation"]
    for k, v in OPERATION_PHRASES.items():
        op = F.when(triple["operation"] == k, v).otherwise(op)
    head = F.concat_ws(" ", triple["src_type"], triple["src_name"], op, triple["dst_type"])
    named = triple["dst_type"].isin(*FILE_KINDS, *PROCESS_KINDS)
    return F.when(named, F.concat(head, F.lit(" "), triple["dst_name"])).when(
        triple["dst_type"].isin(*NETWORK_KINDS), head
    )


def clean_narrative(text: Column) -> Column:
    for old, new in NARRATIVE_REPLACEMENTS:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def operation_reflected(operation: Column, narrative_lower: Column) -> Column:
    """Whether a synonym of the operation occurs; null for operations without synonyms."""
    expr = F.lit(None).cast("boolean")
    for op, words in OPERATION_SYNONYMS.items():
        hit = narrative_lower.contains(words[0])
        for w in words[1:]:
            hit = hit | narrative_lower.contains(w)
        expr = F.when(operation == op, hit).otherwise(expr)
    return expr


def first_contained(word: Column, vocabulary) -> Column:
    w = _strip(F.lower(word))
    expr = None
    for key, label in vocabulary:
        expr = F.when(w.contains(key), label) if expr is None else expr.when(w.contains(key), label)
    return expr.otherwise(w)


def map_verb(word: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in VERB_VOCABULARY.items() for x in kv])
    return F.coalesce(F.try_element_at(table, word), word)


def tactic_label(text: Column) -> Column:
    """'Command & Control - ...' style names to labels: cut at the long dash, '&' -> 'and', '_' joins."""
    name = F.replace(_strip(F.substring_index(text, "—", 1)), F.lit("&"), F.lit("and"))
    return F.array_join(F.filter(F.split(_strip(name), _WS), lambda s: s != ""), "_")


def technique_id(folder: Column) -> Column:
    """'T1219-000' -> 'T1219', 'T1059-004' -> 'T1059.004'."""
    parts = F.split(folder, "-")
    sub = F.coalesce(F.get(parts, F.lit(1)), F.lit("000"))
    return F.when(sub == "000", F.get(parts, F.lit(0))).otherwise(F.concat(F.get(parts, F.lit(0)), F.lit("."), sub))


_OBJECTIVE = r"OBJECTIVE\s*:\s*(.+)"
_SECTION = r"(?s){title}\s*\n-{{10,}}\s*\n+(.*?)\n+-{{10,}}"


def template_focus(text: Column) -> Column:
    """Objective, technique use and outcome of a template joined; the whole text when none is found."""
    def flat(c: Column) -> Column:
        return F.nullif(_strip(F.regexp_replace(c, _WS, " ")), F.lit(""))

    parts = F.concat_ws(
        " ",
        F.nullif(_strip(F.regexp_extract(text, _OBJECTIVE, 1)), F.lit("")),
        flat(F.regexp_extract(text, _SECTION.format(title="TECHNIQUES USE"), 1)),
        flat(F.regexp_extract(text, _SECTION.format(title="OUTCOME / TACTIC LINKS"), 1)),
    )
    return F.when(parts != "", parts).otherwise(text)


def linux_section(text: Column) -> Column:
    """Body under the Linux heading up to the rule line after it; the rule and the blank lines right
    under the heading do not count. The whole text where there is no heading."""
    marker = "LINUX DETECTION STRATEGIES"
    after = F.when(F.instr(text, marker) > 0, F.substring(text, F.instr(text, marker) + len(marker), F.length(text)))
    lines = F.split(after, r"\r\n|\n|\r")
    is_rule = lambda l: F.trim(l).startswith("===") | F.trim(l).startswith("---")
    state = F.aggregate(
        lines,
        F.struct(F.array().cast("array<string>").alias("body"), F.lit(False).alias("done")),
        lambda s, l: F.struct(
            F.when(s["done"] | is_rule(l) | ((F.size(s["body"]) == 0) & (F.trim(l) == "")), s["body"])
            .otherwise(F.concat(s["body"], F.array(l)))
            .alias("body"),
            (s["done"] | (is_rule(l) & (F.size(s["body"]) > 0))).alias("done"),
        ),
        lambda s: s["body"],
    )
    return F.when(after.isNull(), _strip(text)).otherwise(_strip(F.array_join(state, "\n")))


# Report-text patterns, applied in this order.
URL_PATTERN = r"""https?://[^\s,;)>"']+"""
FILE_PATTERN = r"""(?<![:/])/[^\s,;)>"'\n]+"""
ADDRESS_PATTERN = r"\b(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})(:\d+)?\b"
DOMAIN_PATTERN = r"\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9\-]*[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}(?::\d+)?\b"
REPORT_LIBRARY_MARKS = (".dll", ".lib", ".so", ".a")


def _path_role(path: str) -> str:
    from provloom.functions import naming as nm

    low = path.lower()
    base = low.rsplit("/", 1)[-1]
    lead = len(base) - len(base.lstrip("."))
    dot = base.rfind(".")
    bare = (base[:dot] if dot > lead else base).strip("._- ")
    groups = (
        ("email_file", nm.EMAIL_DIRS),
        ("library_file", REPORT_LIBRARY_MARKS + ("/lib",)),
        ("process_file", ("/proc",)),
        ("system_file", nm.SYSTEM_DIRS),
        ("temp_file", nm.TEMP_DIRS),
        ("user_file", nm.USER_DIRS),
    )
    role = next((label for label, marks in groups if any(m in low for m in marks)), "file")
    return f"{role} {bare}" if bare else role


@F.pandas_udf(StringType())
def _name_paths(texts: pd.Series) -> pd.Series:
    pattern = re.compile(FILE_PATTERN)
    return texts.map(lambda t: None if t is None else pattern.sub(lambda m: _path_role(m.group(0)), t))


def abstract_report(text: Column) -> Column:
    """Report text with URLs, file paths, addresses and domains replaced by class names. Only texts
    that hold a slash are sent to Python, for the path callback; the others travel as nulls."""
    t = F.regexp_replace(text, "(?U)" + URL_PATTERN, "public_netflow")
    t = F.coalesce(_name_paths(F.when(t.contains("/"), t)), t)
    # one left-to-right pass brackets the addresses, then each class is named inside the brackets
    t = F.regexp_replace(t, "(?U)" + ADDRESS_PATTERN, "\u0001$1.$2.$3.$4\u0002")
    t = F.regexp_replace(t, "\u0001127\\.[^\u0002]*\u0002", "local_connection")
    private = r"(?:0?10\.|172\.0?(?:1[6-9]|2\d|3[01])\.|192\.168\.)"
    t = F.regexp_replace(t, "\u0001" + private + "[^\u0002]*\u0002", "private_netflow")
    t = F.regexp_replace(t, "\u0001[^\u0002]*\u0002", "public_netflow")
    return F.regexp_replace(t, "(?U)" + DOMAIN_PATTERN, "public_netflow")
