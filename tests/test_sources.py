"""Sources read from real files, and the record rules case by case."""

import json

import pytest
from pyspark.sql import functions as F

from provloom.operators import label
from provloom.session import stage_table
from provloom.sources import audit, cdm, etw, knowledge, lines, reports


def text(spark, rows, file="/x/a.log"):
    return spark.createDataFrame([(v, file, "a", i) for i, v in enumerate(rows)], "value string, file string, file_key string, line_no long")


def test_read_lines_keeps_order_over_files_and_splits(spark, tmp_path):
    for name, n in (("log.json.10", 30), ("log.json.2", 5000), ("log.json", 3)):
        (tmp_path / name).write_text("".join(f"{name}:{i}\n" for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = [r["value"] for r in lines.read_lines(spark, str(tmp_path)).orderBy("file_key", "line_no").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [f"{n}:{i}" for n, c in (("log.json", 3), ("log.json.2", 5000), ("log.json.10", 30)) for i in range(c)]


def test_edge_lines(spark, tmp_path):
    rows = ["a\tP\tb\tF\tR\t5", "a\tP\tb\tF\tR\t 7 ", "a\tb", "a\tP\tb\tF\tR\tx", "a\tP\tb\tF\tR\t1\textra", "a\x00\tP\tb\tF\tR\t1"]
    ok, bad = lines.parse_edge_lines(text(spark, rows))
    assert sorted(r["ts_ns"] for r in ok.collect()) == [5, 7]
    assert sorted(r["reason"] for r in bad.collect()) == ["field count", "field count", "nul byte", "time"]
    lines.write_edges(ok, str(tmp_path / "edges"))
    assert spark.read.parquet(str(tmp_path / "edges")).count() == 2


def test_stage_table_is_read_back(spark, tmp_path):
    calls = []

    def stage():
        calls.append(1)
        return spark.range(3)

    path = str(tmp_path / "stage")
    assert stage_table(stage, spark, path).count() == 3 and stage_table(stage, spark, path).count() == 3 and len(calls) == 1


def cdm_line(kind, **body):
    return json.dumps({"datum": {cdm.NS + kind: body}}, separators=(",", ":"))


def ref(u):
    return {cdm.NS + "UUID": u}


def test_record_log(spark):
    rows = [
        cdm_line("Subject", uuid="p1", type="SUBJECT_PROCESS", cmdLine={"string": "first"}),
        cdm_line("Subject", uuid="p1", type="SUBJECT_PROCESS"),  # later record without a name keeps the old one
        cdm_line("Subject", uuid=cdm.NIL, type="SUBJECT_PROCESS", cmdLine="x"),
        cdm_line("Subject", uuid="u1", type="SUBJECT_UNIT"),
        cdm_line("FileObject", uuid="f1", type="FILE_OBJECT_BLOCK", baseObject={"filename": "null"}),
        cdm_line("NetFlowObject", uuid="n1", localAddress={"string": "1.1.1.1"}, localPort={"int": 5}, remoteAddress="2.2.2.2"),
        cdm_line("MemoryObject", uuid="m1"),
        cdm_line("Host", uuid="h1", type="HOST"),
        cdm_line("Event", type="EVENT_READ", timestampNanos=9, subject=ref("p1"), predicateObject=ref("f1"), predicateObject2=ref("n1")),
        cdm_line("Event", type="EVENT_READ", timestampNanos=3, subject=ref("p1"), predicateObject=ref(cdm.NIL)),
        cdm_line("Event", type="EVENT_READ", timestampNanos=4, subject=ref("gone"), predicateObject=ref("f1")),
        cdm_line("Event", type="EVENT_OPEN", timestampNanos=4, subject=ref("p1"), predicateObject=ref("f1")),
        cdm_line("Event", type="EVENT_WRITE", timestampNanos=5, subject=ref("p1"), predicateObject=ref("new")),
        "\x00" + cdm_line("Event", type="EVENT_WRITE", timestampNanos=5, subject=ref("p1"), predicateObject=ref("f1")),
    ]
    ls = text(spark, rows)
    ent = {r["uuid"]: (r["type"], r["name"]) for r in cdm.entities(ls).collect()}
    assert ent == {"p1": ("SUBJECT_PROCESS", "first"), "f1": ("FILE_OBJECT_BLOCK", None), "n1": ("NetFlowObject", "1.1.1.1_5_2.2.2.2_null")}
    edges = cdm.event_edges(ls, cdm.entities(ls)).orderBy("ts_ns", "line_no").collect()
    assert [(r["src"], r["dst"], r["dst_type"], r["ts_ns"]) for r in edges] == [("p1", "new", "UNKNOWN", 5), ("p1", "f1", "FILE_OBJECT_BLOCK", 9), ("p1", "n1", "NetFlowObject", 9)]
    assert {r["reason"]: r["n"] for r in cdm.event_skips(ls).collect()} == {"nul byte": 1, "EVENT_OPEN": 1}


def test_kernel_log(spark):
    rows = ['{"Event":"ProcessStart","PID":1,"PName":"a","TimeStamp":5,"args":{}}', "{bad", '{"Event":"RegistryClose","PID":1,"PName":"a","TimeStamp":null,"args":{}}', '{"Event":"Other"}', "", '{"Event":"FileIORead","PID":1,"PName":"a","TimeStamp":2,"args":{"FileName":"x"}}']
    s = etw.scan(etw.with_tag(text(spark, rows, "/d/s1.json")))
    e = etw.edges(s)
    assert {r["line_no"]: (r["dst"], r["edge_type"]) for r in e.collect()} == {0: ("proc:1", "process_launch"), 2: ("reg:unresolved:s1:1", "registry_close"), 5: ("file:x", "file_read")}
    assert [r["line_no"] for r in etw.in_time_order(e).orderBy("pos").collect()] == [2, 5, 0]
    t = etw.totals(s, e).first()
    assert (t["n_events"], t["n_kept"], t["n_bad_json"], t["n_unmapped"], t["n_unresolved"]) == (5, 3, 1, 1, 1)
    assert etw.event_map(spark).count() == 35


M = "msg=audit(1765380934.228:{})"
AUDIT = [
    # failed execve without a path record
    f"type=SYSCALL {M.format(1)} success=no ppid=1 pid=2 comm=\"sh\" exe=\"/bin/sh\" ARCH=x86_64 SYSCALL=execve",
    f"type=ANOM_ABEND {M.format(2)} pid=7 comm=\"crash\" sig=11 res=1",
    f"type=ANOM_PROMISCUOUS {M.format(3)} dev=eth0 prom=256 uid=0",
    f"type=NETFILTER_CFG {M.format(4)} table=filter op=nft_register pid=9 comm=\"iptables\"",
    f"type=SYSTEM_SHUTDOWN {M.format(5)} pid=1 comm=\"init\" exe=\"/sbin/init\"",
    f"type=BPF {M.format(6)} prog-id=12 op=LOAD",
    f"type=USER_ERR {M.format(7)} op=login exe=\"/usr/sbin/sshd\"",
    f"type=ADD_USER {M.format(8)} pid=3 op=add user id=1001 exe=\"/usr/sbin/useradd\" res=success",
    f"type=USER_START {M.format(9)} pid=3 exe=\"/x\"",  # no account: dropped
    f"type=SYSCALL {M.format(10)} success=yes pid=2",  # no syscall name: dropped
    f"type=PROCTITLE {M.format(11)} proctitle=x",  # nothing known: dropped
    f"type=SYSCALL {M.format(12)} success=yes ppid=2 pid=3 exe=\"/bin/ls\" ARCH=x SYSCALL=execve",
    f"type=EXECVE {M.format(12)} a0=\"ls\" a1=C3A9 a2=ABC",
    f"type=PATH {M.format(12)} name=\"/bin/ls\" nametype=NORMAL",
    f"type=MMAP {M.format(12)} fd=3 flags=0x2",
    f"type=BPRM_FCAPS {M.format(12)} x=1",
    f"type=SYSCALL {M.format(13)} success=yes pid=3 exe=\"/bin/ls\" ARCH=x SYSCALL=openat",
    f"type=PATH {M.format(13)} name=\"/etc\" nametype=PARENT",
    f"type=SYSCALL {M.format(14)} success=yes pid=3 exe=\"/bin/ls\" ARCH=x SYSCALL=openat",
    f"type=PATH {M.format(14)} name=\"{audit.LOADER}\" nametype=NORMAL",
]


def test_audit_families(spark):
    ev = audit.parse_events(text(spark, AUDIT))
    got = {r["event_id"]: r for r in ev.collect()}
    assert set(got) == {"1", "2", "3", "4", "5", "6", "7", "8", "12", "13", "14"}
    names = {k: (r["src"], r["dest"]) for k, r in got.items()}
    assert names["1"] == ("/bin/sh", None)
    assert names["2"] == ("crash", "crash:sig=11") and names["3"] == ("uid:0", "iface:eth0")
    assert names["4"] == ("iptables", "netfilter:filter") and names["5"] == ("/sbin/init", "system:shutdown")
    assert names["6"] == ("bpf:12", "LOAD") and names["7"] == ("/usr/sbin/sshd", "acct:None:USER_ERR")
    assert names["8"] == ("/usr/sbin/useradd", "acct:uid:1001:ADD_USER") and got["8"]["op"] == "add user"
    assert names["12"] == ("/bin/sh", "/bin/ls") and got["12"]["command"] == "ls é ABC"
    assert names["13"] == ("/bin/ls", "/etc") and names["14"] == ("/bin/ls", None)
    assert (got["12"]["mmap_flags"], got["12"]["fcaps"]) == ("0x2", "yes")
    e = {r["event_id"]: r for r in audit.event_edges(ev).collect()}
    pick = lambda k: (e[k]["src_name"], e[k]["edge_type"], e[k]["dst_name"], e[k]["dst_type"])
    assert pick("1") == ("/bin/sh", "EVENT_EXECVE_FAIL", "unknown", "FileObject")
    assert pick("6") == ("kernel", "EVENT_BPF_LOAD", "bpf-prog:12", "SUBJECT_PROCESS")
    assert pick("7") == ("/usr/sbin/sshd", "EVENT_USER_ERR", "error:login", "FileObject")
    assert pick("14") == ("/bin/ls", "EVENT_OPENAT", "syscall:openat", "SUBJECT_PROCESS")
    assert pick("12")[:2] == ("/bin/sh", "EVENT_EXECVE") and e["12"]["ts_ns"] == 1765380934228000000
    nodes = audit.event_nodes(audit.event_edges(ev)).orderBy("node_id").collect()
    assert [n["name"] for n in nodes][:2] == ["/bin/sh", "unknown"]


def test_primary_host(spark):
    rows = [("t", "s1", "client", 3, 0), ("t", "s1", "zebra", 9, 1), ("t", "s2", "docker-a", 9, 0), ("t", "s2", "linuxshare", 2, 1), ("t", "s2", "linuxshare-b", 7, 2), ("t", "s3", "zebra", 1, 0), ("t", "s4", "zebra", 1, 0), ("t", "s4", "yak", 2, 1)]
    df = spark.createDataFrame([("x", a, b, c, d, e) for a, b, c, d, e in rows], "tactic string, technique string, step string, host_tag string, n_events long, first long")
    got = {r["step"]: r["host_tag"] for r in audit.primary_hosts(df).collect()}
    assert got == {"s1": "zebra", "s2": "docker-a", "s3": "zebra"}


def test_subgraph_layouts(spark):
    one = {"dep_id": 1, "nodes": [[0, {"uuid": "a", "name": "A", "type": "P", "ts": 1}], {"id": "1", "uuid": "b", "name": "B"}, "bare"], "edges": [["a", "b", 0, {"edge_type": "R", "ts": 2}], ["0", "1", {"edge_type": "W", "ts": 3}], {"src": "a", "dest": "bare", "edge_type": "X"}]}
    docs = spark.createDataFrame([(json.dumps({"total_subgraphs": 1, "subgraphs": [one]}),), (json.dumps([dict(one, dep_id=2)]),), (json.dumps(dict(one, dep_id=3)),)], "value string")
    nodes, edges = lines.rebuild_graph(lines.parse_subgraphs(docs), ["dep_id"])
    assert nodes.count() == 9
    for d in (1, 2, 3):
        got = [(r["src_name"], r["edge_type"], r["dst_name"], r["ts_ns"]) for r in edges.filter(F.col("dep_id") == d).orderBy("line_no").collect()]
        assert got == [("A", "R", "B", 2), ("A", "W", "B", 3), ("A", "X", "bare", 0)]


def test_knowledge_bundle(spark, tmp_path):
    ref_ = lambda x: [{"source_name": "other", "external_id": "z"}, {"source_name": "mitre-attack", "external_id": x}]
    objects = [
        {"id": "t", "type": "x-mitre-tactic", "name": "Impact", "x_mitre_shortname": "impact", "external_references": ref_("TA0040")},
        {"id": "a", "type": "attack-pattern", "name": "Alpha", "external_references": ref_("T1"), "kill_chain_phases": [{"kill_chain_name": "mitre-attack", "phase_name": "impact"}]},
        {"id": "b", "type": "attack-pattern", "name": "Beta", "revoked": True, "external_references": ref_("T2"), "kill_chain_phases": [{"kill_chain_name": "mitre-attack", "phase_name": "impact"}]},
        {"id": "r", "type": "relationship", "relationship_type": "detects", "source_ref": "s", "target_ref": "a"},
        {"id": "s", "type": "x-mitre-detection-strategy", "x_mitre_analytic_refs": ["an2", "an1", "an3"]},
        {"id": "an1", "type": "x-mitre-analytic", "description": "one", "x_mitre_platforms": ["Linux"]},
        {"id": "an2", "type": "x-mitre-analytic", "description": " two ", "x_mitre_platforms": ["Windows", "Linux"]},
        {"id": "an3", "type": "x-mitre-analytic", "description": "win", "x_mitre_platforms": ["Windows"]},
    ]
    (tmp_path / "kb.json").write_text(json.dumps({"objects": objects}))
    kb = knowledge.read_bundle(spark, str(tmp_path / "kb.json"))
    got = [(r["tactic_id"], r["tid"], r["description"]) for r in knowledge.tactic_templates(kb).orderBy("pos").collect()]
    assert got == [("TA0040", "T1", "two"), ("TA0040", "T1", "one")]
    wanted = spark.createDataFrame([("T1.004",), ("T9",)], "tid string")
    assert [tuple(r) for r in knowledge.tactics_with_fallback(wanted, knowledge.technique_tactics(kb)).collect()] == [("T1.004", "impact")]


def test_sequence_folder(spark, tmp_path):
    for tactic, name, n in (("impact", "sequence_1_a.json", 3), ("discovery", "sequence_2_a.json", 4), ("impact", "sequence_3_b.json", 2)):
        d = tmp_path / "seq" / tactic / "T1"
        d.mkdir(parents=True, exist_ok=True)
        (d / name).write_text(json.dumps({"tactic": tactic, "step": name[-6:-5], "host": "h", "n_triples": n, "sequence": ["a b c."] * n}, indent=1))
    s = reports.read_sequences(spark, str(tmp_path / "seq"))
    got = {r["step"]: (r["tactic"], r["n_events"], r["dropped"]) for r in reports.first_per_step(s, ["discovery", "impact"]).collect()}
    assert got == {"a": ("discovery", 4, False), "b": ("impact", 2, True)}


def test_names_may_be_missing_in_name_lists(spark):
    e = spark.createDataFrame([("a", None), ("x", "b"), (None, None)], "src_name string, dst_name string")
    assert label.by_names(e, exclude=["x"]).count() == 2


def test_run_log_metrics(spark):
    log = "Ep=1  Loss=2.5\nEp=2 Loss=1.25\nStage 7 x\n  f_1.json  Execution  +0.10  Impact  +0.40\nAll scores: Execution=+0.10 Impact=+0.40 Stealth=+0.30\nAccuracy: 1/1"
    m = reports.run_metrics(F.col("t"))
    r = spark.createDataFrame([(log,), ("",)], "t string").select(*[c.alias(k) for k, c in m.items()]).collect()
    assert (r[0]["loss_ep1"], r[0]["loss_best"], r[0]["top1"], r[0]["top2"], r[0]["top3_score"], r[0]["correct"]) == (2.5, 1.25, "Impact", "Stealth", 0.1, True)
    assert r[1]["loss_best"] is None and not r[1]["correct"]


def test_graph_sink(spark, tmp_path):
    n = spark.createDataFrame([(0, "a")], "node_id long, uuid string")
    e = spark.createDataFrame([(0, 0, "a", "a")], "src_id long, dst_id long, src string, dst string")
    lines.write_graph(n, e, str(tmp_path / "g"))
    assert sorted(spark.read.json(str(tmp_path / "g" / "edges")).columns) == ["dst", "src"]


def test_rebuilt_graphs_send_no_names_to_the_driver(spark):
    docs = spark.createDataFrame([('{"dep_id":1,"nodes":[["7",{"uuid":"o7","name":"n"}]],"edges":[["o7","8",{"edge_type":"E","ts":3}]]}',)], "value string")
    edges = lines.rebuild_graph(lines.parse_subgraphs(docs), ["dep_id"])[1]
    assert [(r["src_name"], r["dst_name"], r["ts_ns"]) for r in edges.collect()] == [("n", "8", 3)]
    assert "Broadcast" not in edges._jdf.queryExecution().executedPlan().toString()
