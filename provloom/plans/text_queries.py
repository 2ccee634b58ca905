"""Scalar functions and text pipelines over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from provloom.functions import naming, network, paths, similarity, timeid
from provloom.functions import text as tx
from provloom.operators import bm25, build, catalog, dedup, sequences
from provloom.plans.registry import named
from provloom.plans.views import query, view

# --- paths -------------------------------------------------------------------------------------

_EXT = "regexp_extract(regexp_extract({0}, '([^/]*)$', 1), '^[.]*[^.].*([.][^.]*)$', 1)"


@named(
    "path_parts",
    f"""SELECT path_id, CASE WHEN regexp_matches(regexp_extract(path, '^(.*/)', 1), '^/*$') THEN regexp_extract(path, '^(.*/)', 1)
           ELSE regexp_replace(regexp_extract(path, '^(.*/)', 1), '/+$', '') END AS dir,
           regexp_extract(path, '([^/]*)$', 1) AS base, {_EXT.format('path')} AS ext,
           left(regexp_extract(path, '([^/]*)$', 1), len(regexp_extract(path, '([^/]*)$', 1)) - len({_EXT.format('path')})) AS stem,
           CAST(len(path) - len(replace(path, '/', '')) AS BIGINT) AS depth FROM path_list""",
)
def path_parts(spark, sf):
    p = F.col("path")
    return view(spark, sf, "path_list").select(
        "path_id", paths.dirname(p).alias("dir"), paths.basename(p).alias("base"), paths.extension(p).alias("ext"),
        paths.stem(p).alias("stem"), paths.depth(p).cast("long").alias("depth"),
    )


_LIFT = """base AS (SELECT path_id, path, list_filter(string_split(path, '/'), lambda x: x <> '' AND x <> '.') AS p FROM path_list),
    s AS (SELECT *, len(p) AS n, p[len(p)] AS name, regexp_extract(p[len(p)], '^.+[.]([^.]+)$', 1) AS e,
          regexp_extract(p[len(p)], '^(.+)[.][^.]+$', 1) AS f FROM base WHERE starts_with(path, '/') AND path NOT LIKE '%/'),
    l AS (SELECT *, concat('/', array_to_string(p[1:n - 1], '/'), '/') AS dir,
          list_max(list_transform(generate_series(1, n - 1), lambda i: CASE WHEN p[i] IN ('lib', 'lib32', 'lib64') THEN i ELSE 0 END)) AS lib FROM s),
    lifted AS (SELECT path_id, path, CASE
      WHEN e <> '' AND p[1] IN ('etc', 'var') AND n >= 3 THEN concat(p[1], ' ', p[2], ' ', e, ' file')
      WHEN e = '' AND p[1] IN ('etc', 'var') AND n = 2 THEN concat(name, ' file')
      WHEN e <> '' AND regexp_matches(dir, '^/(usr/|usr/local/)?s?bin/') THEN concat(f, ' ', e, ' file')
      WHEN e <> '' AND p[1] = 'home' AND n >= 4 THEN concat('user ', p[3], ' ', f, ' ', e, ' file')
      WHEN e <> '' AND p[1] = 'root' AND n >= 3 THEN concat('root user ', p[2], ' ', f, ' ', e, ' file')
      WHEN e <> '' AND lib > 0 AND lib < n - 1 THEN concat(p[lib + 1], ' library file')
      WHEN e <> '' THEN concat(e, ' file') END AS lifted FROM l)"""


@named(
    "lifted_paths",
    f"WITH {_LIFT} SELECT b.path_id, l.lifted FROM path_list b LEFT JOIN lifted l ON l.path_id = b.path_id",
)
def lifted_paths(spark, sf):
    """Seven lifting rules in priority order."""
    return view(spark, sf, "path_list").select("path_id", paths.lift_path(F.col("path")).alias("lifted"))


@named(
    "unresolved_path_frequency",
    f"""WITH {_LIFT} SELECT b.path, count(*) AS n FROM path_list b LEFT JOIN lifted l ON l.path_id = b.path_id
    WHERE l.lifted IS NULL OR l.lifted = b.path GROUP BY b.path""",
)
def unresolved_path_frequency(spark, sf):
    n = view(spark, sf, "path_list").select(F.col("path").alias("name"), F.lit("FILE").alias("type"))
    return catalog.unresolved_paths(n)


@named(
    "unresolved_paths_top",
    f"""WITH {_LIFT} SELECT b.path, count(*) AS n FROM path_list b LEFT JOIN lifted l ON l.path_id = b.path_id
    WHERE l.lifted IS NULL OR l.lifted = b.path GROUP BY b.path ORDER BY n DESC, b.path LIMIT 30""",
)
def unresolved_paths_top(spark, sf):
    return catalog.most_frequent(unresolved_path_frequency(spark, sf))


# --- addresses ---------------------------------------------------------------------------------

_ADDR = """SELECT o_orderkey AS id, CASE o_orderkey % 9
    WHEN 0 THEN concat('10.', CAST(o_custkey % 300 AS STRING), '.3.4') WHEN 1 THEN concat('172.', CAST(o_custkey % 40 AS STRING), '.0.1:8080')
    WHEN 2 THEN concat('192.168.', CAST(o_custkey % 256 AS STRING), '.9') WHEN 3 THEN concat('8.8.', CAST(o_custkey % 400 AS STRING), '.8:53')
    WHEN 4 THEN '0.0.0.0' WHEN 5 THEN concat('host', CAST(o_custkey AS STRING), ':22') WHEN 6 THEN concat('169.254.1.', CAST(o_custkey % 256 AS STRING))
    WHEN 7 THEN concat('127.0.0.1:', CAST(o_custkey AS STRING)) ELSE concat('acct:user', CAST(o_custkey AS STRING)) END AS name FROM orders"""
_ADDR_SQL = f"""a AS (SELECT id, name, CASE WHEN regexp_full_match(name, '([0-9]{{1,3}}[.]){{3}}[0-9]{{1,3}}') THEN name
        WHEN regexp_full_match(regexp_replace(name, ':[^:]*$', ''), '([0-9]{{1,3}}[.]){{3}}[0-9]{{1,3}}') AND contains(name, ':')
        THEN regexp_replace(name, ':[^:]*$', '') END AS ip FROM ({_ADDR})),
    b AS (SELECT id, name, CASE WHEN list_max(list_transform(string_split(ip, '.'), lambda o: CAST(o AS INT))) <= 255 THEN ip END AS ip FROM a),
    c AS (SELECT id, name, ip, CASE WHEN ip IS NULL THEN name WHEN ip = '0.0.0.0' OR regexp_matches(ip, '^(10|127|169[.]254|192[.]168)[.]')
        OR (starts_with(ip, '172.') AND CAST(split_part(ip, '.', 2) AS INT) BETWEEN 16 AND 31) THEN 'internal network address'
        ELSE 'external network address' END AS new_name FROM b)"""


@named("address_generalisation", f"WITH {_ADDR_SQL} SELECT id, ip, new_name FROM c")
def address_generalisation(spark, sf):
    n = F.col("name")
    return query(spark, sf, _ADDR).select("id", network.address_of(n).alias("ip"), network.generalize_address(n).alias("new_name"))


@named(
    "generalisation_counters",
    f"""WITH {_ADDR_SQL}, {_LIFT}, x AS (SELECT b.path, l.lifted FROM path_list b LEFT JOIN lifted l ON l.path_id = b.path_id)
    SELECT (SELECT count(ip) FROM c) AS n_addresses, (SELECT count(*) FROM c WHERE ip IS NOT NULL AND new_name LIKE 'internal%') AS n_internal,
      (SELECT count(*) FROM c WHERE ip IS NOT NULL AND new_name LIKE 'external%') AS n_external, (SELECT count(DISTINCT ip) FROM c) AS n_unique_addresses,
      (SELECT count(*) FROM x WHERE lifted IS NOT NULL AND lifted <> path) AS n_lifted,
      (SELECT count(DISTINCT path) FROM x WHERE lifted IS NOT NULL AND lifted <> path) AS n_unique_lifted,
      (SELECT count(*) FROM x WHERE lifted IS NULL OR lifted = path) AS n_unchanged,
      (SELECT count(DISTINCT path) FROM x WHERE lifted IS NULL OR lifted = path) AS n_unique_unchanged""",
)
def generalisation_counters(spark, sf):
    nodes = query(spark, sf, _ADDR).select("name", F.lit("NetFlowObject").alias("type")).unionByName(
        view(spark, sf, "path_list").select(F.col("path").alias("name"), F.lit("FILE").alias("type"))
    )
    return catalog.generalization_counts(catalog.generalize_nodes(nodes))


@named(
    "flow_name_parts",
    """SELECT uuid, CASE WHEN split_part(name, '_', 1) = '' THEN 'null' ELSE split_part(name, '_', 1) END AS local_ip,
      CASE WHEN len(string_split(name, '_')) > 1 THEN split_part(name, '_', 2) ELSE 'null' END AS local_port,
      CASE WHEN len(string_split(name, '_')) > 2 THEN split_part(name, '_', 3) ELSE 'null' END AS remote_ip,
      CASE WHEN len(string_split(name, '_')) > 3 THEN split_part(name, '_', 4) ELSE 'null' END AS remote_port
    FROM host_name WHERE type = 'NetFlowObject'""",
)
def flow_name_parts(spark, sf):
    n = view(spark, sf, "host_name").filter("type = 'NetFlowObject'")
    parts = ("local_ip", "local_port", "remote_ip", "remote_port")
    return n.select("uuid", *[network.flow_part(F.col("name"), i).alias(p) for i, p in enumerate(parts)])


# --- node names --------------------------------------------------------------------------------

_STEM = "trim(left(regexp_extract(lower(name), '([^/]*)$', 1), len(regexp_extract(lower(name), '([^/]*)$', 1)) - len(" + _EXT.format("lower(name)") + ")), '._- ')"
_LABEL_SQL = f"""x AS (SELECT uuid, type, name, lower(name) AS low, {_STEM} AS stem,
      regexp_extract_all(name, '(?:^|_)([0-9]{{1,3}}(?:[.][0-9]{{1,3}}){{3}})', 1) AS ips,
      regexp_replace(lower(regexp_extract(regexp_replace(regexp_extract(name, '^([^ ]*)', 1), '^-', ''), '([^/]*)$', 1)), ':+$', '') AS cmd FROM host_name),
    r AS (SELECT *, CASE
      WHEN regexp_matches(low, 'thunderbird|outlook|evolution|mutt|[.]mail') THEN 'email_file'
      WHEN regexp_matches(low, '[.]dll|[.]exe|[.]lib|[.]so|[.]a|/lib') THEN 'library_file'
      WHEN contains(low, '/proc') THEN 'process_file'
      WHEN regexp_matches(low, '/dev/|/sys/|/boot|/bin|/sbin|/etc/|/var/|/root|/run') THEN 'system_file'
      WHEN regexp_matches(low, '/tmp|/temp') THEN 'temp_file'
      WHEN regexp_matches(low, '/home/|/usr/|/opt/|/[.]cache') THEN 'user_file' END AS role FROM x),
    lab AS (SELECT uuid, type, name, CASE
      WHEN type LIKE '%FILE%' THEN CASE WHEN regexp_matches(low, '^(hkey|hkcu|hkcr|hklm|hku|hkcc)') THEN 'registry run key'
        WHEN role IS NULL THEN name WHEN stem <> '' THEN concat(role, ' ', stem) ELSE role END
      WHEN type LIKE '%Flow%' THEN CASE WHEN contains(name, 'NA_null') OR contains(name, 'NA_0') THEN 'network_failure'
        WHEN starts_with(name, 'NETLINK') THEN 'kernel_socket' WHEN len(ips) < 2 OR starts_with(ips[len(ips)], '127.') THEN 'local_connection'
        WHEN regexp_matches(ips[len(ips)], '^(10[.]|192[.]168[.]|172[.](1[6-9]|2[0-9]|3[01])[.])') THEN 'private_netflow' ELSE 'public_netflow' END
      ELSE CASE WHEN regexp_matches(cmd, 'firefox|chrome') THEN concat('web_process ', cmd)
        WHEN regexp_matches(cmd, 'mail|thunderbird|outlook|evolution|mutt') THEN concat('email_process ', cmd)
        WHEN regexp_matches(cmd, 'cron|sshd|httpd|mysqld|nginx') THEN concat('service_process ', cmd)
        WHEN regexp_matches(cmd, 'metacity|nautilus|unity|fluxbox') THEN concat('user_process ', cmd)
        WHEN cmd IN ('bash', 'cat', 'sh', 'ls') THEN concat('system_process ', cmd)
        WHEN regexp_matches(low, '/bin/|/usr/sbin/|/snap/bin/') THEN concat('util_process ', cmd)
        WHEN regexp_matches(low, '/bin|/sbin|/etc/|/var|/sys|/run|/lib/systemd') THEN concat('system_process ', cmd)
        WHEN regexp_matches(low, '/tmp/|/temp/') THEN concat('temp_process ', cmd)
        WHEN regexp_matches(low, '/home/|/usr/|/opt/') THEN concat('user_process ', cmd) ELSE name END END AS label FROM r)"""


@named("node_labels", f"WITH {_LABEL_SQL} SELECT uuid, label FROM lab")
def node_labels(spark, sf):
    """First vocabulary: process, file and network roles."""
    n = view(spark, sf, "host_name")
    return n.select("uuid", naming.node_label(F.col("name"), F.col("type")).alias("label"))


@named(
    "path_file_labels",
    f"""WITH x AS (SELECT path_id AS uuid, path AS name FROM path_list),
    y AS (SELECT uuid, name, lower(name) AS low, {_STEM} AS stem FROM x),
    r AS (SELECT *, CASE
      WHEN regexp_matches(low, 'thunderbird|outlook|evolution|mutt|[.]mail') THEN 'email_file'
      WHEN regexp_matches(low, '[.]dll|[.]exe|[.]lib|[.]so|[.]a|/lib') THEN 'library_file'
      WHEN contains(low, '/proc') THEN 'process_file'
      WHEN regexp_matches(low, '/dev/|/sys/|/boot|/bin|/sbin|/etc/|/var/|/root|/run') THEN 'system_file'
      WHEN regexp_matches(low, '/tmp|/temp') THEN 'temp_file'
      WHEN regexp_matches(low, '/home/|/usr/|/opt/|/[.]cache') THEN 'user_file' END AS role FROM y)
    SELECT uuid AS path_id, CASE WHEN role IS NULL THEN name WHEN stem <> '' THEN concat(role, ' ', stem) ELSE role END AS label FROM r""",
)
def path_file_labels(spark, sf):
    return view(spark, sf, "path_list").select("path_id", naming.file_label(F.col("path")).alias("label"))


_CLASS_SQL = """y AS (SELECT uuid, type, name, lower(name) AS low, lower(regexp_extract(name, '([^/]*)$', 1)) AS base,
      regexp_extract(name, '^([^ ]*)', 1) AS tok, string_split(name, '_') AS q FROM host_name),
    z AS (SELECT *, lower(tok) AS lt, lower(regexp_extract(tok, '([^/]*)$', 1)) AS cmd, q[3] AS ip, q[len(q)] AS port FROM y),
    cls AS (SELECT uuid, type, name, CASE
      WHEN type LIKE '%SUBJECT%' THEN CASE WHEN starts_with(tok, './') OR regexp_matches(lt, '/home/|/root/|/tmp/|/temp/') THEN concat('user_process ', name)
        WHEN cmd = 'firefox' THEN concat('browser_process ', name) WHEN cmd = 'thunderbird' THEN concat('mail_process ', name)
        WHEN cmd IN ('sshd', 'cron') THEN concat('service_process ', name) WHEN cmd IN ('bash', 'sh') THEN concat('shell_process ', name)
        WHEN cmd = 'gnome-terminal' THEN concat('ui_process ', name) WHEN cmd = 'fluxbox' THEN concat('window_manager ', name)
        WHEN regexp_matches(lt, '/usr/bin/|/usr/sbin/|/bin/|/sbin/|/snap/bin/|/usr/local/s?bin/') THEN concat('utility_process ', name)
        ELSE concat('process_', name) END
      WHEN type LIKE '%NetFlow%' THEN CASE WHEN q[1] = 'LOCAL' THEN concat('unreachable_host local:', coalesce(q[2], '0'))
        WHEN len(q) < 4 THEN name WHEN ip = 'NA' OR port IN ('null', '0') THEN concat('unreachable_host NA:', q[2])
        WHEN regexp_matches(ip, '^(10[.]|192[.]168[.]|127[.]|128[.]55[.]|172[.](1[6-9]|2[0-9]|3[01])[.])') THEN concat('internal_host ', ip, ':', port)
        ELSE concat('external_host ', ip, ':', port) END
      ELSE CASE WHEN name IN ('/', '/etc', '/root', '/usr') THEN concat('directory ', name)
        WHEN contains(low, '.mozilla') AND contains(low, '/home/') THEN concat('browser_data ', name)
        WHEN contains(low, '.thunderbird') THEN concat('mail_data ', name)
        WHEN contains(low, '/tmp/') THEN concat('temporary_file ', name) WHEN base LIKE '%.cache' THEN concat('cache_file ', name)
        WHEN contains(base, '.so') OR contains(low, '/lib/') THEN concat('library_file ', name)
        WHEN contains(low, '/var/log/') THEN concat('log_file ', name) WHEN starts_with(low, '/etc/') THEN concat('configuration_file ', name)
        WHEN starts_with(low, '/dev/') THEN concat('device_file ', name) WHEN starts_with(low, '/sys/') THEN concat('system_file ', name)
        WHEN starts_with(low, '/bin/') OR starts_with(low, '/sbin/') OR base LIKE '%.bin' OR contains(low, '/downloads/') THEN concat('bin_file ', name)
        WHEN contains(low, '/home/') THEN concat('user_file ', name) ELSE concat('directory ', name) END END AS class FROM z)"""


@named("node_classes", f"WITH {_CLASS_SQL} SELECT uuid, class FROM cls")
def node_classes(spark, sf):
    """Second vocabulary: host, process and file classes that keep the full name."""
    n = view(spark, sf, "host_name")
    return n.select("uuid", naming.node_class(F.col("name"), F.col("type")).alias("class"))


# --- sentences and sequences -------------------------------------------------------------------


@named(
    "labelled_sentences",
    f"""WITH {_LABEL_SQL} SELECT e.src AS seq_id, row_number() OVER (PARTITION BY e.src ORDER BY e.ts_ns, e.line_no) AS pos,
    concat(s.label, ' ', lower(replace(e.edge_type, 'EVENT_', '')), ' ', d.label, '.') AS text
    FROM host_edge e JOIN lab s ON s.uuid = e.src JOIN lab d ON d.uuid = e.dst""",
)
def labelled_sentences(spark, sf):
    """One sequence per process: abstract sentences in time order."""
    names = node_labels(spark, sf).withColumnRenamed("label", "name")
    e = build.endpoint_names(view(spark, sf, "host_edge"), names).withColumnRenamed("src", "seq_id")
    return sequences.sentences(e, ["seq_id"])


@named(
    "tactic_sentences",
    f"""WITH {_CLASS_SQL}, t AS (SELECT e.src AS seq_id, e.ts_ns, e.line_no,
    concat(s.class, ' ', lower(replace(replace(e.edge_type, 'EVENT_', ''), 'RECVFROM', 'receivefrom')), ' ', d.class, '.') AS text
    FROM host_edge e JOIN cls s ON s.uuid = e.src JOIN cls d ON d.uuid = e.dst)
    SELECT seq_id, row_number() OVER (PARTITION BY seq_id ORDER BY ts_ns, line_no) AS pos, text FROM t WHERE NOT contains(text, 'unreachable_host local:9')""",
)
def tactic_sentences(spark, sf):
    """Second-vocabulary sentences without the marked unreachable hosts."""
    names = node_classes(spark, sf).withColumnRenamed("class", "name")
    e = build.endpoint_names(view(spark, sf, "host_edge"), names).withColumnRenamed("src", "seq_id")
    e = e.withColumn("text", naming.sentence(F.col("src_name"), naming.tactic_verb(F.col("edge_type")), F.col("dst_name")))
    kept = sequences.drop_marked(e, "unreachable_host local:9")
    return catalog.group_positions(kept, ["seq_id"], ["ts_ns", "line_no"]).select("seq_id", "pos", "text")


@named(
    "adjacency_order_sentences",
    """WITH n AS (SELECT src, min((ts_ns, line_no)) AS f FROM host_edge GROUP BY src),
    p AS (SELECT *, min((ts_ns, line_no)) OVER (PARTITION BY src, dst) AS pf FROM host_edge)
    SELECT p.edge_type AS seq_id, row_number() OVER (PARTITION BY p.edge_type ORDER BY n.f, p.pf, p.ts_ns, p.line_no) AS pos,
    concat(p.src, ' ', lower(p.edge_type), ' ', p.dst, '.') AS text FROM p JOIN n ON n.src = p.src""",
)
def adjacency_order_sentences(spark, sf):
    """Sentences in graph adjacency order: by source, then by the pair's first edge."""
    e = view(spark, sf, "host_edge")
    nodes = build.number_nodes(e).select(F.col("uuid").alias("src"), F.col("node_id").alias("src_id"))
    pair = e.groupBy("src", "dst").agg(F.min(F.struct("ts_ns", "line_no")).alias("f"))
    e = e.join(nodes, "src").join(pair.select("src", "dst", F.col("f.ts_ns").alias("pair_ts"), F.col("f.line_no").alias("pair_line")), ["src", "dst"])
    e = e.withColumn("src_name", F.col("src")).withColumn("dst_name", F.col("dst")).withColumn("seq_id", F.col("edge_type"))
    return sequences.adjacency_sentences(e, ["seq_id"])


@named(
    "sequence_texts",
    """SELECT src, count(*) AS n_triples,
    string_agg(concat(src, ' ', lower(replace(edge_type, 'EVENT_', '')), ' ', dst, '.'), ' ' ORDER BY ts_ns, line_no) AS sequence
    FROM host_edge GROUP BY src""",
)
def sequence_texts(spark, sf):
    e = view(spark, sf, "host_edge").withColumn("src_name", F.col("src")).withColumn("dst_name", F.col("dst"))
    return sequences.sequence_text(sequences.sentences(e, ["src"]), ["src"])


_SHORT = """SELECT user_id AS seq_id, event_id AS pos, concat(CASE event_type WHEN 'view' THEN 'user_process a' WHEN 'click' THEN 'web_process b'
    ELSE 'util_process c' END, CASE WHEN k % 4 = 0 THEN ' read user_file x.' WHEN k % 4 = 1 THEN ' connect public_netflow.'
    WHEN k % 4 = 2 THEN ' write temp_file y.' ELSE ' clone' END) AS text FROM (SELECT user_id % 10 AS user_id, event_id, event_type, k FROM host_event)"""


@named(
    "adjacent_repeats_dropped",
    f"""SELECT seq_id, pos, text FROM (SELECT *, lag(text) OVER (PARTITION BY seq_id ORDER BY pos) AS b FROM ({_SHORT}))
    WHERE b IS NULL OR text <> b""",
)
def adjacent_repeats_dropped(spark, sf):
    return sequences.drop_adjacent_repeats(query(spark, sf, _SHORT), ["seq_id"])


_ALT = f"""d AS (SELECT seq_id, pos, text FROM (SELECT *, lag(text) OVER (PARTITION BY seq_id ORDER BY pos) AS b FROM ({_SHORT})) WHERE b IS NULL OR text <> b),
    l AS (SELECT seq_id, list(text ORDER BY pos) AS ts, list(pos ORDER BY pos) AS ps FROM d GROUP BY seq_id),
    step AS (SELECT seq_id, ts, ps, 1 AS i FROM l
      UNION ALL SELECT seq_id,
        CASE WHEN ts[i] = ts[i + 2] AND ts[i + 1] = ts[i + 3] THEN list_concat(ts[:i + 1], ts[i + 4:]) ELSE ts END,
        CASE WHEN ts[i] = ts[i + 2] AND ts[i + 1] = ts[i + 3] THEN list_concat(ps[:i + 1], ps[i + 4:]) ELSE ps END,
        CASE WHEN ts[i] = ts[i + 2] AND ts[i + 1] = ts[i + 3] THEN i ELSE i + 1 END
      FROM step WHERE i <= len(ts) - 3),
    fin AS (SELECT seq_id, ts, ps FROM step WHERE i > len(ts) - 3),
    alt AS (SELECT seq_id, unnest(ps) AS pos, unnest(ts) AS text FROM fin)"""


@named("alternating_pairs_dropped", f"WITH RECURSIVE {_ALT} SELECT seq_id, pos, text FROM alt")
def alternating_pairs_dropped(spark, sf):
    """A B A B -> A B to a fix point; the checking SQL deletes pair by pair."""
    d = sequences.drop_adjacent_repeats(query(spark, sf, _SHORT), ["seq_id"])
    return sequences.drop_alternating_pairs(d, ["seq_id"])


@named(
    "parsed_triples",
    f"""WITH p AS (SELECT seq_id, pos, string_split(rtrim(text, '. '), ' ') AS w FROM ({_SHORT}))
    SELECT seq_id, pos, w[1] AS src_type, w[2] AS src_name, w[3] AS operation, w[4] AS dst_type, coalesce(w[5], '') AS dst_name FROM p WHERE len(w) >= 4""",
)
def parsed_triples(spark, sf):
    t = query(spark, sf, _SHORT).withColumn("t", tx.parse_triple(F.col("text"))).filter("t is not null")
    return t.select("seq_id", "pos", "t.*")


@named(
    "template_sentences",
    f"""WITH p AS (SELECT seq_id, pos, string_split(rtrim(text, '. '), ' ') AS w FROM ({_SHORT}))
    SELECT seq_id, pos, CASE WHEN w[4] LIKE '%file' THEN concat(w[1], ' ', w[2], ' ', w[3], ' ', w[4], ' ', coalesce(w[5], ''))
    ELSE concat(w[1], ' ', w[2], ' ', CASE WHEN w[3] = 'connect' THEN 'connect to' ELSE w[3] END, ' ', w[4]) END AS sentence FROM p WHERE len(w) >= 4""",
)
def template_sentences(spark, sf):
    t = query(spark, sf, _SHORT).withColumn("t", tx.parse_triple(F.col("text"))).filter("t is not null")
    return t.select("seq_id", "pos", tx.template_sentence(F.col("t")).alias("sentence"))


_FORMATTED = f"""w AS (SELECT seq_id, pos, string_split(rtrim(text, '. '), ' ') AS w FROM ({_SHORT})),
    tmpl AS (SELECT seq_id, pos, CASE WHEN w[4] LIKE '%file' THEN concat(w[1], ' ', w[2], ' ', w[3], ' ', w[4], ' ', coalesce(w[5], ''))
      ELSE concat(w[1], ' ', w[2], ' ', CASE WHEN w[3] = 'connect' THEN 'connect to' ELSE w[3] END, ' ', w[4]) END AS text FROM w WHERE len(w) >= 4)"""


@named(
    "formatted_document_lines",
    f"WITH RECURSIVE {_FORMATTED}, {_ALT.replace(f'({_SHORT})', 'tmpl')}, ln AS (SELECT seq_id, text, row_number() OVER (PARTITION BY seq_id ORDER BY pos) AS line FROM alt) "
    "SELECT seq_id, line, concat(CAST(line AS STRING), '. ', text) AS text FROM ln",
)
def formatted_document_lines(spark, sf):
    """Numbered template sentences without repeats and alternations."""
    return sequences.formatted_sentences(query(spark, sf, _SHORT), ["seq_id"])


_BY_USER = _SHORT.replace("user_id % 10 AS user_id", "user_id")


@named(
    "narrative_issues",
    f"""WITH p AS (SELECT seq_id, pos, string_split(rtrim(text, '. '), ' ') AS w FROM ({_BY_USER})),
    t AS (SELECT seq_id, pos, w[3] AS op, coalesce(w[5], '') AS dst FROM p WHERE len(w) >= 4),
    n AS (SELECT doc_id AS seq_id, lower(text) AS low FROM documents)
    SELECT t.seq_id, t.pos, concat('Missing target ''', dst, ''' for operation ''', op, '''') AS issue FROM t JOIN n ON n.seq_id = t.seq_id
    WHERE dst <> '' AND NOT contains(low, dst)
    UNION ALL SELECT t.seq_id, t.pos, concat('Operation ''', op, ''' not reflected in narrative') FROM t JOIN n ON n.seq_id = t.seq_id
    WHERE dst <> '' AND ((op = 'read' AND NOT regexp_matches(low, 'read')) OR (op = 'write' AND NOT regexp_matches(low, 'wrote|write|written')))""",
)
def narrative_issues(spark, sf):
    n = query(spark, sf, "SELECT doc_id AS seq_id, text AS narrative FROM documents")
    return sequences.narrative_issues(query(spark, sf, _BY_USER), n, ["seq_id"])


@named(
    "cleaned_narratives",
    """SELECT conv_id, turn, replace(replace(replace(replace(replace(replace(replace(concat(text, ' was cloned, those files and these files'),
    'was cloned', 'cloned itself'), 'were cloned', 'cloned themselves'), 'has been cloned', 'cloned itself'), 'got cloned', 'cloned itself'),
    'those files', 'the specified files'), 'the above files', 'the specified files'), 'these files', 'the specified files') AS text FROM conversations""",
)
def cleaned_narratives(spark, sf):
    c = query(spark, sf, "SELECT conv_id, turn, concat(text, ' was cloned, those files and these files') AS text FROM conversations")
    return c.withColumn("text", tx.clean_narrative(F.col("text")))


_SVO = """SELECT o_custkey AS seq_id, o_orderkey AS pos,
    CASE o_orderkey % 5 WHEN 0 THEN 'Firefox browser' WHEN 1 THEN 'malware' WHEN 2 THEN 'bash' WHEN 3 THEN 'Emails' ELSE 'kernel' END AS subject,
    CASE o_orderkey % 4 WHEN 0 THEN 'inject' WHEN 1 THEN 'download' WHEN 2 THEN 'steal' ELSE 'scan' END AS verb,
    CASE o_orderkey % 6 WHEN 0 THEN 'config file' WHEN 1 THEN 'server' WHEN 2 THEN 'memory' WHEN 3 THEN 'chip' WHEN 4 THEN 'DLL' ELSE 'key' END AS object FROM orders"""


@named(
    "abstract_triples",
    f"""WITH t AS (SELECT seq_id, pos, concat(
      CASE subject WHEN 'Firefox browser' THEN 'web_process' WHEN 'malware' THEN 'user_process' WHEN 'bash' THEN 'system_process' WHEN 'Emails' THEN 'email_process' ELSE 'kernel' END, ' ',
      CASE verb WHEN 'inject' THEN 'execute' WHEN 'download' THEN 'receive' WHEN 'steal' THEN 'read' ELSE verb END, ' ',
      CASE object WHEN 'config file' THEN 'user_file' WHEN 'server' THEN 'public_netflow' WHEN 'memory' THEN 'process_file' WHEN 'chip' THEN 'public_netflow' WHEN 'DLL' THEN 'library_file' ELSE 'key' END) AS text
      FROM ({_SVO})), f AS (SELECT seq_id, text, min(pos) AS p FROM t GROUP BY seq_id, text)
    SELECT seq_id, row_number() OVER (PARTITION BY seq_id ORDER BY p) AS pos, text FROM f""",
)
def abstract_triples(spark, sf):
    """Triples in the abstract vocabulary, first of equal ones kept in order."""
    return sequences.abstract_triples(query(spark, sf, _SVO), ["pos"], ["seq_id"])


# --- sentence splits and scores ----------------------------------------------------------------


@named(
    "sentences_by_period",
    """SELECT doc_id, trim(s, ' \t\n\r') AS sentence, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, '. ')) AS s FROM documents)
    WHERE trim(s, ' \t\n\r') <> '' GROUP BY ALL""",
)
def sentences_by_period(spark, sf):
    d = query(spark, sf, "SELECT doc_id, text FROM documents").select("doc_id", F.explode(tx.split_period(F.col("text"))).alias("sentence"))
    return d.groupBy("doc_id", "sentence").agg(F.count(F.lit(1)).alias("n"))


_SENTS = """SELECT doc_id, unnest(list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)),
      lambda s: trim(s, ' \t\n\r')), lambda s: s <> '')) AS sentence FROM documents"""


@named(
    "sentences_by_mark",
    f"SELECT doc_id, sentence, count(*) AS n FROM ({_SENTS}) GROUP BY ALL",
)
def sentences_by_mark(spark, sf):
    d = query(spark, sf, "SELECT doc_id, text FROM documents").select("doc_id", F.explode(tx.split_sentences(F.col("text"))).alias("sentence"))
    return d.groupBy("doc_id", "sentence").agg(F.count(F.lit(1)).alias("n"))


_W2 = "|".join(dict.fromkeys([*tx.ATTACK_VERBS, *tx.ATTACK_NOUNS]))
_W1 = "|".join(tx.TECH_TERMS)
_SCORED = """SELECT doc_id AS id, concat(text, CASE doc_id % 4 WHEN 0 THEN ' The malware connected to a server. Nothing here!'
    WHEN 1 THEN ' An IP link, the shell.' WHEN 2 THEN ' Ransomware payload executed? Yes.' ELSE '' END) AS text FROM documents"""


@named(
    "attack_sentences",
    f"""WITH s AS (SELECT id, unnest(list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)),
      lambda s: trim(s, ' \t\n\r')), lambda s: s <> '')) AS sentence FROM ({_SCORED})),
    w AS (SELECT id, sentence, regexp_extract_all(lower(sentence), '[\\p{{L}}\\p{{N}}_]+') AS ws FROM s),
    sc AS (SELECT id, sentence, CAST(list_sum(list_transform(ws, lambda x: CASE WHEN regexp_full_match(x, '{_W2}') THEN 2 WHEN regexp_full_match(x, '{_W1}') THEN 1 ELSE 0 END)) AS BIGINT) AS score FROM w)
    SELECT id, sentence, score, count(*) AS n FROM sc WHERE score >= 2 GROUP BY ALL""",
)
def attack_sentences(spark, sf):
    """Sentences with an attack score of two or more."""
    s = query(spark, sf, _SCORED).select("id", F.explode(tx.split_sentences(F.col("text"))).alias("sentence"))
    s = s.withColumn("score", tx.attack_score(F.col("sentence")).cast("long")).filter("score >= 2")
    return s.groupBy("id", "sentence", "score").agg(F.count(F.lit(1)).alias("n"))


@named(
    "report_sentences",
    """WITH p AS (SELECT doc_id, unnest(string_split(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '[.]\\s+([A-Z])', chr(1) || '\\1', 'g'), chr(1))) AS s FROM documents),
    q AS (SELECT doc_id, rtrim(trim(s), '.') AS sentence FROM p)
    SELECT doc_id, sentence, count(*) AS n FROM q WHERE len(sentence) > 10 GROUP BY ALL""",
)
def report_sentences(spark, sf):
    """Report splitter on whole texts (names with dots are checked in the tests)."""
    d = query(spark, sf, "SELECT doc_id, text FROM documents")
    s = d.select("doc_id", F.explode(tx.split_report(F.col("text"))).alias("sentence"))
    return s.groupBy("doc_id", "sentence").agg(F.count(F.lit(1)).alias("n"))


@named(
    "indel_ratio_of_names",
    """WITH n AS (SELECT DISTINCT p_name AS a, p_brand AS b FROM part)
    SELECT a, b, round(2.0 * (len(a) - bit_count(list_reduce(list_transform(string_split(b, ''),
      lambda c: list_sum(list_transform(generate_series(1, len(a)), lambda i: CASE WHEN a[i] = c THEN 1::BIGINT << (i - 1) ELSE 0 END))::BIGINT),
      lambda r, m: ((r + (r & m)) | (r & ~m)) & ((1::BIGINT << len(a)) - 1), (1::BIGINT << len(a)) - 1))) / (len(a) + len(b)), 6) AS ratio FROM n""",
)
def indel_ratio_of_names(spark, sf):
    n = query(spark, sf, "SELECT DISTINCT p_name AS a, p_brand AS b FROM part")
    return n.withColumn("ratio", F.round(similarity.indel_ratio("a", "b"), 6))


@named(
    "indel_ratio_native",
    """WITH n AS (SELECT DISTINCT p_name AS a, p_brand AS b FROM part)
    SELECT a, b, round(2.0 * (len(a) - bit_count(list_reduce(list_transform(string_split(b, ''),
      lambda c: list_sum(list_transform(generate_series(1, len(a)), lambda i: CASE WHEN a[i] = c THEN 1::BIGINT << (i - 1) ELSE 0 END))::BIGINT),
      lambda r, m: ((r + (r & m)) | (r & ~m)) & ((1::BIGINT << len(a)) - 1), (1::BIGINT << len(a)) - 1))) / (len(a) + len(b)), 6) AS ratio FROM n""",
)
def indel_ratio_native(spark, sf):
    """The same ratio without Python."""
    n = query(spark, sf, "SELECT DISTINCT p_name AS a, p_brand AS b FROM part")
    return n.withColumn("ratio", F.round(similarity.indel_ratio_native(F.col("a"), F.col("b")), 6))


# --- near duplicates, relevance, reports -------------------------------------------------------


@named("near_duplicate_sentences")
def near_duplicate_sentences(spark, sf):
    """Greedy near-duplicate removal inside each conversation, whole table (checked in the tests)."""
    c = query(spark, sf, "SELECT conv_id, turn, text FROM conversations")
    s = c.select("conv_id", F.posexplode(tx.split_period(F.col("text"))).alias("i", "text"), (F.col("turn") * 10000).alias("b"))
    return dedup.deduplicate(s.select("conv_id", (F.col("b") + F.col("i")).alias("pos"), "text"), ["conv_id"])


@named("near_duplicate_reduction")
def near_duplicate_reduction(spark, sf):
    """Sentences before and after per conversation, with a total."""
    return dedup.reduction(near_duplicate_sentences(spark, sf), ["conv_id"])


_PHRASES = "SELECT min(p_partkey) AS phrase_id, p_name AS phrase FROM part GROUP BY p_name"
_BM_SENT = """SELECT o_orderkey AS id, concat(o_orderpriority, ' ', CASE o_orderkey % 5 WHEN 0 THEN 'red widget with a bolt' WHEN 1 THEN 'the small small ring'
    WHEN 2 THEN 'nothing' WHEN 3 THEN 'Blue Bolt, large gear' ELSE 'green plate ring' END) AS text FROM orders"""
_BM_SQL = f"""ph AS ({_PHRASES}), pt AS (SELECT phrase_id, phrase, unnest(string_split(lower(phrase), ' ')) AS term, len(string_split(phrase, ' ')) AS dl FROM ph),
    tf AS (SELECT phrase_id, phrase, dl, term, count(*) AS tf FROM pt GROUP BY ALL),
    n AS (SELECT count(*) AS n, avg(len(string_split(phrase, ' '))) AS avgdl FROM ph),
    raw AS (SELECT term, ln(n.n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf, n GROUP BY term, n.n),
    idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
    sent AS (SELECT id, unnest(regexp_extract_all(lower(text), '[a-zA-Z]+')) AS term FROM ({_BM_SENT})),
    sc AS (SELECT s.id, tf.phrase_id, tf.phrase, round(sum(idf.idf * tf.tf * 2.5 / (tf.tf + 1.5 * (0.25 + 0.75 * tf.dl / n.avgdl))), 9) AS score
           FROM sent s JOIN tf ON tf.term = s.term JOIN idf ON idf.term = s.term, n GROUP BY ALL),
    low AS (SELECT id FROM sc GROUP BY id HAVING max(score) <= 0),
    free AS (SELECT l.id, min(p.phrase_id) AS phrase_id FROM low l, ph p
             WHERE NOT EXISTS (SELECT 1 FROM sc WHERE sc.id = l.id AND sc.phrase_id = p.phrase_id) GROUP BY l.id),
    every AS (SELECT * FROM sc UNION ALL SELECT f.id, f.phrase_id, p.phrase, 0.0 FROM free f JOIN ph p ON p.phrase_id = f.phrase_id),
    best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, phrase_id) AS rn FROM every)"""


@named("best_object_phrase", f"WITH {_BM_SQL} SELECT id, phrase, round(score, 6) AS score FROM best WHERE rn = 1")
def best_object_phrase(spark, sf):
    """BM25 over the object phrases: best phrase of every sentence."""
    b = bm25.best_phrase(query(spark, sf, _BM_SENT), query(spark, sf, _PHRASES), "id")
    return b.withColumn("score", F.round("score", 6))


@named(
    "relevant_sentences",
    f"WITH {_BM_SQL} SELECT id, phrase FROM best WHERE rn = 1 AND score >= 5",
)
def relevant_sentences(spark, sf):
    return bm25.relevant(query(spark, sf, _BM_SENT), query(spark, sf, _PHRASES), "id").select("id", "phrase")


@named(
    "listed_verb_test",
    f"""SELECT id, len(list_intersect(regexp_extract_all(lower(text), '[a-zA-Z]+'), ['urgent', 'bolt', 'ring'])) > 0 AS has_verb FROM ({_BM_SENT})""",
)
def listed_verb_test(spark, sf):
    s = query(spark, sf, _BM_SENT).withColumn("stems", F.regexp_extract_all(F.lower("text"), F.lit("([a-zA-Z]+)"), F.lit(1)))
    verbs = spark.createDataFrame([("urgent",), ("bolt",), ("ring",)], "stem string")
    return bm25.has_listed_verb(s, verbs, "id").select("id", "has_verb")


@named(
    "abstracted_page_addresses",
    """SELECT page_id, 'public_netflow' AS text FROM pages""",
)
def abstracted_page_addresses(spark, sf):
    """Page addresses are URLs, so the whole text becomes one label."""
    return query(spark, sf, "SELECT page_id, url AS text FROM pages").withColumn("text", tx.abstract_report(F.col("text")))


@named("abstracted_reports")
def abstracted_reports(spark, sf):
    """Report abstraction over the whole page texts (checked in the tests)."""
    return query(spark, sf, "SELECT page_id, html AS text FROM pages").withColumn("text", tx.abstract_report(F.col("text")))


_ABSTRACTED = """x AS (SELECT doc_id AS key, text, regexp_replace(text, '\\b([0-9]{1,3})[.]([0-9]{1,3})[.]([0-9]{1,3})[.]([0-9]{1,3})(:[0-9]+)?\\b', chr(1) || '\\1.\\2.\\3.\\4' || chr(2), 'g') AS a FROM documents),
    y AS (SELECT key, text, regexp_replace(regexp_replace(regexp_replace(regexp_replace(a, '\\x01127[.][^\\x02]*\\x02', 'local_connection', 'g'),
      '\\x01(0?10[.]|172[.]0?(1[6-9]|2[0-9]|3[01])[.]|192[.]168[.])[^\\x02]*\\x02', 'private_netflow', 'g'), '\\x01[^\\x02]*\\x02', 'public_netflow', 'g'),
      '\\b([a-zA-Z0-9]([a-zA-Z0-9-]*[a-zA-Z0-9])?[.])+[a-zA-Z]{2,}(:[0-9]+)?\\b', 'public_netflow', 'g') AS after FROM x)"""


@named(
    "report_line_changes",
    f"""WITH {_ABSTRACTED}, z AS (SELECT key, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS line_no, unnest(string_split(text, chr(10))) AS b,
      unnest(string_split(after, chr(10))) AS a FROM y WHERE text <> after)
    SELECT key, line_no, trim(b) AS before, trim(a) AS after FROM z WHERE a <> b""",
)
def report_line_changes(spark, sf):
    """Lines of the documents the report abstraction changes."""
    return sequences.report_changes(query(spark, sf, "SELECT doc_id AS key, text FROM documents"))


# --- time and ids ------------------------------------------------------------------------------


@named(
    "eastern_clock",
    """SELECT event_id, strftime(ts - INTERVAL 4 HOUR, '%Y-%m-%d %H:%M:%S') AS clock FROM events""",
)
def eastern_clock(spark, sf):
    return view(spark, sf, "host_event").select("event_id", timeid.eastern(F.col("ts_ns")).alias("clock"))


@named(
    "eastern_clock_to_ns",
    "SELECT event_id, epoch_us(date_trunc('second', ts)) * 1000 AS ts_ns FROM events",
)
def eastern_clock_to_ns(spark, sf):
    """Clock text at UTC-4 back to nanoseconds."""
    return view(spark, sf, "host_event").select("event_id", timeid.from_eastern(timeid.eastern(F.col("ts_ns"))).alias("ts_ns"))


@named(
    "deterministic_ids",
    """WITH h AS (SELECT c_custkey, sha1(concat(from_hex('6ba7b8109dad11d180b400c04fd430c8'), encode(c_name))::BLOB) AS h FROM customer)
    SELECT c_custkey, concat(h[1:8], '-', h[9:12], '-5', h[14:16], '-', substr('89ab', 1 + (instr('0123456789abcdef', h[17]) - 1) % 4, 1),
    h[18:20], '-', h[21:32]) AS uuid FROM h""",
)
def deterministic_ids(spark, sf):
    """UUIDv5 of a name in the DNS namespace."""
    return query(spark, sf, "SELECT c_custkey, c_name FROM customer").select("c_custkey", timeid.uuid5(F.col("c_name")).alias("uuid"))


@named(
    "bare_verbs",
    "SELECT edge_type, count(*) AS n, replace(edge_type, 'EVENT_', '') AS verb FROM host_edge GROUP BY edge_type",
)
def bare_verbs(spark, sf):
    return catalog.verb_counts(view(spark, sf, "host_edge"))


@named(
    "technique_ids",
    """SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN partkey % 3 = 0 THEN concat('T', CAST(suppkey AS STRING))
    ELSE concat('T', CAST(suppkey AS STRING), '.00', CAST(partkey % 3 AS STRING)) END AS technique FROM ship_line""",
)
def technique_ids(spark, sf):
    f = query(spark, sf, "SELECT l_orderkey * 10 + l_linenumber AS id, concat('T', CAST(suppkey AS STRING), '-00', CAST(partkey % 3 AS STRING)) AS folder FROM ship_line")
    return f.select("id", tx.technique_id(F.col("folder")).alias("technique"))


@named(
    "tactic_labels",
    """SELECT p_partkey, concat(replace(p_name, ' ', '_'), '_and_', p_brand) AS label FROM part""",
)
def tactic_labels(spark, sf):
    p = query(spark, sf, "SELECT p_partkey, concat(p_name, ' & ', p_brand, ' — ', p_type) AS t FROM part")
    return p.select("p_partkey", tx.tactic_label(F.col("t")).alias("label"))
