"""Record-level jobs that string several operators together."""

from __future__ import annotations

from pyspark.sql import functions as F

from provloom.functions import text as tx
from provloom.operators import build, catalog, dedup, ordered, reduce, reports, score, sequences
from provloom.plans.label_queries import _MEMBERS, subgraphs
from provloom.plans.reduce_queries import _CASCADE_SQL, walk_merges
from provloom.plans.registry import named
from provloom.plans.source_queries import _AUDIT_SQL, _HOST_SQL, _MERGED, audit_lines
from provloom.plans.text_queries import _LABEL_SQL, near_duplicate_sentences
from provloom.plans.views import query, view
from provloom.sources import audit, lines
from provloom.session import cut_lineage, shared_folder, written


@named(
    "generalised_sequences",
    f"""WITH {_CASCADE_SQL},
    kept_edges AS (SELECT *, min((ts_ns, line_no)) OVER (PARTITION BY src_id, dst_id) AS pf FROM edge e
      WHERE NOT EXISTS (SELECT 1 FROM merges m WHERE m.parent_id = e.dst_id AND m.proc = e.src_id))
    SELECT s.uuid AS seq_id, row_number() OVER (PARTITION BY s.uuid ORDER BY e.src_id, e.pf, e.ts_ns, e.line_no) AS pos,
    concat(s.uuid, ' ', lower(replace(e.edge_type, 'EVENT_', '')), ' ', d.uuid, '.') AS text
    FROM kept_edges e JOIN nodes s ON s.node_id = e.src_id JOIN nodes d ON d.node_id = e.dst_id""",
)
def generalised_sequences(spark, sf):
    """Cascade and strip, names generalised, verbs stripped, sentences in adjacency order."""
    pair = ["pair_ts", "pair_line"]  # sentences are in the order of their pairs' first edges
    nodes, edges, _, shared = walk_merges(spark, sf, pair)
    edges = edges.select("src_id", "dst_id", "edge_type", "ts_ns", "line_no", *pair)
    nodes, edges = reduce.cascade_strip(nodes, edges, shared)
    # both ends read the names, and the scan reads the sentences twice
    gen = written(catalog.generalize_nodes(nodes).select("node_id", "uuid", F.col("new_name").alias("name")))
    s = gen.select(F.col("node_id").alias("src_id"), F.col("uuid").alias("seq_id"), F.col("name").alias("src_name"))
    d = gen.select(F.col("node_id").alias("dst_id"), F.col("name").alias("dst_name"))
    bare = edges.join(s, "src_id").join(d, "dst_id").withColumn("edge_type", F.regexp_replace("edge_type", "^EVENT_", ""))
    return sequences.adjacency_sentences(written(bare), ["seq_id"])


@named(
    "abstracted_subgraph_nodes",
    f"""WITH {_MEMBERS}, {_LABEL_SQL.replace('r AS (', 'r0 AS (').replace('FROM r)', 'FROM r0)')},
    a AS (SELECT s.dep_id, s.part_idx, s.uuid, n.ts_ns, n.node_id, h.name, h.type, regexp_extract_all(h.name, '(?:^|_)([0-9]{{1,3}}(?:[.][0-9]{{1,3}}){{3}})', 1) AS ips
          FROM sub_node s JOIN nodes n ON n.uuid = s.uuid JOIN host_name h ON h.uuid = s.uuid),
    p AS (SELECT *, CASE WHEN type = 'NetFlowObject' AND len(ips) >= 2 AND NOT starts_with(ips[len(ips)], '192.168.') THEN ips[len(ips)] END AS ip FROM a),
    f AS (SELECT dep_id, part_idx, ip, min(node_id) AS pos FROM p WHERE ip IS NOT NULL GROUP BY ALL),
    k AS (SELECT dep_id, part_idx, ip, CASE WHEN count(*) OVER (PARTITION BY dep_id, part_idx) = 1 THEN 'public_netflow'
      ELSE concat('public_netflow_', CAST(row_number() OVER (PARTITION BY dep_id, part_idx ORDER BY pos) AS STRING)) END AS label FROM f)
    SELECT p.dep_id, p.part_idx, p.uuid, coalesce(k.label, lab.label) AS label FROM p JOIN lab ON lab.uuid = p.uuid
    LEFT JOIN k ON k.dep_id = p.dep_id AND k.part_idx = p.part_idx AND k.ip = p.ip""",
)
def abstracted_subgraph_nodes(spark, sf):
    """Node names of every subgraph abstracted, public addresses numbered per subgraph."""
    _, sub_nodes, _, _ = subgraphs(spark, sf)
    n = sequences.abstract_nodes(sub_nodes.withColumn("pos", F.col("node_id")), ["dep_id", "part_idx"])
    return n.select("dep_id", "part_idx", "uuid", "label")


def _subgraph_sentences(spark, sf):
    _, sub_nodes, sub_edges, _ = subgraphs(spark, sf)
    k = ["dep_id", "part_idx"]
    names = cut_lineage(sequences.abstract_nodes(sub_nodes, k, numbered=False).select(*k, "uuid", "label"))
    s = names.select(*k, F.col("uuid").alias("src"), F.col("label").alias("src_name"))
    d = names.select(*k, F.col("uuid").alias("dst"), F.col("label").alias("dst_name"))
    return sequences.sentences(sub_edges.join(s, [*k, "src"]).join(d, [*k, "dst"]), k)


@named(
    "subgraph_sentences",
    f"""WITH {_MEMBERS}, {_LABEL_SQL.replace('r AS (', 'r0 AS (').replace('FROM r)', 'FROM r0)')}
    SELECT e.dep_id, e.part_idx, row_number() OVER (PARTITION BY e.dep_id, e.part_idx ORDER BY e.ts_ns, e.line_no) AS pos,
    concat(s.label, ' ', lower(replace(e.edge_type, 'EVENT_', '')), ' ', d.label, '.') AS text
    FROM sub_edge e JOIN lab s ON s.uuid = e.src JOIN lab d ON d.uuid = e.dst""",
)
def subgraph_sentences(spark, sf):
    """Abstract sentences of every subgraph in time order."""
    return _subgraph_sentences(spark, sf)


# longest common subsequence of short sentences, a bit per character
_FAR = """2.0 * (len(k) - bit_count(list_reduce(list_transform(string_split(s, ''),
      lambda c: list_sum(list_transform(generate_series(1, len(k)), lambda i: CASE WHEN k[i] = c THEN 1::HUGEINT << (i - 1)::INT ELSE 0::HUGEINT END))::HUGEINT),
      lambda r, m: ((r + (r & m)) | (r & xor(m, -1::HUGEINT))) & ((1::HUGEINT << len(k)::INT) - 1), (1::HUGEINT << len(k)::INT) - 1)))
      / (len(k) + len(s)) < 0.7"""


@named(
    "evaluation_texts",
    f"""WITH RECURSIVE {_MEMBERS}, {_LABEL_SQL.replace('r AS (', 'r0 AS (').replace('FROM r)', 'FROM r0)')},
    st AS (SELECT e.dep_id, e.part_idx, row_number() OVER (PARTITION BY e.dep_id, e.part_idx ORDER BY e.ts_ns, e.line_no) AS pos,
      concat(s.label, ' ', lower(replace(e.edge_type, 'EVENT_', '')), ' ', d.label, '.') AS text
      FROM sub_edge e JOIN lab s ON s.uuid = e.src JOIN lab d ON d.uuid = e.dst),
    keepers AS (
      SELECT dep_id, part_idx, pos, [text] AS kept, TRUE AS stays, text FROM st WHERE pos = 1
      UNION ALL
      SELECT n.dep_id, n.part_idx, n.pos, CASE WHEN far THEN list_append(n.kept, n.s) ELSE n.kept END, far, n.s FROM (
        SELECT t.dep_id, t.part_idx, t.pos, k0.kept, t.text AS s, len(list_filter(list_transform(k0.kept, lambda k: {_FAR.replace('(s,', '(t.text,').replace('len(s)', 'len(t.text)')}), lambda ok: NOT ok)) = 0 AS far
        FROM keepers k0 JOIN st t ON t.dep_id = k0.dep_id AND t.part_idx = k0.part_idx AND t.pos = k0.pos + 1) n)
    SELECT dep_id, part_idx, pos, text FROM keepers WHERE stays""",
)
def evaluation_texts(spark, sf):
    """Abstract, build, deduplicate: the kept sentences of every subgraph."""
    d = dedup.deduplicate(_subgraph_sentences(spark, sf), ["dep_id", "part_idx"])
    return d.filter("kept").select("dep_id", "part_idx", "pos", "text")


@named(
    "benign_test_texts",
    """WITH s AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) FILTER (WHERE text <> '') AS t FROM conversations GROUP BY conv_id)
    SELECT conv_id, md5(coalesce(t, 'empty subgraph')) AS digest FROM s""",
)
def benign_test_texts(spark, sf):
    """One text per sequence, a filler for those without sentences."""
    c = query(spark, sf, "SELECT conv_id, turn, role, text FROM conversations")
    said = ordered.scan(c.filter("text <> ''"), ["conv_id"], ["turn"], index="pos").select("conv_id", "pos", "text")
    t = sequences.sequence_text(said, ["conv_id"]).select("conv_id", "sequence")
    full = c.select("conv_id").distinct().join(t, "conv_id", "left")
    return full.select("conv_id", F.md5(F.coalesce("sequence", F.lit("empty subgraph"))).alias("digest"))


@named(
    "raw_tactic_sentences",
    """SELECT e.edge_type AS seq_id, row_number() OVER (PARTITION BY e.edge_type ORDER BY e.ts_ns, e.line_no) AS pos,
    concat(s.name, ' ', e.edge_type, ' ', d.name, '.') AS text FROM host_edge e JOIN host_name s ON s.uuid = e.src JOIN host_name d ON d.uuid = e.dst""",
)
def raw_tactic_sentences(spark, sf):
    """Tactic sentences as they are, names and operations unchanged."""
    e = build.endpoint_names(view(spark, sf, "host_edge"), view(spark, sf, "host_name").select("uuid", "name"))
    e = e.withColumn("seq_id", F.col("edge_type"))
    return sequences.sentences(e, ["seq_id"], op=F.col("edge_type"))


@named(
    "sequence_batch_counters",
    f"""WITH {_MERGED}, l AS (SELECT DISTINCT file FROM ev), n AS (SELECT l.file, count(me.src_name) AS n FROM l LEFT JOIN me ON me.file = l.file GROUP BY l.file)
    SELECT count(CASE WHEN n > 0 THEN 1 END) AS n_ok, count(CASE WHEN n = 0 THEN 1 END) AS n_empty, CAST(sum(n) AS BIGINT) AS n_triples FROM n""",
)
def sequence_batch_counters(spark, sf):
    """Sentences of every audit graph in the batch: graphs that gave some, graphs that gave none, sentences in all."""
    ev = cut_lineage(audit.parse_events(audit_lines(spark, sf)))
    _, _, edges = audit.merged_graph(ev, ["file"], ["file"])
    said = sequences.sentences(edges, ["file"], ["ts_ns", "line_no", "src_name", "edge_type", "dst_name"])
    return audit.batch_counters(ev, said, ["file"])


# --- reports -------------------------------------------------------------------------------------

_SPLIT = "list_filter(list_transform(string_split({}, '. '), lambda s: trim(s, ' \t\n\r')), lambda s: s <> '')"
_RANKED = f"""cs AS (SELECT conv_id, turn, {_SPLIT.format('text')} AS l FROM conversations),
    bs AS (SELECT item_id, {_SPLIT.format('text')} AS l FROM benchmark),
    sent AS MATERIALIZED (SELECT 'r' AS side, conv_id AS k, turn * 10000 + i - 1 AS pos, l[i] AS text FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM cs)
             UNION ALL SELECT 'c', item_id, i - 1, l[i] FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM bs)),
    w AS (SELECT side, k, pos, unnest(string_split_regex(lower(text), '\\s+')) AS w FROM sent),
    n AS (SELECT side, k, pos, CAST(concat('0x', substr(md5(w), 1, 6)) AS BIGINT) % 16 AS b, count(*) AS n FROM w WHERE w <> '' GROUP BY ALL),
    vec AS MATERIALIZED (SELECT side, k, pos, list_transform(range(16), lambda i: coalesce(m[i], 0) / len) AS v FROM
            (SELECT side, k, pos, map(list(b), list(n)) AS m, sqrt(sum(n * n)) AS len FROM n GROUP BY side, k, pos)),
    r AS (SELECT k AS id, pos, text, v FROM sent JOIN vec USING (side, k, pos) WHERE side = 'r'),
    c AS (SELECT k AS ref, pos, text, v FROM sent JOIN vec USING (side, k, pos) WHERE side = 'c'),
    cell AS MATERIALIZED (SELECT r.id, r.pos AS row_pos, r.text AS row_text, c.ref, c.pos AS ref_pos, c.text AS ref_text, list_dot_product(r.v, c.v) AS s FROM r, c),
    late AS (SELECT id, ref, avg(best) AS score FROM (SELECT id, row_pos, ref, max(s) AS best FROM cell GROUP BY ALL) GROUP BY ALL),
    ranking AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 6) DESC, ref) AS rank FROM late),
    pool AS (SELECT cell.*, rank AS report_rank, row_number() OVER (PARTITION BY id, ref ORDER BY round(s, 9) DESC, row_pos, ref_pos) AS p
             FROM cell JOIN ranking USING (id, ref) WHERE rank <= 2),
    once AS (SELECT id, ref, report_rank, row_text, ref_text, min(p) AS p, max(round(s, 9)) AS score FROM pool WHERE p <= 10 GROUP BY ALL),
    explained AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY id, ref ORDER BY p) AS rank FROM once)"""


def _sentence_vectors(df, key):
    """(key, pos, text, v) of (key, pos, text); the id of a vector is the sentence's place."""
    s = cut_lineage(df.select(F.struct(key, "pos").alias("id"), "text"))
    v = score.hashed_vectors(s, 16)
    return cut_lineage(s.join(v, "id").select(f"id.{key}", "id.pos", "text", "v"))


def _matched(spark, sf):
    c = query(spark, sf, "SELECT conv_id AS id, turn, text FROM conversations")
    c = c.select("id", "turn", F.posexplode(tx.split_period(F.col("text"))).alias("i", "text"))
    b = query(spark, sf, "SELECT item_id AS ref, text FROM benchmark").select("ref", F.posexplode(tx.split_period(F.col("text"))).alias("pos", "text"))
    rows = _sentence_vectors(c.select("id", (F.col("turn") * 10000 + F.col("i")).alias("pos"), "text"), "id")
    return reports.ranked_reports(rows, _sentence_vectors(b.withColumn("pos", F.col("pos").cast("long")), "ref"))


@named("ranked_reports", f"WITH {_RANKED} SELECT id, ref, rank, round(score, 6) AS score FROM ranking")
def ranked_reports(spark, sf):
    """Every benchmark text ranked for every conversation by its sentences."""
    return _matched(spark, sf)[0].select("id", "ref", "rank", F.round("score", 6).alias("score"))


@named(
    "explained_reports",
    f"WITH {_RANKED} SELECT id, ref, report_rank, rank, row_text, ref_text, round(score, 6) AS score FROM explained WHERE rank <= 3",
)
def explained_reports(spark, sf):
    """Best sentence pairs of the two best texts of every conversation, ranked and explained in one job."""
    return _matched(spark, sf)[1].withColumn("score", F.round("score", 6))


@named(
    "match_report_lines",
    f"""WITH {_RANKED}, e AS (SELECT * FROM explained WHERE rank <= 3),
    part AS (SELECT id, 0 AS a, 0 AS b, 0 AS c, 0 AS d, printf('    %s', CAST(id AS VARCHAR)) AS line FROM (SELECT DISTINCT id FROM ranking)
      UNION ALL SELECT id, 1, rank, 0, 0, printf('      %-40s %.4f', CAST(ref AS VARCHAR), score) FROM ranking
      UNION ALL SELECT DISTINCT id, 2, report_rank, 0, 0, printf('    Top matching sentences for [%s]:', CAST(ref AS VARCHAR)) FROM e
      UNION ALL SELECT id, 2, report_rank, rank, 1, printf('      [%s] Score : %.4f', CAST(rank AS VARCHAR), score) FROM e
      UNION ALL SELECT id, 2, report_rank, rank, 2, concat('          LOG : ', regexp_replace(row_text, '[\r\n]+', ' ', 'g')) FROM e
      UNION ALL SELECT id, 2, report_rank, rank, 3, concat('          CTI : ', regexp_replace(ref_text, '[\r\n]+', ' ', 'g')) FROM e)
    SELECT row_number() OVER (ORDER BY id, a, b, c, d) AS line_no, line FROM part""",
)
def match_report_lines(spark, sf):
    """The report of the ranking as text files, read back."""
    path = shared_folder(spark, "match-report")
    ranking, explained = _matched(spark, sf)
    reports.write_lines(reports.match_report(cut_lineage(ranking), cut_lineage(explained)), ["id"], path)
    return reports.read_lines(spark, path)


@named("reduction_report_lines")
def reduction_report_lines(spark, sf):
    """The report of the near-duplicate reduction of all conversations, written and read back (checked in the tests)."""
    path = shared_folder(spark, "reduction-report")
    reports.write_lines(reports.reduction_report(cut_lineage(near_duplicate_sentences(spark, sf)), ["conv_id"], dedup.THRESHOLD), ["conv_id"], path)
    return reports.read_lines(spark, path)


@named(
    "written_embeddings",
    """WITH w AS (SELECT doc_id AS id, unnest(string_split_regex(lower(text), '\\s+')) AS w FROM documents),
    n AS (SELECT id, CAST(concat('0x', substr(md5(w), 1, 6)) AS BIGINT) % 16 AS b, count(*) AS n FROM w WHERE w <> '' GROUP BY ALL),
    l AS (SELECT id, sqrt(sum(n * n)) AS len, sum(n) AS n_words, count(*) AS n_buckets FROM n GROUP BY id)
    SELECT d.doc_id AS id, d.lang, d.source, CAST(16 AS INT) AS dim, round(l.n_words / l.len, 6) AS total, CAST(n_buckets AS INT) AS n_filled FROM documents d JOIN l ON l.id = d.doc_id""",
)
def written_embeddings(spark, sf):
    """The embedding table of all documents: written with its metadata, read back and digested."""
    path = shared_folder(spark, "embeddings")
    t = query(spark, sf, "SELECT doc_id AS id, lang, source, text FROM documents")
    score.write_embeddings(t.drop("text"), score.hashed_vectors(t.select("id", "text"), 16), path)
    back = spark.read.parquet(path)
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return back.select("id", "lang", "source", F.size("v").alias("dim"), F.round(total, 6).alias("total"), F.size(F.filter("v", lambda x: x != 0)).alias("n_filled"))


@named(
    "audit_batch_breakdown",
    f"""WITH {_HOST_SQL}, s AS (SELECT tactic, technique, step, max(hosts) AS hosts, arg_min(host_tag, (pr, host_tag)) FILTER (pr IS NOT NULL) AS pick,
      arg_min(n_events, (pr, host_tag)) FILTER (pr IS NOT NULL) AS pick_n, arg_min(host_tag, (-n_events, f)) AS rich, max(n_events) AS rich_n, min(host_tag) AS lone FROM h GROUP BY ALL),
    c AS (SELECT tactic, technique, step, CASE WHEN hosts = 1 THEN lone WHEN pick_n < 5 AND rich_n > pick_n THEN rich ELSE pick END AS host_tag FROM s),
    keep AS (SELECT h.file FROM h JOIN c ON c.tactic = h.tactic AND c.technique = h.technique AND c.step = h.step AND c.host_tag = h.host_tag), {_AUDIT_SQL}
    SELECT type, count(*) AS n FROM ev WHERE file IN (SELECT file FROM keep) GROUP BY type""",
)
def audit_batch_breakdown(spark, sf):
    """Event types over the logs of the primary hosts only."""
    return audit.type_breakdown(audit.primary_events(audit_lines(spark, sf)))


@named(
    "audit_graph_attributes",
    """SELECT user_id AS dep_id, 'T1' AS technique, concat('step', CAST(user_id AS STRING)) AS step, 'client' AS host FROM (SELECT DISTINCT user_id FROM host_event)""",
)
def audit_graph_attributes(spark, sf):
    """Step and host out of a graph's description."""
    docs = query(
        spark, sf,
        """SELECT concat('{"dep_id":', CAST(user_id AS STRING), ',"attack":"T1","description":"T1 step=step', CAST(user_id AS STRING), ' host=client logdir=audit","nodes":[],"edges":[]}') AS value
        FROM (SELECT DISTINCT user_id FROM host_event)""",
    )
    return lines.audit_graph_attributes(lines.parse_subgraphs(docs)).select("dep_id", "technique", "step", "host")


@named(
    "hashed_text_vectors",
    """WITH w AS (SELECT doc_id AS id, unnest(string_split_regex(lower(text), '\\s+')) AS w FROM documents),
    n AS (SELECT id, CAST(concat('0x', substr(md5(w), 1, 6)) AS BIGINT) % 16 AS b, count(*) AS n FROM w WHERE w <> '' GROUP BY ALL),
    l AS (SELECT id, sqrt(sum(n * n)) AS len FROM n GROUP BY id)
    SELECT n.id, n.b, round(n.n / l.len, 6) AS x FROM n JOIN l ON l.id = n.id""",
)
def hashed_text_vectors(spark, sf):
    """The built-in embedder over whole texts, non-zero entries."""
    t = query(spark, sf, "SELECT doc_id AS id, text FROM documents")
    v = score.hashed_vectors(t, 16).select("id", F.posexplode("v").alias("b", "x")).filter("x <> 0")
    return v.select("id", F.col("b").cast("long").alias("b"), F.round("x", 6).alias("x"))


@named(
    "token_means_over_chunks",
    """WITH t AS (SELECT doc_id AS id, list_concat(['<s>'], string_split_regex(text, '\\s+')) AS k FROM documents),
    s AS (SELECT id, k, unnest(generate_series(0, (len(k) - 2) // 48)) AS chunk FROM t WHERE len(k) > 1),
    o AS (SELECT id, chunk, k, unnest(generate_series(1, least(63, len(k) - (1 + chunk * 48)))) AS off FROM s)
    SELECT id, 1 + chunk * 48 + off - 1 AS token, round(avg(len(k[1 + chunk * 48 + off])), 6) AS x0, round(avg(chunk), 6) AS x1 FROM o GROUP BY ALL""",
)
def token_means_over_chunks(spark, sf):
    """Per-token mean over the chunks that cover the token."""
    t = query(spark, sf, "SELECT doc_id AS id, text FROM documents").select(
        "id", F.concat(F.array(F.lit("<s>")), F.split("text", r"\s+")).alias("tokens")
    )
    tok = score.chunk_tokens(t, 64, 48).select("id", "chunk", "start", F.posexplode("tokens").alias("offset", "w"))
    v = tok.select("id", "start", "offset", F.array(F.length("w").cast("double"), F.col("chunk").cast("double")).alias("v"))
    m = score.token_means(v)
    return m.select("id", "token", F.round(F.get("v", F.lit(0)), 6).alias("x0"), F.round(F.get("v", F.lit(1)), 6).alias("x1"))
