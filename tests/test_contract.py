"""The driver contract, and a spread of queries against their checking SQL at the smallest scale."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from provloom.plans import views

SF = "/root/testdata/sf0.001"
QUICK = (
    "subgraph_summary parallel_edge_rule node_numbering seed_owners component_sizes cascade_merges flow_merged_windows "
    "similar_file_parents labelled_segments filtered_attack_segments lifted_paths node_labels node_classes "
    "labelled_sentences alternating_pairs_dropped attack_sentences best_object_phrase label_ranking_average_precision "
    "average_precision_per_label two_stage_retrieval log_event_edges kernel_event_edges audit_events audit_graph_edges "
    "tactic_templates first_sequence_per_step"
).split()
NAMES = sorted(entry.oracle_sql()) if os.environ.get("PROVLOOM_ALL_QUERIES") else QUICK

needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6) + 0.0
        return v

    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["dep_id", "part_idx", "total_parts"] and df.count() >= 0


@needs_data
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    con = duckdb.connect()
    for t in views.TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(cols, cur.fetchall())


@needs_data
@pytest.mark.parametrize("name", ["generalised_sequences"])
def test_query_that_reads_more_of_the_edges(spark, name):
    """The cascade's graph keeps the columns that its readers name; this one reads the place of a pair's first edge too."""
    if name in NAMES:
        pytest.skip("compared above")
    test_query(spark, name)
