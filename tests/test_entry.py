import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry

#: One query of each operator group; the rest differ from these in a parameter.
FEW = ("coref_scores", "ceaf_wide", "per_doc_scores", "tau_grid", "oracle_tau", "tau_correlation", "components", "threshold_sweep", "agglomerative", "system_topics", "merged_clusters", "hypernym", "closure_cyclic", "path_ratio")
FEW += ("conll_encode", "conll_decode", "conll_marks_odd", "file_scores", "score_report", "unseen_mask", "nested_removal", "range_alignment", "fuzzy_match", "extraction_misses")
FEW += ("parse_relations", "entity_links", "bracket_mentions", "signature_fields", "span_alignment", "topic_stats_describe", "topic_density", "temperature_record", "lexical_scores")

TABLES = "/root/testdata/sf0.001"
REPO = os.path.dirname(os.path.abspath(entry.__file__))


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")
def test_queries_match_their_sql(spark):
    import duckdb

    from clusterloom.plans.oracles import ORACLES
    from clusterloom.plans.queries import QUERIES

    con = duckdb.connect()
    for t in ("nation", "supplier", "orders", "lineitem", "documents", "benchmark", "conversations"):
        con.sql(f"create view {t} as select * from '{TABLES}/{t}.parquet'")

    def clean(v):
        if isinstance(v, float):
            return round(v, 5) + 0.0
        return float(v) if type(v).__name__ == "Decimal" else v

    for name in FEW:
        got = QUERIES[name](spark, TABLES)
        rel = con.sql(ORACLES[name])
        assert sorted(got.columns) == sorted(rel.columns), name
        at = [rel.columns.index(c) for c in got.columns]
        assert sorted(repr([clean(v) for v in r]) for r in got.collect()) == sorted(repr([clean(r[i]) for i in at]) for r in rel.fetchall()), name


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_works_without_the_training_data_package(tmp_path, pipeline):
    """The library imports nothing from it; the pipeline's module may stay at the top."""
    gone = shutil.ignore_patterns("llm", "__pycache__", ".git", *([] if pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(REPO, tmp_path / "repo", ignore=gone)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'muc' in q and not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, env=env)
    subprocess.run([sys.executable, "-m", "pytest", "tests", "-q", "-x", "--collect-only"], cwd=tmp_path / "repo", check=True, env=env, capture_output=True)
