"""Registered queries against their SQL at the smallest scale: a part of them here, all with ``python check_oracles.py``."""

import pytest

import __spark_entry__ as entry
from check_oracles import compare, database
from textquarry.plans.oracles import ORACLES
from textquarry.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
CHECKED = (
    "chunk_words chunk_sentences chunk_ids html_text json_flatten row_text_template row_ingest scan_rows extract_mixed "
    "incremental_files upsert_chunks ingest_summary ingest_progress collection_stats purge_kept where_and_or knn_exact "
    "knn_blocked knn_lsh knn_multi search_text cited_sources export_bibtex export_vault recent_distinct throttle_window"
).split()


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", CHECKED)
def test_query_agrees_with_its_sql(spark, con, name):
    assert compare(spark, con, name, SF) == ""


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)
    assert set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    hits = entry.entry(spark)
    assert hits.columns[:2] == ["qid", "rank"] and hits.count() == 200
