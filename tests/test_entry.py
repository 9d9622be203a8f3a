"""The registry, and every query that has an oracle against DuckDB on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_registry():
    known, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(known) and len(known) > 55


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables aren't here")
@pytest.mark.parametrize("name", ["q_grams", "q_search", "q_overlaps", "q_kv_latest", "q_kv_monotonic", "q_descendants", "q_siblings_before", "q_sections", "q_orphans", "q_import_xor", "q_markup_block_style", "q_stream_latest", "q_overlap_topk", "q_overlap_changes", "q_kv_as_of", "q_kv_before_seq", "q_tx_crc", "q_is_cyclic", "q_shared", "q_preview_styles", "q_tile_branches", "q_restore", "q_export_edges", "q_import_edges"])
def test_oracles(spark, duck, name):
    want, got = duck.sql(entry.oracle_sql()[name]).df(), entry.queries()[name](spark, DATA).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    key = lambda df: sorted(map(tuple, df[columns].astype(str).to_numpy()))
    assert key(want) == key(got) and len(got) > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["item_id", "term_ix", "doc_id", "line_ix", "i", "score"]
