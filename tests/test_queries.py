"""Registry checks, and every family of queries against DuckDB at the smallest scale."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from tools.check import rows_of

DIR = "/root/testdata/sf0.001"
PICKED = [
    "a_resample", "w_allind", "w_regime", "o_gld", "j_macro", "w_corr", "p_quar", "o_brz_slv", "a_qual", "w_tail", "o_asof",
    "b_port", "a_btmet", "b_wf", "a_wfsum", "f_sent", "a_sentsum", "a_topk", "w_cumvol", "a_breadth", "o_rowjson", "o_htmlprice",
    "m_split", "a_fcmet", "f_bday", "o_ingest", "o_lineage", "o_slv_wr", "o_tblrw", "o_csvout", "o_kafka_out", "o_topics",
    "st_loop", "st_idemp", "st_tumble", "st_alert", "st_enrich", "st_hwm",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def test_every_check_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


@pytest.mark.parametrize("key", PICKED)
def test_query_equals_sql(spark, db, key):
    df = entry_module.queries()[key](spark, DIR)
    rel = db.sql(entry_module.oracle_sql()[key])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(rel.columns, rel.fetchall())
