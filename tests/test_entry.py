import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_registry():
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and {"text_search_topk", "p4_found", "vector_knn_cosine"} <= set(q)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert 0 < len(rows) <= 10 and {"document_id", "rank_key", "text"} <= set(rows[0].asDict())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", [
    "p4_found", "p4_term_profile", "term_cf_df", "stored_index_search", "batch_text_search", "text_search_empty", "upsert_ignore", "acoustic_search_topk", "fk_orphans", "insert_if_absent_run", "songs_csv_scan", "audio_frames",
])
def test_equal_to_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SMALL}/{f}'")
    df = entry.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    want = con.execute("select " + ", ".join(f'"{c}"' for c in cols) + f" from ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in df.select(*cols).collect())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_stored_search_reads_the_terms_of_the_query_only(spark):
    """The filter reaches the scan of the index, below the explode; titles are joined by broadcast."""
    plan = entry.queries()["stored_index_search"](spark, SMALL)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan =="):]
    index = [line for line in physical.splitlines() if "FileScan" in line and "term_index" in line]
    assert index and all("In(term" in line for line in index)
    titles = [line for line in physical.splitlines() if "FileScan" in line and "title" in line]
    assert len(titles) == 1
