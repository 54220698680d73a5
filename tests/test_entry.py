import __spark_entry__ as e
import pytest


def test_contract(spark):
    names = e.queries()
    assert {k for k in names if k.startswith("q_")} <= set(e.oracle_sql())
    assert set(e.oracle_sql()) <= set(names)
    assert e.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["q_kmer_hash_bits", "q_search_approx_t1", "q_six_frame", "q_report_lines", "q_sizing", "q_bitslice_postings", "q_search_many", "q_search_reads", "q_fasta_pieces", "q_manifest_errors", "q_report_text"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "part", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found, expected = e.queries()[name](spark, sf).toPandas(), con.execute(e.oracle_sql()[name]).df()
    columns = sorted(found.columns)
    assert columns == sorted(expected.columns)
    assert sorted(map(str, found[columns].itertuples(index=False, name=None))) == sorted(map(str, expected[columns].itertuples(index=False, name=None)))
