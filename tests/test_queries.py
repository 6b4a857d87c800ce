import pytest
from compare import connection, differences

from cairn.plans import catalogue, codec_queries

QUERIES, SQL = catalogue.QUERIES | codec_queries.QUERIES, catalogue.SQL | codec_queries.SQL


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    if name in SQL:
        assert differences(df, con, SQL[name]) == ""
    else:
        assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", ["huffman_documents", "rans_documents", "archive_documents", "candidates_documents", "codec_benchmark"])
def test_codecs_take_empty_null_and_long_documents(spark, tmp_path, name):
    rows = [(1, None), (2, ""), (3, "a"), (4, "Zwölf 日本 " * 3000), (25, "x" * 40_000)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    df = QUERIES[name](spark, str(tmp_path))
    if name in SQL:
        import duckdb

        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        assert differences(df, con, SQL[name]) == ""
    else:
        assert {r["size"] for r in df.collect()} == {sum(len((t or "").encode()) for _, t in rows)}
