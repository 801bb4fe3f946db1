"""Every registered query that has SQL gives the rows that DuckDB gives."""

import duckdb
import pytest

import __spark_entry__

SQL = __spark_entry__.oracle_sql()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, sf, duck, tmp_path, name):
    __spark_entry__.queries()[name](spark, sf).write.parquet(f"{tmp_path}/o")
    cols = ", ".join(sorted(spark.read.parquet(f"{tmp_path}/o").columns))
    a, b = f"select {cols} from read_parquet('{tmp_path}/o/*.parquet')", f"select {cols} from ({SQL[name]}) q"
    for x, y in ((a, b), (b, a)):
        assert duck.sql(f"({x}) except all ({y}) limit 3").fetchall() == []


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_titles_of_odd_pages_are_those_of_the_sql(spark, tmp_path):
    odd = [
        "<title>a&amp;&amp b &amp</title>", "<title>&amp;lt; &lt;b&gt; &quot;&#39; &eacute; &#38;</title>", "<h1>no title</h1>", "<title></title><h1>h</h1>", "<title>never ends", "", None,
        "<TITLE>\u00a0 \u3000a\nb <i>c</i>\n </Title><title>second</title>", "<title lang=x>other</title>", "<title> \t</title>",
    ]
    rows = spark.createDataFrame([(k, f"http://h/{k}", h) for k, h in enumerate(odd)], "page_id long, url string, html string")
    rows.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    found = __spark_entry__.queries()["page_titles"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == sorted(con.sql(SQL["page_titles"]).fetchall())
