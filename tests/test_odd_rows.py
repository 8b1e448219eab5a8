"""Queries over small tables with rows that the test tables lack."""

import duckdb
from pyspark.sql import functions as F

from siltstone.functions import dates
from siltstone.plans import catalog


def test_pages_of_one_url_go_by_id(spark, tmp_path):
    url = "https://a.example.org/x"
    rows = [(8, url), (5, url), (2, url), (11, "https://a.example.org/b"), (4, url), (1, url)]
    spark.createDataFrame(rows, "page_id long, url string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = catalog.queries()["interleave_hosts"](spark, str(tmp_path)).collect()
    assert {r["page_id"]: r["place"] for r in got} == {11: 0, 2: 1, 5: 2, 8: 3, 1: 0, 4: 1}


def test_line_end_after_the_suffix(spark, tmp_path):
    """A title of 40 characters that ends in a line end doesn't end in its last word."""
    ends = ["ing", "ing\n", "er.\n", "er.", "er\r\n", "er,\r", "ing\u0085", "ing\u2028", "ing\u2029", "ing\n\n", "ing ", "or"]
    rows = [(k, "x" * (40 - len(end)) + end + " and more", "src1") for k, end in enumerate(ends * 2, 1)] + [(99, None, "src1"), (100, "", "src1")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"lang": F.lit("en"), "n_chars": F.lit(9)}).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = sorted(con.execute(catalog.oracle_sql()["shell_suffix"]).fetchall())
    assert want and sorted(map(tuple, catalog.queries()["shell_suffix"](spark, str(tmp_path)).collect())) == want


def test_dates_at_the_end(spark):
    want = {
        "x\n2026年3月5日": "2026-03-05", "x2026年 12 月31 日 \u3000\xa0\u2028\n": "2026-12-31", "12026年3月5": "2026-03-05", "2026年3月5日。": "", "2026年2月30日": "", "1999年1月1日": "",
        "2026年13月1日": "", "2026年0月1日": "", "2025年1月1日 2026年1月2日": "2026-01-02", "": "", " \n": "", "日": "", "2026-03-05": "", "字" * 400 + "2026年3月5日" + " " * 3000: "2026-03-05",
        "2026年" + " " * 290 + "3月5日": "2026-03-05", "2026年" + " " * 293 + "3月5日": "", "\U0001f600" * 300 + "2026年3月5日\x85": "2026-03-05", "2026年3月5日\u200b": "", None: "",
    }
    rows = spark.createDataFrame([(t,) for t in want], "t string").select("t", dates.trailing(F.col("t")).alias("d")).collect()
    assert {r["t"]: r["d"] for r in rows} == want


def test_simple_dates_are_the_parsed_ones(spark):
    texts = ["发布 2026年3月5日 x", "2026-13-40 then 20260305", "2026.9-2027.1", "x20260230", "1999-01-01", "12026-01-02", "2026-1-2 2025-3-4", "2026/02/29,20260228", "20260101 2026.01.02", "2026-03-051", "20261301", "2026-3-5年 2024-2-29", "$1-$2", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", dates.parse_date_simple(F.col("t")).alias("d")).collect()
    assert {r["t"]: r["d"] for r in rows} == {t: dates.parse(t) for t in texts}


def test_date_columns_work_their_text_out_once(spark):
    """Once for each pattern: copies of a costly text multiply the work and take the code beyond what the JVM compiles."""
    df = spark.range(9).select(F.col("id").cast("string").alias("t"))
    for column, most in ((dates.trailing, 1), (dates.parse_date_simple, 2)):
        plan = df.select(column(F.concat("t", F.lit("<costly>"))).alias("d"))._jdf.queryExecution().optimizedPlan().toString()
        assert 1 <= plan.count("<costly>") <= most
