"""Queries and operators pass whole tables and whole texts."""

import json

import pyarrow.parquet as pq
from pyspark.sql import functions as F

import __spark_entry__
from tablesmith.operators.validate import Field
from tablesmith.plans import engine
from tablesmith.sources import providers


def run(name, spark, sf):
    return __spark_entry__.queries()[name](spark, sf)


def count(sf, table):
    return pq.read_metadata(f"{sf}/{table}.parquet").num_rows


def test_all_customers_are_concatenated(spark, sf):
    found = run("sources_concat", spark, sf)
    assert found.agg(F.sum(F.size(F.split("segments", ", ")))).first()[0] == count(sf, "customer")


def test_rows_have_all_their_sources(spark, sf):
    assert run("rows_with_sources", spark, sf).agg(F.sum("n_sources")).first()[0] == count(sf, "lineitem")


def test_all_urls_are_fetched(spark, sf):
    found = run("fetch_pages", spark, sf)
    assert found.count() == count(sf, "pages") + 1 and [r.error for r in found.where("error is not null").collect()] == ["not_found"]


def test_fetch_too_large(spark):
    pages = spark.createDataFrame([(1, "a", "x" * 5_120_000), (2, "b", "x" * 5_119_999 + "é"), (3, "c", "xyz")], "page_id long, url string, html string")
    urls = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "url string")
    size = lambda r: r.html and len(r.html)
    assert {r.url: (size(r), r.error) for r in providers.fetch(urls, pages).collect()} == {"a": (5_120_000, None), "b": (None, "too_large"), "c": (3, None), "d": (None, "not_found")}
    assert {r.url: r.error for r in providers.fetch(urls, pages, 2).collect()} == {"a": "too_large", "b": "too_large", "c": "too_large", "d": "not_found"}


class Measure(providers.TitleExtractor):
    pass


def test_offline_extraction_sees_whole_texts(spark):
    pages = spark.createDataFrame([("http://a", f"<title>t</title><p>{'word ' * 4_000}</p>")], "url string, html string")
    fields = [Field("name", "text", True), Field("length", "number")]
    whole, cut = (json.loads(engine.page_rows(pages, fields, m).first().data)["length"] for m in (None, Measure()))
    assert whole > 19_000 and cut == 12_000
