"""Routing, image fallback, admission and strict decoding."""

import pytest
from pyspark.sql import functions as F

from tablesmith.functions import text as X
from tablesmith.plans import catalog
from tablesmith.sources import providers


class Told:
    """A model that fails the first times it is asked."""

    def __init__(self, name, failures=0, error=providers.Retryable):
        self.name, self.left, self.error, self.calls = name, failures, error, 0

    def complete(self, role, content):
        self.calls += 1
        if self.left:
            self.left -= 1
            raise self.error("busy")
        return f"{self.name}: {role} {content}"


def test_roles_go_to_their_models():
    routed = providers.RoutedModel({"near": Told("near"), "far": Told("far")}, "far", {"scores": "near"})
    assert [routed.complete("scores", "x"), routed.complete("extract", "y")] == ["near: scores x", "far: extract y"]
    with pytest.raises(ValueError, match="no such model: other"):
        providers.RoutedModel({"near": Told("near")}, "near", {"extract": "other"})


def test_calls_are_repeated_three_times():
    waits = []
    assert providers.RoutedModel({"m": Told("m", 3)}, "m", sleep=waits.append).complete("a", "b") == "m: a b"
    assert waits == [2.0, 4.0, 8.0]
    model = Told("m", 9)
    with pytest.raises(providers.GaveUp) as e:
        providers.RoutedModel({"m": model}, "m", sleep=waits.append).complete("a", "b")
    assert model.calls == 4 and not providers.worth_retrying(e.value)  # so nobody above repeats it
    model = Told("m", 1, ValueError)
    with pytest.raises(ValueError):
        providers.RoutedModel({"m": model}, "m", sleep=waits.append).complete("a", "b")
    assert model.calls == 1


class LazyImages:
    """Image search whose frame fails in a task for some queries."""

    def __init__(self, bad, host):
        self.bad, self.host = bad, host

    def search_images(self, queries):
        bad = F.when(F.col("query_text").contains(self.bad), F.raise_error(F.lit("no answer")).cast("string"))
        return queries.select("query_id", F.coalesce(bad, F.concat(F.lit(f"http://{self.host}/"), "query_text")).alias("image_url"))


def test_images_fall_back_query_by_query(spark):
    queries = spark.createDataFrame([(1, "good"), (2, "bad one")], "query_id long, query_text string")
    found = providers.FallbackSearch(LazyImages("bad", "a"), LazyImages("never", "b"), sleep=lambda s: None).search_images(queries)
    assert sorted(r.image_url for r in found.collect()) == ["http://a/good", "http://b/bad one"]


def test_admission(spark):
    urls = ["http://a/", "http://b/", "http://c/", "http://gone/", "no url", "http://", None]
    pages = [(1, "http://a/", b"<p>\xff caf\xc3\xa9", 200), (2, "http://b/", b"x" * 9, None), (3, "http://c/", b"x" * 30, 500), (4, "no url", b"y", 200)]
    found = providers.fetch(spark.createDataFrame([(u,) for u in urls], "url string"), spark.createDataFrame(pages, "page_id long, url string, html binary, status int"), 20, parsed_only=True)
    assert {r.url: (r.html, r.error) for r in found.collect()} == {
        "http://a/": ("<p>� café", None), "http://b/": (None, "http_status"), "http://c/": (None, "too_large"),
        "http://gone/": (None, "not_found"), "no url": (None, "invalid_url"), "http://": (None, "invalid_url"), None: (None, "invalid_url"),
    }


def test_broken_bytes(spark):
    whole = "aé漢😀z".encode()
    cases = [whole[i:j] for i in range(len(whole)) for j in range(i, len(whole) + 1)] + [b"\xf0\x9f\x41", b"\xe6\xbc\xc3\xa9", b"\xc0\xaf", b"\xed\xa0\x80", b"\xff\xfe"]
    found = spark.createDataFrame([(bytearray(c),) for c in cases], "b binary").select("b", X.utf8_lossy(F.col("b")).alias("t")).collect()
    assert [r.t for r in found] == [bytes(r.b).decode(errors="replace") for r in found]


def test_strict_decoding(spark):
    cases = ['{"a": "x", "n": 1}', '{"a": "x", "n": 1, "more": []}', '{"a": "x"}', '{"n": 1}', '{"a": null, "n": 1}', '{"a": "x", "n": "1x"}', '{"a": "x", "n": 1', "[1]", "", None]
    errors = [None, None, "missing: n", "missing: a", "missing: a", "wrong type", "not json", "not json", "not json", "not json"]
    found = spark.createDataFrame([(c,) for c in cases], "body string").select(X.decode_strict(F.col("body"), {"a": "string", "n": "bigint"}).alias("x")).collect()
    assert [r.x.error for r in found] == errors
    assert [r.x.value and tuple(r.x.value) for r in found] == [("x", 1)] * 2 + [None] * 8


def test_settings_of_runs(spark):
    rows = spark.createDataFrame([("r", "n", "3"), ("s", "n", "x"), ("s", "m", "4")], "run_id string, key string, value string")
    found = catalog.typed_settings(rows, {"n": ("bigint", "7"), "m": ("bigint", "1")}, "run_id").collect()
    assert sorted(map(tuple, found)) == [("r", 3, 1), ("s", 7, 4)]
    assert [tuple(r) for r in catalog.typed_settings(rows.limit(0), {"n": ("bigint", "7")}).collect()] == [(7,)]


def test_percent_rounds_halves_upward(spark):
    rows = spark.createDataFrame([(0.125,), (0.995,), (0.0,), (1.0,), (None,)], "x double")
    assert [r[0] for r in rows.select(X.score_percent(F.col("x"))).collect()] == [13, 100, 0, 100, None]
