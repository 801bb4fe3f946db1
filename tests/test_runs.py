"""Runs that are cancelled, paused, lost and resumed; the versioned manifest below them."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tablesmith.operators.validate import Field
from tablesmith.plans import engine, images, planning
from tablesmith.plans.catalog import Catalog
from tablesmith.plans.manifest import Change, Conflict, Manifest, overlap
from tablesmith.sources import providers

FIELDS = [Field("name", "text", True), Field("website", "url", True)]


def small_pages(spark, n=12):
    html = lambda k: f"<html><head><title>word {'abcdef'[k % 6] * 12}</title></head><body><p>{'word text here ' * 90}</p></body></html>"
    return spark.createDataFrame([(k, f"http://h/{k:03}", html(k)) for k in range(n)], "page_id long, url string, html string")


class Counting:
    """A model that leaves a line in a file for each call."""

    def __init__(self, folder, tokens=None):
        self.folder, self.tokens = str(folder), tokens

    def extract(self, url, title, text, fields):
        with open(f"{self.folder}/{os.getpid()}", "a") as f:
            f.write(url + "\n")
        if url.endswith("7"):
            raise RuntimeError("this page can't be read")
        return [(json.dumps({"name": title, "website": url}), 0.9)]

    def usage(self):
        return self.tokens


def calls(folder):
    return sorted(x for n in os.listdir(folder) for x in open(f"{folder}/{n}").read().split())


def make(spark, tmp_path, **more):
    return engine.ResearchEngine(spark, f"file://{tmp_path}/catalog", small_pages(spark), **more)


def test_the_model_is_called_once_a_page_and_a_failing_page_is_left_out(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    e = make(spark, tmp_path, model=Counting(tmp_path / "calls", (1000, 100)))
    run = e.start_run("word", FIELDS)
    assert calls(tmp_path / "calls") == [f"http://h/{k:03}" for k in range(12)]
    stats = json.loads(e.get_run(run).stats)
    assert (stats["llm_calls"], stats["search_calls"], stats["rows_valid"], stats["rows_found"], stats["duplicates_merged"]) == (12, 1, 11, 6, 5)
    assert stats["spent_usd"] == pytest.approx(0.005 + 12 * 0.00021) and stats["queries_failed"] == 0 and stats["elapsed_secs"] >= 0
    assert {"pages_fetched": 12, "pages_failed": 0, "queries_executed": 1}.items() <= stats.items()


def test_model_costs_end_a_run(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(engine, "BATCH_PAGES", 3)
    (tmp_path / "calls").mkdir()
    e = make(spark, tmp_path, model=Counting(tmp_path / "calls", (1_000_000, 0)))
    stats = json.loads(e.get_run(e.start_run("word", FIELDS, max_budget_usd=0.6)).stats)
    assert stats["stop_reason"] == "budget_exhausted" and stats["pages_fetched"] == 6 and stats["spent_usd"] == pytest.approx(0.905)


def during(monkeypatch, e, step, act):
    """Calls act(run_id) while a step of the run is at work."""
    old = getattr(engine, step)

    def met(*args, **kwargs):
        act(e.list_runs().first()["run_id"])
        return old(*args, **kwargs)

    monkeypatch.setattr(engine, step, met)


def test_cancel_in_dedup_stays_and_its_work_is_thrown_away(spark, tmp_path, monkeypatch):
    e = make(spark, tmp_path)
    during(monkeypatch, e, "with_leaders", e.cancel_run)
    run = e.start_run("word", FIELDS)
    assert e.get_run(run).status == "cancelled" and e.get_run_rows(run).count() == 0
    assert {r.status for r in e.catalog.of_run("entity_rows", run).collect()} == {"valid"} and not e._is_done(run, "dedup")
    with pytest.raises(ValueError):
        e.resume_run(run)


def test_pause_in_dedup_keeps_its_work(spark, tmp_path, monkeypatch):
    e = make(spark, tmp_path)
    during(monkeypatch, e, "with_leaders", e.pause_run)
    run = e.start_run("word", FIELDS)
    assert e.get_run(run).status == "paused" and e.get_run_rows(run).count() == 6
    assert e.get_run(e.resume_run(run)).status == "completed" and e.get_run_rows(run).count() == 6


def test_dedup_done_twice_gives_the_same(spark, tmp_path):
    e = make(spark, tmp_path)
    run = e.start_run("word", FIELDS)
    look = lambda: (sorted((r.entity_row_id, r.status, r.dedup_group_id) for r in e.catalog.of_run("entity_rows", run).collect()), sorted(map(str, e.get_run_rows(run).select("data", "sources").collect())))
    first = look()
    e._set(run, "running", ("completed",))
    assert e._dedup(run, FIELDS, json.loads(e.get_run(run)["config"])) and look() == first
    assert all(g is not None for _, status, g in first[0] if status in ("merged", "final"))


@pytest.mark.parametrize("lost_at", [0, 2, 4, 7, 8])
def test_a_driver_lost_between_any_two_writes(spark, tmp_path, monkeypatch, lost_at):
    """The process ends at a write of the run; another engine resumes it and ends with the same rows, once each."""
    monkeypatch.setattr(engine, "BATCH_PAGES", 6)
    writes = []
    old = Change._write

    class Lost(BaseException):
        pass

    def write(self, do, table, *more):
        if table in ("entity_rows", "row_sources", "fetched_pages", "search_results"):
            writes.append(table)
            if len(writes) == lost_at + 1:
                raise Lost
        return old(self, do, table, *more)

    monkeypatch.setattr(Change, "_write", write)
    e = make(spark, tmp_path)
    with pytest.raises(Lost):
        e.start_run("word", FIELDS)
    monkeypatch.setattr(Change, "_write", old)
    again = make(spark, tmp_path)
    run = again.list_runs().first()["run_id"]
    assert again.get_run(again.resume_run(run)).status == "completed"
    rows = again.catalog.of_run("entity_rows", run)
    assert rows.where("status = 'merged'").count() == 12
    assert {json.loads(r.data)["name"]: len(r.sources) for r in again.get_run_rows(run).collect()} == {f"word {c * 12}": 2 for c in "abcdef"}
    assert json.loads(again.get_run(run).stats)["pages_fetched"] == 12


def test_the_name_column_groups_rows(spark, tmp_path):
    fields = [Field("website", "url", True), Field("name", "text", True)]

    class OneSite:
        def extract(self, url, title, text, fields):
            return [(json.dumps({"website": "http://one", "name": title}), 0.9)]

    e = make(spark, tmp_path, model=OneSite())
    assert e.get_run_rows(e.start_run("word", fields)).count() == 6
    assert engine.name_field(fields) == "name" and engine.name_field([Field("a"), Field("b", "url", True), Field("c", "text", True)]) == "c" and engine.name_field([Field("a"), Field("b", "number", True)]) == "a"


class Lazy:
    """A provider whose frame fails in a task for some queries."""

    def __init__(self, bad, kind=ValueError):
        self.bad, self.kind = bad, kind

    def search(self, queries):
        bad, kind = self.bad, self.kind

        def run(frames):
            for f in frames:
                if any(bad in q for q in f["query_text"]):
                    raise kind("no answer")
                yield f.assign(url="http://first/" + f["query_text"], title="t", snippet="", position=0)[["query_id", "url", "title", "snippet", "position"]]

        return queries.mapInPandas(run, "query_id long, url string, title string, snippet string, position long")


class Second(Lazy):
    def search(self, queries):
        return super().search(queries).withColumn("url", F.regexp_replace("url", "first", "second"))


def test_fallback_of_a_lazy_provider_query_by_query(spark):
    queries = spark.createDataFrame([(1, "good"), (2, "bad one"), (3, "fine")], "query_id long, query_text string")
    found = providers.FallbackSearch(Lazy("bad"), Second("never"), sleep=lambda s: None).search(queries)
    assert sorted(r.url for r in found.collect()) == ["http://first/fine", "http://first/good", "http://second/bad one"]
    with pytest.raises(Exception, match="no answer"):
        providers.FallbackSearch(Lazy("bad"), sleep=lambda s: None).search(queries)
    waits = []
    providers.FallbackSearch(Lazy("bad", providers.Retryable), Second("never"), sleep=waits.append).search(queries)
    assert waits == [2.0, 4.0]


def test_status_of_pages(spark):
    pages = spark.createDataFrame([(1, "a", "x", 200), (2, "b", "y", 404)], "page_id long, url string, html string, status int")
    found = providers.fetch(spark.createDataFrame([("a",), ("b",)], "url string"), pages)
    assert {r.url: (r.html, r.error) for r in found.collect()} == {"a": ("x", None), "b": (None, "http_status")}


def test_images_without_a_working_model(spark):
    class Broken(planning.OfflineModel):
        def complete(self, task, prompt):
            raise RuntimeError("no model")

    assert [r.query_text for r in images.image_queries(spark, "red hd photo", Broken()).orderBy("query_id").collect()] == ["red hd photo", "best red hd photo pictures", "red hd photo examples"]
    found = spark.createDataFrame([(k, f"t{k}") for k in range(20)], "idx long, title string")
    assert {r.score for r in images.score_images(found, "q", Broken()).collect()} == {images.UNRANKED}


# the manifest


def rows(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "x long")


def content(spark, manifest, table, scope=None):
    folders = manifest.folders(table, scope)
    return sorted(r.x for r in spark.read.parquet(*folders).collect()) if folders else []


def test_changes_come_together_or_not_at_all(spark, tmp_path):
    m = Manifest(spark, f"file://{tmp_path}/m")
    c = Change(m, "run")
    c.put("a", rows(spark, 1), "k")
    c.put("b", rows(spark, 2))
    assert Manifest(spark, m.root).refresh() == 0  # written, and seen by nobody
    assert c.finish() == 1
    d = Change(m, "run")
    assert d.put("a", rows(spark, 3, 5), "k", {"n": F.count(F.lit(1)), "most": F.max("x")}) == {"n": 2, "most": 5}
    d.replace("b", rows(spark, 4))
    d.finish()
    reader = Manifest(spark, m.root)
    assert reader.refresh() == 2 and content(spark, reader, "a") == [3, 5] and content(spark, reader, "b") == [4]
    assert content(spark, m.at(1), "a") == [1] and content(spark, m.at(1), "b") == [2]
    assert m.vacuum(["a", "b"]) == 2 and content(spark, reader, "a") == [3, 5]


def test_of_two_writers_one_is_refused(spark, tmp_path):
    root = f"file://{tmp_path}/m"
    one, two, other = Change(Manifest(spark, root), "run"), Change(Manifest(spark, root), "run"), Change(Manifest(spark, root), "else")
    one.replace("a", rows(spark, 1))
    two.replace("a", rows(spark, 2))
    other.replace("a", rows(spark, 3))
    one.finish()
    with pytest.raises(Conflict):
        two.finish()
    other.finish()
    reader = Manifest(spark, root)
    reader.refresh()
    assert content(spark, reader, "a", "run") == [1] and content(spark, reader, "a") == [1, 3]
    two.rebase()
    two.finish()
    reader.refresh()
    assert content(spark, reader, "a", "run") == [2]
    reads = Change(reader, "run", ["a/*"])
    reads.put("b", rows(spark, 9))
    third = Change(Manifest(spark, root), "run")
    third.put("a", rows(spark, 7))
    third.finish()
    with pytest.raises(Conflict):
        reads.finish()


def test_overlaps():
    assert overlap("a/*", "a/k") and overlap("a/k", "a/k") and overlap("*", "b/c") and not overlap("a/k", "a/j") and not overlap("a/*", "b/*")


def test_whole_states_are_kept_now_and_then(spark, tmp_path, monkeypatch):
    from tablesmith.plans import manifest

    monkeypatch.setattr(manifest, "CHECKPOINT", 3)
    m = Manifest(spark, f"file://{tmp_path}/m")
    for k in range(7):
        c = Change(m, "run")
        c.set("last", str(k))
        c.actions.append({"do": "put", "table": "t", "key": str(k), "path": f"p{k}"})
        c.finish()
    assert [n for n in m.files.names() if n.endswith(".state")] == ["000000000003.state", "000000000006.state"]
    for n in m.files.names():
        if n.endswith(".commit") and n < "000000000006":
            m.files.fs.delete(m.files.path(n), False)
    reader = Manifest(spark, m.root)
    assert reader.refresh() == 7 and reader.folders("t") == [f"p{k}" for k in range(7)] and reader.values == {"last": "6"}


def test_deleted_runs_and_lost_folders_go(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}/c")
    c.append("runs", spark.createDataFrame([("q",)], "query string"), "r1")
    c.append("runs", spark.createDataFrame([("p",)], "query string"), "r2")
    c.change("r2").put("runs", spark.createDataFrame([("lost",)], "query string"))
    c.delete("r1")
    assert [(r.run_id, r.query) for r in c.read("runs").collect()] == [("r2", "p")] and c.vacuum() == 2
    assert [r.query for r in c.of_run("runs", "r2").collect()] == ["p"]
