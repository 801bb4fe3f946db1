"""Operators of the engine: unit cases, brute force, files and streams."""

import csv
import json
import random
import zipfile
from collections import Counter

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablesmith.functions import html
from tablesmith.functions import text as X
from tablesmith.operators import dedup
from tablesmith.operators.validate import Field, valid_only, validate
from tablesmith.plans import engine, images, planning
from tablesmith.plans.catalog import DEFAULTS, Catalog
from tablesmith.sources import pdf, providers, sinks
from tablesmith.streaming import stream


@pytest.mark.parametrize(
    ("page", "title", "text"),
    [
        ("<title> A &amp; B </title><p>x</p>", "A & B", "A & B x"),
        ("<body><h1>Head</h1><script>no</script><p>one\n two</p></body>", "Head", "Head one two"),
        ("<body><nav>n</nav><article>" + "word " * 30 + "<footer>f</footer></article>tail</body>", "", ("word " * 30).strip()),
        ("<body><article>short</article>rest<br>more</body>", "", "short rest more"),
        ("", "", ""),
        (None, "", ""),
        ("<p>unclosed <b>tags<div>here", "", "unclosed tags here"),
    ],
)
def test_html(page, title, text):
    assert html.parse(page) == (title, text)


def brute_groups(rows, threshold):
    out, names = {}, [(s, n) for s, n in sorted(rows)]
    for i, (s, n) in enumerate(names):
        if s in out:
            continue
        out[s] = s
        for t, m in names[i + 1 :]:
            if t not in out and n and m and (n == m or 1.0 - dedup.damerau(n, m) / max(len(n), len(m)) >= threshold):
                out[t] = s
    return out


@pytest.mark.parametrize("threshold", [0.85, 0.6, 0.3])
def test_fuzzy_groups_against_greedy_loop(spark, threshold):
    rng = random.Random(7)
    rows = [(i, "".join(rng.choice("abc") for _ in range(rng.randrange(0, 12)))) for i in range(120)]
    found = dedup.fuzzy_groups(spark.createDataFrame(rows, "seq long, name string"), threshold)
    assert {r.seq: r.leader for r in found.collect()} == brute_groups(rows, threshold)


def test_pairs_of_long_names_against_all_pairs_and_what_a_task_holds(spark):
    rng = random.Random(3)
    bases = ["".join(rng.choice("etao nhis") for _ in range(60)) for _ in range(15)]
    swapped = lambda n, k: n[:k] + n[k + 1] + n[k] + n[k + 2 :]
    names = sorted({x for b in bases for x in (b, b[7:], swapped(b, 9), swapped(swapped(b, 5), 30)[1:-4], "".join("x" if k % 7 == 0 else c for k, c in enumerate(b)), b[:4])})
    for threshold in (0.85, 0.96):
        near = lambda x, y: 1.0 - dedup.damerau(x, y) / max(len(x), len(y)) >= threshold  # noqa: B023, E731
        want = {(x, y) for k, x in enumerate(names) for y in names[k + 1 :] if min(len(x), len(y)) >= threshold * max(len(x), len(y)) and near(x, y)}
        assert {(r.a, r.b) for r in dedup.fuzzy_pairs(spark.createDataFrame([(n,) for n in names], "name string"), threshold).collect()} == want and want
    many = pd.DataFrame({"name": ["".join(rng.choice("etao nhis") for _ in range(60)) for _ in range(500)]})
    for threshold in (0.85, 0.96):  # before, one frame of millions of keys
        assert max((len(f) for f in dedup._signatures(threshold, True)(iter([many]))), default=0) <= 50_000


def test_names_of_60_characters_meet_by_segments_with_gaps(spark, monkeypatch):
    rng = random.Random(11)
    draw = lambda n: "".join(rng.choices("etaoinshrdlcumwfgyp. ", k=n))
    segments = dedup._segments(60, 9)
    planted = []
    for _ in range(200):  # one operation in, or at the end of, each segment but one
        name = list(draw(60))
        base, left = "".join(name), rng.randrange(10)
        for j in sorted({*range(10)} - {left}, reverse=True):
            at = segments[j][0] + rng.randrange(segments[j][1])
            match rng.randrange(4):
                case 0:
                    name[at] = draw(1)
                case 1:
                    del name[at]
                case 2:
                    name.insert(at, draw(1))
                case _:
                    at = max(0, segments[j][0] - 1)
                    name[at : at + 2] = name[at : at + 2][::-1]
        planted.append((base, "".join(name)))
    names = sorted({x for p in planted for x in p} | {draw(60) for _ in range(1500)})
    assert sum(map(len, dedup._grams(0.85)(iter([pd.DataFrame({"name": names})])))) == 0  # before, each was compared with each
    looked, apart = [], dedup._apart
    monkeypatch.setattr(dedup, "_apart", lambda x, y: looked.append(len(x)) or apart(x, y))
    halves = dedup._blocks(*[pa.array(names[k::2]) for k in (0, 1)])
    met = [(b, b, True) for b in halves] + [(halves[0], halves[1], True), (halves[1], halves[0], False)]
    found = {frozenset((x.names[int(i)].as_py(), y.names[int(j)].as_py())) for x, y, equal in met for a, b in dedup._gapped(x, y, equal, 0.85) for i, j in zip(a, b, strict=True)}
    near = {frozenset(p) for p in planted if p[0] != p[1] and 1.0 - dedup.damerau(*p) / max(map(len, p)) >= 0.85}
    assert len(near) > 150 and near <= found
    assert sum(looked) < 0.2 * len(names) ** 2 / 2
    few = spark.createDataFrame([(x,) for p in planted[:30] for x in p], "name string")
    told = {(r.a, r.b) for r in dedup.fuzzy_pairs(few).collect()}
    assert told == {(r.a, r.b) for r in dedup.similar_pairs(few).collect()} and {frozenset(p) for p in told} >= near & {frozenset(p) for p in planted[:30]}


def test_pages_go_to_python_in_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    engine.page_rows(spark.createDataFrame([("http://a", "<title>a</title>")], "url string, html string"), [Field("name")])
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 2_000  # before, 10,000 pages at once


def test_damerau():
    assert [dedup.damerau(*p) for p in (("ca", "abc"), ("", "ab"), ("apple inc", "apple inc."), ("ab", "ba"), ("é", "e"))] == [2, 2, 1, 1, 1]


def test_validate_cases(spark):
    fields = [Field("name", "text", True), Field("website", "url"), Field("employees", "number")]
    rows = [(0, '{"name": "a", "website": "http://a", "employees": 5}', 0.9), (1, '{"website": "http://a"}', 0.9), (2, '{"name": "a"}', 0.3), (3, '{"name": "a", "website": "a.com"}', 0.9), (4, '{"name": "a", "employees": "12"}', 0.9), (5, '{"name": "a", "employees": "many"}', 0.9), (6, "3", 0.9), (7, "not json", 0.9), (8, None, 0.9), (9, '{"name": null, "employees": ""}', 0.9), (10, '{"name": 7, "employees": true}', None)]
    found = {r.seq: r for r in validate(spark.createDataFrame(rows, "seq long, data string, confidence double"), fields).collect()}
    assert {k for k, r in found.items() if r.is_valid} == {0, 4}
    assert found[2].issues == ["Confidence 0.30 below threshold 0.50"] and found[9].issues == ["Required column 'name' is missing or empty", "Column 'employees' expected number, got text ''"]
    assert all(found[k].issues == ["Row data is not a JSON object"] for k in (6, 7, 8)) and found[10].issues == ["Column 'employees' expected number"]


def test_merge_fields_by_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(20), i, rng.choice([0.1, 0.5, 0.5]), "u", rng.choice([None, "", f"v{i}"])) for i in range(100)]
    found = {r.key: r for r in dedup.merge_groups(spark.createDataFrame(rows, "key long, seq long, confidence double, source_url string, x string"), "key", ["x"]).collect()}
    for k in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == k]
        best = max(own, key=lambda r: (r[2], r[1]))
        order = [best, *[r for r in own if r is not best]]
        want = next((r[4] for r in order if r[4]), "" if any(r[4] == "" for r in own) else None)
        assert found[k].x == want and found[k].member_count == len(own)


def test_pdf():
    assert pdf.clean_text("a \r\n\n\n b\t\tc \n d ") == "a \n\nb c \nd"
    assert pdf.simple_text(b"<< /Length 9 >>\nstream\nBT (Hi \\(x\\)) Tj ET\nendstream") == "Hi (x)" and pdf.simple_text(b"junk") == ""


def test_retry():
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise providers.Retryable("busy", 99 if len(calls) == 1 else None)
        return 7

    assert providers.with_retry(call, sleep=waits.append) == 7 and waits == [30.0, 4.0]
    with pytest.raises(ZeroDivisionError):
        providers.with_retry(lambda: 1 / 0)


def export_rows(spark):
    src = "array<struct<url:string,title:string,snippet:string>>"
    return spark.createDataFrame([(1, '{"name":"a, \\"b\\"","n":[1,2],"x":null}', 0.125, [("http://1", None, "s"), ("http://2", "t", None)]), (2, '{"name":"<&>"}', 1.0, [])], f"seq long, data string, confidence double, sources {src}")


def test_exports(spark, tmp_path):
    rows = export_rows(spark)
    sinks.export(rows, ["name", "n", "x"], f"{tmp_path}/a.csv", "CSV")
    assert list(csv.reader(open(f"{tmp_path}/a.csv"))) == [["name", "n", "x", "confidence", "sources"], ['a, "b"', "[1,2]", "", "0.12", "http://1; http://2"], ["<&>", "", "", "1.00", ""]]
    sinks.export(rows, [], f"{tmp_path}/a.json", "json")
    assert json.load(open(f"{tmp_path}/a.json"))[0] == {"name": 'a, "b"', "n": [1, 2], "x": None, "confidence": 0.125, "sources": [{"url": "http://1", "snippet": "s"}, {"url": "http://2", "title": "t"}]}
    sinks.export(rows, ["name"], f"{tmp_path}/a.xlsx", "xlsx")
    sheet = zipfile.ZipFile(f"{tmp_path}/a.xlsx").read("xl/worksheets/sheet1.xml").decode()
    assert "&lt;&amp;&gt;" in sheet and "<v>0.125</v>" in sheet
    with pytest.raises(ValueError, match="unknown export format"):
        sinks.export(rows, [], "x", "pdf")


def test_engine_end_to_end(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    e = engine.ResearchEngine(spark, f"file://{tmp_path}/catalog", pages)
    e.update_setting("min_confidence_threshold", "0.1")
    run = e.start_run("the and of", max_budget_usd=0, target_row_count="x")
    assert e.get_run(run).status == "completed" and json.loads(e.get_run(run)["config"])["max_budget_usd"] == "1.0"
    rows = e.get_run_rows(run).collect()
    assert rows and all(r.sources for r in rows)
    members = e.catalog.of_run("entity_rows", run).where("status = 'merged'").collect()
    assert {m.dedup_group_id for m in members} == {r.entity_row_id for r in rows} and sum(len(r.sources) for r in rows) == len(members)
    stats = json.loads(e.get_run(run).stats)
    assert stats["rows_valid"] == len(members) and stats["unique_rows"] == len(rows) and stats["queries_executed"] == 1
    assert {r.status for r in e.catalog.of_run("search_results", run).collect()} == {"fetched"} and e.get_run_schema(run)[0].name == "name"
    e.export_run(run, f"{tmp_path}/out.csv", "csv")
    assert len(list(csv.reader(open(f"{tmp_path}/out.csv")))) == len(rows) + 1
    empty = e.start_run("qqqqqq")
    assert e.get_run(empty).status == "completed" and e.get_run_rows(empty).count() == 0
    e.delete_run(run)
    assert e.get_run(run) is None and e.list_runs().count() == 1
    with pytest.raises(ValueError):
        e.start_run(" ")

    class Broken:
        def search(self, queries):
            raise RuntimeError("no search")

    e.search = Broken()
    with pytest.raises(RuntimeError):
        e.start_run("x y")
    assert {r.status for r in e.list_runs().collect()} == {"completed", "failed"} and DEFAULTS["target_row_count"] == "50"
    e.search = providers.FallbackSearch(Broken(), providers.CorpusSearch(pages), sleep=lambda s: None)
    assert e.get_run(e.start_run("the and of")).status == "completed"


def small_pages(spark, n=12):
    html = lambda k: f"<html><head><title>word {'abcdef'[k % 6] * 12}</title></head><body><p>{'word text here ' * 90}</p></body></html>"
    return spark.createDataFrame([(k, f"http://h/{k:03}", html(k)) for k in range(n)], "page_id long, url string, html string")


def test_runs_stop_wait_pause_and_cancel(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(engine, "BATCH_PAGES", 2)
    e = engine.ResearchEngine(spark, f"file://{tmp_path}/catalog", small_pages(spark))
    run = e.start_run("word", target_row_count=3)
    stats = json.loads(e.get_run(run).stats)
    assert stats["stop_reason"] == "target_reached" and stats["pages_fetched"] == 4 and not e.catalog.pending(run).isEmpty()
    assert json.loads(e.get_run(e.start_run("word", max_budget_usd=0.001)).stats)["stop_reason"] == "budget_exhausted"
    waits = e.start_run("word", confirm=False)
    assert e.get_run(waits).status == "pending"
    with pytest.raises(ValueError):
        e.resume_run(waits)
    with pytest.raises(ValueError):
        e.confirm_schema(waits, [Field(" ")])

    class Pausing(providers.CorpusSearch):
        def search(self, queries):
            e.pause_run(waits)
            return super().search(queries)

    e.search = Pausing(e.pages)
    e.confirm_schema(waits, [Field("name", "text", True), Field(" ")])
    assert e.get_run(waits).status == "paused" and e.get_run_rows(waits).count() == 0 and [f.name for f in e.get_run_schema(waits)] == ["name"]
    e.resume_run(waits)
    assert e.get_run(waits).status == "completed"
    rows = {json.loads(r.data)["name"]: len(r.sources) for r in e.get_run_rows(waits).collect()}
    assert rows == {f"word {c * 12}": 2 for c in "abcdef"}
    with pytest.raises(ValueError):
        e.cancel_run(waits)
    gone = e.start_run("word", confirm=False)
    e.cancel_run(gone)
    assert e.get_run(gone).status == "cancelled"
    with pytest.raises(ValueError):
        e.confirm_schema(gone)


def test_equal_rows_of_a_page_count_once_each(spark):
    class Twice:
        def extract(self, url, title, text, fields):
            return providers.decode_rows(json.dumps({"rows": [{"data": {"name": "Acme"}, "confidence": 0.9}] * 2}))

    fields = [Field("name", "text", True)]
    pages = spark.createDataFrame([("http://a", f"<title>t</title><p>{'word ' * 50}</p>")], "url string, html string")
    rows = engine.in_order(engine.page_rows(pages, fields, Twice()))
    assert [(r.name, r.member_count, r.sources) for r in engine.dedup_rows(rows, "name", fields).collect()] == [("Acme", 2, ["http://a"] * 2)]


def test_rows_without_a_name_lead_themselves(spark):
    rows = spark.createDataFrame([(1, None), (2, None), (3, ""), (4, "a")], "seq long, name string")
    assert {r.seq: r.leader for r in dedup.fuzzy_groups(rows).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}


def test_extraction_envelope():
    assert providers.decode_rows('{"rows": [{"data": {"a": 1, "b": []}, "more": 0}, {"data": 3, "confidence": 2}]}') == [('{"a": 1, "b": []}', 0.5), ("3", 2.0)]
    for bad in ("[]", "{}", '{"rows": {}}', '{"rows": [1]}', '{"rows": [{"confidence": 1}]}', '{"rows": [{"data": 1, "confidence": "x"}]}', "no"):
        with pytest.raises(ValueError):
            providers.decode_rows(bad)


def test_planning_is_strict():
    class Model:
        def __init__(self, **told):
            self.told = told

        def complete(self, task, prompt):
            return self.told[task]

    full = {"entity_type": "x", "attributes": [], "constraints": ["c"], "languages": [], "original_query": "other"}
    assert planning.interpret("q", Model(interpret=json.dumps(full))) == {**full, "languages": ["en"], "original_query": "q"}
    for bad in ({**full, "constraints": None}, {**full, "entity_type": 1}, []):
        with pytest.raises(ValueError):
            planning.interpret("q", Model(interpret=json.dumps(bad)))
    with pytest.raises(ValueError):
        planning.plan_schema(full, Model(schema='{"columns": []}'))
    with pytest.raises(ValueError):
        planning.plan_searches(full, [], Model(searches='{"queries": [{"query_text": "a", "priority": 256}]}'))
    assert planning.expand([], ["de"], Model(expand='{"queries": [{"query_text": "a"}, {"query_text": "a"}]}')) == [{"query_text": "a", "language": "en", "priority": 1}] * 2
    assert [planning.positive(v, 7) for v in ("3", -1, 0, None, "x", "nan")] == [3, 7, 7, 7, 7, 7]


def test_image_run(spark, tmp_path):
    tag = lambda k: f'<img src="http://i/{k % 9}.png" alt="red car {k}" width="{k}">'
    pages = spark.createDataFrame([(k, f"http://h/{k}", "<p>x</p>" + tag(k) + '<IMG alt="none">') for k in range(20)], "page_id long, url string, html string")
    asked = []

    class Model(planning.OfflineModel):
        def complete(self, task, prompt):
            asked.append(task)
            return "[0.9, 0.2]" if task == "scores" else '["blue", "car"]'

    e = engine.ResearchEngine(spark, f"file://{tmp_path}/catalog", pages, planner=planning.OfflineModel())
    run = e.start_run("red car", run_type="images", target_row_count=4)
    found = e.get_image_results(run).collect()
    assert [r.idx for r in found] == [0, 1, 2, 3] and {r.score for r in found} == {1.0} and found[0].thumbnail_url == found[0].image_url
    e.export_run(run, f"{tmp_path}/i.json", "json")
    assert [r["width"] for r in json.load(open(f"{tmp_path}/i.json"))] == ["0", "1", "2", "3"]
    assert [r.query_text for r in images.image_queries(spark, "red car", Model()).orderBy("query_id").collect()] == ["red car", "blue", "car"]
    assert [r.query_text for r in images.image_queries(spark, "red hd photo").orderBy("query_id").collect()] == ["red hd photo", "best red hd photo pictures", "red hd photo examples"]
    scored = images.score_images(images.collect_images(images.CorpusImages(pages).search_images(images.image_queries(spark, "red car"))), "red car", Model(), size=5)
    assert {r.idx: r.score for r in scored.collect()} == {k: (0.9, 0.2, 0, 0, 0)[k % 5] for k in range(9)}


def test_proxy_image(spark, tmp_path):
    e = engine.ResearchEngine(spark, f"file://{tmp_path}/catalog", small_pages(spark))
    table = spark.createDataFrame([("a", b"12", "image/png"), ("b", b"12", "text/html"), ("c", b"1" * (11 << 20), "image/gif")], "url string, content binary, content_type string")
    assert [e.proxy_image(table, u) for u in "abcd"] == ["data:image/png;base64,MTI=", None, None, None]


def test_failing_documents_give_no_rows(spark):
    class Model:
        def extract(self, url, title, text, fields):
            return [(json.dumps({"name": url}), 0.5)] if json.loads(text[:4] if url == "bad" else "1") else []

    docs = spark.createDataFrame([("good", "t", "w" * 60), ("bad", "t", "w" * 60), ("short", "t", "w")], "url string, title string, text string")
    assert [r.source_url for r in providers.extract(docs, Model(), []).collect()] == ["good"]


def test_stream_equals_batch(spark, sf, tmp_path):
    fields = [Field("name", "text", True), Field("website", "url", True)]
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    pages.repartition(3).write.parquet(f"{tmp_path}/in")
    rows = stream.validated_pages(stream.stream_table(spark, f"{tmp_path}/in", pages.schema), fields)
    stream.append_until(rows, f"{tmp_path}/out", f"{tmp_path}/cp", lambda b, n: False).awaitTermination()
    made = spark.read.parquet(f"{tmp_path}/out")
    assert Counter(made.select("source_url", "is_valid").collect()) == Counter(stream.validated_pages(pages, fields).select("source_url", "is_valid").collect())


def test_stream_stops(spark, tmp_path):
    spark.range(40).repartition(4).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    stream.append_until(source, f"{tmp_path}/out", f"{tmp_path}/cp", lambda b, n: n >= 1).awaitTermination()
    assert sorted(r.batch for r in spark.read.parquet(f"{tmp_path}/out").select("batch").distinct().collect()) == [0, 1]


def test_restart_after_a_stop_loses_nothing(spark, tmp_path):
    spark.range(40).repartition(4).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    first = stream.append_until(source, f"{tmp_path}/out", f"{tmp_path}/cp", lambda b, n: n >= 1)
    first.awaitTermination()
    assert first.stopped and spark.read.parquet(f"{tmp_path}/out").count() < 40
    stream.append_until(source, f"{tmp_path}/out", f"{tmp_path}/cp", lambda b, n: False).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(40))


def test_distinct_arrivals(spark, tmp_path):
    made = spark.range(30).select(F.concat(F.lit("k"), F.col("id") % 7).alias("key"), F.timestamp_seconds(F.col("id")).alias("at"))
    made.repartition(3).write.parquet(f"{tmp_path}/in")
    rows = stream.distinct_arrivals(stream.stream_table(spark, f"{tmp_path}/in", made.schema), "key", "at")
    stream.append_until(rows, f"{tmp_path}/out", f"{tmp_path}/cp", lambda b, n: False).awaitTermination()
    assert sorted(r.key for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [f"k{k}" for k in range(7)]


def test_shared_folder_is_demanded_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace as N

    from tablesmith.operators import shared

    session = lambda master, told: N(conf=N(get=lambda k, d=None: told), sparkContext=N(master=master, applicationId="a"))
    assert shared.new_path(session("yarn", "s3://b/c/"), "x").startswith("s3://b/c/x-") and shared.new_path(session("local[4]", None), "x").startswith("file:///tmp/")
    for master in ("yarn", "spark://h:7077", "local-cluster[3,2,1000]"):
        with pytest.raises(ValueError):
            shared.new_path(session(master, None), "x")


def test_scalars(spark):
    one = spark.createDataFrame([("[0.9, 2]", "a  b\n", 0.285)], "r string, t string, x double")
    r = one.select(X.parse_scores(F.col("r"), F.lit(3)).alias("s"), X.clean_whitespace(F.col("t")).alias("t"), X.format_2dp(F.col("x")).alias("x"), X.cap_queries(F.array(F.lit("A"), F.lit("b")), F.lit("a")).alias("q"), X.cap_queries(F.array(F.lit("b")), F.lit("a"), 1).alias("p")).first()
    assert (r.s, r.t, r.x, r.q, r.p) == ([0.9, 1.0, 0.0], "a b", "0.28", ["A", "b"], ["a"])


def test_catalog_settings(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}")
    assert c.read("settings").count() == 0
    c.append("settings", spark.createDataFrame([("a", "1")], "key string, value string"))
    assert [tuple(r) for r in c.read("settings").collect()] == [("a", "1", None)]


def test_a_row_is_parsed_once_however_its_issues_are_used(spark):
    rows = spark.createDataFrame([('{"a": "x"}', 1.0)], "data string, confidence double")
    fields = [Field("a", "number", True), Field("b", "url"), Field("c", "email", True)]
    kept = valid_only(validate(rows, fields))
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parsejson") == 1 and kept.count() == 0  # before, 46 times in valid_rows
