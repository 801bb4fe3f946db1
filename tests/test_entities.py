"""Entities by several keys, similar names, the page index, novelty and evolving tables, against brute force."""

import math
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from tablesmith.operators import graph, names, novelty
from tablesmith.plans import evolving
from tablesmith.plans.manifest import Conflict
from tablesmith.sources import index


def brute_components(pairs):
    leader = {}

    def find(x):
        while leader.setdefault(x, x) != x:
            x = leader[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        leader[b] = a
    return {x: find(x) for x in leader}


@pytest.mark.parametrize("hot", [graph.HOT, 3])
def test_components(spark, monkeypatch, hot):
    monkeypatch.setattr(graph, "HOT", hot)
    rng = random.Random(hot)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(100 + k, 101 + k) for k in range(40)] + [(500, k) for k in range(501, 560)]
    pairs = [(a, b) for a, b in pairs if a != b]
    found = graph.components(spark.createDataFrame(pairs, "a long, b long"))
    assert {r.node: r.component for r in found.collect()} == brute_components(pairs)
    assert graph.components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_entities_by_several_keys_with_a_hot_one(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice([None, "", "hot", "hot", f"n{rng.randrange(90)}"]), rng.choice([None, f"n{rng.randrange(90)}"])) for k in range(200)]
    links = [(a[0], b[0]) for a, b in combinations(rows, 2) if a[1] and a[1] == b[1] or a[2] and a[2] == b[2]]
    want = brute_components(links)
    found = graph.same_by_keys(spark.createDataFrame(rows, "seq long, name string, site string"), "seq", {"name": F.col("name"), "site": F.col("site")})
    assert {r.seq: r.leader for r in found.collect()} == {k: want.get(k, k) for k, _, _ in rows}


def test_rows_of_one_url_are_merged(spark):
    rows = spark.createDataFrame([(1, 0.5, "u", None), (2, 0.9, "u", ""), (3, 0.4, "u", "x"), (4, 0.1, "", "y"), (5, 0.1, None, "z")], "seq long, confidence double, source_url string, name string")
    assert sorted((r.name, r.member_count) for r in graph.merged_by_url(rows, "source_url", ["name"]).collect()) == [("x", 3), ("y", 1), ("z", 1)]


def some_names(rng, n):
    base = ["martha", "dixon", "acme corp", "jones & sons", "a", "ab"]
    made = {"".join(rng.choice("abcde ") for _ in range(rng.randrange(1, 10))).strip() or "x" for _ in range(n)}
    for b in base:
        made.add(b)
        for _ in range(4):
            k = rng.randrange(len(b))
            made.add((b[:k] + rng.choice("abx") + b[k + rng.randrange(0, 2) :])[:12])
    return sorted(made)


@pytest.mark.parametrize("least", [0.7, 0.85, 0.95])
def test_similar_names_are_those_of_all_pairs(spark, least):
    made = some_names(random.Random(7), 150)
    con = duckdb.connect()
    want = {}
    for a, b in combinations(made, 2):
        v = names.jaro_winkler(a, b)
        if v >= least:
            want[a, b] = round(v, 9)
    for (a, b), v in list(want.items())[:300]:
        assert v == pytest.approx(con.execute("select jaro_winkler_similarity(?, ?)", [a, b]).fetchall()[0][0])
    found = names.similar_names(spark.createDataFrame([(x,) for x in made + made[:5] + ["", None]], "name string"), least)
    assert {(r.a, r.b): round(r.similarity, 9) for r in found.collect()} == want
    assert {r.tier for r in found.collect()} <= {n for n, at in names.TIERS.items() if at >= least}


def test_names_below_the_bound_are_refused(spark):
    with pytest.raises(ValueError):
        names.similar_names(spark.createDataFrame([("a",)], "name string"), 0.5)


def brute_bm25(pages, query, most=20):
    words = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    docs = {i: words(re.sub("<[^>]*>", " ", h or "")) for i, _, h in pages}
    avg, df = sum(map(len, docs.values())) / len(docs), Counter(w for d in docs.values() for w in set(d))
    out = {}
    for i, d in docs.items():
        tf, score = Counter(d), 0
        for w in set(words(query)):
            if tf[w]:
                score += math.floor(math.log((len(docs) - df[w] + 0.5) / (df[w] + 0.5) + 1.0) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(d) / avg)) * 1_000_000)
        if any(tf[w] for w in set(words(query))):
            out[i] = score
    return [(i, s) for i, s in sorted(out.items(), key=lambda x: (-x[1], x[0]))[:most]]


def test_index_gives_the_best_pages_of_bm25(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "BLOCK_IDS", 8)
    monkeypatch.setattr(index, "FIRST_BLOCKS", 2)
    rng = random.Random(5)
    vocabulary = [f"w{int(rng.paretovariate(0.6))}" for _ in range(400)]
    pages = [(k, f"http://{k}", f"<title>t{k}</title><p>{' '.join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 60)))}</p>") for k in range(150)] + [(150, "http://none", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = index.build(df, f"file://{tmp_path}/index")
    again = index.PageIndex(spark, f"file://{tmp_path}/index")  # nothing but the index is read
    queries = [(1, "w1 w2"), (2, "w1 W1 w3 w17"), (3, "nothing here"), (4, "")]
    made = again.search(spark.createDataFrame(queries, "query_id long, query_text string"))
    for q, text in queries:
        got = [(int(r.url.rpartition("/")[2]), r.score) for r in made.where(F.col("query_id") == q).orderBy("position").collect()]
        assert got == brute_bm25(pages, text), text
    assert found.path == again.path and made.where("title = 't1'").count() <= 3


def test_novelty_exact_and_by_sketches(spark):
    rng = random.Random(6)
    rows = [(run, b, f"k{int(rng.paretovariate(0.4))}") for run in ("a", "b") for b in range(8) for _ in range(400)] + [("a", 3, None)]
    df = spark.createDataFrame(rows, "run_id string, batch long, key string")
    seen, want, totals = defaultdict(set), Counter(), Counter()
    for run, b, k in sorted(rows, key=lambda r: r[:2]):
        totals[run, b] += 1
        if k is not None and k not in seen[run]:
            seen[run].add(k)
            want[run, b] += 1
    exact = {(r.run_id, r.batch): (r.total_rows, r.new_rows) for r in novelty.novel(df).collect()}
    assert exact == {x: (n, want[x]) for x, n in totals.items()}
    told = {(r.run_id, r.batch): r.new_rows for r in novelty.novel(df, exact=False).collect()}
    for run, keys in seen.items():
        assert sum(n for (r, _), n in told.items() if r == run) == pytest.approx(len(keys), rel=4 * 0.83 / 2 ** (novelty.LG_K / 2))
    parts = novelty.sketches(df).groupBy("run_id").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))
    assert {r.run_id: r.n for r in parts.collect()} == pytest.approx({r: len(k) for r, k in seen.items()}, rel=0.06)


def test_a_saturated_run_stops(spark):
    rows = [("a", b, f"{b if b < 3 else 0} {k}") for b in range(6) for k in range(10)]
    found = novelty.saturation_stop(spark.createDataFrame(rows, "run_id string, batch long, key string"), 0.2)
    assert sorted((r.batch, r.new_rows, r.saturated) for r in found.collect()) == [(0, 10, False), (1, 10, False), (2, 10, False), (3, 0, True)]


def test_columns_are_added_and_renamed_under_old_files(spark, tmp_path):
    t = evolving.EvolvingTable(spark, f"file://{tmp_path}/e", "t")
    t.add_column("a", LongType())
    t.append(spark.createDataFrame([(1,)], "a long"))
    t.rename_column("a", "b")
    t.add_column("a", StringType())  # a new column under the old name
    t.append(spark.createDataFrame([("x", 2)], "a string, b long"))
    assert sorted((r.b, r.a) for r in t.read().collect()) == [(1, None), (2, "x")] and t.read().columns == ["b", "a"]
    for bad in (lambda: t.rename_column("none", "c"), lambda: t.rename_column("a", "B")):
        with pytest.raises(ValueError):
            bad()
    change = t._change()
    change.put("t", spark.createDataFrame([("y", 3)], "a string, b long"))
    t.add_column("c", LongType())
    with pytest.raises(Conflict):
        change.finish()
    assert t.read().count() == 2
