"""Each operator against a brute-force version, and on nulls, ties, repeated rows, empty tables and clashing columns."""

import base64
import binascii
import functools
import hashlib
import itertools
import math
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablesmith.llm import decontaminate, fingerprints, jaccard, language, licenses, packing, queries, sharding, token_counts, url_filter, warc
from tablesmith.llm.common import components, lookup

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "a"), (5, "a"), (None, "some words that stand here"), (6, "Ünï çödé ß İ ŉ 東京 é 🎉 <|endoftext|> <|ENDOFTEXT|>"), (7, "x" * 70_000), (8, "long text here " * 9_000), (9, "...!!!"), (-3, "some words that stand here")]


def odd(spark, rows=ODD):
    """Odd documents with columns that clash with the operators' own names."""
    return spark.createDataFrame([(i, t, None, "s", -1, "x", -2) for i, t in rows], DOCS + ", shard string, score long")


def rows(df):
    return [tuple(r) for r in df.collect()]


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# packing


def check_packing(found, docs, capacity=4096):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENIZER)
    want = Counter()
    for i, t in docs:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at : at + capacity], "<u4")
            want[(i, k, at, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    by = {}
    for r in found:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= capacity
    return len(by), sum(r.length for r in found)


def test_packing_equals_whole_text_encoding(spark, sf):
    docs = documents(spark, sf)
    bins, total = check_packing(packing.best_fit_packing(docs, TOKENIZER).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert bins <= -(-total // 4096) + 1


def test_packing_odd_rows(spark):
    check_packing(packing.best_fit_packing(odd(spark), TOKENIZER).collect(), ODD)
    assert packing.best_fit_packing(odd(spark, []), TOKENIZER).count() == 0


def plain_best_fit(sizes, capacity):
    bins = []
    for w in sorted(sizes, reverse=True):
        fit = [b for b in bins if b >= w]
        if fit:
            bins.remove(min(fit))
            bins.append(min(fit) - w)
        else:
            bins.append(capacity - w)
    return bins


def least_bins(sizes, capacity):
    best = len(sizes)

    def go(left, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if not left:
            best = len(bins)
            return
        w = left[0]
        for r in {b for b in bins if b >= w}:
            at = bins.index(r)
            go(left[1:], [*bins[:at], r - w, *bins[at + 1 :]])
        go(left[1:], [*bins, capacity - w])

    go(sorted(sizes, reverse=True), [])
    return best


@settings(deadline=None, max_examples=200)
@given(st.lists(st.integers(1, 12), max_size=9))
def test_reduction_keeps_an_optimum_and_best_fit_is_plain_best_fit(sizes):
    counts = Counter(sizes)
    assert sorted(12 - sum(w * k for w, k in p) for p, n in packing.best_fit(dict(counts), 12) for _ in range(n)) == sorted(plain_best_fit(sizes, 12))
    made = packing.reduce_and_fit(dict(counts), 12)
    used = Counter()
    for p, n in made:
        assert sum(w * k for w, k in p) <= 12
        for w, k in p:
            used[w] += k * n
    assert used == counts
    assert sum(n for _, n in made) <= len(plain_best_fit(sizes, 12))
    fixed_only = packing.reduce_and_fit(dict(counts), 12)
    packed_rest = packing.best_fit({}, 12)
    assert not packed_rest and sum(n for _, n in fixed_only) >= least_bins(sizes, 12)


@settings(deadline=None, max_examples=150)
@given(st.lists(st.integers(1, 12), max_size=8))
def test_fixed_sets_belong_to_an_optimum(sizes):
    seen = {}

    def keep(left, capacity):
        seen["rest"] = dict(left)
        return []

    fit, packing.best_fit = packing.best_fit, keep
    try:
        fixed = packing.reduce_and_fit(dict(Counter(sizes)), 12)
    finally:
        packing.best_fit = fit
    rest = [w for w, n in seen["rest"].items() for _ in range(n)]
    assert sum(n for _, n in fixed) + least_bins(rest, 12) == least_bins(sizes, 12)


# decontamination


def brute_hits(text, items, size=10, slop=None):
    w = decontaminate.words(text)
    hit, found = set(), set()
    for name, body in items:
        for p in decontaminate.windows(decontaminate.words(body), size):
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i : i + len(p)]) == p:
                    hit.update(range(i, i + len(p)))
                    found.add(str(name))
    ids = ",".join(sorted(found))
    return len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit), brute_near(w, items, size, slop)


def brute_near(w, items, size, slop):
    """Items of which all words of a phrase stand in some len(phrase) + slop consecutive words."""
    found = set()
    for name, body in items if slop is not None else ():
        for p in decontaminate.windows(decontaminate.words(body), size):
            if any(set(p) <= set(w[i : i + len(p) + slop]) for i in range(len(w))):
                found.add(str(name))
    return ",".join(sorted(found))


ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "short Item"), (10, "short item"), (3, None), (4, " .. "), (5, "a a a a a a a a a a a"), (6, "ÄÖ äö é")]
HIT = [(1, "x ONE two, three four five six seven eight nine ten. ELEVEN twelve y"), (2, "a " * 14), (3, None), (4, "short item short, item"), (5, "one two three four five six seven eight nine"), (5, "ÄÖ äö é ..."), (None, "short item"), (7, "")]


@pytest.mark.parametrize("a_pass", [20_000, 10])
@pytest.mark.parametrize("slop", [None, 0, 3])
def test_decontamination_against_brute_force(spark, a_pass, slop):
    docs, bench = odd(spark, HIT), spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontaminate.decontaminate(docs, bench, words_a_pass=a_pass, slop=slop)
    assert Counter(rows(found)) == Counter((i, *brute_hits(t, ITEMS, slop=slop)) for i, t in HIT)


def test_decontamination_of_shuffled_and_long_texts_against_brute_force(spark):
    rng = random.Random(5)
    items = [(f"i{k}", " ".join(rng.choices("abcdefgh", k=rng.randint(1, 14)))) for k in range(12)]
    docs = [(k, " ".join(rng.choices("abcdefghijk", k=rng.choice([3, 40, 900])))) for k in range(12)] + [(99, "z " * 20_000 + items[0][1])]
    for k, (_, t) in enumerate(items):
        w = t.split()
        rng.shuffle(w)
        docs.append((200 + k, "q r " + " s ".join(w[:2]) + " " + " ".join(w[2:])))
    found = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"), window=5, words_a_pass=30, slop=2)
    assert Counter(rows(found)) == Counter((i, *brute_hits(t, items, 5, 2)) for i, t in docs)


def test_long_items_are_cut_into_overlapping_parts(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "WORDS_A_PART", 7)
    item = " ".join(f"w{k}" for k in range(60))
    docs = [(k, " ".join(f"w{j}" for j in range(k, k + 10))) for k in range(52)]
    found = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("x", item), ("y", "short one")], "item_id string, text string"), words_a_pass=20)
    assert Counter(rows(found)) == Counter((i, *brute_hits(t, [("x", item)])) for i, t in docs)


def test_decontamination_without_items(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert {r.n_hit for r in decontaminate.decontaminate(odd(spark), bench.where("item_id < 0")).collect()} == {0}
    assert decontaminate.decontaminate(odd(spark, []), bench).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red x x green blue"), (2, "blue green red"), (3, "red x x x green blue"), (4, "red green"), (5, "blue")], "doc_id long, text string")
    index = decontaminate.build_index(docs)
    phrases = decontaminate.Phrases([("q", "red green blue")])
    near = lambda slop: sorted(r.doc_id for r in decontaminate.match(index, phrases, slop).collect() if r.near_items == ["q"])
    assert near(2) == [1, 2] and near(3) == [1, 2, 3] and near(None) == []


# WARC


def test_warc_round_trip(spark):
    text = "ä" * 700_000
    given_ = [(1, "http://a/\r\nX: y", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (5, "u", text), (9, "u", text), (-7, "u", "neg"), (2, "u", "same"), (None, "u", "same"), (2**62 + 5, "u", "big")]
    pages = spark.createDataFrame([(*r, "x") for r in given_], "page_id long, url string, html string, record_type string")
    first = {}
    for i, _, h in given_:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = Counter()
    for i, _, h in given_:
        b = (h or "").encode()
        f = first[h or ""]
        want[(i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if i == f else "revisit", None if i == f else f)] += 1
    assert Counter(rows(warc.round_trip(pages))) == want
    chunks = warc.read_archives(warc.archive(pages, chunk_bytes=1000), chunk_bytes=4096).where("page_id = 5").orderBy("chunk_no").collect()
    assert b"".join(r.data for r in chunks).decode() == text and max(len(r.data) for r in chunks) == 4096 and [r.chunk_no for r in chunks] == list(range(len(chunks)))
    half = b"".join(r.data for r in chunks[:100])
    assert chunks[99].bytes_so_far == len(half) and chunks[99].digest_so_far == base64.b32encode(hashlib.sha1(half).digest()).decode()
    assert {r.record_type for r in warc.round_trip(pages, least_bytes=5).where("payload_bytes < 5").collect()} == {"response"}
    assert warc.round_trip(pages.where("false")).count() == 0


def test_record_ids_are_unique(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", t) for i, t in [(1, "a"), (1, "a"), (1, "b"), (None, "c"), (None, "c"), (2, "a"), (-5, "d")]], "page_id long, url string, html string")
    chunks = warc.read_archives(warc.archive(pages), chunk_bytes=1).collect()
    assert len({(r.record_id, r.chunk_no) for r in chunks}) == len(chunks) and len({r.record_id for r in chunks}) == 7
    found = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect())
    assert found == Counter({(1, 1, "response", None): 3, (None, 1, "response", None): 2, (2, 1, "revisit", 1): 1, (-5, 1, "response", None): 1})


def test_damaged_archive_is_noticed(spark):
    manifest = warc.archive(spark.createDataFrame([(1, "u", "payload")], "page_id long, url string, html string"))
    path = manifest.first().path.removeprefix("file://")
    import gzip

    data = gzip.decompress(open(path, "rb").read()).replace(b"payload\r\n\r\n", b"pAyload\r\n\r\n")
    with open(path, "wb") as f:
        f.write(gzip.compress(data))
    with pytest.raises(Exception, match="not what its header says"):
        warc.read_archives(manifest).collect()


# sharding


def test_sharding_is_exact_and_whole(spark, sf):
    docs = documents(spark, sf).select("doc_id", "text")
    found = sharding.digests(sharding.shuffle_shards(docs)).collect()
    want = Counter((r.doc_id, len(r.text.encode()) + 1, zlib.crc32(r.text.encode())) for r in docs.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in found) == want
    by = {}
    for r in found:
        by.setdefault(r.shard, []).append(r.slot)
    assert set(by) == set(range(8)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    again = sharding.digests(sharding.shuffle_shards(docs)).collect()
    place = lambda rs: {r.doc_id: (r.shard, r.slot) for r in rs}
    assert place(again) == place(found) != place(sharding.shuffle_shards(docs, seed=7).collect())


@pytest.mark.parametrize("blocks", [1, 3])
def test_sharding_is_uniform(spark, blocks):
    """Over many seeds each of 12 rows (in 3 partitions) is in each of the 12 places about equally often."""
    docs = spark.range(0, 12, 1, 3).withColumnRenamed("id", "doc_id").withColumn("text", F.lit("t"))
    seen, runs = np.zeros((12, 12)), 60
    for seed in range(runs):
        for r in sharding.shuffle_shards(docs, shards=4, seed=seed, blocks=blocks).collect():
            seen[r.doc_id, 3 * r.shard + r.slot] += 1
    assert seen.sum(axis=0).tolist() == [runs] * 12
    chi = ((seen - runs / 12) ** 2 / (runs / 12)).sum()
    assert chi < 121 + 4 * (2 * 121) ** 0.5


def test_sharding_odd_rows(spark):
    found = sharding.shuffle_shards(odd(spark), shards=5)
    assert Counter((r.doc_id, r.text) for r in found.collect()) == Counter(ODD)
    assert sharding.shuffle_shards(odd(spark, [])).count() == 0
    clash = odd(spark).withColumnsRenamed({"shard": "Shard", "score": "SLOT", "n_chars": "_KEY", "source": "_Block"})
    found = sharding.shuffle_shards(clash, shards=2)
    assert found.columns[-2:] == ["shard", "slot"] and Counter((r.doc_id, r.text) for r in found.collect()) == Counter(ODD)


@settings(deadline=None, max_examples=50)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=9), st.integers(1, 6), st.integers(0, 1000))
def test_matrix_has_its_margins(counts, shards, seed):
    sizes = sharding.shard_sizes(sum(counts), 2 * shards)
    made = np.array([sharding.matrix_row(i, np.array(counts), sizes, seed) for i in range(len(counts))])
    assert (made >= 0).all() and made.sum(axis=1).tolist() == counts and made.sum(axis=0).tolist() == sizes.tolist()


def test_draws_are_hypergeometric():
    rng = np.random.default_rng(1)
    own = np.array([sharding._large(rng, 40, 60, 30) for _ in range(20_000)])
    ref = np.random.default_rng(2).hypergeometric(40, 60, 30, 20_000)
    assert abs(own.mean() - ref.mean()) < 0.1 and abs(own.var() - ref.var()) < 0.3
    old, sharding.POPULATION = sharding.POPULATION, 10
    try:
        assert sharding.draw(rng, np.array([0, 7, 20, 3]), 11).sum() == 11
    finally:
        sharding.POPULATION = old


@pytest.mark.parametrize(("good", "bad", "sample"), [(40, 60, 30), (1, 9, 3), (700, 300, 990), (12, 5_000, 4_000)])
def test_probabilities_are_exact(good, bad, sample):
    for k in range(max(0, sample - bad), min(good, sample) + 1):
        exact = Fraction(math.comb(good, k) * math.comb(bad, sample - k), math.comb(good + bad, sample))
        own = sharding.log_probability(k, good, bad, sample)
        assert abs(own - (math.log(exact.numerator) - math.log(exact.denominator))) < 1e-9


@pytest.mark.parametrize(("good", "bad", "sample"), [(10**12, 7 * 10**12, 3 * 10**12), (10**13, 10**13, 10**6), (3 * 10**9, 10, 10**9)])
def test_large_draws(good, bad, sample):
    """Mean and spread at populations beyond numpy's, within five standard errors; margins kept."""
    rng, n, runs = np.random.default_rng(3), good + bad, 300
    own = [sharding._large(rng, good, bad, sample) for _ in range(runs)]
    assert all(max(0, sample - bad) <= k <= min(good, sample) for k in own)
    mean, spread = sample * (good / n), math.sqrt(sample * (good / n) * (bad / n) * ((n - sample) / (n - 1)))
    z = [(k - mean) / spread for k in own]
    assert abs(np.mean(z)) < 5 / math.sqrt(runs)
    assert abs(np.var(z) - 1) < 5 * math.sqrt(2 / runs)


# language


def brute_grams(text):
    found = Counter()
    for w in language._GAP.sub(" ", text.lower()).split():
        for n in (1, 2, 3):
            p = w if n == 1 else f" {w} "
            found.update(p[i : i + n] for i in range(len(p) - n + 1))
    return found


@settings(deadline=None, max_examples=100)
@given(st.text(alphabet="abcäß é.1\n", max_size=60))
def test_grams_against_brute_force(text):
    number = lambda g: sum(ord(c) << 21 * k for k, c in enumerate(reversed(g)))
    assert dict(zip(*(x.tolist() for x in language.grams(text)), strict=True)) == {number(g): n for g, n in brute_grams(text).items()}


def test_grams_of_long_texts_are_summed(monkeypatch):
    text = "some words of ä text " * 50
    whole = language.grams(text)
    monkeypatch.setattr(language, "CHARACTERS", 7)
    assert all((a == b).all() for a, b in zip(language.grams(text), whole, strict=True))


def test_distance_against_brute_force():
    profiles = {"x": [10, 11, 12, 13], "y": [13, 12, 99]}
    judge = language.Profiles(profiles, 4)
    own = [12, 10, 7]
    d = {k: sum(abs(p.index(g) - i) if g in p else 4 for i, g in enumerate(own)) for k, p in profiles.items()}
    spot = [int(np.searchsorted(judge.codes, g)) for g in own]
    assert d == {"x": 2 + 1 + 4, "y": 1 + 4 + 4} and spot


def test_language_held_out_accuracy(spark, sf):
    sf = sf.replace("0.001", "0.01")
    found = language.rank_order(documents(spark, sf)).join(documents(spark, sf).select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in found if binascii.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.95 and all(0 <= r.score <= 1 for r in found)


def test_language_without_letters():
    judge = language.Profiles({"en": [1, 2]}, 4).judge
    assert [judge(t)[0] for t in (None, "", "12 _ ²½", "é", "x²")] == ["und", "und", "und", "en", "en"]


def test_language_sample_is_the_smallest_hashes(spark, sf, monkeypatch):
    docs = documents(spark, sf).select("doc_id", "text", "lang")
    monkeypatch.setattr(language, "SPARE", 1e9)
    every = language.fit(docs, per_language=20)
    monkeypatch.setattr(language, "SPARE", 4)
    assert language.fit(docs, per_language=20) == every


def test_language_odd_rows(spark):
    profiles = {"en": [ord("a"), ord("x")]}
    found = rows(language.identify(odd(spark), profiles).select("doc_id", "text", "lang_pred", "score"))
    assert Counter(r[:2] for r in found) == Counter(ODD)
    assert {r[2:] for r in found if not any(c.isalpha() for c in r[1] or "")} == {("und", 0.0)}
    assert {r[2] for r in rows(language.identify(odd(spark), {}).select("doc_id", "text", "lang_pred"))} == {"und"}
    assert language.fit(odd(spark)) == {} and language.rank_order(odd(spark, [])).count() == 0


# Jaccard


def brute_components(docs, percent=85):
    sets, owner = [], {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets.append((i, frozenset(tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))) if w else frozenset()))
        owner[i] = i

    def top(i):
        while owner[i] != i:
            i = owner[i]
        return i

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and a is not None and b is not None and 100 * len(x & y) >= percent * len(x | y):
            a, b = sorted((top(a), top(b)))
            owner[b] = a
    return Counter((i, len(s), None if i is None else top(i)) for i, s in sets)


def near_copies(rng, n):
    words = [f"w{k}" for k in range(300)]
    out, base = [], []
    for i in range(n):
        if not base or rng.random() < 0.15:
            base = [rng.choice(words) for _ in range(rng.choice([3, 5, 30, 80, 150]))]
        w = list(base)
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            k = rng.randrange(len(w))
            w[k : k + rng.choice([0, 1, 1, 2])] = [rng.choice(words)] * rng.choice([0, 1, 1])
            w = w or ["z"]
        if rng.random() < 0.2:
            base = w
        if rng.random() < 0.3:
            w = w + [f"c{k}" for k in range(12)]
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard, "MEMBERS", 5)
    docs = near_copies(random.Random(seed), 350)
    found = jaccard.group_similar(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    assert Counter(rows(found)) == brute_components(docs)


def test_jaccard_real_documents(spark, sf):
    docs = documents(spark, sf.replace("0.001", "0.01"))
    assert Counter(rows(jaccard.group_similar(docs))) == brute_components([(r.doc_id, r.text) for r in docs.collect()])


def test_jaccard_odd_rows(spark):
    assert Counter(rows(jaccard.group_similar(odd(spark)))) == brute_components(ODD)
    assert jaccard.group_similar(odd(spark, [])).count() == 0
    shared_id = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "u v w x y z"), (3, "u v w x y z")]
    assert {r.component_id for r in jaccard.group_similar(odd(spark, shared_id)).collect()} == {1}


@settings(deadline=None, max_examples=300)
@given(st.integers(1, 400), st.integers(1, 400))
def test_prefix_bounds_lose_no_pair(n, m):
    n, m = max(n, m), min(n, m)
    if 100 * m >= 85 * n:
        need = jaccard.least_overlap(n, m)
        assert 100 * need >= 85 * (n + m - need) and (need == 0 or 100 * (need - 1) < 85 * (n + m - need + 1))
        assert need >= m - jaccard.index_length(m) + 1 or need > m
        assert need >= n - jaccard.probe_length(n) + 1


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)]
    owner = {}

    def top(i):
        while owner.setdefault(i, i) != i:
            i = owner[i]
        return i

    for a, b in links:
        if a != b:
            a, b = sorted((top(a), top(b)))
            owner[b] = a
    found = dict(rows(components(spark.createDataFrame(links, "a long, b long"))))
    assert found == {i: top(i) for i in owner}


def test_lookup_spreads_and_joins(spark):
    left = spark.createDataFrame([(k, "hot" if k % 3 else None) for k in range(50)] + [(99, "cold"), (98, "none")], "i long, k string")
    right = spark.createDataFrame([("hot", 33, 1), ("cold", 1, 2)], "k string, n long, v long")
    assert Counter(rows(lookup(left, right, "k", "n", F.col("i")))) == Counter((i, k, {"hot": 1, "cold": 2}.get(k)) for i, k in rows(left))


# URL filters


URLS = [
    (1, "http://a.NET/x", "a.net", "/x", "net/", "block"), (2, "https://example.net/en/1?q#f", "example.net", "/en/1", "example.net/en/", "allow"),
    (3, "http://www.example.com/de/", "www.example.com", "/de/", "example.com/de/", "block"), (4, "http://notexample.com/de/", "notexample.com", "/de/", None, None),
    (5, "http://x.org/fr/a", "x.org", "/fr/a", "org/fr/", "allow"), (6, None, "", "", None, None), (7, "no scheme.net/", "", "", None, None), (8, "http://net", "net", "", None, None),
    (9, "http://h?x/y", "h", "", None, None), (10, "a://b://c.net/", "b:", "//c.net/", None, None), (10, "http://Ä.net/\nx", "Ä.net", "/\nx", "net/", "block"), (None, "://X.net/#", "x.net", "/", "net/", "block"),
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(r[0], r[1], "h", "r", "x", ["y"]) for r in URLS], "page_id long, url string, html string, rule string, verdict string, tokens array<string>")
    found = url_filter.filter_urls(pages.unionByName(pages))
    by = {(r.page_id, r.host): r for r in found.collect()}
    for i, _, h, p, rule, verdict in URLS:
        assert (by[(i, h)].path, by[(i, h)].rule, by[(i, h)].verdict) == (p, rule, verdict or "allow")
    assert found.count() == 2 * len(URLS) and url_filter.filter_urls(pages.where("false")).count() == 0
    deep = spark.createDataFrame([(1, "http://a.example.org/" + "x/" * 30_000 + "?k=1")], "page_id long, url string")
    assert url_filter.filter_urls(deep).first().verdict == "allow"


def test_verdicts_come_from_planted_labels(spark):
    """Pages without a list rule are judged by rules mined from labels that are not the list's; against brute force."""
    rng = random.Random(3)
    urls = [(k, f"http://{rng.choice(['spam', 'shop', 'blog', 'm'])}.{rng.choice(['alpha', 'beta', 'gamma'])}.example.{rng.choice(['org', 'com'])}/{rng.choice(['en', 'es', 'casino'])}/{k}{rng.choice(['', '?ref=x', '?utm=1&aff=2'])}") for k in range(600)]
    bad = lambda u: "/casino/" in u or "aff=" in u and "/en/" in u
    told = [(k, int(bad(u) and rng.random() < 0.9 or rng.random() < 0.03)) for k, u in urls if k % 2]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    labels = url_filter.labels_of(pages, spark.createDataFrame(told, "doc_id long, toxic int"))
    found = {r.page_id: r for r in url_filter.filter_urls(pages, labels, support=0.02).collect()}
    made = [(r.tokens, r.label) for r in url_filter.with_tokens(labels).select("tokens", "label").collect()]
    share = Counter(label for _, label in made)
    want = [r for r in brute_rules(made, max(0.02, 10 / len(made)), 0.5, False) if 1 - share[r.verdict] / len(made) >= 1.5 * (1 - r.confidence)]
    want = url_filter.prune([r._replace(lift=r.confidence / (share[r.verdict] / len(made))) for r in want])
    own = {r.page_id: set(r.tokens) for r in url_filter.with_tokens(pages).collect()}
    for k, u in urls:
        if found[k].rule is None:
            fits = [r for r in want if set(r.tokens) <= own[k]]
            assert found[k].verdict == (min(fits, key=url_filter.Rule.order).verdict if fits else "allow"), u
    free = [found[k] for k, u in urls if found[k].rule is None and bad(u)]
    assert free and all(r.verdict == "block" and r.mined for r in free)
    assert {r.verdict for r in url_filter.filter_urls(pages).where("rule is null").collect()} == {"allow"}


def test_url_query_is_the_list_then_the_mined_rules(spark, sf):
    found = queries.op1_url_filter(spark, sf).collect()
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert len(found) == len(pages)
    for r in found:
        rest = pages[r.page_id].partition("://")[2]
        h = "".join(itertools.takewhile(lambda c: c not in "/?#", rest))
        p = "".join(itertools.takewhile(lambda c: c not in "?#", rest[len(h) :]))
        fits = [(len(x), v, x) for v, x in url_filter.RULES for d, _, q in (x.partition("/"),) if ("." + h.lower()).endswith("." + d) and p.startswith("/" + q)]
        best = max(fits, default=None)
        assert (r.host, r.path, r.rule) == (h.lower(), p, best and best[2])
        assert r.verdict == (best[1] if best else r.mined and ("block" if r.verdict == "block" else "allow") or "allow")


def brute_rules(rows_, support, confidence, pruned=True):
    n = len(rows_)
    sets = {frozenset(c) for t, _ in rows_ for k in (1, 2, 3) for c in itertools.combinations(sorted(t), k)}
    out = []
    for s in sets:
        have = [label for t, label in rows_ if s <= set(t)]
        for label in ("allow", "block"):
            both = have.count(label)
            if both >= support * n and both / len(have) >= confidence:
                out.append(url_filter.Rule(tuple(sorted(s)), label, both / len(have), both / n))
    return url_filter.prune(out) if pruned else out


def test_mined_rules_against_brute_force(spark):
    rng = random.Random(5)
    made = []
    for _ in range(120):
        t = rng.sample("abcdef", rng.randrange(1, 5))
        made.append((t, "block" if {"a", "b"} <= set(t) or "f" in t and rng.random() < 0.9 else "allow"))
    found = url_filter.mine(spark.createDataFrame(made, "tokens array<string>, label string"), 0.05, 0.8)
    want = brute_rules(made, 0.05, 0.8)
    key = lambda r: (r.tokens, r.verdict, round(r.confidence, 9))
    assert {key(r) for r in found} == {key(r) for r in want} and found
    index = url_filter.Index(found)
    for t, _ in made:
        fits = [r for r in found if set(r.tokens) <= set(t)]
        assert index.best(t) == (min(fits, key=url_filter.Rule.order) if fits else None)


# licenses


def test_license_scan(spark):
    mit = licenses.LICENSES["MIT"]
    varied = "  Copyright (c) 2020 Some One. All rights reserved.\n\n" + mit.lower().replace("noninfringement", "NON-INFRINGEMENT").replace(",", " ,\n").replace("mit license", "MIT Licence")
    docs = [(1, mit), (2, varied), (3, mit + " more"), (4, None), (5, ""), (6, "Copyright 2020\n(c) x"), (7, licenses.LICENSES["0BSD"]), (7, licenses.LICENSES["ISC"])]
    found = {(r.doc_id, r.license_id) for r in licenses.scan(odd(spark, docs), licenses.known_licenses(spark)).collect()}
    assert found == {(1, "MIT"), (2, "MIT"), (3, None), (4, None), (5, None), (6, None), (7, "0BSD"), (7, "ISC")}
    assert licenses.scan(odd(spark, []), licenses.known_licenses(spark)).count() == 0


def test_licenses_of_a_folder(spark, tmp_path):
    body = " ".join(f"clause{k} applies" for k in range(400))
    (tmp_path / "X-1.0.txt").write_text("Copyright 1999 Someone\n" + body)
    (tmp_path / "Zlib.txt").write_text(licenses.LICENSES["Zlib"])
    known = licenses.read_licenses(spark, f"file://{tmp_path}")
    found = {(r.doc_id, r.license_id) for r in licenses.scan(odd(spark, [(1, body.upper()), (2, body + " x"), (3, licenses.LICENSES["Zlib"])]), known).collect()}
    assert found == {(1, "X-1.0"), (2, None), (3, "Zlib")}


def test_license_query_finds_planted_texts(spark, tmp_path):
    docs = [(k, t) for k, t in enumerate(licenses.LICENSES.values())] + [(100, "none of these")]
    odd(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r.license_id for r in queries.op4_license_scan(spark, str(tmp_path)).collect()}
    assert found == {**dict(enumerate(licenses.LICENSES)), 100: None}


def test_license_scan_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(licenses, "BROADCAST_LICENSES", 1)
    docs = [(k, licenses.LICENSES["MIT"]) for k in range(9)] + [(20, "x"), (21, None), (22, licenses.LICENSES["Zlib"])]
    found = Counter(r.license_id for r in licenses.scan(odd(spark, docs), licenses.known_licenses(spark)).collect())
    assert found == {"MIT": 9, None: 2, "Zlib": 1}


# token counts


def brute_tokens(word, scores, least=None, longest=99):
    unknown, best = (min(scores.values()) if least is None else least) - 10, [(0.0, 0)]
    for end in range(1, len(word) + 1):
        options = []
        for start in range(max(0, end - longest), end):
            s = scores.get(word[start:end], unknown if end - start == 1 else None)
            if s is not None:
                options.append((best[start][0] + s, end - start, best[start][1] + 1))
        top = max(options, key=lambda o: (o[0], o[1]))
        best.append((top[0], top[2]))
    return best[-1][1]


SCORES = {"▁": -2.0, "a": -3.0, "b": -3.0, "ab": -4.5, "▁a": -3.5, "abc": -5.0, "ba": -6.0, "aab": -7.0}


@settings(deadline=None, max_examples=200)
@given(st.lists(st.text(alphabet="abcé", min_size=1, max_size=9), max_size=8))
def test_trie_against_brute_force(words):
    trie = token_counts.Trie(SCORES)
    assert [trie.count("▁" + w) for w in words] == [brute_tokens("▁" + w, SCORES) for w in words]


def brute_scores(texts):
    """Scores of pieces by counting the library's pieces of every word by itself."""
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    counts = Counter(i for t in texts for w in (t or "").split() for i in sp.encode(w))
    total = sum(counts[i] for i in plain) + len(plain)
    return {sp.id_to_piece(i): math.log((counts[i] + 1) / total) for i in plain}


def test_token_counts_real(spark, sf, monkeypatch):
    monkeypatch.setattr(token_counts, "NODES", 5_000)
    monkeypatch.setattr(token_counts, "WORDS", 50)
    found = queries.op9_token_counts(spark, sf).collect()
    texts = dict(rows(documents(spark, sf).select("doc_id", "text")))
    scores = brute_scores(texts.values())
    fitted = token_counts.fit(documents(spark, sf), public_tokenizers.path("piece_bpe_32k.model"))
    assert fitted.keys() == scores.keys() and all(abs(fitted[p] - s) < 1e-9 for p, s in scores.items())
    assert abs(sum(map(math.exp, fitted.values())) - 1) < 1e-9
    trie, least, longest = {}, min(fitted.values()), max(map(len, fitted))
    for r in found[:40]:
        for w in (texts[r.doc_id] or "").split():
            if w not in trie:
                trie[w] = brute_tokens("▁" + w, fitted, least, longest)
        assert r.n_tokens == sum(trie[w] for w in (texts[r.doc_id] or "").split())
    assert len(found) == len(texts)


def test_token_scores_odd_rows(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    scores = brute_scores([t for _, t in ODD])
    fitted = token_counts.fit(odd(spark), path)
    assert all(abs(fitted[p] - s) < 1e-9 for p, s in scores.items())
    assert len(set(token_counts.fit(odd(spark, ODD[:0]), path).values())) == 1


def test_token_counts_odd_rows(spark):
    found = token_counts.count_tokens(odd(spark), SCORES).select("doc_id", "text", "n_pre_tokens").collect()
    assert Counter((r.doc_id, r.text) for r in found) == Counter(ODD)
    assert all(r.n_pre_tokens == len((r.text or "").split()) for r in found)


# fingerprints


def check_edits(found, docs):
    order = sorted(docs, key=lambda r: -r[0])
    want = {}
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 3
        want[i] = (len(t), hashlib.sha256((t[: len(t) - cut] + after[:cut]).encode()).hexdigest())
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in found} == want and len(found) == len(docs)


def test_fingerprints_edits(spark, sf):
    docs = documents(spark, sf)
    texts = rows(docs.select("doc_id", "text"))
    found = fingerprints.compare_with_edits(docs).collect()
    check_edits(found, texts)
    assert np.mean([r.near_edited for r in found]) > np.mean([r.near_next for r in found]) + 0.2
    by = {}
    texts = dict(texts)
    for r in found:
        by.setdefault(texts[r.doc_id], set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in by.values())


def test_fingerprints_odd_rows(spark):
    docs = [r for r in dict(ODD).items() if r[0] is not None]
    check_edits(fingerprints.compare_with_edits(odd(spark, docs)).collect(), docs)
    assert fingerprints.compare_with_edits(odd(spark)).count() == len(ODD)
    assert fingerprints.compare_with_edits(odd(spark, [])).count() == 0
    check_edits(fingerprints.compare_with_edits(odd(spark, [(4, "abcdef")])).collect(), [(4, "abcdef")])
    one = fingerprints.fingerprint(odd(spark)).collect()
    assert len(one) == len({(i, t or "") for i, t in ODD})


def test_collision_rate_is_generalised_jaccard(spark):
    a, b = "x x x x y y z " * 5 + "p q", "x x y y y z w " * 5 + "p r s"
    x, y = Counter(a.split()), Counter(b.split())
    want = sum((x & y).values()) / sum((x | y).values())
    docs = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    n = 1500
    one, two = (r.fingerprint for r in fingerprints.fingerprint(docs, n).orderBy("doc_id").collect())
    assert len(one) == n * fingerprints.DIGITS
    rate = sum(one[k : k + 4] == two[k : k + 4] for k in range(0, 4 * n, 4)) / n
    assert abs(rate - want) < 0.05


def term_weights(text):
    return Counter(text.lower().split() or [""])


def test_likenesses_against_the_exact_similarity_of_each_document(spark, sf):
    """With the production number of samples: few errors beyond two standard errors, and no bias."""
    texts = {r.doc_id: r.text or "" for r in documents(spark, sf).collect()}
    found = {r.doc_id: r for r in fingerprints.compare_with_edits(documents(spark, sf)).collect()}
    order = sorted(texts, reverse=True)
    off = []
    for k, i in enumerate(order):
        t, after = texts[i], texts[order[(k + 1) % len(order)]]
        cut = len(t) // 3
        for other, got in ((t[: len(t) - cut] + after[:cut], found[i].near_edited), (after, found[i].near_next)):
            x, y = term_weights(t), term_weights(other)
            want = sum((x & y).values()) / sum((x | y).values())
            off.append((got - want) / max(0.5 / fingerprints.SAMPLES, (want * (1 - want) / fingerprints.SAMPLES) ** 0.5))
    assert abs(np.mean(off)) < 0.3 and np.mean(np.abs(off) > 2) < 0.1 and max(map(abs, off)) < 6


# pipeline


def test_pipeline_keeps_what_it_should(spark, sf):
    import corpus_pipeline

    docs = documents(spark, sf)
    texts = {r.doc_id: r.text for r in docs.collect()}
    items = rows(spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text"))
    stages = dict(corpus_pipeline.STAGES)
    first = stages["language_id"](spark, docs, sf)
    assert first.columns == docs.columns
    kept = {r.doc_id for r in first.collect()}
    assert not any(any(c.isalpha() for c in texts[i]) for i in texts.keys() - kept)
    second = stages["ngram_jaccard_join"](spark, first, sf)
    groups = brute_components([(i, texts[i]) for i in sorted(kept)])
    assert {r.doc_id for r in second.collect()} == {i for i, _, c in groups if i == c}
    third = stages["benchmark_decontamination"](spark, second, sf)
    want = {i for i, _, c in groups if i == c and not brute_hits(texts[i], items)[4]}
    assert {r.doc_id for r in third.collect()} == want
    check_packing(corpus_pipeline.run(spark, sf).collect(), [(i, texts[i]) for i in want])
    assert stages["language_id"](spark, odd(spark, []), sf).count() == 0


@functools.cache
def encoder():
    return packing.Encoder(TOKENIZER)


@settings(deadline=None, max_examples=300)
@given(st.text(alphabet="aB1.,'<|>é́ \u0085 \n\x0bİſ中…-", max_size=40))
def test_encoder_equals_whole_text(text):
    own = encoder()
    tok = own.tokenizer
    for t in (text, text + " <|startoftext|> x. <|ENDOFTEXT|>, a<|endoftext|>."):
        assert np.frombuffer(next(iter(own([t]))), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids
