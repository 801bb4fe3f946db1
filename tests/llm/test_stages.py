"""The corpus pipeline's stages on small documents made for them."""

import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from tablesmith.llm import jaccard, language, url_filter

DOCS = "doc_id long, text string"


def words(name, n):
    return [f"{name}{k}" for k in range(n)]


def near_copies():
    """Documents 1 and 10 with copies of a 5-word Jaccard similarity of 0.80 to 0.83 (4-word: under 0.85), one of 0.79."""
    base, other = words("a", 234), words("b", 200)
    changed = [f"x{k}" if k in (20, 60, 100, 140, 180) else w for k, w in enumerate(base)]
    return [(1, base), (2, changed), (3, base + words("c", 50)), (10, other), (11, other[:164]), (12, other + words("d", 52))]


def likeness(x, y, size):
    x, y = ({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} for w in (x, y))
    return len(x & y) / len(x | y)


def test_near_copies_of_five_words_and_eighty_percent_go(spark):
    made = dict(near_copies())
    for a, b in ((1, 2), (1, 3), (10, 11)):
        assert likeness(made[a], made[b], 5) >= 0.8 and likeness(made[a], made[b], 4) < 0.85
    assert likeness(made[10], made[12], 5) < 0.8
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in made.items()], DOCS)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [1, 10, 12]


def test_all_texts_of_a_document_are_linked(spark):
    texts = [" ".join(words(x, 8)) for x in "abcd"]
    rows = [(1, texts[0]), (3, texts[1]), (4, texts[2]), (5, texts[3]), *[(7, t) for t in texts], (9, "on its own here")]
    found = {(r.doc_id, r.component_id) for r in jaccard.group_similar(spark.createDataFrame(rows, DOCS)).collect()}
    assert found == {(1, 1), (3, 1), (4, 1), (5, 1), (7, 1), (9, 9)}


ODD = DOCS + ", __Row string, `__document` string, `__TEXT` string, lang string, source string, n_chars long, Lang_Pred string, SCORE string"


def odd_docs(spark, texts):
    return spark.createDataFrame([(i, t, "r", "d", "t", "en", "s", 1, "p", "q") for i, t in texts], ODD)


def kept(df):
    return sorted((r.doc_id is not None, r.doc_id or 0, r.text or "", r["__Row"], r["__document"], r["__TEXT"], r["Lang_Pred"], r["SCORE"]) for r in df.collect())


def rest(i, t):
    return (i is not None, i or 0, t or "", "r", "d", "t", "p", "q")


def test_near_copies_of_odd_rows(spark):
    a, b = " ".join(words("a", 40)), " ".join(words("b", 40))
    texts = [(1, a), (2, a), (None, a), (3, None), (3, None), (4, ""), (None, None), (5, b), (5, b), (6, a + " " + b)]
    docs = odd_docs(spark, texts)
    found = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert found.columns == docs.columns
    assert kept(found) == sorted(rest(i, t) for i, t in [(1, a), (3, None), (4, ""), (None, None), (5, b), (6, a + " " + b)])
    assert corpus_pipeline.drop_near_copies(spark, docs.where("false"), "").count() == 0


def test_contaminated_odd_rows(spark, sf):
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first().text
    texts = [(1, "clean words only"), (1, "some text and " + item + " more"), (None, item), (2, None), (2, None), (3, "")]
    docs = odd_docs(spark, texts)
    found = corpus_pipeline.drop_contaminated(spark, docs, sf)
    assert found.columns == docs.columns and kept(found) == sorted(rest(i, t) for i, t in [(1, "clean words only"), (2, None), (2, None), (3, "")])
    assert corpus_pipeline.drop_contaminated(spark, docs.where("false"), sf).count() == 0


def test_languages_of_odd_rows(spark):
    en, de = "the cat sat on the mat and the dog ran off with the hat", "der hund lief mit dem hut der katze weg und die katze schlief"
    texts = [(k, en) for k in range(8)] + [(None, en), (9, None), (10, ""), (11, "12 345"), (12, en), (12, en)]
    docs = odd_docs(spark, texts).unionByName(odd_docs(spark, [(20 + k, de) for k in range(8)]).withColumn("lang", F.lit("de")))
    found = corpus_pipeline.identify_language(spark, docs, "")
    assert found.columns == docs.columns
    assert kept(found) == sorted(rest(i, t) for i, t in [*texts, *[(20 + k, de) for k in range(8)]] if t and t[0] != "1")
    assert corpus_pipeline.identify_language(spark, docs.where("false"), "").count() == 0


def test_packing_of_odd_rows(spark):
    docs = odd_docs(spark, [(1, None), (None, "a b"), (2, "x"), (2, "x")])
    found = corpus_pipeline.pack(spark, docs, "").collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.length) for r in found) == [(False, 0, 3), (True, 1, 1), (True, 2, 2), (True, 2, 2)]
    assert len({(r.sequence_id, r.offset) for r in found}) == 4 and corpus_pipeline.pack(spark, docs.where("false"), "").count() == 0


def test_components_of_the_corpus_at_five_words_and_eighty_percent(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sets = {}
    for r in docs.select("doc_id", "text").collect():
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or "").translate(str.maketrans("\t\n\x0b\x0c\r", " " * 5)).split(" ")
        w = [x for x in w if x]
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    leader = {i: i for i in sets}
    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((leader[i], leader[j]))
                leader = {x: a if y == b else y for x, y in leader.items()}
    found = corpus_pipeline.drop_near_copies(spark, docs, sf)
    assert {r.doc_id for r in found.collect()} == {i for i, c in leader.items() if i == c}


def brute_language(texts, profiles, size):
    """(language, distance) by the definition: places of n-grams in sorted lists, out of place by `size` where absent."""
    found = {}
    for i, t in texts.items():
        own = ranks(t, size)
        if not own:
            found[i] = ("und", None)
            continue
        away = {lang: sum(abs(p[g] - k) if g in p else size for g, k in own.items()) for lang, p in profiles.items()}
        best = min(sorted(away), key=away.get)
        found[i] = (best, 1 - away[best] / (size * len(own)))
    return found


def counts(text):
    made = Counter()
    flat = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())
    for w in f" {flat} ".split():
        padded = f" {w} "
        for n in (1, 2, 3):
            made.update(g for k in range(len(padded) - n + 1) for g in [padded[k : k + n]] if g.strip() and " " not in g[1:-1] and (n > 1 or g != " "))
    return made


def ranks(text, size, made=None):
    made = counts(text) if made is None else made
    code = lambda g: sum(ord(c) << (21 * (len(g) - 1 - k)) for k, c in enumerate(g))
    best = sorted(made, key=lambda g: (-made[g], code(g)))[:size]
    return {g: k for k, g in enumerate(best)}


def test_languages_against_brute_force(spark):
    rng = random.Random(2)
    letters = {"xx": "aaabcde", "yy": "eeedcba", "zz": "cdcdfgh"}
    rows = [(k, lang, " ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(1, 40)))) for k in range(120) for lang in [rng.choice("xx yy zz".split())]]
    docs = spark.createDataFrame([(k, t, lang) for k, lang, t in rows], DOCS + ", lang string")
    learned = defaultdict(Counter)
    for k, lang, t in rows:
        if zlib.crc32(str(k).encode()) % 4 != 2:
            learned[lang].update(counts(t))
    profiles = {lang: ranks(None, language.PROFILE, made) for lang, made in learned.items()}
    want = brute_language({k: t for k, _, t in rows}, profiles, language.PROFILE)
    found = {r.doc_id: (r.lang_pred, r.score) for r in language.rank_order(docs).collect()}
    assert {k: v[0] for k, v in found.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(found[k][1] - want[k][1]) < 1e-12 for k in want)


def test_pages_are_labelled_by_words_of_toxic_documents(spark):
    rng = random.Random(4)
    plain = [f"w{'abcdefgh'[k % 8] * (k // 8 + 1)}" for k in range(40)]
    docs = [(k, " ".join(rng.sample(plain, 12)) + (" Scum, indeed" if k % 5 == 0 else "")) for k in range(200)]
    labels = [(k, int(k % 5 == 0)) for k in range(180)] + [(1, None), (None, 1), (999, 1)]
    d, lab = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")
    assert set(url_filter.toxic_words(d, lab)) == {"scum", "indeed"} and url_filter.toxic_words(d, lab.where("toxic = 0")) == []
    pages = [(k, f"http://h/{k}", f"<p class='scum'>word {'SCUM!' if k % 3 == 0 else 'scummy'}</p>") for k in range(9)] + [(9, None, None)]
    found = url_filter.text_labels(spark.createDataFrame(pages, "page_id long, url string, html string"), d, lab)
    assert [(r.url, r.label) for r in found.orderBy(F.col("url").asc_nulls_last()).collect()] == [(u, "block" if k % 3 == 0 and k < 9 else "allow") for k, u, _ in pages]
    assert url_filter.text_labels(spark.createDataFrame(pages, "page_id long, url string, html string"), d, lab.where("toxic = 0")) is None
