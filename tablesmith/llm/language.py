"""Operator 5: language identification by rank-order profiles (out-of-place distance of n-grams)."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablesmith.llm.common import small_batches

#: Length of a profile, longest n-gram, and labelled documents per language that a profile is fitted on at most.
PROFILE = 300
LONGEST = 3
FIT_DOCUMENTS = 4_000
#: Documents ranked for a language's sample, as a multiple of the sample.
SPARE = 1.25
UNKNOWN = "und"
#: A document's n-grams are taken from so many characters at a time and summed.
CHARACTERS = 250_000
#: N-grams that a task sums before it passes the sums on.
HELD = 500_000
_GAP = re.compile(r"[\W\d_]+")


def grams(text: str | None, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text (as numbers, 21 bits a character) with their counts; words are padded with blanks."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    parts = []
    lowered = f" {_GAP.sub(' ', text.lower()).strip()} "
    if lowered == "  ":
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    for at in range(0, len(lowered), CHARACTERS):
        c = np.frombuffer(lowered[at : at + CHARACTERS + longest - 1].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        own = min(len(c), CHARACTERS)
        gap, code, made = c == 32, np.zeros(len(c), np.int64), []
        inner = np.zeros(len(c), bool)  # a blank stands inside, not at an end
        for n in range(1, longest + 1):
            m = len(c) - n + 1
            if m <= 0:
                break
            if n > 2:
                inner = inner[:m] | gap[n - 2 : n - 2 + m]
            else:
                inner = inner[:m]
            code = (code[:m] << 21) | c[n - 1 :]
            keep = ~inner if n > 1 else ~gap[:m]
            made.append(code[: min(m, own)][keep[: min(m, own)]])
        parts.append(np.unique(np.concatenate(made), return_counts=True))
    if len(parts) == 1:
        return parts[0]
    code, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return code, np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)


def ranked(code: np.ndarray, count: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams, most frequent first; ties by their number."""
    if len(code) > 4 * size:  # the counts that can't be among the first go before the sort
        keep = count >= np.partition(count, len(count) - size)[len(count) - size]
        code, count = code[keep], count[keep]
    return code[np.lexsort((code, -count))][:size]


def fit(docs: DataFrame, size: int = PROFILE, per_language: int = FIT_DOCUMENTS) -> dict[str, list[int]]:
    """Profiles from documents (doc_id, text, lang): per language the n-grams of at most per_language documents.

    The documents of a language are those with the smallest hash of doc_id, so the sample is the same in every run;
    per_language bounds what is fitted, whatever the corpus holds. Rows with a null lang or text don't count.
    """
    small_batches(docs.sparkSession)
    picked = docs.where("lang is not null and text is not null and lang <> 'und'")
    # at most SPARE times the sample reaches the task that ranks a language: hashes are even, so those under this share
    many = picked.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
    share = F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5
    near = picked.select("doc_id", "lang").join(F.broadcast(many), "lang").where(share <= F.lit(SPARE * per_language) / F.col("_n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ids = near.withColumn("_r", rank).where(F.col("_r") <= per_language).select("doc_id", "lang").distinct()
    texts = picked.join(F.broadcast(ids), ["doc_id", "lang"], "left_semi").select("lang", "text")

    def run(batches):
        sums: dict[str, list] = {}

        def flush():
            for lang, parts in sums.items():
                code, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                n = np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code)), pa.array(code), pa.array(n)], names=["lang", "code", "n"])

        held = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                pair = grams(text.as_py())
                sums.setdefault(lang, []).append(pair)
                held += len(pair[0])
                if held > HELD:
                    yield from flush()
                    sums, held = {}, 0
        yield from flush()

    total = texts.mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    best = total.withColumn("r", place).where(F.col("r") <= size).collect()  # `size` rows a language
    profiles: dict[str, list[int]] = {}
    for r in sorted(best, key=lambda r: (r["lang"], r["r"])):
        profiles.setdefault(r["lang"], []).append(r["code"])
    return profiles


class Profiles:
    """Out-of-place distances of a document's profile to every language's."""

    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE):
        self.langs, self.size = sorted(profiles), size
        self.codes = np.unique(np.array([c for p in profiles.values() for c in p] or [-1], np.int64))
        self.rank = np.full((len(self.langs), len(self.codes)), size, np.int64)  # absent: out of place by the most
        for k, lang in enumerate(self.langs):
            self.rank[k, np.searchsorted(self.codes, profiles[lang])] = np.arange(len(profiles[lang]))
        self.absent = self.rank == size

    def judge(self, text: str | None) -> tuple[str, float]:
        """(language, score): the nearest profile, ties to the first name; score: 1 less the distance over the largest."""
        own = ranked(*grams(text), self.size)
        if not any(map(str.isalpha, text or "")) or not self.langs:
            return UNKNOWN, 0.0
        spot = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        known = self.codes[spot] == own
        place = np.arange(len(own))
        away = np.where(self.absent[:, spot] | ~known, self.size, np.abs(self.rank[:, spot] - place)).sum(axis=1)
        best = int(away.argmin())
        return self.langs[best], float(1 - away[best] / (self.size * len(own)))


def identify(docs: DataFrame, profiles: dict[str, list[int]], size: int = PROFILE) -> DataFrame:
    """Adds lang_pred and score to documents (text, ...). Null text, or one without a letter: `und` and 0.

    With no profiles every document is `und`. Whole texts are judged; repeated rows each. Columns lang_pred and score
    that docs has are replaced.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    held = docs.sparkSession.sparkContext.broadcast(Profiles(profiles, size))
    names = list(docs.columns)
    at = names.index("text")

    def run(batches):
        for batch in batches:
            judged = [held.value.judge(t.as_py()) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([j[0] for j in judged], pa.string()), pa.array([j[1] for j in judged], pa.float64())], names=[*names, "lang_pred", "score"])

    return docs.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + ", lang_pred string, score double")


def held_out(doc_id) -> F.Column:
    """Whether a document is never learned from: crc32 of its doc_id as text, modulo 4, is 2 (null: false)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def rank_order(docs: DataFrame) -> DataFrame:
    """documents (doc_id, text, lang, ...) -> doc_id, held_out, lang_pred, score, learned from the others only."""
    profiles = fit(docs.where(~held_out("doc_id")).select("doc_id", "text", "lang"))
    found = identify(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
