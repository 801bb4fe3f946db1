"""Pairs of similar names by Jaro-Winkler similarity, in tiers."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How alike names are called, from which similarity on.
TIERS = {"same": 0.95, "likely": 0.85, "possible": 0.70}
#: The weight of a character of the common beginning, its most characters, and from which Jaro similarity on it counts.
PREFIX, PREFIX_CHARS, BOOSTED = 0.1, 4, 0.7


def jaro_winkler(a: str, b: str) -> float:
    """Of two non-empty names, in characters."""
    reach, taken, own = max(0, max(len(a), len(b)) // 2 - 1), [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                own.append(c)
                break
    m = len(own)
    if not m:
        return 0.0
    turned = sum(x != y for x, y in zip(own, (b[j] for j in range(len(b)) if taken[j]), strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - turned) / m) / 3
    if jaro <= BOOSTED:
        return jaro
    start = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y or k == PREFIX_CHARS), min(len(a), len(b), PREFIX_CHARS))
    return jaro + start * PREFIX * (1 - jaro)


def least_jaro(similarity: float) -> float:
    """The Jaro similarity that names of this Jaro-Winkler similarity have at least."""
    boosted = (similarity - PREFIX * PREFIX_CHARS) / (1 - PREFIX * PREFIX_CHARS)
    return min(similarity, max(boosted, BOOSTED)) if similarity > BOOSTED else similarity


def common(a: int, b: int, jaro: float) -> int:
    """Characters that names of these lengths share at least, counted with repeats: J <= (m/a + m/b + 1) / 3."""
    return max(1, math.ceil((3 * jaro - 1) * a * b / (a + b) - 1e-9))


def _keys(jaro: float):
    """A name's characters, numbered by repeat, in one order for all names. Of two names that share m of them, one of
    the first a - m + 1 of the one is among the first b - m + 1 of the other; keys name both lengths."""

    def run(frames):
        for f in frames:
            made = []
            for name in f["name"]:
                seen: Counter = Counter()
                chars = []
                for c in name:
                    seen[c] += 1
                    chars.append((-seen[c], c))
                chars.sort()
                a = len(name)
                for b in range(max(1, math.ceil((3 * jaro - 2) * a - 1e-9)), math.floor(a / (3 * jaro - 2) + 1e-9) + 1):
                    need = common(a, b, jaro)
                    if need <= min(a, b):
                        made += [(name, f"{min(a, b)} {max(a, b)} {-k}{c}", a) for k, c in chars[: a - need + 1]]
            yield pd.DataFrame(made, columns=["name", "key", "size"])

    return run


def _similar(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_winkler(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def similar_names(names: DataFrame, least: float = TIERS["possible"]) -> DataFrame:
    """names (name) -> a, b, similarity, tier of distinct non-empty names at least so similar, a < b; least from 0.7 on.

    Candidates share one of their first characters in a common order, by length (see _keys), then enough characters in
    all; no pair of similar names is lost and no two names are compared for their length alone.
    """
    if least < BOOSTED:
        raise ValueError(f"names less than {BOOSTED} similar have no common character that can be told")
    jaro = least_jaro(least)
    keys = names.where("name <> ''").select("name").distinct().mapInPandas(_keys(jaro), "name string, key string, size int")
    x, y = keys.toDF("a", "key", "n"), keys.toDF("b", "key", "m")
    pairs = x.join(y, "key").where("a < b").select("a", "b").distinct()
    count = lambda s, c: F.length(s) - F.length(F.replace(s, c, F.lit("")))
    letters = F.array_distinct(F.filter(F.split(F.col("a"), ""), lambda c: c != ""))
    shared = F.aggregate(letters, F.lit(0), lambda n, c: n + F.least(count(F.col("a"), c), count(F.col("b"), c)))
    p, q = F.length("a"), F.length("b")
    near = pairs.where(shared * (1 / p + 1 / q) >= 3 * jaro - 1 - 1e-9)
    found = near.withColumn("similarity", F.pandas_udf(_similar, "double")("a", "b")).where(F.col("similarity") >= least)
    tier = F.lit(None).cast("string")
    for name, at in sorted(TIERS.items(), key=lambda x: x[1]):
        tier = F.when(F.col("similarity") >= at, name).otherwise(tier)
    return found.withColumn("tier", tier)
