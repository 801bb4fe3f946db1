"""Operator 1: URL filters: host and path rules, and association rules mined from labelled URLs by FP-growth."""

from __future__ import annotations

from typing import NamedTuple

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.common import partitions

#: Fixed list: (verdict, rule).
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: Tokens of a rule. Rules hold for at least SUPPORT of the labelled URLs and LEAST_ROWS of them, with at least this
#: CONFIDENCE, and are wrong CONVICTION times as seldom as their verdict is at large, so that rules for a rare verdict can
#: arise and rules for a common one must better the base rate. Tokens below that support are in no rule and no itemset.
RULE_TOKENS, SUPPORT, LEAST_ROWS, CONFIDENCE, CONVICTION = 3, 0.002, 10, 0.5, 1.5


#: Labelled documents that toxic words are told from at most, and words that are kept at most, those in most documents
#: first. A word is toxic if this share of its documents are, with one clean document added to them.
FIT_LABELS, TOXIC_WORDS, WORD_SHARE = 200_000, 1_000, 0.9


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A to Z lower-cased; empty for null or without ://."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """From the host's end up to ?, # or the end; empty for null or without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def with_rule(rows: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Adds rule and rule_verdict to rows (host, path): the longest rule whose host is the row's or a parent domain of
    it and whose path the row's starts with; block before allow among equally long ones; null where none fits."""
    made = [F.struct(F.lit(len(r)).alias("size"), F.lit(v).alias("verdict"), F.lit(r).alias("rule"), F.lit("." + r.partition("/")[0]).alias("end"), F.lit("/" + r.partition("/")[2] if "/" in r else "").alias("start")) for v, r in rules]
    if not made:
        return rows.withColumns({"rule": F.lit(None).cast("string"), "rule_verdict": F.lit(None).cast("string")})
    dotted = F.concat(F.lit("."), F.col("host"))
    best = F.array_max(F.transform(F.filter(F.array(*made), lambda r: dotted.endswith(r["end"]) & F.col("path").startswith(r["start"])), lambda r: F.struct(r["size"].alias("size"), r["verdict"].alias("verdict"), r["rule"].alias("rule"))))
    return rows.withColumn("_r", best).withColumns({"rule": F.col("_r.rule"), "rule_verdict": F.col("_r.verdict")}).drop("_r")


def tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens of a URL: the host and its parent domains, path segments by place (digits as #), query keys."""
    labels = F.split(host, r"\.")
    size = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), size), lambda k: F.concat(F.lit("h:"), F.array_join(F.slice(labels, size - k + 1, k), ".")))
    parts = F.filter(F.split(F.regexp_replace(path, "[0-9]+", "#"), "/"), lambda x: x != "")
    segments = F.transform(parts, lambda x, i: F.concat(F.lit("p"), i.cast("string"), F.lit(":"), x))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    return F.array_distinct(F.concat(F.when(host == "", F.array().cast("array<string>")).otherwise(domains), segments, keys))


class Rule(NamedTuple):
    tokens: tuple[str, ...]
    verdict: str
    confidence: float
    support: float
    lift: float = 1.0

    def order(self) -> tuple:
        """The best rule first: lift (confidence over the verdict's share), confidence, support, more tokens, block,
        then the tokens themselves."""
        return (-self.lift, -self.confidence, -self.support, -len(self.tokens), self.verdict != "block", self.tokens)


def prune(rules: list[Rule]) -> list[Rule]:
    """Without rules that a rule of fewer of their tokens makes needless (same verdict, no less confidence)."""
    best: dict[tuple[str, frozenset], float] = {(r.verdict, frozenset(r.tokens)): r.confidence for r in rules}

    def needless(r: Rule) -> bool:
        own = frozenset(r.tokens)
        parts = [own - {a} for a in own] + [frozenset({a}) for a in own]
        return any(p and p != own and best.get((r.verdict, p), -1.0) >= r.confidence for p in parts)

    return sorted((r for r in rules if not needless(r)), key=Rule.order)


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, conviction: float = 0.0, least_rows: int = 1) -> list[Rule]:
    """Rules from rows (tokens array, label block or allow) by Spark's FP-growth; none from no rows.

    Rows are transactions of all their tokens and the label. Kept are rules of up to RULE_TOKENS tokens with at least
    this support, confidence and conviction ((1 - the label's share) / (1 - confidence)) that no shorter rule makes
    needless. What reaches the driver is bounded by the support, whatever the number of rows.
    """
    made = labelled.select(F.concat(F.array(F.concat(F.lit("="), "label")), "tokens").alias("items"))
    share = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    total = sum(share.values())
    if not total:
        return []
    least = min(1.0, max(support, least_rows / total))
    model = FPGrowth(itemsCol="items", minSupport=least, minConfidence=confidence, numPartitions=partitions(labelled.sparkSession)).fit(made)
    found = model.associationRules.where(F.col("consequent")[0].startswith("=") & (F.size("antecedent") <= RULE_TOKENS) & ~F.exists("antecedent", lambda t: t.startswith("=")))
    rules = [Rule(tuple(sorted(r["antecedent"])), r["consequent"][0][1:], r["confidence"], r["support"], r["confidence"] / (share[r["consequent"][0][1:]] / total)) for r in found.collect()]
    return prune([r for r in rules if 1 - share[r.verdict] / total >= conviction * (1 - r.confidence)])


class Index:
    """Inverted index of rules: each is listed under the one of its tokens that the fewest rules have."""

    def __init__(self, rules: list[Rule]):
        used: dict[str, int] = {}
        for r in rules:
            for t in r.tokens:
                used[t] = used.get(t, 0) + 1
        self.lists: dict[str, list[tuple[int, frozenset]]] = {}
        self.rules = rules
        for k, r in enumerate(rules):
            self.lists.setdefault(min(r.tokens, key=lambda t: (used[t], t)), []).append((k, frozenset(r.tokens)))

    def best(self, found: list[str]) -> Rule | None:
        """The first rule (in the order of the list) of which all tokens are among those found."""
        own = set(found)
        k = min((k for t in own for k, need in self.lists.get(t, ()) if need <= own), default=None)
        return None if k is None else self.rules[k]


def match(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds mined (the tokens of the best rule), mined_verdict and mined_confidence to rows (tokens, ...), null where no rule fits."""
    held = rows.sparkSession.sparkContext.broadcast(Index(rules))
    names = list(rows.columns)
    at = names.index("tokens")

    def run(batches):
        for batch in batches:
            best = [held.value.best(t or []) for t in batch.column(at).to_pylist()]
            new = [pa.array([r and " ".join(r.tokens) for r in best], pa.string()), pa.array([r and r.verdict for r in best], pa.string()), pa.array([r and r.confidence for r in best], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*names, "mined", "mined_verdict", "mined_confidence"])

    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(run, f"{kinds}, mined string, mined_verdict string, mined_confidence double")


def with_tokens(df: DataFrame) -> DataFrame:
    """Adds host, path and tokens to rows (url, ...)."""
    return df.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))}).withColumn("tokens", tokens(F.col("host"), F.col("path"), F.col("url")))


def labels_of(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, label) of the pages (page_id, url) that have labels (doc_id, toxic): block where any is toxic, else allow."""
    told = labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.max("toxic").alias("toxic")).where("toxic is not null")
    return pages.select("page_id", "url").join(told, "page_id").select("url", F.when(F.col("toxic") > 0, "block").otherwise("allow").alias("label"))


def words(text: Column) -> Column:
    """Distinct runs of letters, lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+"), lambda w: w != ""))


def toxic_words(documents: DataFrame, labels: DataFrame, most: int = FIT_LABELS) -> list[str]:
    """Words by which labelled documents (doc_id, text; doc_id, toxic) are told to be toxic.

    Counted over whole texts of all labelled documents up to `most`, those with the smallest hashes of their doc_id.
    """
    told = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("toxic is not null")
    told = told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    each = documents.select("doc_id", "text").join(told, "doc_id").select((F.col("toxic") > 0).cast("long").alias("toxic"), F.explode(words(F.col("text"))).alias("word"))
    counts = each.groupBy("word").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n"))
    best = counts.where(F.col("bad") >= WORD_SHARE * (F.col("n") + 1)).orderBy(F.desc("bad"), "word").limit(TOXIC_WORDS)
    return [r["word"] for r in best.collect()]


def text_labels(pages: DataFrame, documents: DataFrame, labels: DataFrame) -> DataFrame | None:
    """(url, label) of all pages (url, html): block where the text between the tags has a toxic word, else allow. None
    where no word is known to be toxic."""
    bad = toxic_words(documents, labels)
    if not bad:
        return None
    own = words(F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]*>", " "))
    return pages.select("url", F.when(F.arrays_overlap(own, F.array(*map(F.lit, bad))), "block").otherwise("allow").alias("label"))


def filter_urls(pages: DataFrame, labels: DataFrame | None = None, rules: list[tuple[str, str]] = RULES, default: str = "allow", support: float = SUPPORT, confidence: float = CONFIDENCE, conviction: float = CONVICTION, least_rows: int = LEAST_ROWS) -> DataFrame:
    """Judge every page (page_id, url): page_id, host, path, rule, verdict, and the mined rule that fits.

    The verdict is the list rule's, else the best mined rule's, else `default`. Rules are mined from labels (url,
    label block or allow), none without labels. Null urls, and those without ://, have an empty host and path, no rule
    and no mined rule by host. Repeated rows are judged each; no pages: no rows; pages' further columns are ignored.
    """
    rows = with_rule(with_tokens(pages.select("page_id", "url")), rules)
    mined = [] if labels is None else mine(with_tokens(labels.select("url", "label")).where("label in ('block', 'allow')").select("tokens", "label"), support, confidence, conviction, least_rows)
    found = match(rows.select("page_id", "host", "path", "rule", "rule_verdict", "tokens"), mined)
    return found.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "mined_verdict", F.lit(default)).alias("verdict"), "mined", "mined_confidence")
