"""Provider seam: search, page and model providers. The defaults are deterministic and need no network."""

from __future__ import annotations

import functools
import time
from collections.abc import Callable
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.functions.text import utf8_lossy
from tablesmith.operators.dedup import first_by_key
from tablesmith.operators.shared import written


class Retryable(Exception):
    """An error after which the call is worth repeating; hint: seconds to wait, if the other side said so."""

    def __init__(self, message: str, hint: float | None = None):
        super().__init__(message)
        self.hint = hint


def worth_retrying(e: Exception) -> bool:
    """Whether an error is Retryable, or that of a job of which a task raised one."""
    return isinstance(e, Retryable) or "providers.Retryable" in str(e)


def with_retry(call: Callable[[], Any], retries: int = 2, initial: float = 2.0, factor: float = 2.0, most: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> Any:
    """call(), repeated up to `retries` times after Retryable errors, with growing waits; other errors pass at once.

    Errors of a lazy frame come when it is written: the call has to write it.
    """
    delay = initial
    for attempt in range(retries + 1):
        try:
            return call()
        except Exception as e:
            if attempt == retries or not worth_retrying(e):
                raise
            hint = getattr(e, "hint", None)
            sleep(min(hint if hint is not None else delay, most))
            delay = min(delay * factor, most)


class SearchProvider(Protocol):
    def search(self, queries: DataFrame) -> DataFrame:
        """queries (query_id, query_text) -> query_id, url, title, snippet, position."""


class ModelProvider(Protocol):
    def extract(self, url: str, title: str, text: str, fields: list) -> list[tuple[str, float]]:
        """(data JSON, confidence) of each entity of a document."""


def _words(x: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(x), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


class CorpusSearch:
    """Searches a table of pages by an inverted list of terms: pages are ranked by how many query terms they hold."""

    def __init__(self, pages: DataFrame, per_query: int = 20):
        self.pages, self.per_query = pages, per_query

    def search(self, queries: DataFrame) -> DataFrame:
        terms = queries.select("query_id", F.explode(_words(F.col("query_text"))).alias("term"))
        wanted = terms.select("term").distinct()
        postings = self.pages.select("page_id", F.explode(_words(F.regexp_replace("html", "<[^>]*>", " "))).alias("term")).join(wanted, "term", "left_semi")
        hits = postings.join(terms, "term").groupBy("query_id", "page_id").agg(F.count(F.lit(1)).alias("hits"))
        from pyspark.sql import Window

        ranked = hits.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("hits"), "page_id")) - 1).where(F.col("position") < self.per_query)
        found = ranked.join(self.pages.select("page_id", "url", "html"), "page_id")
        return found.select("query_id", "url", F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1).alias("title"), F.lit("").alias("snippet"), F.col("position").cast("long"), "hits")


def search_with_fallback(primary: DataFrame, failed: DataFrame, fallback: DataFrame) -> DataFrame:
    """Primary results, and the fallback's for the queries that failed (query_id)."""
    return primary.join(failed, "query_id", "left_anti").unionByName(fallback.join(failed, "query_id", "left_semi"))


def collect_results(results: DataFrame) -> DataFrame:
    """Distinct results by URL: the first in order of (priority, query, position)."""
    return first_by_key(results, "url", ["priority", "query_id", "position"])


def fetch(urls: DataFrame, pages: DataFrame, most_bytes: int = 5_000 * 1024, parsed_only: bool = False) -> DataFrame:
    """urls (url, ...) -> with html and error (invalid_url, not_found, too_large, http_status or null), from a table of pages.

    The status of a page, where the table has any, must be 200 to 299. A binary html is decoded, broken bytes replaced;
    its bytes are measured before. With parsed_only a URL without a scheme and a host isn't looked up.
    """
    names = [c for c in ("url", "html", "status") if c in pages.columns]
    body = first_by_key(pages.select("page_id", *names), "url", ["page_id"]).select(*names)
    wanted = F.col("url").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]") if parsed_only else F.lit(True)
    out = urls.join(body, "url", "left")
    error = F.when(~F.coalesce(wanted, F.lit(False)), "invalid_url").when(F.col("html").isNull(), "not_found")
    error = error.when(F.octet_length("html") > most_bytes, "too_large")
    if "status" in pages.columns:
        error = error.when(~F.coalesce(F.col("status").between(200, 299), F.lit(False)), "http_status")
    html = utf8_lossy(F.col("html")) if dict(pages.dtypes)["html"] == "binary" else F.col("html")
    return out.withColumn("error", error).withColumn("html", F.when(F.col("error").isNull(), html)).drop("status")


def decode_rows(answer: str) -> list[tuple[str, float]]:
    """(data JSON, confidence) of each row of a model's answer {"rows": [{"data", "confidence"}]}.

    A missing or null confidence is 0.5. Anything of a wrong type, wherever it stands, makes the whole answer a
    ValueError, so a page gives all of its rows or none.
    """
    import json

    found = json.loads(answer)
    if not isinstance(found, dict) or not isinstance(found.get("rows"), list):
        raise ValueError("an answer has no rows")
    made = []
    for r in found["rows"]:
        if not isinstance(r, dict) or "data" not in r:
            raise ValueError("a row has no data")
        c = r.get("confidence")
        if c is not None and (isinstance(c, bool) or not isinstance(c, (int, float))):
            raise ValueError("a confidence is no number")
        made.append((json.dumps(r["data"], ensure_ascii=False), 0.5 if c is None else float(c)))
    return made


class AnswerExtractor:
    """Extraction by a model that answers texts; see decode_rows."""

    def __init__(self, complete: Callable[[str, str], str]):
        self.complete = complete

    def extract(self, url: str, title: str, text: str, fields: list) -> list[tuple[str, float]]:
        import json

        return decode_rows(self.complete("extract", json.dumps({"columns": [f.name for f in fields], "title": title, "url": url, "text": text}, ensure_ascii=False)))


class GaveUp(Exception):
    """A call that failed though it was repeated; nobody above repeats it."""


class RoutedModel:
    """A text model made of several: roles names the one for a role ("extract", "scores", ...), others go to `default`.

    A call is repeated three times after errors worth it, at 2 seconds, growing to 60; other errors pass at once. To
    extract rows use AnswerExtractor(routed.complete).
    """

    def __init__(self, models: dict[str, Any], default: str, roles: dict[str, str] | None = None, retries: int = 3, sleep: Callable[[float], None] = time.sleep):
        self.models, self.default, self.roles, self.retries, self.sleep = models, default, roles or {}, retries, sleep
        if gone := {default, *self.roles.values()} - set(models):
            raise ValueError(f"no such model: {', '.join(sorted(gone))}")

    def complete(self, role: str, content: str) -> str:
        model = self.models[self.roles.get(role, self.default)]
        try:
            return with_retry(lambda: model.complete(role, content), self.retries, most=60.0, sleep=self.sleep)
        except Retryable as e:
            raise GaveUp(f"{role}: {e}") from None


class FallbackSearch:
    """Searches (pages or images) with the first provider, again after errors worth it, then with the second.

    Results are written, so that errors of lazy providers are met here. If a search for all queries fails, each query
    is searched by itself (a run has a few dozen), and only those that fail go to the second provider.
    """

    def __init__(self, primary: Any, fallback: Any | None = None, retries: int = 2, sleep: Callable[[float], None] = time.sleep):
        self.primary, self.fallback, self.retries, self.sleep = primary, fallback, retries, sleep

    def _all(self, verb: str, provider: Any, queries: DataFrame, retries: int) -> DataFrame:
        return with_retry(lambda: written(getattr(provider, verb)(queries), "found"), retries, sleep=self.sleep)

    def _one(self, verb: str, query: DataFrame) -> DataFrame:
        try:
            return self._all(verb, self.primary, query, self.retries)
        except Exception:
            if self.fallback is None:
                raise
            return self._all(verb, self.fallback, query, 0)

    def _search(self, verb: str, queries: DataFrame) -> DataFrame:
        try:
            return self._all(verb, self.primary, queries, 0)
        except Exception:
            rows = queries.collect()
            if not rows:
                raise
            each = [self._one(verb, queries.sparkSession.createDataFrame([r], queries.schema)) for r in rows]
            return functools.reduce(DataFrame.unionByName, each)

    def search(self, queries: DataFrame) -> DataFrame:
        return self._search("search", queries)

    def search_images(self, queries: DataFrame) -> DataFrame:
        return self._search("search_images", queries)


def rate_limit_slots(requests: DataFrame, interval_ms: int = 2000, burst: int = 3) -> DataFrame:
    """requests (host, at_ms, seq) -> with slot_ms, the earliest time at which each may go: a token bucket per host.

    A bucket holds `burst` tokens and gets one each interval. In order of (at_ms, seq) request k of a host (from 0) goes
    at the latest of at_ms and, over all earlier ones j whose bucket is not refilled, their time and (k - j - burst + 1)
    intervals: max(at[k], max over j <= k of (at[j] + (k - j - burst + 1) * interval)).
    """
    from pyspark.sql import Window

    w = Window.partitionBy("host").orderBy("at_ms", "seq")
    k = F.row_number().over(w) - 1
    placed = requests.withColumn("_k", k)
    ahead = F.max(F.col("at_ms") - F.col("_k") * interval_ms).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("slot_ms", F.greatest(F.col("at_ms"), ahead + (F.col("_k") - (burst - 1)) * interval_ms)).drop("_k")


class TitleExtractor:
    """Offline model: one row a document, named by its title."""

    def extract(self, url: str, title: str, text: str, fields: list) -> list[tuple[str, float]]:
        import json

        data = {f.name: url if f.type == "url" else len(text) if f.type == "number" else title for f in fields}
        return [(json.dumps(data, ensure_ascii=False), min(1.0, len(text) / 1000))] if title else []


def answers(docs: DataFrame, model: ModelProvider, fields: list, most_chars: int | None = 12_000, retries: int = 3, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """docs (url, title, text) of more than 50 bytes -> one row for each call of the model: url, title, rows (data,
    confidence), error, prompt_tokens, completion_tokens.

    The model sees the first most_chars characters of a text, all of it if that is None. A call is repeated after
    errors worth it; a document whose call fails has its error and no rows. Tokens are those that the model tells
    (usage(), of its last call), else a quarter of the characters. Write the result before using it twice: the model
    is called for every use.
    """
    text = F.col("text") if most_chars is None else F.left("text", F.lit(most_chars))
    gated = docs.where(F.octet_length("text") > 50).select("url", "title", text.alias("text"))

    def ask(r) -> tuple:
        rows, error = [], None
        try:
            rows = [{"data": d, "confidence": c} for d, c in with_retry(lambda: model.extract(r.url, r.title, r.text, fields), retries, most=60.0, sleep=sleep)]
        except Exception as e:
            error = f"{type(e).__name__}: {e}"[:500]
        told = model.usage() if hasattr(model, "usage") else (-(-len(r.text) // 4), -(-sum(len(x["data"]) for x in rows) // 4))
        return r.url, r.title, rows, error, *told

    def run(frames):
        for f in frames:
            yield pd.DataFrame([ask(r) for r in f.itertuples()], columns=["url", "title", "rows", "error", "prompt_tokens", "completion_tokens"])

    return gated.mapInPandas(run, "url string, title string, rows array<struct<data:string,confidence:double>>, error string, prompt_tokens long, completion_tokens long")


def answered_rows(told: DataFrame) -> DataFrame:
    """Answers -> data, confidence, source_url, source_title, place (from 0 in the document)."""
    x = told.select("url", "title", F.posexplode("rows").alias("place", "r"))
    return x.select("r.data", "r.confidence", F.col("url").alias("source_url"), F.col("title").alias("source_title"), F.col("place").cast("long"))


def extract(docs: DataFrame, model: ModelProvider, fields: list, most_chars: int | None = 12_000) -> DataFrame:
    """The rows of the model's answers; see answers."""
    return answered_rows(answers(docs, model, fields, most_chars))


def robots_rules(robots: DataFrame, agent: str = "*") -> DataFrame:
    """robots (origin, body) -> origin, rule: the paths that the agent, or every agent, must not read."""
    from pyspark.sql import Window

    lines = robots.select("origin", F.posexplode(F.split("body", "\n")).alias("at", "line")).withColumn("line", F.trim("line"))
    named = F.when(F.col("line").rlike("^[Uu]ser-agent:"), F.trim(F.regexp_replace("line", "^[Uu]ser-agent:", "")))
    marked = lines.withColumn("agent", F.last(named, ignorenulls=True).over(Window.partitionBy("origin").orderBy("at")))
    rule = F.trim(F.regexp_replace("line", "^[Dd]isallow:", ""))
    return marked.where(F.col("line").rlike("^[Dd]isallow:") & F.col("agent").isin("*", agent) & (rule != "")).select("origin", rule.alias("rule")).distinct()


def robots_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The urls (origin, path, ...) that no rule of their origin forbids."""
    hit = (urls.origin == rules.origin) & F.col("path").startswith(F.col("rule"))
    return urls.join(rules, hit, "left_anti")
