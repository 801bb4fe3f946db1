"""Responses of search and model services, as tables of JSON texts -> rows; no network is needed to read them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where each service's answers have their results, and the shape of one.
WEB = {
    "web.results": "struct<web:struct<results:array<struct<title:string,url:string,description:string>>>>",
    "organic": "struct<organic:array<struct<title:string,link:string,snippet:string>>>",
}
IMAGES = {
    "results": "struct<results:array<struct<title:string,url:string,thumbnail:struct<src:string>,properties:struct<url:string,width:bigint,height:bigint>>>>",
    "images": "struct<images:array<struct<title:string,imageUrl:string,thumbnailUrl:string,link:string,source:string,imageWidth:bigint,imageHeight:bigint>>>",
}
COMPLETIONS = {
    "choices": "struct<choices:array<struct<message:struct<content:string>>>,usage:struct<prompt_tokens:bigint,completion_tokens:bigint>>",
    "message": "struct<message:struct<content:string>,prompt_eval_count:bigint,eval_count:bigint>",
}


def _each(answers: DataFrame, kinds: dict[str, str], at: str) -> DataFrame:
    body = F.from_json("body", kinds[at])
    found = body
    for part in at.split("."):
        found = found[part]
    return answers.select("query_id", F.posexplode(found).alias("position", "x"))


def web_results(answers: DataFrame, at: str = "web.results") -> DataFrame:
    """answers (query_id, body) -> query_id, url, title, snippet, position; an answer without results gives no rows."""
    x = _each(answers, WEB, at)
    url, snippet = ("x.url", "x.description") if at == "web.results" else ("x.link", "x.snippet")
    return x.select("query_id", F.col(url).alias("url"), F.col("x.title").alias("title"), F.coalesce(snippet, F.lit("")).alias("snippet"), F.col("position").cast("long"))


def image_results(answers: DataFrame, at: str = "results") -> DataFrame:
    """answers (query_id, body) -> query_id, position, image_url, thumbnail_url, title, source_url, width, height.

    A missing thumbnail is the image itself; the page is `url`, or `link` and else `source`, or empty.
    """
    x = _each(answers, IMAGES, at)
    if at == "results":
        cols = {"image_url": F.col("x.properties.url"), "thumbnail_url": F.coalesce("x.thumbnail.src", "x.properties.url"), "source_url": F.coalesce("x.url", F.lit("")), "width": F.col("x.properties.width"), "height": F.col("x.properties.height")}
    else:
        cols = {"image_url": F.col("x.imageUrl"), "thumbnail_url": F.coalesce("x.thumbnailUrl", "x.imageUrl"), "source_url": F.coalesce("x.link", "x.source", F.lit("")), "width": F.col("x.imageWidth"), "height": F.col("x.imageHeight")}
    names = ["image_url", "thumbnail_url", "title", "source_url", "width", "height"]
    cols["title"] = F.coalesce("x.title", F.lit(""))
    return x.select("query_id", F.col("position").cast("long"), *[cols[n].alias(n) for n in names])


def failure(status: Column) -> Column:
    """What an HTTP status means for a call: null (fine), auth_error, rate_limited or provider_error."""
    return F.when(status.between(200, 299), F.lit(None).cast("string")).when(status.isin(401, 403), "auth_error").when(status == 429, "rate_limited").otherwise("provider_error")


def completions(answers: DataFrame, at: str = "choices") -> DataFrame:
    """answers (call_id, status, body) -> call_id, content, prompt_tokens, completion_tokens, error.

    The content is that of the first choice; an answer of status 200 without one has the error parse_error.
    """
    x = answers.select("call_id", failure(F.col("status")).alias("failed"), F.from_json("body", COMPLETIONS[at]).alias("x"))
    if at == "choices":
        content, prompt, made = F.try_element_at(F.col("x.choices"), F.lit(1))["message"]["content"], "x.usage.prompt_tokens", "x.usage.completion_tokens"
    else:
        content, prompt, made = F.col("x.message.content"), "x.prompt_eval_count", "x.eval_count"
    x = x.select("call_id", "failed", F.when(F.col("failed").isNull(), content).alias("content"), F.coalesce(prompt, F.lit(0)).alias("prompt_tokens"), F.coalesce(made, F.lit(0)).alias("completion_tokens"))
    return x.select("call_id", "content", "prompt_tokens", "completion_tokens", F.coalesce("failed", F.when(F.col("content").isNull(), "parse_error")).alias("error"))
