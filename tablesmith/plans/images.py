"""The image run: searches, results distinct by URL, ranking in chunks, the best ones."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesmith.functions.text import cap_queries, parse_scores, query_variations
from tablesmith.operators.dedup import first_by_key
from tablesmith.operators.flow import numbered
from tablesmith.operators.shared import written
from tablesmith.plans.planning import TextModel, decode

CHUNK = 15
LEAST_SCORE = 0.7
#: The score of images that the model couldn't judge.
UNRANKED = 0.5


def image_queries(spark: SparkSession, query: str, model: TextModel | None = None) -> DataFrame:
    """query_id, query_text: the model's searches, the original first, 12 at most; without a model, or where its call
    fails or its answer is no list of texts, the static variations."""
    one = spark.createDataFrame([(query,)], "q string")
    try:
        made = [x for x in decode(model.complete("image_queries", query), list) if isinstance(x, str) and x.strip()] if model else []
    except Exception:
        made = []
    queries = cap_queries(F.array(*[F.lit(x) for x in made]), F.col("q")) if made else query_variations(F.col("q"))
    return one.select(F.posexplode(queries).alias("query_id", "query_text")).withColumn("query_id", F.col("query_id").cast("long"))


class CorpusImages:
    """Image search over a table of pages: the <img> tags of pages of which the query has a word in the alternative text."""

    def __init__(self, pages: DataFrame, per_query: int = 20):
        self.pages, self.per_query = pages, per_query

    def search_images(self, queries: DataFrame) -> DataFrame:
        from pyspark.sql import Window

        tag = F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<img\s[^>]*>"), F.lit(0))).alias("tag")
        attribute = lambda n: F.regexp_extract("tag", rf"(?is)\b{n}\s*=\s*\"([^\"]*)\"", 1)
        tags = self.pages.select("page_id", "url", tag).where(attribute("src") != "")
        images = tags.select("page_id", F.col("url").alias("source_url"), attribute("src").alias("image_url"), attribute("alt").alias("title"), attribute("width").try_cast("long").alias("width"), attribute("height").try_cast("long").alias("height"))
        words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
        terms = queries.select("query_id", F.explode(words(F.col("query_text"))).alias("term"))
        hits = images.withColumn("term", F.explode(words(F.col("title")))).join(F.broadcast(terms), "term")  # a query's words: at most 12 queries
        hits = hits.groupBy("query_id", "page_id", "source_url", "image_url", "title", "width", "height").agg(F.count(F.lit(1)).alias("n"))
        w = Window.partitionBy("query_id").orderBy(F.desc("n"), "page_id", "image_url")
        ranked = hits.withColumn("position", (F.row_number().over(w) - 1).cast("long")).where(F.col("position") < self.per_query)
        return ranked.select("query_id", "position", "image_url", F.col("image_url").alias("thumbnail_url"), "title", "source_url", "width", "height")


def collect_images(results: DataFrame) -> DataFrame:
    """Distinct results by image URL, the first in order of (query, position), with idx from 0 in that order."""
    return numbered(first_by_key(results, "image_url", ["query_id", "position"]), ["query_id", "position"], "idx")


def zip_scores(chunks: DataFrame) -> DataFrame:
    """chunks (items array, response) -> an item per row with its score: the response's number at its place, 0 if absent."""
    scores = parse_scores(F.col("response"), F.size("items"))
    return chunks.select(F.explode(F.arrays_zip("items", scores.alias("scores"))).alias("z")).select("z.items.*", F.col("z.scores").alias("score"))


def score_images(images: DataFrame, query: str, model: TextModel, size: int = CHUNK) -> DataFrame:
    """Adds score to images (idx, title, ...): the model judges them in chunks of `size`, in order of idx; those of a
    chunk for which its call fails are UNRANKED."""
    item = F.struct(*images.columns)
    chunks = images.withColumn("chunk", F.floor(F.col("idx") / size)).groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("idx", item.alias("item")))).alias("of"))
    chunks = chunks.select("chunk", F.transform("of", lambda x: x["item"]).alias("items"))  # `size` items at most

    def ask(frames):
        for f in frames:
            yield pd.DataFrame({"chunk": f["chunk"], "response": [one(titles) for titles in f["titles"]]})

    def one(titles) -> str:
        try:
            return model.complete("scores", json.dumps({"query": query, "titles": [t or "" for t in titles]}))
        except Exception:
            return json.dumps([UNRANKED] * len(titles))

    asked = written(chunks, "chunks")
    answers = asked.select("chunk", F.transform("items", lambda x: x["title"]).alias("titles")).mapInPandas(ask, "chunk long, response string")
    return zip_scores(asked.join(answers, "chunk"))


def best_images(scored: DataFrame, least: float = LEAST_SCORE, most: int | None = None) -> DataFrame:
    """Images of at least this score, best first; ties by idx."""
    best = scored.where(F.col("score") >= least).orderBy(F.desc("score"), "idx")
    return best if most is None else best.limit(most)
