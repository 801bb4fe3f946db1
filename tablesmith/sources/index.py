"""A stored inverted index of pages with BM25 scores; searches read the index only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Parameters of BM25; scores are summed in whole millionths, so that they don't depend on the order of terms.
K1, B, MICRO = 1.2, 0.75, 1_000_000
#: Folders of postings by a hash of the term, and page_ids to a block of postings that has a bound of its scores.
BUCKETS, BLOCK_IDS = 64, 256
#: Blocks of a query that are scored first; what the best `per_query` of them reach is the bar for all other blocks.
FIRST_BLOCKS = 4


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def build(pages: DataFrame, path: str) -> PageIndex:
    """Write the index of pages (page_id, url, html). Postings are a row for each page and term, with its score."""
    spark = pages.sparkSession
    text = pages.select("page_id", "url", F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1).alias("title"), words(F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]*>", " ")).alias("w"))
    text.select("page_id", "url", "title", F.size("w").cast("long").alias("dl")).write.parquet(f"{path}/pages")
    counts = text.select("page_id", F.size("w").cast("long").alias("dl"), F.explode("w").alias("term")).groupBy("page_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    counts.write.parquet(f"{path}/counts")
    counts = spark.read.parquet(f"{path}/counts")
    n, total = spark.read.parquet(f"{path}/pages").agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    score = (F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * ((1 - B) + B * F.col("dl") / F.lit(total / max(n, 1)))))
    scored = counts.join(df, "term").select(_bucket(F.col("term")).alias("bucket"), "term", F.floor(F.col("page_id") / BLOCK_IDS).alias("block"), "page_id", F.floor(score * MICRO).cast("long").alias("score"))
    scored.repartition("bucket").sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{path}/postings")
    postings = spark.read.parquet(f"{path}/postings")
    postings.groupBy("bucket", "term", "block").agg(F.max("score").alias("most")).write.parquet(f"{path}/blocks")
    return PageIndex(spark, path)


class PageIndex:
    """A search provider over a stored index."""

    def __init__(self, spark: SparkSession, path: str, per_query: int = 20):
        self.spark, self.path, self.per_query = spark, path, per_query

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _best(self, scored: DataFrame) -> DataFrame:
        """The best pages of each query: of each block first, so that no task ranks all hits of a query."""
        order = [F.desc("score"), "page_id"]
        within = scored.withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "block").orderBy(*order))).where(F.col("_r") <= self.per_query)
        return within.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("_r") <= self.per_query)

    def search(self, queries: DataFrame) -> DataFrame:
        """queries (query_id, query_text) -> query_id, url, title, snippet, position, score: the best pages, ties by
        page_id. Blocks whose bound is below a query's bar aren't scored."""
        from tablesmith.operators.shared import written

        terms = queries.select("query_id", F.explode(F.array_distinct(words(F.col("query_text")))).alias("term")).withColumn("bucket", _bucket(F.col("term")))
        terms = written(terms, "terms")
        buckets = [r["bucket"] for r in terms.select("bucket").distinct().collect()]  # BUCKETS of them at most
        of = F.col("bucket").isin(buckets)
        blocks = self._read("blocks").where(of).join(terms, ["bucket", "term"]).groupBy("query_id", "block").agg(F.sum("most").alias("bound"))
        blocks = written(blocks.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "block"))), "bounds")
        postings = self._read("postings").where(of)

        def score(of_blocks: DataFrame) -> DataFrame:
            hits = postings.join(terms, ["bucket", "term"]).join(of_blocks.select("query_id", "block"), ["query_id", "block"])
            return self._best(hits.groupBy("query_id", "block", "page_id").agg(F.sum("score").alias("score")))

        first = written(score(blocks.where(F.col("_r") <= FIRST_BLOCKS)), "first")
        bars = first.where(F.col("_r") == self.per_query).select("query_id", F.col("score").alias("bar"))
        rest = blocks.where(F.col("_r") > FIRST_BLOCKS).join(bars, "query_id", "left").where(F.coalesce("bar", F.lit(0)) <= F.col("bound"))
        best = self._best(first.drop("_r").unionByName(score(rest).drop("_r"))).select("query_id", "page_id", "score", (F.col("_r") - 1).cast("long").alias("position"))
        return best.join(self._read("pages"), "page_id").select("query_id", "url", "title", F.lit("").alias("snippet"), "position", "score")
