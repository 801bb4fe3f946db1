"""Corpus pipeline: language ID, n-gram Jaccard join, benchmark decontamination, best-fit packing.

In every stage a null text is a text without words, an empty table gives an empty one, and columns of any further names
pass through the filtering stages as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablesmith.llm import decontaminate, jaccard, language, packing
from tablesmith.llm.common import materialize

#: A document whose nearest profile is as far off as this is in no known language.
LEAST_SCORE = 0.15
#: Words of a shingle and percent of shared shingles of near copies in the corpus (op7 by itself has 4 and 85).
NEAR_WORDS, NEAR_PERCENT = 5, 80
#: Where the stand-in ids of rows without a doc_id begin.
NO_ID = 1 << 62


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a known language; those without a letter, or near to no profile, go.

    Null and empty texts go. Every row is judged by its own text, so repeated rows stay or go together, a null doc_id
    stays null. A text as near to two languages counts as the first by name. Without labelled rows no language is known.
    """
    profiles = language.fit(docs.where(~language.held_out("doc_id")).select("doc_id", "text", "lang"))
    own = {c: f"__{c}" for c in docs.columns if c.lower() in ("lang_pred", "score")}
    judged = language.identify(docs.withColumnsRenamed(own), profiles)
    kept = judged.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).drop("lang_pred", "score")
    return kept.withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)


def _document() -> Column:
    """The doc_id; of a row without one, a number made of its text beyond all ids."""
    own = F.lit(NO_ID) + F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(NO_ID))
    return F.coalesce(F.col("doc_id").cast("long"), own)


def _free(docs: DataFrame, *names: str) -> list[str]:
    """These names, or longer ones that no column of docs has, whatever its case."""
    taken, found = {c.lower() for c in docs.columns}, []
    for n in names:
        while n in taken:
            n += "_"
        found.append(n)
    return found


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each component of similar documents one row: that with the smallest doc_id.

    Rows that share a doc_id are one document, of which the row with the smallest digest of the text stays. Rows without
    a doc_id are compared like others and stay only where no row with one is similar. Texts without words are similar to
    none; such rows stay, one for each doc_id (and one of those without any).
    """
    document, place = _free(docs, "__document", "__row")
    keyed = docs.withColumn(document, _document())
    found = materialize(jaccard.group_similar(keyed.select(F.col(document).alias("doc_id"), "text"), size=NEAR_WORDS, percent=NEAR_PERCENT), "components")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(document)).distinct()
    several = found.where("doc_id = component_id").groupBy(F.col("doc_id").alias(document)).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(document)
    left = keyed.join(gone, document, "left_anti")
    # rows of one document are few but for repeated ids; the window's limit keeps one row of each task before the shuffle
    first = F.row_number().over(Window.partitionBy(document).orderBy(F.sha2(F.coalesce("text", F.lit("")), 256)))
    repeated = left.join(several, document, "left_semi").withColumn(place, first).where(F.col(place) == 1)
    return left.join(several, document, "left_anti").select(*docs.columns).unionByName(repeated.select(*docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in which no benchmark phrase occurs.

    Texts are judged, not ids: a row without a doc_id is judged like any other, repeated rows go together, and a clean
    row stays where another row of its doc_id is contaminated. Texts are told apart by a 64-bit hash.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    (key,) = _free(docs, "__text")
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit(""))))
    gone = decontaminate.decontaminate(keyed.select(F.col(key).alias("doc_id"), "text"), benchmark).where("contaminated").select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(gone, key, "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into training sequences, a row per piece. Null and empty texts are an end token alone; rows
    without a doc_id and repeated rows are packed each."""
    import public_tokenizers

    return packing.best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", identify_language), ("ngram_jaccard_join", drop_near_copies), ("benchmark_decontamination", drop_contaminated), ("best_fit_packing", pack)]

#: SQL can't express the tokenizer, the profiles or the packing; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's rows written in the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
