"""Run catalog: run tables under a versioned manifest, history, status log, settings, cascade deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesmith.plans.manifest import Change, Manifest

#: The tables of the catalog with their columns.
TABLES = {
    "runs": "run_id string, query string, config string, run_type string, created_at long",
    "run_status": "run_id string, seq long, status string, error string, stats string, at long",
    "run_schemas": "run_id string, columns string, confirmed boolean, created_at long",
    "search_queries": "run_id string, query_id string, query_text string, language string, geo_target string, priority int, batch_number int, status string, result_count long",
    "search_results": "run_id string, query_id string, result_id string, url string, title string, snippet string, rank long, status string",
    "fetched_pages": "run_id string, result_id string, page_id string, url string, content_type string, error string, fetched_at long",
    "entity_rows": "run_id string, entity_row_id string, seq long, data string, confidence double, status string, dedup_group_id string, created_at long",
    "row_sources": "run_id string, entity_row_id string, url string, title string, snippet string, created_at long",
    "image_results": "run_id string, idx long, image_url string, thumbnail_url string, title string, source_url string, width long, height long, score double, created_at long",
    "run_logs": "run_id string, id long, level string, message string, at long",
    "run_batches": "run_id string, batch long, pages_fetched long, pages_failed long, rows long, valid long, llm_calls long, llm_micros long, millis long, stop_reason string",
    "settings": "key string, value string, version long",
}
TERMINAL = ("completed", "failed", "cancelled")
DEFAULTS = {"target_row_count": "50", "max_budget_usd": "1.00", "max_duration_seconds": "600", "saturation_threshold": "0.05", "min_confidence_threshold": "0.5", "dedup_similarity_threshold": "0.85", "search_results_per_query": "20", "max_extraction_text_chars": "12000", "enable_content_truncation": "true", "max_page_size_kb": "5000", "max_parallel_extractions": "3"}


def latest_status(log: DataFrame) -> DataFrame:
    """run_status rows -> the last status of each run, with completed_at where it is terminal."""
    last = log.groupBy("run_id").agg(F.max_by(F.struct("status", "error", "stats", "at"), "seq").alias("s"))
    return last.select("run_id", "s.status", "s.error", "s.stats", F.when(F.col("s.status").isin(*TERMINAL), F.col("s.at")).alias("completed_at"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new replace those of old with their key."""
    return old.join(new, key, "left_anti").unionByName(new)


def insert_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.unionByName(new.join(old, key, "left_anti"))


def typed_settings(settings: DataFrame, kinds: dict[str, tuple[str, str]], *by: str) -> DataFrame:
    """One row (for each `by`) with each key of kinds {key: (type, default)}; absent or unparsable values become the default."""
    value = lambda k: F.max(F.when(F.col("key") == k, F.col("value")))
    return settings.groupBy(*by).agg(*[F.coalesce(value(k).try_cast(t), F.lit(d).cast(t)).alias(k) for k, (t, d) in kinds.items()])


def cascade_delete(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """The tables without the rows of the runs in gone (run_id)."""
    return {n: t.join(gone, "run_id", "left_anti") if "run_id" in t.columns else t for n, t in tables.items()}


class Catalog:
    """The tables of all runs in a folder, under a versioned manifest; a run is a scope, settings have none.

    Reads are of the last version. What belongs together is written by one change (see :meth:`change`).
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.manifest = Manifest(spark, self.root)

    def change(self, run_id: str = "", reads: list[str] = ()) -> CatalogChange:
        return CatalogChange(self.manifest, run_id, reads)

    def _rows(self, table: str, folders: list[str]) -> DataFrame:
        kinds = TABLES[table]
        return self.spark.read.schema(kinds).parquet(*folders) if folders else self.spark.createDataFrame([], kinds)

    def read(self, table: str) -> DataFrame:
        self.manifest.refresh()
        return self._rows(table, self.manifest.folders(table))

    def of_run(self, table: str, run_id: str) -> DataFrame:
        """A run's rows; other runs' folders aren't read."""
        self.manifest.refresh()
        return self._rows(table, self.manifest.folders(table, run_id))

    def append(self, table: str, rows: DataFrame, run_id: str = "", key: str | None = None) -> None:
        change = self.change(run_id)
        change.put(table, rows, key)
        change.finish()

    def replace_run(self, table: str, run_id: str, rows: DataFrame) -> None:
        """Put rows in the place of the run's rows (rows may be made from them): an update of a status or a group."""
        change = self.change(run_id)
        change.replace(table, rows)
        change.finish()

    def pending(self, run_id: str) -> DataFrame:
        """The work queue: search results that are still to be fetched, in order of rank."""
        fetched = self.of_run("fetched_pages", run_id).select("result_id")
        return self.of_run("search_results", run_id).where("status = 'pending'").join(fetched, "result_id", "left_anti").orderBy("rank", "result_id")

    def set_schema(self, run_id: str, columns: str, confirmed: bool, at: int) -> None:
        self.replace_run("run_schemas", run_id, self.spark.createDataFrame([(columns, confirmed, at)], "columns string, confirmed boolean, created_at long"))

    def schema_of(self, run_id: str):
        """The run's row of run_schemas, or None."""
        return self.of_run("run_schemas", run_id).first()

    def settings(self) -> DataFrame:
        """key, value: the defaults, and the last value that was set for each key."""
        last = self.read("settings").groupBy("key").agg(F.max_by("value", "version").alias("value"))
        return upsert(self.spark.createDataFrame(sorted(DEFAULTS.items()), "key string, value string"), last, "key")

    def set_setting(self, key: str, value: str) -> None:
        change = self.change()
        version = self.read("settings").agg(F.coalesce(F.max("version"), F.lit(0))).first()[0] + 1
        change.put("settings", self.spark.createDataFrame([(key, value, version)], TABLES["settings"]), f"{version}")
        change.finish()

    def delete(self, run_id: str) -> None:
        """Drop the run's rows of every table."""
        change = self.change(run_id)
        change.drop()
        change.finish()

    def vacuum(self) -> int:
        """Delete folders that lost or deleted runs have left; see Manifest.vacuum."""
        return self.manifest.vacuum(list(TABLES))

    def runs(self, limit: int | None = 50, offset: int = 0) -> DataFrame:
        """History: newest first; all runs, in any order, without a limit."""
        found = self.read("runs").join(latest_status(self.read("run_status")), "run_id", "left")
        return found if limit is None else found.orderBy(F.desc("created_at"), "run_id").offset(offset).limit(limit)


class CatalogChange(Change):
    """A change whose rows get their table's columns (absent ones null) and the run's id."""

    def _write(self, do, table, rows, key, counts):
        have = set(rows.columns) | {"run_id"}
        rows = rows.withColumn("run_id", F.lit(self.scope))
        kinds = [x.split() for x in TABLES[table].split(", ")]
        return super()._write(do, table, rows.select(*[(F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in kinds]), key, counts)
