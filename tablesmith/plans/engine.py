"""The two pipelines, a question to a typed table and to a ranked list of images, and the verbs that control them."""

from __future__ import annotations

import contextlib
import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablesmith.functions.html import parse_html
from tablesmith.functions.text import data_url, format_2dp, normalize_name
from tablesmith.operators import flow
from tablesmith.operators.dedup import first_by_key, fuzzy_groups, merge_groups
from tablesmith.operators.shared import small_batches, written, written_and_counted
from tablesmith.operators.validate import Field, valid_only, validate
from tablesmith.plans import images, planning
from tablesmith.plans.catalog import TERMINAL, Catalog, CatalogChange
from tablesmith.plans.manifest import Conflict
from tablesmith.sources import providers, sinks

#: Pages that are read between two looks at the stop limits.
BATCH_PAGES = 200
#: Micro-dollars of a search.
SEARCH_MICROS = 5000


def page_rows(pages: DataFrame, fields: list[Field], model=None, most_chars: int | None = 12_000) -> DataFrame:
    """pages (url, html) -> extracted rows with their place in the page. Only a model's texts are cut, not the offline extractor's."""
    small_batches(pages.sparkSession)
    docs = pages.select("url", parse_html("html").alias("p")).select("url", "p.title", "p.text")
    return providers.extract(docs, model, fields, most_chars) if model else providers.extract(docs, providers.TitleExtractor(), fields, None)


def in_order(rows: DataFrame) -> DataFrame:
    """Adds seq to extracted rows: from 0, by source_url and place; rows that are equal in both by their data."""
    return flow.numbered(rows, ["source_url", "place", "data"], "seq")


def dedup_rows(valid: DataFrame, name: str, fields: list[Field], threshold: float = 0.85) -> DataFrame:
    """Valid rows (seq, data, confidence, source_url) -> one merged row per entity, with leader: its first row's seq.

    seq is unique and bears the order. Rows meet by their names, so repeated rows count once each; a row without a name
    is an entity of its own.
    """
    return merge_groups(with_leaders(valid, name, fields, threshold), "leader", [f.name for f in fields])


def with_leaders(valid: DataFrame, name: str, fields: list[Field], threshold: float = 0.85) -> DataFrame:
    """Valid rows with the fields as columns and leader, the seq of the first row of the entity."""
    flat = valid.select("seq", "data", "confidence", "source_url", *[F.get_json_object("data", f"$['{f.name}']").alias(f.name) for f in fields], normalize_name(F.get_json_object("data", f"$['{name}']")).alias("_name"))
    flat = written(flat, "rows")
    groups = fuzzy_groups(flat.select("seq", F.col("_name").alias("name")).where("name <> ''"), threshold)
    label = groups.groupBy(F.col("name").alias("_name")).agg(F.min("leader").alias("leader"))  # one leader a name
    return flat.join(label, "_name", "left").withColumn("leader", F.coalesce("leader", "seq")).drop("_name")


def name_field(fields: list[Field]) -> str:
    """The column by which rows are the same entity: "name", else the first required text, else the first one."""
    names = [f.name for f in fields]
    return "name" if "name" in names else next((f.name for f in fields if f.required and f.type == "text"), names[0])


class ResearchEngine:
    """The control verbs over a catalog. A step, or a batch of pages, leaves its results, its line in the log and its
    counts in one commit, so a run that is paused, or whose driver is lost, is resumed at the first that isn't there. A
    step that a cancel meets is thrown away; a pause lets it end."""

    def __init__(self, spark: SparkSession, root: str, pages: DataFrame, search=None, model=None, planner: planning.TextModel | None = None, image_search=None):
        self.spark, self.catalog, self.pages = spark, Catalog(spark, root), pages
        self.search, self.model, self.planner = search or providers.CorpusSearch(pages), model, planner or planning.OfflineModel()
        self.image_search = image_search or images.CorpusImages(pages)

    # runs

    def start_run(self, query: str, fields: list[Field] | None = None, run_type: str = "table", confirm: bool = True, **limits) -> str:
        """Start a run and take it as far as it goes; returns its id.

        limits (target_row_count, max_budget_usd, max_duration_seconds, ...) override the settings for this run where
        they are positive numbers. Without confirm a table run waits, pending, for confirm_schema.
        """
        if not query.strip():
            raise ValueError("an empty query")
        run_id = uuid.uuid4().hex
        settings = self.get_settings()
        config = settings | {k: str(planning.positive(v, float(settings[k]))) for k, v in limits.items()}
        change = self.catalog.change(run_id)
        change.put("runs", self._row([(query, run_type, json.dumps(config), int(time.time()))], "query string, run_type string, config string, created_at long"))
        self._status_row(change, 1, "running")
        change.finish()
        try:
            if run_type == "images":
                self._image_run(run_id, query, config)
                return run_id
            intent = planning.interpret(query, self.planner)
            fields = planning.named_only(fields or planning.plan_schema(intent, self.planner))
            searches = planning.plan_searches(intent, fields, self.planner)
            searches += planning.expand(searches, intent["languages"], self.planner)
            rows = [(str(k), q["query_text"], q["language"], q["priority"], k // 5, "pending") for k, q in enumerate(searches)]
            change = self._step(run_id)
            self._schema(change, fields, confirm)
            change.replace("search_queries", self._row(rows, "query_id string, query_text string, language string, priority int, batch_number int, status string"))
            self._done(change, "plan")
            self._commit(change)
        except Exception as e:
            self._fail(run_id, e)
            raise
        if not confirm:
            self._set(run_id, "pending", ("running",))
            return run_id
        return self._continue(run_id)

    def confirm_schema(self, run_id: str, fields: list[Field] | None = None) -> str:
        """Go on with a run that waits for its schema, with these columns if any are given."""
        if self._status(run_id) != "pending":
            raise ValueError("the run doesn't wait for a schema")
        fields = planning.named_only(fields or self.get_run_schema(run_id))
        change = self._step(run_id)
        self._schema(change, fields, True)
        self._commit(change)
        self._set(run_id, "running", ("pending",))
        return self._continue(run_id)

    def cancel_run(self, run_id: str) -> None:
        """End the run; what the step or batch it is in makes is thrown away."""
        self._set(run_id, "cancelled")

    def pause_run(self, run_id: str) -> None:
        """The run stops after the step or batch it is in."""
        self._set(run_id, "paused")

    def resume_run(self, run_id: str) -> str:
        """Go on with a run that is paused, or is still called running though its driver was lost."""
        if self._status(run_id) not in ("paused", "running"):
            raise ValueError("the run isn't paused")
        self._set(run_id, "running", ("paused", "running"))
        return self._continue(run_id)

    def _row(self, rows: list[tuple], kinds: str) -> DataFrame:
        return self.spark.createDataFrame(rows, kinds)

    def _status(self, run_id: str) -> str | None:
        found = self.catalog.of_run("run_status", run_id).agg(F.max_by("status", "seq")).first()
        return found[0] if found else None

    def _status_row(self, change: CatalogChange, seq: int, status: str, error: str | None = None, stats: str | None = None) -> None:
        change.put("run_status", self._row([(seq, status, error, stats, int(time.time()))], "seq long, status string, error string, stats string, at long"), f"{seq}")

    def _set(self, run_id: str, status: str, of: tuple[str, ...] = ("pending", "running", "paused"), error: str | None = None, stats: str | None = None) -> None:
        """The run's next status, if it now has one of these; otherwise ValueError."""
        while True:
            change = self._step(run_id)
            last = self.catalog.of_run("run_status", run_id).agg(F.max("seq").alias("seq"), F.max_by("status", "seq").alias("status")).first()
            if last["status"] not in of:
                raise ValueError("the run isn't active" if "running" in of else f"the run isn't {of[0]}")
            self._status_row(change, last["seq"] + 1, status, error, stats)
            try:
                change.finish()
                return
            except Conflict:
                continue  # another status came first

    def _fail(self, run_id: str, error: Exception) -> None:
        with contextlib.suppress(ValueError):  # it was cancelled
            self._set(run_id, "failed", error=str(error)[:500])

    def _step(self, run_id: str) -> CatalogChange:
        """The changes of a step, which nobody may have given the run another status meanwhile."""
        return self.catalog.change(run_id, ["run_status/*"])

    def _commit(self, change: CatalogChange) -> bool:
        """Commit a step; False, and nothing is written, if the run has come to its end meanwhile."""
        while True:
            change.rebase()
            if self._status(change.scope) in (None, *TERMINAL):
                return False
            try:
                change.finish()
                return True
            except Conflict:
                continue  # a status came between the look and the commit

    def _schema(self, change: CatalogChange, fields: list[Field], confirmed: bool) -> None:
        change.replace("run_schemas", self._row([(json.dumps([f._asdict() for f in fields]), confirmed, int(time.time()))], "columns string, confirmed boolean, created_at long"))

    def _done(self, change: CatalogChange, step: str, *more: str) -> None:
        """Lines of the log with the step's commit."""
        first = self.catalog.of_run("run_logs", change.scope).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] + 1
        lines = [(first + k, "info", m, int(time.time())) for k, m in enumerate((*more, f"done: {step}"))]
        change.put("run_logs", self._row(lines, "id long, level string, message string, at long"), f"{step}")

    def _is_done(self, run_id: str, step: str) -> bool:
        return not self.catalog.of_run("run_logs", run_id).where(F.col("message") == f"done: {step}").isEmpty()

    def _told(self, run_id: str, what: str) -> str | None:
        """What the log says after `what`, in the last line that begins with it."""
        found = self.catalog.of_run("run_logs", run_id).where(F.col("message").startswith(what)).agg(F.max_by("message", "id")).first()[0]
        return found.removeprefix(what) if found else None

    def _continue(self, run_id: str) -> str:
        config = json.loads(self.get_run(run_id)["config"])
        fields = self.get_run_schema(run_id)
        try:
            for step, work in (("search", self._search), ("extract", self._extract), ("dedup", self._dedup)):
                if self._status(run_id) != "running":
                    return run_id
                if not self._is_done(run_id, step) and not work(run_id, fields, config):
                    return run_id
            with contextlib.suppress(ValueError):  # paused or cancelled in the last step
                self._set(run_id, "completed", ("running",), stats=json.dumps(self._stats(run_id)))
        except Exception as e:
            self._fail(run_id, e)
            raise
        return run_id

    def _search(self, run_id: str, fields: list[Field], config: dict) -> bool:
        change = self._step(run_id)
        if isinstance(self.search, providers.CorpusSearch):
            self.search.per_query = int(float(config["search_results_per_query"]))
        queries = written(self.catalog.of_run("search_queries", run_id).withColumn("query_id", F.col("query_id").cast("long")), "queries")
        found = written(self.search.search(queries.select("query_id", "query_text")), "found").join(queries.select("query_id", "priority"), "query_id")
        counts = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("result_count"))
        ranked = flow.numbered(providers.collect_results(found), ["priority", "query_id", "position"], "rank")
        results = ranked.select(F.xxhash64("url").cast("string").alias("result_id"), F.col("query_id").cast("string"), "url", "title", "snippet", "rank", F.lit("pending").alias("status"))
        change.replace("search_results", results)
        told = queries.drop("result_count", "status", "run_id").join(counts, "query_id", "left").withColumns({"status": F.lit("completed"), "result_count": F.coalesce("result_count", F.lit(0))})
        seen = change.replace("search_queries", told, {"n": F.count(F.lit(1)), "failed": F.count_if(F.col("status") != "completed")})
        self._done(change, "search", f"searches: {json.dumps(seen)}")
        return self._commit(change)

    def _so_far(self, run_id: str) -> dict:
        """The sums of the run's batches."""
        sums = ("pages_fetched", "pages_failed", "rows", "valid", "llm_calls", "llm_micros", "millis")
        return self.catalog.of_run("run_batches", run_id).agg(F.coalesce(F.max("batch"), F.lit(0)).alias("batch"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums]).first().asDict()

    def _extract(self, run_id: str, fields: list[Field], config: dict) -> bool:
        """Fetch and extract pending results a batch at a time, until a limit is reached or none is left.

        The model is called once for a page. Counts come from the passes that write the rows.
        """
        searches = json.loads(self._told(run_id, "searches: "))["n"]
        limits = {"target_rows": float(config["target_row_count"]), "max_cost_micros": float(config["max_budget_usd"]) * 1e6, "max_seconds": float(config["max_duration_seconds"]), "saturation": float(config["saturation_threshold"])}
        cut = int(float(config["max_extraction_text_chars"])) if config["enable_content_truncation"] == "true" else None
        most = int(float(config["max_page_size_kb"])) * 1024
        total = self._so_far(run_id)
        while self._told(run_id, "done: stopped: ") is None:
            if self._status(run_id) != "running":
                return False
            began, key = time.time(), f"extract-{total['batch'] + 1}"
            batch = written(self.catalog.pending(run_id).limit(BATCH_PAGES), "batch")
            if batch.isEmpty():
                break
            change = self._step(run_id)
            fetched = written(providers.fetch(batch.select("result_id", "url"), self.pages, most, parsed_only=True), "fetched")
            docs = fetched.where("error is null").select("url", parse_html("html").alias("p")).select("url", "p.title", "p.text")
            docs = docs.repartition(max(1, int(float(config["max_parallel_extractions"])))) if self.model else docs
            told = providers.answers(docs, self.model or providers.TitleExtractor(), fields, cut if self.model else None)
            asked, usage = written_and_counted(told, "answers", {"llm_calls": F.count(F.lit(1)), "llm_micros": F.coalesce(F.sum(flow.llm_micros(F.col("prompt_tokens"), F.col("completion_tokens"))), F.lit(0))})
            usage = usage if self.model else dict.fromkeys(usage, 0)
            rows = in_order(validate(providers.answered_rows(asked), fields, float(config["min_confidence_threshold"])))
            made = rows.select(F.concat(F.lit(f"{run_id}-"), F.col("seq") + total["rows"]).alias("entity_row_id"), (F.col("seq") + total["rows"]).alias("seq"), "data", "confidence", F.when(F.col("is_valid"), "valid").otherwise("invalid").alias("status"), "source_url", "source_title", F.lit(int(time.time())).alias("created_at"))
            made = written(made, "rows")
            new = change.put("entity_rows", made, key, {"rows": F.count(F.lit(1)), "valid": F.count_if(F.col("status") == "valid")})
            change.put("row_sources", made.select("entity_row_id", F.col("source_url").alias("url"), F.col("source_title").alias("title"), "created_at"), key)
            new |= change.put("fetched_pages", fetched.select("result_id", F.col("result_id").alias("page_id"), "url", "error", F.lit(int(time.time())).alias("fetched_at")), key, {"pages_fetched": F.count_if(F.col("error").isNull()), "pages_failed": F.count_if(F.col("error").isNotNull())})
            new |= usage | {"millis": int((time.time() - began) * 1000)}
            total = {k: v + new[k] if k in new else v + 1 for k, v in total.items()}
            cost = searches * SEARCH_MICROS + total["llm_micros"]
            reason = self.spark.range(1).select(flow.stop_reason(F.lit(total["valid"]), F.lit(cost), F.lit(total["millis"] / 1000), F.lit(new["valid"]), F.lit(new["rows"]), limits)).first()[0]
            kinds = "batch long, pages_fetched long, pages_failed long, rows long, valid long, llm_calls long, llm_micros long, millis long, stop_reason string"
            change.put("run_batches", self._row([tuple((new | {"batch": total["batch"], "stop_reason": reason})[x.split()[0]] for x in kinds.split(", "))], kinds), key)
            if reason:
                self._done(change, f"stopped: {reason}")
            if not self._commit(change):
                return False
        if self._status(run_id) != "running":
            return False
        change = self._step(run_id)
        state = self.catalog.of_run("fetched_pages", run_id).select("result_id", F.when(F.col("error").isNull(), "fetched").otherwise("failed").alias("_new"))
        told = self.catalog.of_run("search_results", run_id).join(state, "result_id", "left").withColumn("status", F.coalesce("_new", "status")).drop("_new")
        change.replace("search_results", told)
        self._done(change, "extract")
        return self._commit(change)

    def _dedup(self, run_id: str, fields: list[Field], config: dict) -> bool:
        """Keep the members with their group, and put a final row with merged data beside them for each group.

        Done again, it starts from the same members and gives the same groups.
        """
        change = self._step(run_id)
        rows = written(self.catalog.of_run("entity_rows", run_id).where("status <> 'final'"), "members")
        urls = self.catalog.of_run("row_sources", run_id).select("entity_row_id", F.col("url").alias("source_url"))
        valid = rows.where("status in ('valid', 'merged')").join(urls, "entity_row_id")
        grouped = written(with_leaders(valid, name_field(fields), fields, float(config["dedup_similarity_threshold"])), "groups")
        merged = merge_groups(grouped, "leader", [f.name for f in fields])
        group = F.concat(F.lit(f"{run_id}-g"), F.col("leader"))
        final = merged.select(group.alias("entity_row_id"), F.col("leader").alias("seq"), F.to_json(F.struct(*[f.name for f in fields])).alias("data"), "confidence", F.lit("final").alias("status"), group.alias("dedup_group_id"), F.lit(int(time.time())).alias("created_at"), "sources")
        final = written(final, "final")
        members = rows.drop("dedup_group_id").join(grouped.select("seq", group.alias("dedup_group_id")), "seq", "left")
        members = members.withColumn("status", F.when(F.col("dedup_group_id").isNotNull(), "merged").otherwise(F.col("status")))
        columns = ["entity_row_id", "seq", "data", "confidence", "status", "dedup_group_id", "created_at"]
        seen = change.replace("entity_rows", members.select(*columns).unionByName(final.select(*columns)), {"rows_valid": F.count_if(F.col("status") == "merged"), "unique_rows": F.count_if(F.col("status") == "final")})
        change.put("row_sources", final.select("entity_row_id", F.explode("sources").alias("url"), "created_at"), "dedup")
        self._done(change, "dedup", f"rows: {json.dumps(seen)}")
        return self._commit(change)

    def _stats(self, run_id: str) -> dict:
        """Counts that the steps have left; no table of rows is read again."""
        found, searches, batches = json.loads(self._told(run_id, "rows: ")), json.loads(self._told(run_id, "searches: ")), self._so_far(run_id)
        spent = searches["n"] * SEARCH_MICROS + batches["llm_micros"]
        return {
            **found, "rows_found": found["unique_rows"], "duplicates_merged": found["rows_valid"] - found["unique_rows"],
            "pages_fetched": batches["pages_fetched"], "pages_failed": batches["pages_failed"], "queries_executed": searches["n"], "queries_failed": searches["failed"],
            "spent_usd": spent / 1e6, "llm_calls": batches["llm_calls"], "search_calls": searches["n"],
            "elapsed_secs": max(0, int(time.time()) - self.get_run(run_id)["created_at"]), "stop_reason": self._told(run_id, "done: stopped: "),
        }

    def _image_run(self, run_id: str, query: str, config: dict) -> None:
        change = self._step(run_id)
        queries = written(images.image_queries(self.spark, query, self.planner if not isinstance(self.planner, planning.OfflineModel) else None), "queries")
        change.put("search_queries", queries.select(F.col("query_id").cast("string"), "query_text", F.lit("completed").alias("status")))
        found = images.collect_images(written(self.image_search.search_images(queries), "found"))
        best = images.best_images(images.score_images(found, query, self.planner), most=int(float(config["target_row_count"])))
        seen = change.put("image_results", best.withColumn("created_at", F.lit(int(time.time()))), counts={"images": F.count(F.lit(1))})
        if self._commit(change):
            with contextlib.suppress(ValueError):
                self._set(run_id, "completed", ("running",), stats=json.dumps(seen))

    # reads

    def get_run(self, run_id: str):
        """The run with its status, or None."""
        return self.catalog.runs(limit=None).where(F.col("run_id") == run_id).first()

    def list_runs(self, limit: int = 50, offset: int = 0) -> DataFrame:
        return self.catalog.runs(limit, offset).drop("config")

    def get_run_schema(self, run_id: str) -> list[Field]:
        """The columns; none for a run without a schema, or whose columns can't be read."""
        found = self.catalog.schema_of(run_id)
        try:
            return [Field(**c) for c in json.loads(found["columns"])] if found else []
        except (ValueError, TypeError):
            return []

    def get_run_rows(self, run_id: str) -> DataFrame:
        """The final rows with their sources, in order of seq."""
        rows = self.catalog.of_run("entity_rows", run_id).where("status = 'final'")
        return sinks.with_sources(rows, self.catalog.of_run("row_sources", run_id).drop("run_id")).orderBy("seq")

    def get_run_logs(self, run_id: str, level: str | None = None, most: int = 1000) -> DataFrame:
        """The newest lines."""
        logs = self.catalog.of_run("run_logs", run_id)
        return (logs if level is None else logs.where(F.col("level") == level)).orderBy(F.desc("id")).limit(most)

    def get_image_results(self, run_id: str) -> DataFrame:
        return self.catalog.of_run("image_results", run_id).orderBy(F.desc_nulls_last("score"), "idx")

    def proxy_image(self, pages: DataFrame, url: str) -> str | None:
        """An image of a table (url, content, content_type) as a data URL; null if it is absent, no image or over 10 MiB."""
        one = pages.where((F.col("url") == url) & F.col("content_type").startswith("image/") & (F.octet_length("content") <= 10 << 20))
        found = one.select(data_url(F.col("content"), F.col("content_type")).alias("d")).first()
        return found["d"] if found else None

    def export_run(self, run_id: str, path: str, kind: str, fields: list[str] | None = None) -> None:
        """Export a run's final rows, or its images: CSV, JSON or XLSX by kind."""
        if self.get_run(run_id)["run_type"] == "images":
            sinks.export(image_rows(self.get_image_results(run_id)), IMAGE_COLUMNS, path, kind)
        else:
            sinks.export(self.get_run_rows(run_id), fields or [f.name for f in self.get_run_schema(run_id)], path, kind)

    def delete_run(self, run_id: str) -> None:
        self.catalog.delete(run_id)

    # settings

    def get_settings(self) -> dict[str, str]:
        return {r["key"]: r["value"] for r in self.catalog.settings().collect()}

    def get_setting(self, key: str) -> str | None:
        return self.get_settings().get(key)

    def update_setting(self, key: str, value: str) -> None:
        self.catalog.set_setting(key, value)


#: The columns of an image export.
IMAGE_COLUMNS = ["title", "image_url", "thumbnail_url", "source_url", "width", "height", "score"]


def image_rows(found: DataFrame) -> DataFrame:
    """Image results as rows to export: seq, data of IMAGE_COLUMNS (absent sizes and scores empty), confidence, sources."""
    cell = {c: F.coalesce(format_2dp(F.col(c)) if c == "score" else F.col(c).cast("string"), F.lit("")).alias(c) for c in IMAGE_COLUMNS}
    source = F.array(F.struct(F.col("source_url").alias("url"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("snippet")))
    return found.select(F.col("idx").alias("seq"), F.to_json(F.struct(*cell.values())).alias("data"), F.coalesce("score", F.lit(0.0)).alias("confidence"), source.alias("sources"))


def rank_images(found: DataFrame, k: int, least: float = images.LEAST_SCORE) -> DataFrame:
    """images (idx, image_url, score) -> the k best distinct ones of at least this score, ties by idx."""
    return images.best_images(first_by_key(found, "image_url", ["idx"]), least, k)


def run_stats(results: DataFrame) -> DataFrame:
    """results (run_id, fetched boolean, query) -> counts and percent of a run."""
    ok, n = F.count_if("fetched"), F.count(F.lit(1))
    return results.groupBy("run_id").agg(n.alias("rows_found"), ok.alias("pages_fetched"), (n - ok).alias("pages_failed"), F.countDistinct("query").alias("queries_executed"), F.round(100.0 * ok / n).cast("long").alias("percent"))


def last_of(rows: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")
