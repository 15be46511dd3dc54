"""A store of jobs as tables, with the steps of document processing as methods."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import text as T
from quire.operators import backends, compiling, jobs, layout, markdown, translation
from quire.sources import files


class NotFound(LookupError):
    """A job, its file or an artefact is missing."""


class Conflict(RuntimeError):
    """Saved regions would be replaced, or the job is being worked on."""


class Invalid(ValueError):
    """Nothing is selected, or nothing was recognised."""


#: What a job may leave.
KINDS = ("pages", "regions", "page_texts", "first_results", "results", "blocks", "tables", "chunks", "translated", "translated_tables")


@dataclass
class Engine:
    """Tables `jobs` and `KINDS` under `root`, one folder a job in each."""

    spark: SparkSession
    root: str

    def _path(self, name: str, job: str) -> str:
        return f"{self.root}/{name}/job_id={job}"

    def _save(self, rows: DataFrame, name: str, job: str) -> None:
        rows.write.mode("overwrite").parquet(self._path(name, job))

    def _has(self, name: str, job: str) -> bool:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self._path(name, job))
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _load(self, name: str, job: str) -> DataFrame:
        if not self._has(name, job):
            raise NotFound(f"{name} of job {job}")
        return self.spark.read.parquet(self._path(name, job))

    # Jobs

    def ingest(self, job: str, filename: str, pages: DataFrame) -> None:
        """A new job with its pages (doc_id, page_number, ...); its name tells which attempt at the file it is."""
        source = filename
        before = self.jobs()
        attempt = 0
        if before is not None:
            same = before.where(jobs.source_name(F.col("source")) == source).agg(F.max("attempt")).first()[0]
            attempt = 0 if same is None else same + 1
        name = jobs.attempt_name(F.lit(filename), F.lit(attempt))
        row = self.spark.range(1).select(F.lit(job).alias("id"), name.alias("filename"), F.lit(source).alias("source"), F.lit(attempt).alias("attempt"), F.lit("upload").alias("stage"))
        self._save(row, "jobs", job)
        self._save(pages, "pages", job)

    def jobs(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.root}/jobs")
        except Exception as error:  # no job yet
            if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
                return None
            raise

    def status(self, job: str) -> dict:
        return self._load("jobs", job).first().asDict()

    def set_stage(self, job: str, stage: str) -> None:
        row = self.status(job) | {"stage": stage}
        self._save(self.spark.createDataFrame([tuple(row.values())], list(row)).withColumn("attempt", F.col("attempt").cast("int")), "jobs", job)

    def cleanup(self) -> int:
        """Removes the jobs that have ended; how many."""
        known = self.jobs()
        ended = [] if known is None else [r["id"] for r in known.where(F.col("stage").isin(*jobs.TERMINAL)).select("id").collect()]
        jvm = self.spark._jvm
        for job in ended:
            for name in (*KINDS, "jobs"):
                at = jvm.org.apache.hadoop.fs.Path(self._path(name, job))
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        return len(ended)

    def duplicate(self, job: str, new: str) -> None:
        """A job with the same pages and regions, without results; not while the old one is being worked on."""
        old = self.status(job)
        if old["stage"] in jobs.ACTIVE:
            raise Conflict(f"job {job} is being worked on")
        name = self.spark.range(1).select(jobs.rerun_name(F.lit(old["source"]))).first()[0]
        self.ingest(new, name, self._load("pages", job))
        if self._has("regions", job):
            self._save(self._load("regions", job), "regions", new)

    # Regions and recognition

    def regions(self, job: str, detected: DataFrame | None = None, refresh: bool = False, confirmed: bool = False) -> DataFrame:
        """Saved regions, or detected or full-page ones, which are saved; to replace saved ones takes a confirmation."""
        if self._has("regions", job):
            if not refresh:
                return self._load("regions", job)
            if not confirmed:
                raise Conflict(f"job {job} has saved regions")
        found = layout.default_regions(self._load("pages", job).select("doc_id", "page_number").distinct()) if detected is None else detected
        self.save_regions(job, found)
        return self._load("regions", job)

    def save_regions(self, job: str, regions: DataFrame) -> None:
        self._save(layout.reindexed(regions), "regions", job)

    def boxes_summary(self, job: str) -> DataFrame:
        return layout.boxes_summary(self._load("regions", job))

    def inspect(self, job: str) -> DataFrame:
        """The job's pages: their number, selected regions and whether any text is known for them."""
        pages = self._load("pages", job).select("doc_id", "page_number").distinct()
        chosen = layout.selected(self._load("regions", job)) if self._has("regions", job) else None
        read = self.ocr_results(job).where(T.strip(F.col("ocr_text")) != "") if self._has("results", job) else None
        for rows, name in ((chosen, "n_selected"), (read, "n_with_text")):
            counts = pages.withColumn(name, F.lit(0).cast("long")) if rows is None else rows.groupBy("doc_id", "page_number").agg(F.count("*").alias(name))
            pages = counts if rows is None else pages.join(counts, ["doc_id", "page_number"], "left").fillna(0, [name])
        return pages

    def run_ocr(
        self, job: str, images: Callable[[DataFrame], DataFrame], backend: Callable[[], backends.OcrBackend], retry_images: Callable[[DataFrame], DataFrame] | None = None
    ) -> DataFrame:
        """Recognises the selected regions; `images` adds each one's name and image. Regions whose text is blank are
        recognised again from the image that `retry_images` adds to them; a text that is then not blank replaces it."""
        chosen = layout.selected(self._load("regions", job))
        if chosen.isEmpty():
            raise Invalid(f"job {job} has no selected regions")
        rows = chosen.select("doc_id", "page_number", "reading_order", F.col("id").alias("box_id"), F.col("type").alias("box_type"))
        found = backends.recognized(images(rows), backend)
        if retry_images is not None:
            self._save(found, "first_results", job)  # so that the model reads each image once
            first = self._load("first_results", job)
            blank = first.where(T.strip(F.col("ocr_text")) == "").select(*rows.columns)
            found = backends.with_retries(first, backends.recognized(retry_images(blank), backend))
        self._save(found, "results", job)
        return self.ocr_results(job)

    def ocr_results(self, job: str) -> DataFrame:
        return self._load("results", job)

    def artifacts(self, job: str) -> list[str]:
        return [name for name in KINDS if self._has(name, job)]

    # Documents and translation

    def build(self, job: str, continuous: bool = True) -> DataFrame:
        """Blocks (doc_id, page_number, block_ord, block_type, text) from the recognised regions."""
        results = self.ocr_results(job)
        if results.where(T.strip(F.col("ocr_text")) != "").isEmpty():
            raise Invalid(f"nothing was recognised for job {job}")
        if continuous:
            texts = compiling.compiled(results).select("doc_id", F.lit(1).alias("page_number"), "text")
        else:
            items = F.array_sort(F.collect_list(F.struct("reading_order", "box_id", "ocr_text")))
            texts = results.groupBy("doc_id", "page_number").agg(F.array_join(F.transform(items, lambda x: x["ocr_text"]), "\n\n").alias("text"))
        return self.build_from_pages(job, texts)

    def build_from_pages(self, job: str, texts: DataFrame) -> DataFrame:
        """Blocks and tables of a job from its pages' markdown (doc_id, page_number, text)."""
        lines = texts.select("doc_id", "page_number", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        self._save(markdown.blocks(lines), "blocks", job)
        named = F.concat_ws("-", F.col("doc_id").cast("string"), F.col("page_number").cast("string"), F.col("table_ord").cast("string"))
        self._save(markdown.tables(lines).withColumn("table_id", named), "tables", job)
        return self._load("blocks", job)

    def full_page(self, job: str, images: Callable[[DataFrame], DataFrame], backend: Callable[[], backends.OcrBackend]) -> DataFrame:
        """Blocks from whole pages: each page's image is recognised as markdown, with which its blocks and tables are built."""
        pages = self._load("pages", job).select("doc_id", "page_number").distinct()
        self._save(backends.recognized(images(pages), backend).select("doc_id", "page_number", F.col("ocr_text").alias("text")), "page_texts", job)
        texts = self._load("page_texts", job)
        if texts.where(T.strip(F.col("text")) != "").isEmpty():
            raise Invalid(f"nothing was recognised for job {job}")
        return self.build_from_pages(job, texts)

    def tables(self, job: str, translated: bool = False) -> DataFrame:
        """The tables of a job's document (headers and rows of cells), as they were read or as translated."""
        return self._load("translated_tables" if translated else "tables", job)

    def translate(self, job: str, translator: translation.Factory, chunk_size: int = 0, max_tokens: int = translation.MAX_TOKENS) -> DataFrame:
        """Blocks with their translations; those of tables, header and rows as units of their own, are `tables(job, translated=True)`.

        `translator` makes the model, once a worker. Blocks from markdown have no boxes, so none are merged.
        """
        blocks = self._load("blocks", job).withColumn("block_id", F.concat(F.col("doc_id").cast("string"), F.lit("-"), "block_ord"))
        placed = blocks.select("*", F.lit(0.0).alias("x0"), F.lit(None).cast("double").alias("y0"), F.lit(None).cast("double").alias("y1"), F.lit(10.0).alias("font_size"))
        found = translation.units(placed.where("block_type <> 'table'"))
        tables = self._load("tables", job)
        last = found.groupBy("doc_id").agg(F.max("unit_ord").alias("last"))
        parts = translation.table_units(tables, F.lit("")).join(last, "doc_id", "left")
        order = Window.partitionBy("doc_id").orderBy("page_number", "table_ord", "row_ord")
        parts = parts.withColumn("unit_ord", F.coalesce("last", F.lit(0)) + F.row_number().over(order)).select(*found.columns)
        chunks = translation.chunked(found.unionByName(parts), chunk_size)
        chunks = chunks.withColumn("skipped", T.skip_translation(F.col("source_text"), backends.detected_language(F.col("source_text"))))
        self._save(translation.translated(chunks, translator, max_tokens), "chunks", job)
        done = translation.coalesced(self._load("chunks", job))
        self._save(translation.applied_to_tables(tables, done), "translated_tables", job)
        self._save(translation.applied(blocks, done), "translated", job)
        return self._load("translated", job)

    def retranslate(self, job: str, new: str, translator: translation.Factory, chunk_size: int = 0) -> DataFrame:
        """A new job that translates what was recognised for an old one: its cached full pages, else its regions' texts."""
        choice = jobs.cache_choice(F.lit(self._has("page_texts", job)), F.lit(self._has("results", job)))
        found = self.spark.range(1).select(choice).first()[0]
        if found.startswith("error"):
            raise NotFound(f"nothing is cached for job {job}")
        self.ingest(new, self.status(job)["source"], self._load("pages", job))
        for name in ("regions", "results", "page_texts"):
            if self._has(name, job):
                self._save(self._load(name, job), name, new)
        if found == "full_page":
            self.build_from_pages(new, self._load("page_texts", new))
        else:
            self.build(new)
        return self.translate(new, translator, chunk_size)

    def events(self, path: str) -> DataFrame:
        return jobs.ocr_progress(files.parsed_events(self.spark.read.text(path)))
