"""Jobs: names, attempts, queue, progress and state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The stages in order, and those that end or occupy a job.
STAGES = ("upload", "extraction", "ocr_layout_parsing", "structure_generation", "translation", "pdf_generation", "complete")
TERMINAL = ("complete", "failed", "cancelled")
ACTIVE = ("extraction", "ocr_layout_parsing", "structure_generation", "translation", "pdf_generation")


def attempt_name(name: Column, attempt: Column) -> Column:
    """`stem (n).ext` for the nth repetition, the name itself for the first attempt."""
    stem, ext = F.regexp_extract(name, r"^(.+?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.+?)(\.[^.]*)?$", 2)
    return F.when(attempt <= 0, name).otherwise(F.concat(stem, F.lit(" ("), attempt.cast("string"), F.lit(")"), ext))


def source_name(name: Column) -> Column:
    """A name without the number of its attempt."""
    return F.when(name.rlike(r"^.+\s\(\d+\)(\.[^.]*)?$"), F.regexp_replace(name, r"\s\(\d+\)(\.[^.]*)?$", "$1")).otherwise(name)


def rerun_name(name: Column) -> Column:
    return F.regexp_replace(name, r"^(.+?)(\.[^.]*)?$", "$1 OCR rerun$2")


def next_attempts(jobs: DataFrame) -> DataFrame:
    """The next attempt's number and name for each source file."""
    grouped = jobs.groupBy(source_name(F.col("filename")).alias("source")).agg((F.max(F.coalesce("attempt", F.lit(0))) + 1).alias("next_attempt"))
    return grouped.withColumn("next_name", attempt_name(F.col("source"), F.col("next_attempt")))


def latest(jobs: DataFrame) -> DataFrame:
    """The last update of each job: one partial maximum, no window."""
    rest = [c for c in jobs.columns if c != "job_id"]
    return jobs.groupBy("job_id").agg(F.max_by(F.struct(*rest), "event_id").alias("s")).select("job_id", "s.*")


def queue_messages(queued: DataFrame, active: Column) -> DataFrame:
    """What each queued job is told; one is ahead of all if a job is `active`."""
    ahead = F.row_number().over(Window.partitionBy("queue").orderBy("arrival")) - 1 + active.cast("int")
    message = F.when(F.col("ahead") > 0, F.concat(F.lit("Queued. Waiting for "), F.col("ahead").cast("string"), F.lit(" job(s) ahead."))).otherwise("Queued. Waiting for processing to start.")
    return queued.withColumn("ahead", ahead).withColumn("message", message)


def transitions(jobs: DataFrame) -> DataFrame:
    """Each update with the stage before and whether the step is allowed: forward, or to an end from a stage that is not one."""
    before = F.lag("stage").over(Window.partitionBy("job_id").orderBy("event_id"))
    rank = lambda c: F.array_position(F.array(*map(F.lit, STAGES)), c)
    ended = F.col("previous").isin(*TERMINAL)
    allowed = F.when(F.col("previous").isNull(), F.col("stage") == STAGES[0]).when(ended, False).when(F.col("stage").isin("cancelled", "failed"), True)
    return jobs.withColumn("previous", before).withColumn("allowed", allowed.otherwise(rank(F.col("stage")) >= rank(F.col("previous"))))


def stage_counts(jobs: DataFrame) -> DataFrame:
    """How many jobs have ended, are being worked on or wait, by their last update."""
    now = latest(jobs)
    return now.agg(F.count_if(F.col("stage").isin(*TERMINAL)).alias("ended"), F.count_if(F.col("stage").isin(*ACTIVE)).alias("active"), F.count_if(F.col("stage") == "upload").alias("waiting"))


def _positive(c: Column) -> Column:
    whole = c.try_cast("int")
    return F.when(whole > 0, whole)


def ocr_progress(events: DataFrame) -> DataFrame:
    """Worker events (event, phase, index, total, pages, chars) with progress and message; both null for what says nothing."""
    index, total, pages, chars = (_positive(F.col(c)) for c in ("index", "total", "pages", "chars"))
    label = F.when(F.coalesce("phase", F.lit("primary")).isin("primary", ""), "OCR selected regions").otherwise("Retrying empty OCR regions")
    counted = index.isNotNull() & total.isNotNull()
    share = lambda n: F.bround(0.36 + 0.48 * F.greatest(F.lit(0.0), F.least(n / total, F.lit(1.0))), 3)
    at = F.concat(label, F.lit(": "), index.cast("string"), F.lit("/"), total.cast("string"))
    note = F.coalesce(F.concat(F.lit("; "), chars.cast("string"), F.lit(" characters")), F.lit(""))
    started, done = (F.col("event") == "page_started") & counted, (F.col("event") == "page_done") & counted
    progress = F.when(F.col("event") == "model_loading", 0.35).when(F.col("event") == "model_loaded", 0.36).when(started, share(index - 1)).when(done, share(index))
    message = (
        F.when(F.col("event") == "model_loading", "Loading OCR model for selected regions")
        .when(
            F.col("event") == "model_loaded",
            F.coalesce(F.concat(F.lit("OCR model loaded; processing "), pages.cast("string"), F.lit(" selected region(s)")), F.lit("OCR model loaded; processing selected regions")),
        )
        .when(started, at)
        .when(done, F.concat(at, F.lit(" complete"), note))
    )
    return events.withColumn("progress", progress).withColumn("message", message)


def translation_progress(events: DataFrame) -> DataFrame:
    """Progress of chunk and table events (event, index, total)."""
    share = F.col("index") / F.greatest("total", F.lit(1))
    progress = (
        F.when(F.col("event") == "chunk_started", 0.7)
        .when(F.col("event") == "chunk_translated", F.bround(F.least(0.7 + 0.18 * share, F.lit(0.88)), 3))
        .when(F.col("event") == "table_progress", F.bround(F.least(0.88 + 0.08 * share, F.lit(0.96)), 3))
    )
    return events.withColumn("progress", progress)


def progress_label(stage: Column, message: Column, percent: Column) -> Column:
    counter = F.regexp_extract(F.coalesce(message, F.lit("")), r"\b(\d+\s*/\s*\d+)\b", 1)
    counted = (stage == "ocr_layout_parsing") & (counter != "")
    return F.when(counted, F.concat(F.lit("OCR "), F.regexp_replace(counter, r"\s+", ""))).otherwise(F.concat(percent.cast("string"), F.lit("%")))


def start_decision(has_results: Column, n_nonempty: Column, mode: Column, fallback: Column) -> Column:
    """How a job starts: on selected regions, on full pages, or not."""
    wanted = F.when(mode.isin("selected_regions", "full_page"), mode).otherwise("selected_regions")
    return F.when(wanted == "full_page", "full_page").when(~has_results & fallback, "full_page").when(~has_results, "error: no results").when(n_nonempty == 0, "error: no text").otherwise("selected_regions")


def cache_choice(has_pages: Column, has_regions: Column) -> Column:
    """Which cached recognition a repeated translation uses."""
    return F.when(has_pages, "full_page").when(has_regions, "selected_regions").otherwise("error: no cache")


def rerun_eligible(stage: Column) -> Column:
    return ~stage.isin(*ACTIVE)
