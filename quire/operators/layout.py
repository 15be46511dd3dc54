"""Regions of a page: type guesses, reading order, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.text import count, strip

# Fixed values of the reading order and the detectors.
MIN_GAP, GAP_SHARE, MIN_BOXES, MIN_SIDE = 0.12, 0.22, 4, 2
MIN_QUALITY, MIN_REGIONS, DEFAULT_INSET, FALLBACK_INSET = 0.3, 2, 0.03, 0.02
BLOCK_TYPES = {
    "page": "paragraph", "text": "paragraph", "table": "table", "figure": "figure", "caption": "caption",
    "header": "header", "footer": "footer", "reference": "reference", "other": "unknown",
}


def block_type(region_type: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in BLOCK_TYPES.items() for x in pair))
    return F.coalesce(F.try_element_at(table, region_type), F.lit("unknown"))


def guess_type(text: Column, y0: Column, y1: Column, height: Column) -> Column:
    """A region's type by its words, then its place, then its pipes; the first that fits."""
    low = F.lower(strip(text))
    return (
        F.when(low == "", "other")
        .when(low.rlike(r"^references?$") | low.rlike(r"^\[\d+\]"), "reference")
        .when(low.rlike(r"^(figure|fig\.)\s*\d+") | low.rlike(r"^table\s*\d+"), "caption")
        .when(y1 <= height * 0.1, "header")
        .when(y0 >= height * 0.9, "footer")
        .when(count(text, r"\|") >= 3, "table")
        .otherwise("text")
    )


def reindexed(regions: DataFrame) -> DataFrame:
    """Reading order 1, 2, ... a page by (reading_order, y0, x0, id)."""
    page = Window.partitionBy("doc_id", "page_number").orderBy("reading_order", "y0", "x0", "id")
    return regions.withColumn("reading_order", F.row_number().over(page))


def in_columns(regions: DataFrame) -> DataFrame:
    """Reading order by columns: a page of four boxes or more is split once at its widest gap between centres, if
    that is wide enough and leaves two boxes on each side; columns go left to right, boxes top down."""
    page = Window.partitionBy("doc_id", "page_number")
    by_x = page.orderBy("centre", "y0", "id")
    rows = regions.withColumn("centre", (F.col("x0") + F.col("x1")) / 2)
    rows = rows.withColumn("at", F.row_number().over(by_x)).withColumn("gap", F.lead("centre").over(by_x) - F.col("centre"))
    rows = rows.withColumn("n", F.count("*").over(page)).withColumn("span", F.max("x1").over(page) - F.min("x0").over(page))
    rows = rows.withColumn("widest", F.max("gap").over(page))
    rows = rows.withColumn("cut", F.min(F.when(F.col("gap") == F.col("widest"), F.col("at"))).over(page))
    split = (F.col("n") >= MIN_BOXES) & (F.col("span") > 0) & (F.col("widest") >= F.greatest(F.lit(MIN_GAP), F.col("span") * GAP_SHARE))
    split = split & (F.least("cut", F.col("n") - F.col("cut")) >= MIN_SIDE)
    rows = rows.withColumn("side", F.when(F.coalesce(split, F.lit(False)) & (F.col("at") > F.col("cut")), 1).otherwise(0))
    order = page.orderBy("side", F.bround("y0", 4), F.bround("x0", 4), "reading_order", "id")
    return rows.withColumn("new_order", F.row_number().over(order)).drop("centre", "at", "gap", "n", "span", "widest", "cut", "side")


def detector_choice(pages: DataFrame) -> DataFrame:
    """Which detector's regions a page takes, from counts: good embedded text, else the fallback, else what there is."""
    good = F.col("has_embedded_text") & (F.col("quality") >= MIN_QUALITY) & (F.col("n_primary") >= MIN_REGIONS)
    choice = F.when(good, "primary").when(F.col("n_fallback") > 0, "fallback").when(F.col("n_primary") > 0, "primary").otherwise("fallback_full_page")
    return pages.withColumn("detector", choice)


def default_regions(pages: DataFrame) -> DataFrame:
    """One full-page region a page, inset a little."""
    return pages.select(
        "doc_id",
        "page_number",
        F.concat(F.lit("default-full-page-"), F.col("page_number").cast("string")).alias("id"),
        *(F.lit(v).alias(n) for n, v in (("x0", DEFAULT_INSET), ("y0", DEFAULT_INSET), ("x1", 1.0 - DEFAULT_INSET), ("y1", 1.0 - DEFAULT_INSET))),
        F.lit("normalized").alias("coordinate_space"),
        F.lit("page").alias("type"),
        F.lit(True).alias("selected"),
        F.lit(1).alias("reading_order"),
        F.lit("default_full_page").alias("source"),
    )


def selected(regions: DataFrame, pages: list[int] | None = None, ids: list[str] | None = None) -> DataFrame:
    """Selected regions, of some pages or with some ids if given."""
    found = regions.where("selected")
    if pages is not None:
        found = found.where(F.col("page_number").isin(*pages))
    if ids is not None:
        found = found.where(F.col("id").isin(*ids))
    return found


def resolved(saved: DataFrame, detected: DataFrame) -> DataFrame:
    """Saved regions of a page win over all detected ones."""
    missing = detected.join(saved.select("doc_id", "page_number").distinct(), ["doc_id", "page_number"], "left_anti")
    return saved.unionByName(missing)


def ocr_summary(results: DataFrame) -> DataFrame:
    """Regions with and without text, and pages, for each document."""
    full = strip(F.col("ocr_text")) != ""
    pages = results.groupBy("doc_id", "page_number").agg(F.count("*").alias("n"), F.count_if(full).alias("full"))
    listed = lambda c: F.array_join(F.array_sort(F.collect_list(c)), ",")
    return pages.groupBy("doc_id").agg(
        F.sum("n").alias("total_regions"),
        F.sum("full").alias("nonempty_regions"),
        F.sum(F.col("n") - F.col("full")).alias("empty_regions"),
        listed(F.when(F.col("full") > 0, F.col("page_number"))).alias("pages_with_text"),
        listed(F.when(F.col("full") == 0, F.col("page_number"))).alias("pages_without_text"),
    )


def boxes_summary(regions: DataFrame) -> DataFrame:
    pages = regions.groupBy("doc_id", "page_number").agg(F.count("*").alias("n"), F.count_if("selected").alias("s"))
    return pages.groupBy("doc_id").agg(
        F.count("*").alias("saved_pages"), F.sum("n").alias("n_regions"), F.sum("s").alias("n_selected"), F.array_join(F.array_sort(F.collect_list("page_number")), ",").alias("pages")
    )


def output_name(page: Column, box: Column) -> Column:
    return F.concat(F.format_string("p%04d_", page), F.regexp_replace(box, r"[^a-zA-Z0-9_-]", "_"))


def column_estimate(words: DataFrame) -> DataFrame:
    """Columns of a page by how many words (x0, page_width) lie left and right of its middle."""
    sides = words.groupBy("doc_id", "page_number").agg(F.count_if(F.col("x0") < F.col("page_width") / 2).alias("left"), F.count("*").alias("n"))
    right = F.col("n") - F.col("left")
    two = (F.least("left", right) >= 8) & (F.abs(F.col("left") - right) / F.greatest("n", F.lit(1)) < 0.8)
    return sides.select("doc_id", "page_number", F.when(two, 2).otherwise(1).alias("n_columns"))


def with_retries(primary: DataFrame, retried: DataFrame) -> DataFrame:
    """Results in which a retry's text replaces a blank one, if the retry is not blank itself."""
    again = retried.where(strip(F.col("ocr_text")) != "").select("doc_id", "box_id", F.col("ocr_text").alias("again"))
    joined = primary.join(again, ["doc_id", "box_id"], "left")
    blank = strip(F.col("ocr_text")) == ""
    return joined.withColumn("retried", blank & F.col("again").isNotNull()).withColumn("ocr_text", F.when(blank, F.coalesce("again", "ocr_text")).otherwise(F.col("ocr_text"))).drop("again")
