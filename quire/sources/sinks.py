"""Writers: documents, regions, reports and timings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import geometry
from quire.functions.html import markdown_html
from quire.functions.text import strip
from quire.operators.reports import profile, profile_summary


def write_documents(blocks: DataFrame, path: str) -> None:
    """One JSON document a line: doc_id and its blocks in order."""
    rest = [c for c in blocks.columns if c != "doc_id"]
    item = F.struct("block_ord", *(c for c in rest if c != "block_ord"))
    blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("blocks")).write.json(path)


def write_markdown(documents: DataFrame, path: str) -> None:
    """`markdown` of each document in a folder of its own."""
    documents.select("doc_id", "markdown").write.partitionBy("doc_id").option("lineSep", "\n").text(path)


def write_region_pages(regions: DataFrame, path: str) -> None:
    """A page's regions as one JSON object, in order."""
    rest = [c for c in regions.columns if c not in ("doc_id", "page_number", "reading_order", "id")]
    item = F.struct("reading_order", "id", *rest)
    regions.groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list(item)).alias("regions")).write.json(path)


def write_all_pages(regions: DataFrame, path: str) -> None:
    """A document's pages with their regions as one JSON object: doc_id and `pages`, by number."""
    rest = [c for c in regions.columns if c not in ("doc_id", "page_number", "reading_order", "id")]
    pages = regions.groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("reading_order", "id", *rest))).alias("regions"))
    pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "regions"))).alias("pages")).write.json(path)


def write_ocr_results(results: DataFrame, path: str) -> None:
    """A document's recognised regions as one JSON object: doc_id and `results`, in reading order; `files.ocr_results` reads them."""
    rest = [c for c in results.columns if c not in ("doc_id", "page_number", "reading_order", "box_id")]
    item = F.struct("page_number", "reading_order", "box_id", *rest)
    results.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("results")).write.json(path)


def source_markdown(pages: DataFrame, results: DataFrame) -> DataFrame:
    """(doc_id, markdown) of documents' sources: their page texts (doc_id, page_number, text) trimmed and joined by blank lines; for
    documents without any, their recognised regions with page markers."""
    item = F.struct("page_number", strip(F.col("text")).alias("text"))
    whole = pages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["text"]), "\n\n").alias("text"))
    full = whole.select("doc_id", F.concat(strip(F.col("text")), F.lit("\n")).alias("markdown"))
    return full.unionByName(region_markdown(results).join(full.select("doc_id"), "doc_id", "left_anti"))


def write_debug_boxes(regions: DataFrame, path: str) -> None:
    """Each region's geometry as JSON: its box in shares and in percent of the page, by document."""
    percent = F.struct(*(c.alias(n) for c, n in zip(geometry.percent(tuple(F.col(n) for n in ("x0", "y0", "x1", "y1"))), ("x", "y", "width", "height"), strict=True)))
    shown = regions.select("doc_id", "page_number", "id", "type", "reading_order", F.struct("x0", "y0", "x1", "y1").alias("bbox"), percent.alias("percent"))
    shown.write.partitionBy("doc_id").json(path)


def region_markdown(results: DataFrame) -> DataFrame:
    """(doc_id, markdown): texts in order with a marker before each page's first; blank texts are left out."""
    full = results.withColumn("text", strip(F.col("ocr_text"))).where("text <> ''")
    pages = full.groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("reading_order", "box_id", "text"))).alias("items"))
    page = F.concat(F.lit("<!-- page: "), F.col("page_number").cast("string"), F.lit(" -->\n\n"), F.array_join(F.transform("items", lambda x: x["text"]), "\n\n"))
    whole = pages.select("doc_id", "page_number", page.alias("page")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "page"))).alias("pages"))
    return whole.select("doc_id", F.array_join(F.transform("pages", lambda x: x["page"]), "\n\n").alias("markdown"))


def write_timings(timings: DataFrame, path: str) -> None:
    """JSON sums, CSV (page or ALL, stage, seconds to six places) and a summary in words, each in its folder."""
    sums = profile(timings)
    sums.write.json(f"{path}/json")
    rows = sums.select("job_id", F.coalesce(F.col("page").cast("string"), F.lit("ALL")).alias("page"), "stage", F.format_string("%.6f", "seconds").alias("seconds"))
    rows.write.option("header", True).csv(f"{path}/csv")
    said = profile_summary(timings)
    mean = F.when(F.col("n_pages") > 0, F.format_string(", %.2fs/page", "mean")).otherwise("")
    said.select(F.concat("job_id", F.lit(" "), "stage", F.lit(": "), F.format_string("%.2fs total", "total"), mean).alias("value")).write.text(f"{path}/summary")


def write_report(report: DataFrame, path: str) -> None:
    report.write.json(path)


def copied(rows: DataFrame, old: str, new: str, key: str = "job_id") -> DataFrame:
    """A job's rows under another job; an error if there are none."""
    found = rows.where(F.col(key) == old)
    if found.isEmpty():
        raise FileNotFoundError(f"nothing is cached for {old}")
    return found.withColumn(key, F.lit(new))


def decisions(pages: DataFrame) -> DataFrame:
    """(doc_id, decisions): why each page was read as it was, as a map from page to reason."""
    return pages.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("page_number").cast("string"), "reason")))).alias("decisions"))


#: Column rules of the output modes; `faithful` sets two columns.
MODE_CSS = {"readable": "", "faithful": "column-count: 2; column-gap: 8mm;", "debug_markdown": "white-space: pre-wrap; font-family: monospace;"}


def html_documents(documents: DataFrame, mode: str = "readable") -> DataFrame:
    """(doc_id, html): printable pages of documents (doc_id, title, markdown)."""
    return documents.select("doc_id", html_page(markdown_html(F.col("markdown")), F.col("title"), mode).alias("html"))


def html_page(body: Column, title: Column, mode: str = "readable") -> Column:
    """A printable page around a body that is HTML already."""
    head = F.concat(F.lit('<!doctype html>\n<html><head><meta charset="utf-8"><title>'), F.coalesce(title, F.lit("Translated Document")), F.lit("</title>"))
    style = f"<style>@page {{ size: A4; margin: 18mm 16mm; }} table {{ width: 100%; border-collapse: collapse; }} main {{ {MODE_CSS.get(mode, '')} }}</style></head><body><main>\n"
    return F.concat(head, F.lit(style), body, F.lit("\n</main></body></html>\n"))


def report_markdown(report: DataFrame) -> DataFrame:
    """(doc_id, markdown) of a report (doc_id, failure, fix, source and translated counts as maps, n_chunks, empty_ids, short_ids)."""
    keys = F.array_sort(F.map_keys("source_counts"))
    count = lambda m, k: F.coalesce(F.try_element_at(F.col(m), k).cast("string"), F.lit("0"))
    rows = F.array_join(F.transform(keys, lambda k: F.concat(F.lit("| "), k, F.lit(" | "), count("source_counts", k), F.lit(" | "), count("translated_counts", k), F.lit(" |"))), "\n")
    listed = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", "none").otherwise(F.col(c))
    text = F.concat_ws(
        "\n",
        F.lit("# Translation Comparison Report\n"),
        F.concat(F.lit("- Likely failure point: **"), "failure", F.lit("**")),
        F.concat(F.lit("- Recommended fix: "), "fix"),
        F.lit("\n## Counts\n\n| Metric | Source | Translated |\n| --- | ---: | ---: |"),
        rows,
        F.concat(F.lit("\n## Chunks\n\n- Source chunks: "), F.col("n_chunks").cast("string")),
        F.concat(F.lit("- Empty translated chunks: "), listed("empty_ids")),
        F.concat(F.lit("- Suspiciously short chunks: "), listed("short_ids")),
    )
    return report.select("doc_id", text.alias("markdown"))


def with_artifacts(status: DataFrame, found: DataFrame) -> DataFrame:
    """Status rows (job_id, artifacts) with the files that exist (job_id, name, path); names that are there keep their path."""
    new = found.groupBy("job_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "path"))).alias("new"))
    joined = status.join(new, "job_id", "left").withColumn("old", F.coalesce("artifacts", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))
    extra = F.map_filter("new", lambda k, _: ~F.map_contains_key("old", k))
    return joined.withColumn("artifacts", F.when(F.col("new").isNull(), F.col("old")).otherwise(F.map_concat("old", extra))).drop("new", "old")


def lineage(status: DataFrame) -> DataFrame:
    """Jobs with the file name and stage of the job that they repeat."""
    parents = status.select(F.col("job_id").alias("parent_id"), F.col("filename").alias("parent_filename"), F.col("stage").alias("parent_stage"))
    return status.withColumn("parent_id", F.try_element_at("artifacts", F.lit("parent_job_id"))).join(parents, "parent_id", "left")
