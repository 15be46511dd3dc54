"""Readers of the files that jobs leave: page texts, regions, results, status, events."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REGION = "id string, page_number int, x0 double, y0 double, x1 double, y1 double, coordinate_space string, type string, selected boolean, reading_order int, source string"
REGION_PAGE = f"pdf_file_id string, page_number int, page_width double, page_height double, image_width int, image_height int, coordinate_space string, detector string, regions array<struct<{', '.join(f'{n}:{t}' for n, t in (x.split(' ') for x in REGION.split(', ')))}>>"
STATUS = "job_id string, filename string, source_filename string, attempt int, stage string, progress double, message string, error string, artifacts map<string,string>, translation map<string,string>"
RESULT = "pdf_file_id string, page_number int, box_id string, x0 double, y0 double, x1 double, y1 double, coordinate_space string, box_type string, reading_order int, ocr_text string, ocr_confidence double, metadata map<string,string>"
EVENT = "event string, phase string, index string, total string, pages string, chars string"


_SPOT = "struct<x0:double,y0:double,x1:double,y1:double>"
_BLOCK = f"id string, page_number int, block_type string, text string, bbox {_SPOT}, confidence double, reading_order_index int, source_type string, language string, metadata map<string,string>"
_TABLE = f"id string, page_numbers array<int>, page int, bbox {_SPOT}, caption_block_id string, caption string, headers array<string>, rows array<array<string>>"
_CHUNK = "id string, block_ids array<string>, source_text string, translated_text string, context string, source_language string, source_token_count int"


def _as_struct(columns: str) -> str:
    return "struct<" + re.sub(r"(^|, )(\w+) ", r"\1\2:", columns) + ">"


DOCUMENT = ", ".join((
    "metadata struct<filename:string,title:string,author:string,page_count:int,detected_language:string>",
    "pages array<struct<page_number:int,width:double,height:double,has_embedded_text:boolean,embedded_text_quality:double,extraction_mode:string>>",
    f"blocks array<{_as_struct(_BLOCK)}>",
    f"tables array<{_as_struct(_TABLE)}>",
    f"translation_chunks array<{_as_struct(_CHUNK)}>",
    "warnings array<string>",
))


def found(spark: SparkSession, path: str) -> bool:
    """Whether any file fits a path, in whatever store it is."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    status = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return status is not None and len(status) > 0


def structured_documents(spark: SparkSession, path: str) -> DataFrame:
    """(file, metadata, pages, blocks, tables, translation_chunks, warnings) of structured documents, one JSON object a file."""
    return spark.read.schema(DOCUMENT).option("multiLine", True).json(path).withColumn("file", F.input_file_name())


def document_blocks(documents: DataFrame) -> DataFrame:
    """(file, block_ord, ...): a row for each block of structured documents, in their order."""
    return documents.select("file", F.posexplode("blocks").alias("block_ord", "b")).select("file", "block_ord", "b.*")


def document_tables(documents: DataFrame) -> DataFrame:
    """(file, table_ord, ...): a row for each table of structured documents."""
    return documents.select("file", F.posexplode("tables").alias("table_ord", "t")).select("file", "table_ord", "t.*")


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length, content) of uploaded files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)


def cached_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_number, text) of `page_0001.md`, `page_0002.md`, ..."""
    files = spark.read.text(f"{path}/page_*.md", wholetext=True).withColumn("file", F.input_file_name())
    return files.select(F.regexp_extract("file", r"page_(\d+)\.md$", 1).cast("int").alias("page_number"), F.col("value").alias("text"))


def with_cached_pages(pages: DataFrame, cached: DataFrame, strict: bool = False) -> DataFrame:
    """`pages` with their cached text, empty where there is none; strict: an error that names the first ten missing pages."""
    keys = [c for c in ("doc_id", "page_number") if c in pages.columns and c in cached.columns]
    if strict:
        missing = pages.join(cached, keys, "left_anti").select("page_number").orderBy("page_number").limit(10).collect()
        if missing:
            raise FileNotFoundError(f"no cached text for pages {[r[0] for r in missing]}")
    return pages.join(cached, keys, "left").withColumn("missing", F.col("text").isNull()).fillna("", ["text"])


def region_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REGION_PAGE).option("multiLine", True).json(f"{path}/page_*.json")


def ocr_results(spark: SparkSession, path: str) -> DataFrame | None:
    """The results of files of OCR results; None if there is no such file."""
    if not found(spark, path):
        return None
    return spark.read.schema(f"results array<struct<{', '.join(f'{n}:{t}' for n, t in (x.split(' ', 1) for x in RESULT.split(', ')))}>>").option("multiLine", True).json(path).select(F.explode("results").alias("r")).select("r.*")


def job_status(spark: SparkSession, path: str) -> DataFrame:
    """Status files; one that can't be read is a row with `_corrupt_record`, not an error."""
    return spark.read.schema(f"{STATUS}, _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(f"{path}/*/status.json")


def parsed_events(text_lines: DataFrame) -> DataFrame:
    """Worker events from lines (value) of JSON; blank lines and lines that are no event are left out."""
    return text_lines.select(F.from_json("value", EVENT).alias("e")).select("e.*").where("event IS NOT NULL")


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    return parsed_events(spark.readStream.format("text").load(path))
