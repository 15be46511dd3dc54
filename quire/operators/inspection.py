"""Facts about the pages of files."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T

RAW = "doc_id string, page_number int, width double, height double, text string, word_x array<double>, image_count int, table_count int"


class PageReader(Protocol):
    """A file's pages as (width, height, text, left edges of the words, images, tables)."""

    def __call__(self, content: bytes) -> list[tuple[float, float, str, list[float], int, int]]: ...


def read_pages(files: DataFrame, reader: Callable[[], PageReader]) -> DataFrame:
    """Pages of files (path, content); the reader is made once a worker."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = None
        for pdf in batches:
            read = read or reader()
            rows = [(path, n, *page) for path, content in zip(pdf["path"], pdf["content"], strict=True) for n, page in enumerate(read(bytes(content)), 1)]
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in RAW.split(", ")])

    return files.select("path", "content").mapInPandas(run, RAW)


def inspected(pages: DataFrame) -> DataFrame:
    """Pages with the quality of their embedded text, its letters, and the number of columns."""
    text, n = F.col("text"), F.size("word_x")
    density = n / (F.greatest(F.col("width") * F.col("height"), F.lit(1.0)) / 100000.0)
    left = F.size(F.filter("word_x", lambda x: x < F.col("width") / 2))
    two = (F.least(left, n - left) >= 8) & (F.abs(left * 2 - n) / F.greatest(n, F.lit(1)) < 0.8)
    return pages.select(
        "doc_id",
        "page_number",
        "width",
        "height",
        F.length(T.strip(text)).alias("text_length"),
        F.least(F.lit(1.0), F.length(text) / 1200.0 * 0.7 + F.least(density / 20.0, F.lit(1.0)) * 0.3).alias("embedded_text_quality"),
        (T.strip(text) != "").alias("has_embedded_text"),
        T.letter_ratio(text).alias("embedded_alpha_ratio"),
        T.non_ascii_ratio(text).alias("embedded_non_ascii_ratio"),
        "image_count",
        "table_count",
        F.when(two, 2).otherwise(1).alias("detected_columns"),
    )
