"""A data source for SQL and streams: the cached page texts of job folders, `spark.read.format("quire_pages")`.

For folders that driver and executors both see as files; other stores are read with `files.cached_pages`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class PagesReader(DataSourceReader):
    """One partition a job folder."""

    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(str(p)) for p in sorted(Path(self.root).iterdir()) if p.is_dir()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        folder = Path(partition.value)
        for page in sorted(folder.glob("page_*.md")):
            if m := re.fullmatch(r"page_(\d+)\.md", page.name):
                yield folder.name, int(m[1]), page.read_text(encoding="utf-8")


class Pages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quire_pages"

    def schema(self) -> str:
        return "job_id string, page_number int, text string"

    def reader(self, schema) -> PagesReader:
        return PagesReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Pages)
