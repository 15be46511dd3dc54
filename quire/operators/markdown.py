"""Markdown lines to blocks and tables, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import text as T


def line_kind(line: Column) -> Column:
    """A stripped line's kind; the first that fits."""
    return (
        F.when(line == "", "blank")
        .when(line.startswith("|") & line.endswith("|"), "table")
        .when(line.rlike(r"^#{1,6}\s+.+$"), "heading")
        .when(line.rlike(r"^[-*+]\s+"), "list")
        .when(line.rlike(r"(?i)^(table|figure)\s+\d+"), "caption")
        .otherwise("paragraph")
    )


def line_text(line: Column, kind: Column) -> Column:
    return F.when(kind == "heading", T.strip(F.regexp_replace(line, r"^#{1,6}\s+", ""))).when(kind == "list", F.regexp_replace(line, r"^[-*+]\s+", "")).otherwise(line)


def blocks(lines: DataFrame, page: str = "page_number") -> DataFrame:
    """(doc_id, page, block_ord, block_type, text) from (doc_id, page, pos, line).

    Runs of paragraph lines make a block, runs of table rows a placeholder; other lines are blocks of their own.
    Blocks are numbered through the document, from 0.
    """
    in_page = Window.partitionBy("doc_id", page).orderBy("pos")
    kinds = lines.withColumn("line", T.strip(F.col("line"))).withColumn("kind", line_kind(F.col("line")))
    fresh = F.coalesce(F.lag("kind").over(in_page) != F.col("kind"), F.lit(True)) | F.col("kind").isin("heading", "list", "caption")
    runs = kinds.withColumn("run", F.sum(fresh.cast("int")).over(in_page)).where("kind <> 'blank'")
    item = F.struct("pos", line_text(F.col("line"), F.col("kind")).alias("text"))
    grouped = runs.groupBy("doc_id", page, "run", "kind").agg(F.min("pos").alias("first_pos"), F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["text"]), " ").alias("text"))
    order = Window.partitionBy("doc_id").orderBy(page, "run")
    return grouped.select(
        "doc_id", page, (F.row_number().over(order) - 1).alias("block_ord"), F.col("kind").alias("block_type"), F.when(F.col("kind") == "table", "[TABLE]").otherwise(F.col("text")).alias("text")
    )


def tables(lines: DataFrame, page: str = "page_number") -> DataFrame:
    """(doc_id, page, table_ord, caption, headers, rows) of the pages' runs of table rows.

    The caption is the last line `Table n` since the table before. A second row of dashes is left out if more follow.
    """
    in_page = Window.partitionBy("doc_id", page).orderBy("pos")
    rows = lines.withColumn("line", T.strip(F.col("line")))
    rows = rows.withColumn("row", F.col("line").startswith("|") & F.col("line").endswith("|"))
    fresh = F.col("row") & ~F.coalesce(F.lag("row").over(in_page), F.lit(False))
    rows = rows.withColumn("table_ord", F.sum(fresh.cast("int")).over(in_page))
    named = Window.partitionBy("doc_id", page, "era").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("era", F.col("table_ord") - F.col("row").cast("int"))
    title = F.when(F.col("line").rlike(r"(?i)^table\s+\d+"), F.col("line"))
    rows = rows.withColumn("caption", F.last(title, ignorenulls=True).over(named)).where("row")
    cells = F.when(F.regexp_replace("line", r"\|", "") != "", T.pipe_cells(F.col("line")))
    found = rows.groupBy("doc_id", page, "table_ord").agg(
        F.min_by("caption", "pos").alias("caption"), F.transform(F.array_sort(F.collect_list(F.when(cells.isNotNull(), F.struct("pos", cells.alias("cells"))))), lambda x: x["cells"]).alias("all")
    )
    skip = F.when((F.size("all") > 2) & T.is_separator(F.get("all", F.lit(1))), 3).otherwise(2)
    body = F.slice("all", skip, F.greatest(F.size("all"), F.lit(1)))
    return found.select(
        "doc_id", page, (F.col("table_ord") - 1).alias("table_ord"), "caption", F.coalesce(F.get("all", F.lit(0)), F.array().cast("array<string>")).alias("headers"), body.alias("rows")
    )


def _plain(rows: Column) -> Column:
    return F.transform(rows, lambda r: F.transform(r, lambda c: F.struct(c.alias("text"), F.lit(1).alias("rowspan"), F.lit(1).alias("colspan"))))


def markdown(blocks_: DataFrame, tables_: DataFrame, page: str = "page_number") -> DataFrame:
    """(doc_id, markdown): blocks with page markers; a page's tables stand at its first table block."""
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy(page, "table_ord"))
    title = F.coalesce("caption", F.concat(F.lit("Table "), number.cast("string")))
    written = tables_.withColumn("title", title).withColumn("md", F.concat(F.lit("\n### "), F.col("title"), F.lit("\n\n"), T.table_html(F.col("headers"), _plain(F.col("rows")))))
    per_page = written.groupBy("doc_id", page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("table_ord", "md"))), lambda x: x["md"]), "\n").alias("tables_md"))
    kept = blocks_.where((F.col("block_type") == "table") | (T.strip(F.col("text")) != ""))
    order = Window.partitionBy("doc_id").orderBy("block_ord")
    marker = F.when(F.coalesce(F.lag(page).over(order) != F.col(page), F.lit(True)), F.concat(F.lit("\n<!-- page: "), F.col(page).cast("string"), F.lit(" -->\n\n"))).otherwise("")
    nth = F.row_number().over(Window.partitionBy("doc_id", page, "block_type").orderBy("block_ord"))
    text = F.col("text")
    body = (
        F.when(F.col("block_type") == "heading", F.concat(F.lit("## "), text, F.lit("\n")))
        .when(F.col("block_type").isin("list", "reference"), F.concat(F.lit("- "), text, F.lit("\n")))
        .when(F.col("block_type") == "caption", F.concat(F.lit("*"), text, F.lit("*\n")))
        .when(F.col("block_type") == "footnote", F.concat(F.lit("<small>[Footnote] "), text, F.lit("</small>\n")))
        .when(F.col("block_type").isin("header", "footer"), F.concat(F.lit("<small>"), text, F.lit("</small>\n")))
        .when((F.col("block_type") == "table") & (F.col("nth") == 1), F.col("tables_md"))
        .when(F.col("block_type") != "table", F.concat(text, F.lit("\n")))
    )
    rows = kept.withColumn("marker", marker).withColumn("nth", nth).join(per_page, ["doc_id", page], "left").withColumn("body", body)
    piece = F.when(F.col("body").isNull(), F.when(F.col("marker") != "", F.rtrim(F.col("marker"), F.lit("\n")))).otherwise(F.concat("marker", "body"))
    whole = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(piece.isNotNull(), F.struct("block_ord", piece.alias("piece"))))).alias("pieces"))
    return whole.select("doc_id", F.array_join(F.transform("pieces", lambda x: x["piece"]), "\n").alias("markdown"))


def language_sample(blocks_: DataFrame) -> DataFrame:
    """The first 4,000 characters of a document's paragraphs and headings, null under 40."""
    kept = blocks_.where(F.col("block_type").isin("paragraph", "heading"))
    whole = kept.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block_ord", "text"))).alias("items"))
    sample = T.strip(F.left(F.array_join(F.transform("items", lambda x: x["text"]), "\n"), F.lit(4000)))
    return whole.select("doc_id", F.when(F.length(sample) >= 40, sample).alias("sample"))
