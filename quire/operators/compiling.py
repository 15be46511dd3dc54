"""Continuous text from recognised regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T

SPAN = "struct<page_number:bigint,box_id:string,reading_order:bigint,start:int,stop:int>"


def compiled(results: DataFrame) -> DataFrame:
    """(doc_id, text, spans): each document's non-blank regions in order (page, reading order, box) as one text.

    What follows depends on the text so far, as a word may move from one region to the one before, so this is an `aggregate` over the ordered
    regions. It holds the settled pieces, the last region's text, whose end may still change, and where that begins; a
    region that moved wholly leaves an empty span. Spans are places in the text when they were added.
    """
    rows = results.withColumn("part", T.strip(F.col("ocr_text"))).where("part <> ''")
    item = F.struct(F.col("page_number").cast("bigint").alias("page_number"), F.col("reading_order").cast("bigint").alias("reading_order"), "box_id", "part")
    ordered = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("items"))

    def span(x: Column, start: Column) -> Column:
        return F.struct(x["page_number"].alias("page_number"), x["box_id"].alias("box_id"), x["reading_order"].alias("reading_order"), start.cast("int").alias("start"), (start + F.length(x["part"])).cast("int").alias("stop"))

    def state(pieces: Column, now: Column, start: Column, spans: Column) -> Column:
        return F.struct(pieces.alias("pieces"), now.alias("now"), start.cast("bigint").alias("start"), spans.alias("spans"))

    def joined(acc: Column, x: Column) -> Column:
        left, right = T.dehyphenated(acc["now"], x["part"])
        return T.bound(F.struct(left.alias("left"), right.alias("right")), lambda pair: placed(acc, x, pair))

    def placed(acc: Column, x: Column, pair: Column) -> Column:
        gap = F.when(T.joined_by_space(pair["left"], pair["right"]), " ").otherwise("\n\n")
        return T.bound(F.struct(gap.alias("gap"), (acc["start"] + F.length(pair["left"]) + F.length(gap)).alias("at")), lambda y: added(acc, x, pair, y))

    def added(acc: Column, x: Column, pair: Column, y: Column) -> Column:
        spans = F.concat(acc["spans"], F.array(span(x.withField("part", pair["right"]), y["at"])))
        moved = state(acc["pieces"], F.concat(pair["left"], y["gap"]), acc["start"], spans)
        return F.when(pair["right"] == "", moved).otherwise(state(F.concat(acc["pieces"], F.array(pair["left"], y["gap"])), pair["right"], y["at"], spans))

    first = F.get("items", F.lit(0))
    begun = state(F.array().cast("array<string>"), first["part"], F.lit(0), F.array(span(first, F.lit(0))).cast(f"array<{SPAN}>"))
    whole = F.aggregate(F.slice("items", 2, F.size("items")), begun, joined)
    done = ordered.select("doc_id", whole.alias("w"))
    return done.select("doc_id", F.concat(F.array_join("w.pieces", ""), F.col("w.now")).alias("text"), F.col("w.spans").alias("spans"))


def page_by_page(pages: DataFrame, results: DataFrame) -> DataFrame:
    """(doc_id, markdown): every page's marker and its regions' texts; a page without regions keeps its marker."""
    full = results.withColumn("text", T.strip(F.col("ocr_text"))).where("text <> ''")
    item = F.struct("reading_order", "box_id", "text")
    texts = full.groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list(item)).alias("items"))
    joined = pages.join(texts, ["doc_id", "page_number"], "left")
    body = F.array_join(F.transform("items", lambda x: x["text"]), "\n\n")
    page = F.concat(F.lit("\n<!-- page: "), F.col("page_number").cast("string"), F.lit(" -->\n\n"), F.coalesce(body, F.lit("")), F.lit("\n"))
    whole = joined.select("doc_id", "page_number", page.alias("page")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "page"))).alias("pages"))
    return whole.select("doc_id", F.array_join(F.transform("pages", lambda x: x["page"]), "\n").alias("markdown"))
