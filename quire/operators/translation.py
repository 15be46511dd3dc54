"""Translation units, chunks, validated model calls and recombination."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quire.functions import text as X

# The prompt's frame, ids of table parts and the paragraph thresholds in page points.
HEADER_ID, ROW_ID = "__table_header__:", "__table_row__:"
COLUMN_EDGE, SIZE_CHANGE, MIN_GAP, GAP, GAP_SHARE = 300, 2, -1, 7.5, 0.9
CONTEXT_HEAD = "\nSECTION CONTEXT (for terminology only, do not translate this unless it appears in TEXT):\n"
HEADING_NOTE = "TEXT is a section heading/title. Translate it to natural English while preserving the heading intent."
RETRY_NOTE = (
    "Preserve the source structure exactly: keep paragraph boundaries, list boundaries, headings, "
    "Markdown markers, citations, numbers, and line breaks that separate logical blocks. "
    "Do not summarize, omit, or collapse content."
)
TABLE_NOTE = "TEXT contains an HTML table. Keep all HTML tags and attributes intact. Return a complete table with closing </table>."
TABLE_RETRY_NOTE = "Do not truncate output. Keep the same number of rows and cells."
GROUP_NOTE = "Translate this partial HTML table and keep tags intact. Return complete table markup."
MAX_TOKENS = 2048
CELL_NOTE = "Preserve the delimiter token exactly as written: |||CELL_BREAK||| . Return the same number of cells in the same order."


class Translator(Protocol):
    """A model, called on the executors with texts, their contexts and the most tokens of each answer. What fails keeps its source."""

    def __call__(self, texts: list[str], contexts: list[str], limits: list[int]) -> list[str]: ...


#: Makes the model once a Python worker, so that weights and samplers never travel with the tasks.
Factory = Callable[[], Translator]


class IdentityTranslator:
    def __call__(self, texts: list[str], contexts: list[str], limits: list[int]) -> list[str]:
        return list(texts)


class BracketTranslator:
    """Puts texts in brackets; a stand-in for a model."""

    def __call__(self, texts: list[str], contexts: list[str], limits: list[int]) -> list[str]:
        return [f"[{t}]" for t in texts]


class FirstTryFails:
    """Answers `short` unless the context asks to keep the structure, then brackets."""

    def __call__(self, texts: list[str], contexts: list[str], limits: list[int]) -> list[str]:
        return [f"[{t}]" if c.endswith((RETRY_NOTE, TABLE_RETRY_NOTE)) else "short" for t, c in zip(texts, contexts, strict=True)]


def prompt(text: Column, context: Column, system: str) -> Column:
    """The plain prompt: instructions, context if any, text."""
    part = F.when(F.coalesce(context, F.lit("")) != "", F.concat(F.lit(CONTEXT_HEAD), context, F.lit("\n"))).otherwise("")
    return F.concat(F.lit(system + "\n\n"), part, F.lit("\nTEXT:\n"), text, F.lit("\n\nENGLISH:"))


def augmented_context(context: Column, block_type: Column) -> Column:
    noted = F.when(X.strip(context) == "", F.lit(HEADING_NOTE)).otherwise(F.concat(context, F.lit("\n" + HEADING_NOTE)))
    return F.when(F.coalesce(block_type, F.lit("")) == "heading", noted).otherwise(context)


def section_context(blocks: DataFrame) -> DataFrame:
    """`blocks` with the text of the heading before each; a heading has the one before it."""
    before = Window.partitionBy("doc_id").orderBy("block_ord").rowsBetween(Window.unboundedPreceding, -1)
    heading = F.when((F.col("block_type") == "heading") & (X.strip(F.col("text")) != ""), X.strip(F.col("text")))
    return blocks.withColumn("context", F.coalesce(F.last(heading, ignorenulls=True).over(before), F.lit("")))


def same_paragraph(order: Window) -> Column:
    """Whether a block continues the one before: same page and column, like size, small gap, no sentence end before a capital."""
    was = lambda c: F.lag(c).over(order)
    column = lambda x: (x >= COLUMN_EDGE).cast("int")
    gap = F.col("y0") - was("y1")
    stops = X.rstrip(was("text")).rlike(r"[.!?:;]$") & X.lstrip(F.col("text")).rlike(r"^\p{Lu}")
    joined = (
        (was("page_number") == F.col("page_number"))
        & (column(was("x0")) == column(F.col("x0")))
        & (F.abs(was("font_size") - F.col("font_size")) <= SIZE_CHANGE)
        & (gap >= MIN_GAP)
        & (gap <= F.greatest(F.lit(GAP), was("font_size") * GAP_SHARE))
        & ~stops
    )
    return F.coalesce(joined, F.lit(False))


def units(blocks: DataFrame) -> DataFrame:
    """(doc_id, unit_ord, block_ids, text, block_type, context) from blocks (doc_id, block_ord, page_number, block_type, text, box, font_size).

    Headers, footers and blank blocks are left out. Paragraph blocks that run on make one unit; each other block is its own.
    """
    kept = section_context(blocks).where(~F.col("block_type").isin("header", "footer") & (X.strip(F.col("text")) != ""))
    order = Window.partitionBy("doc_id").orderBy("block_ord")
    both = (F.col("block_type") == "paragraph") & (F.lag("block_type").over(order) == "paragraph")
    fresh = ~F.coalesce(both & same_paragraph(order), F.lit(False))
    islands = kept.withColumn("unit_ord", F.sum(fresh.cast("int")).over(order) - 1)
    item = F.struct("block_ord", "block_id", "text")
    grouped = islands.groupBy("doc_id", "unit_ord").agg(F.array_sort(F.collect_list(item)).alias("items"), F.first("block_type").alias("kind"), F.min_by("context", "block_ord").alias("context"))
    texts = F.transform("items", lambda x: x["text"])
    text = F.when(F.col("kind") == "paragraph", X.join_lines(texts)).otherwise(X.strip(F.array_join(texts, "\n")))
    made = grouped.select("doc_id", "unit_ord", F.transform("items", lambda x: x["block_id"]).alias("block_ids"), text.alias("text"), F.col("kind").alias("block_type"), "context")
    tabular = (F.col("block_type") == "paragraph") & X.table_heavy(F.col("text"))
    return made.withColumn("block_type", F.when(tabular, "table").otherwise(F.col("block_type"))).withColumn("text", F.when(tabular, X.normalize_table(F.col("text"))).otherwise(F.col("text")))


def table_units(tables: DataFrame, context: Column) -> DataFrame:
    """Units for a table's header and each of its rows, cells joined by the cell break."""
    join = lambda c: F.array_join(F.transform(c, X.strip), X.CELL_BREAK)
    own = tables.withColumn("context", X.strip(F.concat(context, F.lit("\nTable "), (F.col("table_ord") + 1).cast("string"), F.lit("\n" + CELL_NOTE))))
    part = lambda ids, texts, at: F.struct(at.alias("row_ord"), ids.alias("id"), texts.alias("text"))
    head = F.when(F.size("headers") > 0, F.array(part(F.concat(F.lit(HEADER_ID), "table_id"), join(F.col("headers")), F.lit(-1))))
    rows = F.transform("rows", lambda r, i: part(F.concat(F.lit(ROW_ID), F.col("table_id"), F.lit(":"), i.cast("string")), join(r), i))
    parts = own.select("doc_id", "page_number", "table_ord", "context", F.explode(F.concat(F.coalesce(head, F.array().cast(rows_type())), rows)).alias("p"))
    return parts.select("doc_id", "page_number", "table_ord", F.col("p.row_ord").alias("row_ord"), F.array("p.id").alias("block_ids"), F.col("p.text").alias("text"), F.lit("table").alias("block_type"), "context")


def rows_type() -> str:
    return "array<struct<row_ord:int,id:string,text:string>>"


def chunked(units_: DataFrame, chunk_size: int = 0) -> DataFrame:
    """Units in chunks: table parts and table markup whole, other text packed to the token budget."""
    whole = F.get("block_ids", F.lit(0)).startswith("__table_") | ((F.col("block_type") == "table") & X.table_heavy(F.col("text")))
    parts = F.when(whole, F.array("text")).otherwise(X.chunks(F.col("text"), X.token_budget(F.lit(chunk_size))))
    exploded = units_.select("*", F.posexplode(parts).alias("part", "source_text"))
    order = Window.partitionBy("doc_id").orderBy("unit_ord", "part")
    return exploded.withColumn("chunk_ord", F.row_number().over(order) - 1).drop("text", "part")


def _answers(model: Translator, texts: list[str], contexts: list[str], limits: list[int]) -> list[str]:
    """The model's answers; if a call with many texts fails they are asked one by one, and one that fails is its own answer."""
    if not texts:
        return []
    try:
        found = model(texts, contexts, limits)
        if len(found) == len(texts):
            return found
    except Exception:
        logging.getLogger(__name__).warning("a call with %d texts failed", len(texts), exc_info=True)
    if len(texts) == 1:
        return texts
    return [x for one in zip(texts, contexts, limits, strict=True) for x in _answers(model, *([y] for y in one))]


def _asked(rows: DataFrame, factory: Factory, into: str, ask: Column, texts: Column, context: Column, limits: Column) -> DataFrame:
    """`rows` with the column `into` of the model's answers to the arrays `texts`, null where `ask` is false; one model a worker."""
    sent = rows.withColumns({into: F.when(ask, texts), "_context": context, "_limits": limits})
    schema = T.StructType([*rows.schema.fields, T.StructField(into, T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for pdf in batches:
            asked = [k for k, x in enumerate(pdf[into]) if x is not None]
            out: list[list[str] | None] = [None] * len(pdf)
            if asked:
                model = model or factory()
                sizes = [len(pdf[into].iloc[k]) for k in asked]
                flat = [t for k in asked for t in pdf[into].iloc[k]]
                contexts = [pdf["_context"].iloc[k] or "" for k, n in zip(asked, sizes, strict=True) for _ in range(n)]
                answers = iter(_answers(model, flat, contexts, [int(x) for k in asked for x in pdf["_limits"].iloc[k]]))
                for k, n in zip(asked, sizes, strict=True):
                    out[k] = [next(answers) for _ in range(n)]
            yield pdf.drop(columns=["_context", "_limits"]).assign(**{into: pd.Series(out, index=pdf.index, dtype=object)})

    return sent.mapInPandas(run, schema)


def table_groups(table: Column) -> Column:
    """A whole table cut into tables of `ROW_GROUP` rows each, with its beginning and end around them."""
    rows = X.table_rows(table)
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(rows) / X.ROW_GROUP).cast("int") - 1, F.lit(0)))
    parts = F.transform(starts, lambda i: F.concat(_table_start(table), F.array_join(F.slice(rows, i * X.ROW_GROUP + 1, F.lit(X.ROW_GROUP)), ""), F.lit("</table>")))
    return F.when(F.size(rows) > 0, parts).otherwise(F.array().cast("array<string>"))


def _table_start(table: Column) -> Column:
    return F.regexp_extract(table, r"(?is)^(.*?<table\b[^>]*>)", 1)


def from_groups(source: Column, groups: Column, answers: Column) -> Column:
    """A text whose first table has the rows of its groups' answers; a group whose answer does not hold keeps its own rows."""

    def rows(group: Column, answer: Column) -> Column:
        clean = X.clean_translation(answer)
        own, new = X.table_rows(group), X.table_rows(X.primary_table(clean))
        return F.when(F.coalesce(X.valid_table(group, clean) & (F.size(new) == F.size(own)), F.lit(False)), new).otherwise(own)

    table = X.primary_table(source)
    body = F.array_join(F.flatten(F.zip_with(groups, answers, rows)), "")
    at = F.instr(source, table)
    whole = F.concat(_table_start(table), body, F.lit("</table>"))
    return F.concat(F.substring(source, F.lit(1), at - 1), whole, F.substring(source, at + F.length(table), F.length(source)))


def translated(chunks: DataFrame, factory: Factory, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """`chunks` with translated_text, attempts and outcome: an answer is checked, asked for again once with a stricter note, else the source stays.

    Chunks (source_text, context, block_type, skipped) that are skipped keep their text and make no call. Headings have a note in their
    context. Table markup is normalised first; if both its answers fail it is asked for by groups of eight rows, of which those that hold
    are taken (outcome `grouped`). A call that raises gives the source back. Checks are columns between passes of the model, so no answer is computed twice; each
    pass gets the rows of the one before, in batches, and nothing is shuffled.
    """
    given_ = chunks.columns
    heavy = X.table_heavy(F.col("source_text"))
    rows = chunks.withColumn("_ask", ~F.coalesce(F.col("skipped"), F.lit(False))).withColumn("_table", heavy)
    rows = rows.withColumn("_text", F.when(F.col("_table"), X.normalize_table(F.col("source_text"))).otherwise(F.col("source_text")))
    text, table = F.col("_text"), F.col("_table")
    heading = F.coalesce(F.col("block_type") == "heading", F.lit(False))
    base = F.coalesce(augmented_context(F.col("context"), F.col("block_type")), F.lit(""))
    noted = lambda c, *notes: X.strip(F.concat(c, *(F.lit(f"\n{n}") for n in notes)))
    limit = F.when(table, X.table_budget(X.token_count(text), F.lit(max_tokens))).otherwise(X.output_budget(X.token_count(prompt(text, base, "")), F.lit(max_tokens)))
    good = lambda answer: F.coalesce(F.when(table, X.valid_table(text, answer)).otherwise(X.valid_structure(text, answer, heading)), F.lit(False))

    def tried(rows: DataFrame, name: str, ask: Column, context: Column) -> DataFrame:
        answered = _asked(rows, factory, f"_{name}", ask, F.array(text), context, F.array(limit))
        answered = answered.withColumn(f"_{name}", X.clean_translation(F.get(f"_{name}", F.lit(0))))
        return answered.withColumn(f"_{name}_good", good(F.col(f"_{name}")))

    rows = tried(rows, "first", F.col("_ask"), F.when(table, noted(base, TABLE_NOTE)).otherwise(base))
    again = F.col("_ask") & ~F.col("_first_good")
    rows = tried(rows, "second", again, F.when(table, noted(base, TABLE_NOTE, TABLE_RETRY_NOTE)).otherwise(noted(base, RETRY_NOTE)))
    rows = rows.withColumn("_groups", F.when(again & ~F.col("_second_good") & table, table_groups(X.primary_table(text))))
    sized = F.transform("_groups", lambda g: X.table_budget(X.token_count(g), F.lit(max_tokens)))
    rows = _asked(rows, factory, "_parts", F.size("_groups") > 0, F.col("_groups"), noted(base, GROUP_NOTE), sized)
    rows = rows.withColumn("_third", F.when(F.col("_parts").isNotNull(), from_groups(text, F.col("_groups"), F.col("_parts"))))
    grouped = F.col("_third").isNotNull() & (F.col("_third") != text) & good(F.col("_third"))
    outcome = lambda c, name: F.struct(c.alias("text"), F.lit(name).alias("outcome"))
    done = (
        F.when(~F.col("_ask"), outcome(F.col("source_text"), "skipped"))
        .when(F.col("_first_good"), outcome(F.col("_first"), "translated"))
        .when(F.col("_second_good"), outcome(F.col("_second"), "retried"))
        .when(grouped, outcome(F.col("_third"), "grouped"))
        .otherwise(outcome(text, "source"))
    )
    attempts = F.col("_ask").cast("int") + again.cast("int") + F.col("_parts").isNotNull().cast("int")
    return rows.withColumn("_done", done).select(*given_, F.col("_done.text").alias("translated_text"), F.col("_done.outcome").alias("outcome"), attempts.alias("attempts"))


def coalesced(chunks: DataFrame) -> DataFrame:
    """Consecutive chunks of the same blocks as one; table parts stay apart."""
    order = Window.partitionBy("doc_id").orderBy("chunk_ord")
    same = (F.lag("block_ids").over(order) == F.col("block_ids")) & ~F.get("block_ids", F.lit(0)).startswith("__table_")
    runs = chunks.withColumn("run", F.sum((~F.coalesce(same, F.lit(False))).cast("int")).over(order))
    item = F.struct("chunk_ord", "source_text", "translated_text")
    grouped = runs.groupBy("doc_id", "run", "block_ids").agg(F.array_sort(F.collect_list(item)).alias("items"))

    def joined(name: str) -> Column:
        texts = F.filter(F.transform("items", lambda x: X.strip(x[name])), lambda x: x != "")
        return F.when(F.size("items") == 1, F.get("items", F.lit(0))[name]).otherwise(F.array_join(texts, "\n\n"))

    return grouped.select(
        "doc_id", F.array_min(F.transform("items", lambda x: x["chunk_ord"])).alias("chunk_ord"), "block_ids", joined("source_text").alias("source_text"), joined("translated_text").alias("translated_text")
    )


def applied(blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """Blocks with their translations: the first block of a chunk has its text, the others are merged into it."""
    targets = chunks.select("doc_id", F.posexplode("block_ids").alias("at", "block_id"), F.get("block_ids", F.lit(0)).alias("into"), "translated_text")
    joined = blocks.join(targets, ["doc_id", "block_id"], "left")
    text = F.when(F.col("at").isNull(), F.col("text")).when(F.col("at") == 0, X.strip(F.col("translated_text"))).otherwise("")
    return joined.withColumn("text", text).withColumn("merged_into", F.when(F.col("at") > 0, F.col("into"))).drop("at", "into", "translated_text")


def applied_to_tables(tables: DataFrame, chunks: DataFrame) -> DataFrame:
    """Tables (doc_id, table_id, headers, rows) with the translated cells of their parts (block_ids, source_text, translated_text).

    A part's id names its table and row; an answer with another number of cells than its row leaves the row's own.
    """
    part = F.get("block_ids", F.lit(0))
    cells = lambda n: X.split_cells(F.col("translated_text"), F.col("source_text"), n)
    texts = F.struct("source_text", "translated_text")
    heads = chunks.where(part.startswith(HEADER_ID)).select("doc_id", F.substring(part, F.lit(len(HEADER_ID) + 1), F.length(part)).alias("table_id"), texts.alias("head"))
    found = chunks.where(part.startswith(ROW_ID)).select(
        "doc_id", F.regexp_extract(part, rf"^{ROW_ID}(.*):\d+$", 1).alias("table_id"), F.regexp_extract(part, r":(\d+)$", 1).cast("int").alias("row_ord"), "source_text", "translated_text"
    )
    placed = tables.select("doc_id", "table_id", F.posexplode("rows").alias("row_ord", "row")).join(found, ["doc_id", "table_id", "row_ord"], "left")
    new = F.when(F.col("translated_text").isNull() | (F.size("row") == 0), F.col("row")).otherwise(cells(F.size("row")))
    rows = placed.groupBy("doc_id", "table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_ord", new.alias("cells")))), lambda x: x["cells"]).alias("_rows"))
    joined = tables.join(heads, ["doc_id", "table_id"], "left").join(rows, ["doc_id", "table_id"], "left")
    header = F.when(F.col("head").isNull(), F.col("headers")).otherwise(X.split_cells(F.col("head.translated_text"), F.col("head.source_text"), F.size("headers")))
    return joined.withColumns({"headers": header, "rows": F.coalesce("_rows", "rows")}).select(*tables.columns)


def row_groups(rows: DataFrame) -> DataFrame:
    """Table rows (table_id, row_ord, row, new_row) by groups of eight: a group takes its new rows if all of them are whole."""
    numbered = rows.withColumn("group", F.floor(F.col("row_ord") / X.ROW_GROUP).cast("int"))
    whole = F.bool_and(F.coalesce(F.col("new_row").rlike(r"(?is)^<tr\b[^>]*>.*</tr>$"), F.lit(False))).over(Window.partitionBy("table_id", "group"))
    return numbered.withColumn("row", F.when(whole, F.col("new_row")).otherwise(F.col("row"))).withColumn("replaced", whole).drop("new_row")
