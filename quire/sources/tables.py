"""Parquet tables, and views of them in the shapes of the document model.

The views only compute: no row is left out. Each has SQL of the same name in `SQL_VIEWS`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ocr_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised regions: a conversation is a document, a turn a region; every fifth text is blank."""
    return table(spark, sf_dir, "conversations").selectExpr(
        "conv_id AS doc_id",
        "turn div 4 + 1 AS page_number",
        "turn AS reading_order",
        "concat(conv_id, '-', turn) AS box_id",
        "CASE role WHEN 'user' THEN 'text' WHEN 'assistant' THEN 'table' ELSE 'header' END AS box_type",
        "CASE WHEN (conv_id + turn) % 5 = 3 THEN '  ' ELSE text END AS ocr_text",
    )


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page regions: an order is a document, a line item a region with exact binary fractions for its box."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS doc_id",
        "CAST(l_linenumber % 2 + 1 AS INT) AS page_number",
        "concat('r', l_orderkey, '-', l_linenumber) AS id",
        "CAST(l_linenumber AS INT) AS reading_order",
        "CAST(l_suppkey % 24 AS DOUBLE) / 32 AS x0",
        "CAST(l_linenumber * 5 % 24 AS DOUBLE) / 32 AS y0",
        "CAST(l_suppkey % 24 + l_partkey % 8 + 1 AS DOUBLE) / 32 AS x1",
        "CAST(l_linenumber * 5 % 24 + l_orderkey % 8 + 1 AS DOUBLE) / 32 AS y1",
        "CASE WHEN l_linestatus = 'O' THEN 'normalized' ELSE 'pdf' END AS coordinate_space",
        "l_returnflag <> 'R' AS selected",
        "CASE l_returnflag WHEN 'A' THEN 'text' WHEN 'N' THEN 'table' ELSE 'figure' END AS type",
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents, each whole, made into markdown by their place: headings, items, table rows and captions; a blank line stays where a text has one."""
    split = table(spark, sf_dir, "documents").select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    return split.selectExpr(
        "doc_id",
        "lang",
        "pos",
        """CASE WHEN pos % 7 = 0 THEN concat('# ', raw) WHEN pos % 7 = 3 THEN concat('- ', raw)
                WHEN pos % 11 = 5 OR pos % 11 = 6 THEN concat('| ', replace(raw, '|', ' '), ' | ', length(raw), ' |')
                WHEN pos % 13 = 4 THEN concat('Table ', pos, ' ', raw) ELSE raw END AS line""",
    )


def timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiler events: stage, seconds, page (null for every third)."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id", "concat('j', user_id % 50) AS job_id", "event_type AS stage", "value AS seconds", "CASE WHEN event_id % 3 > 0 THEN user_id % 9 + 1 END AS page"
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job status rows: an event is an update of its user's job."""
    return table(spark, sf_dir, "events").selectExpr(
        "user_id AS job_id",
        "event_id",
        "element_at(array('upload', 'extraction', 'ocr_layout_parsing', 'structure_generation', 'translation', 'complete', 'cancelled', 'failed'), CAST(event_id % 8 + 1 AS INT)) AS stage",
        "concat('file', user_id % 40, CASE WHEN user_id % 3 = 0 THEN concat(' (', user_id % 4 + 1, ')') ELSE '' END, '.pdf') AS filename",
        "CAST(event_id % 4 AS INT) AS attempt",
    )


def markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, with tables whose tags are whole, escaped, without row ends or cut off, by the page's number."""
    return table(spark, sf_dir, "pages").selectExpr(
        "page_id",
        """concat(html, CASE page_id % 5
             WHEN 0 THEN '<table><tr><td>A</td><td>B</td></tr><tr><th>C</th></tr></table>'
             WHEN 1 THEN '<table class="x">&lt; tr&gt;&lt;td&gt;1&lt;/td&gt;<tr><td>2</td></tr></table>'
             WHEN 2 THEN '<TABLE><TR><td>x</td><tr><td>y</td></TABLE>\n'
             WHEN 3 THEN '<table><tr><td>cut'
             ELSE '' END) AS text""",
    )


SQL_VIEWS = {
    "ocr_results": """SELECT conv_id AS doc_id, turn // 4 + 1 AS page_number, turn AS reading_order, conv_id || '-' || turn AS box_id,
        CASE role WHEN 'user' THEN 'text' WHEN 'assistant' THEN 'table' ELSE 'header' END AS box_type,
        CASE WHEN (conv_id + turn) % 5 = 3 THEN '  ' ELSE text END AS ocr_text FROM conversations""",
    "regions": """SELECT l_orderkey AS doc_id, CAST(l_linenumber % 2 + 1 AS INT) AS page_number, 'r' || l_orderkey || '-' || l_linenumber AS id,
        CAST(l_linenumber AS INT) AS reading_order, CAST(l_suppkey % 24 AS DOUBLE) / 32 AS x0, CAST(l_linenumber * 5 % 24 AS DOUBLE) / 32 AS y0,
        CAST(l_suppkey % 24 + l_partkey % 8 + 1 AS DOUBLE) / 32 AS x1, CAST(l_linenumber * 5 % 24 + l_orderkey % 8 + 1 AS DOUBLE) / 32 AS y1,
        CASE WHEN l_linestatus = 'O' THEN 'normalized' ELSE 'pdf' END AS coordinate_space, l_returnflag <> 'R' AS selected,
        CASE l_returnflag WHEN 'A' THEN 'text' WHEN 'N' THEN 'table' ELSE 'figure' END AS type FROM lineitem""",
    "lines": """SELECT doc_id, lang, pos, CASE WHEN pos % 7 = 0 THEN '# ' || raw WHEN pos % 7 = 3 THEN '- ' || raw
        WHEN pos % 11 = 5 OR pos % 11 = 6 THEN '| ' || replace(raw, '|', ' ') || ' | ' || length(raw) || ' |'
        WHEN pos % 13 = 4 THEN 'Table ' || pos || ' ' || raw ELSE raw END AS line
        FROM (SELECT doc_id, lang, unnest(x) AS raw, generate_subscripts(x, 1) - 1 AS pos FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS x FROM documents))""",
    "timings": """SELECT event_id, 'j' || (user_id % 50) AS job_id, event_type AS stage, value AS seconds, CASE WHEN event_id % 3 > 0 THEN user_id % 9 + 1 END AS page FROM events""",
    "jobs": """SELECT user_id AS job_id, event_id,
        (['upload', 'extraction', 'ocr_layout_parsing', 'structure_generation', 'translation', 'complete', 'cancelled', 'failed'])[CAST(event_id % 8 + 1 AS INT)] AS stage,
        'file' || (user_id % 40) || CASE WHEN user_id % 3 = 0 THEN ' (' || (user_id % 4 + 1) || ')' ELSE '' END || '.pdf' AS filename, CAST(event_id % 4 AS INT) AS attempt FROM events""",
    "markup": """SELECT page_id, html || CASE page_id % 5
        WHEN 0 THEN '<table><tr><td>A</td><td>B</td></tr><tr><th>C</th></tr></table>'
        WHEN 1 THEN '<table class="x">&lt; tr&gt;&lt;td&gt;1&lt;/td&gt;<tr><td>2</td></tr></table>'
        WHEN 2 THEN '<TABLE><TR><td>x</td><tr><td>y</td></TABLE>' || chr(10)
        WHEN 3 THEN '<table><tr><td>cut' ELSE '' END AS text FROM pages""",
}


def with_views(*names: str) -> str:
    """A WITH clause that defines the views."""
    return "WITH " + ",\n".join(f"{n} AS ({SQL_VIEWS[n]})" for n in names) + "\n"
