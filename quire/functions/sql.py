"""The column functions for SQL: each is a SQL function whose body is the column's own expression, so Catalyst inlines it."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import text as T

_TEXT = {"c": "STRING"}
_BOX = {"x0": "DOUBLE", "y0": "DOUBLE", "x1": "DOUBLE", "y1": "DOUBLE"}


def _box(*names: str) -> G.Box:
    return tuple(F.col(n) for n in names)


def _named(columns: tuple[Column, ...], names: Iterable[str]) -> Column:
    return F.named_struct(*(x for c, n in zip(columns, names, strict=True) for x in (F.lit(n), c)))


#: Name, parameters and the column made of them. Columns with lambda functions have no SQL text and are for DataFrames alone.
SCALARS: dict[str, tuple[dict[str, str], Callable[[], Column]]] = {
    **{
        f"quire_{f.__name__}": (_TEXT, lambda f=f: f(F.col("c")))
        for f in (
            T.strip, T.compact, T.token_count, T.list_item_count, T.heading_count, T.word_count, T.table_mark_count, T.figure_mark_count, T.letter_ratio,
            T.non_ascii_ratio, T.table_heavy, T.inline_markup, T.may_hold_table, T.primary_table, T.table_rows, T.escape_cell, T.for_detection,
            T.normalize_language, T.sentences, T.clean_translation,
        )
    },
    "quire_dehyphenated": ({"a": "STRING", "b": "STRING"}, lambda: _named(T.dehyphenated(F.col("a"), F.col("b")), ("before", "after"))),
    "quire_token_budget": ({"c": "INT"}, lambda: T.token_budget(F.col("c"))),
    "quire_table_budget": ({"c": "INT", "n": "INT"}, lambda: T.table_budget(F.col("c"), F.col("n"))),
    "quire_output_budget": ({"c": "INT", "n": "INT"}, lambda: T.output_budget(F.col("c"), F.col("n"))),
    "quire_snap_box": (_BOX, lambda: _named(G.snap(_box(*_BOX)), _BOX)),
    "quire_percent_box": (_BOX, lambda: _named(G.percent(_box(*_BOX)), ("x", "y", "width", "height"))),
    "quire_manual_box": (_BOX, lambda: _named(G.manual_copy(_box(*_BOX)), _BOX)),
}


def body(spark: SparkSession, parameters: dict[str, str], column: Column) -> str:
    """The SQL text of a column over columns named like the parameters."""
    frame = spark.createDataFrame([], ", ".join(f"{n} {t}" for n, t in parameters.items())).select(column.alias("v"))
    return frame._jdf.queryExecution().analyzed().expressions().head().child().sql()


def register(spark: SparkSession) -> list[str]:
    """Makes `SCALARS` and the table function `quire_sentence_rows(text)` known to SQL as temporary functions; their names."""
    for name, (parameters, column) in SCALARS.items():
        given = ", ".join(f"{n} {t}" for n, t in parameters.items())
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({given}) RETURN {body(spark, parameters, column())}")
    split = body(spark, _TEXT, T.sentences(F.col("c")))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION quire_sentence_rows(c STRING) RETURNS TABLE (pos INT, sentence STRING) RETURN SELECT * FROM posexplode({split}) AS t(pos, sentence)")
    return [*SCALARS, "quire_sentence_rows"]
