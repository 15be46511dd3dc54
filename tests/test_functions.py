"""Text and geometry functions on cases with known results."""

from __future__ import annotations

import re

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from compare import DATA

from quire.plans import catalogue
from quire.functions import geometry as G
from quire.functions import text as T
from quire.operators import backends, compiling, layout, markdown, translation
from quire.sources import tables as sources


def value(spark, column, **given_):
    rows = spark.createDataFrame([tuple(given_.values())], list(given_)) if given_ else spark.range(1)
    return rows.select(column.alias("v")).first()["v"]


def values(spark, column, texts, name="t"):
    return [r["v"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, {name} string").select("i", column.alias("v")).orderBy("i").collect()]


# Text


@pytest.mark.parametrize(
    ("text", "n"),
    [
        ("Dr. Smith measured 3.14 units in the trial. The values were stable.", 2),
        ("One! Two? Three.", 3),
        ("He said \"stop.\" Then left.", 2),
        ("see fig. 3 and no. 4. but not this", 1),
        ("A. B. Next one", 1),
        ("", 0),
        ("   ", 0),
    ],
)
def test_sentences(spark, text, n):
    assert len(value(spark, T.sentences(F.lit(text)))) == n


def estimate(t):
    return max(1, len(t) // 4)


def split_reference(text):
    """Sentences by a walk over the characters."""
    c = " ".join(text.split())
    out, start, i = [], 0, 0
    while i < len(c):
        if c[i] not in ".!?":
            i += 1
            continue
        word = re.search(r"[^\W\d_]*$", c[:i])[0].lower()
        number = c[i] == "." and 0 < i < len(c) - 1 and c[i - 1].isdigit() and c[i + 1].isdigit()
        short = c[i] == "." and (word in T.ABBREVIATIONS or len(word) == 1)
        end = i + 1
        while end < len(c) and c[end] in "'\"”’)]}":
            end += 1
        after = end + 1 if end < len(c) else end
        if number or short or end < len(c) and c[end] != " " or after < len(c) and c[after].islower():
            i += 1
            continue
        out.append(c[start:end])
        start = i = after
    return [*out, c[start:]] if c[start:] else out


def pack_reference(pieces, budget):
    out, now = [], ""
    for p in pieces:
        joined = f"{now} {p}".strip()
        if now and estimate(joined) > budget:
            out.append(now)
            now = p
        else:
            now = joined
    return [*out, now] if now else out


def long_reference(s, budget):
    if estimate(s) <= budget:
        return [s]
    clauses = re.split(r"(?<=[;:])\s+|(?<=,)\s+(?=[A-Z0-9(])", s)
    by_clause = pack_reference(clauses, budget)
    if len(clauses) > 1 and by_clause and all(estimate(p) <= budget for p in by_clause):
        return by_clause
    return pack_reference(s.split(), budget) or [s]


def chunks_reference(text, budget):
    if estimate(text) <= budget:
        return [text]
    out, now = [], ""
    for s in split_reference(text):
        if estimate(s) > budget:
            out += [now] if now else []
            out += long_reference(s, budget)
            now = ""
        elif now and estimate(f"{now} {s}") > budget:
            out.append(now)
            now = s
        else:
            now = f"{now} {s}".strip()
    return out + ([now] if now else []) or [text]


WORDS = st.sampled_from(["Alpha", "beta", "dr.", "3.14", "end.", "stop!", "why?", "so,", "Then;", "x.", "(Go)", "fig.", "A", "Été", "par:", "ok.)"])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(WORDS, max_size=80).map(" ".join), min_size=1, max_size=25))
def test_sentences_and_chunks_follow_a_walk(spark, texts):
    assert values(spark, T.sentences(F.col("t")), texts) == [split_reference(t) for t in texts]
    assert values(spark, T.chunks(F.col("t"), 12), texts) == [chunks_reference(t, 12) for t in texts]


def test_documents_are_packed_as_by_a_walk(spark):
    want = [(r["doc_id"], i, x) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect() for i, x in enumerate(chunks_reference(r["text"], 128))]
    got = [tuple(r) for r in catalogue.QUERIES["pack_chunks"](spark, DATA).select("doc_id", "pos", "chunk").collect()]
    assert sorted(got) == sorted(want)


def repaired(text):
    """Table markup made whole by a walk over tables and rows."""
    low = text.lower()
    if "<table" not in low and not ("&lt;" in low and "table" in low):
        return text
    text = re.sub(r"(?is)&lt;\s*(/?)\s*(table|thead|tbody|tfoot|tr|td|th)\b([^<>]*?)&gt;", lambda m: f"<{m[1]}{m[2].lower()}{m[3]}>", text)

    def table(m):
        pieces = re.split(r"(?is)(?=<tr\b[^>]*>)", m[0])
        out = []
        for x in pieces:
            if re.match(r"(?is)<tr\b[^>]*>", x) and not re.search(r"(?is)</tr\s*>", x):
                end = re.search(r"(?is)</table\s*>", x)
                x = f"{x[: end.start()]}</tr>{x[end.start() :]}" if end else f"{x}</tr>"
            out.append(x)
        return "".join(out)

    return re.sub(r"(?is)<table\b.*?</table>", table, text)


def test_table_markup_is_repaired_and_translated_whole(spark):
    pages = {r["page_id"]: r["text"] for r in sources.markup(spark, DATA).collect()}
    got = {r["page_id"]: r["normalized"] for r in catalogue.QUERIES["normalize_table"](spark, DATA).collect()}
    assert got == {k: repaired(t) for k, t in pages.items()} and any(got[k] != t for k, t in pages.items())
    heavy = {k: all(x in t.lower() for x in ("<table", "</table>")) and bool(re.search(r"<tr|&lt;\s*tr\b", t.lower())) for k, t in pages.items()}
    done = {r["page_id"]: tuple(r)[1:] for r in catalogue.QUERIES["table_translate"](spark, DATA).collect()}
    assert done == {k: ("translated", 1, (repaired(t) if heavy[k] else t).strip()) for k, t in pages.items()}


def test_join_lines(spark):
    lines = F.array(*map(F.lit, ("para-", " graph ", "", "goes on")))
    assert value(spark, T.join_lines(lines)) == "paragraph goes on"


@pytest.mark.parametrize(
    ("before", "after", "want"),
    [
        ("We found improve-", "ment in it", ("We found improvement", "in it")),
        ("associated with", "a significant result.", ("associated with", "a significant result.")),
        ("x-", "ment", ("x-", "ment")),
        ("improve-", "ment", ("improvement", "")),
    ],
)
def test_dehyphenation(spark, before, after, want):
    left, right = T.dehyphenated(F.lit(before), F.lit(after))
    assert (value(spark, left), value(spark, right)) == want


@pytest.mark.parametrize(
    ("before", "after", "joined"),
    [("with", "a result.", True), ("significant.", "Discussion", False), ("open", "# Head", False), ("end.", "lower case", True), ("open", "Several Words With lower one", True), ("(x)", "Then it went on and on and on and on.", False)],
)
def test_join_decisions_agree(spark, before, after, joined):
    assert value(spark, T.joined_by_space(F.lit(before), F.lit(after))) is joined


def test_english_hints(spark):
    texts = ["Metoda", "Introduction", "the cat", "<table><tr><td>the</td></tr></table>", "Größe of the", "", "This is a sentence of the usual kind with words", "12 34"]
    assert values(spark, T.looks_english(F.col("t")), texts) == [False, True, True, False, False, True, True, False]


def test_language_codes(spark):
    assert values(spark, T.normalize_language(F.col("t")), [" EN", "pt_br", "de-at", "x", "eng", None]) == ["en", "pt-BR", "de-AT", None, None, None]


def test_tables(spark):
    whole, cut = "<table><tr><td>A</td></tr></table>", "<table><tr><td>A</td></tr>"
    assert value(spark, T.valid_table(F.lit(whole), F.lit(whole))) and not value(spark, T.valid_table(F.lit(whole), F.lit(cut)))
    assert value(spark, T.valid_table(F.lit(whole), F.lit(whole.replace("td>", "th>"))))
    fixed = value(spark, T.normalize_table(F.lit("x <table>&lt; tr&gt;<td>1</td><tr><td>2</td></tr><TR><td>3</table> y")))
    assert (fixed.lower().count("<tr"), fixed.lower().count("</tr>")) == (3, 3) and fixed.endswith("</tr></table> y")
    assert value(spark, T.pipe_cells(F.lit("| a || b |"))) == ["a", "", "b"]
    assert value(spark, T.is_separator(F.array(F.lit("---"), F.lit(":-: ")))) and not value(spark, T.is_separator(F.array(F.lit("- a"))))
    cell = F.struct(F.lit("x|y").alias("text"), F.lit(2).alias("rowspan"), F.lit(1).alias("colspan"))
    html = value(spark, T.table_html(F.array(F.lit("A"), F.lit("B")), F.array(F.array(cell))))
    assert html.startswith('<table class="structured-table">\n<thead><tr>\n<th>A</th>') and '<td rowspan="2">x\\|y</td>' in html


def test_model_output(spark):
    assert value(spark, T.clean_translation(F.lit("INTRODUCTION<end_of_turn><end_of_turn>"))) == "INTRODUCTION"
    assert value(spark, T.clean_translation(F.lit("<end_of_turn>"))) == "<end_of_turn>"
    raw = "<image>\nConvert the document to markdown\n\n<|ref|>a<|/ref|>Text<|det|>1<|/det|> P<|end|>"
    assert value(spark, T.clean_ocr(F.lit(raw), "P")) == "Text"


def test_banned_tokens(spark):
    ids = F.array(*map(F.lit, (10, 11, 12, 10, 11)))
    assert value(spark, T.banned_tokens(ids, 3, 16)) == [12]
    assert value(spark, T.banned_tokens(ids, 3, 16, [12])) == []
    assert value(spark, T.banned_tokens(F.array(F.lit(1)), 3, 16)) == []
    assert value(spark, T.banned_tokens(ids, 1, 2)) == [10, 11]


def test_repeat_guard_follows_the_column(spark):
    rng = np.random.default_rng(1)
    runs = [[int(x) for x in rng.integers(0, 4, int(k))] for k in rng.integers(0, 30, 40)]
    rows = spark.createDataFrame(list(enumerate(runs)), "i int, ids array<int>")
    for n, window in ((1, 2), (2, 5), (3, 16), (3, 100)):
        guard = backends.RepeatGuard(n, window, {2})
        got = [r["b"] for r in rows.select("i", T.banned_tokens(F.col("ids"), n, window, [2]).alias("b")).orderBy("i").collect()]
        assert got == [sorted(guard.banned(ids)) for ids in runs]
    scores = backends.RepeatGuard(3, 16)([10, 11, 1, 10, 11], np.zeros((1, 4)))
    assert np.isneginf(scores[0]).tolist() == [False, True, False, False]
    codes = {"<td>": [5], "</td>": [6, 7]}
    assert backends.free_tokens(codes.__getitem__) == {5, *backends.FREE_IDS} and backends.free_tokens({}.__getitem__) == set(backends.FREE_IDS)


# Geometry


def box(*xs):
    return tuple(F.lit(float(x)) for x in xs)


def numbers(spark, columns):
    return tuple(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def test_boxes(spark):
    normal = G.normalize(box(72, 144, 216, 288), F.lit("pdf"), 612.0, 792.0)
    assert numbers(spark, G.denormalize(normal, F.lit("normalized"), 612.0, 792.0)) == pytest.approx((72, 144, 216, 288), abs=1e-6)
    assert numbers(spark, G.pixels(box(0.125, 0.25, 0.625, 0.75), 800, 1000)) == (100, 250, 500, 750)
    assert numbers(spark, G.pixels(box(0.5, 0.5, 0.5, 0.5), 10, 10)) == (5, 5, 6, 6)
    assert numbers(spark, G.from_pixels(box(100, 250, 500, 750), 800.0, 1000.0)) == (0.125, 0.25, 0.625, 0.75)
    assert numbers(spark, G.pad(box(0.1, 0.2, 0.6, 0.7), 0.1)) == (0.05, 0.15000000000000002, 0.65, 0.75)
    assert numbers(spark, G.rescale(box(10, 20, 110, 220), (200.0, 400.0), (1000.0, 2000.0))) == (50, 100, 550, 1100)
    assert numbers(spark, G.snap(box(0.12345, 0.9999, 0.00049, 1.2))) == pytest.approx((0.0, 1.0, 0.123, 1.0))


def test_typed_and_drawn_boxes(spark):
    whole = box(0.2, 0.2, 0.6, 0.5)
    assert numbers(spark, G.edited(whole, F.lit("x"), F.lit(90.0))) == pytest.approx((0.6, 0.2, 1.0, 0.5))
    assert numbers(spark, G.edited(whole, F.lit("h"), F.lit(0.0))) == pytest.approx((0.2, 0.2, 0.6, 0.205))
    assert numbers(spark, G.edited(whole, F.lit("w"), F.lit(float("nan")))) == pytest.approx((0.2, 0.2, 0.6, 0.5))
    point = lambda x, y: (F.lit(float(x)), F.lit(float(y)))
    assert numbers(spark, G.drawn(point(50, 10), point(10, 10), 100.0, 100.0)) == pytest.approx((0.1, 0.1, 0.5, 0.105))


# Layout and documents


def test_two_columns(spark):
    rows = [(1, 1, f"b{i}", i, x - 0.1, y, x + 0.1, y + 0.1) for i, (x, y) in enumerate([(0.75, 0.1), (0.25, 0.1), (0.25, 0.5), (0.75, 0.5), (0.25, 0.8), (0.75, 0.8)])]
    got = layout.in_columns(spark.createDataFrame(rows, "doc_id int, page_number int, id string, reading_order int, x0 double, y0 double, x1 double, y1 double"))
    assert [r["id"] for r in got.orderBy("new_order").collect()] == ["b1", "b2", "b4", "b0", "b3", "b5"]


def test_compiled_text_and_spans(spark):
    rows = [(1, 2, 1, "c", "ity of life."), (1, 1, 2, "b", "measure of the qual-"), (1, 1, 1, "a", "  Title "), (1, 1, 3, "z", "  "), (2, 1, 1, "a", "only")]
    got = {r["doc_id"]: r for r in compiling.compiled(spark.createDataFrame(rows, "doc_id int, page_number long, reading_order long, box_id string, ocr_text string")).collect()}
    assert got[1]["text"] == "Title measure of the quality of life." and got[2]["text"] == "only"
    assert [s["box_id"] for s in got[1]["spans"]] == ["a", "b", "c"]
    assert [got[1]["text"][s["start"] : s["stop"]] for s in got[1]["spans"]] == ["Title", "measure of the quali", "of life."]  # as long as it was when added


def test_a_region_that_moves_wholly(spark):
    rows = [(1, 1, i, "b", t) for i, t in enumerate(["so improve-", "ment", "goes on", "and is cut-", "off"])]
    got = compiling.compiled(spark.createDataFrame(rows, "doc_id int, page_number long, reading_order long, box_id string, ocr_text string")).first()
    assert got["text"] == "so improvement goes on and is cutoff\n\n"
    assert [(s["start"], s["stop"]) for s in got["spans"]][1] == (16, 16)


def test_markdown_round(spark):
    text = ["# Head", "one", "two", "", "Table 1 Things", "| A | B |", "|---|---|", "| x | y |", "- item", "", "| C |", "| z |"]
    lines = spark.createDataFrame([(1, 1, i, x) for i, x in enumerate(text)], "doc_id int, page_number int, pos int, line string")
    blocks = markdown.blocks(lines)
    assert [(r["block_type"], r["text"]) for r in blocks.orderBy("block_ord").collect()] == [
        ("heading", "Head"), ("paragraph", "one two"), ("caption", "Table 1 Things"), ("table", "[TABLE]"), ("list", "item"), ("table", "[TABLE]"),
    ]
    tables = markdown.tables(lines)
    assert [(r["caption"], r["headers"], r["rows"]) for r in tables.orderBy("table_ord").collect()] == [("Table 1 Things", ["A", "B"], [["x", "y"]]), (None, ["C"], [["z"]])]
    whole = markdown.markdown(blocks, tables).first()["markdown"]
    assert whole.startswith("\n<!-- page: 1 -->\n\n## Head\n") and whole.count("<table") == 2 and "### Table 2" in whole


def test_paragraph_islands(spark):
    rows = [(1, i, f"b{i}", 1, "paragraph", t, 50.0, y, y + 10, 10.0) for i, (t, y) in enumerate([("para-", 100.0), ("graph", 112.0), ("far", 145.0)])]
    blocks = spark.createDataFrame(rows, "doc_id int, block_ord int, block_id string, page_number int, block_type string, text string, x0 double, y0 double, y1 double, font_size double")
    got = translation.units(blocks).orderBy("unit_ord").collect()
    assert [(r["block_ids"], r["text"]) for r in got] == [(["b0", "b1"], "paragraph"), (["b2"], "far")]


def test_calls_are_checked_and_repeated_once(spark):
    long = "word " * 60
    rows = [(1, 0, long, "", "paragraph", False), (1, 1, "the same", "", "paragraph", True), (1, 2, "ok", "", "heading", False)]
    chunks = spark.createDataFrame(rows, "doc_id int, chunk_ord int, source_text string, context string, block_type string, skipped boolean")
    got = {r["chunk_ord"]: r for r in translation.translated(chunks, translation.FirstTryFails).collect()}
    assert (got[0]["outcome"], got[0]["attempts"]) == ("retried", 2) and got[0]["translated_text"].startswith("[word")
    assert (got[1]["outcome"], got[1]["attempts"], got[1]["translated_text"]) == ("skipped", 0, "the same")
    assert got[2]["outcome"] == "translated"

    failed = {r["chunk_ord"]: r for r in translation.translated(chunks, lambda: lambda texts, contexts, limits: ["" for _ in texts]).collect()}
    assert failed[0]["outcome"] == "source" and failed[0]["translated_text"] == long


def test_a_failing_model_leaves_the_source(spark):
    def model(texts, contexts, limits):
        if any("bad" in t for t in texts):
            raise RuntimeError("no answer")
        return [f"{t}!" for t in texts]

    rows = [(0, "good one", "", "paragraph"), (1, "bad one", "", "paragraph"), (2, "good two", None, None)]
    chunks = spark.createDataFrame(rows, "chunk_ord int, source_text string, context string, block_type string").withColumn("skipped", F.lit(False)).coalesce(1)
    got = {r["chunk_ord"]: r["translated_text"] for r in translation.translated(chunks, lambda: model).collect()}
    assert got == {0: "good one!", 1: "bad one", 2: "good two!"}


def test_the_model_is_told_about_headings_retries_and_limits(spark):
    def model(texts, contexts, limits):
        return [f"{c}|{n}" if "retry me" not in t or c.endswith(translation.RETRY_NOTE) else "" for t, c, n in zip(texts, contexts, limits, strict=True)]

    rows = [(0, "Head", "S", "heading"), (1, "retry me", "S", "paragraph"), (2, "Head", "", "heading")]
    chunks = spark.createDataFrame(rows, "chunk_ord int, source_text string, context string, block_type string").withColumn("skipped", F.lit(False))
    got = {r["chunk_ord"]: r for r in translation.translated(chunks, lambda: model, max_tokens=500).collect()}
    assert got[0]["translated_text"] == f"S\n{translation.HEADING_NOTE}|128" and got[2]["translated_text"] == f"{translation.HEADING_NOTE}|128"
    assert (got[1]["translated_text"], got[1]["outcome"]) == (f"S\n{translation.RETRY_NOTE}|128", "retried")


def test_tables_fall_back_to_groups_of_rows(spark):
    """A model that cuts off what has more than eight rows, and one group: the groups that hold are taken."""

    def model(texts, contexts, limits):
        out = []
        for t, c in zip(texts, contexts, strict=True):
            broken = t.count("<tr>") > 8 or "r9<" in t
            out.append(t[: len(t) // 2] if broken else t.replace("r", "R").replace("<tR", "<tr").replace("</tR", "</tr"))
            assert "HTML table" in c and limits
        return out

    rows = "".join(f"<tr><td>r{i}</td></tr>" for i in range(20))
    text = f"before <table class='x'>{rows}</table> after"
    chunks = spark.createDataFrame([(0, text, "ctx", "table")], "chunk_ord int, source_text string, context string, block_type string").withColumn("skipped", F.lit(False))
    got = translation.translated(chunks, lambda: model).first()
    want = "".join(f"<tr><td>{'r' if 8 <= i < 16 else 'R'}{i}</td></tr>" for i in range(20))
    assert (got["outcome"], got["attempts"], got["translated_text"]) == ("grouped", 3, f"before <table class='x'>{want}</table> after")


def test_cells_go_back_to_their_tables(spark):
    tables = spark.createDataFrame([(1, 1, 0, "t", ["A", "B"], [["a", "b"], ["c", "d"]]), (1, 2, 0, "u", [], [["x"]])], "doc_id int, page_number int, table_ord int, table_id string, headers array<string>, rows array<array<string>>")
    parts = translation.table_units(tables, F.lit("")).withColumn("unit_ord", F.col("row_ord"))
    chunks = translation.chunked(parts).withColumn("translated_text", F.when(F.col("row_ord") == 1, "one cell alone").otherwise(F.upper("source_text")))
    got = {r["table_id"]: r for r in translation.applied_to_tables(tables, chunks).collect()}
    assert (got["t"]["headers"], got["t"]["rows"]) == (["A", "B"], [["A", "B"], ["c", "d"]]) and (got["u"]["headers"], got["u"]["rows"]) == ([], [["X"]])
