"""The engine's steps, backends and table functions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from test_functions import split_reference

from quire.engine import Conflict, Engine, Invalid, NotFound
from quire.functions import sql
from quire.operators import backends, translation


def test_a_job_from_pages_to_translation(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    pages = spark.createDataFrame([(1, 1), (1, 2)], "doc_id int, page_number int")
    with pytest.raises(NotFound):
        engine.status("a")
    engine.ingest("a", "file.pdf", pages)
    engine.ingest("b", "file.pdf", pages)
    assert engine.status("b")["filename"] == "file (1).pdf"
    assert engine.regions("a").count() == 2
    with pytest.raises(Conflict):
        engine.regions("a", refresh=True)
    assert engine.boxes_summary("a").first()["n_selected"] == 2
    texts = {"1": "# Kapitel\nDas ist der Text und er geht wei-", "2": "ter bis zum Ende."}
    images = lambda rows: rows.withColumn("name", F.col("page_number").cast("string")).withColumn("image", F.lit(b""))
    engine.run_ocr("a", images, lambda: backends.FixtureOcr(texts))
    blocks = engine.build("a")
    assert [r["text"] for r in blocks.orderBy("block_ord").collect()] == ["Kapitel", "Das ist der Text und er geht weiter bis zum Ende."]
    done = engine.translate("a", translation.BracketTranslator)
    assert [r["text"] for r in done.orderBy("block_ord").collect()] == ["[Kapitel]", "[Das ist der Text und er geht weiter bis zum Ende.]"]
    assert engine.artifacts("a") == ["pages", "regions", "results", "blocks", "tables", "chunks", "translated", "translated_tables"]
    assert [tuple(r) for r in engine.inspect("a").orderBy("page_number").collect()] == [(1, 1, 1, 1), (1, 2, 1, 1)]
    again = engine.retranslate("a", "a2", translation.IdentityTranslator)
    assert [r["text"] for r in again.orderBy("block_ord").collect()] == ["Kapitel", "Das ist der Text und er geht weiter bis zum Ende."]
    with pytest.raises(NotFound):
        engine.retranslate("b", "b2", translation.IdentityTranslator)
    engine.set_stage("a", "translation")
    with pytest.raises(Conflict):
        engine.duplicate("a", "c")
    engine.set_stage("a", "complete")
    engine.duplicate("a", "c")
    assert engine.artifacts("c") == ["pages", "regions"] and engine.status("c")["filename"] == "file OCR rerun.pdf"
    engine.run_ocr("c", images, lambda: backends.FixtureOcr({}))
    with pytest.raises(Invalid):
        engine.build("c")
    assert engine.cleanup() == 1 and engine.jobs().count() == 3


def test_retries_replace_blank_texts(spark):
    images = spark.createDataFrame([("a", b""), ("b", b"")], "name string, image binary")
    retries = spark.createDataFrame([("b", b"")], "name string, image binary")
    got = backends.recognized_twice(images, retries, lambda: backends.FixtureOcr({"a": "one"}))
    assert {r["name"]: r["ocr_text"] for r in got.collect()} == {"a": "one", "b": ""}


def test_languages(spark):
    rows = [("das ist nicht der Fall und gut",), ("the end of the line and more",), ("xyz",), ("",)]
    got = spark.createDataFrame(rows, "t string").select(backends.detected_language(F.col("t")).alias("c"))
    assert [r["c"] for r in got.collect()] == ["de", "en", None, None]


def test_a_document_with_tables_and_blank_regions(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    engine.ingest("a", "file.pdf", spark.createDataFrame([(1, 1), (1, 2)], "doc_id int, page_number int"))
    engine.regions("a")
    texts = {"p1": "Ein Text.\n\nTable 1 Dinge\n\n| Name | Wert |\n|---|---|\n| eins | zwei |", "p2": " ", "r2": "noch einer", "r1": "never read"}

    def drawn(kind):
        return lambda rows: rows.withColumn("name", F.col("page_number").cast("string")).withColumn("image", F.concat(F.lit(kind), "page_number").cast("binary"))

    def model():
        return lambda images, names: [texts[x.decode()] for x in images]

    assert {r["page_number"]: r["ocr_text"] for r in engine.run_ocr("a", drawn("p"), model).collect()} == {1: texts["p1"], 2: " "}
    found = engine.run_ocr("a", drawn("p"), model, retry_images=drawn("r"))
    assert {r["page_number"]: r["ocr_text"] for r in found.collect()} == {1: texts["p1"], 2: "noch einer"}
    texts["p2"] = "noch einer"
    engine.full_page("a", drawn("p"), model)
    done = engine.translate("a", translation.BracketTranslator)
    assert [r["text"] for r in done.orderBy("block_ord").collect()] == ["[Ein Text.]", "[Table 1 Dinge]", "[TABLE]", "[noch einer]"]
    table = engine.tables("a", translated=True).first()
    assert (table["headers"], table["rows"]) == (["[Name", "Wert]"], [["[eins", "zwei]"]]) and engine.tables("a").first()["rows"] == [["eins", "zwei"]]


TEXTS = ["Dr. Who came. He said \"go.\" Then 3.14 was; all: of it, And more of it here to be long enough!", "", "One. two. Three.) Four", "word " * 90]


def test_functions_for_sql(spark):
    names = sql.register(spark)
    assert {"quire_sentence_rows", "quire_sentences", "quire_snap_box"} <= set(names)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    rows.createOrReplaceTempView("texts")
    assert [r["s"] for r in spark.sql("SELECT quire_sentences(t) AS s FROM texts ORDER BY i").collect()] == [split_reference(t) for t in TEXTS]
    assert [r["sentence"] for r in spark.sql("SELECT * FROM quire_sentence_rows('One. Two')").collect()] == ["One.", "Two"]
    assert spark.sql("SELECT count(*) FROM texts, LATERAL quire_sentence_rows(t)").first()[0] == sum(len(split_reference(t)) for t in TEXTS)
    assert tuple(spark.sql("SELECT quire_snap_box(0.12345D, 0.5D, 0.3D, 2D) AS b").first()["b"]) == pytest.approx((0.123, 0.5, 0.3, 1.0))
    assert spark.sql("SELECT quire_dehyphenated('improve-', 'ment it') AS d").first()["d"]["before"] == "improvement"
    plan = spark.sql("SELECT quire_token_count(t) FROM texts")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
