"""Images, inspection, settings, the queue and the smaller sinks."""

from __future__ import annotations

import threading

import numpy as np
from pyspark.sql import functions as F

from quire.operators import images, inspection
from quire.operators.queue import JobQueue
from quire.operators.settings import JobSettings
from quire.sources import sinks


def test_images(spark):
    def draw(content, page, scale):
        image = np.full((int(8 * scale), int(8 * scale)), 255, dtype=np.uint8)
        image[: page + 1, :2] = content[0]
        return image

    pages = spark.createDataFrame([("a", bytearray([100]), 1), ("b", bytearray([200]), 2)], "name string, content binary, page_number int")
    got = images.rendered(pages, lambda: draw, dpi=72, binarize=True)
    assert {r["name"]: r["nonwhite"] for r in images.inked(got).collect()} == {"a": 4 / 64, "b": 0.0}
    boxed = images.rendered(pages, lambda: draw, dpi=72).withColumns({"left": F.lit(0), "top": F.lit(0), "right": F.lit(2), "bottom": F.lit(1)})
    masks = {r["name"]: r for r in images.cut(boxed, images.masked).collect()}
    assert (masks["a"]["width"], masks["a"]["height"]) == (8, 8) and bytes(masks["a"]["pixels"])[:3] == bytes([100, 100, 255])
    crops = {r["name"]: r for r in images.cut(boxed, images.retry_crop).collect()}
    assert (crops["a"]["width"], crops["a"]["height"]) == (2, 1)
    noisy = np.full((5, 5), 255, dtype=np.uint8)
    noisy[2, 2] = 0
    assert (images.cleaned(noisy, denoise=True) == 255).all()
    assert images.contrasted(np.array([[100, 200]], dtype=np.uint8), 2.0).tolist() == [[50, 250]]


def test_inspection(spark):
    files = spark.createDataFrame([("f", bytearray(b"x"))], "path string, content binary")
    reader = lambda: lambda content: [(600.0, 800.0, "Text of it", [10.0] * 9 + [400.0] * 9, 1, 0), (600.0, 800.0, " ", [], 0, 0)]
    first, second = inspection.inspected(inspection.read_pages(files, reader)).orderBy("page_number").collect()
    assert first["detected_columns"] == 2 and first["has_embedded_text"] and first["text_length"] == 10
    assert second["detected_columns"] == 1 and not second["has_embedded_text"] and second["embedded_alpha_ratio"] == 0.0


def test_settings_fall_back():
    s = JobSettings(models=("m1", "m2"), model="other", translation_mode="odd")
    assert (s.model, s.translation_mode, JobSettings(models=("m1", "m2"), model="m2").model) == ("m1", "continuous_document", "m2")


def test_queue(spark):
    queue, gate, order = JobQueue(spark), threading.Event(), []
    queue.submit("a", lambda: (gate.wait(20), order.append("a")))
    while queue.states["a"] != "active":
        pass
    queue.submit("b", lambda: order.append("b"))
    queue.submit("c", lambda: order.append("c"))
    queue.submit("d", lambda: 1 / 0)
    assert queue.messages()["c"] == "Queued. Waiting for 2 job(s) ahead."
    assert queue.cancel("c") and not queue.cancel("zzz")
    gate.set()
    assert queue.wait() and order == ["a", "b"]
    assert queue.states == {"a": "complete", "b": "complete", "c": "cancelled", "d": "failed"}
    assert queue.stop_all() == {"queued_cancelled": 0, "active_cancelled": 0}


def test_smaller_sinks(spark):
    pages = spark.createDataFrame([(1, 1, "good text"), (1, 2, "scan")], "doc_id int, page_number int, reason string")
    assert sinks.decisions(pages).first()["decisions"] == {"1": "good text", "2": "scan"}
    page = spark.range(1).select(sinks.html_page(F.lit("<p>x</p>"), F.lit(None).cast("string"), "faithful").alias("h")).first()["h"]
    assert "column-count: 2" in page and "<title>Translated Document</title>" in page
    row = spark.range(1).select(
        F.lit(1).alias("doc_id"), F.lit("f").alias("failure"), F.lit("x").alias("fix"), F.create_map(F.lit("words"), F.lit(3)).alias("source_counts"),
        F.create_map(F.lit("words"), F.lit(2)).alias("translated_counts"), F.lit(4).alias("n_chunks"), F.lit("").alias("empty_ids"), F.lit("chunk-1").alias("short_ids"),
    )
    text = sinks.report_markdown(row).first()["markdown"]
    assert "| words | 3 | 2 |" in text and "Empty translated chunks: none" in text and "short chunks: chunk-1" in text
    status = spark.createDataFrame([("a", "f", "complete", {"x": "1"}), ("b", "f", "upload", {"parent_job_id": "a"}), ("c", "f", "upload", None)], "job_id string, filename string, stage string, artifacts map<string,string>")
    found = spark.createDataFrame([("a", "x", "2"), ("a", "y", "3"), ("c", "z", "4")], "job_id string, name string, path string")
    assert {r["job_id"]: r["artifacts"] for r in sinks.with_artifacts(status, found).collect()} == {"a": {"x": "1", "y": "3"}, "b": {"parent_job_id": "a"}, "c": {"z": "4"}}
    assert {r["job_id"]: r["parent_stage"] for r in sinks.lineage(status).collect()} == {"a": None, "b": "complete", "c": None}
