"""Files and streams."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quire.functions.html import to_html
from quire.operators import jobs
from quire.sources import files, sinks
from quire.streaming import events


def test_cached_pages(spark, tmp_path):
    (tmp_path / "page_0001.md").write_text("# One\ntext")
    pages = spark.createDataFrame([(1,), (2,)], "page_number int")
    cached = files.cached_pages(spark, str(tmp_path))
    got = {r["page_number"]: r for r in files.with_cached_pages(pages, cached).collect()}
    assert got[1]["text"] == "# One\ntext" and got[2]["text"] == "" and got[2]["missing"]
    with pytest.raises(FileNotFoundError, match="2"):
        files.with_cached_pages(pages, cached, strict=True)


def test_status_files_keep_broken_ones(spark, tmp_path):
    for name, text in (("a", json.dumps({"job_id": "a", "stage": "upload", "attempt": 1})), ("b", "{broken")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "status.json").write_text(text)
    got = files.job_status(spark, str(tmp_path)).cache()
    assert got.count() == 2 and got.where("_corrupt_record IS NOT NULL").count() == 1


def test_region_files(spark, tmp_path):
    page = {"pdf_file_id": "f", "page_number": 1, "regions": [{"id": "r", "x0": 0.1, "selected": True, "type": "text"}]}
    (tmp_path / "page_0001.json").write_text(json.dumps(page, indent=1))
    (tmp_path / "results.json").write_text(json.dumps({"results": [{"box_id": "r", "ocr_text": "t", "metadata": {"k": 1}}]}, indent=1))
    assert files.region_pages(spark, str(tmp_path)).first()["regions"][0]["id"] == "r"
    assert files.ocr_results(spark, str(tmp_path / "results.json")).first()["ocr_text"] == "t"


LINES = ['{"event": "model_loading"}', "noise", "", '{"event": "page_done", "index": 15, "total": 15, "chars": 1234}', '{"event": "page_started", "phase": "retry", "index": 1, "total": 3}', '{"event": "page_done", "index": 0, "total": 3}', '{"event": "other"}']


def test_progress_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(LINES))
    query = events.progress_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("progress").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted(map(tuple, spark.table("progress").select("progress", "message").collect()))
    assert got == [(0.35, "Loading OCR model for selected regions"), (0.36, "Retrying empty OCR regions: 1/3"), (0.84, "OCR selected regions: 15/15 complete; 1234 characters")]
    batch = jobs.ocr_progress(files.parsed_events(spark.read.text(str(tmp_path / "in")))).where("progress IS NOT NULL")
    assert sorted(map(tuple, batch.select("progress", "message").collect())) == got


def test_upsert_keeps_the_last_state(spark, tmp_path):
    for k, rows in enumerate([[(1, 1, "upload"), (2, 2, "upload")], [(1, 3, "complete")]]):
        spark.createDataFrame(rows, "job_id int, event_id int, stage string").coalesce(1).write.json(str(tmp_path / f"d{k}"))
    schema = "job_id int, event_id int, stage string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "d*"))
    events.upsert(stream, str(tmp_path / "state"), str(tmp_path / "c"), buckets=4).awaitTermination()
    assert {r["job_id"]: r["stage"] for r in events.states(spark, str(tmp_path / "state")).collect()} == {1: "complete", 2: "upload"}
    assert all(len(list(bucket.iterdir())) == 1 for bucket in (tmp_path / "state").iterdir())  # no old versions


def test_a_job_s_streams_are_stopped(spark, tmp_path):
    query = spark.readStream.format("rate").load().writeStream.format("memory").queryName("job7").option("checkpointLocation", str(tmp_path)).start()
    assert events.stop_job(spark, "job7") == 1 and not query.isActive and events.stop_job(spark, "job7") == 0


def test_structured_documents(spark, tmp_path):
    box = {"x0": 0.1, "y0": 0.2, "x1": 0.3, "y1": 0.4}
    block = {"id": "b1", "page_number": 1, "block_type": "heading", "text": "H", "bbox": box, "reading_order_index": 0, "source_type": "ocr", "metadata": {"k": "v"}}
    table = {"id": "t1", "page_numbers": [1, 2], "headers": ["A"], "rows": [["x"], ["y"]], "caption": "Table 1"}
    chunk = {"id": "chunk-0", "block_ids": ["b1"], "source_text": "H"}
    whole = {"metadata": {"filename": "f.pdf", "page_count": 2}, "pages": [], "blocks": [block, block | {"id": "b2", "bbox": None}], "tables": [table], "translation_chunks": [chunk], "warnings": ["w"], "unknown": 1}
    (tmp_path / "structured.json").write_text(json.dumps(whole, indent=2))
    got = files.structured_documents(spark, str(tmp_path / "structured.json"))
    assert got.first()["metadata"]["filename"] == "f.pdf" and got.first()["warnings"] == ["w"] and got.first()["translation_chunks"][0]["block_ids"] == ["b1"]
    blocks = files.document_blocks(got).orderBy("block_ord").collect()
    assert [(r["id"], r["bbox"] and r["bbox"]["x1"]) for r in blocks] == [("b1", 0.3), ("b2", None)]
    assert files.document_tables(got).first()["rows"] == [["x"], ["y"]]


def test_ocr_results_are_written_and_read_back(spark, tmp_path):
    rows = [("f", 1, 2, "b", "two"), ("f", 1, 1, "a", "one"), ("f", 2, 1, "c", " ")]
    results = spark.createDataFrame(rows, "doc_id string, page_number int, reading_order int, box_id string, ocr_text string")
    assert files.ocr_results(spark, str(tmp_path / "none.json")) is None
    sinks.write_ocr_results(results, str(tmp_path / "o"))
    back = files.ocr_results(spark, str(tmp_path / "o"))
    assert [tuple(r) for r in back.select("page_number", "reading_order", "box_id", "ocr_text").collect()] == [(1, 1, "a", "one"), (1, 2, "b", "two"), (2, 1, "c", " ")]


def test_sources_fall_back_to_regions(spark):
    pages = spark.createDataFrame([(1, 2, " second\n"), (1, 1, "first ")], "doc_id int, page_number int, text string")
    results = spark.createDataFrame([(1, 1, 1, "a", "not this"), (2, 1, 1, "a", "region")], "doc_id int, page_number int, reading_order int, box_id string, ocr_text string")
    got = {r["doc_id"]: r["markdown"] for r in sinks.source_markdown(pages, results).collect()}
    assert got == {1: "first\n\nsecond\n", 2: "<!-- page: 1 -->\n\nregion"}


def test_pages_and_debug_boxes(spark, tmp_path):
    rows = [("f", 2, 1, "c", "text", 0.0, 0.0, 0.5, 0.5), ("f", 1, 2, "b", "text", 0.25, 0.5, 0.75, 1.0), ("f", 1, 1, "a", "text", 0.0, 0.0, 1.0, 0.5)]
    regions = spark.createDataFrame(rows, "doc_id string, page_number int, reading_order int, id string, type string, x0 double, y0 double, x1 double, y1 double")
    sinks.write_all_pages(regions, str(tmp_path / "all"))
    pages = spark.read.json(str(tmp_path / "all")).first()["pages"]
    assert [(p["page_number"], [x["id"] for x in p["regions"]]) for p in pages] == [(1, ["a", "b"]), (2, ["c"])]
    sinks.write_debug_boxes(regions, str(tmp_path / "debug"))
    shown = {r["id"]: r["percent"] for r in spark.read.json(str(tmp_path / "debug")).collect()}
    assert (shown["b"]["x"], shown["b"]["width"], shown["b"]["height"]) == (25.0, 50.0, 50.0)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, ""),
        ("  \n", ""),
        ("# Head *one* #\ntext\nmore", "<h1>Head <em>one</em></h1>\n<p>text\nmore</p>"),
        ("a < b & **c** `x<y` [l](u?a=1&b) ![i](p.png)", '<p>a &lt; b &amp; <strong>c</strong> <code>x&lt;y</code> <a href="u?a=1&amp;b">l</a> <img alt="i" src="p.png" /></p>'),
        ("- a\n- b\n  - c\n\n1. x\n2. y", "<ul>\n<li>a</li>\n<li>b\n<ul>\n<li>c</li>\n</ul>\n</li>\n</ul>\n<ol>\n<li>x</li>\n<li>y</li>\n</ol>"),
        ("| A | B |\n|---|--:|\n| x\\|y | 1 |\nafter", '<table>\n<thead>\n<tr>\n<th>A</th>\n<th style="text-align: right">B</th>\n</tr>\n</thead>\n<tbody>\n<tr>\n<td>x|y</td>\n<td style="text-align: right">1</td>\n</tr>\n</tbody>\n</table>\n<p>after</p>'),
        ("```py\na < b\n# no\n```\nend", '<pre><code class="language-py">a &lt; b\n# no\n</code></pre>\n<p>end</p>'),
        ('<table class="x">\n<tr><td>1</td></tr>\n</table>\n\n<small>s</small>', '<table class="x">\n<tr><td>1</td></tr>\n</table>\n<small>s</small>'),
        ("> q\n> r\n\n---", "<blockquote>\n<p>q\nr</p>\n</blockquote>\n<hr />"),
        ("<!-- page: 1 -->\n\ntext with <b>tags</b> and \\* star", "<!-- page: 1 -->\n<p>text with <b>tags</b> and * star</p>"),
    ],
)
def test_markdown_to_html(text, want):
    assert to_html(text) == want


def test_html_documents(spark):
    docs = spark.createDataFrame([(1, "T", "# H"), (2, None, None)], "doc_id int, title string, markdown string")
    got = {r["doc_id"]: r["html"] for r in sinks.html_documents(docs, "faithful").collect()}
    assert "<title>T</title>" in got[1] and "column-count: 2" in got[1] and "<h1>H</h1>" in got[1] and "<title>Translated Document</title>" in got[2]


def test_sinks(spark, tmp_path):
    timings = spark.createDataFrame([("j", "render", 0.4, 1), ("j", "ocr", 1.2, 1), ("j", "ocr", 1.4, 2), ("j", "load", 0.5, None)], "job_id string, stage string, seconds double, page long")
    sinks.write_timings(timings, str(tmp_path / "t"))
    csv = {tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "t" / "csv")).collect()}
    assert ("j", "ALL", "ocr", "2.600000") in csv and ("j", "1", "render", "0.400000") in csv
    assert "j ocr: 2.60s total, 1.30s/page" in {r[0] for r in spark.read.text(str(tmp_path / "t" / "summary")).collect()}
    regions = spark.createDataFrame([(1, 1, 2, "b", 0.5), (1, 1, 1, "a", 0.25)], "doc_id int, page_number int, reading_order int, id string, x0 double")
    sinks.write_region_pages(regions, str(tmp_path / "r"))
    assert [x["id"] for x in spark.read.json(str(tmp_path / "r")).first()["regions"]] == ["a", "b"]
    results = spark.createDataFrame([(1, 1, 1, "a", "one"), (1, 1, 2, "b", " "), (1, 2, 1, "a", "two")], "doc_id int, page_number int, reading_order int, box_id string, ocr_text string")
    assert sinks.region_markdown(results).first()["markdown"] == "<!-- page: 1 -->\n\none\n\n<!-- page: 2 -->\n\ntwo"
    sinks.write_markdown(sinks.region_markdown(results), str(tmp_path / "m"))
    assert spark.read.text(str(tmp_path / "m"), wholetext=True).count() == 1
    copied = sinks.copied(regions.withColumn("job_id", F.lit("old")), "old", "new")
    assert copied.select("job_id").distinct().first()[0] == "new"
    with pytest.raises(FileNotFoundError):
        sinks.copied(regions.withColumn("job_id", F.lit("old")), "none", "new")


def test_job_folders_as_a_data_source(spark, tmp_path):
    from quire.sources import job_directory

    for job in ("a", "b"):
        (tmp_path / job).mkdir()
        (tmp_path / job / "page_0001.md").write_text(f"text of {job}")
    (tmp_path / "a" / "page_0002.md").write_text("more")
    (tmp_path / "a" / "other.md").write_text("no page")
    job_directory.register(spark)
    got = spark.read.format("quire_pages").load(str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [("a", 1, "text of a"), ("a", 2, "more"), ("b", 1, "text of b")]
