"""Queries of regions, documents, translation, reports and jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import text as T
from quire.operators import compiling, jobs, layout, markdown, reports, translation
from quire.plans.registry import query
from quire.plans.text_queries import _CLEAN, _COMPACT, _COUNT, _ENGLISH, _FOUND, _PARAGRAPHS, _STRIP, _TOKENS, chunks_sql
from quire.sources import files
from quire.sources import tables as S
from quire.sources.tables import with_views

_BOX = ("x0", "y0", "x1", "y1")


def _box(*names: str) -> G.Box:
    return tuple(F.col(n) for n in names or _BOX)


def _named(box: G.Box, names: tuple[str, ...] = _BOX) -> list:
    return [c.alias(n) for c, n in zip(box, names, strict=True)]


# Geometry, on boxes of line items; those in points are scaled by 640 x 1024


@query(
    with_views("regions")
    + """, p AS (SELECT id, coordinate_space AS s, x0 * CASE WHEN coordinate_space = 'pdf' THEN 640 ELSE 1.5 END AS x0, y0 * CASE WHEN coordinate_space = 'pdf' THEN 1024 ELSE 1 END AS y0,
  x1 * CASE WHEN coordinate_space = 'pdf' THEN 320 ELSE 1 END AS x1, y1 * CASE WHEN coordinate_space = 'pdf' THEN 1024 ELSE 1 END AS y1 FROM regions),
u AS (SELECT id, s, CASE WHEN s = 'normalized' THEN greatest(0, least(1, x0)) ELSE greatest(0, least(1, x0 / 640)) END AS a, CASE WHEN s = 'normalized' THEN greatest(0, least(1, y0)) ELSE greatest(0, least(1, y0 / 1024)) END AS b,
  CASE WHEN s = 'normalized' THEN greatest(0, least(1, x1)) ELSE greatest(0, least(1, x1 / 640)) END AS c, CASE WHEN s = 'normalized' THEN greatest(0, least(1, y1)) ELSE greatest(0, least(1, y1 / 1024)) END AS d FROM p)
SELECT id, CASE WHEN s = 'pdf' THEN least(a, c) ELSE a END AS x0, CASE WHEN s = 'pdf' THEN least(b, d) ELSE b END AS y0, CASE WHEN s = 'pdf' THEN greatest(a, c) ELSE c END AS x1, CASE WHEN s = 'pdf' THEN greatest(b, d) ELSE d END AS y1 FROM u"""
)
def normalize_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    pdf = F.col("coordinate_space") == "pdf"
    raw = tuple(F.col(n) * F.when(pdf, float(p)).otherwise(o) for n, p, o in (("x0", 640, 1.5), ("y0", 1024, 1.0), ("x1", 320, 1.0), ("y1", 1024, 1.0)))
    return S.regions(spark, sf_dir).select("id", *_named(G.normalize(raw, F.col("coordinate_space"), 640.0, 1024.0)))


@query(
    with_views("regions")
    + """SELECT id, CASE WHEN coordinate_space = 'pdf' THEN x0 ELSE least(least(1, x0) * 640, least(1, x1) * 640) END AS x0, CASE WHEN coordinate_space = 'pdf' THEN y0 ELSE least(least(1, y0) * 1024, least(1, y1) * 1024) END AS y0,
 CASE WHEN coordinate_space = 'pdf' THEN x1 ELSE greatest(least(1, x0) * 640, least(1, x1) * 640) END AS x1, CASE WHEN coordinate_space = 'pdf' THEN y1 ELSE greatest(least(1, y0) * 1024, least(1, y1) * 1024) END AS y1 FROM regions"""
)
def denormalize_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.regions(spark, sf_dir).select("id", *_named(G.denormalize(_box(), F.col("coordinate_space"), 640.0, 1024.0)))


_PIX = ("left_px", "top_px", "right_px", "bottom_px")


@query(
    with_views("regions")
    + """, p AS (SELECT id, CAST(round_even(least(1, x0) * 813, 0) AS INT) AS a, CAST(round_even(least(1, y0) * 1009, 0) AS INT) AS b, CAST(round_even(least(1, x1) * 813, 0) AS INT) AS c, CAST(round_even(least(1, y1) * 1009, 0) AS INT) AS d FROM regions),
q AS (SELECT id, greatest(0, least(a, c)) AS l, greatest(0, least(b, d)) AS t, least(813, greatest(a, c)) AS r, least(1009, greatest(b, d)) AS m FROM p)
SELECT id, l AS left_px, t AS top_px, CASE WHEN r <= l THEN least(813, l + 1) ELSE r END AS right_px, CASE WHEN m <= t THEN least(1009, t + 1) ELSE m END AS bottom_px FROM q"""
)
def pixel_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.regions(spark, sf_dir).select("id", *_named(G.pixels(_box(), 813, 1009), _PIX))


@query(
    with_views("regions")
    + """, u AS (SELECT id, least(1, x0) AS a, least(1, y0) AS b, least(1, x1) AS c, least(1, y1) AS d FROM regions), o AS (SELECT id, least(a, c) AS a, least(b, d) AS b, greatest(a, c) AS c, greatest(b, d) AS d FROM u)
SELECT id, greatest(0, least(1, a - (c - a) * 0.1::DOUBLE)) AS x0, greatest(0, least(1, b - (d - b) * 0.1::DOUBLE)) AS y0, greatest(0, least(1, c + (c - a) * 0.1::DOUBLE)) AS x1, greatest(0, least(1, d + (d - b) * 0.1::DOUBLE)) AS y1 FROM o"""
)
def pad_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.regions(spark, sf_dir).select("id", *_named(G.pad(_box(), 0.1)))


@query(
    with_views("regions")
    + """SELECT id, x0 * 512 * (1000.0::DOUBLE / 512) AS image_x0, y0 * 256 * (2000.0::DOUBLE / 256) AS image_y0, x1 * 512 * (1000.0::DOUBLE / 512) AS image_x1, y1 * 256 * (2000.0::DOUBLE / 256) AS image_y1,
 least(1, x0 * 512 / 512) AS back_x0 FROM regions"""
)
def canvas_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    canvas = tuple(F.col(n) * s for n, s in zip(_BOX, (512, 256, 512, 256), strict=True))
    image = G.rescale(canvas, (512.0, 256.0), (1000.0, 2000.0))
    return S.regions(spark, sf_dir).select("id", *_named(image, tuple(f"image_{n}" for n in _BOX)), G.from_pixels(canvas, 512.0, 256.0)[0].alias("back_x0"))


@query(
    with_views("regions")
    + """, s AS (SELECT id, """
    + ", ".join(f"greatest(0, least(1, round_even({n} / 3 / 0.001::DOUBLE, 0) * 0.001::DOUBLE)) AS {n}" for n in _BOX)
    + """ FROM regions) SELECT id, least(x0, x1) AS x0, least(y0, y1) AS y0, greatest(x0, x1) AS x1, greatest(y0, y1) AS y1 FROM s"""
)
def snap_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.regions(spark, sf_dir).select("id", *_named(G.snap(tuple(F.col(n) / 3 for n in _BOX))))


@query(with_views("regions") + "SELECT id, x0 * 100 AS x, y0 * 100 AS y, (x1 - x0) * 100 AS width, (y1 - y0) * 100 AS height FROM regions")
def bbox_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.regions(spark, sf_dir).select("id", *_named(G.percent(_box()), ("x", "y", "width", "height")))


@query(
    with_views("regions")
    + """, w AS (SELECT id, x0, y0, least(greatest(x1 - x0, 0.08::DOUBLE), 0.8::DOUBLE) AS w, least(greatest(y1 - y0, 0.05::DOUBLE), 0.6::DOUBLE) AS h FROM regions),
p AS (SELECT id, w, h, least(greatest(x0 + 0.035::DOUBLE, 0), 1 - w) AS x0, least(greatest(y0 + 0.035::DOUBLE, 0), 1 - h) AS y0 FROM w)
SELECT id, x0, y0, least(greatest(x0 + w, x0 + 0.005::DOUBLE), 1) AS x1, least(greatest(y0 + h, y0 + 0.005::DOUBLE), 1) AS y1 FROM p"""
)
def manual_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.regions(spark, sf_dir).select("id", *_named(G.manual_copy(_box())))


@query(with_views("regions") + "SELECT id FROM regions WHERE (x1 - x0) * 1600 >= greatest(20, 1600 * 0.015::DOUBLE) AND (y1 - y0) * 800 >= greatest(20, 800 * 0.015::DOUBLE)")
def drawn_box_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = G.drawn_large_enough((F.col("x1") - F.col("x0")) * 1600, (F.col("y1") - F.col("y0")) * 800, F.lit(1600.0), F.lit(800.0))
    return S.regions(spark, sf_dir).where(big).select("id")


@query(
    with_views("regions")
    + """, w AS (SELECT id, greatest(0, least(0.995::DOUBLE, least(x0 * 600, y1 * 300) / 640)) AS a, greatest(x0 * 600, y1 * 300) / 640 AS c, greatest(0, least(0.995::DOUBLE, least(y0 * 900, x1 * 100) / 1024)) AS b, greatest(y0 * 900, x1 * 100) / 1024 AS d FROM regions)
SELECT id, a AS x0, b AS y0, least(greatest(c, a + 0.005::DOUBLE), 1) AS x1, least(greatest(d, b + 0.005::DOUBLE), 1) AS y1 FROM w"""
)
def drawn_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes between two points of a canvas."""
    a, b = (F.col("x0") * 600, F.col("y0") * 900), (F.col("y1") * 300, F.col("x1") * 100)
    return S.regions(spark, sf_dir).select("id", *_named(G.drawn(a, b, 640.0, 1024.0)))


_EDIT = "(['x', 'y', 'w', 'h', 'none'])[(reading_order % 5 + 1)::INT]"


@query(
    with_views("regions")
    + f""", e AS (SELECT id, x0, y0, x1, y1, {_EDIT} AS f, (x1 * 90 - 10)::DOUBLE AS v FROM regions), n AS (SELECT *, greatest(0, least(1, v / 100)) AS m, greatest(0.005::DOUBLE, least(1, v / 100)) AS z,
  least(greatest(x1 - x0, 0.005::DOUBLE), 1) AS w, least(greatest(y1 - y0, 0.005::DOUBLE), 1) AS h, greatest(0, least(1, x0)) AS sx, greatest(0, least(1, y0)) AS sy FROM e),
p AS (SELECT *, least(greatest(m, 0), 1 - w) AS mx, least(greatest(m, 0), 1 - h) AS my FROM n)
SELECT id, f AS field, CASE WHEN f = 'x' THEN mx ELSE x0 END AS x0, CASE WHEN f = 'y' THEN my ELSE y0 END AS y0,
 CASE WHEN f = 'x' THEN least(greatest(mx + w, mx + 0.005::DOUBLE), 1) WHEN f = 'w' THEN least(greatest(sx + z, sx + 0.005::DOUBLE), 1) ELSE x1 END AS x1,
 CASE WHEN f = 'y' THEN least(greatest(my + h, my + 0.005::DOUBLE), 1) WHEN f = 'h' THEN least(greatest(sy + z, sy + 0.005::DOUBLE), 1) ELSE y1 END AS y1 FROM p"""
)
def edited_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes with one number typed anew."""
    field = F.element_at(F.array(*map(F.lit, ("x", "y", "w", "h", "none"))), F.col("reading_order") % 5 + 1)
    return S.regions(spark, sf_dir).select("id", field.alias("field"), *_named(G.edited(_box(), field, F.col("x1") * 90 - 10)))


# Regions


@query(with_views("regions") + "SELECT doc_id, page_number, id, CAST(row_number() OVER (PARTITION BY doc_id, page_number ORDER BY reading_order, y0, x0, id) AS INT) AS reading_order FROM regions")
def reindex_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.reindexed(S.regions(spark, sf_dir)).select("doc_id", "page_number", "id", "reading_order")


@query(
    with_views("regions")
    + """, a AS (SELECT doc_id, doc_id AS page_number, id, reading_order, x0, y0, x1, y1, (x0 + x1) / 2 AS centre FROM regions),
b AS (SELECT *, row_number() OVER w AS place, lead(centre) OVER w - centre AS gap, count(*) OVER (PARTITION BY doc_id) AS n, max(x1) OVER (PARTITION BY doc_id) - min(x0) OVER (PARTITION BY doc_id) AS span
      FROM a WINDOW w AS (PARTITION BY doc_id ORDER BY centre, y0, id)),
c AS (SELECT *, max(gap) OVER (PARTITION BY doc_id) AS widest FROM b), d AS (SELECT *, min(CASE WHEN gap = widest THEN place END) OVER (PARTITION BY doc_id) AS cut FROM c)
SELECT doc_id, id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN n >= 4 AND span > 0 AND widest >= greatest(0.12::DOUBLE, span * 0.22::DOUBLE) AND least(cut, n - cut) >= 2 AND place > cut THEN 1 ELSE 0 END,
  round_even(y0, 4), round_even(x0, 4), reading_order, id) AS INT) AS reading_order FROM d"""
)
def column_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's items as one page."""
    page = S.regions(spark, sf_dir).withColumn("page_number", F.col("doc_id"))
    return layout.in_columns(page).select("doc_id", "id", F.col("new_order").alias("reading_order"))


@query(with_views("regions") + "SELECT doc_id, page_number, id FROM regions WHERE selected AND page_number IN (2)")
def selected_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.selected(S.regions(spark, sf_dir), pages=[2]).select("doc_id", "page_number", "id")


@query(
    with_views("ocr_results")
    + """SELECT box_id, CASE box_type WHEN 'page' THEN 'paragraph' WHEN 'text' THEN 'paragraph' WHEN 'table' THEN 'table' WHEN 'figure' THEN 'figure' WHEN 'caption' THEN 'caption' WHEN 'header' THEN 'header'
 WHEN 'footer' THEN 'footer' WHEN 'reference' THEN 'reference' ELSE 'unknown' END AS block_type FROM ocr_results"""
)
def region_to_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.ocr_results(spark, sf_dir).select("box_id", layout.block_type(F.col("box_type")).alias("block_type"))


@query(f"""WITH t AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'References' WHEN 1 THEN 'Fig. ' || doc_id || ' x' WHEN 2 THEN 'a | b | c | d' WHEN 3 THEN '  ' ELSE text END AS t, (doc_id % 20) / 20.0::DOUBLE * 800 AS y0 FROM documents),
l AS (SELECT *, lower({_STRIP.format("t")}) AS low FROM t)
SELECT doc_id, CASE WHEN low = '' THEN 'other' WHEN regexp_matches(low, '^references?$') OR regexp_matches(low, '^\\[\\d+\\]') THEN 'reference' WHEN regexp_matches(low, '^(figure|fig\\.)\\s*\\d+') OR regexp_matches(low, '^table\\s*\\d+') THEN 'caption'
 WHEN y0 + 30 <= 800 * 0.1::DOUBLE THEN 'header' WHEN y0 >= 800 * 0.9::DOUBLE THEN 'footer' WHEN length(t) - length(replace(t, '|', '')) >= 3 THEN 'table' ELSE 'text' END AS type FROM l""")
def guess_region_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 6
    t = F.when(k == 0, "References").when(k == 1, F.concat(F.lit("Fig. "), "doc_id", F.lit(" x"))).when(k == 2, "a | b | c | d").when(k == 3, "  ").otherwise(F.col("text"))
    y0 = (F.col("doc_id") % 20) / 20.0 * 800
    return S.table(spark, sf_dir, "documents").select("doc_id", layout.guess_type(t, y0, y0 + 30, F.lit(800)).alias("type"))


@query(
    with_views("regions")
    + """SELECT doc_id, page_number, count(*) AS n_primary, CASE WHEN doc_id % 3 > 0 AND (doc_id % 10) / 10.0::DOUBLE >= 0.3::DOUBLE AND count(*) >= 2 THEN 'primary' WHEN doc_id % 4 > 0 THEN 'fallback' WHEN count(*) > 0 THEN 'primary' ELSE 'fallback_full_page' END AS detector
 FROM regions GROUP BY doc_id, page_number"""
)
def detector_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = S.regions(spark, sf_dir).groupBy("doc_id", "page_number").agg(F.count("*").alias("n_primary"))
    pages = pages.withColumn("has_embedded_text", F.col("doc_id") % 3 > 0).withColumn("quality", (F.col("doc_id") % 10) / 10.0).withColumn("n_fallback", F.col("doc_id") % 4)
    return layout.detector_choice(pages).select("doc_id", "page_number", "n_primary", "detector")


@query(
    with_views("regions")
    + """SELECT DISTINCT doc_id, page_number, 'default-full-page-' || page_number AS id, 0.03::DOUBLE AS x0, 0.03::DOUBLE AS y0, 1.0::DOUBLE - 0.03::DOUBLE AS x1, 1.0::DOUBLE - 0.03::DOUBLE AS y1,
 'normalized' AS coordinate_space, 'page' AS type, true AS selected, 1 AS reading_order, 'default_full_page' AS source FROM regions"""
)
def default_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.default_regions(S.regions(spark, sf_dir).select("doc_id", "page_number").distinct())


@query(with_views("regions") + "SELECT id FROM regions WHERE trim(type) <> '' AND (x1 - x0) * 40 >= 3 AND (y1 - y0) * 40 >= 3")
def layout_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected boxes that are not blank and at least three points wide and high on a page of 40 points."""
    big = ((F.col("x1") - F.col("x0")) * 40 >= 3) & ((F.col("y1") - F.col("y0")) * 40 >= 3)
    return S.regions(spark, sf_dir).where((T.strip(F.col("type")) != "") & big).select("id")


@query(with_views("regions") + "SELECT id, 'text' AS kind FROM regions WHERE type <> 'table' UNION ALL SELECT id, 'table' FROM regions WHERE type = 'table'")
def layout_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = S.regions(spark, sf_dir).select("id", "type")
    return r.where("type <> 'table'").select("id", F.lit("text").alias("kind")).unionByName(r.where("type = 'table'").select("id", F.lit("table").alias("kind")))


@query(
    with_views("regions")
    + """, saved AS (SELECT * FROM regions WHERE doc_id % 2 = 0) SELECT doc_id, page_number, id FROM saved UNION ALL SELECT r.doc_id, r.page_number, r.id || '-new' FROM regions r
 WHERE NOT EXISTS (SELECT 1 FROM saved s WHERE s.doc_id = r.doc_id AND s.page_number = r.page_number)"""
)
def regions_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = S.regions(spark, sf_dir).select("doc_id", "page_number", "id")
    return layout.resolved(r.where("doc_id % 2 = 0"), r.withColumn("id", F.concat("id", F.lit("-new"))))


@query(with_views("regions") + "SELECT 'copy-' || doc_id AS doc_id, id, x0, y0, x1, y1 FROM regions")
def regions_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.regions(spark, sf_dir).select(F.concat(F.lit("copy-"), "doc_id").alias("doc_id"), "id", *_BOX)


@query(with_views("regions") + "SELECT id, printf('p%04d_', page_number) || regexp_replace(id || ' /' || type, '[^a-zA-Z0-9_-]', '_', 'g') AS name FROM regions")
def output_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.regions(spark, sf_dir).select("id", layout.output_name(F.col("page_number"), F.concat("id", F.lit(" /"), "type")).alias("name"))


@query(
    with_views("regions")
    + """, p AS (SELECT doc_id, page_number, count(*) AS n, count(*) FILTER (WHERE selected) AS s FROM regions GROUP BY doc_id, page_number)
SELECT doc_id, count(*) AS saved_pages, sum(n)::BIGINT AS n_regions, sum(s)::BIGINT AS n_selected, string_agg(page_number, ',' ORDER BY page_number) AS pages FROM p GROUP BY doc_id"""
)
def boxes_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.boxes_summary(S.regions(spark, sf_dir))


@query(with_views("regions") + ", p AS (SELECT DISTINCT doc_id, page_number, 'render-' || doc_id || '-' || page_number AS image FROM regions WHERE selected) SELECT r.id, p.image FROM regions r JOIN p ON p.doc_id = r.doc_id AND p.page_number = r.page_number WHERE r.selected")
def regions_page_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page with a selected region is rendered once and joined to its regions."""
    chosen = layout.selected(S.regions(spark, sf_dir))
    renders = chosen.select("doc_id", "page_number").distinct().withColumn("image", F.concat(F.lit("render-"), "doc_id", F.lit("-"), "page_number"))
    return chosen.join(renders, ["doc_id", "page_number"]).select("id", "image")


@query(
    """WITH w AS (SELECT l_suppkey AS doc_id, 1 AS page_number, CAST(l_partkey % 612 AS DOUBLE) AS x0 FROM lineitem), s AS (SELECT doc_id, page_number, count(*) FILTER (WHERE x0 < 306) AS l, count(*) AS n FROM w GROUP BY doc_id, page_number)
SELECT doc_id, page_number, CASE WHEN least(l, n - l) >= 8 AND abs(l - (n - l)) / n < 0.8::DOUBLE THEN 2 ELSE 1 END AS n_columns FROM s"""
)
def column_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = S.table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS doc_id", "1 AS page_number", "CAST(l_partkey % 612 AS DOUBLE) AS x0", "612.0D AS page_width")
    return layout.column_estimate(words)


# Recognised text


@query(with_views("ocr_results") + f"SELECT doc_id, box_id FROM ocr_results WHERE {_STRIP.format('ocr_text')} <> ''")
def nonblank_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.ocr_results(spark, sf_dir).where(T.strip(F.col("ocr_text")) != "").select("doc_id", "box_id")


@query(
    with_views("ocr_results")
    + """, p AS (SELECT doc_id, page_number, count(*) AS n, count(*) FILTER (WHERE trim(ocr_text) <> '') AS f FROM ocr_results GROUP BY doc_id, page_number)
SELECT doc_id, sum(n)::BIGINT AS total_regions, sum(f)::BIGINT AS nonempty_regions, sum(n - f)::BIGINT AS empty_regions, coalesce(string_agg(page_number, ',' ORDER BY page_number) FILTER (WHERE f > 0), '') AS pages_with_text,
 coalesce(string_agg(page_number, ',' ORDER BY page_number) FILTER (WHERE f = 0), '') AS pages_without_text FROM p GROUP BY doc_id"""
)
def ocr_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.ocr_summary(S.ocr_results(spark, sf_dir))


@query(
    with_views("ocr_results")
    + """, r AS (SELECT doc_id, box_id, CASE WHEN reading_order % 2 = 0 THEN 'again ' || box_id ELSE ' ' END AS again FROM ocr_results WHERE trim(ocr_text) = '')
SELECT o.doc_id, o.box_id, trim(o.ocr_text) = '' AND coalesce(trim(r.again), '') <> '' AS retried, CASE WHEN trim(o.ocr_text) = '' AND coalesce(trim(r.again), '') <> '' THEN r.again ELSE o.ocr_text END AS ocr_text
FROM ocr_results o LEFT JOIN r ON r.doc_id = o.doc_id AND r.box_id = o.box_id"""
)
def retry_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    primary = S.ocr_results(spark, sf_dir).select("doc_id", "box_id", "reading_order", "ocr_text")
    retried = primary.where(T.strip(F.col("ocr_text")) == "").withColumn("ocr_text", F.when(F.col("reading_order") % 2 == 0, F.concat(F.lit("again "), "box_id")).otherwise(" "))
    return layout.with_retries(primary, retried).select("doc_id", "box_id", "retried", "ocr_text")


_L = T.LATIN
_PRE, _SUF = "regexp_replace({0}, '\\s+$', '')", "regexp_replace({0}, '^\\s+', '')"
_FOLLOW = f"""regexp_matches(a, '[{_L}]{{{{2,}}}}-$') AND regexp_matches(b, '^[{_L}]{{{{2,}}}}')""".replace("{{", "{").replace("}}", "}")
_SUFFIX = f"regexp_extract(b, '^[{_L}]{{2,}}')"
_LEFT = f"CASE WHEN {_FOLLOW} THEN left(a, length(a) - 1) || {_SUFFIX} ELSE a END"
_RIGHT = f"CASE WHEN {_FOLLOW} THEN regexp_replace(substr(b, length({_SUFFIX}) + 1), '^\\s+', '') ELSE b END"
_ENDS = "['.', '?', '!', ':', ';', ')', '\"', '''', '”', '’']"
_HEADING = f"""(h <> '' AND (starts_with(h, '#') OR (len(regexp_extract_all(h, '[{_L}]+')) BETWEEN 1 AND 7 AND length(h) <= 80 AND len(list_filter(regexp_extract_all(h, '[{_L}]+'), lambda w: regexp_matches(w, '^\\p{{Ll}}'))) = 0)))"""
_RUNS_ON = f"(l <> '' AND r <> '' AND NOT {_HEADING} AND (regexp_matches(r, '^\\p{{Ll}}') OR NOT list_contains({_ENDS}, right(l, 1))))"


@query(
    with_views("ocr_results").replace("WITH", "WITH RECURSIVE", 1)
    + f""", o AS (SELECT doc_id, {_STRIP.format("ocr_text")} AS t, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, reading_order, box_id) AS i FROM ocr_results WHERE {_STRIP.format("ocr_text")} <> ''),
f AS (SELECT doc_id, i, t FROM o WHERE i = 1 UNION ALL
 SELECT doc_id, i, l || CASE WHEN {_RUNS_ON} THEN ' ' ELSE chr(10) || chr(10) END || r FROM (
  SELECT *, regexp_replace(string_split(regexp_replace(r, '^\\s+|\\s+$', '', 'g'), chr(10))[1], '^\\s+|\\s+$', '', 'g') AS h FROM (
   SELECT doc_id, i, {_LEFT} AS l, {_RIGHT} AS r FROM (SELECT o.doc_id, o.i, {_PRE.format("f.t")} AS a, {_SUF.format("o.t")} AS b FROM f JOIN o ON o.doc_id = f.doc_id AND o.i = f.i + 1))))
SELECT doc_id, arg_max(t, i) AS text, count(*) AS n_spans FROM f GROUP BY doc_id"""
)
def compile_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compiling.compiled(S.ocr_results(spark, sf_dir)).select("doc_id", "text", F.size("spans").cast("long").alias("n_spans"))


@query(
    with_views("ocr_results")
    + f""", p AS (SELECT doc_id, box_id, {_PRE.format("ocr_text || CASE WHEN reading_order % 3 = 0 THEN ' co-' ELSE '' END")} AS a, {_SUF.format("lead(ocr_text) OVER (PARTITION BY doc_id ORDER BY page_number, reading_order, box_id)")} AS b FROM ocr_results),
q AS (SELECT doc_id, box_id, {_LEFT} AS l, {_RIGHT} AS r FROM p WHERE b IS NOT NULL), s AS (SELECT *, regexp_replace(string_split(regexp_replace(r, '^\\s+|\\s+$', '', 'g'), chr(10))[1], '^\\s+|\\s+$', '', 'g') AS h FROM q)
SELECT doc_id, box_id, l AS before, r AS after, {_RUNS_ON} AS runs_on FROM s"""
)
def join_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    order = Window.partitionBy("doc_id").orderBy("page_number", "reading_order", "box_id")
    marked = F.concat("ocr_text", F.when(F.col("reading_order") % 3 == 0, " co-").otherwise(""))
    pairs = S.ocr_results(spark, sf_dir).select("doc_id", "box_id", marked.alias("a"), F.lead("ocr_text").over(order).alias("b")).where("b IS NOT NULL")
    left, right = T.dehyphenated(F.col("a"), F.col("b"))
    return pairs.select("doc_id", "box_id", left.alias("l"), right.alias("r")).select(
        "doc_id", "box_id", F.col("l").alias("before"), F.col("r").alias("after"), T.joined_by_space(F.col("l"), F.col("r")).alias("runs_on")
    )


@query(f"""WITH p AS (SELECT doc_id, 'see the impro' || substr(lang, 1, (doc_id % 2)::INT) || '-  ' AS a0, CASE doc_id % 4 WHEN 0 THEN '  ment of it' WHEN 1 THEN 'x1' WHEN 2 THEN 'ment' ELSE text END AS b0 FROM documents),
q AS (SELECT doc_id, {_PRE.format("a0")} AS a, {_SUF.format("b0")} AS b FROM p) SELECT doc_id, {_LEFT} AS l, {_RIGHT} AS r FROM q""")
def dehyphenate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 4
    a = F.concat(F.lit("see the impro"), F.substring("lang", F.lit(1), (F.col("doc_id") % 2).cast("int")), F.lit("-  "))
    b = F.when(k == 0, "  ment of it").when(k == 1, "x1").when(k == 2, "ment").otherwise(F.col("text"))
    left, right = T.dehyphenated(a, b)
    return S.table(spark, sf_dir, "documents").select("doc_id", left.alias("l"), right.alias("r"))


def _all_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = S.ocr_results(spark, sf_dir).groupBy("doc_id").agg(F.max("page_number").alias("last"))
    return docs.select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("last") + 1)).alias("page_number"))


_PAGES = ", pg AS (SELECT doc_id, unnest(range(1, max(page_number) + 2)) AS page_number FROM ocr_results GROUP BY doc_id)"


@query(
    with_views("ocr_results")
    + _PAGES
    + f""", t AS (SELECT doc_id, page_number, string_agg({_STRIP.format("ocr_text")}, chr(10) || chr(10) ORDER BY reading_order, box_id) AS body FROM ocr_results WHERE {_STRIP.format("ocr_text")} <> '' GROUP BY doc_id, page_number)
SELECT doc_id, string_agg(chr(10) || '<!-- page: ' || page_number || ' -->' || chr(10) || chr(10) || coalesce(body, '') || chr(10), chr(10) ORDER BY page_number) AS markdown FROM pg LEFT JOIN t USING (doc_id, page_number) GROUP BY doc_id"""
)
def page_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compiling.page_by_page(_all_pages(spark, sf_dir), S.ocr_results(spark, sf_dir))


def _cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.ocr_results(spark, sf_dir).where("page_number % 3 <> 0").groupBy("doc_id", "page_number").agg(F.min("box_id").alias("text"))


@query(
    with_views("ocr_results")
    + _PAGES
    + ", c AS (SELECT doc_id, page_number, min(box_id) AS text FROM ocr_results WHERE page_number % 3 <> 0 GROUP BY doc_id, page_number) SELECT doc_id, page_number, coalesce(text, '') AS text, text IS NULL AS missing FROM pg LEFT JOIN c USING (doc_id, page_number)"
)
def cached_page_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.with_cached_pages(_all_pages(spark, sf_dir), _cached(spark, sf_dir)).select("doc_id", "page_number", "text", "missing")


@query(
    with_views("ocr_results")
    + _PAGES
    + ", c AS (SELECT DISTINCT doc_id, page_number FROM ocr_results WHERE page_number % 3 <> 0) SELECT doc_id, page_number FROM pg ANTI JOIN c USING (doc_id, page_number)"
)
def missing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_pages(spark, sf_dir).join(_cached(spark, sf_dir), ["doc_id", "page_number"], "left_anti").select("doc_id", "page_number")


# Markdown


def _paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.lines(spark, sf_dir).withColumn("page_number", F.floor(F.col("pos") / 20).cast("int") + 1)


_KIND = r"""CASE WHEN l = '' THEN 'blank' WHEN starts_with(l, '|') AND suffix(l, '|') THEN 'table' WHEN regexp_matches(l, '^#{1,6}\s+.+$') THEN 'heading' WHEN regexp_matches(l, '^[-*+]\s+') THEN 'list'
 WHEN regexp_matches(l, '(?i)^(table|figure)\s+\d+') THEN 'caption' ELSE 'paragraph' END"""
_KINDS = f", k AS (SELECT *, {_KIND} AS kind FROM pl)"
_PAGED = with_views("lines") + f", pl AS (SELECT doc_id, pos, CAST(pos // 20 AS INT) + 1 AS page_number, {_STRIP.format('line')} AS l FROM lines)" + _KINDS
_RUNS = r""", c AS (SELECT *, CASE WHEN coalesce(lag(kind) OVER w <> kind, true) OR kind IN ('heading', 'list', 'caption') THEN 1 ELSE 0 END AS fresh FROM k WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY pos)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, page_number ORDER BY pos) AS run FROM c),
b AS (SELECT doc_id, page_number, run, kind AS block_type, CASE WHEN kind = 'table' THEN '[TABLE]' ELSE string_agg(CASE kind WHEN 'heading' THEN regexp_replace(regexp_replace(l, '^#{1,6}\s+', ''), '^\s+|\s+$', '', 'g')
  WHEN 'list' THEN regexp_replace(l, '^[-*+]\s+', '') ELSE l END, ' ' ORDER BY pos) END AS text FROM g WHERE kind <> 'blank' GROUP BY doc_id, page_number, run, kind),
blocks AS (SELECT doc_id, page_number, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_number, run) - 1 AS INT) AS block_ord, block_type, text FROM b)
"""
_BLOCKS = _PAGED + _RUNS


@query(_PAGED + " SELECT doc_id, pos, kind FROM k")
def classify_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paged(spark, sf_dir).select("doc_id", F.col("pos").cast("long"), markdown.line_kind(T.strip(F.col("line"))).alias("kind"))


@query(_BLOCKS + "SELECT * FROM blocks")
def blocks_from_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.blocks(_paged(spark, sf_dir))


_TABLES = (
    _PAGED
    + r""", a AS (SELECT *, kind = 'table' AS is_row, kind = 'table' AND coalesce(lag(kind) OVER (PARTITION BY doc_id, page_number ORDER BY pos), '') <> 'table' AS fresh FROM k),
o AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id, page_number ORDER BY pos) AS t FROM a),
n AS (SELECT *, last_value(CASE WHEN regexp_matches(l, '(?i)^table\s+\d+') THEN l END IGNORE NULLS) OVER (PARTITION BY doc_id, page_number, t - is_row::INT ORDER BY pos) AS caption FROM o),
r AS (SELECT doc_id, page_number, t - 1 AS table_ord, arg_min(caption, pos) AS c0, min_by(caption, pos) AS caption, list(list_transform(string_split(regexp_replace(l, '^\|+|\|+$', '', 'g'), '|'), lambda x: trim(x)) ORDER BY pos) AS x, min(pos) AS p0 FROM n WHERE is_row GROUP BY ALL)
"""
)


@query(
    _TABLES
    + """, cap AS (SELECT n.doc_id, n.page_number, n.t - 1 AS table_ord, n.caption FROM n JOIN r ON r.doc_id = n.doc_id AND n.pos = r.p0)
SELECT r.doc_id, r.page_number, CAST(r.table_ord AS INT) AS table_ord, coalesce(cap.caption, '') AS caption, array_to_string(x[1], chr(31)) AS headers, len(x) - 1 AS n_rows FROM r JOIN cap ON cap.doc_id = r.doc_id AND cap.page_number = r.page_number AND cap.table_ord = r.table_ord"""
)
def extract_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = markdown.tables(_paged(spark, sf_dir))
    return found.select(
        "doc_id", "page_number", F.col("table_ord").cast("int"), F.coalesce("caption", F.lit("")).alias("caption"), F.array_join("headers", "\x1f").alias("headers"), F.size("rows").cast("long").alias("n_rows")
    )


_ESCAPED = "trim(replace(replace({0}, chr(10), '<br>'), '|', '\\|'))"
_GRID = """, g0 AS (SELECT n.doc_id, n.page_number, n.t - 1 AS table_ord, n.caption, list_filter(r.x, lambda c: len(list_filter(c, lambda y: y <> '')) > 0 OR len(c) > 1) AS x FROM n JOIN r ON r.doc_id = n.doc_id AND n.pos = r.p0),
grid AS (SELECT doc_id, page_number, CAST(table_ord AS INT) AS table_ord, caption, x[1] AS headers, CASE WHEN len(x) > 2 AND len(list_filter(x[2], lambda y: regexp_replace(y, '^[-: ]+', '') <> '')) = 0 THEN x[3:] ELSE x[2:] END AS rows FROM g0)
"""


@query(
    _TABLES
    + _RUNS
    + _GRID
    + f""", named AS (SELECT *, coalesce(caption, 'Table ' || row_number() OVER (PARTITION BY doc_id ORDER BY page_number, table_ord)) AS title FROM grid),
md AS (SELECT doc_id, page_number, string_agg(chr(10) || '### ' || title || chr(10) || chr(10) || array_to_string(list_concat(['<table class="structured-table">', '<thead><tr>'], list_transform(headers, lambda h: '<th>' || {_ESCAPED.format("h")} || '</th>'), ['</tr></thead>', '<tbody>'],
  flatten(list_transform(rows, lambda y: list_concat(['<tr>'], list_transform(y, lambda c: '<td>' || {_ESCAPED.format("c")} || '</td>'), ['</tr>']))), ['</tbody></table>']), chr(10)), chr(10) ORDER BY table_ord) AS tables_md FROM named GROUP BY doc_id, page_number),
kept AS (SELECT *, coalesce(lag(page_number) OVER w <> page_number, true) AS turned, row_number() OVER (PARTITION BY doc_id, page_number, block_type ORDER BY block_ord) AS nth FROM blocks WHERE block_type = 'table' OR text <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY block_ord)),
parts AS (SELECT doc_id, block_ord, CASE WHEN turned THEN chr(10) || '<!-- page: ' || page_number || ' -->' || chr(10) || chr(10) ELSE '' END AS mark, CASE WHEN block_type = 'heading' THEN '## ' || text || chr(10) WHEN block_type = 'list' THEN '- ' || text || chr(10)
  WHEN block_type = 'caption' THEN '*' || text || '*' || chr(10) WHEN block_type = 'table' THEN CASE WHEN nth = 1 THEN tables_md END ELSE text || chr(10) END AS body FROM kept LEFT JOIN md USING (doc_id, page_number)),
pieces AS (SELECT doc_id, block_ord, CASE WHEN body IS NULL THEN CASE WHEN mark <> '' THEN rtrim(mark, chr(10)) END ELSE mark || body END AS piece FROM parts)
SELECT doc_id, coalesce(string_agg(piece, chr(10) ORDER BY block_ord), '') AS markdown FROM pieces GROUP BY doc_id"""
)
def build_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _paged(spark, sf_dir)
    return markdown.markdown(markdown.blocks(lines), markdown.tables(lines))


@query(
    _TABLES
    + _RUNS
    + f""", j AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY block_ord) AS t FROM blocks WHERE block_type IN ('paragraph', 'heading') GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, page_number, table_ord FROM r) GROUP BY doc_id), s AS (SELECT doc_id, {_STRIP.format("left(t, 4000)")} AS sample FROM j),
b2 AS (SELECT doc_id, count(*) AS n_blocks, count(*) FILTER (WHERE block_type = 'heading') AS n_headings, string_agg(block_type || ': ' || text, chr(10) ORDER BY block_ord) AS content FROM blocks GROUP BY doc_id)
SELECT b2.doc_id, n_blocks, n_headings, content, coalesce(m.n, 0) AS n_tables, CASE WHEN length(sample) >= 40 THEN sample END AS sample FROM b2 LEFT JOIN m USING (doc_id) LEFT JOIN s USING (doc_id)"""
)
def build_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's blocks in order, their number, its tables' and its language sample."""
    lines = _paged(spark, sf_dir)
    found = markdown.blocks(lines)
    item = F.struct("block_ord", F.concat("block_type", F.lit(": "), "text").alias("piece"))
    content = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["piece"]), "\n")
    counts = found.groupBy("doc_id").agg(F.count("*").alias("n_blocks"), F.count_if(F.col("block_type") == "heading").alias("n_headings"), content.alias("content"))
    tables = markdown.tables(lines).groupBy("doc_id").agg(F.count("*").alias("n_tables"))
    return counts.join(tables, "doc_id", "left").join(markdown.language_sample(found), "doc_id", "left").fillna(0, ["n_tables"])


@query(
    with_views("ocr_results")
    + f""", pages_of AS (SELECT doc_id, page_number, string_agg(ocr_text, chr(10) || chr(10) ORDER BY reading_order, ocr_text) AS text FROM ocr_results GROUP BY doc_id, page_number),
pl AS (SELECT doc_id, page_number, generate_subscripts(x, 1) - 1 AS pos, {_STRIP.format("unnest(x)")} AS l FROM (SELECT doc_id, page_number, string_split(text, chr(10)) AS x FROM pages_of))"""
    + _KINDS
    + _RUNS
    + "SELECT * FROM blocks"
)
def cached_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of documents from cached page texts."""
    pages = S.ocr_results(spark, sf_dir).groupBy("doc_id", "page_number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("reading_order", "ocr_text"))), lambda x: x["ocr_text"]), "\n\n").alias("text"))
    lines = pages.select("doc_id", "page_number", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return markdown.blocks(lines)


@query(
    _BLOCKS
    + f", j AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY block_ord) AS t FROM blocks WHERE block_type IN ('paragraph', 'heading') GROUP BY doc_id) SELECT doc_id, CASE WHEN length({_STRIP.format('left(t, 4000)')}) >= 40 THEN {_STRIP.format('left(t, 4000)')} END AS sample FROM j"
)
def language_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.language_sample(markdown.blocks(_paged(spark, sf_dir)))


@query(
    _BLOCKS
    + """SELECT doc_id, block_ord, coalesce(last_value(CASE WHEN block_type = 'heading' AND text <> '' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS context FROM blocks"""
)
def section_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return translation.section_context(markdown.blocks(_paged(spark, sf_dir))).select("doc_id", "block_ord", "context")


@query(_BLOCKS + "SELECT doc_id, block_ord FROM blocks WHERE block_type NOT IN ('header', 'footer') AND text <> ''")
def translatable_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = markdown.blocks(_paged(spark, sf_dir))
    return found.where(~F.col("block_type").isin("header", "footer") & (T.strip(F.col("text")) != "")).select("doc_id", "block_ord")


@query(
    _TABLES
    + """, d AS (SELECT DISTINCT doc_id, page_number, CAST(table_ord AS INT) AS table_ord FROM r), e AS (SELECT *, unnest(CASE WHEN table_ord % 2 = 1 THEN [page_number, page_number + 1] ELSE [page_number] END) AS on_page FROM d)
SELECT doc_id, page_number, table_ord, CAST(on_page AS INT) AS on_page, on_page = page_number AS written FROM e"""
)
def tables_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables on each of their pages (odd ones reach onto the next page), marked where they are written first."""
    from pyspark.sql.window import Window

    found = markdown.tables(_paged(spark, sf_dir)).select("doc_id", "page_number", F.col("table_ord").cast("int"))
    pages = found.withColumn("on_page", F.explode(F.when(F.col("table_ord") % 2 == 1, F.array("page_number", F.col("page_number") + 1)).otherwise(F.array("page_number"))))
    first = Window.partitionBy("doc_id", "page_number", "table_ord").orderBy("on_page")
    return pages.withColumn("written", F.row_number().over(first) == 1)


# Translation


def _boxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as blocks with boxes: two columns of ten lines in turn, a hyphen at every fifth paragraph's end."""
    rows = S.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("block_ord", "text"))
    return rows.selectExpr(
        "doc_id",
        "block_ord",
        "concat('b', doc_id, '-', block_ord) AS block_id",
        "CAST(block_ord div 50 + 1 AS INT) AS page_number",
        "CASE WHEN block_ord % 7 = 0 THEN 'heading' WHEN block_ord % 9 = 5 THEN 'list' ELSE 'paragraph' END AS block_type",
        "concat(text, CASE WHEN block_ord % 5 = 2 THEN '-' ELSE '' END) AS text",
        "CASE WHEN (block_ord div 10) % 2 = 0 THEN 50D ELSE 350D END AS x0",
        "CAST(block_ord AS DOUBLE) * 12 AS y0",
        "CAST(block_ord AS DOUBLE) * 12 + 10 AS y1",
        "CASE WHEN block_ord % 11 = 8 THEN 16D ELSE 10D END AS font_size",
    )


_BOXED = """WITH l AS (SELECT doc_id, unnest(x) AS raw, generate_subscripts(x, 1) - 1 AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
bx AS (SELECT doc_id, i, 'b' || doc_id || '-' || i AS block_id, i // 50 AS pg, CASE WHEN i % 7 = 0 THEN 'heading' WHEN i % 9 = 5 THEN 'list' ELSE 'paragraph' END AS kind, raw || CASE WHEN i % 5 = 2 THEN '-' ELSE '' END AS t,
 (i // 10) % 2 AS col, i * 12 AS y0, i * 12 + 10 AS y1, CASE WHEN i % 11 = 8 THEN 16 ELSE 10 END AS fs FROM l),
kp AS (SELECT *, coalesce(last_value(CASE WHEN kind = 'heading' AND regexp_replace(t, '\\s', '', 'g') <> '' THEN regexp_replace(t, '^\\s+|\\s+$', '', 'g') END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS context FROM bx),
ne AS (SELECT * FROM kp WHERE regexp_replace(t, '\\s', '', 'g') <> ''),
cn AS (SELECT *, CASE WHEN kind = 'paragraph' AND lag(kind) OVER w = 'paragraph' AND lag(pg) OVER w = pg AND lag(col) OVER w = col AND abs(lag(fs) OVER w - fs) <= 2 AND y0 - lag(y1) OVER w >= -1
 AND y0 - lag(y1) OVER w <= greatest(7.5::DOUBLE, lag(fs) OVER w * 0.9::DOUBLE) AND NOT (regexp_matches(regexp_replace(lag(t) OVER w, '\\s+$', ''), '[.!?:;]$') AND regexp_matches(regexp_replace(t, '^\\s+', ''), '^\\p{Lu}')) THEN 0 ELSE 1 END AS fresh
 FROM ne WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
gr AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS unit_ord FROM cn),
un AS (SELECT doc_id, unit_ord, first(kind) AS kind, arg_min(context, i) AS context, string_agg(block_id, ',' ORDER BY i) AS ids, list(regexp_replace(t, '^\\s+|\\s+$', '', 'g') ORDER BY i) AS ts FROM gr GROUP BY doc_id, unit_ord)
"""


@query(
    _BOXED
    + f"""SELECT doc_id, CAST(unit_ord AS INT) AS unit_ord, ids, kind AS block_type, context, CASE WHEN kind = 'paragraph' THEN {_COMPACT.format("array_to_string(list_transform(ts, lambda l, k: CASE WHEN k = len(ts) THEN l WHEN suffix(l, '-') THEN left(l, length(l) - 1) ELSE l || ' ' END), '')")} ELSE ts[1] END AS text FROM un"""
)
def paragraph_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = translation.units(_boxed(spark, sf_dir))
    return made.select("doc_id", F.col("unit_ord").cast("int"), F.array_join("block_ids", ",").alias("ids"), "block_type", "context", "text")


@query(
    _TABLES
    + _RUNS
    + _GRID
    + f""", ub AS (SELECT * FROM blocks WHERE block_type <> 'table' AND text <> ''),
uc AS (SELECT *, CASE WHEN block_type = 'paragraph' AND lag(block_type) OVER w = 'paragraph' AND lag(page_number) OVER w = page_number AND block_ord - lag(block_ord) OVER w <= 9
  AND NOT (regexp_matches(lag(text) OVER w, '[.!?:;]$') AND regexp_matches(text, '^\\p{{Lu}}')) THEN 0 ELSE 1 END AS fresh FROM ub WINDOW w AS (PARTITION BY doc_id ORDER BY block_ord)),
ud AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY block_ord) - 1 AS unit FROM uc),
ue AS (SELECT doc_id, unit, first(block_type) AS kind, string_agg('b' || doc_id || '-' || block_ord, ',' ORDER BY block_ord) AS ids, list(text ORDER BY block_ord) AS ts FROM ud GROUP BY doc_id, unit),
parts AS (SELECT doc_id, table_ord * 100000 - 1 AS ord, '__table_header__:t' || page_number || '-' || table_ord AS ids, headers AS cells, page_number FROM grid WHERE len(headers) > 0
  UNION ALL SELECT doc_id, table_ord * 100000 + i - 1, '__table_row__:t' || page_number || '-' || table_ord || ':' || (i - 1), y, page_number FROM (SELECT *, unnest(rows) AS y, generate_subscripts(rows, 1) AS i FROM grid))
SELECT doc_id, 0 AS part, CAST(unit AS BIGINT) AS ord, ids, kind AS block_type, CASE WHEN kind = 'paragraph' THEN {_COMPACT.format("array_to_string(list_transform(ts, lambda l, k: CASE WHEN k = len(ts) THEN l WHEN suffix(l, '-') THEN left(l, length(l) - 1) ELSE l || ' ' END), '')")} ELSE ts[1] END AS text FROM ue
UNION ALL SELECT doc_id, 1, CAST(ord AS BIGINT), ids, 'table', array_to_string(cells, chr(10) || '|||CELL_BREAK|||' || chr(10)) FROM parts"""
)
def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All translation units: blocks in order, then table parts."""
    lines = _paged(spark, sf_dir)
    found = markdown.blocks(lines).withColumn("block_id", F.concat(F.lit("b"), "doc_id", F.lit("-"), "block_ord"))
    boxed = found.select("*", F.lit(0.0).alias("x0"), F.col("block_ord").cast("double").alias("y0"), F.col("block_ord").cast("double").alias("y1"), F.lit(10.0).alias("font_size"))
    text_units = translation.units(boxed.where("block_type <> 'table'")).select("doc_id", F.lit(0).alias("part"), F.col("unit_ord").cast("long").alias("ord"), "block_ids", "block_type", "text")
    tables = markdown.tables(lines).withColumn("table_id", F.concat(F.lit("t"), "page_number", F.lit("-"), "table_ord"))
    parts = translation.table_units(tables, F.lit(""))
    parts = parts.select("doc_id", F.lit(1).alias("part"), (F.col("table_ord") * 100_000 + F.col("row_ord")).cast("long").alias("ord"), "block_ids", "block_type", "text")
    return text_units.unionByName(parts).withColumn("block_ids", F.array_join("block_ids", ",")).withColumnRenamed("block_ids", "ids")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = translation.chunked(translation.units(_boxed(spark, sf_dir)), 128)
    docs = S.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return made.join(docs, "doc_id").withColumn("skipped", T.skip_translation(F.col("source_text"), F.col("lang"))).drop("lang")


@query(with_views("lines") + "SELECT l.doc_id, l.pos, d.lang FROM lines l LEFT JOIN documents d ON d.doc_id = l.doc_id AND l.pos % 2 = 0")
def chunk_block_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with their block's facts; a chunk without a block keeps nulls."""
    blocks = S.table(spark, sf_dir, "documents").select(F.concat("doc_id", F.lit("-0")).alias("block_id"), "lang")
    chunks = S.lines(spark, sf_dir).select("doc_id", F.col("pos").cast("long"), F.concat("doc_id", F.lit("-"), F.col("pos") % 2).alias("block_id"))
    return chunks.join(blocks, "block_id", "left").select("doc_id", "pos", "lang")


@query(
    with_views("markup")
    + r", h AS (SELECT page_id, contains(lower(text), '<table') AND (contains(lower(text), '<tr') OR regexp_matches(lower(text), '&lt;\s*tr\b')) AND contains(lower(text), '</table>') AS heavy FROM markup) SELECT page_id, CAST(row_number() OVER (ORDER BY page_id) AS INT) AS ordinal FROM h WHERE heavy"
)
def table_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of each chunk with a table among them, counted over range partitions so that no task sees all rows."""
    from pyspark.sql.window import Window

    heavy = S.markup(spark, sf_dir).where(T.table_heavy(F.col("text"))).select("page_id")
    parts = heavy.withColumn("part", F.floor(F.col("page_id") / 10_000))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy("part").count().withColumn("offset", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    at = F.row_number().over(Window.partitionBy("part").orderBy("page_id"))
    return parts.withColumn("at", at).join(offsets, "part").select("page_id", (F.col("at") + F.col("offset")).cast("int").alias("ordinal"))


_UNIT_TEXT = f"CASE WHEN kind = 'paragraph' THEN {_COMPACT.format("array_to_string(list_transform(ts, lambda l, k: CASE WHEN k = len(ts) THEN l WHEN suffix(l, '-') THEN left(l, length(l) - 1) ELSE l || ' ' END), '')")} ELSE ts[1] END"
_CHUNKED = (
    _BOXED
    + f""", src AS (SELECT {{'d': doc_id, 'u': unit_ord}} AS k, {_UNIT_TEXT} AS t FROM un),
{chunks_sql("src", 128)},
ck AS (SELECT k.d AS doc_id, k.u AS unit_ord, unnest(x) AS text, generate_subscripts(x, 1) AS part FROM packed),
cl AS (SELECT ck.doc_id, ck.unit_ord, ck.part, ck.text, d.lang AS language, un.kind, un.ids, {_CLEAN.format("ck.text")} AS clean FROM ck JOIN un ON un.doc_id = ck.doc_id AND un.unit_ord = ck.unit_ord JOIN documents d ON d.doc_id = ck.doc_id),
ce AS (SELECT *, {_FOUND} AS found FROM cl),
cs AS (SELECT doc_id, unit_ord, kind, ids, text AS s, '[' || text || ']' AS bracketed, CASE WHEN language = 'en' OR (language IS NULL AND {_STRIP.format("text")} <> '') THEN {_ENGLISH} ELSE false END AS skipped,
  CAST(row_number() OVER (PARTITION BY doc_id ORDER BY unit_ord, part) - 1 AS INT) AS chunk_ord FROM ce)
"""
)


def _holds(t: str) -> str:
    """SQL: whether the translation `t` keeps the structure of the chunk `s` of a block of `kind`."""
    items, heads = r"(?m)^\s*[-*+]\s+\S", r"(?m)^\s{0,3}#{1,6}\s+\S"
    return f"""(length({t}) > 0 AND NOT ((length(s) >= 200 AND length({t}) < greatest(40, floor(length(s) * 0.2::DOUBLE))) OR ({_PARAGRAPHS.format("s")} >= 3 AND {_PARAGRAPHS.format(t)} < greatest(2, {_PARAGRAPHS.format("s")} // 2))
  OR ({_COUNT.format("s", items)} > 0 AND {_COUNT.format(t, items)} < {_COUNT.format("s", items)}) OR ({_COUNT.format("s", heads)} > 0 AND {_COUNT.format(t, heads)} < {_COUNT.format("s", heads)})
  OR (kind = 'heading' AND contains({t}, chr(10) || chr(10)))))"""


def _joined(column: str) -> str:
    """SQL: the texts of a unit's chunks, joined by blank lines if there are more than one."""
    return f"CASE WHEN count(*) = 1 THEN first({column}) ELSE coalesce(string_agg({_STRIP.format(column)}, chr(10) || chr(10) ORDER BY chunk_ord) FILTER (WHERE {_STRIP.format(column)} <> ''), '') END"


@query(_CHUNKED + f"SELECT doc_id, min(chunk_ord) AS chunk_ord, ids, {_joined('s')} AS source_text, {_joined('bracketed')} AS translated_text FROM cs GROUP BY doc_id, unit_ord, ids")
def coalesce_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir).withColumn("translated_text", F.concat(F.lit("["), "source_text", F.lit("]")))
    return translation.coalesced(chunks).select("doc_id", "chunk_ord", F.array_join("block_ids", ",").alias("ids"), "source_text", "translated_text")


@query(
    _CHUNKED
    + f"""SELECT doc_id, chunk_ord, CASE WHEN skipped THEN 'skipped' WHEN {_holds("'short'")} THEN 'translated' WHEN {_holds("bracketed")} THEN 'retried' ELSE 'source' END AS outcome,
 CASE WHEN skipped THEN 0 WHEN {_holds("'short'")} THEN 1 ELSE 2 END AS attempts, CASE WHEN skipped THEN s WHEN {_holds("'short'")} THEN 'short' WHEN {_holds("bracketed")} THEN bracketed ELSE s END AS translated_text FROM cs"""
)
def validated_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks through a model that fails at first and answers at the second call."""
    done = translation.translated(_chunks(spark, sf_dir), translation.FirstTryFails)
    return done.select("doc_id", "chunk_ord", "outcome", "attempts", "translated_text")


@query()
def table_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with tables through a model that keeps markup."""
    rows = S.markup(spark, sf_dir).select("page_id", F.col("text").alias("source_text"), F.lit("").alias("context"), F.lit("table").alias("block_type"), F.lit(False).alias("skipped"))
    return translation.translated(rows, translation.IdentityTranslator).select("page_id", "outcome", "attempts", "translated_text")


@query(
    _CHUNKED
    + f""", done AS (SELECT *, CASE WHEN skipped THEN s WHEN {_holds("bracketed")} THEN bracketed ELSE s END AS now FROM cs),
whole AS (SELECT doc_id, unit_ord, {_joined("now")} AS text FROM done GROUP BY doc_id, unit_ord),
placed AS (SELECT doc_id, i, block_id, unit_ord, row_number() OVER (PARTITION BY doc_id, unit_ord ORDER BY i) AS nth, first(block_id) OVER (PARTITION BY doc_id, unit_ord ORDER BY i) AS head FROM gr)
SELECT bx.doc_id, CAST(bx.i AS INT) AS block_ord, CASE WHEN nth > 1 THEN head END AS merged_into, CASE WHEN nth IS NULL THEN bx.t WHEN nth = 1 THEN {_STRIP.format("whole.text")} ELSE '' END AS text
FROM bx LEFT JOIN placed ON placed.doc_id = bx.doc_id AND placed.i = bx.i LEFT JOIN whole ON whole.doc_id = placed.doc_id AND whole.unit_ord = placed.unit_ord"""
)
def translate_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks after translation: skipped, bracketed and merged."""
    chunks = translation.coalesced(translation.translated(_chunks(spark, sf_dir), translation.BracketTranslator))
    return translation.applied(_boxed(spark, sf_dir), chunks).select("doc_id", "block_ord", "merged_into", "text")


@query("""WITH r AS (SELECT l_orderkey AS table_id, l_linenumber - 1 AS row_ord, '<tr><td>' || l_partkey || '</td></tr>' AS row, CASE WHEN l_partkey % 11 = 0 THEN '<tr>cut' ELSE '<tr><td>new</td></tr>' END AS new_row FROM lineitem),
w AS (SELECT *, bool_and(regexp_matches(new_row, '(?is)^<tr\\b[^>]*>.*</tr>$')) OVER (PARTITION BY table_id, row_ord // 8) AS ok FROM r)
SELECT table_id, CAST(row_ord AS INT) AS row_ord, CASE WHEN ok THEN new_row ELSE row END AS row, ok AS replaced FROM w""")
def row_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS table_id",
        "CAST(l_linenumber - 1 AS INT) AS row_ord",
        "concat('<tr><td>', l_partkey, '</td></tr>') AS row",
        "CASE WHEN l_partkey % 11 = 0 THEN '<tr>cut' ELSE '<tr><td>new</td></tr>' END AS new_row",
    )
    return translation.row_groups(rows).select("table_id", "row_ord", "row", "replaced")


@query("""WITH t AS (SELECT '__table_row__:' || l_orderkey || ':' || (l_linenumber - 1) AS id, l_shipmode AS cell FROM (SELECT *, 'm' || l_partkey AS l_shipmode FROM lineitem) WHERE l_linenumber % 2 = 0)
SELECT l.l_orderkey AS table_id, CAST(l.l_linenumber - 1 AS INT) AS row_ord, coalesce(t.cell, 'old') AS cell FROM lineitem l LEFT JOIN t ON regexp_extract(t.id, '^__table_row__:(.*):\\d+$', 1) = l.l_orderkey::VARCHAR AND regexp_extract(t.id, ':(\\d+)$', 1)::INT = l.l_linenumber - 1""")
def table_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translated rows put back into their tables by the ids that hold table and row."""
    rows = S.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS table_id", "CAST(l_linenumber - 1 AS INT) AS row_ord", "l_partkey", "l_linenumber")
    sent = rows.where("l_linenumber % 2 = 0").selectExpr(f"concat('{translation.ROW_ID}', table_id, ':', row_ord) AS id", "concat('m', l_partkey) AS cell")
    target = sent.select(F.regexp_extract("id", r"^__table_row__:(.*):\d+$", 1).cast("long").alias("table_id"), F.regexp_extract("id", r":(\d+)$", 1).cast("int").alias("row_ord"), "cell")
    return rows.join(target, ["table_id", "row_ord"], "left").select("table_id", "row_ord", F.coalesce("cell", F.lit("old")).alias("cell"))


# Reports


_QA = """WITH c AS (SELECT l.doc_id, l.pos, l.raw AS s, left(l.raw, (length(l.raw) * (l.pos % 5) // 5)::INT) AS t FROM (SELECT doc_id, unnest(x) AS raw, generate_subscripts(x, 1) - 1 AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)) l)
"""


def _qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_ord", "source_text"))
    cut = F.left("source_text", F.floor(F.length("source_text") * (F.col("chunk_ord") % 5) / 5).cast("int"))
    return rows.withColumn("translated_text", cut).withColumn("chunk_id", F.concat(F.lit("chunk-"), "chunk_ord"))


@query(
    _QA
    + """SELECT doc_id, count(*) AS n_chunks, count(*) FILTER (WHERE regexp_replace(t, '\\s', '', 'g') <> '') AS n_translated, coalesce(string_agg('chunk-' || pos, ',' ORDER BY pos) FILTER (WHERE length(s) > 0 AND length(t) = 0), '') AS empty_ids,
 coalesce(string_agg('chunk-' || pos, ',' ORDER BY pos) FILTER (WHERE length(s) >= 200 AND length(t) < length(s) * 0.25::DOUBLE), '') AS short_ids FROM c GROUP BY doc_id"""
)
def chunk_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.chunk_qa(_qa(spark, sf_dir))


_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in reports.FAILURES.items())
_FIX_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in reports.FIXES.items())


@query(f"""WITH f AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'empty' WHEN doc_id % 7 = 0 THEN 'short' WHEN doc_id % 5 = 0 THEN 'table' WHEN length(text) > 0 AND length(text) * (doc_id % 10) // 10 < length(text) * 0.35::DOUBLE THEN 'length' ELSE 'none' END AS k FROM documents)
SELECT doc_id, CASE k {_CASES} END AS failure, CASE k {_FIX_CASES} END AS fix FROM f""")
def failure_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    n = F.length("text")
    key = reports.failure(d % 11 == 0, d % 7 == 0, d % 5 == 0, T.paragraph_count(F.col("text")), F.lit(1), n, F.floor(n * (d % 10) / 10))
    return S.table(spark, sf_dir, "documents").select("doc_id", reports.described(key, reports.FAILURES).alias("failure"), reports.described(key, reports.FIXES).alias("fix"))


_EXACT = "CAST(seconds AS DECIMAL(20,6))"


@query(
    with_views("timings")
    + f"SELECT job_id, CAST(page AS VARCHAR) AS page, stage, CAST(sum({_EXACT}) AS DOUBLE) AS seconds FROM timings WHERE page IS NOT NULL GROUP BY job_id, page, stage UNION ALL SELECT job_id, 'ALL', stage, CAST(sum({_EXACT}) AS DOUBLE) FROM timings GROUP BY job_id, stage"
)
def profile_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.profile(S.timings(spark, sf_dir)).withColumn("page", F.coalesce(F.col("page").cast("string"), F.lit("ALL")))


@query(
    with_views("timings")
    + f""", p AS (SELECT job_id, stage, page, sum({_EXACT}) AS s FROM timings GROUP BY job_id, stage, page), t AS (SELECT job_id, stage, CAST(sum(s) AS DOUBLE) AS total, count(*) FILTER (WHERE page IS NOT NULL AND s > 0) AS n_pages FROM p GROUP BY job_id, stage)
SELECT *, CASE WHEN n_pages > 0 THEN total / n_pages END AS mean FROM t"""
)
def profile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.profile_summary(S.timings(spark, sf_dir))


# Jobs

_SOURCE = r"CASE WHEN regexp_matches(filename, '^.+\s\(\d+\)(\.[^.]*)?$') THEN regexp_replace(filename, '\s\(\d+\)(\.[^.]*)?$', '\1') ELSE filename END"


@query(
    with_views("jobs")
    + rf", a AS (SELECT {_SOURCE} AS source, max(attempt) + 1 AS next_attempt FROM jobs GROUP BY 1) SELECT source, next_attempt, regexp_extract(source, '^(.+?)(\.[^.]*)?$', 1) || ' (' || next_attempt || ')' || regexp_extract(source, '^(.+?)(\.[^.]*)?$', 2) AS next_name FROM a"
)
def attempt_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.next_attempts(S.jobs(spark, sf_dir))


@query(
    with_views("jobs")
    + rf"""SELECT event_id, CASE WHEN attempt <= 0 THEN filename ELSE regexp_extract(filename, '^(.+?)(\.[^.]*)?$', 1) || ' (' || attempt || ')' || regexp_extract(filename, '^(.+?)(\.[^.]*)?$', 2) END AS name, {_SOURCE} AS source,
 regexp_replace(filename, '^(.+?)(\.[^.]*)?$', '\1 OCR rerun\2') AS rerun FROM jobs"""
)
def attempt_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("filename")
    return S.jobs(spark, sf_dir).select("event_id", jobs.attempt_name(f, F.col("attempt")).alias("name"), jobs.source_name(f).alias("source"), jobs.rerun_name(f).alias("rerun"))


@query(
    with_views("jobs")
    + """, l AS (SELECT job_id, arg_max(stage, event_id) AS stage FROM jobs GROUP BY job_id) SELECT count(*) FILTER (WHERE stage IN ('complete', 'failed', 'cancelled')) AS ended,
 count(*) FILTER (WHERE stage IN ('extraction', 'ocr_layout_parsing', 'structure_generation', 'translation', 'pdf_generation')) AS active, count(*) FILTER (WHERE stage = 'upload') AS waiting FROM l"""
)
def terminal_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.stage_counts(S.jobs(spark, sf_dir))


@query(with_views("jobs") + "SELECT job_id, arg_max(stage, event_id) AS stage, arg_max(filename, event_id) AS filename FROM jobs GROUP BY job_id")
def latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.latest(S.jobs(spark, sf_dir)).select("job_id", "stage", "filename")


_STAGES = "['upload', 'extraction', 'ocr_layout_parsing', 'structure_generation', 'translation', 'pdf_generation', 'complete']"


@query(
    with_views("jobs")
    + f""", p AS (SELECT event_id, stage, lag(stage) OVER (PARTITION BY job_id ORDER BY event_id) AS previous FROM jobs)
SELECT event_id, previous, CASE WHEN previous IS NULL THEN stage = 'upload' WHEN previous IN ('complete', 'failed', 'cancelled') THEN false WHEN stage IN ('cancelled', 'failed') THEN true ELSE list_position({_STAGES}, stage) >= list_position({_STAGES}, previous) END AS allowed FROM p"""
)
def stage_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.transitions(S.jobs(spark, sf_dir)).select("event_id", "previous", "allowed")


@query(
    with_views("jobs")
    + """, q AS (SELECT event_id, row_number() OVER (PARTITION BY job_id ORDER BY event_id) - 1 + CASE WHEN job_id % 2 = 0 THEN 1 ELSE 0 END AS ahead FROM jobs)
SELECT event_id, CASE WHEN ahead > 0 THEN 'Queued. Waiting for ' || ahead || ' job(s) ahead.' ELSE 'Queued. Waiting for processing to start.' END AS message FROM q"""
)
def queue_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    queued = S.jobs(spark, sf_dir).select("event_id", F.col("job_id").alias("queue"), F.col("event_id").alias("arrival"))
    return jobs.queue_messages(queued, F.col("queue") % 2 == 0).select("event_id", "message")


@query(with_views("jobs") + "SELECT event_id, stage NOT IN ('extraction', 'ocr_layout_parsing', 'structure_generation', 'translation', 'pdf_generation') AS eligible FROM jobs")
def rerun_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.jobs(spark, sf_dir).select("event_id", jobs.rerun_eligible(F.col("stage")).alias("eligible"))


@query(with_views("jobs") + "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'full_page' WHEN event_id % 3 = 0 THEN 'selected_regions' ELSE 'error: no cache' END AS choice FROM jobs")
def cache_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return S.jobs(spark, sf_dir).select("event_id", jobs.cache_choice(e % 2 == 0, e % 3 == 0).alias("choice"))


@query(
    with_views("jobs")
    + """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'full_page' WHEN event_id % 2 = 0 AND event_id % 3 = 0 THEN 'full_page' WHEN event_id % 2 = 0 THEN 'error: no results' WHEN event_id % 7 = 0 THEN 'error: no text' ELSE 'selected_regions' END AS decision FROM jobs"""
)
def start_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    mode = F.when(e % 5 == 0, "full_page").when(e % 5 == 1, "other").otherwise("selected_regions")
    return S.jobs(spark, sf_dir).select("event_id", jobs.start_decision(e % 2 != 0, e % 7, mode, e % 3 == 0).alias("decision"))


_EVENT_NAMES = ("model_loading", "model_loaded", "page_started", "page_done", "other")


def _worker_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as a worker writes them: an event of five kinds, every tenth line is no JSON."""
    names = ", ".join(f"'{n}'" for n in _EVENT_NAMES)
    line = f"""CASE WHEN event_id % 10 = 9 THEN 'loading weights' ELSE concat('{{"event": "', element_at(array({names}), CAST(event_id % 5 + 1 AS INT)), '", "phase": "', CASE WHEN event_id % 3 = 0 THEN 'retry' ELSE 'primary' END,
 '", "index": ', event_id % 16, ', "total": 16, "pages": ', event_id % 4, ', "chars": ', event_id % 7, '}}') END"""
    return S.table(spark, sf_dir, "events").selectExpr("event_id", f"{line} AS value")


_WORKER = f"""WITH w AS (SELECT event_id, ({list(_EVENT_NAMES)})[CAST(event_id % 5 + 1 AS INT)] AS event, CASE WHEN event_id % 3 = 0 THEN 'retry' ELSE 'primary' END AS phase, event_id % 16 AS i, event_id % 4 AS p, event_id % 7 AS c FROM events WHERE event_id % 10 <> 9)
"""


@query(_WORKER + "SELECT event, phase, CAST(i AS VARCHAR) AS index, '16' AS total, CAST(p AS VARCHAR) AS pages, CAST(c AS VARCHAR) AS chars FROM w")
def event_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.parsed_events(_worker_lines(spark, sf_dir).select("value"))


_LABEL = "CASE WHEN phase = 'primary' THEN 'OCR selected regions' ELSE 'Retrying empty OCR regions' END"


@query(
    _WORKER
    + f"""SELECT event, phase, CAST(i AS VARCHAR) AS index, CASE event WHEN 'model_loading' THEN 0.35::DOUBLE WHEN 'model_loaded' THEN 0.36::DOUBLE WHEN 'page_started' THEN CASE WHEN i > 0 THEN round_even(0.36::DOUBLE + 0.48::DOUBLE * ((i - 1) / 16), 3) END
 WHEN 'page_done' THEN CASE WHEN i > 0 THEN round_even(0.36::DOUBLE + 0.48::DOUBLE * (i / 16), 3) END END AS progress,
 CASE event WHEN 'model_loading' THEN 'Loading OCR model for selected regions' WHEN 'model_loaded' THEN CASE WHEN p > 0 THEN 'OCR model loaded; processing ' || p || ' selected region(s)' ELSE 'OCR model loaded; processing selected regions' END
 WHEN 'page_started' THEN CASE WHEN i > 0 THEN {_LABEL} || ': ' || i || '/16' END WHEN 'page_done' THEN CASE WHEN i > 0 THEN {_LABEL} || ': ' || i || '/16 complete' || CASE WHEN c > 0 THEN '; ' || c || ' characters' ELSE '' END END END AS message FROM w"""
)
def ocr_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.ocr_progress(files.parsed_events(_worker_lines(spark, sf_dir).select("value"))).select("event", "phase", "index", "progress", "message")


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 0.7::DOUBLE WHEN 1 THEN round_even(least(0.7::DOUBLE + 0.18::DOUBLE * ((event_id % 16) / 8), 0.88::DOUBLE), 3) ELSE round_even(least(0.88::DOUBLE + 0.08::DOUBLE * ((event_id % 16) / 8), 0.96::DOUBLE), 3) END AS progress FROM events""")
def progress_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "events").selectExpr("event_id", "element_at(array('chunk_started', 'chunk_translated', 'table_progress'), CAST(event_id % 3 + 1 AS INT)) AS event", "event_id % 16 AS index", "8 AS total")
    return jobs.translation_progress(rows).select("event_id", "progress")


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 AND event_id % 3 <> 0 THEN 'OCR ' || (event_id % 9) || '/12' ELSE (event_id % 100) || '%' END AS label FROM events""")
def progress_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    stage = F.when(e % 2 == 0, "ocr_layout_parsing").otherwise("translation")
    message = F.when(e % 3 != 0, F.concat(F.lit("Region "), e % 9, F.lit(" / 12 done")))
    return S.table(spark, sf_dir, "events").select("event_id", jobs.progress_label(stage, message, e % 100).alias("label"))
