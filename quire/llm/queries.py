"""The training-data operators' queries over the standard tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import chat, decontam, html_text, jaccard, lines, lm, mixing, pq, quality, sharding
from quire.llm.common import Scratch, remainder, table


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq.near_groups(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), Scratch(spark, "op1"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.overlaps(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"), Scratch(spark, "op2"))
    return found.select("doc_id", "item_id", "n_same", "n_window")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (remainder("doc_id", 5) != 1).alias("learn"))
    scored = lm.score(docs, "learn", Scratch(spark, "op3"), order=3)
    return scored.select("doc_id", (remainder("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    odd = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    rows = rows.unionByName(odd)
    done = chat.conversations(chat.sequence_of_turns(rows), Scratch(spark, "op4"))
    done = done.withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("loss", chat.under_mask(F.col("formatted"), F.col("loss_spans")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", 3) != 1).select("doc_id", F.col("quality").alias("label"))
    scored, _ = quality.classify(docs, labels, Scratch(spark, "op5"))
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.similar_groups(docs, Scratch(spark, "op6"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = lines.removals(docs, Scratch(spark, "op7"))
    return found.select("doc_id", "n_lines", F.size("removed").alias("n_removed"), F.array_join("removed", ",").alias("removed"))


def op8_mixing_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = mixing.by_quality_and_toxicity(table(spark, sf_dir, "labels"))
    rated, model, _ = mixing.mix(docs, labels, MIX_WEIGHTS, Scratch(spark, "op8"))
    place = {d: F.col(f"p{k}") for k, d in enumerate(model.domains)}
    unknown = F.lit(0.0 if place else None).cast("double")
    named = [place.get(d, unknown).alias(f"p_{d}") for d in sorted(MIX_WEIGHTS)]
    return rated.select("doc_id", "n_tokens", *named, "rate", "copies")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.digest(sharding.shard(docs, n_shards=16))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return text.withColumn("n_chars", F.length("text").cast("long"))


#: Shares of the expected tokens by domain.
MIX_WEIGHTS = {"good": 0.9, "low": 0.07, "toxic": 0.03}

QUERIES = {
    f.__name__: f
    for f in (
        op1_embedding_near_dedup,
        op2_benchmark_decontamination,
        op3_lm_scoring,
        op4_chat_formatting,
        op5_quality_classifier,
        op6_ngram_jaccard_join,
        op7_line_dedup,
        op8_mixing_to_weights,
        op9_sharding,
        op10_html_extraction,
    )
}
_WORDS = """list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"""

SQL = {
    "op1_embedding_near_dedup": """
WITH RECURSIVE
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
good AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0
         AND list_dot_product(x, x) > 0),
links AS (SELECT a.vec_id AS p, b.vec_id AS q FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
n AS (SELECT p, count(*) AS n FROM links GROUP BY p),
reach AS (SELECT p AS origin, q AS node FROM links UNION SELECT origin, q FROM reach JOIN links ON node = p),
low AS (SELECT origin, min(node) AS least FROM reach GROUP BY origin)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(low.least, vec_id)) AS component_id,
       coalesce(vec_id = least(vec_id, coalesce(low.least, vec_id)), false) AS kept
FROM v LEFT JOIN n ON n.p = vec_id LEFT JOIN low ON low.origin = vec_id""",
    "op2_benchmark_decontamination": """
WITH
d AS (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) AS pos, len(t) AS n
      FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS t FROM documents)),
i AS (SELECT item_id, unnest(t) AS token, generate_subscripts(t, 1) AS pos, len(t) AS n
      FROM (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS t FROM benchmark)),
same AS (SELECT doc_id, item_id, d.pos - i.pos AS diagonal, i.pos AS pos, least(i.n, 13) AS w,
                least(i.n, d.n - (d.pos - i.pos)) - greatest(0, i.pos - d.pos) AS room
         FROM d JOIN i USING (token) WHERE i.n >= 5),
counted AS (SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY pos RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS c FROM same WHERE room >= w)
SELECT doc_id, item_id, CAST(max(c) AS INTEGER) AS n_same, CAST(max(w) AS INTEGER) AS n_window
FROM counted WHERE c >= CASE WHEN w = 13 THEN 11 ELSE w END GROUP BY doc_id, item_id""",
    "op4_chat_formatting": """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
e AS (SELECT *, length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '"', '&quot;')) + 24
             + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '"', '&quot;')) AS size FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
             coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss, sum(size) AS size FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(size AS BIGINT) AS formatted_chars FROM g""",
    "op6_ngram_jaccard_join": f"""
WITH RECURSIVE
w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
      ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_common FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM met JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * n_common >= 75 * (p.n + q.n - n_common)),
reach AS (SELECT x AS origin, y AS node FROM links UNION SELECT origin, y FROM reach JOIN links ON node = x),
low AS (SELECT origin, min(node) AS least FROM reach GROUP BY origin)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(low.least, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN low ON low.origin = d.doc_id""",
    # every pair of equal lines, a later with an earlier one; pairs that follow each other on both sides are a run that occurs before
    "op7_line_dedup": """
WITH
l AS (SELECT doc_id, i - 1 AS place, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line
      FROM (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents))),
n AS (SELECT doc_id, place, line, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS words, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS pos
      FROM l WHERE line <> ''),
same AS (SELECT a.doc_id AS doc, a.pos AS pos, b.doc_id AS other, a.pos - b.pos AS shift, a.words
         FROM n a JOIN n b ON a.line = b.line AND (b.doc_id < a.doc_id OR b.doc_id = a.doc_id AND b.pos < a.pos)),
runs AS (SELECT *, pos - row_number() OVER (PARTITION BY doc, other, shift ORDER BY pos) AS run FROM same),
long AS (SELECT doc, min(pos) AS first, max(pos) AS last FROM runs GROUP BY doc, other, shift, run HAVING sum(words) >= 50),
gone AS (SELECT DISTINCT doc_id, place FROM n JOIN (SELECT DISTINCT * FROM long) ON doc = doc_id AND pos BETWEEN first AND last),
g AS (SELECT doc_id, count(*) AS n_removed, string_agg(place, ',' ORDER BY place) AS removed FROM gone GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_lines FROM n GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(n_removed, 0) AS INTEGER) AS n_removed, coalesce(removed, '') AS removed
FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN g ON g.doc_id = d.doc_id""",
}
