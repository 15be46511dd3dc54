"""The operators' queries against SQL and brute force over whole small tables, and the pipeline against brute force."""

from __future__ import annotations

import itertools

import duckdb
import numpy as np
import pytest
from compare import DATA, assert_same
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import decontam, lm, queries
from quire.llm.common import Scratch, remainder


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    assert_same(spark, queries.QUERIES[name], queries.SQL[name])


def table(name):
    return duckdb.sql(f"SELECT * FROM '{DATA}/{name}.parquet'").fetchdf()


def test_sharding_query(spark):
    got = queries.op9_sharding(spark, DATA).toPandas()
    docs = table("documents")
    assert sorted(got["doc_id"]) == sorted(docs["doc_id"])
    sizes = got["shard"].value_counts().reindex(range(16), fill_value=0)
    assert sizes.max() - sizes.min() <= 1
    merged = got.merge(docs, on="doc_id")
    assert (merged["size"] == merged["text"].map(lambda t: len(t.encode()) + 1)).all()


def test_quality_query(spark):
    got = queries.op5_quality_classifier(spark, DATA).toPandas()
    assert len(got) == len(table("documents")) and got["score"].between(0, 1).all()
    merged = got[got["held_out"]].merge(table("labels"), on="doc_id")
    assert len(merged) > 20 and (merged["predicted"] == merged["quality"]).mean() > 0.95


def test_mixing_query(spark):
    got = queries.op8_mixing_to_weights(spark, DATA).toPandas()
    assert len(got) == len(table("documents"))
    totals = {d: (got["rate"] * got["n_tokens"] * got[f"p_{d}"]).sum() for d in queries.MIX_WEIGHTS if f"p_{d}" in got}
    want = {d: queries.MIX_WEIGHTS[d] for d in totals}
    for d, t in totals.items():
        assert t / sum(totals.values()) == pytest.approx(want[d] / sum(want.values()), abs=1e-6)


def test_language_model_query(spark):
    got = queries.op3_lm_scoring(spark, DATA).toPandas()
    assert len(got) == len(table("documents")) and np.isfinite(got["score"]).all()
    assert got["score"].sum() > got["base_score"].sum()


def test_language_model_query_uses_trigrams(spark):
    got = queries.op3_lm_scoring(spark, DATA).toPandas().set_index("doc_id").sort_index()
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", (remainder("doc_id", 5) != 1).alias("learn"))
    bigrams = lm.score(docs, "learn", Scratch(spark, "t"), order=2).toPandas().set_index("doc_id").sort_index()
    held = got["held_out"].to_numpy(dtype=bool)
    assert got["score"][held].sum() > bigrams["score"][held].sum()


def test_extraction_query(spark):
    got = queries.op10_html_extraction(spark, DATA).toPandas().merge(table("pages"), on="page_id")
    assert (got["n_chars"] == got["text"].str.len()).all() and (got["n_chars"] > 0).all()
    assert not got["text"].str.contains("track\\(0\\)|</p>").any()


def words(text):
    return text.encode().lower().split() if text else []


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_pipeline_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append(docs.toPandas())
    for frame in kept[:-1]:
        assert tuple(frame.columns) == corpus_pipeline.COLUMNS
    first, second, third, fourth, last = kept
    labels = table("labels").set_index("doc_id")["quality"]
    known = first[first["doc_id"].isin(labels.index)]
    assert (labels.reindex(known["doc_id"]) == 1).mean() > 0.95
    # one document of each group
    sets = {int(i): shingles(t) for i, t in zip(first["doc_id"], first["text"], strict=True)}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b]):
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    assert sorted(second["doc_id"]) == sorted(i for i in sets if find(i) == i)
    # no leaks
    items = [set(itertools.pairwise(decontam.tokens(t))) for t in table("benchmark")["text"]]
    texts = dict(zip(second["doc_id"], second["text"], strict=True))
    gone = set(second["doc_id"]) - set(third["doc_id"])
    for i, t in texts.items():
        shared = max(len(x & set(itertools.pairwise(decontam.tokens(t)))) for x in items)
        assert (shared >= 8) if i in gone else (shared < 12)
    # the mixture takes rows as they are, sharding loses none
    assert set(fourth["doc_id"]) <= set(third["doc_id"])
    assert sorted(last["doc_id"]) == sorted(fourth["doc_id"])
    sizes = last["shard"].value_counts()
    assert sizes.max() - sizes.min() <= 1


def test_run_is_the_last_stage(spark):
    assert set(corpus_pipeline.run(spark, DATA).columns) == {*corpus_pipeline.COLUMNS, "shard", "slot"}


def test_pipeline_stages_with_odd_rows(spark):
    """Nulls in any column, empty and very long texts, repeated rows, columns with names that the stages use; then an empty table."""
    base = [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").where("lang = 'en' AND length(text) > 400").orderBy("doc_id").limit(6).collect()]
    rows = [(100_000 + i, t, "en", "s", 1) for i, t in enumerate(base)]
    rows += [(None, base[0], None, None, None), (None, None, None, None, None), (100_010, None, "en", None, None), (100_011, "", "en", "s", 0), (100_012, " \n\t", "en", "s", 0)]
    rows += [rows[0], rows[0], (100_000, base[1], "en", "s", 1), (100_020, " ".join(base) * 40, "en", "s", 1), (100_021, "x" * 300_000, "en", "s", 1)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").repartition(3)
    clash = {c: F.lit(c) for c in ("score", "_stats", "label", "sid", "chunk", "_text_id", "seed", "p0", "_p0", "rate", "copies", "n_tokens", "bucket", "_x", "_copy")}
    for name, stage in corpus_pipeline.STAGES:
        docs = plain.withColumns(clash)
        got = stage(spark, docs, DATA)
        assert [c for c in got.columns if c not in ("shard", "slot")] == docs.columns
        found = got.toPandas()
        assert all((found[c] == c).all() for c in clash), name
        texts = [t for t in found["text"] if t is not None]
        if name == "quality_classifier":
            assert set(base) <= set(texts)
        if name == "ngram_jaccard_join":  # one row of each key and text; a key goes if its text is a smaller key's too; rows without a key or words stay
            keys = found["doc_id"].dropna().astype(int).tolist()
            assert keys.count(100_000) == 2 and 100_001 not in keys and {100_010, 100_011, 100_012, 100_020, 100_021} <= set(keys) and found["doc_id"].isna().sum() == 2
        if name == "sharding":
            assert len(found) == len(rows) and sorted(found["slot"] * 16 + found["shard"]) == list(range(len(rows)))
        none = stage(spark, docs.where("false"), DATA)
        assert none.columns == got.columns and none.count() == 0, name
