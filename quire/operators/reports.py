"""Translation reports and timing profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import strip

# The failures, in order of priority, and what to do about each.
FAILURES = {
    "empty": "translation returned empty output for one or more chunks",
    "short": "translation output is suspiciously short for one or more chunks",
    "table": "translated markdown contains malformed table markup",
    "collapsed": "translated markdown appears to have collapsed many paragraphs",
    "length": "translated markdown is much shorter than source markdown",
    "none": "no obvious source/translation mismatch detected",
}
FIXES = {
    "empty": "Reduce effective translation chunk size and inspect the listed chunk IDs.",
    "short": "Reduce effective translation chunk size and inspect the listed chunk IDs.",
    "table": "Use table-specific translation fallback or preserve table markup without translation.",
    "collapsed": "Split source text at paragraph boundaries before translation and preserve markdown line breaks.",
    "length": "Check chunk max_tokens and translated chunk recombination.",
    "none": "Inspect PDF rebuild expectations if the translated markdown structure looks healthy.",
}


def chunk_qa(chunks: DataFrame) -> DataFrame:
    """Chunks without output, with too little, and with some, for each document."""
    source, target = F.length("source_text"), F.length("translated_text")
    ids = lambda when: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("chunk_ord", "chunk_id")))), lambda x: x["chunk_id"]), ",")
    return chunks.groupBy("doc_id").agg(
        F.count("*").alias("n_chunks"),
        F.count_if(strip(F.col("translated_text")) != "").alias("n_translated"),
        ids((source > 0) & (target == 0)).alias("empty_ids"),
        ids((source >= 200) & (target < source * 0.25)).alias("short_ids"),
    )


def failure(empty: Column, short: Column, unclosed: Column, source_paragraphs: Column, paragraphs: Column, source_chars: Column, chars: Column) -> Column:
    """The key of the most likely failure."""
    collapsed = (source_paragraphs > 0) & (paragraphs < F.greatest(F.lit(1), F.floor(source_paragraphs / 4)))
    return (
        F.when(empty, "empty")
        .when(short, "short")
        .when(unclosed, "table")
        .when(collapsed, "collapsed")
        .when((source_chars > 0) & (chars < source_chars * 0.35), "length")
        .otherwise("none")
    )


def described(key: Column, texts: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in texts.items() for x in pair)), key)


def profile(timings: DataFrame) -> DataFrame:
    """(job_id, page, stage, seconds): sums by page and stage, and by stage (page null) over all events."""
    exact = timings.withColumn("seconds", F.col("seconds").cast("decimal(20,6)")).withColumn("whole", F.lit(True))
    pages = exact.where("page IS NOT NULL").groupBy("job_id", "page", "stage").agg(F.sum("seconds").alias("seconds"))
    stages = exact.groupBy("job_id", F.lit(None).cast("long").alias("page"), "stage").agg(F.sum("seconds").alias("seconds"))
    return pages.unionByName(stages).withColumn("seconds", F.col("seconds").cast("double"))


def profile_summary(timings: DataFrame) -> DataFrame:
    """Total by stage, and its mean over the pages that took time; the total has the events without a page too."""
    exact = timings.withColumn("seconds", F.col("seconds").cast("decimal(20,6)"))
    pages = exact.groupBy("job_id", "stage", "page").agg(F.sum("seconds").alias("s"))
    counted = F.count_if(F.col("page").isNotNull() & (F.col("s") > 0))
    total = F.sum("s").cast("double")
    return pages.groupBy("job_id", "stage").agg(total.alias("total"), counted.alias("n_pages")).withColumn("mean", F.when(F.col("n_pages") > 0, F.col("total") / F.col("n_pages")))
