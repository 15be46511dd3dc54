"""Sharding by a two-pass external shuffle."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quire.llm.common import Scratch, trim, unused

#: Buckets whose places are summed together: one row of sums each.
SPAN = 4096


def _content(rows: DataFrame) -> list[Column]:
    """All columns in a form that can be hashed."""
    return [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map" in f.dataType.simpleString() or "variant" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in rows.schema]


def shard(df: DataFrame, n_shards: int = 16, text: str = "text", seed: int = 17, bucket_bytes: int = 8 << 20, scratch: Scratch | None = None) -> DataFrame:
    """Every row of `df`, in random order, with its `shard` and its `slot` there.

    Pass one scatters the rows into buckets of about `bucket_bytes` by a seeded hash of their whole content; a row that
    occurs n times takes part as n copies numbered from 0, whose numbers are hashed too. So a key may hold any share of the rows, and rows
    that are alike spread over the buckets like others. Pass two brings each bucket into one worker's memory, puts it in a
    canonical order and Fisher-Yates shuffles it with a generator seeded by (seed, bucket). The buckets in
    sequence are the global order; its row g goes to shard g mod n, slot g div n. So shards hold counts at most
    one apart (law `rows`), slots are gapless from 0, and the result depends on the rows alone, not on their files, splits or order.

    Before pass one a table of row hashes (128 bits) and sizes is summed and written: the number of buckets, which rows repeat, and
    where each bucket begins follow from it. Beginnings are running sums over `SPAN` buckets, then over the spans; they are
    brought to the buckets by a cogroup. The driver gets the number of rows and bytes.

    Null keys and texts are kept and count as such; an empty table gives no
    rows. Input columns named `shard` or `slot` are replaced. A text longer than a bucket makes a bucket that large.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    scratch = scratch or Scratch(df.sparkSession, "shards")
    rows = df.drop("shard", "slot")
    schema = T.StructType([*rows.schema, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    x, y, n, copy, bucket = unused(rows, "_x", "_y", "_n", "_copy", "_bucket")
    content = _content(rows)
    named = rows.withColumns({x: F.xxhash64(F.lit(seed), *content), y: F.xxhash64(F.lit(~seed), *reversed(content))})
    sizes = named.select(x, y, (F.coalesce(F.octet_length(text), F.lit(0)) + 1).alias("size"))
    known = scratch.save(sizes.groupBy(x, y).agg(F.count("*").alias(n), F.min("size").alias("size")), "rows")
    total, size, most = known.agg(F.coalesce(F.sum(n), F.lit(0)), F.coalesce(F.sum(F.col(n) * F.col("size")), F.lit(0)), F.max(n)).first()
    n_buckets = max(1, math.ceil(size / bucket_bytes))
    at = F.pmod(F.xxhash64(F.lit(seed), x, y, copy), F.lit(n_buckets))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    if total and most > 1:
        again = scratch.save(known.where(F.col(n) > 1).select(x, y, n), "repeated")  # so that its size is known when the join is planned
        marked = named.join(again, [x, y], "left")
        single = marked.where(F.col(n).isNull()).withColumn(copy, F.lit(0).cast("long"))
        several = marked.where(F.col(n).isNotNull()).dropDuplicates([x, y]).withColumn(copy, every)
        dealt = single.unionByName(several).drop(n)
    else:
        dealt = named.withColumn(copy, F.lit(0).cast("long"))
    dealt = dealt.withColumn(bucket, at)
    counts = known.withColumn(copy, every).groupBy(at.alias("bucket")).agg(F.count("*").alias("rows")).withColumn("span", F.floor(F.col("bucket") / SPAN))
    spans = counts.groupBy("span").agg(F.sum("rows").alias("whole"))  # a row for 32 GB of input
    spans = spans.select("span", (F.sum("whole").over(Window.orderBy("span")) - F.col("whole")).alias("before"))
    inside = F.sum("rows").over(Window.partitionBy("span").orderBy("bucket")) - F.col("rows")
    starts = counts.withColumn("inside", inside).join(spans, "span").select("bucket", (F.col("before") + F.col("inside")).alias("start"))
    starts = scratch.save(starts, "starts")
    scratch.drop("rows")

    def shuffled(key: tuple, pdf: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        order = np.lexsort((pdf[copy].to_numpy(), pdf[y].to_numpy(), pdf[x].to_numpy()))
        np.random.default_rng([seed, int(key[0])]).shuffle(order)  # Fisher-Yates
        place = int(start["start"].iloc[0]) + np.arange(len(order), dtype=np.int64)
        trim()
        return pdf.iloc[order].drop(columns=[x, y, copy, bucket]).assign(shard=(place % n_shards).astype(np.int32), slot=place // n_shards)

    return dealt.groupBy(bucket).cogroup(starts.groupBy("bucket")).applyInPandas(shuffled, schema)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard; within its files the rows keep the order of their slots."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def digest(sharded: DataFrame) -> DataFrame:
    """The sharding's digest: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return sharded.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
