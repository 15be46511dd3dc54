"""Line dedup: a suffix array over line-ID sequences by distributed prefix doubling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import Scratch, unused, whole_numbers

WORD = r"[^\x20\x09-\x0D]+"


def _lines(text: Column) -> Column:
    """The lines that hold words, as (place, line): places count all lines from 0, white space around a line is ignored."""
    stripped = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x, i: F.struct(i.alias("place"), F.btrim(x, F.lit(" \t\x0b\x0c\r")).alias("line")))
    return F.filter(stripped, lambda s: s["line"] != "")


def _named(rows: DataFrame, scratch: Scratch, name: str, columns: list[str], rank: str) -> DataFrame:
    """`rows` with `rank`: a number for each distinct value of `columns` that sorts as they do."""
    ranks = rows.select(*columns).distinct().orderBy(*columns).withColumn(rank, F.monotonically_increasing_id())
    return rows.join(scratch.save(ranks, f"{name}-ranks"), columns)


def removals(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", min_words: int = 50) -> DataFrame:
    """(key, text_id, n_lines, removed) for every row of `docs`: the places of the lines to delete, in order.

    A line is deleted if it lies in a run of lines of `min_words` words or more that occurs before: in a text of a
    smaller key or further up in its own. Lines without words are no part of runs and stay. In detail:

    - A text equal to one of a smaller key goes whole if it has `min_words` words; otherwise no run of it can count. Only
      the first of equal texts takes further part, so copies make no work.
    - Lines that occur once end runs. Stretches of repeated lines with `min_words` words remain.
    - Their line IDs are ranked, then pairs of ranks 1, 2, 4, ... lines apart, each by one distributed sort of the
      distinct pairs: prefix doubling. As every line has a word, runs are told apart by at most `min_words` lines, so the
      suffix array is sorted to that depth and no further, however long texts are.
    - A window is the shortest run of `min_words` words that begins at a line, or the shortest that ends at one. Equal windows
      form an interval of the array, and all but the first of an interval are later copies. A run that occurs before is the
      union of its windows: the one that begins it holds its lines up to `min_words` words, each further line ends one.

    Ranks and intervals are sums and joins, nothing is gathered by line or interval; windows are within one text.
    Null keys come last; rows with equal keys and texts are one document; null and empty texts have no lines; further
    columns are ignored; an empty table gives no rows. Keys are whole numbers. Lines and texts are held by their MD5 digests.
    """
    whole_numbers(docs, key)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).alias("text_id"), _lines(F.col(text)).alias("lines"))
    rows = rows.withColumn("lines", F.transform("lines", lambda s: F.struct(s["place"].alias("place"), F.unhex(F.md5(s["line"].cast("binary"))).alias("id"), F.regexp_count(s["line"], F.lit(WORD)).alias("words"))))
    rows = rows.withColumn("words", F.aggregate("lines.words", F.lit(0).cast("long"), lambda a, x: a + x))
    rows = scratch.save(rows, "documents")
    order = F.coalesce(F.col("key"), F.lit((1 << 63) - 1))
    firsts = scratch.save(rows.groupBy("text_id").agg(F.min(order).alias("first")), "firsts")
    rows = rows.join(firsts, "text_id").withColumn("is_first", order == F.col("first"))
    long_enough = F.col("words") >= min_words
    one = rows.where(F.col("is_first") & long_enough).dropDuplicates(["text_id"])
    lines = one.select("text_id", "first", F.posexplode("lines").alias("pos", "l")).select("text_id", "first", "pos", F.col("l.id").alias("id"), F.col("l.words").alias("words"), F.col("l.place").alias("place"))
    lines = scratch.save(lines, "lines")
    often = scratch.save(lines.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "often")
    in_text = Window.partitionBy("text_id").orderBy("pos")
    stretch = Window.partitionBy("text_id", "stretch")
    held = lines.join(often, "id", "left_semi").withColumn("stretch", F.col("pos") - F.row_number().over(in_text))
    held = held.withColumn("total", F.sum("words").over(stretch)).where(F.col("total") >= min_words).drop("total")
    along = Window.partitionBy("text_id", "stretch").orderBy("pos")
    shortest = lambda words: F.aggregate(
        words,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("words")),
        lambda a, x: F.when(a["words"] >= min_words, a).otherwise(F.struct((a["n"] + 1).alias("n"), (a["words"] + x).alias("words"))),
    )
    held = held.withColumn("ahead", shortest(F.collect_list("words").over(along.rowsBetween(0, min_words - 1))))
    held = held.withColumn("behind", shortest(F.reverse(F.collect_list("words").over(along.rowsBetween(1 - min_words, 0)))))
    held = held.withColumn("width", F.when(F.col("ahead.words") >= min_words, F.col("ahead.n")))
    # one that is too short without its last line is the shortest of its first line already
    held = held.withColumn("width_back", F.when(F.col("behind.words") - F.col("words") >= min_words, F.col("behind.n"))).drop("ahead", "behind", "words")
    state = scratch.save(_named(held, scratch, "0", ["id"], "r0").drop("id"), "state-0")
    widest = state.agg(F.max(F.greatest("width", "width_back"))).first()[0]
    depth = 0
    while widest and (2 << depth) <= widest:
        pairs = state.withColumn("next", F.coalesce(F.lead(f"r{depth}", 1 << depth).over(along), F.lit(-1)))
        ranked = _named(pairs, scratch, str(depth + 1), [f"r{depth}", "next"], f"r{depth + 1}").drop("next")
        state = scratch.save(ranked, f"state-{depth + 1}")
        depth += 1
    level = F.floor(F.log2("width")).cast("int")
    at_level = lambda alias: F.coalesce(*(F.when(F.col("a.level") == k, F.col(f"{alias}.r{k}")) for k in range(depth + 1)))
    spans = F.array(
        F.when(F.col("width").isNotNull(), F.struct("pos", "width")),
        F.when(F.col("width_back").isNotNull(), F.struct((F.col("pos") - F.col("width_back") + 1).alias("pos"), F.col("width_back").alias("width"))),
    )
    starts = state.select("text_id", "first", F.inline(F.array_compact(spans))).withColumn("level", level)
    starts = starts.withColumn("back", (F.col("pos") + F.col("width") - F.pow(F.lit(2), F.col("level"))).cast("int"))
    windows = starts.alias("a").join(state.alias("h"), (F.col("a.text_id") == F.col("h.text_id")) & (F.col("a.pos") == F.col("h.pos")))
    windows = windows.select("a.*", at_level("h").alias("head"))
    windows = windows.alias("a").join(state.alias("b"), (F.col("a.text_id") == F.col("b.text_id")) & (F.col("a.back") == F.col("b.pos")))
    windows = windows.select("a.text_id", "a.first", "a.pos", "a.width", "a.head", at_level("b").alias("tail"))
    windows = scratch.save(windows, "windows")
    interval = ["width", "head", "tail"]
    leads = windows.groupBy(*interval).agg(F.min(F.struct("first", "text_id", "pos")).alias("lead"), F.count("*").alias("n")).where("n > 1").drop("n")
    leads = scratch.save(leads, "leads")
    copies = windows.join(leads, interval).where(F.struct("first", "text_id", "pos") > F.col("lead"))
    ends = copies.groupBy("text_id", "pos").agg(F.max(F.col("pos") + F.col("width")).alias("end"))
    covered = F.max("end").over(in_text.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    gone = state.join(ends, ["text_id", "pos"], "left").withColumn("end", covered).where("end > pos")
    gone = scratch.save(gone.groupBy("text_id").agg(F.array_sort(F.collect_list("place")).alias("gone")), "gone")
    everything = F.transform("lines", lambda s: s["place"])
    none = F.array().cast("array<int>")
    removed = F.when(~long_enough, none).when(~F.col("is_first"), everything).otherwise(F.coalesce("gone", none))
    done = rows.join(gone, "text_id", "left")
    return done.select(F.col("key").alias(key), "text_id", F.size("lines").alias("n_lines"), removed.alias("removed"))


def without_repeats(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", min_words: int = 50) -> DataFrame:
    """`docs` with the repeated lines taken out of its texts; all columns stay, a null text stays null."""
    at, name, gone = unused(docs, "_key", "_text_id", "_removed")
    cut = removals(docs, scratch, key, text, min_words).where(F.size("removed") > 0).dropDuplicates([key, "text_id"])
    cut = scratch.save(cut.select(F.col(key).alias(at), F.col("text_id").alias(name), F.col("removed").alias(gone)), "cut")
    named = docs.withColumn(name, F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))))
    joined = named.alias("d").join(cut.alias("c"), F.col(f"d.{key}").eqNullSafe(F.col(f"c.{at}")) & (F.col(f"d.{name}") == F.col(f"c.{name}")), "left")
    numbered = F.transform(F.split(F.col(f"d.{text}"), "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    kept = F.filter(numbered, lambda s: ~F.array_contains(F.col(f"c.{gone}"), s["i"]))
    clean = F.when(F.col(f"c.{gone}").isNull(), F.col(f"d.{text}")).otherwise(F.array_join(F.transform(kept, lambda s: s["x"]), "\n"))
    return joined.select(*(clean.alias(c) if c == text else F.col(f"d.{c}") for c in docs.columns))
