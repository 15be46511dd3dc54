"""Benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import BitFilter, Digests, Scratch, mix, signed, trim, unused

#: A leak is a window of WINDOW tokens that differ from an item's in at most SUBSTITUTIONS places.
WINDOW, SUBSTITUTIONS, LEAST = 13, 2, 5
#: Whichever two places of a window of 13 differ, one of these masks fits in it at some offset without
#: looking at either (all 78 pairs are tested); 0 marks a token that is ignored.
MASKS = ("11101011", "110100111")
_STEP = np.uint64(0x9E3779B97F4A7C15)
_TOKEN = re.compile(r"\w+")
_SPLIT_TOKENS = 1 << 18
#: Test hashes with the tokens around them are broadcast if they take so many bytes at most; a larger table is shuffled.
BROADCAST_BYTES, ROW_BYTES = 32 << 20, 96
AHEAD = WINDOW - min(map(len, MASKS))


def tokens(text: str | None) -> list[bytes]:
    """Words and numbers in lower case, without punctuation."""
    return [t.encode("utf-8", "surrogatepass") for t in _TOKEN.findall(text.lower())] if text else []


def seeds(hashes: np.ndarray, mask: str) -> np.ndarray:
    """A hash for every place where the mask fits, of the tokens under its ones."""
    n = len(hashes) - len(mask) + 1
    acc = np.full(max(n, 0), int(mask, 2), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k, bit in enumerate(mask):
            if bit == "1":
                acc = acc * _STEP + hashes[k : k + n]
    return mix(acc)


def _aligned(doc: np.ndarray, item: np.ndarray, shift: int, window: int, allowed: int) -> tuple[int, int, int] | None:
    """(first token, one past the last, most equal tokens in a window) of the leak on the diagonal doc[i + shift] = item[i]."""
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    if hi - lo < window:
        return None
    same = np.concatenate([[0], np.cumsum(doc[lo + shift : hi + shift] == item[lo:hi])])
    sums = same[window:] - same[:-window]
    good = np.flatnonzero(sums >= window - allowed)
    return (lo + shift + int(good[0]), lo + shift + int(good[-1]) + window, int(sums[good].max())) if len(good) else None


def overlaps(docs: DataFrame, tests: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", test_key: str = "item_id", test_text: str = "text") -> DataFrame:
    """(doc key, item key, n_same, n_window, first, last): a row for every document and item that overlap.

    Items of at least 13 tokens leak where 13 consecutive tokens of a document and the item differ in at
    most 2 places; items of 5 to 12 tokens where they occur whole; shorter ones never. `n_same` is the most
    equal tokens in a window, `first` and `last` bound the token places found in the document.

    Masks hash the tests into a table (hash, item, the tokens around the place: what a window that holds the mask can reach). One pass over the documents hashes every place;
    a fixed-size bit table of the test hashes drops nearly all places where nothing can match, and the rest are
    joined with the tests by hash. Each hit carries the tokens around it, so it is verified where it is, without reading the document
    again. Hits are not gathered by item or document before the final sum, which is partial on both sides.

    Null and empty texts overlap with nothing; a null key is a key like others; rows that share a key are one
    document (or item); empty tables give no rows.
    """
    spark = docs.sparkSession

    def test_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digests = Digests()
        for pdf in batches:
            for item, t in zip(pdf["item"], pdf["text"], strict=True):
                h = digests.of(tokens(t))
                if len(h) < LEAST:
                    continue
                for mask in ("1" * len(h),) if len(h) < WINDOW else MASKS:
                    found, out = signed(seeds(h, mask)), []
                    for at, s in enumerate(found):
                        begin = max(0, at - AHEAD)
                        out.append((int(s), len(mask), int(mask, 2), at - begin, len(h) < WINDOW, item, h[begin : at + WINDOW].tobytes()))
                    yield pd.DataFrame(out, columns=["seed", "span", "mask", "place", "short", "item", "tokens"])

    rows = tests.select(F.col(test_key).alias("item"), F.col(test_text).alias("text"))
    kind = rows.schema["item"].dataType.simpleString()
    hashed = scratch.save(rows.mapInPandas(test_rows, f"seed long, span int, mask int, place int, short boolean, item {kind}, tokens binary"), "tests")
    n_tests, test_bytes = hashed.agg(F.count("*"), F.sum(F.length("tokens") + F.coalesce(F.octet_length(F.col("item").cast("string")), F.lit(0)) + ROW_BYTES)).first()
    masks = sorted((r["mask"], r["span"]) for r in hashed.select("mask", "span").distinct().collect())  # 2 and a length of short items each: 10 at most
    bits = BitFilter(hashed, "seed", bits=1 << 26, hashed=True)

    def doc_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digests, pending, keys, size = Digests(), [], [], 0

        def flush() -> pd.DataFrame:
            lengths = np.array([len(h) for h in pending])
            owner, flat = np.repeat(np.arange(len(pending)), lengths), np.concatenate(pending)
            begin = np.cumsum(lengths) - lengths
            out = []
            for mask, span in masks:
                found = seeds(flat, format(mask, "b").zfill(span))
                if not len(found):
                    continue
                at = np.flatnonzero((owner[: len(found)] == owner[span - 1 :]) & bits.maybe(signed(found)))
                for place, seed in zip(at, signed(found[at]), strict=True):
                    d = owner[place]
                    a, b = max(begin[d], place - AHEAD), min(begin[d] + lengths[d], place + max(WINDOW, span))
                    out.append((keys[d], int(seed), int(place - a), int(a - begin[d]), flat[a:b].tobytes()))
            return pd.DataFrame(out, columns=["doc", "seed", "inside", "offset", "around"])

        for pdf in batches:
            for k, t in zip(pdf["doc"], pdf["text"], strict=True):
                h = digests.of(tokens(t))
                if len(h) >= LEAST:
                    pending.append(h)
                    keys.append(k)
                    size += len(h)
                if size >= _SPLIT_TOKENS:
                    yield flush()
                    pending, keys, size = [], [], 0
                    trim()
        if pending:
            yield flush()

    texts = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    doc_kind = texts.schema["doc"].dataType.simpleString()
    hits = texts.mapInPandas(doc_rows, f"doc {doc_kind}, seed long, inside int, offset int, around binary") if n_tests else spark.createDataFrame([], f"doc {doc_kind}, seed long, inside int, offset int, around binary")
    hits = scratch.save(hits, "hits")  # so that finding and verifying have one Python worker a task each, not two
    side = hashed.select("seed", "place", "short", "item", "tokens")
    joined = hits.join(F.broadcast(side) if (test_bytes or 0) <= BROADCAST_BYTES else side, "seed")

    @F.pandas_udf("n_same int, n_window int, first int, last int")
    def verify(around: pd.Series, inside: pd.Series, offset: pd.Series, place: pd.Series, short: pd.Series, item: pd.Series) -> pd.DataFrame:
        out = []
        for a, i, o, p, small, t in zip(around, inside, offset, place, short, item, strict=True):
            t = np.frombuffer(t, dtype=np.uint64)
            window = len(t) if small else WINDOW
            found = _aligned(np.frombuffer(a, dtype=np.uint64), t, i - p, window, 0 if small else SUBSTITUTIONS)
            out.append((found[2], window, found[0] + o, found[1] + o) if found else (None, None, None, None))
        return pd.DataFrame(out, columns=["n_same", "n_window", "first", "last"]).astype("Int32")

    checked = joined.select("doc", "item", verify("around", "inside", "offset", "place", "short", "tokens").alias("v")).where("v.n_same IS NOT NULL")
    grouped = checked.groupBy("doc", "item").agg(
        F.max("v.n_same").alias("n_same"), F.max("v.n_window").alias("n_window"), F.min("v.first").alias("first"), F.max("v.last").alias("last")
    )
    return grouped.select(F.col("doc").alias(key), F.col("item").alias(test_key if test_key != key else f"test_{test_key}"), "n_same", "n_window", "first", "last")


def without_leaks(docs: DataFrame, tests: DataFrame, scratch: Scratch, text: str = "text", test_key: str = "item_id") -> DataFrame:
    """The rows of `docs` whose texts overlap with no item; equal texts share their fate, keys don't matter. All columns stay."""
    (name,) = unused(docs, "_text_id")
    named = docs.withColumn(name, F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    leaked = scratch.save(overlaps(named, tests, scratch, key=name, text=text, test_key=test_key).select(name).distinct(), "leaked")
    scratch.keep("leaked")
    return named.join(leaked, name, "left_anti").drop(name)
