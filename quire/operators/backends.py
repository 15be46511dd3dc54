"""Models as protocols, run once a Python worker over batches of rows, with stand-ins that need no model."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T

# Common words that stand for a language.
STOP_WORDS = {
    "de": ("der", "die", "und", "das", "ist", "nicht", "ein", "eine", "mit", "den"),
    "en": ("the", "and", "of", "to", "in", "is", "that", "for", "with", "was"),
    "es": ("el", "la", "de", "que", "y", "en", "los", "para", "con", "una"),
    "fr": ("le", "la", "les", "et", "des", "une", "est", "pour", "dans", "qui"),
}


class OcrBackend(Protocol):
    """Images in, markdown out."""

    def __call__(self, images: list[bytes], names: list[str]) -> list[str]: ...


class LayoutDetector(Protocol):
    """An image in, boxes (x0, y0, x1, y1, type) out."""

    def __call__(self, image: bytes) -> list[tuple[float, float, float, float, str]]: ...


class FixtureOcr:
    """Knows the texts of named images; a stand-in for a model."""

    def __init__(self, texts: dict[str, str]):
        self.texts = texts

    def __call__(self, images: list[bytes], names: list[str]) -> list[str]:
        return [self.texts.get(n, "") for n in names]


# Table marks that may repeat, and two ids that always may.
CELL_MARKS, FREE_IDS = ("<td>", "</td>"), (128821, 128822)


def free_tokens(encode: Callable[[str], list[int]]) -> set[int]:
    """Ids that a repeat guard never bans: those of cell marks that are one token, and the fixed ones."""
    found = set(FREE_IDS)
    for mark in CELL_MARKS:
        try:
            ids = encode(mark)
        except Exception:  # a tokenizer may not know the mark
            continue
        if len(ids) == 1:
            found.add(int(ids[0]))
    return found


class RepeatGuard:
    """Takes tokens that would repeat an n-gram of the trailing window out of a model's scores; `T.banned_tokens` is the same as a column."""

    def __init__(self, n: int, window: int, free: set[int] | None = None):
        self.n, self.window, self.free = n, window, free or set()

    def banned(self, ids: list[int]) -> set[int]:
        tail = list(ids)[-self.window :] if self.window else []
        head = tuple(tail[len(tail) - self.n + 1 :])
        grams = zip(*(tail[k:] for k in range(self.n)), strict=False)
        return {g[-1] for g in grams if g[:-1] == head} - self.free if len(tail) >= self.n else set()

    def __call__(self, ids: list[int], scores: np.ndarray) -> np.ndarray:
        out = np.array(scores, dtype=float)
        out[..., [k for k in self.banned(ids) if 0 <= k < out.shape[-1]]] = -np.inf
        return out


def recognized(images: DataFrame, backend: Callable[[], OcrBackend]) -> DataFrame:
    """`images` (name, image, ...) with `ocr_text` in place of the image; `backend` makes the model once a worker."""
    rest = [f for f in images.schema if f.name != "image"]
    names = [f.name for f in rest]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "ocr_text string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for pdf in batches:
            model = model or backend()
            yield pdf[names].assign(ocr_text=model([bytes(x) for x in pdf["image"]], pdf["name"].tolist()))

    return images.mapInPandas(run, schema)


def with_retries(first: DataFrame, again: DataFrame) -> DataFrame:
    """Texts of which a blank one is replaced by its second reading (name, ocr_text), if that is not blank."""
    read = again.select("name", F.col("ocr_text").alias("again")).where(T.strip(F.col("again")) != "")
    blank = T.strip(F.col("ocr_text")) == ""
    return first.join(read, "name", "left").withColumn("ocr_text", F.when(blank, F.coalesce("again", "ocr_text")).otherwise(F.col("ocr_text"))).drop("again")


def recognized_twice(images: DataFrame, retries: DataFrame, backend: Callable[[], OcrBackend]) -> DataFrame:
    """Texts of the images; a blank one is replaced by its retry image's, if that has one."""
    return with_retries(recognized(images, backend), recognized(retries, backend))


def detected_language(text: Column) -> Column:
    """The language with most of its stop words in a text, null if none has two; ties go to the first in the alphabet."""
    found = F.split(F.lower(T.for_detection(text)), r"[^\p{L}]+")
    hits = [F.struct(_hits(found, known).alias("n"), F.lit(code).alias("code")) for code, known in STOP_WORDS.items()]
    best = F.array_sort(F.array(*hits), lambda a, b: F.when(a["n"] != b["n"], b["n"] - a["n"]).when(a["code"] < b["code"], -1).otherwise(1))
    top = F.get(best, F.lit(0))
    return F.when(top["n"] >= 2, top["code"])


def _hits(found: Column, known: tuple[str, ...]) -> Column:
    return F.size(F.filter(found, lambda w: w.isin(*known)))
