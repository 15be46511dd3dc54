"""Page images as arrays: clean-up, crops, masks and how much of them is not white.

An image is a row (name, width, height, pixels): one byte a pixel, grey, row by row. Decoding files into rows is the
caller's (`Rasteriser`), as no image library is needed here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# The threshold between black and white, white, and the retry's contrast.
BLACK_BELOW, WHITE_FROM, RETRY_CONTRAST, POINTS_PER_INCH = 140, 250, 1.8, 72


class Rasteriser(Protocol):
    """A file's page as grey pixels: (bytes, page number, pixels a point) to a two-dimensional array."""

    def __call__(self, content: bytes, page_number: int, scale: float) -> np.ndarray: ...


def contrasted(image: np.ndarray, factor: float) -> np.ndarray:
    """Pixels moved away from (or towards) the mean grey."""
    mean = int(image.mean() + 0.5)
    return np.clip(mean + (image.astype(np.float64) - mean) * factor, 0, 255).astype(np.uint8)


def denoised(image: np.ndarray) -> np.ndarray:
    """The median of each pixel and its eight neighbours; edges are repeated outwards."""
    padded = np.pad(image, 1, mode="edge")
    h, w = image.shape
    return np.median(np.stack([padded[i : i + h, j : j + w] for i in range(3) for j in range(3)]), axis=0).astype(np.uint8)


def binarized(image: np.ndarray) -> np.ndarray:
    return np.where(image < BLACK_BELOW, 0, 255).astype(np.uint8)


def cleaned(image: np.ndarray, contrast: float = 1.0, denoise: bool = False, binarize: bool = False) -> np.ndarray:
    if contrast != 1.0:
        image = contrasted(image, contrast)
    if denoise:
        image = denoised(image)
    return binarized(image) if binarize else image


def nonwhite_ratio(image: np.ndarray) -> float:
    return float((image < WHITE_FROM).sum() / max(image.size, 1))


def masked(image: np.ndarray, left: int, top: int, right: int, bottom: int) -> np.ndarray:
    """A white page with the box's pixels in their place."""
    out = np.full_like(image, 255)
    out[top:bottom, left:right] = image[top:bottom, left:right]
    return out


def retry_crop(image: np.ndarray, left: int, top: int, right: int, bottom: int) -> np.ndarray:
    return contrasted(image[top:bottom, left:right], RETRY_CONTRAST)


def rendered(pages: DataFrame, rasteriser: Callable[[], Rasteriser], dpi: int = 100, **clean) -> DataFrame:
    """(name, width, height, pixels) of pages (name, content, page_number); the rasteriser is made once a worker."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        draw = None
        for pdf in batches:
            draw = draw or rasteriser()
            images = [cleaned(draw(bytes(c), int(n), dpi / POINTS_PER_INCH), **clean) for c, n in zip(pdf["content"], pdf["page_number"], strict=True)]
            yield _rows(pdf["name"], images)

    return pages.select("name", "content", "page_number").mapInPandas(run, IMAGE)


IMAGE = "name string, width int, height int, pixels binary"


def _rows(names: pd.Series, images: list[np.ndarray]) -> pd.DataFrame:
    return pd.DataFrame({"name": names.to_numpy(), "width": [i.shape[1] for i in images], "height": [i.shape[0] for i in images], "pixels": [i.tobytes() for i in images]})


def _arrays(pdf: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(p, dtype=np.uint8).reshape(h, w) for p, h, w in zip(pdf["pixels"], pdf["height"], pdf["width"], strict=True)]


def cut(images: DataFrame, how: Callable[[np.ndarray, int, int, int, int], np.ndarray]) -> DataFrame:
    """Images (name, width, height, pixels, left, top, right, bottom) by `masked` or `retry_crop`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            boxes = pdf[["left", "top", "right", "bottom"]].itertuples(index=False)
            yield _rows(pdf["name"], [how(a, *map(int, b)) for a, b in zip(_arrays(pdf), boxes, strict=True)])

    return images.mapInPandas(run, IMAGE)


def inked(images: DataFrame) -> DataFrame:
    """(name, nonwhite) of images."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"name": pdf["name"], "nonwhite": [nonwhite_ratio(a) for a in _arrays(pdf)]})

    return images.mapInPandas(run, "name string, nonwhite double")
