"""Boxes as column arithmetic: page, normalised, pixel and canvas coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def clamp(x: Column, low: Column | float = 0.0, high: Column | float = 1.0) -> Column:
    """`x` held to [low, high]; the lower bound wins last, as where high is below low."""
    return F.least(F.greatest(x, F.lit(low) if not isinstance(low, Column) else low), F.lit(high) if not isinstance(high, Column) else high)


def unit(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def ordered(box: Box) -> Box:
    """Corners sorted into top left and bottom right."""
    x0, y0, x1, y1 = box
    return F.least(x0, x1), F.least(y0, y1), F.greatest(x0, x1), F.greatest(y0, y1)


def _at_least_one(x: Column | float) -> Column:
    return F.greatest((x if isinstance(x, Column) else F.lit(x)).cast("double"), F.lit(1.0))


def normalize(box: Box, space: Column, width: Column | float, height: Column | float) -> Box:
    """Page points to [0, 1]; a box that is normalised already is only clamped, not reordered."""
    w, h = _at_least_one(width), _at_least_one(height)
    scaled = ordered(tuple(unit(c / s) for c, s in zip(box, (w, h, w, h), strict=True)))
    done = space == "normalized"
    return tuple(F.when(done, unit(c)).otherwise(s) for c, s in zip(box, scaled, strict=True))


def denormalize(box: Box, space: Column, width: Column | float, height: Column | float) -> Box:
    """[0, 1] to page points; a box in points is left alone."""
    w, h = _at_least_one(width), _at_least_one(height)
    scaled = ordered(tuple(unit(c) * s for c, s in zip(box, (w, h, w, h), strict=True)))
    return tuple(F.when(space == "pdf", c).otherwise(s) for c, s in zip(box, scaled, strict=True))


def pixels(box: Box, width: Column | int, height: Column | int) -> Box:
    """[0, 1] to whole pixels, halves to even, one pixel at least in each direction where the image has room."""
    w, h = (x if isinstance(x, Column) else F.lit(x) for x in (width, height))
    x0, y0, x1, y1 = ordered(tuple(F.bround(unit(c) * s).cast("int") for c, s in zip(box, (w, h, w, h), strict=True)))
    left, top, right, bottom = F.greatest(F.lit(0), x0), F.greatest(F.lit(0), y0), F.least(w, x1), F.least(h, y1)
    return left, top, F.when(right <= left, F.least(w, left + 1)).otherwise(right), F.when(bottom <= top, F.least(h, top + 1)).otherwise(bottom)


def pad(box: Box, share: float) -> Box:
    """A box grown by a share of its size on each side, within the page."""
    x0, y0, x1, y1 = ordered(tuple(unit(c) for c in box))
    dx, dy = (x1 - x0) * max(0.0, share), (y1 - y0) * max(0.0, share)
    return unit(x0 - dx), unit(y0 - dy), unit(x1 + dx), unit(y1 + dy)


def from_pixels(box: Box, width: Column | float, height: Column | float) -> Box:
    w, h = _at_least_one(width), _at_least_one(height)
    return ordered(tuple(unit(c / s) for c, s in zip(box, (w, h, w, h), strict=True)))


def rescale(box: Box, from_size: tuple[Column | float, Column | float], to_size: tuple[Column | float, Column | float]) -> Box:
    """Canvas to image coordinates or back."""
    sx, sy = ((t if isinstance(t, Column) else F.lit(float(t))) / _at_least_one(f) for f, t in zip(from_size, to_size, strict=True))
    x0, y0, x1, y1 = box
    return x0 * sx, y0 * sy, x1 * sx, y1 * sy


def snap(box: Box, step: float = 0.001) -> Box:
    """Corners moved to multiples of `step`, halves to even, clamped and sorted."""
    return ordered(tuple(unit(F.bround(c / step) * step) for c in box))


def percent(box: Box) -> tuple[Column, Column, Column, Column]:
    """x, y, width and height in hundredths of the page."""
    x0, y0, x1, y1 = box
    return x0 * 100, y0 * 100, (x1 - x0) * 100, (y1 - y0) * 100


#: Fixed values of hand-drawn boxes.
MIN_SIDE, COPY_OFFSET, MIN_WIDTH, MAX_WIDTH, MIN_HEIGHT, MAX_HEIGHT = 0.005, 0.035, 0.08, 0.8, 0.05, 0.6
MIN_DRAWN_PIXELS, MIN_DRAWN_SHARE = 20, 0.015


def manual_copy(box: Box) -> Box:
    """A copy of a box, moved a little down and right and kept on the page."""
    x0, y0, x1, y1 = box
    w, h = clamp(x1 - x0, MIN_WIDTH, MAX_WIDTH), clamp(y1 - y0, MIN_HEIGHT, MAX_HEIGHT)
    left, top = clamp(x0 + COPY_OFFSET, 0.0, 1 - w), clamp(y0 + COPY_OFFSET, 0.0, 1 - h)
    return left, top, clamp(left + w, left + MIN_SIDE, 1.0), clamp(top + h, top + MIN_SIDE, 1.0)


def drawn(a: tuple[Column, Column], b: tuple[Column, Column], width: Column | float, height: Column | float) -> Box:
    """The box between two points of a canvas, as shares of it, `MIN_SIDE` wide and high at least."""
    out = []
    for p, q, side in zip(a, b, (width, height), strict=True):
        low = clamp(F.least(p, q) / side, 0.0, 1 - MIN_SIDE)
        out.append((low, clamp(F.greatest(p, q) / side, low + MIN_SIDE, 1.0)))
    (x0, x1), (y0, y1) = out
    return x0, y0, x1, y1


def edited(box: Box, field: Column, value: Column) -> Box:
    """A box of which one number was typed in percent: x or y move it, w or h resize it; a value that is none changes nothing."""
    x0, y0, x1, y1 = box
    typed = F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")), value)

    def along(low: Column, high: Column, move: str, size: str) -> tuple[Column, Column]:
        start, length = unit(low), clamp(high - low, MIN_SIDE, 1.0)
        moved = clamp(clamp(typed / 100), 0.0, 1 - length)
        resized = clamp(start + clamp(typed / 100, MIN_SIDE, 1.0), start + MIN_SIDE, 1.0)
        moves, resizes = (field == move) & typed.isNotNull(), (field == size) & typed.isNotNull()
        return F.when(moves, moved).otherwise(low), F.when(moves, clamp(moved + length, moved + MIN_SIDE, 1.0)).when(resizes, resized).otherwise(high)

    (a, c), (b, d) = along(x0, x1, "x", "w"), along(y0, y1, "y", "h")
    return a, b, c, d


def drawn_large_enough(width: Column, height: Column, canvas_width: Column, canvas_height: Column) -> Column:
    return (width >= F.greatest(F.lit(float(MIN_DRAWN_PIXELS)), canvas_width * MIN_DRAWN_SHARE)) & (
        height >= F.greatest(F.lit(float(MIN_DRAWN_PIXELS)), canvas_height * MIN_DRAWN_SHARE)
    )
