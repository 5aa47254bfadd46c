"""Box geometry as column expressions over x0,y0 (top left), x1,y1 (top right), x2,y2 (bottom right)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = bx - ax, by - ay
    return F.sqrt(dx * dx + dy * dy)


def with_geometry(blocks: DataFrame, canvas_w: Column | None = None, canvas_h: Column | None = None) -> DataFrame:
    """Adds centre (cx, cy), size (w, h) and normalised centre (nx, ny).

    A block without a usable box sits at (0, 0); without a canvas the normalised centre is in pixels.
    """
    cx = F.coalesce((F.col("x0") + F.col("x2")) / 2, F.lit(0.0))
    cy = F.coalesce((F.col("y0") + F.col("y2")) / 2, F.lit(0.0))
    cw = F.lit(0) if canvas_w is None else canvas_w
    ch = F.lit(0) if canvas_h is None else canvas_h
    return blocks.select(
        "*", cx.alias("cx"), cy.alias("cy"),
        (F.col("x2") - F.col("x0")).alias("w"), (F.col("y2") - F.col("y0")).alias("h"),
        F.when(cw > 0, cx / cw).otherwise(cx).alias("nx"),
        F.when(ch > 0, cy / ch).otherwise(cy).alias("ny"))


def rescaled(ratio: Column, *values: str) -> list[Column]:
    """Coordinates with a down-scaling undone."""
    return [F.when(ratio != 1.0, F.col(v) / ratio).otherwise(F.col(v)).alias(v) for v in values]


def remapped(origin_x: Column, origin_y: Column, scale: Column) -> list[Column]:
    """Crop-local corners moved to the page; a scale of 0 or less counts as 1."""
    s = F.when(scale > 0, scale).otherwise(F.lit(1.0))
    return [(origin_x + F.col("x0") / s).alias("x0"), (origin_y + F.col("y0") / s).alias("y0"),
            (origin_x + F.col("x2") / s).alias("x2"), (origin_y + F.col("y2") / s).alias("y2")]


def in_region(min_x: Column | float, max_x: Column | float, min_y: Column | float, max_y: Column | float,
              canvas_w: Column | float = 1.0, canvas_h: Column | float = 1.0) -> Column:
    """Top-left corner inside the normalised region, edges included; no canvas means no match."""
    cw = F.lit(canvas_w) if isinstance(canvas_w, (int, float)) else canvas_w
    ch = F.lit(canvas_h) if isinstance(canvas_h, (int, float)) else canvas_h
    x = F.col("x0") / F.when(cw > 0, cw)
    y = F.col("y0") / F.when(ch > 0, ch)
    return x.between(min_x, max_x) & y.between(min_y, max_y)
