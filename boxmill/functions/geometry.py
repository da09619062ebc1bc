"""Box geometry as Column builders. Boxes are structs with x1, y1, x2, y2."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

CORNERS = ("x1", "y1", "x2", "y2")


def box(prefix: str = "", source: str | None = None) -> Column:
    """The struct of the corner columns prefix + x1 ..., optionally of an aliased DataFrame."""
    at = f"{source}." if source else ""
    return F.struct(*[F.col(f"{at}{prefix}{c}").alias(c) for c in CORNERS])


def _sides(b: Column, clamp: bool) -> tuple[Column, Column]:
    w, h = b["x2"] - b["x1"], b["y2"] - b["y1"]
    return (F.greatest(w, F.lit(0.0)), F.greatest(h, F.lit(0.0))) if clamp else (w, h)


def area(b: Column, clamp: bool = True) -> Column:
    w, h = _sides(b, clamp)
    return w * h


def intersection(a: Column, b: Column) -> Column:
    """The area that two boxes share."""
    w = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0.0))
    h = F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), F.lit(0.0))
    return w * h


def iou_of(shared: Column, area_a: Column, area_b: Column) -> Column:
    """Intersection over union from the areas; an empty union gives 0."""
    union = area_a + area_b - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def iou(a: Column, b: Column, *, clamp: bool = True, eps: float | None = None) -> Column:
    """Intersection over union.

    clamp: areas of inverted boxes count as 0, else they stay negative. eps: is
    added to the union, which then may be 0; without it an empty union gives 0.
    """
    shared = intersection(a, b)
    if eps is not None:
        return shared / (area(a, clamp) + area(b, clamp) - shared + eps)
    return iou_of(shared, area(a, clamp), area(b, clamp))


def overlaps(a: Column, b: Column) -> Column:
    """Whether two boxes can have an IoU over 0: the prefilter of IoU joins."""
    return (a["x1"] < b["x2"]) & (b["x1"] < a["x2"]) & (a["y1"] < b["y2"]) & (b["y1"] < a["y2"])


def centre_to_corners(cx: Column, cy: Column, w: Column, h: Column) -> dict[str, Column]:
    return {"x1": cx - w / 2, "y1": cy - h / 2, "x2": cx + w / 2, "y2": cy + h / 2}


def coco_box(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> dict[str, Column]:
    """Pixel x, y, w, h and area, rounded to 2 places. A box that begins left of the image keeps its width."""
    x = F.greatest((cx - w / 2) * width, F.lit(0.0))
    y = F.greatest((cy - h / 2) * height, F.lit(0.0))
    out = {"x": x, "y": y, "w": F.least(w * width, width - x), "h": F.least(h * height, height - y)}
    out = {k: F.round(v, 2) for k, v in out.items()}
    return out | {"area": F.round(out["w"] * out["h"], 2)}


def shifted(dx: Column, dy: Column) -> dict[str, Column]:
    """Tile to image coordinates: the tile's unrounded origin is added."""
    return {"x1": F.col("x1") + dx, "y1": F.col("y1") + dy, "x2": F.col("x2") + dx, "y2": F.col("y2") + dy}


def undo_augmentation(kind: Column, scale: Column, width: Column, height: Column) -> dict[str, Column]:
    """Corners in the original image of boxes found in a flipped, scaled or brightened one."""
    x1, y1, x2, y2 = (F.col(c) for c in CORNERS)
    across, down = kind.isin("flip_h", "flip_hv"), kind.isin("flip_v", "flip_hv")
    scaled = kind == "scale"
    return {
        "x1": F.when(across, width - x2).when(scaled, x1 / scale).otherwise(x1),
        "y1": F.when(down, height - y2).when(scaled, y1 / scale).otherwise(y1),
        "x2": F.when(across, width - x1).when(scaled, x2 / scale).otherwise(x2),
        "y2": F.when(down, height - y1).when(scaled, y2 / scale).otherwise(y2),
    }


def normalised(width: Column, height: Column, digits: int = 4) -> dict[str, Column]:
    """Corners in 0..1: pixels are divided by the image size unless all four are at most 1; clamped and rounded."""
    small = F.greatest(*[F.col(c) for c in CORNERS]) <= 1
    size = {"x1": width, "y1": height, "x2": width, "y2": height}
    return {c: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(small, F.col(c)).otherwise(F.col(c) / size[c]))), digits) for c in CORNERS}


def depth_scale(cy: Column, height: Column) -> Column:
    """Half size at the top of the image, full size at its bottom."""
    return F.lit(0.5) + F.lit(0.5) * cy / height


def scaled_size(w: Column, h: Column, cy: Column, height: Column, least: tuple[int, int] = (25, 20)) -> dict[str, Column]:
    s = depth_scale(cy, height)
    return {"w": F.greatest(F.lit(least[0]), (w * s).cast("int")), "h": F.greatest(F.lit(least[1]), (h * s).cast("int"))}


def resized(width: Column, height: Column, max_side: int = 1024, divisor: int = 16) -> dict[str, Column]:
    """Image size after shrinking to max_side, in multiples of divisor, halves to even."""
    scale = F.least(max_side / F.greatest(width, height), F.lit(1.0))

    def side(x: Column) -> Column:
        return F.greatest(F.lit(divisor), (F.bround(x * scale / divisor) * divisor).cast("int"))

    return {"w": side(width), "h": side(height), "scale": scale}


def _span(centre: Column, side: Column, size: Column, least: int) -> tuple[Column, Column]:
    """Start and end of `side` pixels about a centre, pushed into 0..size; at least `least` pixels where the image has them."""
    start = F.least(centre - F.floor(side / 2).cast("int"), size - side)
    start = F.when(start < 0, F.lit(0)).otherwise(start)
    return start, F.least(size, start + F.greatest(side, F.lit(least)))


def crop_region(width: Column, height: Column, cx: Column, cy: Column, w: Column, h: Column, *, factor: float = 2.5, smallest: int = 256, largest: int = 640, divisor: int = 16) -> dict[str, Column]:
    """A square crop around (cx, cy) of factor times the object, in whole divisors, moved inside the image where it fits."""
    wanted = F.greatest(F.lit(smallest), F.least(F.lit(largest), F.floor(F.greatest(w, h) * factor)))
    side = F.greatest(wanted - F.pmod(wanted, F.lit(divisor)), F.lit(divisor)).cast("int")
    (x0, x1), (y0, y1) = _span(cx, side, width, divisor), _span(cy, side, height, divisor)
    return {"x0": x0, "y0": y0, "x1": x1, "y1": y1}


def grid_shape(n: int) -> tuple[int, int]:
    """Rows and columns of n tiles; n is even and positive."""
    if n <= 0 or n % 2:
        raise ValueError("the number of tiles must be even and positive")
    rows = int(math.sqrt(n))
    return rows, math.ceil(n / rows)
