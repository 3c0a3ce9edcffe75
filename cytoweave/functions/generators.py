"""Table functions for SQL: many rows from one, with LATERAL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators.morph import label_pixels


@udtf(returnType="tile int, r0 int, c0 int, height int, width int")
class TilesOf:
    """Tiles of an image of h by w that overlap: of each side the size with the least padding by its length."""

    def eval(self, h: int, w: int, overlap: int = 48, largest: int = 256):
        if h is None or w is None:
            return
        rows, cols = ([(1, h)], [(1, w)]) if h <= largest and w <= largest else ([self._side(h, overlap, largest)], [self._side(w, overlap, largest)])
        (nh, th), (nw, tw) = rows[0], cols[0]
        for j in range(nh):
            for i in range(nw):
                yield j * nw + i, j * (th - overlap), i * (tw - overlap), th, tw

    def _side(self, n: int, overlap: int, largest: int) -> tuple[int, int]:
        best = None
        for size in range(overlap + 40, largest + 1, 8):
            count = max(1, -(-(n - overlap) // (size - overlap)))
            waste = (count * (size - overlap) + overlap - n) / count
            if best is None or (waste, size) < best[:2]:
                best = (waste, size, count)
        return best[2], best[1]


@udtf(returnType="cell int, r int, c int")
class MasksOf:
    """Pixels of the components (eight neighbours) above a threshold of an image given row by row."""

    def eval(self, values: list, width: int, threshold: float):
        if not values or not width:
            return
        image = np.array([np.nan if v is None else v for v in values], float)
        r, c = np.divmod(np.flatnonzero(image > threshold), width)
        for cell, y, x in zip(label_pixels(np.zeros(len(r), np.int64), r, c, True).tolist(), r.tolist(), c.tolist(), strict=True):
            yield cell, y, x


@udtf(returnType="draw int, r0 int, c0 int")
class ExamplesOf:
    """Corners of the crops of one size that fit side by side into an image; one at the corner if none fits."""

    def eval(self, h: int, w: int, crop_h: int, crop_w: int):
        if h is None or w is None:
            return
        down, across = max(1, h // crop_h), max(1, w // crop_w)
        for k in range(down * across):
            yield k + 1, k // across * crop_h, k % across * crop_w


def register(spark: SparkSession) -> None:
    """Table functions tiles_of, masks_of, examples_of; scalar functions iou, containment, area_volume."""
    for name, function in (("tiles_of", TilesOf), ("masks_of", MasksOf), ("examples_of", ExamplesOf)):
        spark.udtf.register(name, function)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION iou(n BIGINT, a BIGINT, b BIGINT) RETURNS DOUBLE RETURN n / (a + b - n)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION containment(n BIGINT, a BIGINT, b BIGINT) RETURNS DOUBLE RETURN greatest(n / a, n / b)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION area_volume(area DOUBLE) RETURNS DOUBLE RETURN 4 / 3 * pi() * power(sqrt(area / pi()), 3)")
