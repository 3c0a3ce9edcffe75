"""Ray casting, refinement of touching objects, and threshold masks."""

import math

import numpy as np
from pyspark.sql import functions as F

from cytoweave.operators import morph, outlines, segment

SHAPE = "frame_id long, grp int, cell int, centre_r double, centre_c double, radii array<double>, angles array<double>"


def disc(y, x, q, size=60):
    return [(r, c) for r in range(size) for c in range(size) if (r - y) ** 2 + (c - x) ** 2 <= q * q]


def test_curves_pass_their_knots_and_equal_the_basis():
    rng = np.random.default_rng(2)
    angles = np.sort(rng.uniform(-3, 3, (5, 6)), axis=1)
    radii = rng.uniform(5, 10, (5, 6))
    curve = outlines.curves(radii, angles)
    which = np.repeat(np.arange(5), 6)
    assert np.allclose(outlines.on_curve(curve, which, angles.ravel()), radii.ravel())
    phi = rng.uniform(-7, 7, 40)
    for k in range(5):
        assert np.allclose(outlines.on_curve(curve, np.full(40, k), phi), outlines.spline_basis(angles[k], phi) @ radii[k])


def test_fits_find_radii_and_angles_within_their_bounds():
    rng = np.random.default_rng(3)
    n, objects = 8, 30
    angles = np.tile(np.arange(n) * 2 * math.pi / n, (objects, 1))
    first = rng.uniform(8, 12, (objects, n))
    move = rng.uniform(-0.8, 0.8, (objects, 2 * n))
    true_r, true_a = first * (1 + 0.3 * move[:, :n]), angles + move[:, n:] * math.pi / (2 * n)
    which = np.repeat(np.arange(objects), 120)
    phi = rng.uniform(0, 2 * math.pi, len(which))
    rho = outlines.on_curve(outlines.curves(true_r, true_a), which, phi)
    radii, moved = outlines.fit_outlines(first, angles, which, rho, phi, np.ones(len(phi)))
    off = np.abs(outlines.on_curve(outlines.curves(radii, moved), which, phi) - rho)
    assert np.median(off) < 0.01 and np.bincount(which, off).max() / 120 < 0.3
    far, _ = outlines.fit_outlines(first, angles, which, 3 * rho, phi, np.ones(len(phi)))
    assert np.abs(far / first - 1).max() <= 0.3 + 1e-9 and (np.abs(far / first - 1).mean(axis=1) > 0.2).all()


def test_touching_objects_of_neighbouring_groups_are_told_apart(spark):
    """Two discs that touch, of two groups; both groups' edge maps show both of them."""
    n, circles = 8, [(20.0, 20.0, 10.0), (20.0, 38.0, 8.0)]
    ring = {(r, c) for y, x, q in circles for r in range(60) for c in range(60) if abs(math.hypot(r - y, c - x) - q) < 0.8}
    px = spark.createDataFrame([(f, g, r, c, 0.9) for f in range(3) for g in (0, 1) for r, c in ring], "frame_id long, grp int, r int, c int, p double")
    angles = [2 * math.pi * k / n for k in range(n)]
    rng = np.random.default_rng(4)
    rows = [(f, g, 1, y, x, [q * float(rng.uniform(0.9, 1.1)) for _ in range(n)], angles) for f in range(3) for g, (y, x, q) in enumerate(circles)]
    rows += [(9, 0, 1, 20.0, 20.0, [10.0] * n, angles), (0, 5, 1, 50.0, 50.0, [3.0] * n, angles)]
    shapes = spark.createDataFrame(rows, SHAPE)
    got = outlines.refine(px, shapes)
    assert got.columns == shapes.columns
    found = {(x.frame_id, x.grp): x for x in got.collect()}
    assert len(found) == len(rows) and found[9, 0].radii == [10.0] * n and found[0, 5].radii == [3.0] * n  # no pixels: as they were
    for (f, g), x in found.items():
        if f < 3 and g < 2:
            phi = np.linspace(0, 2 * math.pi, 60)
            drawn = outlines.on_curve(outlines.curves(np.array([x.radii]), np.array([x.angles])), np.zeros(60, int), phi)
            off = np.abs(drawn - circles[g][2])
            assert off.max() < 1.3 and off.mean() < 0.35, (f, g)


def test_rays_over_a_circle_and_a_cut_off_one(spark):
    m = spark.createDataFrame([(0, 1, r, c) for r, c in disc(30, 30, 12)] + [(0, 2, r, c) for r, c in disc(0, 30, 12)], "frame_id long, cell int, r int, c int")
    found = {}
    for x in outlines.cast_rays(morph.edges(m, 60, 60), outlines.ray_objects(m), 60, 60).collect():
        found.setdefault(x.cell, []).append(x.radius)
    assert len(found[1]) == 8 and all(abs(r - 11.3) < 0.6 for r in found[1])
    assert len(found[2]) == 8 and all(r > 3 for r in found[2])  # rays out of the frame are interpolated
    lone = spark.createDataFrame([(0, 1, 5, 5)], "frame_id long, cell int, r int, c int")
    assert {x.radius for x in outlines.cast_rays(lone.filter("false"), outlines.ray_objects(lone), 60, 60).collect()} == {0.1}


def test_threshold_masks_share_the_overlap(spark):
    left, right = [(r, c) for r in range(4, 12) for c in range(2, 9)], [(r, c) for r in range(4, 12) for c in range(13, 20)]
    lens = [(r, c) for r in range(4, 12) for c in range(9, 13)]
    maps = lambda px: spark.createDataFrame([(0, r, c, 0.95) for r, c in px], "frame_id long, r int, c int, v double")
    interior, overlap = maps(left + right), maps(lens)
    masks = {}
    for x in segment.threshold_masks(interior, 24, 24, overlap=overlap, dilate=False).collect():
        masks.setdefault(x.cell, set()).add((x.r, x.c))
    assert masks[1] >= set(left) | set(lens) and masks[2] >= set(right) | set(lens) and not masks[1] & set(right)
    alone = segment.threshold_masks(interior, 24, 24, dilate=False)
    assert {(x.r, x.c) for x in alone.collect()} == set(left + right)
    # a bud takes the place of the object that it fills
    bud = maps(right)
    for radial in (False, True):
        drawn = segment.threshold_segmentation(interior, 24, 24, bud=bud, radial=radial)
        assert drawn.select("cell").distinct().count() == 2
    damped = segment.threshold_segmentation(interior, 24, 24, bud=bud.withColumn("v", F.lit(0.5)), is_bud=None)
    assert {x.cell for x in damped.collect()} == {1}
