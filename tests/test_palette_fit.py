import numpy as np
from pyspark.sql import functions as F

from pixelweir.functions import color
from pixelweir.operators import palette_fit as P


def test_colours_equal_the_columns(spark):
    rng = np.random.default_rng(0)
    rgb = np.vstack([rng.integers(0, 256, (60, 6)), [[0, 0, 0, 255, 255, 255], [9, 9, 9, 9, 9, 9], [255, 0, 0, 0, 255, 255]]])
    df = spark.createDataFrame([tuple(map(int, r)) for r in rgb], "r1 int, g1 int, b1 int, r2 int, g2 int, b2 int")
    both = color.with_lab(color.with_lab(df, ("r1", "g1", "b1"), ("l1", "a1", "b_1")), ("r2", "g2", "b2"), ("l2", "a2", "b_2"))
    got = color.with_delta_e2000(both, ("l1", "a1", "b_1"), ("l2", "a2", "b_2")).select("r1", "g1", "b1", "r2", "g2", "b2", "l1", F.col("de")).collect()
    for r in got:
        p, q = P.rgb_to_lab(np.array(r[:3])), P.rgb_to_lab(np.array(r[3:6]))
        assert abs(p[0] - r["l1"]) < 1e-6 and abs(P.delta_e2000(p, q) - r["de"]) < 1e-6
    assert (P.lab_to_rgb(P.rgb_to_lab(rgb[:, :3])) == rgb[:, :3]).all()


def test_close_centres_merge_by_weight():
    lab = np.array([[50.0, 10, 10], [51.0, 10, 10], [90.0, 0, 0]])
    got = P.merge_close(lab, np.array([3.0, 1.0, 5.0]))
    assert np.allclose(got, [[50.25, 10, 10], [90, 0, 0]])
    assert len(P.merge_close(lab, np.zeros(3))) == 2 and len(P.merge_close(lab[:1], np.ones(1))) == 1
    assert (P.apart(P.merge_close(np.random.default_rng(1).normal(50, 6, (24, 3)), np.ones(24))) >= P.MERGE).all()


def test_nearest_equals_brute_force():
    rng = np.random.default_rng(2)
    p, c = rng.integers(0, 9, (400, 3)).astype(float), rng.integers(0, 9, (7, 3)).astype(float)
    assert (P.nearest(p, c) == ((p[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)).all()


def test_blends_equal_brute_force():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 9):
        rgb = rng.integers(0, 256, (n, 3)).astype(float)
        if n > 2:
            rgb[-1] = np.rint((rgb[0] + rgb[1]) / 2)
        lab = P.rgb_to_lab(rgb)
        want = []
        for c in range(n):
            hit = False
            for a in range(n):
                for b in range(n):
                    d = rgb[a] - rgb[b]
                    if c in (a, b) or not d @ d:
                        continue
                    t = (rgb[c] - rgb[b]) @ d / (d @ d)
                    mix = P.rgb_to_lab(np.clip(np.rint(rgb[b] + t * d), 0, 255))
                    hit |= 0.1 <= t <= 0.9 and np.linalg.norm(mix - lab[c]) < P.MIXTURE
            want.append(hit)
        assert list(P.blends(lab)) == want


def test_thin_mixtures_go_and_solid_ones_stay():
    rgb = np.zeros((12, 30, 3))
    rgb[:, 10:] = 128
    rgb[:, 11:] = 255
    lab = P.rgb_to_lab(rgb)
    centers = P.rgb_to_lab(np.array([[0.0, 0, 0], [128, 128, 128], [255, 255, 255]]))
    every = np.ones((12, 30), bool)
    assert len(P.prune(lab.reshape(-1, 3), every, centers)) == 2
    rgb[:, 10:20] = 128
    assert len(P.prune(P.rgb_to_lab(rgb).reshape(-1, 3), every, centers)) == 3
    count, solid = P.solid_share(np.array([[0, 0, -1], [0, 0, 1]]), 3)
    assert list(count) == [4, 1, 0] and solid[0] == 0.5 and solid[1] == solid[2] == 0


def test_labels_of_one_colour_become_one():
    lab = P.rgb_to_lab(np.array([[200.0, 0, 0]] * 3 + [[201, 1, 0]] * 2 + [[0, 0, 255]] * 4 + [[7, 7, 7]]))
    assert list(P.merge_labels(lab, np.array([0, 0, 0, 1, 1, 2, 2, 2, 2, -1]))) == [0] * 5 + [2] * 4 + [-1]
