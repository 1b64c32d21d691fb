"""Fitted palettes made smaller, on the arrays of one image: close colours merged, thin mixtures of others dropped."""

from __future__ import annotations

import numpy as np

from pixelweir.functions import color

# CIEDE2000 under which two colours are one, and under which a thin one is an artifact of the other; CIE76
# within which a colour is a mixture; the share of a solid colour's pixels whose eight neighbours have it too; the span
# of mixtures.
MERGE, ARTIFACT, MIXTURE, SOLID = 3.0, 20.0, 6.0, 0.4
MIX_FROM, MIX_TO = 0.1, 0.9
PRIMARIES, BACK, WHITE = np.array(color.RGB_TO_XYZ), np.array(color.XYZ_TO_RGB), np.array(color.WHITE)


def rgb_to_lab(rgb: np.ndarray) -> np.ndarray:
    c = np.asarray(rgb, float) / 255.0
    linear = np.where(c > 0.04045, ((c + 0.055) / 1.055) ** 2.4, c / 12.92)
    t = linear @ PRIMARIES.T / WHITE
    f = np.where(t > 0.008856, np.cbrt(t), 7.787 * t + 16.0 / 116.0)
    return np.stack([116.0 * f[..., 1] - 16.0, 500.0 * (f[..., 0] - f[..., 1]), 200.0 * (f[..., 1] - f[..., 2])], axis=-1)


def lab_to_rgb(lab: np.ndarray) -> np.ndarray:
    """Whole sRGB values, those out of range at its ends."""
    fy = (lab[..., 0] + 16.0) / 116.0
    f = np.stack([lab[..., 1] / 500.0 + fy, fy, np.maximum(fy - lab[..., 2] / 200.0, 0.0)], axis=-1)
    xyz = np.where(f > 0.2068966, f**3, (f - 16.0 / 116.0) / 7.787) * WHITE
    linear = xyz @ BACK.T
    c = np.where(linear > 0.0031308, 1.055 * np.maximum(linear, 0.0) ** (1 / 2.4) - 0.055, 12.92 * linear)
    return np.rint(np.clip(c, 0.0, 1.0) * 255.0)


def delta_e2000(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """CIEDE2000 of LAB arrays that broadcast."""
    p, q = np.broadcast_arrays(np.asarray(p, float), np.asarray(q, float))
    mean7 = ((np.hypot(p[..., 1], p[..., 2]) + np.hypot(q[..., 1], q[..., 2])) / 2) ** 7
    stretch = 1.5 - 0.5 * np.sqrt(mean7 / (mean7 + 25.0**7))
    ap, aq = p[..., 1] * stretch, q[..., 1] * stretch
    cp, cq = np.hypot(ap, p[..., 2]), np.hypot(aq, q[..., 2])
    hp, hq = np.degrees(np.arctan2(p[..., 2], ap)) % 360, np.degrees(np.arctan2(q[..., 2], aq)) % 360
    gray = cp * cq == 0
    turn = np.where(gray, 0.0, (hq - hp + 180) % 360 - 180)
    turn = np.where(~gray & (hq - hp == 180), 180.0, turn)
    apart = np.abs(hp - hq) > 180
    hue = np.where(gray, hp + hq, np.where(apart, np.where(hp + hq < 360, hp + hq + 360, hp + hq - 360), hp + hq) / 2)
    light, chroma = (p[..., 0] + q[..., 0]) / 2, (cp + cq) / 2
    cos = lambda k, d: np.cos(np.radians(k * hue + d))
    t = 1 - 0.17 * cos(1, -30) + 0.24 * cos(2, 0) + 0.32 * cos(3, 6) - 0.20 * cos(4, -63)
    c7 = chroma**7
    rotate = -np.sin(np.radians(60 * np.exp(-(((hue - 275) / 25) ** 2)))) * 2 * np.sqrt(c7 / (c7 + 25.0**7))
    dl = (q[..., 0] - p[..., 0]) / (1 + 0.015 * (light - 50) ** 2 / np.sqrt(20 + (light - 50) ** 2))
    dc = (cq - cp) / (1 + 0.045 * chroma)
    dh = 2 * np.sqrt(cp * cq) * np.sin(np.radians(turn / 2)) / (1 + 0.015 * chroma * t)
    return np.sqrt(np.maximum(dl**2 + dc**2 + dh**2 + rotate * dc * dh, 0))


def apart(lab: np.ndarray) -> np.ndarray:
    """CIEDE2000 of all pairs of a palette; a colour is infinitely far from itself."""
    de = delta_e2000(lab[:, None], lab[None])
    np.fill_diagonal(de, np.inf)
    return de


def nearest(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The nearest centre of each point, the first of equals; one centre after the other, so that memory grows with the points alone."""
    best, found = np.full(len(points), np.inf), np.zeros(len(points), np.int64)
    for k, c in enumerate(centers):
        d = ((points - c) ** 2).sum(axis=1)
        closer = d < best
        best[closer], found[closer] = d[closer], k
    return found


def merge_close(centers: np.ndarray, weights: np.ndarray, least: float = MERGE) -> np.ndarray:
    """Merges the closest two centres to their weighted mean until all are `least` apart."""
    centers, weights = np.array(centers, float), np.array(weights, float)
    while len(centers) > 1:
        de = apart(centers)
        i, j = divmod(int(de.argmin()), len(centers))
        if de[i, j] >= least:
            break
        both = weights[i] + weights[j]
        share = weights[j] / both if both > 0 else 0.0
        centers[i] += share * (centers[j] - centers[i])
        weights[i] = both
        others = np.arange(len(centers)) != j
        centers, weights = centers[others], weights[others]
    return centers


def blends(centers: np.ndarray) -> np.ndarray:
    """Whether each centre is near a mixture, in sRGB, of two others."""
    rgb = lab_to_rgb(centers)
    n = len(rgb)
    span = rgb[:, None] - rgb[None]  # a - b
    norm = (span**2).sum(axis=-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.einsum("cbk,abk->cab", span, span) / norm[None]
    mixed = np.clip(np.rint(rgb[None, None] + np.nan_to_num(t, posinf=0, neginf=0)[..., None] * span[None]), 0, 255)
    near = np.sqrt(((rgb_to_lab(mixed) - centers[:, None, None]) ** 2).sum(axis=-1)) < MIXTURE
    c, a, b = np.ogrid[:n, :n, :n]
    return (near & (norm[None] > 0) & (t >= MIX_FROM) & (t <= MIX_TO) & (a < b) & (c != a) & (c != b)).any(axis=(1, 2))


def solid_share(labels: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Pixels of each label from 0 to n - 1, and the share of them whose eight neighbours have the label too (beyond the edge: the edge's own)."""
    around = np.pad(labels, 1, mode="edge")
    h, w = labels.shape
    same = np.ones(labels.shape, bool)
    for dy in range(3):
        for dx in range(3):
            same &= around[dy : dy + h, dx : dx + w] == labels
    count = np.bincount(labels[labels >= 0], minlength=n)
    return count, np.bincount(labels[same & (labels >= 0)], minlength=n) / np.maximum(count, 1)


def prune(points: np.ndarray, mask: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Drops centres without pixels, and thin ones that are mixtures of two others or close to another, the smallest first; points are those of the mask in raster order."""
    labels = np.full(mask.shape, -1)
    while len(centers) > 1:
        labels[mask] = nearest(points, centers)
        count, solid = solid_share(labels, len(centers))
        odd = (apart(centers).min(axis=1) < ARTIFACT) | blends(centers)
        bad = (count == 0) | (odd & (solid < SOLID))
        if not bad.any():
            break
        centers = np.delete(centers, int(np.where(bad, count, np.iinfo(np.int64).max).argmin()), axis=0)
    return centers


def merge_labels(points: np.ndarray, labels: np.ndarray, least: float = MERGE) -> np.ndarray:
    """Labels whose median colours, as whole sRGB values, are less than `least` apart become the larger one's, the closest two first. Negative labels stay."""
    labels = labels.copy()
    while True:
        used, count = np.unique(labels[labels >= 0], return_counts=True)
        if len(used) < 2:
            return labels
        colours = np.stack([np.median(points[labels == k], axis=0) for k in used])
        de = apart(rgb_to_lab(lab_to_rgb(colours)))
        i, j = divmod(int(de.argmin()), len(used))
        if de[i, j] >= least:
            return labels
        small, big = (i, j) if (count[i], -used[i]) < (count[j], -used[j]) else (j, i)
        labels[labels == used[small]] = used[big]
