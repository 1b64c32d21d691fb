"""Neighbourhoods on pixel relations keyed by (image_id, y, x).

Stencils are separable windows or equi-joins on shifted keys, never range joins on coordinates. All windows are
partitioned by image and line, so that no task holds more than a line of an image.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelweir.functions import color

KEYS = ("image_id", "y", "x")
#: The eight neighbours.
EIGHT = tuple((dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) != (0, 0))


def row(width: int = 0):
    w = Window.partitionBy("image_id", "y").orderBy("x")
    return w.rangeBetween(-width, width) if width else w


def column(width: int = 0):
    w = Window.partitionBy("image_id", "x").orderBy("y")
    return w.rangeBetween(-width, width) if width else w


def border(px: DataFrame, width: int, height: int, n: int = 1) -> Column:
    y, x = px["y"], px["x"]
    return (y < n) | (x < n) | (y >= height - n) | (x >= width - n)


def box(px: DataFrame, value: Column, how, radius: int = 1, name: str = "v") -> DataFrame:
    """Adds an aggregate (min, max, sum) over a square around each pixel, clipped at the image."""
    return px.withColumn("_row", how(value).over(row(radius))).withColumn(name, how("_row").over(column(radius))).drop("_row")


def erode(px: DataFrame, mask: Column, radius: int = 1, name: str = "eroded") -> DataFrame:
    """The mask without what lies within `radius` of its outside; the image's edge is no outside."""
    return box(px, mask.cast("int"), F.min, radius, "_v").withColumn(name, F.col("_v") == 1).drop("_v")


def dilate(px: DataFrame, mask: Column, radius: int = 1, name: str = "dilated") -> DataFrame:
    return box(px, mask.cast("int"), F.max, radius, "_v").withColumn(name, F.col("_v") == 1).drop("_v")


def opened(px: DataFrame, mask: Column, radius: int, name: str = "opened") -> DataFrame:
    """Morphological opening by a square."""
    return dilate(erode(px, mask, radius, "_e"), F.col("_e"), radius, name).drop("_e")


def neighbor_count(px: DataFrame, mask: Column, name: str = "n") -> DataFrame:
    """Set pixels among the eight neighbours."""
    return box(px.withColumn("_m", mask.cast("int")), F.col("_m"), F.sum, 1, "_v").withColumn(name, F.col("_v") - F.col("_m")).drop("_v", "_m")


def endpoints(px: DataFrame, mask: Column) -> DataFrame:
    """Set pixels with exactly one set neighbour."""
    return neighbor_count(px.withColumn("_set", mask), F.col("_set"), "_n").filter("_set AND _n = 1").drop("_set", "_n")


def seams(px: DataFrame, label: str = "label") -> DataFrame:
    """Adds seam: the right or the lower neighbour has another label."""
    right, below = F.lead(label).over(row()), F.lead(label).over(column())
    return px.withColumn("seam", F.coalesce(right != F.col(label), F.lit(False)) | F.coalesce(below != F.col(label), F.lit(False)))


def shifted(px: DataFrame, dy: int, dx: int, columns: dict[str, str]) -> DataFrame:
    """For each pixel the columns of its neighbour at (dy, dx), renamed; pixels without one are left out."""
    return px.select("image_id", (F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x"), *[F.col(c).alias(n) for c, n in columns.items()])


#: An edge's least sRGB distance, the least distance of a blend from both sides, and the allowed detour.
EDGE_MIN, MIX_MIN, MIX_SLACK = 24.0, 6.0, 10.0


def mixed(px: DataFrame) -> DataFrame:
    """Adds mixed: an opaque pixel whose colour is a blend of two opposite, clearly different opaque neighbours.

    The four directions are four lag/lead pairs over lines, columns and both diagonals.
    """
    here = F.struct("r", "g", "b", "a").alias("c")
    lines = {"row": ("y", "x"), "column": ("x", "y"), "falling": ("_d", "x"), "rising": ("_s", "x")}
    out = px.withColumn("_d", F.col("y") - F.col("x")).withColumn("_s", F.col("y") + F.col("x")).withColumn("_c", here)
    hits = []
    for name, (by, along) in lines.items():
        w = Window.partitionBy("image_id", by).orderBy(along)
        out = out.withColumn(f"_b{name}", F.lag("_c").over(w)).withColumn(f"_a{name}", F.lead("_c").over(w))
        p, q, me = F.col(f"_b{name}"), F.col(f"_a{name}"), F.col("_c")
        rgb = lambda s: tuple(s[k].cast("double") for k in "rgb")
        d1, d2, d12 = color.rgb_distance(rgb(me), rgb(p)), color.rgb_distance(rgb(me), rgb(q)), color.rgb_distance(rgb(p), rgb(q))
        hit = (p["a"] >= 128) & (q["a"] >= 128) & (d12 > EDGE_MIN) & (F.least(d1, d2) > MIX_MIN) & (d1 + d2 <= d12 + MIX_SLACK)
        hits.append(F.coalesce(hit, F.lit(False)))
    any_hit = hits[0] | hits[1] | hits[2] | hits[3]
    return out.withColumn("mixed", any_hit & color.opaque(F.col("a"))).select(*px.columns, "mixed")


def noise_sigma(px: DataFrame, gray: Column) -> DataFrame:
    """(image_id, sigma): Gaussian noise on smooth inner pixels, by the absolute Laplacian difference.

    The nine taps are three lag/lead triples down the columns after three along the rows.
    """
    g = px.withColumn("_g", gray)
    for k, offset in (("l", -1), ("c", 0), ("r", 1)):
        g = g.withColumn(f"_{k}", F.lag("_g", -offset).over(row()) if offset else F.col("_g"))
    taps = {}
    for k in "lcr":
        g = g.withColumn(f"_{k}u", F.lag(f"_{k}").over(column())).withColumn(f"_{k}d", F.lead(f"_{k}").over(column()))
        taps[k] = (F.col(f"_{k}u"), F.col(f"_{k}"), F.col(f"_{k}d"))
    (lu, lm, ld), (cu, cm, cd), (ru, rm, rd) = taps["l"], taps["c"], taps["r"]
    lap = F.abs(lu - 2 * cu + ru - 2 * lm + 4 * cm - 2 * rm + ld - 2 * cd + rd)
    slope = F.abs(ru + 2 * rm + rd - lu - 2 * lm - ld) + F.abs(ld + 2 * cd + rd - lu - 2 * cu - ru)
    inner = g.select("image_id", lap.alias("lap"), slope.alias("slope")).filter("lap IS NOT NULL AND slope < 48")
    found = inner.groupBy("image_id").agg((F.lit((3.141592653589793 / 2) ** 0.5 / 6) * F.sum("lap") / F.count("*")).alias("sigma"))
    return px.select("image_id").distinct().join(found, "image_id", "left").select("image_id", F.coalesce("sigma", F.lit(0.0)).alias("sigma"))


def ssim(pairs: DataFrame, width: int, height: int, radius: int = 3) -> DataFrame:
    """(image_id, ssim): structural similarity of gray columns p and q (0 to 1), uniform windows, sample covariance, the border cut off."""
    n = float((2 * radius + 1) ** 2)
    out = pairs.select("image_id", "y", "x", "p", "q", (F.col("p") * F.col("p")).alias("pp"), (F.col("q") * F.col("q")).alias("qq"), (F.col("p") * F.col("q")).alias("pq"))
    for c in ("p", "q", "pp", "qq", "pq"):
        out = out.withColumn(c, F.sum(c).over(row(radius)))
    for c in ("p", "q", "pp", "qq", "pq"):
        out = out.withColumn(c, F.sum(c).over(column(radius)) / n)
    inner = out.filter((F.col("y") >= radius) & (F.col("y") < height - radius) & (F.col("x") >= radius) & (F.col("x") < width - radius))
    fix, c1, c2 = n / (n - 1), 0.01**2, 0.03**2
    vp, vq, cov = fix * (F.col("pp") - F.col("p") * F.col("p")), fix * (F.col("qq") - F.col("q") * F.col("q")), fix * (F.col("pq") - F.col("p") * F.col("q"))
    s = (2 * F.col("p") * F.col("q") + c1) * (2 * cov + c2) / ((F.col("p") * F.col("p") + F.col("q") * F.col("q") + c1) * (vp + vq + c2))
    return inner.groupBy("image_id").agg(F.avg(s).alias("ssim"))


def resize_area(px: DataFrame, factor: int, columns: tuple[str, ...] = ("r", "g", "b", "a")) -> DataFrame:
    """Averages of factor x factor cells."""
    return px.groupBy("image_id", F.floor(F.col("y") / factor).cast("int").alias("y"), F.floor(F.col("x") / factor).cast("int").alias("x")).agg(*[F.avg(c).alias(c) for c in columns])


def resize_nearest(px: DataFrame, sh: int, sw: int, h: int, w: int) -> DataFrame:
    """Nearest neighbour by pixel centres: each source pixel gives the target pixels whose centre falls on it."""

    def targets(at: Column, source: int, target: int) -> Column:
        first = F.ceil(at * target / source - 0.5)
        last = F.ceil((at + 1) * target / source - 0.5) - 1
        return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))

    out = px.withColumn("_y", F.explode(targets(F.col("y"), sh, h))).withColumn("_x", F.explode(targets(F.col("x"), sw, w)))
    return out.select(*[F.col(f"_{c}").cast("int").alias(c) if c in ("y", "x") else F.col(c) for c in px.columns])
