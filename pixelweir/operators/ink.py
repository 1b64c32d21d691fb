"""Ink and strokes by histograms and stencils: thresholds, stroke masks, ramps, and colours of pure members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelweir.functions import color
from pixelweir.operators import grid, palette

# Fixed values of the stroke masks and the ramp measure.
CORE_DISTANCE, DARK_L_MAX, CLEAR_SHARE, RAMP_SLOPE = 60.0, 40.0, 0.25, 0.5


def otsu(values: DataFrame) -> DataFrame:
    """(image_id, threshold): the integer level v (0 to 255) after which the variance between the classes is largest, the least of equals. An image with one level gets it.

    Only the histogram is windowed: 256 rows an image.
    """
    h = values.groupBy("image_id", "v").agg(F.count("*").alias("n"))
    image = Window.partitionBy("image_id")
    upto = image.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    s = h.select("image_id", "v", F.sum("n").over(upto).alias("n0"), F.sum(F.col("n") * F.col("v")).over(upto).alias("s0"), F.sum("n").over(image).alias("n"), F.sum(F.col("n") * F.col("v")).over(image).alias("s"))
    n1 = F.col("n") - F.col("n0")
    gap = F.col("s0") / F.col("n0") - (F.col("s") - F.col("s0")) / F.nullif(n1, F.lit(0))
    between = F.coalesce(F.col("n0") * n1 * gap * gap, F.lit(-1.0))
    return s.groupBy("image_id").agg(F.max_by("v", F.struct(F.round(between, 3), -F.col("v"))).alias("threshold"))


def _to(px: DataFrame, colors: DataFrame, name: str) -> DataFrame:
    """Adds the RGB distance to each image's colour; 0 on transparent pixels."""
    c = colors.select("image_id", *[F.col(k).alias(f"_{k}") for k in "rgb"])
    d = color.rgb_distance(tuple(F.col(k).cast("double") for k in "rgb"), tuple(F.col(f"_{k}").cast("double") for k in "rgb"))
    return px.join(c, "image_id", "left").withColumn(name, F.when(color.opaque(F.col("a")), F.coalesce(d, F.lit(0.0))).otherwise(0.0)).drop("_r", "_g", "_b")


def line_art_mask(px: DataFrame) -> DataFrame:
    """Adds ink: opaque pixels far from the dominant colour and at least half of the local contrast; of mostly transparent art all that is opaque."""
    far = grid.box(_to(px, palette.dominant_color(px), "_s"), F.col("_s"), F.max, 1, "_m")
    high = far.groupBy("image_id").agg(F.expr("percentile(_s, 0.9) FILTER (WHERE _s > 20)").alias("_h"), F.avg(color.opaque(F.col("a")).cast("double")).alias("_o"))
    least = F.least(F.lit(120.0), F.greatest(F.lit(30.0), 0.35 * F.col("_h")))
    drawn = F.coalesce((F.col("_s") >= least) & (F.col("_s") >= 0.5 * F.col("_m")), F.lit(False))
    ink = color.opaque(F.col("a")) & F.when(F.col("_o") <= 1 - CLEAR_SHARE, True).otherwise(drawn)
    return far.join(high, "image_id").withColumn("ink", ink).select(*px.columns, "ink")


def ink_color(px: DataFrame) -> DataFrame:
    """(image_id, r, g, b): medians, cut to integers, of the darkest ink; images with less than four dark pixels have none."""
    lab = palette.lab_columns(px.filter(color.opaque(F.col("a")))).withColumn("v", F.floor(F.col("l") * 2.55).cast("int"))
    cut = otsu(lab.select("image_id", "v")).select("image_id", F.least(F.col("threshold") / 2.55, F.lit(DARK_L_MAX)).alias("cut"))
    dark = lab.join(cut, "image_id").filter(F.col("l") <= F.col("cut"))
    floor = dark.groupBy("image_id").agg(F.count("*").alias("n"), F.expr("percentile(l, 0.05)").alias("l0")).filter("n >= 4")
    core = dark.join(floor, "image_id").filter(F.col("l") <= F.col("l0") + 10.0)
    return palette.mean_median(core, ["image_id"]).select("image_id", *[F.col(c).cast("int").alias(c) for c in "rgb"])


def mixed_mask(px: DataFrame) -> DataFrame:
    """Adds ink: pixels near the ink's colour, and the fringe around them that is at most half as far from it as its surroundings."""
    colors = ink_color(px)
    near = grid.box(_to(px, colors, "_t"), F.col("_t"), F.max, 1, "_m").join(colors.select("image_id", F.lit(True).alias("_has")), "image_id", "left")
    core = near.withColumn("_core", F.col("_has").isNotNull() & color.opaque(F.col("a")) & (F.col("_t") <= CORE_DISTANCE))
    ring = grid.dilate(core, F.col("_core"), 1, "_near")
    fringe = F.col("_near") & (F.col("_t") <= 0.5 * F.col("_m")) & color.opaque(F.col("a"))
    return ring.withColumn("ink", F.col("_core") | fringe).select(*px.columns, "ink")


def ramp_share(px: DataFrame, cell: int) -> DataFrame:
    """(image_id, ramp): share of cells whose mean LAB changes by more than RAMP_SLOPE to its neighbours, away from transparency."""
    cells = palette.lab_columns(px).groupBy("image_id", F.floor(F.col("y") / cell).cast("int").alias("y"), F.floor(F.col("x") / cell).cast("int").alias("x")).agg(*[F.avg(c).alias(c) for c in ("l", "la", "lb")], F.min("a").alias("a"))
    g = grid.box(cells, F.col("a"), F.min, 1, "_a")
    up, down, left, right = (lambda c: F.lag(c).over(grid.column())), (lambda c: F.lead(c).over(grid.column())), (lambda c: F.lag(c).over(grid.row())), (lambda c: F.lead(c).over(grid.row()))
    for c in ("l", "la", "lb"):
        g = g.withColumns({f"_{c}y": left(c) + 2 * F.col(c) + right(c), f"_{c}x": up(c) + 2 * F.col(c) + down(c)})
    for c in ("l", "la", "lb"):
        g = g.withColumns({f"_{c}gy": (down(f"_{c}y") - up(f"_{c}y")) / 8.0, f"_{c}gx": (right(f"_{c}x") - left(f"_{c}x")) / 8.0})
    slope = sum((F.col(f"_{c}g{k}") * F.col(f"_{c}g{k}") for c in ("l", "la", "lb") for k in "xy"), F.lit(0.0))
    ramp = F.coalesce((slope > RAMP_SLOPE**2) & (F.col("_a") >= 128), F.lit(False))
    return g.groupBy("image_id").agg(F.avg(ramp.cast("double")).alias("ramp"))


def pure_colors(px: DataFrame, least: int = 8, share: float = 0.02) -> DataFrame:
    """(image_id, label, r, g, b, n_pure): lower medians of each label's unmixed pixels; of all if these are too few."""
    m = grid.mixed(px).filter(color.opaque(F.col("a")))
    w = Window.partitionBy("image_id", "label")
    pure = F.sum((~F.col("mixed")).cast("long")).over(w)
    chosen = m.withColumn("n_pure", pure).withColumn("_all", F.col("n_pure") < F.greatest(F.lit(float(least)), share * F.count("*").over(w))).filter("_all OR NOT mixed")
    return palette.lower_median(chosen, ["image_id", "label", "n_pure"])


def shift_lightness(table: DataFrame, by: float = -5.0) -> DataFrame:
    """Adds shifted: each colour's hex with another lightness, the other way where that would leave the gamut."""
    lab = color.with_lab(table)
    moved = F.when((F.col("l") + by).between(0.0, 100.0), F.col("l") + by).otherwise(F.col("l") - by)
    r, g, b = color.lab_to_rgb(F.col("_l"), F.col("la"), F.col("lb"))
    rgb = lab.withColumn("_l", moved).withColumns({"_r": r, "_g": g, "_b": b})
    return rgb.withColumn("shifted", color.hex_of(F.col("_r"), F.col("_g"), F.col("_b"))).select(*table.columns, "shifted")


def drop_largest(paths: DataFrame, background: DataFrame) -> DataFrame:
    """The paths (image_id, label, d) without the layer of the most path text, the least label of equals; backgrounds count only if there is nothing else."""
    size = paths.groupBy("image_id", "label").agg(F.sum(F.length("d")).alias("size")).join(background.select("image_id", F.col("label").alias("bg")), "image_id", "left")
    rank = F.struct((F.coalesce(F.col("bg") != F.col("label"), F.lit(True))).alias("front"), "size", (-F.col("label")).alias("first"))
    gone = size.groupBy("image_id").agg(F.max_by("label", rank).alias("label"))
    return paths.join(gone, ["image_id", "label"], "left_anti")


def expected_width(explicit: Column, widths: Column) -> Column:
    """A stated stroke width, else the median of the listed ones."""
    v = F.array_sort(F.map_values(widths))
    n = F.size(v)
    middle = (F.get(v, F.floor((n - 1) / 2).cast("int")) + F.get(v, F.floor(n / 2).cast("int"))) / 2.0
    return F.coalesce(explicit.cast("double"), F.when(n > 0, middle))


def width_matches(got: Column, want: Column) -> Column:
    return F.abs(got - want) <= F.greatest(F.lit(1.0), 0.25 * want)
