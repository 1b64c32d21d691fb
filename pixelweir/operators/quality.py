"""Quality of a rendering against its source: gaps, overlap, colour differences, and the checks made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelweir.functions import color
from pixelweir.operators import grid, palette

# Thresholds of the checks.
MAX_DELTA_E, MAX_MEAN_DELTA_E, MIN_ALPHA_IOU, MAX_GAP_RATIO = 3.0, 2.0, 0.98, 0.0005
SSIM_MIN = {"flat_color": 0.90, "line_art": 0.85, "mixed": 0.85}
UNCOVERED_SHARE = 0.005


def pair(source: DataFrame, preview: DataFrame) -> DataFrame:
    """Source and preview pixels side by side: r, g, b, a, label and pr, pg, pb, pa."""
    other = preview.select("image_id", "y", "x", *[F.col(c).alias(f"p{c}") for c in "rgba"])
    return source.join(other, ["image_id", "y", "x"])


def gaps(pairs: DataFrame) -> DataFrame:
    """(image_id, interior, gap, gap_ratio, iou): transparent preview pixels inside the source's eroded opaque area, and the overlap of both opaque areas (1 if neither has any)."""
    inner = grid.erode(pairs, F.col("a") >= 128, 1, "inside")
    a, b = F.col("a") >= 128, F.col("pa") >= 128
    n = lambda c: F.sum(c.cast("long"))
    out = inner.groupBy("image_id").agg(n(F.col("inside")).alias("interior"), n(F.col("inside") & (F.col("pa") < 128)).alias("gap"), n(a & b).alias("both"), n(a | b).alias("any"))
    return out.select(
        "image_id", "interior", "gap", F.when(F.col("interior") > 0, F.col("gap") / F.col("interior")).otherwise(0.0).alias("gap_ratio"), F.when(F.col("any") > 0, F.col("both") / F.col("any")).otherwise(1.0).alias("iou")
    )


def region_delta_e(source: DataFrame, layers: DataFrame) -> DataFrame:
    """(image_id, label, n, delta_e): CIEDE2000 between each layer's colour (image_id, label, lr, lg, lb) and the median LAB of its opaque source pixels."""
    lab = color.with_lab(source.filter(color.opaque(F.col("a"))))
    middle = lab.groupBy("image_id", "label").agg(F.count("*").alias("n"), *[F.expr(f"percentile({c}, 0.5)").alias(c) for c in ("l", "la", "lb")])
    own = color.with_lab(layers, ("lr", "lg", "lb"), ("ol", "oa", "ob")).select("image_id", "label", "ol", "oa", "ob")
    out = color.with_delta_e2000(middle.join(own, ["image_id", "label"]), ("ol", "oa", "ob"), ("l", "la", "lb"), "delta_e")
    return out.select("image_id", "label", "n", "delta_e")


def uncovered(source: DataFrame, layers: DataFrame, share: float = UNCOVERED_SHARE) -> DataFrame:
    """(image_id, label, n): labels with a share of the opaque pixels that no layer represents."""
    seen = source.filter(color.opaque(F.col("a"))).groupBy("image_id", "label").agg(F.count("*").alias("n"))
    total = seen.groupBy("image_id").agg(F.sum("n").alias("total"))
    return seen.join(total, "image_id").filter(F.col("n") >= share * F.col("total")).select("image_id", "label", "n").join(layers.select("image_id", "label"), ["image_id", "label"], "left_anti")


def pixel_delta_e(pairs: DataFrame, most: int = 200_000) -> DataFrame:
    """(image_id, p95): 95th percentile, interpolated, of CIEDE2000 over white inside the eroded opaque area, evenly strided."""
    inner = grid.erode(pairs, F.col("a") >= 128, 1, "inside").filter("inside")
    some = palette.stride_sample(inner, ["image_id"], ["y", "x"], most)
    white = {f"{p}w{c}": color.over_white(F.col(f"{p}{c}"), F.col(f"{p}a")) * 255.0 for p in ("", "p") for c in "rgb"}
    both = color.with_lab(color.with_lab(some.withColumns(white), ("wr", "wg", "wb"), ("l1", "a1", "b1")), ("pwr", "pwg", "pwb"), ("l2", "a2", "b2"))
    de = color.with_delta_e2000(both, ("l1", "a1", "b1"), ("l2", "a2", "b2"))
    return de.groupBy("image_id").agg(F.expr("percentile(de, 0.95)").alias("p95"))


def passes(value: Column, comparator: Column, threshold: Column) -> Column:
    return F.when(comparator == "<", value < threshold).when(comparator == "<=", value <= threshold).when(comparator == ">=", value >= threshold).when(comparator == ">", value > threshold)


def checks(reports: DataFrame) -> DataFrame:
    """(image_id, name, value, threshold, comparator, passed) from a row of metrics an image: ssim, ssim_min, mean_de, max_de, gap_ratio, iou (null: not asked), time_s, budget_s, svg_ok."""
    rows = [
        ("ssim", F.col("ssim"), F.col("ssim_min"), ">="),
        ("mean_delta_e", F.col("mean_de"), F.lit(MAX_MEAN_DELTA_E), "<"),
        ("max_delta_e", F.col("max_de"), F.lit(MAX_DELTA_E), "<"),
        ("gap_ratio", F.col("gap_ratio"), F.lit(MAX_GAP_RATIO), "<="),
        ("alpha_iou", F.col("iou"), F.lit(MIN_ALPHA_IOU), ">="),
        ("processing_time_s", F.col("time_s"), F.col("budget_s"), "<"),
        ("svg_valid", F.col("svg_ok").cast("double"), F.lit(1.0), ">="),
    ]
    stack = F.array(*[F.struct(F.lit(n).alias("name"), v.cast("double").alias("value"), t.cast("double").alias("threshold"), F.lit(c).alias("comparator")) for n, v, t, c in rows])
    out = reports.select("image_id", F.explode(stack).alias("c")).select("image_id", "c.*").filter("value IS NOT NULL")
    return out.withColumn("passed", passes(F.col("value"), F.col("comparator"), F.col("threshold")))


def verdicts(rows: DataFrame) -> DataFrame:
    """(image_id, passed, failed): all checks passed, and the names of those that didn't."""
    failed = F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("name"))))
    return rows.groupBy("image_id").agg(F.every("passed").alias("passed"), failed.alias("failed"))


def class_scores(features: DataFrame) -> DataFrame:
    """(image_id, p_mixed, p_line_art, p_flat_color, label, confidence) from features by factored logistic scores; ties prefer flat_color."""
    s = color.sigmoid
    f = F.col
    gradient = F.greatest(s((f("gradient_area") - 0.25) / 0.05), s((f("colors_95") - 20.0) / 3.0))
    thin = F.sqrt(s((f("thin_ink_ratio") - 0.8) / 0.05) * s((f("edge_per_ink") - 0.15) / 0.04))
    line = s((0.03 - f("fill_ratio")) / 0.008) * thin * s((f("ink_extent") - 0.25) / 0.05) * s((0.3 - f("ink_ratio")) / 0.05)
    outline = s((f("outline_fraction") - 0.008) / 0.002) * s((f("outline_ratio") - 0.35) / 0.07)
    p = features.withColumns({"_g": gradient, "_l": line, "_o": outline})
    g, ln, o = f("_g"), f("_l"), f("_o")
    out = p.select("image_id", (g + (1 - g) * (1 - ln) * o).alias("p_mixed"), ((1 - g) * ln).alias("p_line_art"), ((1 - g) * (1 - ln) * (1 - o)).alias("p_flat_color"))
    top = F.greatest("p_mixed", "p_line_art", "p_flat_color")
    label = F.when(f("p_flat_color") == top, "flat_color").when(f("p_line_art") == top, "line_art").otherwise("mixed")
    return out.withColumn("label", label).withColumn("confidence", F.least(F.lit(1.0), F.greatest(F.lit(0.0), top)))


def palette_problems(labels: DataFrame, table: DataFrame) -> DataFrame:
    """(image_id, problem, n): indexes that aren't dense, more than one background, labels without a colour, and counts that don't fit."""
    dense = table.groupBy("image_id").agg(F.count("*").alias("k"), F.max("idx").alias("top"), F.sum(F.col("is_background").cast("int")).alias("bg"))
    counts = labels.filter("idx >= 0").groupBy("image_id", "idx").agg(F.count("*").alias("got"))
    joined = table.select("image_id", "idx", "n").join(counts, ["image_id", "idx"], "full")
    found = [
        dense.filter("top + 1 <> k").select("image_id", F.lit("index_not_dense").alias("problem"), F.lit(1).cast("long").alias("n")),
        dense.filter("bg > 1").select("image_id", F.lit("many_backgrounds").alias("problem"), F.col("bg").cast("long").alias("n")),
        joined.filter("n IS NULL").groupBy("image_id").agg(F.lit("unknown_label").alias("problem"), F.count("*").alias("n")),
        joined.filter("n IS NOT NULL AND coalesce(got, 0) <> n").groupBy("image_id").agg(F.lit("count_differs").alias("problem"), F.count("*").alias("n")),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
