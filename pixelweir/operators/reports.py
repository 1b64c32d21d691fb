"""Reports: rows of formatted results, plain-text tables of them, and images of what differs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelweir.functions import color
from pixelweir.operators import grid

#: How much a difference is stretched, the gray that gaps are shown on, and their colour.
STRETCH, GRAY_SPAN, GRAY_FROM, GAP_COLOUR = 4.0, 160.0, 60.0, (255, 0, 255)


def decimals(value: Column, places: int) -> Column:
    """A number with so many decimals, halves away from zero; '-' for null."""
    return F.coalesce(F.round(F.round(value, 6).cast("decimal(18,6)"), places).cast("string"), F.lit("-"))


def results(reports: DataFrame, checks: DataFrame) -> DataFrame:
    """(image_id, ssim, mean_de, max_de, gap, iou, verdict) as text, from metrics an image and its checks (quality.checks); failed checks by name. Images without checks give ERROR."""
    failed = checks.filter("NOT passed").groupBy("image_id").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("failed"))
    seen = checks.select("image_id").distinct().withColumn("checked", F.lit(True))
    rows = reports.join(seen, "image_id", "left").join(failed, "image_id", "left")
    verdict = F.when(F.col("checked").isNull(), "ERROR").when(F.col("failed").isNull(), "PASS").otherwise(F.concat(F.lit("FAIL: "), F.col("failed")))
    shown = {"ssim": 4, "mean_de": 2, "max_de": 2, "gap_ratio": 5, "iou": 4}
    return rows.select("image_id", *[decimals(F.col(c), n).alias(c) for c, n in shown.items()], verdict.alias("verdict"))


def lines(rows: DataFrame, group: Column, order: Column, columns: list[str]) -> DataFrame:
    """(group, k, line): a Markdown table for each group, its head being lines 0 and 1 and its rows following by order. Cells are shown as text, null as '-'; a bar inside is escaped."""
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("-")), F.lit("|"), F.lit("\\|"))
    whole = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    k = F.row_number().over(Window.partitionBy("group").orderBy("_order")) + 1
    body = rows.select(group.alias("group"), order.alias("_order"), whole([cell(c) for c in columns]).alias("line")).select("group", k.cast("int").alias("k"), "line")
    heads = F.array(F.struct(F.lit(0).alias("k"), whole([F.lit(c) for c in columns]).alias("line")), F.struct(F.lit(1).alias("k"), whole([F.lit("---") for _ in columns]).alias("line")))
    head = body.select("group").distinct().select("group", F.explode(heads).alias("h")).select("group", "h.*")
    return head.unionByName(body)


def difference(pairs: DataFrame) -> DataFrame:
    """(image_id, y, x, heat, gr, gg, gb): how far preview (pr, pg, pb, pa) and source lie apart over white, stretched, from 0 to 255; and the source in gray with gaps and the pixels around them marked."""
    white = {f"_{p}{c}": color.over_white(F.col(f"{p}{c}"), F.col(f"{p}a")) for p in ("", "p") for c in "rgb"}
    d = F.greatest(*[F.abs(F.col(f"_{c}") - F.col(f"_p{c}")) for c in "rgb"])
    inner = grid.erode(pairs, F.col("a") >= 128, 1, "_inside").withColumn("_gap", F.col("_inside") & (F.col("pa") < 128))
    near = grid.dilate(inner, F.col("_gap"), 1, "_near").withColumns(white)
    gray = F.floor((F.col("_r") + F.col("_g") + F.col("_b")) / 3.0 * GRAY_SPAN + GRAY_FROM + 1e-9)
    marked = [F.when(F.col("_near"), v).otherwise(gray).cast("int").alias(f"g{c}") for c, v in zip("rgb", GAP_COLOUR, strict=True)]
    return near.select("image_id", "y", "x", F.least(F.floor(d * (STRETCH * 255.0) + 1e-9), F.lit(255)).cast("int").alias("heat"), *marked)
