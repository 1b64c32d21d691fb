"""Regions: connected components, rectangles, layers and rectangle paths, and filling them again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelweir.functions import text
from pixelweir.operators import kernels


def components(px: DataFrame, label: str = "label", diagonal: bool = False) -> DataFrame:
    """Adds comp: the smallest y * 2^20 + x of the pixel's connected region of equal labels.

    One image is one group: a raster fits a task, and its pixels are needed together.
    """
    fields = [f for f in px.schema.fields if f.name != "comp"]
    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([*fields, StructField("comp", LongType())])

    def run(pdf):
        return pdf.assign(comp=kernels.component_ids(pdf["y"].to_numpy(), pdf["x"].to_numpy(), pdf[label].to_numpy(), diagonal))

    return px.select(*[f.name for f in fields]).groupBy("image_id").applyInPandas(run, schema)


def component_stats(px: DataFrame) -> DataFrame:
    """(image_id, label, comp, area, y0, x0, y1, x1) of pixels with comp; bounds are inclusive."""
    return px.groupBy("image_id", "label", "comp").agg(F.count("*").alias("area"), F.min("y").alias("y0"), F.min("x").alias("x0"), F.max("y").alias("y1"), F.max("x").alias("x1"))


def ink_extent(stats: DataFrame, width: int, height: int) -> DataFrame:
    """(image_id, ink_extent): the components' bounding diagonals by area, over the image's."""
    diagonal = F.sqrt(F.pow(F.col("x1") - F.col("x0") + 1, F.lit(2.0)) + F.pow(F.col("y1") - F.col("y0") + 1, F.lit(2.0)))
    return stats.groupBy("image_id").agg((F.sum(F.col("area") * diagonal) / F.sum("area") / F.lit(float((width**2 + height**2) ** 0.5))).alias("ink_extent"))


def speckle_targets(px: DataFrame, stats: DataFrame, colors: DataFrame, least_area: int) -> DataFrame:
    """(image_id, comp, target): for each component under least_area the neighbouring label of another, settled component with the closest colour, the least of equals.

    Neighbours come from eight shifted equi-joins; components without a settled neighbour get no row.
    """
    from pixelweir.operators import grid

    sized = px.join(stats.select("image_id", "comp", "area"), ["image_id", "comp"])
    small = sized.filter(F.col("area") < least_area).select("image_id", "y", "x", "comp", "label")
    settled = sized.filter(F.col("area") >= least_area).select("image_id", F.col("y").alias("ny"), F.col("x").alias("nx"), F.col("label").alias("target"))
    offsets = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in grid.EIGHT])
    around = small.withColumn("o", F.explode(offsets)).withColumn("ny", F.col("y") + F.col("o.dy")).withColumn("nx", F.col("x") + F.col("o.dx"))
    near = around.join(settled, ["image_id", "ny", "nx"]).select("image_id", "comp", "label", "target").distinct()
    own = colors.select("image_id", "label", *[F.col(c).alias(f"o{c}") for c in "rgb"])
    other = colors.select("image_id", F.col("label").alias("target"), *[F.col(c).alias(f"t{c}") for c in "rgb"])
    cost = sum(((F.col(f"o{c}") - F.col(f"t{c}")) * (F.col(f"o{c}") - F.col(f"t{c}")) for c in "rgb"), F.lit(0)).cast("long")
    priced = near.join(own, ["image_id", "label"]).join(other, ["image_id", "target"]).withColumn("cost", cost)
    first = F.row_number().over(Window.partitionBy("image_id", "comp").orderBy("cost", "target"))
    return priced.withColumn("_k", first).filter("_k = 1").select("image_id", "comp", "target", "cost")


def rectangles(px: DataFrame, label: str = "label") -> DataFrame:
    """(image_id, label, x0, y0, x1, y1): runs of equal labels along rows, merged downwards where they repeat exactly; ends are exclusive."""
    line = Window.partitionBy("image_id", "y").orderBy("x")
    first = F.coalesce((F.lag(label).over(line) != F.col(label)) | (F.lag("x").over(line) != F.col("x") - 1), F.lit(True))
    runs = px.withColumn("_run", F.sum(first.cast("int")).over(line)).groupBy("image_id", "y", label, "_run").agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"))
    same = Window.partitionBy("image_id", label, "x0", "x1").orderBy("y")
    islands = runs.withColumn("_i", F.col("y") - F.row_number().over(same))
    return islands.groupBy("image_id", label, "x0", "x1", "_i").agg(F.min("y").alias("y0"), (F.max("y") + 1).alias("y1")).select("image_id", label, "x0", "y0", "x1", "y1")


def rect_layers(rects: DataFrame, chunk: int = 1000) -> DataFrame:
    """(image_id, label, path_no, d, n_rects, n_nodes): a label's rectangles as paths of at most `chunk` each, by (y0, x0)."""
    order = Window.partitionBy("image_id", "label").orderBy("y0", "x0")
    numbered = rects.withColumn("path_no", F.floor((F.row_number().over(order) - 1) / chunk).cast("long")).withColumn("d", text.rect_path(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))
    grouped = numbered.groupBy("image_id", "label", "path_no").agg(F.array_sort(F.collect_list(F.struct("y0", "x0", "d"))).alias("parts"), F.count("*").alias("n_rects"))
    d = F.array_join(F.transform("parts", lambda p: p["d"]), " ")
    return grouped.select("image_id", "label", "path_no", d.alias("d"), "n_rects").withColumn("n_nodes", text.n_nodes(F.col("d")).cast("long"))


def layer_plan(counts: DataFrame) -> DataFrame:
    """(image_id, label, z): paint order of labels (n, is_background, is_line): background first, then fills by falling area, lines last."""
    order = Window.partitionBy("image_id").orderBy(F.col("is_line"), ~F.col("is_background"), F.desc("n"), "label")
    return counts.withColumn("z", (F.row_number().over(order) - 1).cast("long"))


def line_colors(px: DataFrame, mask, least: float = 0.05) -> DataFrame:
    """(image_id, label, n): labels with at least a share of the mask, most frequent first."""
    seen = px.filter(mask).groupBy("image_id", "label").agg(F.count("*").alias("n"))
    return seen.withColumn("_t", F.sum("n").over(Window.partitionBy("image_id"))).filter(F.col("n") >= least * F.col("_t")).drop("_t")


def rects_of_paths(paths: DataFrame) -> DataFrame:
    """(image_id, label, x0, y0, x1, y1) parsed from rectangle paths: ten numbers a subpath, the first and the third corner span it."""
    parts = F.filter(F.split("d", "Z"), lambda s: F.trim(s) != "")
    numbers = F.transform(F.regexp_extract_all(F.col("part"), F.lit(r"-?[0-9]+(?:\.[0-9]+)?"), F.lit(0)), lambda t: t.cast("double"))
    rows = paths.select("image_id", "label", F.explode(parts).alias("part")).withColumn("n", numbers)
    return rows.select("image_id", "label", *[F.col("n")[k].cast("int").alias(c) for c, k in (("x0", 0), ("y0", 1), ("x1", 4), ("y1", 5))])


def scanline_fill(rects: DataFrame, width: int) -> DataFrame:
    """(image_id, y, x, label) of pixels inside: each edge adds or ends winding in its rows, and a running sum along the row tells inside from outside.

    Only columns where winding changes are summed; pixels come from spans between them.
    """
    rows = rects.withColumn("y", F.explode(F.sequence(F.col("y0"), F.col("y1") - 1)))
    edges = rows.select("image_id", "label", "y", F.explode(F.array(F.struct(F.col("x0").alias("x"), F.lit(1).alias("w")), F.struct(F.col("x1").alias("x"), F.lit(-1).alias("w")))).alias("e")).select("image_id", "label", "y", "e.*")
    steps = edges.groupBy("image_id", "label", "y", "x").agg(F.sum("w").alias("w"))
    along = Window.partitionBy("image_id", "label", "y").orderBy("x")
    spans = steps.withColumn("wind", F.sum("w").over(along.rowsBetween(Window.unboundedPreceding, 0))).withColumn("end", F.coalesce(F.lead("x").over(along), F.lit(width)))
    return spans.filter("wind <> 0 AND end > x").select("image_id", "y", F.explode(F.sequence(F.col("x"), F.col("end") - 1)).alias("x"), "label")


def composite(layers: DataFrame) -> DataFrame:
    """(image_id, y, x, label, z): the topmost opaque layer of each pixel."""
    return layers.groupBy("image_id", "y", "x").agg(F.max_by(F.struct("label", "z"), "z").alias("t")).select("image_id", "y", "x", "t.*")


def premultiplied_over(layers: DataFrame) -> DataFrame:
    """(image_id, y, x, r, g, b, a) of layer pixels (z, r, g, b, a from 0 to 1) painted from the lowest z up, premultiplied."""
    stack = F.array_sort(F.collect_list(F.struct("z", "r", "g", "b", "a")))
    zero = F.struct(*[F.lit(0.0).alias(c) for c in "rgba"])

    def over(low, top):
        return F.struct(*[(top[c] * top["a"] + low[c] * (1 - top["a"])).alias(c) for c in "rgb"], (top["a"] + low["a"] * (1 - top["a"])).alias("a"))

    done = layers.groupBy("image_id", "y", "x").agg(stack.alias("s")).withColumn("o", F.aggregate("s", zero, over))
    plain = lambda c: F.when(F.col("o.a") > 0, F.col(f"o.{c}") / F.col("o.a")).otherwise(0.0)
    return done.select("image_id", "y", "x", *[plain(c).alias(c) for c in "rgb"], F.col("o.a").alias("a"))
