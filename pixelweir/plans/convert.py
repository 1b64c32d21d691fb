"""From pixels to vector documents: the stages as DataFrame transforms, `df.transform(quantize).transform(...)`.

What needs a whole raster at once runs as one array kernel an image (applyInPandas by image_id); all that counts,
joins, ranks or formats is a relation.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweir.functions import color
from pixelweir.operators import documents, grid, kernels, palette, palette_fit, quality, regions, render

# Palette sizes by class, and the quantiser's tolerances.
MAX_COLORS = {"line_art": 8, "flat_color": 16, "mixed": 24}
FIT_TOLERANCE, OUTLIER_SHARE = 12.0, 0.0004


def _by_image(px: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    return px.groupBy("image_id").applyInPandas(run, schema)


def _grid(pdf: pd.DataFrame, *columns: str) -> list[np.ndarray]:
    y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy()
    return [kernels.dense(y, x, pdf[c].to_numpy(), 0) for c in columns]


def fill_transparent(px: DataFrame) -> DataFrame:
    """Transparent pixels in the colour of the nearest opaque one (the first in raster order of equals); images without any stay."""

    def run(pdf):
        r, g, b, a = _grid(pdf, "r", "g", "b", "a")
        if (a >= 128).any():
            ny, nx = kernels.nearest_seed(a >= 128)
            y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy()
            clear = a[y, x] < 128
            at = ny[y, x], nx[y, x]
            pdf = pdf.assign(**{k: np.where(clear, v[at], v[y, x]) for k, v in zip("rgb", (r, g, b), strict=True)})
        return pdf[["image_id", "y", "x", "r", "g", "b", "a"]]

    return _by_image(px.select("image_id", "y", "x", "r", "g", "b", "a"), run, "image_id long, y int, x int, r int, g int, b int, a int")


def denoise(px: DataFrame, rounds: int = 1, sigma_color: float = 50.0) -> DataFrame:
    """Bilateral smoothing."""

    def run(pdf):
        rgb = np.stack(_grid(pdf, "r", "g", "b"), axis=2).astype(np.uint8)
        out = kernels.bilateral(rgb, sigma_color=sigma_color, rounds=rounds)[pdf["y"], pdf["x"]].astype(np.int32)
        return pdf[["image_id", "y", "x", "a"]].assign(r=out[:, 0], g=out[:, 1], b=out[:, 2])[["image_id", "y", "x", "r", "g", "b", "a"]]

    return _by_image(px.select("image_id", "y", "x", "r", "g", "b", "a"), run, "image_id long, y int, x int, r int, g int, b int, a int")


def remove_background(px: DataFrame, found: DataFrame, tolerance: float = 10.0) -> DataFrame:
    """Pixels within tolerance of the detected background and joined to the border become transparent; the fringe around them gets an alpha ramp."""
    lab = palette.lab_columns(px).join(found.filter("found").select("image_id", F.col("l").alias("bl"), F.col("la").alias("ba"), F.col("lb").alias("bb")), "image_id", "left")
    delta = F.coalesce(color.delta_e76(tuple(F.col(c) for c in ("l", "la", "lb")), tuple(F.col(c) for c in ("bl", "ba", "bb"))), F.lit(1e9))
    near = lab.withColumn("delta", delta).select(*px.columns, "delta")

    def run(pdf):
        delta, a = _grid(pdf, "delta", "a")
        flooded = kernels.flood_background((delta < tolerance) & (a >= 128))
        y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy()
        return pdf[["image_id", "y", "x"]].assign(flooded=flooded[y, x])

    flooded = _by_image(near.select("image_id", "y", "x", "a", "delta"), run, "image_id long, y int, x int, flooded boolean")
    joined = grid.dilate(near.join(flooded, ["image_id", "y", "x"]), F.col("flooded"), 1, "fringe")
    ramp = F.rint(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("delta") - tolerance) / tolerance)) * 255.0)
    alpha = F.when(F.col("flooded"), 0).when(F.col("fringe") & (F.col("a") >= 128), F.least(F.col("a"), ramp)).otherwise(F.col("a")).cast("int")
    return joined.withColumn("a", alpha).select(*px.columns)


def quantize(px: DataFrame, max_colors: int = MAX_COLORS["flat_color"], least_area: int = 4) -> DataFrame:
    """(image_id, y, x, label): opaque pixels in their palette's labels by falling count, -1 elsewhere. Close colours are merged and thin mixtures dropped; small regions join the nearest larger one."""

    def run(pdf):
        lab = pdf[["l", "la", "lb"]].to_numpy()
        opaque = pdf["a"].to_numpy() >= 128
        label = np.full(len(pdf), -1)
        if opaque.any():
            points, back, n = np.unique(np.rint(lab[opaque]), axis=0, return_inverse=True, return_counts=True)
            sums = np.stack([np.bincount(back.ravel(), weights=lab[opaque][:, k]) for k in range(3)], axis=1) / n[:, None]
            centers = kernels.grow_centers(sums, n.astype(float), max_colors, FIT_TOLERANCE, OUTLIER_SHARE * n.sum())
            weights = np.bincount(palette_fit.nearest(sums, centers), weights=n, minlength=len(centers))
            y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy()
            mask = kernels.dense(y, x, opaque.astype(np.int64), 0).astype(bool)
            raster_order = np.lexsort((x[opaque], y[opaque]))
            centers = palette_fit.prune(lab[opaque][raster_order], mask, palette_fit.merge_close(centers, weights))
            label[opaque] = palette_fit.nearest(lab[opaque], centers)
            whole = kernels.remove_small(kernels.dense(y, x, label, -1), least_area)[y, x]
            label = palette_fit.merge_labels(lab, np.where(opaque & (whole >= 0), whole, label))
            used, counts = np.unique(label[label >= 0], return_counts=True)
            order = used[np.lexsort((used, -counts))]
            remap = np.full(used.max() + 2, -1)
            remap[order] = np.arange(len(order))
            label = remap[label]
        return pdf[["image_id", "y", "x"]].assign(label=label)

    lab = palette.lab_columns(px).select("image_id", "y", "x", "a", "l", "la", "lb")
    return _by_image(lab, run, "image_id long, y int, x int, label int")


def distances(px: DataFrame, mask) -> DataFrame:
    """(image_id, y, x, d): set pixels' distance to the nearest unset one."""

    def run(pdf):
        d = kernels.edge_distances(_grid(pdf, "m")[0].astype(bool))
        return pdf[["image_id", "y", "x"]].assign(d=d[pdf["y"], pdf["x"]])[pdf["m"].to_numpy().astype(bool)]

    return _by_image(px.select("image_id", "y", "x", mask.alias("m")), run, "image_id long, y int, x int, d double")


def skeleton(px: DataFrame, mask) -> DataFrame:
    """(image_id, y, x, width): a mask's pruned skeleton with the line's width."""

    def run(pdf):
        m = _grid(pdf, "m")[0].astype(bool)
        width = 2 * kernels.edge_distances(m)
        y, x = np.nonzero(kernels.cut_short_ends(kernels.thin(m), width))
        return pd.DataFrame({"image_id": pdf["image_id"].iloc[0], "y": y.astype(np.int32), "x": x.astype(np.int32), "width": width[y, x]})

    return _by_image(px.select("image_id", "y", "x", mask.alias("m")), run, "image_id long, y int, x int, width double")


def centerlines(px: DataFrame, mask, tolerance: float = 0.8) -> DataFrame:
    """(image_id, chain, d, width): a mask's lines as fitted open paths, with their median width to half a pixel."""

    def run(pdf):
        m = _grid(pdf, "m")[0].astype(bool)
        width = 2 * kernels.edge_distances(m)
        rows = []
        for k, line in enumerate(kernels.chains(kernels.cut_short_ends(kernels.thin(m), width))):
            cells = (line - 0.5).astype(int)
            w = max(0.5, float(np.rint(np.median(width[cells[:, 1], cells[:, 0]]) / 0.5) * 0.5))
            words = ["M" + " ".join(kernels.number(v) for v in line[0])]
            for c in kernels.fit_curve(line, tolerance) if len(line) > 1 else []:
                words.append(("L" if len(c) == 2 else "C") + " ".join(kernels.number(v) for v in c[1:].ravel()))
            rows.append((pdf["image_id"].iloc[0], k, " ".join(words), w))
        return pd.DataFrame(rows, columns=["image_id", "chain", "d", "width"])

    return _by_image(px.select("image_id", "y", "x", mask.alias("m")), run, "image_id long, chain int, d string, width double")


def trace(labels: DataFrame, tolerance: float = 0.8, degrees: float = 60.0) -> DataFrame:
    """(image_id, label, d, n_nodes): each label's outline with exact corners and fitted curves, holes by the even-odd rule."""

    def run(pdf):
        grid_ = kernels.dense(pdf["y"].to_numpy(), pdf["x"].to_numpy(), pdf["label"].to_numpy(), -1)
        rows = [(pdf["image_id"].iloc[0], int(k), " ".join(kernels.trace(grid_ == k, tolerance, degrees))) for k in np.unique(grid_[grid_ >= 0])]
        return pd.DataFrame(rows, columns=["image_id", "label", "d"])

    from pixelweir.functions import text

    return _by_image(labels.select("image_id", "y", "x", "label"), run, "image_id long, label int, d string").withColumn("n_nodes", text.n_nodes(F.col("d")).cast("long"))


def document_layers(px: DataFrame, width: int, height: int, exact: bool = False, max_colors: int = 16) -> tuple[DataFrame, DataFrame]:
    """(opaque pixels with the labels found, document layers with label and n_nodes) of rasters (image_id, y, x, r, g, b, a): quantised, planned, and traced (or as exact rectangles)."""
    labels = quantize(px, max_colors)
    seen = px.drop("label").join(labels, ["image_id", "y", "x"])
    opaque = seen.filter("label >= 0")
    table = palette.palette(seen, palette.border_background(seen, grid.border(seen, width, height), opaque_only=False).filter("label >= 0"))
    plan = regions.layer_plan(table.select("image_id", "label", "n", "is_background", F.lit(False).alias("is_line")))
    paths = regions.rect_layers(regions.rectangles(opaque), 1 << 30) if exact else trace(opaque)
    layers = table.join(plan.select("image_id", "label", "z"), ["image_id", "label"]).join(paths.select("image_id", "label", "d", "n_nodes"), ["image_id", "label"])
    style = [F.lit(False).alias("is_stroke"), F.lit(1.0).alias("stroke_width"), F.lit("evenodd").alias("fill_rule"), F.lit(1.0).alias("opacity")]
    return opaque, layers.select("image_id", "label", "z", F.col("name").alias("id"), "d", "n_nodes", F.col("hex").alias("color_hex"), *style)


def convert(px: DataFrame, width: int, height: int, exact: bool = False, max_colors: int = 16) -> DataFrame:
    """(image_id, svg, eps, n_layers, n_nodes) of rasters (image_id, y, x, r, g, b, a): their document layers, written."""
    rows = document_layers(px, width, height, exact, max_colors)[1]
    sums = rows.groupBy("image_id").agg(F.count("*").alias("n_layers"), F.sum("n_nodes").alias("n_nodes"))
    return documents.svg(rows, width, height).join(documents.eps(rows, width, height), "image_id").join(sums, "image_id")


def evaluate(px: DataFrame, width: int, height: int, ssim_min: float, exact: bool = False) -> DataFrame:
    """Checks of converted documents against their sources: similarity, colours, gaps and outlines measured on the
    rendered layers, and the written SVG's structure. Time isn't asked, as no image is converted on its own."""
    opaque, layers = document_layers(px, width, height, exact)
    preview = render.render(layers.withColumns({"path_no": F.lit(0), "width": F.lit(width), "height": F.lit(height)}))
    whole = px.select("image_id", "y", "x").join(preview, ["image_id", "y", "x"], "left").na.fill(0, ["r", "g", "b", "a"])
    pairs = quality.pair(px, whole)
    gray = [color.gray_over_white(*[F.col(f"{p}{c}") for c in "rgba"]).alias(n) for p, n in (("", "p"), ("p", "q"))]
    ssim = grid.ssim(pairs.select("image_id", "y", "x", *gray), width, height)
    r, g, b = color.from_hex(F.col("color_hex"))
    de = quality.region_delta_e(opaque, layers.select("image_id", "label", r.alias("lr"), g.alias("lg"), b.alias("lb"))).groupBy("image_id").agg(F.avg("delta_e").alias("mean_de"), F.max("delta_e").alias("max_de"))
    ids = layers.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("z", "id"))), lambda x: x["id"]).alias("ids"))
    bad = documents.svg_problems(documents.svg(layers, width, height).join(ids, "image_id"), width, height).select("image_id").distinct().withColumn("bad", F.lit(True))
    rows = quality.gaps(pairs).join(ssim, "image_id", "left").join(de, "image_id", "left").join(bad, "image_id", "left")
    none = F.lit(None).cast("double")
    return quality.checks(rows.withColumns({"ssim_min": F.lit(ssim_min), "svg_ok": F.col("bad").isNull(), "time_s": none, "budget_s": none}))
