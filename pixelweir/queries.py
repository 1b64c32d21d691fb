"""The registered queries of the raster engine: operators applied to the raster derived from `events`, and to other tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelweir.functions import color, text
from pixelweir.operators import documents, grid, ink, jobs, palette, quality, regions, render, reports
from pixelweir.oracles import ORACLES  # noqa: F401
from pixelweir.plans import convert
from pixelweir.sources import raster

H, W = raster.HEIGHT, raster.WIDTH
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
FLAGSHIP = "rect_paths_nodecount"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def on_raster(f: Callable[[DataFrame], DataFrame]) -> Callable:
    QUERIES[f.__name__] = lambda spark, sf: f(raster.derived(spark, sf))
    return f


def big(df: DataFrame, *doubles: str) -> DataFrame:
    """Integers as BIGINT, the named columns rounded to six places: so both engines agree bit by bit."""
    kinds = dict(df.dtypes)
    return df.select(*[F.round(F.col(c).cast("double"), 6).alias(c) if c in doubles else F.col(c).cast("long").alias(c) if kinds[c] in ("int", "bigint", "smallint") or kinds[c].startswith("decimal") else F.col(c) for c in df.columns])


def rgb(prefix: str = "") -> tuple[Column, Column, Column]:
    return F.col(f"{prefix}r"), F.col(f"{prefix}g"), F.col(f"{prefix}b")


def colours(px: DataFrame) -> DataFrame:
    return px.select("r", "g", "b").distinct()


def on_border(px: DataFrame) -> Column:
    return grid.border(px, W, H)


def background(px: DataFrame) -> DataFrame:
    return palette.border_background(px, on_border(px), opaque_only=False)


def table_of(px: DataFrame) -> DataFrame:
    return palette.palette(px, background(px))


@on_raster
def raster_scan(px: DataFrame) -> DataFrame:
    return big(px.withColumn("on_border", on_border(px)))


@on_raster
def color_hex_pack(px: DataFrame) -> DataFrame:
    c = colours(px).select("r", "g", "b", color.hex_of(*rgb()).alias("hex"), color.code(*rgb()).alias("code"), color.code5(*rgb()).alias("code5"))
    back = color.from_hex(F.col("hex"))
    return big(c.withColumns({"back": color.code(*back)}))


@on_raster
def srgb_to_lab(px: DataFrame) -> DataFrame:
    c = palette.lab_columns(colours(px))
    return big(c.withColumn("bin", color.lab_bin(F.col("l"), F.col("la"), F.col("lb"))), "l", "la", "lb")


@on_raster
def lab_round_trip(px: DataFrame) -> DataFrame:
    c = palette.lab_columns(colours(px))
    r, g, b = color.lab_to_rgb(F.col("l"), F.col("la"), F.col("lb"))
    return big(c.select("r", "g", "b", r.alias("r2"), g.alias("g2"), b.alias("b2")))


def _pairs(px: DataFrame) -> DataFrame:
    return palette.palette_pairs(palette.lab_columns(table_of(px)))


_SIDES = tuple(tuple(f"{c}{k}" for c in ("l", "la", "lb")) for k in (1, 2))


@on_raster
def delta_e2000_pairs(px: DataFrame) -> DataFrame:
    return big(color.with_delta_e2000(_pairs(px), *_SIDES).select("image_id", "i", "j", "de"), "de")


@on_raster
def delta_e76_pairs(px: DataFrame) -> DataFrame:
    p, q = (tuple(F.col(c) for c in s) for s in _SIDES)
    return big(_pairs(px).select("image_id", "i", "j", color.delta_e76(p, q).alias("de")), "de")


@on_raster
def composite_gray(px: DataFrame) -> DataFrame:
    a = F.col("a")
    return big(px.select("image_id", "y", "x", *[color.over_white(c, a).alias(f"w{n}") for n, c in zip("rgb", rgb(), strict=True)], color.gray_over_white(*rgb(), a).alias("gray"), color.opaque(a).alias("is_opaque")), "wr", "wg", "wb", "gray")


@on_raster
def unique_color_histogram(px: DataFrame) -> DataFrame:
    return big(palette.histogram(px), "share")


@on_raster
def coarse_bins_colors95(px: DataFrame) -> DataFrame:
    return big(palette.coarse_bins(px))


@on_raster
def lab_grid_collapse(px: DataFrame) -> DataFrame:
    points = palette.lab_columns(px.groupBy("image_id", "r", "g", "b").agg(F.count("*").alias("w")))
    return big(palette.lab_grid(points, 8.0), "l", "la", "lb")


@on_raster
def lower_median_color(px: DataFrame) -> DataFrame:
    return big(palette.lower_median(px, ["image_id", "label"]))


@on_raster
def np_median_color(px: DataFrame) -> DataFrame:
    return big(palette.mean_median(px, ["image_id", "label"]), "r", "g", "b")


@on_raster
def p95_delta(px: DataFrame) -> DataFrame:
    return big(quality.pixel_delta_e(quality.pair(px, raster.rendered(px))), "p95")


@on_raster
def stride_sample(px: DataFrame) -> DataFrame:
    return big(palette.stride_sample(px, ["image_id", "label"], ["y", "x"], 10))


@on_raster
def border_background_all(px: DataFrame) -> DataFrame:
    return big(background(px))


@on_raster
def border_background_opaque(px: DataFrame) -> DataFrame:
    corner = F.when(F.col("y").isin(0, H - 1) & F.col("x").isin(0, W - 1), 2).otherwise(1)
    return big(palette.border_background(px.withColumn("_corner", corner), on_border(px), opaque_only=True))


@on_raster
def detect_background(px: DataFrame) -> DataFrame:
    return big(palette.detect_background(px, on_border(px)), "l", "la", "lb", "share")


@on_raster
def dominant_color(px: DataFrame) -> DataFrame:
    return big(palette.dominant_color(px))


@on_raster
def nearest_center_rgb(px: DataFrame) -> DataFrame:
    c = colours(px)
    best = palette.nearest([k.cast("double") for k in rgb()], [(k, list(v)) for k, v in enumerate(raster.PALETTE)])
    return big(c.select("r", "g", "b", best["id"].alias("center"), best["d2"].cast("long").alias("d2")))


@query
def nearest_center_embedding(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector's nearest of the ten first vectors by class (the smallest vec_id of a label)."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    first = e.groupBy("label").agg(F.min_by(F.transform("embedding", lambda v: v.cast("double")), "vec_id").alias("c"))
    packed = first.agg(F.array_sort(F.collect_list(F.struct("label", "c"))).alias("centers"))  # a row a class
    d2 = lambda c: F.aggregate(F.zip_with("embedding", c, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, v: s + v)
    best = F.array_min(F.transform("centers", lambda c: F.struct(F.round(d2(c["c"]), 6).alias("d2"), c["label"].alias("label"))))
    return big(e.join(F.broadcast(packed)).withColumn("b", best).select("vec_id", F.col("b.label").alias("center"), F.col("b.d2").alias("d2")), "d2")


OVERRIDE = ("#ffffff", "#dc322f", "#268bd2", "#101010")


@on_raster
def palette_override_assign(px: DataFrame) -> DataFrame:
    """Pixels to the nearest colour of a given palette (CIELAB); colours nobody uses go, the order stays."""
    spark = px.sparkSession
    table = spark.createDataFrame([(k, h) for k, h in enumerate(OVERRIDE)], "id int, hex string")
    r, g, b = color.from_hex(F.col("hex"))
    centers = [(c.id, [c.l, c.la, c.lb]) for c in palette.lab_columns(table.withColumns({"r": r, "g": g, "b": b})).select("id", "l", "la", "lb").collect()]  # a given palette: 64 rows at most
    best = palette.nearest([F.col(c) for c in ("l", "la", "lb")], centers)["id"]
    per_colour = palette.lab_columns(colours(px)).select("r", "g", "b", best.alias("center"))
    used = px.filter(color.opaque(F.col("a"))).join(per_colour, ["r", "g", "b"]).groupBy("image_id", "center").agg(F.count("*").alias("n"))
    idx = F.row_number().over(Window.partitionBy("image_id").orderBy("center")) - 1
    return big(used.withColumn("idx", idx))


@on_raster
def palette_table(px: DataFrame) -> DataFrame:
    return big(table_of(px))


@on_raster
def palette_remap(px: DataFrame) -> DataFrame:
    return big(palette.remap(px, table_of(px)).select("image_id", "y", "x", "idx"))


TRUTH = ("#ffffff", "#dc322f", "#000000", "#6c71c4")


def _truth_pairs(px: DataFrame) -> DataFrame:
    truth = px.sparkSession.createDataFrame([(h,) for h in TRUTH], "truth string")
    r, g, b = color.from_hex(F.col("truth"))
    t = color.with_lab(truth.withColumns({"r": r, "g": g, "b": b}), out=("ql", "qa", "qb")).drop("r", "g", "b")
    own = palette.lab_columns(table_of(px)).select("image_id", "idx", "hex", "l", "la", "lb")
    pairs = color.with_delta_e2000(own.join(F.broadcast(t)), ("ql", "qa", "qb"), ("l", "la", "lb"))  # four truth colours
    return pairs.withColumn("de", F.round("de", 6))


@on_raster
def gt_palette_match(px: DataFrame) -> DataFrame:
    best = _truth_pairs(px).groupBy("image_id", "truth").agg(F.min(F.struct("de", "idx")).alias("b"))
    return big(best.select("image_id", "truth", F.col("b.idx").alias("idx"), F.col("b.de").alias("de")), "de")


@on_raster
def gt_palette_unmatched_anti(px: DataFrame) -> DataFrame:
    """Truth colours without a palette colour under 3, and palette colours without a truth colour."""
    pairs = _truth_pairs(px)
    near = F.min("de") >= 3.0
    missing = pairs.groupBy("image_id", "truth").agg(near.alias("alone")).filter("alone").select("image_id", F.lit("missing").alias("kind"), F.col("truth").alias("hex"))
    extra = pairs.groupBy("image_id", "hex").agg(near.alias("alone")).filter("alone").select("image_id", F.lit("extra").alias("kind"), "hex")
    return big(missing.unionByName(extra))


def layers_of(px: DataFrame) -> DataFrame:
    """(image_id, label, lr, lg, lb, n): each label as a layer in its lower median colour, but for the last label of the palette."""
    t = table_of(px).filter("label <> 5")
    return t.select("image_id", "label", *[F.col(c).alias(f"l{c}") for c in "rgb"])


@on_raster
def uncovered_regions_anti(px: DataFrame) -> DataFrame:
    return big(quality.uncovered(px, layers_of(px)))


@query
def kmeans_fixed_iters(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    points = e.select(F.col("vec_id").alias("id"), *[F.col("embedding")[k].cast("double").alias(f"e{k}") for k in range(3)])
    out = palette.kmeans(points, ["e0", "e1", "e2"], 4, 3)
    return big(out.select("cluster", "n", *[F.round(c, 4).alias(c) for c in ("e0", "e1", "e2")]))


@on_raster
def blend_triples(px: DataFrame) -> DataFrame:
    """Of an image's distinct colours, those near a blend of two others."""
    c = palette.histogram(px).select("image_id", (F.col("rank") - 1).cast("int").alias("idx"), F.shiftright("code", 16).cast("int").alias("r"), F.shiftright("code", 8).bitwiseAND(255).cast("int").alias("g"), F.col("code").bitwiseAND(255).cast("int").alias("b"))
    return big(palette.blends(c), "t", "de")


@on_raster
def mixed_pixel_mask(px: DataFrame) -> DataFrame:
    return big(grid.mixed(px).filter("mixed").select("image_id", "y", "x"))


@on_raster
def erosion_survival(px: DataFrame) -> DataFrame:
    """Share of each label's pixels that survive a 3 x 3 erosion of the label: all nine are the same."""
    marked = grid.box(grid.box(px, F.col("label"), F.min, 1, "lo"), F.col("label"), F.max, 1, "hi")
    keeps = (F.col("lo") == F.col("label")) & (F.col("hi") == F.col("label"))
    return big(marked.groupBy("image_id", "label").agg(F.count("*").alias("n"), F.avg(keeps.cast("double")).alias("survival")), "survival")


@on_raster
def interior_gap_iou(px: DataFrame) -> DataFrame:
    return big(quality.gaps(quality.pair(px, raster.rendered(px))), "gap_ratio", "iou")


@on_raster
def neighbor_count_endpoints(px: DataFrame) -> DataFrame:
    noisy = color.code(*rgb()) != color.code(*raster.colour_of(F.col("label")))
    counted = grid.neighbor_count(px.withColumn("noisy", noisy), F.col("noisy"), "n").filter("noisy")
    return big(counted.select("image_id", "y", "x", "n", (F.col("n") == 1).alias("is_end")))


@on_raster
def seam_mask(px: DataFrame) -> DataFrame:
    return big(grid.seams(px).filter("seam").select("image_id", "y", "x"))


@on_raster
def noise_sigma(px: DataFrame) -> DataFrame:
    return big(grid.noise_sigma(px, color.luma(*rgb())), "sigma")


def comps(px: DataFrame) -> DataFrame:
    return regions.components(px)


@on_raster
def connected_components(px: DataFrame) -> DataFrame:
    return big(comps(px).select("image_id", "y", "x", "label", "comp"))


@on_raster
def component_stats(px: DataFrame) -> DataFrame:
    return big(regions.component_stats(comps(px)))


@on_raster
def component_stats_ink_extent(px: DataFrame) -> DataFrame:
    return big(regions.ink_extent(regions.component_stats(comps(px).filter("label <> 0")), W, H), "ink_extent")


@on_raster
def speckle_target_first(px: DataFrame) -> DataFrame:
    c = comps(px)
    return big(regions.speckle_targets(c, regions.component_stats(c), palette.lower_median(px, ["image_id", "label"]), 30))


@on_raster
def label_rectangles(px: DataFrame) -> DataFrame:
    return big(regions.rectangles(px))


@on_raster
def layer_plan_order(px: DataFrame) -> DataFrame:
    t = table_of(px).select("image_id", "label", "n", "is_background", (F.col("label") == 2).alias("is_line"))
    return big(regions.layer_plan(t))


@on_raster
def line_colors(px: DataFrame) -> DataFrame:
    noisy = color.code(*rgb()) != color.code(*raster.colour_of(F.col("label")))
    return big(regions.line_colors(px, noisy))


@on_raster
def rect_paths_nodecount(px: DataFrame) -> DataFrame:
    return big(regions.rect_layers(regions.rectangles(px), 10))


@on_raster
def path_token_parse(px: DataFrame) -> DataFrame:
    paths = regions.rect_layers(regions.rectangles(px), 10)
    d = F.col("d")
    return big(paths.select("image_id", "label", "path_no", F.size(text.tokens(d)).alias("n_tokens"), text.largest(d).alias("largest"), text.is_path(d).alias("is_path"), text.all_integer(d).alias("all_integer"), text.round_path(d, 1).alias("rounded")))


@on_raster
def scanline_fill(px: DataFrame) -> DataFrame:
    """Rectangles to paths, parsed and filled again: the labels of the raster."""
    return big(regions.scanline_fill(regions.rects_of_paths(regions.rect_layers(regions.rectangles(px), 10)), W))


@on_raster
def composite_layers(px: DataFrame) -> DataFrame:
    """Each label painted over its whole bounding box in plan order, the topmost layer of each pixel."""
    z = regions.layer_plan(table_of(px).select("image_id", "label", "n", "is_background", F.lit(False).alias("is_line")))
    boxes = px.groupBy("image_id", "label").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"))
    filled = regions.scanline_fill(boxes, W).join(z.select("image_id", "label", "z"), ["image_id", "label"])
    return big(regions.composite(filled))


@on_raster
def alpha_blend_layers(px: DataFrame) -> DataFrame:
    """Each label's row band at half opacity over the pixel's own colour."""
    own = px.select("image_id", "y", "x", F.lit(0).alias("z"), *[(c / 255.0).alias(n) for n, c in zip("rgb", rgb(), strict=True)], (F.col("a") / 255.0).alias("a"))
    band = px.select("image_id", "y", "x", F.lit(1).alias("z"), *[(c / 255.0).alias(n) for n, c in zip("rgb", raster.colour_of(F.col("y") % 6), strict=True)], F.lit(0.5).alias("a"))
    return big(regions.premultiplied_over(own.unionByName(band)), "r", "g", "b", "a")


@on_raster
def region_delta_e(px: DataFrame) -> DataFrame:
    return big(quality.region_delta_e(px, layers_of(px)), "delta_e")


def _reports(px: DataFrame) -> DataFrame:
    de = quality.region_delta_e(px, layers_of(px)).groupBy("image_id").agg(F.avg("delta_e").alias("mean_de"), F.max("delta_e").alias("max_de"))
    gap = quality.gaps(quality.pair(px, raster.rendered(px)))
    out = gap.join(de, "image_id", "left").select("image_id", F.round("gap_ratio", 6).alias("gap_ratio"), F.round("iou", 6).alias("iou"), F.round(F.coalesce("mean_de", F.lit(0.0)), 6).alias("mean_de"), F.round(F.coalesce("max_de", F.lit(0.0)), 6).alias("max_de"))
    return out.join(_ssim(px), "image_id").withColumns({"ssim": F.round("ssim", 6), "ssim_min": F.lit(quality.SSIM_MIN["flat_color"]), "time_s": (F.col("image_id") % 5).cast("double"), "budget_s": text.time_budget(F.lit(W), F.lit(H)), "svg_ok": F.col("image_id") % 3 != 0})


@on_raster
def quality_checks(px: DataFrame) -> DataFrame:
    return big(quality.checks(_reports(px)), "value", "threshold")


@on_raster
def failed_checks(px: DataFrame) -> DataFrame:
    return big(quality.verdicts(quality.checks(_reports(px))).withColumn("failed", F.array_join("failed", ",")))


@on_raster
def corruption_flip(px: DataFrame) -> DataFrame:
    """Checks that fail only once the largest layer is dropped."""
    n = px.filter("a >= 128").groupBy("image_id", "label").count()
    largest = n.groupBy("image_id").agg(F.max_by("label", F.struct("count", -F.col("label"))).alias("gone"))
    clean = px.select("image_id", "y", "x", "label", "r", "g", "b", "a")
    broken = clean.join(largest, "image_id").withColumn("a", F.when(F.col("label") == F.col("gone"), 0).otherwise(F.col("a"))).drop("gone")

    def failing(preview: DataFrame) -> DataFrame:
        g = quality.gaps(quality.pair(px, preview))
        none = F.lit(None).cast("double")
        r = g.select("image_id", "gap_ratio", "iou", *[none.alias(c) for c in ("ssim", "ssim_min", "mean_de", "max_de", "time_s", "budget_s")], F.lit(None).cast("boolean").alias("svg_ok"))
        return quality.verdicts(quality.checks(r))

    a, b = failing(clean).select("image_id", F.col("failed").alias("before")), failing(broken).select("image_id", F.col("failed").alias("after"))
    return big(a.join(b, "image_id").select("image_id", F.array_join(F.array_except("after", "before"), ",").alias("flipped")))


@on_raster
def palette_constraint_violations(px: DataFrame) -> DataFrame:
    """A sound palette has none; here one count is wrong and one label unknown in each third image."""
    t = table_of(px)
    worse = t.filter("NOT (image_id % 3 = 0 AND idx = 1)").withColumn("n", F.when((F.col("image_id") % 3 == 1) & (F.col("idx") == 0), F.col("n") + 1).otherwise(F.col("n")))
    return big(quality.palette_problems(palette.remap(px.filter("a >= 128"), t), worse))


@on_raster
def class_scores(px: DataFrame) -> DataFrame:
    """Features that the raster gives by counting; the others are fixed fractions of them."""
    bins = palette.coarse_bins(px)
    ink = px.groupBy("image_id").agg(F.avg(((F.col("label") != 0) & (F.col("a") >= 128)).cast("double")).alias("ink"), F.avg((F.col("label") == 2).cast("double")).alias("dark"))
    f = ink.join(bins, "image_id").select(
        "image_id", (F.col("ink") * 0.35).alias("gradient_area"), F.col("colors_95").cast("double").alias("colors_95"), (1 - F.col("dark")).alias("thin_ink_ratio"), (F.col("dark") * 1.2).alias("edge_per_ink"),
        (F.col("dark") * 0.2).alias("fill_ratio"), (F.col("ink") * 0.4).alias("ink_extent"), (F.col("ink") * 0.4).alias("ink_ratio"), (F.col("dark") * 0.06).alias("outline_fraction"), (F.col("ink") * 0.5).alias("outline_ratio"),
    )
    return big(quality.class_scores(f), "p_mixed", "p_line_art", "p_flat_color", "confidence")


def _ssim(px: DataFrame) -> DataFrame:
    gray = lambda d, n: d.select("image_id", "y", "x", color.gray_over_white(*rgb(), F.col("a")).alias(n))
    return grid.ssim(gray(px, "p").join(gray(raster.rendered(px), "q"), ["image_id", "y", "x"]), W, H)


@on_raster
def ssim_window(px: DataFrame) -> DataFrame:
    return big(_ssim(px), "ssim")


@on_raster
def area_resize(px: DataFrame) -> DataFrame:
    return big(grid.resize_area(px, 5), "r", "g", "b", "a")


@on_raster
def nearest_resize(px: DataFrame) -> DataFrame:
    return big(grid.resize_nearest(px.select("image_id", "y", "x", "label"), H, W, 32, 40))


@on_raster
def morphological_opening(px: DataFrame) -> DataFrame:
    out = grid.opened(px, F.col("label") >= 3, 2)
    return big(out.filter("opened").select("image_id", "y", "x"))


def _layers(px: DataFrame) -> DataFrame:
    t = table_of(px)
    plan = regions.layer_plan(t.select("image_id", "label", "n", "is_background", F.lit(False).alias("is_line")))
    paths = regions.rect_layers(regions.rectangles(px.filter("a >= 128")), 1 << 30)
    named = t.join(plan.select("image_id", "label", "z"), ["image_id", "label"]).join(paths.select("image_id", "label", "d"), ["image_id", "label"])
    return named.select("image_id", "z", F.col("name").alias("id"), "d", F.col("hex").alias("color_hex"), F.lit(False).alias("is_stroke"), F.lit(1.0).alias("stroke_width"), F.lit("evenodd").alias("fill_rule"), F.lit(1.0).alias("opacity"))


@on_raster
def svg_documents(px: DataFrame) -> DataFrame:
    s = documents.svg(_layers(px), W, H)
    return big(s.select("image_id", F.length("svg").alias("size"), F.md5("svg").alias("digest")))


@on_raster
def svg_structure_check(px: DataFrame) -> DataFrame:
    """Problems of documents of which two thirds were tampered with."""
    layers = _layers(px)
    ids = layers.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("z", "id"))), lambda x: x["id"]).alias("ids"))
    s = documents.svg(layers, W, H).join(ids, "image_id")
    k = F.col("image_id") % 3
    bad = F.when(k == 0, F.replace(F.col("svg"), F.lit("<path "), F.lit("<image href=\"x\" "))).when(k == 1, F.concat(F.replace(F.col("svg"), F.lit('viewBox="0 0'), F.lit('viewBox="1 1')), F.lit("<!--"))).otherwise(F.col("svg"))
    return big(documents.svg_problems(s.withColumn("svg", bad), W, H))


@on_raster
def eps_structure_check(px: DataFrame) -> DataFrame:
    e = documents.eps(_layers(px), W, H)
    k = F.col("image_id") % 4
    bad = F.when(k == 0, F.replace(F.col("eps"), F.lit("grestore"), F.lit("image"))).when(k == 1, F.replace(F.col("eps"), F.lit("BoundingBox: 0 0 25"), F.lit("BoundingBox: 0 0 26"))).otherwise(F.col("eps"))
    return big(documents.eps_checks(e.withColumn("eps", bad), W, H))


@on_raster
def pdf_documents(px: DataFrame) -> DataFrame:
    """Names of the layers that the PDF holds."""
    p = documents.pdf(_layers(px), W, H)
    return big(p.select("image_id", F.array_join(documents.layer_names_of_pdf(F.col("pdf")), ",").alias("layers")))


@query
def forbidden_markup(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with elements or attributes that a vector document must not have."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    h = F.col("html")
    return big(pages.select("page_id", h.rlike(r"(?i)<(?:script|style|iframe|object|embed)\b").alias("element"), h.rlike(documents.FORBIDDEN_ATTRIBUTE).alias("attribute"), F.size(F.regexp_extract_all(h, F.lit(r'href="([^"]*)"'), F.lit(1))).alias("n_links")))


@query
def settings_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Settings made from events (`props` has an unknown field): defaults, canonical formats, and the first errors."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    colors = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(', "max_colors": '), (F.col("event_id") % 80).cast("string"))).otherwise("")
    formats = F.when(F.col("event_id") % 3 == 0, ', "output_formats": ["eps", "svg", "eps"]').when(F.col("event_id") % 3 == 1, ', "output_formats": ["ai"]').otherwise("")
    raw = F.when(F.col("event_id") % 7 == 0, F.col("props")).otherwise(F.concat(F.lit('{"smoothing": '), (F.col("user_id") % 130).cast("string"), colors, formats, F.lit(', "palette_override": ["#AABBCC", "#aabbcc", "#000000"]}')))
    settings, errors = jobs.parse_settings(F.col("raw"))
    s = e.select("event_id", raw.alias("raw")).select("event_id", settings.alias("s"), errors.alias("errors"))
    return big(s.select("event_id", "s.mode", F.coalesce("s.max_colors", F.lit(0)).alias("max_colors"), "s.detail_level", "s.smoothing", F.coalesce(F.array_join("s.palette_override", ","), F.lit("")).alias("palette"), F.array_join("s.output_formats", ",").alias("formats"), F.array_join("errors", ";").alias("errors")))


def job_log(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a job log: a user's events are a job's updates."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    t = F.col("event_type")
    status = F.when(t == "signup", "queued").when(t == "purchase", "succeeded").when(t == "error", "failed").otherwise("running")
    stage = F.element_at(F.array(*[F.lit(s) for s in ("load", "preprocess", "classify", "quantize", "vectorize", "export")]), (F.col("event_id") % 6 + 1).cast("int"))
    return e.select(F.col("user_id").alias("job_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), status.alias("status"), stage.alias("stage"), (F.col("event_id") % 101).alias("progress"))


def _epoch(df: DataFrame, *names: str) -> DataFrame:
    return big(df.select(*[F.unix_micros(c).alias(c) if c in names else F.col(c) for c in df.columns]))


@query
def job_latest_state(spark: SparkSession, sf: str) -> DataFrame:
    return _epoch(jobs.latest(job_log(spark, sf)), "created", "updated")


@query
def job_ttl_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs that have expired an hour before the log's end."""
    log = job_log(spark, sf)
    end = log.agg((F.max("ts") - F.expr("INTERVAL 1 HOUR")).alias("now"))
    return _epoch(jobs.sweep(jobs.latest(log).join(F.broadcast(end)), F.col("now"), 600).select("job_id", "status", "updated", "expires"), "updated", "expires")


@query
def job_fail_unfinished(spark: SparkSession, sf: str) -> DataFrame:
    return big(jobs.fail_unfinished(jobs.latest(job_log(spark, sf)), "restarted").select("job_id", "status", "error"))


@query
def job_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """The log's first half, then its second, merged by job."""
    log = job_log(spark, sf)
    keep = ("job_id", "status", "stage", "updated")
    old, new = (jobs.latest(log.filter(c)).select(*keep) for c in ("event_id % 2 = 0", "event_id % 2 = 1"))
    return _epoch(jobs.upsert(old, new), "updated")


@query
def stage_status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return big(jobs.status_counts(job_log(spark, sf)))


@query
def bench_median(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    out = e.groupBy("user_id", "event_type").agg(F.expr("percentile(value, 0.5)").alias("median"), F.count("*").alias("runs"))
    return big(out, "median")


@query
def stage_time_top2(spark: SparkSession, sf: str) -> DataFrame:
    """The two slowest stages of each job by summed value."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    log = job_log(spark, sf).select("event_id", "job_id", "stage").join(e.select("event_id", "value"), "event_id")
    total = log.groupBy("job_id", "stage").agg(F.round(F.sum(F.col("value").cast("decimal(18,6)")), 6).cast("double").alias("seconds"))
    k = F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("seconds"), "stage"))
    return big(total.withColumn("rank", k).filter("rank <= 2"), "seconds")


@on_raster
def layer_nearest_palette(px: DataFrame) -> DataFrame:
    """Layers with an explicit index, an exact colour, or a shifted one, to palette indexes."""
    t = table_of(px)
    shifted = color.hex_of(F.col("r"), F.least(F.col("g") + 3, F.lit(255)), F.col("b"))
    layers = t.select("image_id", F.col("idx").alias("layer"), F.when(F.col("idx") % 3 == 0, F.col("hex")).otherwise(shifted).alias("color_hex"), F.when(F.col("idx") % 3 == 1, F.lit(0)).alias("palette_index"))
    return big(palette.layer_palette_index(layers, t))


@on_raster
def bezier_flatten(px: DataFrame) -> DataFrame:
    """A cubic over each label's bounding box, at nine parameters."""
    b = px.groupBy("image_id", "label").agg(*[f(c).cast("double").alias(n) for n, f, c in (("x0", F.min, "x"), ("x1", F.max, "x"), ("y0", F.min, "y"), ("y1", F.max, "y"))])
    u = F.explode(F.sequence(F.lit(0), F.lit(8))).alias("k")
    at = b.select("*", u).withColumn("u", F.col("k") / 8.0)
    bx = text.bezier((F.col("x0"), F.col("x0"), F.col("x1"), F.col("x1")), F.col("u"))
    by = text.bezier((F.col("y0"), F.col("y1"), F.col("y0"), F.col("y1")), F.col("u"))
    return big(at.select("image_id", "label", "k", bx.alias("bx"), by.alias("by")), "bx", "by")


@on_raster
def arc_length(px: DataFrame) -> DataFrame:
    """Running length along each label's pixels in raster order, over its whole."""
    w = Window.partitionBy("image_id", "label").orderBy("y", "x")
    step = F.coalesce(F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), F.lit(2.0)) + F.pow(F.col("y") - F.lag("y").over(w), F.lit(2.0))), F.lit(0.0))
    s = px.withColumn("_s", step).withColumn("s", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    total = F.max("s").over(Window.partitionBy("image_id", "label"))
    return big(s.select("image_id", "label", "y", "x", F.when(total > 0, F.col("s") / total).otherwise(0.0).alias("t")), "t")


@query
def number_format(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    v = (F.col("event_id") % 4001 - 2000) / 16.0
    return big(e.select("event_id", text.number(v).alias("number"), text.size_text(F.col("event_id") * 977).alias("size"), text.stroke_width((F.col("event_id") % 97) / 7.0, F.lit(2.0)).alias("stroke"), text.target_scale(F.col("event_id") % 3000 + 1, F.col("user_id") * 20 + 1).alias("scale")), "stroke", "scale")


@on_raster
def fill_transparent(px: DataFrame) -> DataFrame:
    return big(convert.fill_transparent(px))


@on_raster
def distance_transform(px: DataFrame) -> DataFrame:
    return big(convert.distances(px, F.col("label") >= 3), "d")


@on_raster
def background_removed(px: DataFrame) -> DataFrame:
    return big(convert.remove_background(px, palette.detect_background(px, on_border(px))))


@on_raster
def denoised(px: DataFrame) -> DataFrame:
    return big(convert.denoise(px))


@on_raster
def quantize_auto(px: DataFrame) -> DataFrame:
    return big(convert.quantize(px))


@on_raster
def skeleton_widths(px: DataFrame) -> DataFrame:
    return big(convert.skeleton(px, F.col("label") >= 3), "width")


@on_raster
def centerline_paths(px: DataFrame) -> DataFrame:
    return big(convert.centerlines(px, F.col("label") >= 3), "width")


@on_raster
def traced_layers(px: DataFrame) -> DataFrame:
    return big(convert.trace(px))


@on_raster
def converted_documents(px: DataFrame) -> DataFrame:
    return big(convert.convert(px, W, H).select("image_id", "n_layers", "n_nodes", F.length("svg").alias("svg_size"), F.length("eps").alias("eps_size")))


@on_raster
def otsu_threshold(px: DataFrame) -> DataFrame:
    return big(ink.otsu(px.select("image_id", color.luma(*rgb()).cast("int").alias("v"))))


@on_raster
def line_art_stroke_mask(px: DataFrame) -> DataFrame:
    return big(ink.line_art_mask(px).filter("ink").select("image_id", "y", "x"))


@on_raster
def ink_color(px: DataFrame) -> DataFrame:
    return big(ink.ink_color(px))


@on_raster
def mixed_stroke_mask(px: DataFrame) -> DataFrame:
    return big(ink.mixed_mask(px).filter("ink").select("image_id", "y", "x"))


@on_raster
def gradient_ramps(px: DataFrame) -> DataFrame:
    return big(ink.ramp_share(px, 5), "ramp")


@on_raster
def final_colors(px: DataFrame) -> DataFrame:
    return big(ink.pure_colors(px))


@on_raster
def shift_colors(px: DataFrame) -> DataFrame:
    return big(ink.shift_lightness(table_of(px)).select("image_id", "idx", "hex", "shifted"))


@on_raster
def drop_largest_layer(px: DataFrame) -> DataFrame:
    return big(ink.drop_largest(regions.rect_layers(regions.rectangles(px), 10), background(px)).select("image_id", "label", "path_no"))


@query
def ground_truth_widths(spark: SparkSession, sf: str) -> DataFrame:
    """Stated or listed stroke widths from events, and whether a measured one fits."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    listed = F.when(F.col("event_id") % 4 != 0, F.create_map(F.lit("a"), (F.col("event_id") % 7).cast("double"), F.lit("b"), (F.col("event_id") % 11).cast("double"), F.lit("c"), (F.col("event_id") % 5).cast("double"))).otherwise(F.create_map().cast("map<string,double>"))
    want = ink.expected_width(F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 9), listed)
    w = e.select("event_id", want.alias("want"), (F.col("event_id") % 10).cast("double").alias("got"))
    return big(w.select("event_id", F.coalesce("want", F.lit(-1.0)).alias("want"), F.coalesce(ink.width_matches(F.col("got"), F.col("want")), F.lit(False)).alias("fits")), "want")


@query
def upload_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Files by their first bytes alone: format, media type, and the error that an upload gets."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    k = F.col("doc_id") % 4
    content = F.when(k == 0, F.concat(F.unhex(F.lit(raster.PNG_MAGIC)), F.encode("text", "UTF-8"))).when(k == 1, F.concat(F.unhex(F.lit(raster.JPEG_MAGIC)), F.encode("text", "UTF-8"))).otherwise(F.encode("text", "UTF-8"))
    c = d.select("doc_id", content.alias("content"), (F.col("n_chars").cast("long") * 10_000).alias("pixels"))
    kind = raster.sniff_format(F.col("content"))
    error = F.when(kind.isNull(), "unsupported_media_type").when(F.col("pixels") > raster.MAX_PIXELS, "too_many_pixels")
    return big(c.select("doc_id", F.coalesce(kind, F.lit("none")).alias("format"), F.coalesce(raster.media_type(F.col("content")), F.lit("none")).alias("media_type"), F.coalesce(error, F.lit("ok")).alias("error")))


@query
def upload_names(spark: SparkSession, sf: str) -> DataFrame:
    """Safe names of pages' addresses, and what their files would be downloaded and linked as."""
    p = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", text.safe_filename(F.col("url")).alias("name"))
    return big(p.select("page_id", "name", text.download_name(F.col("name"), F.lit("svg")).alias("svg"), text.download_name(F.col("name"), F.lit("preview")).alias("preview"), text.file_url(F.col("page_id").cast("string"), F.lit("eps")).alias("link")))


@query
def typed_colours(spark: SparkSession, sf: str) -> DataFrame:
    """Colours as people type them, as #rrggbb or null, with the luminance that chooses readable text over them."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    n = F.pmod(F.col("event_id") * 7919, F.lit(1 << 24))
    long, short = F.lpad(F.upper(F.hex(n)), 6, "0"), F.lpad(F.hex(F.pmod(n, F.lit(4096))), 3, "0")
    typed = F.element_at(F.array(F.concat(F.lit("#"), long), short, F.concat(F.lit(" #"), F.lower(short), F.lit(" ")), F.concat(long, F.lit("z")), F.substring(long, 1, 4)), (F.col("event_id") % 5 + 1).cast("int"))
    out = e.select("event_id", typed.alias("typed")).withColumn("hex", text.typed_hex(F.col("typed")))
    return big(out.withColumn("luminance", color.luminance(F.col("hex"))), "luminance")


@query
def poll_schedule(spark: SparkSession, sf: str) -> DataFrame:
    """The delay after each update of a job, and whether there is a next one."""
    log = job_log(spark, sf)
    k = F.row_number().over(Window.partitionBy("job_id").orderBy("ts", "event_id"))
    out = log.withColumn("k", k).select("event_id", "job_id", "k", jobs.is_final(F.col("status")).alias("final"), jobs.poll_delay(F.col("k")).alias("delay_ms"))
    return big(out)


@query
def metric_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics as reports print them, each with its own number of decimals."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    names = ("ssim", "alpha_iou", "mean_delta_e", "max_delta_e", "gap_ratio", "processing_time_s", "svg_valid")
    name = F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("event_id") % 7 + 1).cast("int"))
    value = (F.col("event_id") % 4096) / F.lit(1024.0) + F.lit(2.0**-20)
    return e.select("event_id", name.alias("name"), value.alias("v")).select("event_id", "name", text.metric_label(F.col("name"), F.col("v")).alias("label"))


@query
def media_types(spark: SparkSession, sf: str) -> DataFrame:
    """The type of an uploaded file: what the browser says, else by its extension; and whether it is accepted."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    ends = (".PNG", ".jpg", ".tar.jpeg", "", ".gif", ".")
    name = F.concat(F.lit("scan"), F.col("user_id").cast("string"), F.element_at(F.array(*[F.lit(x) for x in ends]), (F.col("event_id") % 6 + 1).cast("int")))
    said = F.when(F.col("event_id") % 5 == 0, "image/png").when(F.col("event_id") % 5 == 1, "").otherwise(F.lit(None))
    kind = text.media_type(F.col("name"), F.col("said"))
    return e.select("event_id", name.alias("name"), said.alias("said")).select("event_id", "name", kind.alias("media_type"), text.accepted(kind).alias("accepted"))


@on_raster
def layer_constraint_violations(px: DataFrame) -> DataFrame:
    """Layers whose colour text isn't their colour, that have a stroke width without a stroke or the reverse, or that cover the whole canvas."""
    t = table_of(px).select("image_id", "idx", "r", "g", "b", "hex", "n")
    odd = F.col("idx") % 3
    rows = t.select(
        "image_id", "idx", "n", *rgb(), F.when(odd == 1, F.upper("hex")).otherwise(F.col("hex")).alias("hex"), (odd == 2).alias("is_stroke"), F.when(F.col("idx") % 2 == 0, F.lit(1.5)).alias("stroke_width")
    )
    bad_hex, bad_stroke = F.col("hex") != color.hex_of(*rgb()), F.col("is_stroke") != F.col("stroke_width").isNotNull()
    return big(rows.select("image_id", "idx", bad_hex.alias("bad_hex"), bad_stroke.alias("bad_stroke"), (F.col("n") == H * W).alias("whole_canvas")).filter("bad_hex OR bad_stroke OR whole_canvas"))


def _curved_layers(px: DataFrame, stroke: bool = False) -> DataFrame:
    """A path over each label's bounding box, with repeated operands, curves, a subpath closed and gone on from, and open ones; label is z."""
    box = px.groupBy("image_id", "label").agg(*[f.cast("string").alias(n) for n, f in (("x0", F.min("x")), ("y0", F.min("y")), ("x1", F.max("x") + 1), ("y1", F.max("y") + 1))])
    d = F.format_string(
        "M %1$s %2$s L %3$s %2$s %3$s %4$s C %3$s %2$s %1$s %4$s %1$s %2$s.5 Z C %1$s %4$s %3$s %4$s %3$s %2$s M%1$s.25 %2$sL%3$s %4$s %1$s %4$s", F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")
    )
    even, see_through = F.col("label") % 2 == 0, F.col("label") % 3 == 0
    style = {"color_hex": color.hex_of(*raster.colour_of(F.col("label"))), "is_stroke": F.lit(stroke), "stroke_width": F.lit(1.3) + F.col("label") / 7.0, "fill_rule": F.when(even, "evenodd").otherwise("nonzero"), "opacity": F.when(see_through, 0.5).otherwise(1.0)}
    return box.select("image_id", F.col("label").alias("z"), "label", F.lit(0).alias("path_no"), d.alias("d")).withColumns({**style, "width": F.lit(W), "height": F.lit(H)})


@on_raster
def path_edges(px: DataFrame) -> DataFrame:
    e = render.edges(render.with_samples(_curved_layers(px)))
    return big(e.select("image_id", "z", "x0", "y0", "x1", "y1", "implied"), "x0", "y0", "x1", "y1")


@on_raster
def curved_fill_coverage(px: DataFrame) -> DataFrame:
    """Even-odd fills of even labels and nonzero ones of odd labels, nine samples a pixel."""
    return big(render.coverage(render.with_samples(_curved_layers(px))).select("image_id", "z", "y", "x", "cover"), "cover")


@on_raster
def stroke_coverage(px: DataFrame) -> DataFrame:
    return big(render.coverage(render.with_samples(_curved_layers(px, True))).select("image_id", "z", "y", "x", "cover"), "cover")


@on_raster
def rendered_layers(px: DataFrame) -> DataFrame:
    """Curved layers, some of them see-through, painted over one another from the lowest label up."""
    return big(render.paint(render.coverage(render.with_samples(_curved_layers(px)))), "r", "g", "b", "a")


@on_raster
def rendered_rectangles(px: DataFrame) -> DataFrame:
    """Exact documents of whole numbers give the raster's clean colours again."""
    paths = regions.rect_layers(regions.rectangles(px), 10).select("image_id", F.col("label").alias("z"), "path_no", "d", color.hex_of(*raster.colour_of(F.col("label"))).alias("color_hex"))
    return big(render.render(paths.withColumns({"is_stroke": F.lit(False), "stroke_width": F.lit(1.0), "fill_rule": F.lit("evenodd"), "opacity": F.lit(1.0), "width": F.lit(W), "height": F.lit(H)})))


@on_raster
def converted_quality(px: DataFrame) -> DataFrame:
    """Traced documents, rendered and measured against their sources."""
    return big(convert.evaluate(px, W, H, quality.SSIM_MIN["flat_color"]), "value", "threshold")


@on_raster
def results_table(px: DataFrame) -> DataFrame:
    r = _reports(px)
    return big(reports.results(r, quality.checks(r)))


@on_raster
def results_markdown(px: DataFrame) -> DataFrame:
    """A table of the palette of each image."""
    return big(reports.lines(table_of(px), F.col("image_id"), F.col("idx"), ["idx", "name", "hex", "n"]).withColumnRenamed("group", "image_id"))


@on_raster
def difference_images(px: DataFrame) -> DataFrame:
    return big(reports.difference(quality.pair(px, raster.rendered(px))))


@query
def job_deletions(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs named for deletion (each tenth event's user, and users that don't exist), whether they existed, and how many updates stay in all."""
    log = job_log(spark, sf)
    ids = log.select(F.when(F.col("event_id") % 10 == 0, F.col("job_id")).when(F.col("event_id") % 10 == 1, -F.col("job_id") - 1).alias("job_id"))
    left, gone = jobs.delete(log, ids)
    return big(gone.join(F.broadcast(left.agg(F.count("*").alias("updates_left")))))


@query
def job_cancellations(spark: SparkSession, sf: str) -> DataFrame:
    return big(jobs.cancel_queued(jobs.latest(job_log(spark, sf))).select("job_id", "status", "cancelled"))


@query
def new_jobs(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    return _epoch(e.select(jobs.new_row(F.col("event_id"), F.col("ts").cast("timestamp")).alias("j")).select("j.*"), "created", "expires")


@query
def environment_settings(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    names = (*jobs.ENVIRONMENT, "MAX_PLAYERS")
    name = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("event_id") % len(names) + 1).cast("int"))
    raw = F.element_at(F.array(F.col("user_id").cast("string"), F.lit(" "), F.lit("2.5"), F.concat(F.lit(" -"), F.col("user_id").cast("string")), F.lit(None).cast("string"), F.lit("0")), (F.col("event_id") % 6 + 1).cast("int"))
    value, error = jobs.environment_number(F.col("name"), F.col("raw"))
    return big(e.select("event_id", name.alias("name"), raw.alias("raw")).select("event_id", "name", value.alias("value"), F.coalesce(error, F.lit("")).alias("error")))
