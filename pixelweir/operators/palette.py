"""Histograms, palettes and nearest colours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelweir.functions import color, text


def lab_columns(df: DataFrame) -> DataFrame:
    """Adds l, la, lb to r, g, b."""
    return color.with_lab(df)


def histogram(px: DataFrame) -> DataFrame:
    """(image_id, code, n, share, rank): distinct opaque colours by falling count."""
    n = px.filter(color.opaque(F.col("a"))).groupBy("image_id", color.code(F.col("r"), F.col("g"), F.col("b")).cast("long").alias("code")).agg(F.count("*").alias("n"))
    image = Window.partitionBy("image_id")
    return n.withColumn("share", F.col("n") / F.sum("n").over(image)).withColumn("rank", F.row_number().over(image.orderBy(F.desc("n"), "code")).cast("long"))


def coarse_bins(px: DataFrame) -> DataFrame:
    """(image_id, n_colors, colors_95): coarse bins with 0.2 % of the pixels or more, and bins that make 95 % of them.

    Bins are computed for distinct colours and weighted, not for each pixel.
    """
    colours = px.filter(color.opaque(F.col("a"))).groupBy("image_id", "r", "g", "b").agg(F.count("*").alias("n"))
    binned = lab_columns(colours).groupBy("image_id", color.lab_bin(F.col("l"), F.col("la"), F.col("lb")).alias("bin")).agg(F.sum("n").alias("n"))
    image = Window.partitionBy("image_id")
    order = image.orderBy(F.desc("n"), "bin").rowsBetween(Window.unboundedPreceding, 0)
    ranked = binned.withColumn("total", F.sum("n").over(image)).withColumn("upto", F.sum("n").over(order))
    return ranked.groupBy("image_id").agg(
        F.sum((F.col("n") * 500 >= F.col("total")).cast("long")).alias("n_colors"),
        F.least(F.sum((F.col("upto") * 20 < F.col("total") * 19).cast("long")) + 1, F.count("*")).alias("colors_95"),
    )


def lab_grid(points: DataFrame, step: float = 1.0) -> DataFrame:
    """(image_id, kl, ka, kb, w, l, la, lb): weighted centroids of a grid over LAB points (l, la, lb, w). Cells round halves to even."""
    keys = [F.rint(F.col(c) / step).cast("long").alias(k) for c, k in (("l", "kl"), ("la", "ka"), ("lb", "kb"))]
    return points.groupBy("image_id", *keys).agg(F.sum("w").alias("w"), *[(F.sum(F.col(c) * F.col("w")) / F.sum("w")).alias(c) for c in ("l", "la", "lb")])


def fit_points(points: DataFrame, most: int = 20_000, step: float = 1.0) -> DataFrame:
    """lab_grid with the step doubled until no image has more than `most` cells."""
    while True:
        out = lab_grid(points, step)
        top = out.groupBy("image_id").count().agg(F.max("count")).first()[0]
        if top is None or top <= most:
            return out
        step *= 2


def lower_median(px: DataFrame, by: list[str], columns: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """The first value whose cumulative count reaches half, of each column."""
    kinds = dict(px.dtypes)
    return px.groupBy(*by).agg(*[F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c})").cast(kinds[c]).alias(c) for c in columns])


def mean_median(px: DataFrame, by: list[str], columns: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """The mean of the middle two."""
    return px.groupBy(*by).agg(*[F.expr(f"percentile({c}, 0.5)").alias(c) for c in columns])


def stride_sample(px: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """At most about `most` evenly strided rows of each group: every ceil(n / most)-th."""
    w = Window.partitionBy(*by)
    ranked = px.withColumn("_n", F.count("*").over(w)).withColumn("_k", F.row_number().over(w.orderBy(*order)) - 1)
    return ranked.filter(F.col("_k") % F.ceil(F.col("_n") / most) == 0).drop("_n", "_k")


def border_background(px: DataFrame, on_border: Column, opaque_only: bool) -> DataFrame:
    """(image_id, label, n, total): the label of at least half of the border, the least of equals.

    Transparent border pixels count against it, or with opaque_only don't count; corners then count twice.
    """
    edge = px.filter(on_border).withColumn("_w", F.lit(1))
    if opaque_only:
        edge = edge.filter(color.opaque(F.col("a"))).withColumn("_w", F.col("_corner"))
    total = edge.groupBy("image_id").agg(F.sum("_w").cast("long").alias("total"))
    seen = edge.filter(color.opaque(F.col("a"))).groupBy("image_id", "label").agg(F.sum("_w").cast("long").alias("n"))
    best = seen.groupBy("image_id").agg(F.max_by(F.struct("label", "n"), F.struct("n", -F.col("label"))).alias("b")).select("image_id", "b.*")
    return best.join(total, "image_id").filter(F.col("n") * 2 >= F.col("total"))


def dominant_color(px: DataFrame) -> DataFrame:
    """(image_id, r, g, b): medians, cut to integers, over the most common bin of five bits a channel (the least of equals)."""
    binned = px.filter(color.opaque(F.col("a"))).withColumn("bin", color.code5(F.col("r"), F.col("g"), F.col("b")).cast("long"))
    best = binned.groupBy("image_id", "bin").count().groupBy("image_id").agg(F.max_by("bin", F.struct("count", -F.col("bin"))).alias("bin"))
    medians = mean_median(binned.join(best, ["image_id", "bin"]), ["image_id"])
    return medians.select("image_id", *[F.col(c).cast("int").alias(c) for c in "rgb"])


def detect_background(px: DataFrame, on_border: Column, tolerance: float = 10.0) -> DataFrame:
    """(image_id, l, la, lb, share, found): median LAB of the border's most common coarse bin, and the share of the opaque border within tolerance. Mostly transparent borders have none."""
    edge = px.filter(on_border)
    clear = edge.groupBy("image_id").agg(F.avg((F.col("a") < 128).cast("double")).alias("clear"))
    seeds = lab_columns(edge.filter("a >= 128")).join(clear.filter("clear <= 0.5"), "image_id")
    keys = [F.floor(F.col(c) / 4.0).cast("long").alias(k) for c, k in (("l", "kl"), ("la", "ka"), ("lb", "kb"))]
    keyed = seeds.select("*", *keys)
    best = keyed.groupBy("image_id", "kl", "ka", "kb").count().groupBy("image_id").agg(F.max_by(F.struct("kl", "ka", "kb"), F.struct("count", -F.col("kl"), -F.col("ka"), -F.col("kb"))).alias("k")).select("image_id", "k.*")
    middle = mean_median(keyed.join(best, ["image_id", "kl", "ka", "kb"]), ["image_id"], ("l", "la", "lb")).select("image_id", *[F.col(c).alias(f"m_{c}") for c in ("l", "la", "lb")])
    near = color.delta_e76(tuple(F.col(c) for c in ("l", "la", "lb")), tuple(F.col(f"m_{c}") for c in ("l", "la", "lb"))) < tolerance
    out = seeds.join(middle, "image_id").groupBy("image_id", "m_l", "m_la", "m_lb").agg(F.avg(near.cast("double")).alias("share"))
    return out.select("image_id", F.col("m_l").alias("l"), F.col("m_la").alias("la"), F.col("m_lb").alias("lb"), "share", (F.col("share") >= 0.5).alias("found"))


def nearest(point: list[Column], centers: list[tuple[int, list[float]]]) -> Column:
    """struct<d2, id> of the nearest of a fixed list of centres, the first of equals: literals, so it is no join."""
    return F.array_min(F.array(*[F.struct(sum(((p - F.lit(float(v))) * (p - F.lit(float(v))) for p, v in zip(point, c, strict=True)), F.lit(0.0)).alias("d2"), F.lit(k).alias("id")) for k, c in centers]))


def nearest_join(points: DataFrame, centers: DataFrame, columns: list[str], key: str, center_id: str) -> DataFrame:
    """(key, center_id, d2) for each point. The centres (a palette: 64 rows at most) are gathered in one row; beyond that use blocks."""
    packed = centers.agg(F.array_sort(F.collect_list(F.struct(F.col(center_id).alias("id"), *[F.col(c).cast("double").alias(c) for c in columns]))).alias("_centers"))
    d2 = lambda c: sum(((F.col(k).cast("double") - c[k]) * (F.col(k).cast("double") - c[k]) for k in columns), F.lit(0.0))
    joined = points.join(F.broadcast(packed))
    best = F.array_min(F.transform("_centers", lambda c: F.struct(d2(c).alias("d2"), c["id"].alias("id"))))
    return joined.withColumn("_best", best).select(key, F.col("_best.id").alias(center_id), F.col("_best.d2").alias("d2"))


def palette(px: DataFrame, background: DataFrame) -> DataFrame:
    """(image_id, idx, label, r, g, b, hex, n, is_background, name): labels by falling count, in their lower median colours."""
    seen = px.filter(color.opaque(F.col("a")))
    table = lower_median(seen, ["image_id", "label"]).join(seen.groupBy("image_id", "label").agg(F.count("*").alias("n")), ["image_id", "label"])
    idx = (F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("n"), "label")) - 1).cast("int")
    marked = table.withColumn("idx", idx).join(background.select("image_id", F.col("label").alias("bg")), "image_id", "left")
    hex_ = color.hex_of(F.col("r"), F.col("g"), F.col("b"))
    is_bg = F.coalesce(F.col("bg") == F.col("label"), F.lit(False))
    role = F.when(is_bg, "background").otherwise("fill")
    return marked.select("image_id", "idx", "label", "r", "g", "b", hex_.alias("hex"), "n", is_bg.alias("is_background"), text.layer_name(role, F.col("idx"), hex_).alias("name"))


def remap(px: DataFrame, table: DataFrame) -> DataFrame:
    """Labels to palette indexes, -1 for those without."""
    return px.join(table.select("image_id", "label", "idx"), ["image_id", "label"], "left").withColumn("idx", F.coalesce("idx", F.lit(-1)))


def palette_pairs(table: DataFrame, columns: tuple[str, ...] = ("l", "la", "lb")) -> DataFrame:
    """Ordered pairs of different colours of each image's palette (64 rows at most): i, j and both colours."""
    a = table.select("image_id", F.col("idx").alias("i"), *[F.col(c).alias(f"{c}1") for c in columns])
    b = table.select("image_id", F.col("idx").alias("j"), *[F.col(c).alias(f"{c}2") for c in columns])
    return a.join(b, "image_id").filter("i <> j")


def blends(table: DataFrame, tolerance: float = 6.0) -> DataFrame:
    """(image_id, c, a, b, t): palette colours (c) near a blend of 10 to 90 % of two others (a < b). Palettes are small, so triples are joined by image."""
    one = lambda n: table.select("image_id", F.col("idx").alias(n), *[F.col(k).cast("double").alias(f"{k}{n}") for k in "rgb"])
    t3 = one("c").join(one("a"), "image_id").filter("c <> a").join(one("b"), "image_id").filter("a < b AND b <> c")
    span = [F.col(f"{k}a") - F.col(f"{k}b") for k in "rgb"]
    part = [F.col(f"{k}c") - F.col(f"{k}b") for k in "rgb"]
    den = sum((s * s for s in span), F.lit(0.0))
    t3 = t3.withColumn("t", sum((p * s for p, s in zip(part, span, strict=True)), F.lit(0.0)) / F.nullif(den, F.lit(0.0))).filter("t BETWEEN 0.1 AND 0.9")
    mixed = {f"m{k}": F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.rint(F.col(f"{k}b") + F.col("t") * s))) for k, s in zip("rgb", span, strict=True)}
    both = color.with_lab(color.with_lab(t3.withColumns(mixed), ("mr", "mg", "mb"), ("l1", "a1", "b1")), ("rc", "gc", "bc"), ("l2", "a2", "b2"))
    de = color.delta_e76(tuple(F.col(c) for c in ("l1", "a1", "b1")), tuple(F.col(c) for c in ("l2", "a2", "b2")))
    # a filter would be pushed below the steps and repeat them all; an explode of at most one value isn't
    near = F.explode(F.when(F.col("de") < tolerance, F.array("de")))
    return both.withColumn("de", de).select("image_id", "c", "a", "b", "t", near.alias("de"))


def kmeans(points: DataFrame, columns: list[str], k: int, rounds: int) -> DataFrame:
    """(cluster, n, columns): Lloyd's algorithm from the first k points by id, a fixed number of rounds. Each round is one grouped sum; only k centres come back."""
    first = points.orderBy("id").limit(k).select(*columns).collect()
    centers = [(i, [float(v) for v in r]) for i, r in enumerate(first)]
    out = None
    for _ in range(rounds):
        which = nearest([F.col(c).cast("double") for c in columns], centers)["id"]
        out = points.select(which.alias("cluster"), *columns).groupBy("cluster").agg(F.count("*").alias("n"), *[(F.sum(F.col(c).cast("double")) / F.count("*")).alias(c) for c in columns])
        moved = {r["cluster"]: [float(r[c]) for c in columns] for r in out.collect()}
        centers = [(i, moved.get(i, c)) for i, c in centers]
    return out


def layer_palette_index(layers: DataFrame, table: DataFrame) -> DataFrame:
    """(image_id, layer, idx): the explicit index, else the colour's, else the nearest by CIEDE2000 (the first of equals)."""
    pal = color.with_lab(table.select("image_id", "idx", "hex", "r", "g", "b"), out=("pl", "pa", "pb")).drop("r", "g", "b")
    r, g, b = color.from_hex(F.col("color_hex"))
    own = color.with_lab(layers.withColumns({"r": r, "g": g, "b": b}), out=("ql", "qa", "qb")).drop("r", "g", "b")
    pair = color.with_delta_e2000(own.join(pal, "image_id"), ("ql", "qa", "qb"), ("pl", "pa", "pb"))
    same = F.col("hex") == F.col("color_hex")
    rank = F.struct((~same).alias("other"), F.when(same, 0.0).otherwise(F.round("de", 9)).alias("de"), "idx")
    best = pair.groupBy("image_id", "layer", "palette_index").agg(F.min(rank).alias("best"))
    return best.select("image_id", "layer", F.coalesce("palette_index", F.col("best.idx")).cast("int").alias("idx"))
