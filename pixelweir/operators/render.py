"""Documents to pixels: paths flattened to edges, fills by winding, strokes as rows of capsules, layers painted over one another.

Layers are rows (image_id, z, path_no, d, color_hex, is_stroke, stroke_width, fill_rule, opacity, width, height); the
paths of one (image_id, z) share their winding. Everything is rows and windows by layer and line, so that no task needs
a whole canvas. Null and empty paths, and what stands before a path's first M, draw nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelweir.functions import color, text
from pixelweir.operators import regions

LAYER = ["image_id", "z", "color_hex", "is_stroke", "stroke_width", "fill_rule", "opacity", "width", "height", "ss"]
_NUMBER = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"
# A curve's edges are this long at most where its control polygon allows, within bounds of their number.
EDGE_LENGTH, FEWEST, MOST = 1.5, 2, 64
SMALL_CANVAS = 1_500_000


def with_samples(layers: DataFrame) -> DataFrame:
    """Adds ss, the samples a side of each pixel: 1 for documents of whole numbers without strokes, else 3, or 2 on large canvases."""
    exact = F.min((F.coalesce(text.all_integer(F.col("d")), F.lit(True)) & ~F.col("is_stroke")).cast("int")).over(Window.partitionBy("image_id"))
    return layers.withColumn("ss", F.when(exact == 1, 1).when(F.col("width").cast("long") * F.col("height") <= SMALL_CANVAS, 3).otherwise(2))


def _steps(layers: DataFrame) -> DataFrame:
    """One row for each drawing step: op, its numbers v, the end point, where the pen stood, where its subpath began, and the ops before and after."""
    words = layers.select(*LAYER, "path_no", F.posexplode(F.regexp_extract_all("d", F.lit("[MLCZ][^MLCZ]*"), F.lit(0))).alias("_c", "_word"))
    rows = words.select(*LAYER, "path_no", "_c", F.substring("_word", 1, 1).alias("_cmd"), F.transform(F.regexp_extract_all("_word", F.lit(_NUMBER), F.lit(0)), lambda n: n.cast("double")).alias("_n"))
    size = F.when(F.col("_cmd") == "C", 6).otherwise(2)
    count = F.floor(F.size("_n") / size).cast("int")
    nothing = F.array().cast("array<double>")
    groups = F.when(F.col("_cmd") == "Z", F.array(nothing)).when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda g: F.slice("_n", g * size + 1, size)))
    steps = rows.select(*LAYER, "path_no", "_c", "_cmd", F.posexplode(groups).alias("_g", "v"))
    op = F.when((F.col("_cmd") == "M") & (F.col("_g") > 0), "L").otherwise(F.col("_cmd"))
    end = F.struct(F.get("v", F.size("v") - 2).alias("x"), F.get("v", F.size("v") - 1).alias("y"))
    along = Window.partitionBy(*LAYER, "path_no").orderBy("_c", "_g")
    out = steps.withColumns({"op": op, "end": end})
    begun = F.last(F.when(F.col("op") == "M", F.col("end")), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumns({"start": begun, "before": F.lag("op").over(along), "after": F.lead("op").over(along), "_lag": F.lag("end").over(along)})
    return out.withColumn("pen", F.when(F.col("before") == "Z", F.col("start")).otherwise(F.col("_lag"))).filter("start IS NOT NULL")


def edges(layers: DataFrame) -> DataFrame:
    """Straight edges (x0, y0, x1, y1) of the layers' paths, curves flattened; `implied` are those that close an open subpath, for fills alone."""
    steps = _steps(layers)
    pen, end, start, v = (F.col(c) for c in ("pen", "end", "start", "v"))
    at = [(pen["x"], pen["y"])] + [(F.get(v, F.lit(k)), F.get(v, F.lit(k + 1))) for k in (0, 2, 4)]
    length = sum((F.sqrt((q[0] - p[0]) * (q[0] - p[0]) + (q[1] - p[1]) * (q[1] - p[1])) for p, q in zip(at, at[1:], strict=False)), F.lit(0.0))
    n = F.least(F.greatest(F.ceil(length / EDGE_LENGTH), F.lit(FEWEST)), F.lit(MOST)).cast("int")

    def edge(x0: Column, y0: Column, x1: Column, y1: Column, implied: bool) -> Column:
        return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), F.lit(implied).alias("implied"))

    def piece(k: Column) -> Column:
        u, w = k / F.col("n"), (k + 1) / F.col("n")
        xs, ys = tuple(p[0] for p in at), tuple(p[1] for p in at)
        return edge(text.bezier(xs, u), text.bezier(ys, u), text.bezier(xs, w), text.bezier(ys, w), False)

    none = F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double,implied:boolean>>")
    drawn = (
        F.when(F.col("op") == "C", F.transform(F.sequence(F.lit(0), F.col("n") - 1), piece))
        .when(F.col("op") == "L", F.array(edge(pen["x"], pen["y"], end["x"], end["y"], False)))
        .when((F.col("op") == "Z") & F.col("before").isin("L", "C"), F.array(edge(pen["x"], pen["y"], start["x"], start["y"], False)))
        .otherwise(none)
    )
    ends = F.col("op").isin("L", "C") & (F.col("after").isNull() | (F.col("after") == "M"))
    closing = F.when(ends, F.array(edge(end["x"], end["y"], start["x"], start["y"], True))).otherwise(none)
    known = steps.withColumn("n", F.coalesce(n, F.lit(FEWEST)))
    return known.select(*LAYER, F.explode(F.concat(drawn, closing)).alias("e")).select(*LAYER, "e.*")


def _scaled(e: DataFrame) -> DataFrame:
    return e.withColumns({c: F.col(c) * F.col("ss") for c in ("x0", "y0", "x1", "y1")})


def _rows(e: DataFrame, top: Column, bottom: Column) -> DataFrame:
    """A row for each line of samples whose centre lies in [top, bottom), with that centre as yc."""
    first, last = F.greatest(F.ceil(top - 0.5), F.lit(0)), F.least(F.ceil(bottom - 0.5), F.col("height") * F.col("ss")) - 1
    return e.withColumns({"_first": first.cast("int"), "_last": last.cast("int")}).filter("_last >= _first").withColumn("row", F.explode(F.sequence("_first", "_last"))).withColumn("yc", F.col("row") + 0.5)


def _inside_columns(at: Column) -> Column:
    """The first column of samples whose centre isn't left of a place."""
    return F.least(F.greatest(F.ceil(at - 0.5), F.lit(0)), F.col("width") * F.col("ss")).cast("int")


def _fill_steps(e: DataFrame) -> DataFrame:
    """Where winding changes along lines of samples: each edge counts once a line, signed under the nonzero rule."""
    at = _rows(_scaled(e).filter("y0 <> y1"), F.least("y0", "y1"), F.greatest("y0", "y1"))
    x = F.col("x0") + (F.col("yc") - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))
    sign = F.when((F.col("fill_rule") == "nonzero") & (F.col("y1") < F.col("y0")), -1).otherwise(1)
    return at.select(*LAYER, "row", _inside_columns(x).alias("col"), sign.alias("w"))


def _stroke_steps(e: DataFrame) -> DataFrame:
    """Each edge with round ends is convex, so that it meets a line of samples in one span: from the least to the greatest
    of where the line meets both circles and the rectangle between them."""
    s = _scaled(e.filter("NOT implied")).withColumn("_r", F.greatest(F.coalesce("stroke_width", F.lit(1.0)) * F.col("ss"), F.lit(1.0)) / 2)
    at = _rows(s, F.least("y0", "y1") - F.col("_r"), F.greatest("y0", "y1") + F.col("_r"))
    length = F.sqrt((F.col("x1") - F.col("x0")) * (F.col("x1") - F.col("x0")) + (F.col("y1") - F.col("y0")) * (F.col("y1") - F.col("y0")))
    at = at.withColumn("_len", length)
    long = F.col("_len") > 0
    at = at.withColumns({"_nx": F.when(long, -(F.col("y1") - F.col("y0")) / F.col("_len") * F.col("_r")), "_ny": F.when(long, (F.col("x1") - F.col("x0")) / F.col("_len") * F.col("_r"))})
    at = at.withColumns({f"_{c}{k}{n}": F.col(f"{c}{k}") + side * F.col(f"_n{c}") for n, side in (("l", 1), ("r", -1)) for c in "xy" for k in (0, 1)})
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    corners = [point(f"_x{k}{n}", f"_y{k}{n}") for k, n in ((0, "l"), (1, "l"), (1, "r"), (0, "r"))]
    at = at.withColumn("_sides", F.array(*[F.struct(p.alias("p"), q.alias("q")) for p, q in zip(corners, corners[1:] + corners[:1], strict=True)]))
    yc = F.col("yc")

    def circle(c: Column) -> Column:
        rest = F.col("_r") * F.col("_r") - (yc - c["y"]) * (yc - c["y"])
        return F.when(rest >= 0, F.array(c["x"] - F.sqrt(F.abs(rest)), c["x"] + F.sqrt(F.abs(rest)))).otherwise(F.array().cast("array<double>"))

    def side(s: Column) -> Column:
        p, q = s["p"], s["q"]
        return F.when((p["y"] != q["y"]) & yc.between(F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"])), p["x"] + (yc - p["y"]) * (q["x"] - p["x"]) / (q["y"] - p["y"]))

    meets = F.concat(F.flatten(F.transform(F.array(point("x0", "y0"), point("x1", "y1")), circle)), F.transform("_sides", side))
    spans = at.withColumn("_meets", meets).withColumns({"_a": F.array_min("_meets"), "_b": F.array_max("_meets")}).filter("_a IS NOT NULL")
    begin, end = _inside_columns(F.col("_a")), F.least(F.greatest(F.floor(F.col("_b") - 0.5) + 1, F.lit(0)), F.col("width") * F.col("ss")).cast("int")
    both = F.array(F.struct(F.col("_from").alias("col"), F.lit(1).alias("w")), F.struct(F.col("_to").alias("col"), F.lit(-1).alias("w")))
    return spans.withColumns({"_from": begin, "_to": end}).filter("_to > _from").select(*LAYER, "row", F.explode(both).alias("s")).select(*LAYER, "row", "s.*")


def coverage(layers: DataFrame) -> DataFrame:
    """(layer columns, y, x, cover): the share of each pixel's samples that a layer covers, where there is any. Expects ss (with_samples); strokes take two samples a side at least."""
    own = layers.withColumn("ss", F.when(F.col("is_stroke"), F.greatest("ss", F.lit(2))).otherwise(F.col("ss")))
    e = edges(own)
    steps = _fill_steps(e.filter("NOT is_stroke")).unionByName(_stroke_steps(e.filter("is_stroke")))
    merged = steps.groupBy(*LAYER, "row", "col").agg(F.sum("w").alias("w"))
    along = Window.partitionBy(*LAYER, "row").orderBy("col")
    wind = F.sum("w").over(along.rowsBetween(Window.unboundedPreceding, 0))
    spans = merged.withColumns({"_wind": wind, "_end": F.coalesce(F.lead("col").over(along), F.col("width") * F.col("ss"))})
    odd = F.pmod(F.col("_wind"), F.lit(2)) == 1
    spans = spans.filter((F.col("_end") > F.col("col")) & F.when(F.col("is_stroke") | (F.col("fill_rule") == "nonzero"), F.col("_wind") != 0).otherwise(odd))
    cells = spans.withColumn("x", F.explode(F.sequence(F.expr("int(col div ss)"), F.expr("int((_end - 1) div ss)")))).withColumn("y", F.expr("int(row div ss)"))
    part = F.least("_end", (F.col("x") + 1) * F.col("ss")) - F.greatest("col", F.col("x") * F.col("ss"))
    return cells.groupBy(*LAYER, "y", "x").agg((F.sum(part) / F.first(F.col("ss") * F.col("ss"))).alias("cover"))


def paint(cover: DataFrame) -> DataFrame:
    """(image_id, y, x, r, g, b, a) from 0 to 1, straight alpha, where any layer covers a pixel."""
    colours = [(c / 255.0).alias(n) for n, c in zip("rgb", color.from_hex(F.col("color_hex")), strict=True)]
    return regions.premultiplied_over(cover.select("image_id", "y", "x", "z", *colours, (F.col("cover") * F.col("opacity")).alias("a")))


def render(layers: DataFrame) -> DataFrame:
    """(image_id, y, x, r, g, b, a) as bytes of whole documents; pixels that no layer covers have no row."""
    painted = paint(coverage(with_samples(layers)))
    return painted.select("image_id", "y", "x", *[F.rint(F.least(F.greatest(F.col(c) * 255.0, F.lit(0.0)), F.lit(255.0))).cast("int").alias(c) for c in "rgba"])
