"""Vector documents as text: SVG, EPS and PDF content, and the structure checks on them."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelweir.functions import color, text


def paint(is_stroke: Column, color_hex: Column, stroke_width: Column, fill_rule: Column, opacity: Column) -> Column:
    """SVG paint attributes of a layer."""
    fill = F.concat(F.lit('fill="'), color_hex, F.lit('" fill-rule="'), fill_rule, F.lit('"'))
    stroke = F.concat(F.lit('fill="none" stroke="'), color_hex, F.lit('" stroke-width="'), text.number(stroke_width), F.lit('" stroke-linecap="round" stroke-linejoin="round"'))
    return F.concat(F.when(is_stroke, stroke).otherwise(fill), F.when(opacity < 1, F.concat(F.lit(' opacity="'), text.number(opacity), F.lit('"'))).otherwise(""))


def svg(layers: DataFrame, width: int, height: int) -> DataFrame:
    """(image_id, svg): a group for each layer by z. layers: image_id, z, id, d, color_hex, is_stroke, stroke_width, fill_rule, opacity."""
    p = paint(F.col("is_stroke"), F.col("color_hex"), F.col("stroke_width"), F.col("fill_rule"), F.col("opacity"))
    group = F.concat(F.lit('<g id="'), F.col("id"), F.lit('" '), p, F.lit('><path d="'), F.col("d"), F.lit('"/></g>'))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("z", group.alias("g")))), lambda x: x["g"]), "")
    head = f'<svg xmlns="http://www.w3.org/2000/svg" version="1.1" width="{width}" height="{height}" viewBox="0 0 {width} {height}">'
    return layers.groupBy("image_id").agg(F.concat(F.lit(head), body, F.lit("</svg>")).alias("svg"))


def metadata(filename: Column, label: Column, settings: Column) -> Column:
    """Compact JSON with sorted keys."""
    return F.to_json(F.struct(label.alias("class"), filename.alias("filename"), settings.alias("settings")))


#: Elements and attributes that an exported SVG must not have.
FORBIDDEN_ELEMENTS = ("script", "foreignObject", "image", "iframe", "object", "embed", "animate", "set", "use", "style", "text")
FORBIDDEN_ATTRIBUTE = r"(?i)\s(?:on[a-z]+|href|xlink:href|style)\s*="


def svg_problems(docs: DataFrame, width: int, height: int) -> DataFrame:
    """(image_id, problem) for svg and ids (the layers' ids in order): root, view box, order of groups, forbidden markup, nothing drawn."""
    s = F.col("svg")
    got = F.regexp_extract_all(s, F.lit(r'<g id="([^"]*)"'), F.lit(1))
    elements = "|".join(FORBIDDEN_ELEMENTS)
    found = F.array(
        F.when(~s.rlike(r"^\s*(?:<\?xml[^>]*>\s*)?<svg\b") | ~s.rlike(r"</svg>\s*$"), "no_root"),
        F.when(~F.contains(s, F.lit(f'viewBox="0 0 {width} {height}"')), "view_box"),
        F.when(F.size(F.array_except("ids", got)) > 0, "missing_layer"),
        F.when((F.size(F.array_except("ids", got)) == 0) & (got != F.col("ids")), "layer_order"),
        F.when(s.rlike(rf"<(?:{elements})\b"), "forbidden_element"),
        F.when(s.rlike(FORBIDDEN_ATTRIBUTE), "forbidden_attribute"),
        F.when(~s.rlike(r"<path\b"), "nothing_drawn"),
    )
    return docs.select("image_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("problem"))


def _ops(d: Column, names: dict[str, str]) -> Column:
    """A path's commands with their operands first, as PostScript and PDF want them."""
    parts = F.regexp_extract_all(d, F.lit("[MLCZ][^MLCZ]*"), F.lit(0))
    word = lambda p: F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.substring(p, 1, 1))
    return F.array_join(F.transform(parts, lambda p: F.ltrim(F.concat_ws(" ", F.nullif(F.trim(F.regexp_replace(F.substring(p, 2, 1 << 30), r"[,\s]+", " ")), F.lit("")), word(p)))), "\n")


def pdf_ops(d: Column) -> Column:
    return _ops(d, {"M": "m", "L": "l", "C": "c", "Z": "h"})


def eps_ops(d: Column) -> Column:
    return _ops(d, {"M": "moveto", "L": "lineto", "C": "curveto", "Z": "closepath"})


def _unit(color_hex: Column) -> Column:
    return F.concat_ws(" ", *[text.number(c, 4) for c in color.unit_rgb(color_hex)])


def layer_content(d: Column, color_hex: Column, is_stroke: Column, stroke_width: Column, fill_rule: Column) -> Column:
    """One layer's PDF content stream."""
    end = F.when(is_stroke, "S").when(fill_rule == "evenodd", "f*").otherwise("f")
    set_ = F.when(is_stroke, F.concat(_unit(color_hex), F.lit(" RG "), text.number(stroke_width), F.lit(" w 1 J 1 j"))).otherwise(F.concat(_unit(color_hex), F.lit(" rg")))
    return F.concat_ws("\n", set_, pdf_ops(d), end)


def eps(layers: DataFrame, width: int, height: int) -> DataFrame:
    """(image_id, eps): fills by z in PostScript, y turned downwards."""
    end = F.when(F.col("is_stroke"), "stroke").when(F.col("fill_rule") == "evenodd", "eofill").otherwise("fill")
    part = F.concat_ws("\n", F.lit("newpath"), eps_ops(F.col("d")), F.concat(_unit(F.col("color_hex")), F.lit(" setrgbcolor")), end)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("z", part.alias("p")))), lambda x: x["p"]), "\n")
    head = f"%!PS-Adobe-3.0 EPSF-3.0\n%%BoundingBox: 0 0 {width} {height}\n%%EndComments\n%%BeginProlog\n%%EndProlog\ngsave\n0 {height} translate\n1 -1 scale\n"
    return layers.groupBy("image_id").agg(F.concat(F.lit(head), body, F.lit("\ngrestore\nshowpage\n%%EOF\n")).alias("eps"))


def eps_checks(docs: DataFrame, width: int, height: int) -> DataFrame:
    """(image_id, name, status): header, bounding box, terminator, balanced graphics state, canvas size, vector operators and no raster ones."""
    e = F.col("eps")
    box = F.regexp_extract_all(e, F.lit(r"%%BoundingBox: (-?[0-9]+ -?[0-9]+ -?[0-9]+ -?[0-9]+)"), F.lit(1))
    n = lambda word: F.size(F.regexp_extract_all(e, F.lit(rf"(?m)(?:^|\s)({word})(?=\s|$)"), F.lit(1)))
    off = lambda k, want: F.abs(F.split(F.get(box, F.lit(0)), " ")[k].cast("int") - want)
    gap = F.greatest(off(2, width), off(3, height))
    say = lambda good: F.when(good, "pass").otherwise("fail")
    rows = {
        "header": say(F.startswith(e, F.lit("%!PS-Adobe-3.0 EPSF-3.0"))),
        "bounding_box": say(F.size(box) == 1),
        "terminator": say(F.rtrim(e).endswith("%%EOF") | F.regexp_replace(e, r"\s+$", "").endswith("%%EOF")),
        "graphics_state": say(n("gsave") == n("grestore")),
        "canvas": F.when(F.size(box) != 1, "fail").when(gap == 0, "pass").when(gap <= 2, "warn").otherwise("fail"),
        "vector": say(n("moveto") + n("lineto") + n("curveto") > 0),
        "no_raster": say(~e.rlike(r"(?m)(?:^|\s)(?:image|imagemask|colorimage)(?:\s|$)")),
    }
    return docs.select("image_id", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), v.alias("status")) for k, v in rows.items()])).alias("c")).select("image_id", "c.*")


def pdf(layers: DataFrame, width: int, height: int) -> DataFrame:
    """(image_id, pdf): a page with an optional content group for each layer. The bytes' offsets need the bytes, so a scalar pandas UDF assembles them."""
    content = layer_content(F.col("d"), F.col("color_hex"), F.col("is_stroke"), F.col("stroke_width"), F.col("fill_rule"))
    packed = layers.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("z", "id", content.alias("c")))).alias("parts"))

    @F.pandas_udf("binary")
    def build(parts: pd.Series) -> pd.Series:
        return pd.Series([pdf_bytes([(p["id"], p["c"]) for p in x], width, height) for x in parts])

    return packed.select("image_id", build("parts").alias("pdf"))


def pdf_bytes(layers: list[tuple[str, str]], width: int, height: int) -> bytes:
    """A PDF 1.5 file of (name, content stream) layers."""
    n = len(layers)
    refs = " ".join(f"{5 + k} 0 R" for k in range(n))
    names = " ".join(f"/L{k} {5 + k} 0 R" for k in range(n))
    body = f"q 1 0 0 -1 0 {height} cm\n" + "\n".join(f"/OC /L{k} BDC\n{c}\nEMC" for k, (_, c) in enumerate(layers)) + "\nQ"
    stream = zlib.compress(body.encode("latin-1"))
    objects = [
        f"<< /Type /Catalog /Pages 2 0 R /OCProperties << /OCGs [{refs}] /D << /Order [{refs}] /ON [{refs}] >> >> >>".encode(),
        b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>",
        f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {width} {height}] /Contents 4 0 R /Resources << /Properties << {names} >> >> >>".encode(),
        b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(stream), stream),
        *[f"<< /Type /OCG /Name ({name}) >>".encode("latin-1") for name, _ in layers],
    ]
    out, at = b"%PDF-1.5\n", []
    for k, o in enumerate(objects, 1):
        at.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (k, o)
    table = b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in at)
    return out + table + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, len(out))


def layer_names_of_pdf(content: Column) -> Column:
    return F.regexp_extract_all(F.decode(content, "ISO-8859-1"), F.lit(r"/Type /OCG /Name \(([^)]*)\)"), F.lit(1))


def png_bytes(rgba) -> bytes:
    """An 8-bit RGBA PNG of an array."""
    import struct

    h, w = rgba.shape[:2]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + rgba[y].astype("u1").tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
