"""Colour science as Spark columns: sRGB, CIELAB (D65, 2 degrees), colour differences, packing and compositing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Linear sRGB to XYZ, and the D65 white point of the 2-degree observer.
RGB_TO_XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
XYZ_TO_RGB = ((3.24048134, -1.53715152, -0.49853633), (-0.96925495, 1.87599000, 0.04155593), (0.05564664, -0.20404134, 1.05731107))
WHITE = (0.95047, 1.0, 1.08883)
# Rec. 709 weights of a gray.
GRAY = (0.2125, 0.7154, 0.0721)


def linear(c: Column) -> Column:
    """An sRGB channel (0 to 255) as linear light."""
    v = c / F.lit(255.0)
    return F.when(v > 0.04045, F.pow((v + 0.055) / 1.055, F.lit(2.4))).otherwise(v / 12.92)


def _f(t: Column) -> Column:
    return F.when(t > 0.008856, F.pow(t, F.lit(1.0 / 3.0))).otherwise(7.787 * t + 16.0 / 116.0)


def rgb_to_lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    light = [linear(c) for c in (r, g, b)]
    x, y, z = (_f((row[0] * light[0] + row[1] * light[1] + row[2] * light[2]) / w) for row, w in zip(RGB_TO_XYZ, WHITE, strict=True))
    return 116.0 * y - 16.0, 500.0 * (x - y), 200.0 * (y - z)


def lab_to_rgb(l: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:  # noqa: E741
    """8-bit sRGB, clipped, halves to even."""
    y = (l + 16.0) / 116.0
    x, z = a / 500.0 + y, F.greatest(F.lit(0.0), y - b / 200.0)

    def back(t: Column, w: float) -> Column:
        return w * F.when(t > 0.2068966, t * t * t).otherwise((t - 16.0 / 116.0) / 7.787)

    xyz = [back(t, w) for t, w in zip((x, y, z), WHITE, strict=True)]

    def channel(row: tuple[float, float, float]) -> Column:
        v = row[0] * xyz[0] + row[1] * xyz[1] + row[2] * xyz[2]
        s = F.when(v > 0.0031308, 1.055 * F.pow(F.greatest(v, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055).otherwise(12.92 * v)
        return F.rint(255.0 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), s))).cast("int")

    return channel(XYZ_TO_RGB[0]), channel(XYZ_TO_RGB[1]), channel(XYZ_TO_RGB[2])


def delta_e76(p: tuple[Column, ...], q: tuple[Column, ...]) -> Column:
    return F.sqrt(sum((F.pow(x - y, F.lit(2.0)) for x, y in zip(p, q, strict=True)), F.lit(0.0)))


def _staged(df: DataFrame, steps: list[dict[str, Column]], keep: list[str]) -> DataFrame:
    """Adds columns step by step, so that each value is computed once.

    As one expression the tree would double with every use, and so would plain projections once the optimizer merges
    them or carries a filter through them. A one-row inline() between steps keeps them apart and stays in codegen.
    """
    for step in steps:
        df = df.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in step.items()]))))
    return df.select(*keep)


def with_lab(df: DataFrame, rgb: tuple[str, str, str] = ("r", "g", "b"), out: tuple[str, str, str] = ("l", "la", "lb")) -> DataFrame:
    """Adds CIELAB columns for 8-bit (or finer) sRGB columns."""
    c = F.col
    return _staged(
        df,
        [
            {f"_v{k}": linear(c(name)) for k, name in enumerate(rgb)},
            {f"_t{k}": (row[0] * c("_v0") + row[1] * c("_v1") + row[2] * c("_v2")) / w for k, (row, w) in enumerate(zip(RGB_TO_XYZ, WHITE, strict=True))},
            {f"_f{k}": _f(c(f"_t{k}")) for k in range(3)},
            {out[0]: 116.0 * c("_f1") - 16.0, out[1]: 500.0 * (c("_f0") - c("_f1")), out[2]: 200.0 * (c("_f1") - c("_f2"))},
        ],
        [*[x for x in df.columns if x not in out], *out],
    )


def with_delta_e2000(df: DataFrame, p: tuple[str, str, str], q: tuple[str, str, str], out: str = "de") -> DataFrame:
    """Adds CIEDE2000 between LAB columns p and q. Achromatic colours have hue 0; hue differences and means wrap at 180 degrees."""
    c = F.col
    (l1, a1, b1), (l2, a2, b2) = ([c(x) for x in s] for s in (p, q))
    sq = lambda x: x * x
    cos = lambda x: F.cos(F.radians(x))
    far = float(25**7)

    def hue(b: Column, u: Column) -> Column:
        return F.when((b == 0) & (u == 0), 0.0).otherwise(F.degrees(F.atan2(b, u)))

    turn, total = c("_h2") - c("_h1"), c("_h1") + c("_h2")
    gray = (c("_c1") * c("_c2")) == 0
    steps = [
        {"_c7": F.pow((F.sqrt(sq(a1) + sq(b1)) + F.sqrt(sq(a2) + sq(b2))) / 2.0, F.lit(7.0))},
        {"_g": 1.0 + 0.5 * (1.0 - F.sqrt(c("_c7") / (c("_c7") + far)))},
        {"_u1": a1 * c("_g"), "_u2": a2 * c("_g")},
        {"_c1": F.sqrt(sq(c("_u1")) + sq(b1)), "_c2": F.sqrt(sq(c("_u2")) + sq(b2)), "_a1": hue(b1, c("_u1")), "_a2": hue(b2, c("_u2"))},
        {f"_h{k}": F.when(c(f"_a{k}") < 0, c(f"_a{k}") + 360.0).otherwise(c(f"_a{k}")) for k in (1, 2)},
        {
            "_dh": F.when(gray, 0.0).when(turn > 180.0, turn - 360.0).when(turn < -180.0, turn + 360.0).otherwise(turn),
            "_hm": F.when(gray, total).when(F.abs(turn) <= 180.0, total / 2.0).when(total < 360.0, (total + 360.0) / 2.0).otherwise((total - 360.0) / 2.0),
            "_lm": sq((l1 + l2) / 2.0 - 50.0),
            "_cm": (c("_c1") + c("_c2")) / 2.0,
        },
        {"_t": 1.0 - 0.17 * cos(c("_hm") - 30.0) + 0.24 * cos(2.0 * c("_hm")) + 0.32 * cos(3.0 * c("_hm") + 6.0) - 0.20 * cos(4.0 * c("_hm") - 63.0), "_m7": F.pow(c("_cm"), F.lit(7.0))},
        {
            "_x": (l2 - l1) / (1.0 + 0.015 * c("_lm") / F.sqrt(20.0 + c("_lm"))),
            "_y": (c("_c2") - c("_c1")) / (1.0 + 0.045 * c("_cm")),
            "_z": 2.0 * F.sqrt(c("_c1") * c("_c2")) * F.sin(F.radians(c("_dh") / 2.0)) / (1.0 + 0.015 * c("_cm") * c("_t")),
            "_r": -F.sin(F.radians(60.0 * F.exp(-sq((c("_hm") - 275.0) / 25.0)))) * 2.0 * F.sqrt(c("_m7") / (c("_m7") + far)),
        },
        {out: F.sqrt(F.greatest(sq(c("_x")) + sq(c("_y")) + sq(c("_z")) + c("_r") * c("_y") * c("_z"), F.lit(0.0)))},
    ]
    return _staged(df, steps, [*[x for x in df.columns if x != out], out])


def code(r: Column, g: Column, b: Column) -> Column:
    """24-bit packed colour."""
    return F.shiftleft(r, 16).bitwiseOR(F.shiftleft(g, 8)).bitwiseOR(b)


def code5(r: Column, g: Column, b: Column) -> Column:
    """15-bit packed colour of the five high bits of each channel."""
    return F.shiftleft(F.shiftright(r, 3), 10).bitwiseOR(F.shiftleft(F.shiftright(g, 3), 5)).bitwiseOR(F.shiftright(b, 3))


def hex_of(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02x%02x%02x", r, g, b)


def from_hex(h: Column) -> tuple[Column, Column, Column]:
    r, g, b = (F.conv(F.substring(h, k, 2), 16, 10).cast("int") for k in (2, 4, 6))
    return r, g, b


def unit_rgb(h: Column) -> tuple[Column, ...]:
    return tuple(c / F.lit(255.0) for c in from_hex(h))


def lab_bin(l: Column, a: Column, b: Column) -> Column:  # noqa: E741
    """Coarse bin: lightness in tens, a and b in twelves."""
    return (F.least(F.floor(l / 10.0), F.lit(10)) * 484 + F.floor((a + 128.0) / 12.0) * 22 + F.floor((b + 128.0) / 12.0)).cast("long")


def over_white(c: Column, alpha: Column) -> Column:
    """A straight-alpha channel over white, 0 to 1."""
    return c / F.lit(255.0) * (alpha / F.lit(255.0)) + (1.0 - alpha / F.lit(255.0))


def gray_over_white(r: Column, g: Column, b: Column, alpha: Column) -> Column:
    return GRAY[0] * over_white(r, alpha) + GRAY[1] * over_white(g, alpha) + GRAY[2] * over_white(b, alpha)


def opaque(alpha: Column) -> Column:
    return F.coalesce(alpha, F.lit(255)) >= 128


def rgb_distance(p: tuple[Column, ...], q: tuple[Column, ...]) -> Column:
    return delta_e76(p, q)


def luma(r: Column, g: Column, b: Column) -> Column:
    """8-bit gray with Rec. 601 weights in fixed point, halves up."""
    return F.shiftright(r * 4899 + g * 9617 + b * 1868 + 8192, 14)


def sigmoid(x: Column) -> Column:
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1.0 / (1.0 + e)).otherwise(e / (1.0 + e))


def luminance(h: Column) -> Column:
    """Relative luminance of #rrggbb by the web accessibility guidelines."""

    def linear(c: Column) -> Column:
        return F.when(c <= 0.03928, c / F.lit(12.92)).otherwise(F.pow((c + 0.055) / F.lit(1.055), F.lit(2.4)))

    r, g, b = map(linear, unit_rgb(h))
    return 0.2126 * r + 0.7152 * g + 0.0722 * b
