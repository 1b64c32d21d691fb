"""Numbers, names, paths and validators as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens of an absolute M/L/C/Z path.
TOKEN = r"[MLCZ]|-?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"
NUMBER = r"^-?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?$"
GRAMMAR = r"^\s*M[MLCZ0-9eE+\-.,\s]*$"
HEX = r"^#[0-9a-f]{6}$"
XML_ID = r"^[A-Za-z_][A-Za-z0-9_.\-]*$"
UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def number(v: Column, decimals: int = 2) -> Column:
    """At most `decimals` places (halves to even), without trailing zeros and without -0. Written from a scaled integer, as Java rounds decimal text."""
    scaled = F.rint(v * float(10**decimals)).cast("long")
    whole, rest = F.expr("0") + F.floor(F.abs(scaled) / 10**decimals), F.abs(scaled) % 10**decimals
    text = F.concat(F.when(scaled < 0, "-").otherwise(""), whole.cast("long").cast("string"), F.lit("."), F.lpad(rest.cast("string"), decimals, "0"))
    return F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def rect_path(x0: Column, y0: Column, x1: Column, y1: Column, decimals: int = 2) -> Column:
    """A closed rectangle, clockwise from its upper left corner."""
    a, b, c, d = (number(v, decimals) for v in (x0, y0, x1, y1))
    return F.concat(F.lit("M"), a, F.lit(" "), b, F.lit(" L"), c, F.lit(" "), b, F.lit(" L"), c, F.lit(" "), d, F.lit(" L"), a, F.lit(" "), d, F.lit(" Z"))


def tokens(d: Column) -> Column:
    return F.regexp_extract_all(d, F.lit(TOKEN), F.lit(0))


def n_nodes(d: Column) -> Column:
    """Nodes of an M/L/C path with explicit commands: one for each M, L and C."""
    return F.length(d) - F.length(F.translate(d, "MLC", ""))


def round_path(d: Column, decimals: int = 2) -> Column:
    return F.array_join(F.transform(tokens(d), lambda t: F.when(t.rlike(NUMBER), number(t.cast("double"), decimals)).otherwise(t)), " ")


def largest(d: Column) -> Column:
    """The largest absolute number of a path, 0 if it has none."""
    return F.coalesce(F.array_max(F.transform(F.filter(tokens(d), lambda t: t.rlike(NUMBER)), lambda t: F.abs(t.cast("double")))), F.lit(0.0))


def all_integer(d: Column) -> Column:
    return F.forall(F.filter(tokens(d), lambda t: t.rlike(NUMBER)), lambda t: t.cast("double") == F.floor(t.cast("double")))


def is_path(d: Column) -> Column:
    return d.rlike(GRAMMAR)


def layer_name(role: Column, n: Column, color_hex: Column) -> Column:
    """background, color_3_E53935 or line_1_000000."""
    return F.when(role == "background", F.lit("background")).otherwise(F.concat_ws("_", F.when(role == "line", "line").otherwise("color"), n.cast("string"), F.upper(F.substring(color_hex, 2, 6))))


def safe_filename(raw: Column) -> Column:
    """The last part of a path without unprintable characters, 200 at most; `upload` if nothing is left."""
    last = F.regexp_extract(F.coalesce(raw, F.lit("")), r"([^/\\]*)$", 1)
    return F.coalesce(F.nullif(F.left(F.trim(F.regexp_replace(last, r"[^\p{Print}\p{L}\p{N}\p{P}\p{S} ]", "")), F.lit(200)), F.lit("")), F.lit("upload"))


def size_text(n: Column) -> Column:
    """Bytes, or KB and MB to a tenth."""

    def tenths(unit: float, name: str) -> Column:
        t = F.floor(n * 10 / F.lit(unit) + 0.5)
        return F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string"), F.lit(f" {name}"))

    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, tenths(1024.0, "KB")).otherwise(tenths(1048576.0, "MB"))


def time_budget(width: Column, height: Column) -> Column:
    return F.greatest(F.lit(2.0), 10.0 * width * height / 4e6)


def target_scale(width: Column, height: Column, below: int = 500, longest: int = 2048) -> Column:
    """Twofold for small images, within a longest side."""
    up = F.when(F.least(width, height) < below, 2.0).otherwise(1.0)
    return F.least(up, float(longest) / F.greatest(width, height))


def stroke_width(w: Column, scale: Column) -> Column:
    """In source pixels, to half a pixel, 0.5 at least."""
    return F.greatest(F.lit(0.5), F.rint(w / scale / 0.5) * 0.5)


def file_url(job_id: Column, kind: Column) -> Column:
    return F.concat(F.lit("/jobs/"), job_id, F.lit("/files/"), kind)


def download_name(upload: Column, kind: Column) -> Column:
    stem = F.regexp_replace(upload, r"\.[^.]*$", "")
    return F.when(kind == "preview", F.concat(stem, F.lit("_preview.png"))).otherwise(F.concat(stem, F.lit("."), kind))


def bezier(p: tuple[Column, ...], u: Column) -> Column:
    """One coordinate of a cubic Bézier curve."""
    v = 1.0 - u
    return v * v * v * p[0] + 3.0 * v * v * u * p[1] + 3.0 * v * u * u * p[2] + u * u * u * p[3]


def typed_hex(value: Column) -> Column:
    """A typed colour ('#ABC', 'abc123', ' #AbC123 ') as #rrggbb, else null."""
    bare = F.regexp_replace(F.lower(F.trim(value)), "^#", "")
    whole = F.when(bare.rlike("^[0-9a-f]{3}$"), F.regexp_replace(bare, "(.)", "$1$1")).otherwise(bare)
    return F.when(whole.rlike("^[0-9a-f]{6}$"), F.concat(F.lit("#"), whole))


#: Decimals of the metrics' labels.
METRIC_DECIMALS = {"ssim": 3, "alpha_iou": 3, "mean_delta_e": 2, "max_delta_e": 2, "gap_ratio": 5, "processing_time_s": 2}


def metric_label(name: Column, value: Column) -> Column:
    out = F.when(name == "svg_valid", F.when(value >= 1, "yes").otherwise("no"))
    for metric, n in METRIC_DECIMALS.items():
        out = out.when(name == metric, F.concat(F.format_string(f"%.{n}f", value), F.lit(" s" if metric.endswith("_s") else "")))
    return out


#: Media types by extension, and those accepted if nothing else is set.
MEDIA_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg"}
ACCEPTED = ("image/png", "image/jpeg")


def media_type(name: Column, said: Column) -> Column:
    """What the browser says, else by the extension; empty if neither is known."""
    end = F.lower(F.element_at(F.split(name, r"\."), -1))
    by_end = F.lit("")
    for ext, kind in MEDIA_TYPES.items():
        by_end = F.when(end == ext, kind).otherwise(by_end)
    return F.when(F.coalesce(said, F.lit("")) != "", said).otherwise(by_end)


def accepted(kind: Column, types: tuple[str, ...] = ACCEPTED) -> Column:
    return kind.isin(*types)
