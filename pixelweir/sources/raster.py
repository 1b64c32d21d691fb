"""Rasters as relations (image_id, y, x, ...): from image files, and derived from the events table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values of the derived raster: its size, and six colours.
WIDTH, HEIGHT, BLOCK = 25, 20, 5
PALETTE = ((255, 255, 255), (220, 50, 47), (0, 0, 0), (38, 139, 210), (133, 153, 0), (181, 137, 0))

PNG_MAGIC, JPEG_MAGIC = "89504E470D0A1A0A", "FFD8FF"
MAX_PIXELS = 36_000_000


def sniff_format(content: Column) -> Column:
    """PNG, JPEG or null, by the first bytes alone."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head == PNG_MAGIC, "PNG").when(head.startswith(JPEG_MAGIC), "JPEG")


def media_type(content: Column) -> Column:
    kind = sniff_format(content)
    return F.when(kind == "PNG", "image/png").when(kind == "JPEG", "image/jpeg")


def list_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Image files that have a JSON file of the same stem, by name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    images = files.filter(F.lower("path").rlike(r"\.(png|jpe?g)$")).withColumn("stem", stem)
    truth = files.filter(F.lower("path").endswith(".json")).select(stem.alias("stem"))
    return images.join(truth, "stem", "left_semi").select("path", F.regexp_extract("stem", "([^/]*)$", 1).alias("name")).orderBy("name")


def find_sample(samples: DataFrame, key: str) -> DataFrame:
    """Samples by stem, file name or number prefix; the caller checks that there is one."""
    padded = F.lpad(F.lit(key), 2, "0")
    return samples.filter((F.col("name") == key) | F.col("path").endswith(f"/{key}") | (F.lit(key).rlike("^[0-9]+$") & F.col("name").startswith(F.concat(padded, F.lit("_")))))


def images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, width, height, n_channels, format, size_bytes, error): image files, broken ones with an error instead of a size."""
    raw = spark.read.format("binaryFile").load(folder).select("path", F.col("length").alias("size_bytes"), "content")
    read = spark.read.format("image").option("dropInvalid", False).load(folder).select(F.col("image.origin").alias("path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.nChannels").alias("n_channels"))
    tidy = lambda c: F.regexp_replace(c, "^file:/*", "/")
    joined = raw.withColumn("path", tidy("path")).join(read.withColumn("path", tidy("path")), "path", "left")
    error = (
        F.when(sniff_format(F.col("content")).isNull(), "unsupported_format")
        .when(F.coalesce("height", F.lit(-1)) <= 0, "invalid_image")
        .when(F.col("width").cast("long") * F.col("height") > MAX_PIXELS, "too_many_pixels")
    )
    return joined.select("path", "width", "height", "n_channels", sniff_format(F.col("content")).alias("format"), "size_bytes", error.alias("error"))


def image_pixels(spark: SparkSession, folder: str) -> DataFrame:
    """(path, y, x, r, g, b, a) of readable images: the source's BGR(A) bytes, one row a pixel."""
    i = F.col("image")
    data = spark.read.format("image").option("dropInvalid", True).load(folder)
    at = data.select(i["origin"].alias("path"), i["width"].alias("w"), i["nChannels"].alias("n"), i["data"].alias("data"), F.explode(F.sequence(F.lit(0), i["width"] * i["height"] - 1)).alias("k"))

    def byte(c: Column) -> Column:
        return F.conv(F.hex(F.substring(F.col("data"), F.col("k") * F.col("n") + c + 1, F.lit(1))), 16, 10).cast("int")

    one = F.col("n") == 1
    channel = lambda k: F.when(one, byte(F.lit(0))).otherwise(byte(F.lit(k)))
    return at.select("path", F.expr("k div w").cast("int").alias("y"), F.expr("k % w").cast("int").alias("x"), channel(2).alias("r"), channel(1).alias("g"), channel(0).alias("b"), F.when(F.col("n") == 4, byte(F.lit(3))).otherwise(255).alias("a"))


def orient(y: Column, x: Column, height: Column, width: Column, orientation: Column) -> tuple[Column, Column]:
    """Where a stored pixel is shown, by EXIF orientation 1 to 8."""
    up, back = height - 1 - y, width - 1 - x
    new_y = F.when(orientation.isin(3, 4), up).when(orientation.isin(5, 6), x).when(orientation.isin(7, 8), back).otherwise(y)
    new_x = F.when(orientation.isin(2, 3), back).when(orientation.isin(5, 8), y).when(orientation.isin(6, 7), up).otherwise(x)
    return new_y, new_x


def palette_table(spark: SparkSession) -> DataFrame:
    """(label, pr, pg, pb): the six colours."""
    return spark.createDataFrame([(k, *c) for k, c in enumerate(PALETTE)], "label int, pr int, pg int, pb int")


def colour_of(label: Column) -> tuple[Column, Column, Column]:
    """The palette as literals, so that a lookup is no join."""
    r, g, b = (F.element_at(F.array(*[F.lit(c[k]) for c in PALETTE]), label + 1) for k in range(3))
    return r, g, b


def by_image(df: DataFrame) -> DataFrame:
    """Deals rows by image_id, and lets joins on image_id and more use that: an image is small, and there are many."""
    df.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return df.repartition("image_id")


def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, y, x, label, r, g, b, a): 500 events make an image of flat 5 x 5 regions, with noise where an event is an error.

    Rows are dealt by image once. Windows and groups by image and anything else then need no further exchange, and with
    `by_image` neither do joins.
    """
    size, row = WIDTH * HEIGHT, WIDTH
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.expr(f"event_id div {size}").alias("image_id"), F.expr(f"int((event_id % {size}) div {row})").alias("y"), F.expr(f"int(event_id % {row})").alias("x"), "user_id", "event_type"
    )
    cell = Window.partitionBy("image_id", F.expr(f"y div {BLOCK}"), F.expr(f"x div {BLOCK}"))
    anchor = (F.col("y") % BLOCK == 0) & (F.col("x") % BLOCK == 0)  # a region's first event; regions without one are left out
    first = lambda c: F.max(F.when(anchor, c)).over(cell)
    px = by_image(ev).select("image_id", "y", "x", "event_type", first((F.col("user_id") % len(PALETTE)).cast("int")).alias("label"), first(F.when(F.col("event_type") == "signup", 0).otherwise(255)).alias("a")).filter("label IS NOT NULL")
    own, after = colour_of(F.col("label")), colour_of((F.col("label") + 1) % len(PALETTE))
    noisy = F.col("event_type") == "error"
    return px.select("image_id", "y", "x", "label", *[F.when(noisy, F.floor((c + n) / 2).cast("int")).otherwise(c).alias(k) for k, c, n in zip("rgb", own, after, strict=True)], "a")


def rendered(px: DataFrame, dropped: int = 5) -> DataFrame:
    """The raster as a renderer would draw it: each pixel in its label's clean colour, one label missing."""
    r, g, b = colour_of(F.col("label"))
    return px.select("image_id", "y", "x", "label", r.alias("r"), g.alias("g"), b.alias("b"), F.when((F.col("a") < 128) | (F.col("label") == dropped), 0).otherwise(255).alias("a"))
