"""Writers: one file a row, results as JSON, and previews as PNG."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelweir.operators import documents, kernels


def write_results(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def previews(px: DataFrame) -> DataFrame:
    """(image_id, png): RGBA pixels as PNG bytes, one image a group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy()
        rgba = np.stack([kernels.dense(y, x, pdf[c].to_numpy(), 0) for c in "rgba"], axis=2).astype(np.uint8)
        return pd.DataFrame({"image_id": [pdf["image_id"].iloc[0]], "png": [documents.png_bytes(rgba)]})

    return px.select("image_id", "y", "x", "r", "g", "b", "a").groupBy("image_id").applyInPandas(run, "image_id long, png binary")


def write_files(df: DataFrame, folder: str, name: str, content: str) -> DataFrame:
    """Writes each row's content to folder/name from the executors through Hadoop-free Python I/O; the folder must be shared by all machines. Returns (name, size)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        for pdf in batches:
            sizes = []
            for n, c in zip(pdf["name"], pdf["content"], strict=True):
                path = os.path.normpath(os.path.join(folder, n))
                if not path.startswith(os.path.normpath(folder) + os.sep):
                    raise ValueError(f"{n} lies outside {folder}")
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(f"{path}.part", "wb") as f:
                    f.write(bytes(c))
                os.replace(f"{path}.part", path)  # a task that runs twice leaves one whole file
                sizes.append(len(c))
            yield pd.DataFrame({"name": pdf["name"], "size": sizes})

    return df.select(F.col(name).alias("name"), F.col(content).cast("binary").alias("content")).mapInPandas(run, "name string, size long")


def missing_files(wanted: DataFrame, folder: str) -> DataFrame:
    """Names of `wanted` (name) that the folder doesn't hold."""
    found = wanted.sparkSession.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"))
    return wanted.join(found, "name", "left_anti")
