"""Pixelweir: raster analytics on Spark, as relations of pixels, palettes, layers and paths."""
