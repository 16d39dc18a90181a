"""Raster operators. Spark partitions the items; numpy works on one raster at a time inside Arrow batches."""
