"""Part of the raster engine."""
