"""Image analytics as Spark jobs: rasters are relations of pixels."""
