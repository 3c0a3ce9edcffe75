"""Image-series and lineage analytics as Spark jobs."""
