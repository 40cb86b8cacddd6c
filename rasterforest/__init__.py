"""Connected filtering of rasters held in Spark tables."""
