"""Photo-measure analytics on Spark: pixels, rasters and ratings as DataFrames."""
