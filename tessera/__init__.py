"""A raster analytics engine on Spark DataFrames."""
