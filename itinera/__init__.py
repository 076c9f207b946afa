"""Trip, geospatial and temporal analytics on Spark DataFrames."""
