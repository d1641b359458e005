"""Spatial, temporal, network, raster-grid and data-quality analytics on Spark DataFrames."""
