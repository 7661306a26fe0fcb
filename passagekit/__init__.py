"""Passage analytics on Spark: weather rasters, boat performance, coastlines, routes and their quality."""
