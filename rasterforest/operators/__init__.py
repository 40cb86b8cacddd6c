"""Operators on rasters, trees, node attributes, scores, data sets, patches and predictions."""
