"""Column functions: names, planar geometry, cameras and scores."""
