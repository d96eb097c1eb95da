"""Line-of-sight and site analytics on Spark: links, rasters, snapping, corrections, graphs."""
