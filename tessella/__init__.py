"""tessella: rasters, sampled signals and codec metadata as Spark relations."""
