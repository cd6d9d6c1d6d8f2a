"""Spatial sampling design on Spark: grids, strata, samples and quality metrics as DataFrame plans."""
