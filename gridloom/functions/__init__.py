"""Column expressions and raster kernels."""
