"""Sources: raster views over tables, and binary files."""
