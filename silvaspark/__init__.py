"""Forest mapping from airborne laser scans and satellite rasters, as lazy Spark plans."""
