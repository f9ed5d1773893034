"""selenic - planetary raster analytics as Spark jobs."""
