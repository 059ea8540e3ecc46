"""A PySpark engine that turns gridded, time-ordered measurements into a catalog of moving objects."""
