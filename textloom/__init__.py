"""A PySpark engine for curating text corpora."""
