"""Compilers of declarative configurations to Spark plans."""
