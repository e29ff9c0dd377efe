"""Spark-first dataset toolkit: reading, filtering, merging, schema work and
physical maintenance of file datasets, all expressed as DataFrame plans."""

__version__ = "0.1.0"
