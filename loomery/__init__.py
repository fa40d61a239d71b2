"""Loomery: a Spark-first engine for building and analysing very large non-redundant catalogues."""
