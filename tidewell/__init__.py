"""Catalogue engine on Spark: decoding, identity, scoring, lifecycle, search."""
