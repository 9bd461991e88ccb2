"""Governed, versioned record analytics expressed as Spark DataFrames."""
