"""Lodestone: retrieval and analytics over source code and text, as Spark DataFrames."""
