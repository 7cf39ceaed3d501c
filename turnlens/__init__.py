"""Turnlens: analytics over spoken-transcript corpora, on Spark DataFrames."""
