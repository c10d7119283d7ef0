"""Reconstruction of gridded fields from along-track observations, on Spark DataFrames."""
