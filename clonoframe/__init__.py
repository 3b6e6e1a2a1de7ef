"""Clonoframe: repertoire analytics and corpus operators on Spark DataFrames."""
