"""Passagework: text-retrieval analytics as Spark DataFrames."""
