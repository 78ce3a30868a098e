"""Question-and-answer forum analytics as lazily composed Spark DataFrames."""
