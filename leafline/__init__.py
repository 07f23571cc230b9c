"""Document-evidence engine on Spark DataFrames: line cleaning, chunking, ranking, context and evaluation."""

__version__ = "0.1.0"
