"""Document features, vector neighbours and classification evaluation on Spark DataFrames."""

__version__ = "0.1.0"
