"""folioforge: document structuring, lexical retrieval and corpus processing on Spark DataFrames."""
