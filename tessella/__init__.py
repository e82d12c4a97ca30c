"""Image-array and corpus analytics expressed as Spark DataFrames."""
