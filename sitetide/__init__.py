"""sitetide: website change analytics as Spark DataFrames."""
