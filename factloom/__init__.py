"""factloom: evidence analytics over Spark DataFrames."""
