"""daftar: record linkage and evidence analytics on Spark DataFrames."""
