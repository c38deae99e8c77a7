"""strandloom: interval assembly and corpus analytics expressed on Spark DataFrames."""
