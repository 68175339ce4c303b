"""strandlake: sequence-homology analytics expressed as Spark DataFrames."""
