"""Evidence graphs, partitions, fronts and paired statistics as Spark DataFrames."""
