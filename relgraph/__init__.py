"""relgraph: relational graph queries and graph analytics on Spark DataFrames."""
