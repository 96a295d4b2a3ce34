"""lexmatch: fuzzy dictionary matching and word-graph analytics on Spark."""
