"""Log search, log privacy, document preparation and hybrid retrieval on Spark tables."""
