"""Fixed compositions of operators (L1-L9) and the query catalog."""
