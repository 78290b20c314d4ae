"""Jobs and the query registry built from the operators."""
