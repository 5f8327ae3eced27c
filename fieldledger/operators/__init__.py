"""Table-level operators: DataFrame in, DataFrame out. Column names are parameters."""
